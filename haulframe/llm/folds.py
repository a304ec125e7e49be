"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int, most_labels: int = 1000, shorten: Callable[[DataFrame], DataFrame] | None = None) -> list:
    """At most per_label rows of each label, chosen by a hash of key, in a fixed order; of rows with one label and key, the least.

    A first pass counts the labels; a second one keeps about twice per_label keys of each, of which the
    driver takes those with the smallest hash. What is collected is bounded by the two parameters;
    where rows may be long, shorten bounds each of them on the executors (it must keep label, key and __place).
    More than most_labels labels are an error, as none may be left out unnoticed.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label, key).count().groupBy(label).count().limit(most_labels + 1).collect()}
    if not counts:
        return []
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} different values of {label}")
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 2 * (per_label + 10) / n)))), F.col(label))
    place = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 20))
    some = rows.withColumn("__place", place).where(F.col("__place") < share * (1 << 20))
    some = shorten(some) if shorten else some
    # a key may stand in any number of rows
    others = [c for c in some.columns if c not in (label, key)]
    chosen = some.groupBy(label, key).agg(F.min(F.struct(*others)).alias("r")).select(label, key, "r.*").collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(chosen, key=lambda r: (r["__place"], str(r[key]))):
        if taken[r[label]] < per_label:
            taken[r[label]] += 1
            out.append(r)
    return out
