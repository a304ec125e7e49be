"""Exact substring removal across documents by Rabin-Karp hashes of every fixed-length window.

Three steps. Map tasks hash every window of ``width`` words and keep, for each hash of a batch, the
smallest doc_id; windows that already lose inside the batch are known to be repeated and go straight to
the buckets of their documents. Buckets of the hash space count what is left: in a group of equal
hashes, at most one pair a batch, all but the smallest doc_id lose.
The lost hashes return to their documents, whose windows merge into maximal removal intervals.

Defined results: null text has no words; a null doc_id neither removes nor loses anything; equal
doc_ids are no reason for each other's removal; repeated rows are each treated alike; a text of
fewer than ``width`` words is kept whole; a very long text is treated whole, as a slice of its own. An input
without rows gives an output without rows.
Columns of the input are kept, whatever their names. A window counts as equal when its 64-bit hash is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm import incidence, tokens
from haulframe.llm.storage import bucket_count, free_name

WIDTH = 13


def _first_in_batch(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pair per hash, with the smallest id; and the pairs that lose to it, once each."""
    at = incidence.repeated(hashes)
    alone = np.ones(len(hashes), bool)
    alone[at] = False
    begins, run = incidence.group_ids(hashes[at])
    if not len(at):
        return hashes, ids, hashes[:0], ids[:0]
    least = np.minimum.reduceat(ids[at], begins)
    lost = ids[at] > least[run]
    keys, least_ids = hashes[at][begins], least
    lost_hashes, lost_ids = hashes[at][lost], ids[at][lost]
    order = np.lexsort((lost_hashes, lost_ids))
    lost_hashes, lost_ids = lost_hashes[order], lost_ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (lost_hashes[1:] != lost_hashes[:-1]) | (lost_ids[1:] != lost_ids[:-1])
    # pairs with the same id lie together again, for the sake of compression
    first = np.concatenate((np.flatnonzero(alone), at[begins]))
    order = np.argsort(first, kind="stable")
    return np.concatenate((hashes[alone], keys))[order], np.concatenate((ids[alone], least_ids))[order], lost_hashes[new], lost_ids[new]


def _hash_windows(width: int, buckets: int):
    def packed(hashes: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, ids, lost_hashes, lost_ids = _first_in_batch(np.concatenate(hashes), np.concatenate(ids))
        yield incidence.pack(incidence.top(hashes, buckets), hashes, ids)
        if len(lost_ids):  # these need no counting, and go by their documents, so that no hash gathers them
            yield incidence.pack(-1 - incidence.owner_bucket(lost_ids, buckets), lost_hashes, lost_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held = [], [], 0
        for batch in tokens.frugal(batches):
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in tokens.slices(batch.column(1)):
                found, at = part.windows(part.word_hashes(), width)
                hashes.append(found)
                ids.append(doc_ids[part.first + part.owners()[at]])
                held += len(found)
                if held > incidence.PACK_PAIRS:
                    yield from packed(hashes, ids)
                    hashes, ids, held = [], [], 0
        if held:
            yield from packed(hashes, ids)

    return run


def _count_bucket(buckets: int):
    """buckets: the coarse ones of the owners."""

    def run(table: pa.Table) -> pa.Table:
        hashes, ids = incidence.joined(table.column("hashes"), np.uint64), incidence.joined(table.column("owners"), np.int64)
        if table.column("bucket")[0].as_py() >= 0:
            at = incidence.repeated(hashes)
            hashes, ids = hashes[at], ids[at]
            begins, run = incidence.group_ids(hashes)
            lost = ids > np.minimum.reduceat(ids, begins)[run] if len(ids) else np.zeros(0, bool)
            hashes, ids = hashes[lost], ids[lost]
        order = np.argsort(ids, kind="stable")
        return pa.Table.from_batches([incidence.pack(incidence.owner_bucket(ids[order], buckets), hashes[order], ids[order])])

    return tokens.thrifty(run)


def repeated_windows(docs: DataFrame, buckets: int, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, fan_out: int = incidence.FAN_OUT) -> DataFrame:
    """The windows that a smaller doc_id also has, packed by buckets of the documents that lose them."""
    first = incidence.coarse(buckets, fan_out)
    known = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    packed = incidence.split(known.mapInArrow(_hash_windows(width, first), incidence.PACKED), buckets, fan_out=fan_out)
    lost = packed.groupBy("bucket").applyInArrow(_count_bucket(first), incidence.PACKED)
    return incidence.split(lost, buckets, by_owner=True, fan_out=fan_out)


def _cut(batch: pa.RecordBatch, text_at: int, id_at: int, lost: dict[int, np.ndarray], width: int) -> tuple[list, list, list]:
    """Kept texts, numbers of words and of removed words of a batch; lost has the hashes that each document loses."""
    texts, n_words, n_removed = [], [], []
    ids = batch.column(id_at)
    for part in tokens.slices(batch.column(text_at)):
        hashes, at = part.windows(part.word_hashes(), width)
        window_bounds = np.searchsorted(at, part.word_bounds)
        change = np.zeros(len(part.starts) + 1, np.int32)
        for doc in range(part.n):
            mine = lost.get(ids[part.first + doc].as_py())
            if mine is not None:
                a, b = window_bounds[doc], window_bounds[doc + 1]
                hit = at[a:b][np.isin(hashes[a:b], mine)]
                np.add.at(change, hit, 1)
                np.add.at(change, hit + width, -1)
        keep = np.cumsum(change[:-1]) == 0  # outside all removal intervals
        starts, lengths = part.starts[keep], (part.ends - part.starts)[keep]
        kept_words = np.concatenate(([0], np.cumsum(keep)))[part.word_bounds]
        # each kept word and one space after it; the last space of a document goes
        flat = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
        to = np.concatenate(([0], np.cumsum(lengths + 1)))
        flat[tokens.ragged(to[:-1], lengths)] = part.data[tokens.ragged(starts, lengths)]
        for doc in range(part.n):
            a, b = to[kept_words[doc]], to[kept_words[doc + 1]]
            texts.append(flat[a : max(a, b - 1)].tobytes().decode("utf-8", "replace"))
        n_words += np.diff(part.word_bounds).tolist()
        n_removed += (np.diff(part.word_bounds) - np.diff(kept_words)).tolist()
    return texts, n_words, n_removed


def _cut_bucket(text_at: int, id_at: int, width: int, schema: pa.Schema):
    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        owners, hashes, _, begins = incidence.owned(packed)
        lost = {int(owners[i]): hashes[i:j] for i, j in zip(begins[:-1], begins[1:])}
        out = []
        for batch in docs.to_batches():
            made = [*batch.columns[: len(schema) - 3], *(pa.array(c) for c in _cut(batch, text_at, id_at, lost, width))]
            out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return tokens.thrifty(run)


def remove_repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, buckets: int | None = None, fan_out: int = incidence.FAN_OUT) -> DataFrame:
    """docs with three columns more: kept_text, n_words, n_removed (names are lengthened if docs has them).

    kept_text is the words that are left, joined by one space. Texts meet their lost windows bucket by
    bucket; a bucket holds a bounded amount of text, documents without id are spread over all of them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    buckets = buckets or bucket_count(docs, text)
    lost = repeated_windows(docs, buckets, text, doc_id, width, fan_out)
    bucket = free_name("bucket", docs.columns)
    spread = F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(text))
    both = docs.withColumn(bucket, incidence.owner_bucket_column(spread, buckets))
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("kept_text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())):
        schema = schema.add(free_name(name, schema.names), kind)
    low = [x.lower() for x in docs.columns]
    cut = _cut_bucket(low.index(text.lower()), low.index(doc_id.lower()), width, to_arrow_schema(schema))
    return both.groupBy(bucket).cogroup(lost.groupBy("bucket")).applyInArrow(cut, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
least AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
lost AS (
    SELECT DISTINCT w.doc_id, w.i + j AS p
    FROM windows w JOIN least USING (g), (SELECT unnest(range(0, 13)) AS j) WHERE w.doc_id > first_doc),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM lost GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
