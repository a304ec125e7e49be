"""Benchmark decontamination by spaced-seed hashing.

Each mask hashes seven of the words at fixed places of a span and ignores the others, so a hit
survives substitutions at the ignored places. The three masks together hit every thirteen-word
window with up to two substituted words (the tests enumerate them all). Of items shorter than that
the first and the last half are hashed as well, one of which a single substitution leaves alone, and of
those of fewer than ``EXACT`` words the whole.

Spark joins the seeds of texts and items; a filter of at most ``FILTER_BITS`` bits, in which the items'
seeds are marked, lets through what a text's seeds can join at all, so the join is small and the texts
are read once for any benchmark. A hit names an item, a text and a diagonal; on each diagonal all words
are compared, and windows of ``WINDOW`` words with at most ``SUBSTITUTIONS`` different ones make up the
reported overlap. Equal texts and equal items are joined and compared once and reported for each of their
rows. Equality of words, seeds and whole texts is that of 64-bit hashes.

Words are runs of letters and digits (A-Z as a-z, other characters beyond ASCII count as letters).
Defined results: null or empty text and null or empty items match nothing; an item of fewer words than
``WINDOW`` must occur whole, with proportionally fewer substitutions; one of fewer than ``EXACT`` words
without any, down to a single word. Repeated documents or items are each reported; null ids are
carried through; very long texts are compared whole, with a bounded number of words at a time. Without
rows on either side nothing is reported. Columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm import tokens
from haulframe.llm.storage import free_name, materialise

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 4, 6, 7, 8, 9), (0, 1, 3, 4, 7, 9, 10))
#: Items of fewer words must occur unchanged.
EXACT = 8

#: The filter has at least as many bits for each seed of the items, up to its bound (32 MB).
BITS_PER_SEED = 256
FILTER_BITS = 28
#: Texts that a group of the comparison holds, about, and words that are compared at a time.
GROUP_TEXTS = 64
COMPARED = 1 << 20
#: Matched texts that are named to all tasks (8 bytes each); more are joined.
MOST_NAMED = 1 << 20

#: Bytes that end a word: all of ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

def _seeds(hashes: np.ndarray, mask: tuple[int, ...], which: int) -> np.ndarray:
    """The spaced hash at every word that a span begins with, across document bounds."""
    n = max(len(hashes) - mask[-1], 0)
    out = np.full(n, which + 1, np.uint64)
    for place in mask:
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[place : place + n]
    return tokens.mix(out)


def _halves(n: int) -> int:
    """Words of the whole seeds of an item of n words; 0 where the masks reach all of it."""
    return n if n < EXACT else n // 2 if n < WINDOW else 0


def _item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of an item and the words that they begin with."""
    seeds, at = [], []
    for which, mask in enumerate(MASKS):
        seeds.append(_seeds(words, mask, which))
        at.append(np.arange(len(seeds[-1])))
    n = _halves(len(words))
    if n:
        places = np.unique([0, len(words) - n])
        seeds.append(_seeds(words, tuple(range(n)), len(MASKS) + n)[places])
        at.append(places)
    return np.concatenate(seeds), np.concatenate(at)


def _grouped(first: np.ndarray, seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One entry for each different (first, seed), with the list of its places."""
    order = np.lexsort((at, seeds, first))
    first, seeds, at = first[order], seeds[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (seeds[1:] != seeds[:-1])
    begins = np.flatnonzero(new)
    return first[begins], seeds[begins], pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), pa.array(at, pa.int32()))


_WORDS = "item bigint, words array<bigint>"
_HITS = "item bigint, seed bigint, at array<int>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of each item."""
    for batch in tokens.frugal(batches):
        for part in tokens.slices(batch.column(1), lower=True, separators=NOT_ALNUM):
            words = pa.ListArray.from_arrays(pa.array(part.word_bounds, pa.int32()), pa.array(part.word_hashes().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), words], names=["item", "words"])


def _seeds_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1)):
            seeds, at = _item_seeds(words.values.to_numpy().view(np.uint64))
            items, seeds, places = _grouped(np.full(len(seeds), item), seeds.view(np.int64), at)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(seeds), places], names=["item", "seed", "at"])


def _marks(seeds: np.ndarray, bits: int) -> np.ndarray:
    return (tokens.mix(seeds.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _seeds_of_texts(sent, sizes: list[int]):
    masks = [*enumerate(MASKS), *((len(MASKS) + n, tuple(range(n))) for n in sizes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, marked = sent.value
        for batch in tokens.frugal(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for part in tokens.slices(batch.column(1), lower=True, separators=NOT_ALNUM):
                words, owners = part.word_hashes(), part.owners()
                found = [(np.zeros(0, np.int64),) * 3]
                for which, mask in masks:
                    seeds = _seeds(words, mask, which)
                    mark = _marks(seeds, bits)
                    maybe = np.flatnonzero(marked[mark >> 3] >> (mark & 7).astype(np.uint8) & 1)
                    maybe = maybe[owners[maybe] == owners[maybe + mask[-1]]]
                    found.append((owners[maybe], seeds[maybe].view(np.int64), maybe - part.word_bounds[owners[maybe]]))
                doc, seeds, at = (np.concatenate(x) for x in zip(*found))
                if len(doc):
                    doc, seeds, places = _grouped(doc, seeds, at)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc + part.first], pa.int64()), pa.array(seeds), places], names=["key", "seed", "at"])

    return run


def shifts(there: np.ndarray, here: np.ndarray) -> np.ndarray:
    """All different values of there minus here; memory and results grow with their spans, not with the product."""
    if len(there) * len(here) <= 4 * (len(there) + len(here)):
        return np.unique(there[:, None] - here[None, :])
    least = int(there.min() - here.max())
    seen = np.zeros(int(there.max() - here.min()) - least + 1, bool)
    few, many, sign = (here, there - least, -1) if len(here) <= len(there) else (there - least, -here, 1)
    for x in few:
        seen[many + sign * x] = True
    return np.flatnonzero(seen) + least


def _diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, items, lines = [], [], [np.zeros(0, np.int64)]
        for key, item, there, here in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            lines.append(shifts(there.values.to_numpy().astype(np.int64), here.values.to_numpy().astype(np.int64)))
            keys.append(np.full(len(lines[-1]), key, np.int64)), items.append(np.full(len(lines[-1]), item, np.int64))
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([np.concatenate([none, *keys]), np.concatenate([none, *items]), np.concatenate(lines)], names=["key", "item", "shift"])


def compared(words: np.ndarray, item: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows (first word in the text, words, equal words) of the overlaps of a text and an item on these diagonals."""
    size = len(item)
    window = min(WINDOW, size)
    allowed = 0 if size < EXACT else SUBSTITUTIONS * window // WINDOW
    first, last = np.maximum(0, -lines), np.minimum(size, len(words) - lines)
    lines, first, last = (x[last - first >= window] for x in (lines, first, last))
    out = [np.zeros((0, 3), np.int64)]
    ends = np.cumsum(last - first)
    i = 0
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COMPARED, side="right")))
        lengths = last[i:j] - first[i:j]
        index = tokens.ragged(first[i:j], lengths)
        line = np.repeat(np.arange(j - i), lengths)
        equal = words[index + lines[i:j][line]] == item[index]
        sums = np.concatenate(([0], np.cumsum(equal)))
        begin = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(len(index))
        place = place[place + window <= begin[line + 1]]
        place = place[sums[place + window] - sums[place] >= window - allowed]
        if len(place):
            line = line[place]
            begins = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            a, b = place[begins], place[np.concatenate((begins[1:], [len(line)])) - 1] + window
            out.append(np.stack((index[a] + lines[i:j][line[begins]], b - a, sums[b] - sums[a]), 1))
        i = j
    return np.concatenate(out)


_FOUND = "key bigint, item bigint, start_word bigint, n_words bigint, n_equal bigint"
_FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("key", "item", "start_word", "n_words", "n_equal")])


def _verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """The overlaps of some texts (group, key, text) with the items that their seeds hit (group, key, item, words, shifts)."""
    words_of: dict[int, np.ndarray] = {}
    keys = texts.column("key").to_pylist()
    for part in tokens.slices(texts.column("text").combine_chunks(), lower=True, separators=NOT_ALNUM):
        words = part.word_hashes()
        for i in range(part.n):
            words_of[keys[part.first + i]] = words[part.word_bounds[i] : part.word_bounds[i + 1]]
    out = [np.zeros((0, 5), np.int64)]
    for key, item, words, lines in zip(pairs.column("key").to_pylist(), pairs.column("item").to_pylist(), pairs.column("words"), pairs.column("shifts")):
        rows = compared(words_of[key], words.values.to_numpy().view(np.uint64), np.sort(lines.values.to_numpy()))
        out.append(np.concatenate((np.broadcast_to([key, item], (len(rows), 2)), rows), 1))
    return pa.table(list(np.concatenate(out).T.copy()), schema=_FOUND_ARROW)


def _filter(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of the filter's places, and the filter: a bounded array with the seeds' places marked."""
    n = seeds.count()
    bits = min(max(20, int(BITS_PER_SEED * n).bit_length()), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = np.unique(_marks(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array(mark >> 6), pa.array(np.left_shift(np.uint64(1), (mark & 63).astype(np.uint64)).view(np.int64))], names=["place", "marks"])

    # at most a row for each 64 bits of the filter
    rows = seeds.select("seed").mapInArrow(run, "place bigint, marks bigint").groupBy("place").agg(F.bit_or("marks").alias("marks")).toArrow()
    marked = np.zeros(1 << (bits - 6), np.int64)
    marked[rows.column("place").to_numpy()] = rows.column("marks").to_numpy()
    return bits, marked.view(np.uint8)


def matches(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str) -> DataFrame:
    """key, item, start_word, n_words, n_equal of all overlaps of different texts and different items (xxhash64 of each)."""
    spark = docs.sparkSession
    items = benchmark.select(F.xxhash64(item_text).alias("item"), F.col(item_text).alias("t")).where("t IS NOT NULL").groupBy("item").agg(F.first("t").alias("t"))
    words = materialise(items.mapInArrow(_items, _WORDS))
    seeds = materialise(words.mapInArrow(_seeds_of_items, _HITS))
    sizes = sorted({_halves(r[0]) for r in words.select(F.size("words")).where(F.size("words") < WINDOW).distinct().collect()} - {0})
    texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    sent = spark.sparkContext.broadcast(_filter(seeds))
    hits = texts.mapInArrow(_seeds_of_texts(sent, sizes), "key bigint, seed bigint, at array<int>").dropDuplicates(["key", "seed"])
    met = hits.join(seeds.select("seed", "item", F.col("at").alias("here")), "seed").select("key", "item", "at", "here")
    lines = met.mapInArrow(_diagonals, "key bigint, item bigint, shift bigint").groupBy("key", "item").agg(F.collect_set("shift").alias("shifts"))
    lines = materialise(lines)
    named = lines.select("key").distinct()
    n = named.count()
    groups = max(1, n // GROUP_TEXTS)
    pairs = lines.join(words, "item").select(F.pmod("key", F.lit(groups)).alias("group"), "key", "item", "words", "shifts")
    wanted = texts.join(F.broadcast(named) if n <= MOST_NAMED else named, "key", "left_semi").dropDuplicates(["key"])
    wanted = wanted.select(F.pmod("key", F.lit(groups)).alias("of_group"), F.col("key").alias("key"), "text")
    return pairs.groupBy("group").cogroup(wanted.groupBy("of_group")).applyInArrow(tokens.thrifty(_verify), _FOUND)


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_equal (long) of every verified overlap; words count from 0."""
    found = materialise(matches(docs, benchmark, text, item_text))
    ids = docs.select(F.xxhash64(text).alias("key"), F.col(doc_id).cast("bigint").alias("doc_id"))
    items = benchmark.select(F.xxhash64(item_text).alias("item"), F.col(item_id).cast("bigint").alias("item_id"))
    return found.join(items, "item").join(ids, "key").select("doc_id", "item_id", "start_word", "n_words", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """docs without the documents that overlap with any item of the benchmark."""
    found = materialise(matches(docs, benchmark, text, item_text).select("key").distinct())
    key = free_name("key", docs.columns)
    gone = found.withColumnRenamed("key", key)
    if found.count() <= MOST_NAMED:
        gone = F.broadcast(gone)
    return docs.withColumn(key, F.xxhash64(text)).join(gone, key, "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    """The same by seeds and diagonals in DuckDB's SQL; the masks leave no window out, so hashes don't matter. It lacks the look-ups for items of fewer than ``WINDOW`` words."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    def seeds(table: str, key: str) -> str:
        parts = [f"SELECT {key}, p, {k} AS mask, concat_ws(' ', {', '.join(f'w[p + {o}]' for o in mask)}) AS seed FROM {table} WHERE p + {mask[-1]} <= len(w)" for k, mask in enumerate(MASKS)]
        return " UNION ALL ".join(parts)

    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
d_at AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
b_at AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM b),
d_seeds AS ({seeds("d_at", "doc_id")}),
b_seeds AS ({seeds("b_at", "item_id")}),
lines AS (SELECT DISTINCT x.doc_id, y.item_id, x.p - y.p AS shift FROM d_seeds x JOIN b_seeds y USING (mask, seed)),
places AS (
    SELECT l.*, j, least({WINDOW}, len(b.w)) AS n, (d.w[j + shift] = b.w[j])::INTEGER AS equal
    FROM lines l JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.w) + 1)) AS t(j) WHERE j + shift BETWEEN 1 AND len(d.w)),
windows AS (
    SELECT *, sum(equal) OVER near AS got, count(*) OVER near AS full_size FROM places
    WINDOW near AS (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)),
good AS (
    SELECT doc_id, item_id, shift, min(j) AS a, max(j + n) AS z FROM windows
    WHERE full_size = n AND got >= n - {SUBSTITUTIONS} * n // {WINDOW} GROUP BY ALL)
SELECT g.doc_id, g.item_id, (a + g.shift - 1)::BIGINT AS start_word, (z - a)::BIGINT AS n_words, sum(equal)::BIGINT AS n_equal
FROM good g JOIN places p ON p.doc_id = g.doc_id AND p.item_id = g.item_id AND p.shift = g.shift AND j >= a AND j < z
GROUP BY g.doc_id, g.item_id, g.shift, a, z
"""


OP5_SQL = _sql()
