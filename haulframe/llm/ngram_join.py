"""Exact Jaccard self-join of documents on word shingles, as a blocked sparse matrix product.

The matrix has a row per different shingle set and a column per shingle. Blocks of columns (hash
buckets) first give each column's exact number of rows; columns of one row can take part in no
overlap and go. Per row the columns are then ordered rare first, and size-derived bounds decide which
entries of the product are computed at all: a row whose lone columns fill its prefix can reach the
wanted overlap with no other row, and an entry is only wanted at columns from which both rows still
have enough columns left. The wanted entries are dealt into blocks of bounded size, each some rows and
their partners; a block multiplies its rows with its partners' and adds up the overlap counts over all
columns, and entries below the bound that the two sizes give are discarded.

A group of near copies does not become all its entries: in each column the row with the fewest lone
columns is multiplied with all others first, and linked rows become one component. After that a row is
multiplied with rows of other components only, found by the rank of a component in the column, so no
two rows of one component meet again. Equal sets are one row from the start. The partners of a row
that has very many are dealt over several blocks.

Defined results: null or empty text has no shingles, links with nothing and is its own component;
repeated rows are equal sets; a null doc_id takes part, and its component is named by the smallest
doc_id that is not null (null if there is none). An input without rows gives none; a very long text is
one row like any other. A shingle counts as equal when its 64-bit hash is. ``cluster`` returns its own
columns only, ``keep_one`` those of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulframe.llm import incidence, tokens
from haulframe.llm.components import components
from haulframe.llm.storage import bucket_count, free_name, materialise

SHINGLE = 3
PERCENT = 90
#: Columns of partners that a block of the product holds, about.
BLOCK_COLUMNS = 1 << 18
#: Rows with more partners than a block holds are named to all tasks if they are at most so many, else joined.
MOST_NAMED = 1 << 18


def _sets(part: tokens.Slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their documents, in order of documents; size and signature of each document's set."""
    words = part.word_hashes()
    hashes, at = part.windows(words, k)
    owners = part.owners()[at]
    n_words = np.diff(part.word_bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        whole = n_words[short].astype(np.uint64)
        for j in range(k - 1):
            there = n_words[short] > j
            index = np.minimum(part.word_bounds[short] + j, len(words) - 1)
            whole = np.where(there, tokens.mix(whole + words[index] * np.uint64(2 * j + 3)), whole)
        hashes, owners = np.concatenate((hashes, whole)), np.concatenate((owners, short))
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    sizes = np.bincount(owners, minlength=part.n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens.mix(hashes), dtype=np.uint64)))
    ends = np.cumsum(sizes)
    signs = tokens.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
    return hashes, owners, sizes, signs


_SIGNED = "doc_id bigint, text_hash bigint, row bigint, n_shingles bigint"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64())])


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.frugal(batches):
            for part in tokens.slices(batch.column(2), lower=True):
                _, _, sizes, signs = _sets(part, k)
                ids, texts = (batch.column(c).slice(part.first, part.n) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(signs, mask=sizes == 0), pa.array(sizes.astype(np.int64))], schema=_SIGNED_ARROW)

    return run


def _columns_of_rows(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, held, seen = [], [], 0, set()

        def packed() -> pa.RecordBatch:
            every = np.concatenate(hashes)
            return incidence.pack(incidence.top(every, buckets), every, np.concatenate(rows))

        for batch in tokens.frugal(batches):
            for part in tokens.slices(batch.column(0), lower=True):
                found, owners, sizes, signs = _sets(part, k)
                new = np.zeros(part.n, bool)
                for i in np.flatnonzero(sizes):
                    if signs[i] not in seen:
                        seen.add(signs[i])
                        new[i] = True
                mine = new[owners]
                hashes.append(found[mine])
                rows.append(signs[owners[mine]])
                held += len(hashes[-1])
                if held > incidence.PACK_PAIRS:
                    yield packed()
                    hashes, rows, held, seen = [], [], 0, set()
        if held:
            yield packed()

    return run


def _shared_columns(buckets: int):
    """buckets: the coarse ones of the rows."""

    def run(table: pa.Table) -> pa.Table:
        hashes, rows = incidence.joined(table.column("hashes"), np.uint64), incidence.joined(table.column("owners"), np.int64)
        at = incidence.repeated(hashes)
        hashes, rows = hashes[at], rows[at]
        order = np.lexsort((rows, hashes))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
        begins, run = incidence.group_ids(hashes)
        counts = np.bincount(run, minlength=len(begins))[run] if len(run) else run
        shared = counts > 1
        hashes, rows, counts = hashes[shared], rows[shared], counts[shared]
        order = np.argsort(rows, kind="stable")
        hashes, rows, counts = hashes[order], rows[order], counts[order]
        return pa.Table.from_batches([incidence.pack(incidence.owner_bucket(rows, buckets), hashes, rows, counts)])

    return tokens.thrifty(run)


_ROWS = "row bigint, n int, lone int, prefix int, columns array<bigint>"
_ROWS_ARROW = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("lone", pa.int32()), ("prefix", pa.int32()), ("columns", pa.list_(pa.int64()))])


def _rare_first(percent: int):
    def run(table: pa.Table, sizes: pa.Table) -> pa.Table:
        rows, hashes, counts, begins = incidence.owned(table)
        out = []
        if len(rows):
            named, n = sizes.column("row").to_numpy(), sizes.column("n").to_numpy()
            order = np.argsort(named)
            rows, shared = rows[begins[:-1]], np.diff(begins)
            n = n[order][np.searchsorted(named[order], rows)]
            prefix, lone = n - (percent * n + 99) // 100 + 1, n - shared
            for i in np.flatnonzero(lone < prefix):
                mine = slice(begins[i], begins[i + 1])
                columns = hashes[mine].view(np.int64)
                out.append((rows[i], n[i], lone[i], prefix[i] - lone[i], columns[np.lexsort((columns, counts[mine]))]))
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 5, _ROWS_ARROW)], schema=_ROWS_ARROW)

    return tokens.thrifty(run)


def candidate_rows(docs: DataFrame, signed: DataFrame, text: str, k: int, percent: int, buckets: int | None = None, fan_out: int = incidence.FAN_OUT) -> DataFrame:
    """The rows that can link with another: row, n, lone, prefix, columns (shared by other rows, rare first)."""
    buckets = buckets or bucket_count(docs, text)
    first = incidence.coarse(buckets, fan_out)
    packed = docs.select(F.col(text).alias("t")).mapInArrow(_columns_of_rows(k, first), incidence.PACKED)
    shared = incidence.split(packed, buckets, fan_out=fan_out).groupBy("bucket").applyInArrow(_shared_columns(first), incidence.PACKED)
    shared = incidence.split(shared, buckets, by_owner=True, fan_out=fan_out)
    sizes = signed.where("row is not null").groupBy("row").agg(F.max("n_shingles").alias("n")).withColumn("bucket", incidence.owner_bucket_column(F.col("row"), buckets))
    return shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_rare_first(percent), _ROWS)


_LINKS = "a bigint, b bigint"
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _multiply(percent: int):
    """A block of the product: links between its rows (second table) and their partners (first table)."""

    def run(partners: pa.Table, rows: pa.Table) -> pa.Table:
        ids, n = rows.column("own").to_numpy(), rows.column("own_n").to_numpy().astype(np.int64)
        own = rows.column("own_columns").combine_chunks()
        own_at, own_flat = own.offsets.to_numpy(), own.values.to_numpy()
        names, of = partners.column("b").to_numpy(), partners.column("row").to_numpy()
        m = partners.column("n").to_numpy().astype(np.int64)
        theirs = partners.column("columns").combine_chunks()
        at, flat = theirs.offsets.to_numpy().astype(np.int64), theirs.values.to_numpy()
        order = np.argsort(of, kind="stable")
        begins, _ = incidence.group_ids(of[order])
        place = dict(zip(ids.tolist(), range(len(ids))))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in np.split(order, begins[1:]) if len(order) else ():
            i = place[int(of[some[0]])]
            mine = np.sort(own_flat[own_at[i] : own_at[i + 1]])
            lengths = at[some + 1] - at[some]
            columns = flat[tokens.ragged(at[some], lengths)]
            hit = mine[np.minimum(np.searchsorted(mine, columns), len(mine) - 1)] == columns
            overlap = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
            good = overlap * 100 >= (n[i] + m[some] - overlap) * percent
            a.append(np.full(int(good.sum()), ids[i]))
            b.append(names[some[good]])
        return pa.table([np.concatenate(a), np.concatenate(b)], schema=_LINKS_ARROW)

    return tokens.thrifty(run)


def product(wanted: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links a, b among the wanted entries (row, b, weight: columns of b) of the product."""
    wanted = materialise(wanted)
    weights = wanted.groupBy("row").agg(F.sum("weight").alias("total"))
    blocks = max(1, -(-(wanted.agg(F.sum("weight")).head()[0] or 0) // BLOCK_COLUMNS))
    large = materialise(weights.where(F.col("total") > BLOCK_COLUMNS).select("row", F.ceil(F.col("total") / BLOCK_COLUMNS).cast("int").alias("parts")))
    if large.count() <= MOST_NAMED:
        large = F.broadcast(large)
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    placed = wanted.join(large, "row", "left").select("row", "b", F.pmod(F.xxhash64("row", part), F.lit(blocks)).cast("bigint").alias("block"))
    of_b = rows.select(F.col("row").alias("b"), "n", "columns")
    partners = placed.join(of_b, "b").select("block", "row", "b", "n", "columns")
    of_row = rows.select(F.col("row").alias("own"), F.col("n").alias("own_n"), F.col("columns").alias("own_columns"))
    own = placed.select(F.col("block").alias("own_block"), F.col("row").alias("own")).distinct().join(of_row, "own").select("own_block", "own", "own_n", "own_columns")
    return partners.groupBy("block").cogroup(own.groupBy("own_block")).applyInArrow(_multiply(percent), _LINKS)


def _prefixes(rows: DataFrame) -> DataFrame:
    """row, n, column, left (columns from it on), odd (share of lone columns), weight for each column of the rows' prefixes."""
    at = F.posexplode(F.slice("columns", 1, F.col("prefix")))
    every = rows.select("row", "n", "lone", at.alias("i", "column"))
    return every.select("row", "n", "column", (F.col("n") - F.col("lone") - F.col("i")).alias("left"), (F.col("lone") / F.col("n")).alias("odd"), (F.col("n") - F.col("lone")).alias("weight"))


def _enough(percent: int) -> Column:
    """Whether x and y can reach the wanted overlap from the column on."""
    return F.least("x.left", "y.left") * (100 + percent) >= F.lit(percent) * (F.col("x.n") + F.col("y.n"))


def stars(prefix: DataFrame, percent: int) -> DataFrame:
    """Wanted entries between the row of each column that has the fewest lone columns and the others there."""
    first = F.min(F.struct("odd", "row", "n", "left")).alias("first")
    pivots = prefix.groupBy("column").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("column", "first.*")
    met = prefix.alias("x").join(pivots.alias("y"), F.col("x.column") == F.col("y.column")).where(_enough(percent) & (F.col("x.row") != F.col("y.row")))
    return met.groupBy(F.col("y.row").alias("row"), F.col("x.row").alias("b")).agg(F.max("x.weight").alias("weight"))


def across(prefix: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Wanted entries between rows of different components (known: row, component) that share a prefix column.

    The bound for two rows, added up for both, says that their slacks together aren't negative. So rows whose
    slack even the best one of the column doesn't make up for go first. In each column the components are then
    ranked by their best slack. A row goes to each component of a better rank, one with a negative slack only
    to those with a positive one, and meets its rows there; only entries across components are formed.
    """
    slack = F.col("left") * (100 + percent) - F.col("n") * (2 * percent)
    told = prefix.join(known, "row", "left").withColumns({"component": F.coalesce("component", "row"), "slack": slack.cast("bigint")})
    several = told.groupBy("column").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.max("slack").alias("best")).where("c != d").select("column", "best")
    told = materialise(told.join(several, "column").where("slack + best >= 0").drop("best"))
    held = told.groupBy("column", "component").agg(F.max("slack").alias("reach"))
    of_column = Window.partitionBy("column")
    rank = F.row_number().over(of_column.orderBy(F.desc("reach"), "component"))
    held = held.select("column", "component", rank.alias("rank"), F.count_if(F.col("reach") > 0).over(of_column).alias("open"))
    told = told.join(held, ["column", "component"])
    last = F.when(F.col("slack") < 0, F.least(F.col("rank") - 1, F.col("open"))).otherwise(F.col("rank") - 1)
    going = told.withColumn("last", last).where("last > 0").withColumn("to", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))))
    met = going.alias("x").join(told.alias("y"), (F.col("x.column") == F.col("y.column")) & (F.col("x.to") == F.col("y.rank"))).where(_enough(percent))
    return met.groupBy(F.col("x.row").alias("row"), F.col("y.row").alias("b")).agg(F.max("y.weight").alias("weight"))


def _linked(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of the stars, their components (row, component), and links across these."""
    prefix = _prefixes(rows)
    near = materialise(product(stars(prefix, percent), rows, percent))
    known = components(near).withColumnRenamed("node", "row")
    return near, known, materialise(product(across(prefix, known, percent), rows, percent))


def links(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links a, b between rows that join all rows of each component, though not every pair of it."""
    near, _, far = _linked(rows, percent)
    return near.union(far)


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = materialise(plain.mapInArrow(_sign(k), _SIGNED))
    rows = materialise(candidate_rows(docs, signed, text, k, percent))
    _, known, far = _linked(rows, percent)
    if not far.isEmpty():
        known = components(known.select(F.col("row").alias("a"), F.col("component").alias("b")).union(far)).withColumnRenamed("node", "row")
    named = signed.where("row is not null").groupBy("row").agg(F.min("doc_id").alias("first_id"))
    of_row = known.join(named, "row")
    least = of_row.groupBy("component").agg(F.min("first_id").alias("least_id"))
    joined = materialise(of_row.join(least, "component").select("row", "least_id"))
    named = named.join(joined, "row", "left").select("row", F.coalesce("least_id", "first_id").alias("component_id"))
    alone = signed.where("row is null").withColumn("component_id", F.col("doc_id"))
    return signed.where("row is not null").join(named, "row").unionByName(alone).select("doc_id", "text_hash", "n_shingles", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id.

    Documents without shingles stay, as do those without doc_id that link with none that has one.
    Of repeated rows (same doc_id and text) one stays.
    """
    found = cluster(docs, text, doc_id, k, percent).where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    def key(d: str, h: str) -> Column:
        return F.concat_ws("|", F.coalesce(F.col(d).cast("bigint").cast("string"), F.lit("none")), F.col(h))

    # the semi-join and the removal of repeated rows go by one key, so the texts are shuffled once
    name = free_name("key", docs.columns)
    chosen = found.select(key("doc_id", "text_hash").alias(name)).distinct()
    marked = docs.withColumn(name, F.xxhash64(text)).withColumn(name, key(doc_id, name))
    return marked.join(chosen, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cluster(docs).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
    FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a) USING (doc_id)
"""
