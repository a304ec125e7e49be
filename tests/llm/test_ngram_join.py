import random

import plain
import pytest
from plain import TEXTS

from haulframe.llm.components import components
from haulframe.llm.ngram_join import cluster, keep_one


def near_copies(seed, n=90):
    """Texts, copies, and copies of copies with some words changed."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(f"{rng.choice('abc')}{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 30, 60, 90]))))
    ids = list(range(n))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, k, percent", [(0, 3, 90), (1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_equals_plain_version(spark, seed, k, percent):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in cluster(df, k=k, percent=percent).collect()}
    want = {d: (c, len(plain.shingles(t, k))) for (d, t), c in zip(docs, plain.components(docs, k, percent))}
    assert got == want


def test_links_across_pivots_are_found(spark):
    """A chain: each text links with the next only, and none with all."""
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(12):
        docs.append((i, " ".join([*[f"c{i}_{j}" for j in range(0)], *[f"x{j}" if j < 8 * i else w for j, w in enumerate(base)]])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in cluster(df).collect()}
    assert got == dict(zip(range(12), plain.components(docs, 3, 90)))


def test_a_stranger_meets_each_near_copy_once(spark):
    """20,000 rows of one component and a stranger share a column: no two rows of the component meet again."""
    from pyspark.sql import functions as F

    from haulframe.llm.ngram_join import across

    n = 20_000
    prefix = spark.range(n + 1).select(F.col("id").alias("row"), F.lit(50).alias("n"), F.lit(7).cast("bigint").alias("column"), F.lit(50).alias("left"), F.lit(0.0).alias("odd"), F.lit(50).alias("weight"))
    known = spark.range(n).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("component"))
    met = across(prefix, known, 90)
    assert met.count() == n and met.where(f"(row = {n}) != (b = {n})").count() == n


def test_rows_that_cannot_reach_the_bound_do_not_meet(spark):
    """5,000 rows share a passage's column, each with too many columns of its own: none meets another."""
    from pyspark.sql import functions as F

    from haulframe.llm.ngram_join import across

    prefix = spark.range(5000).select(F.col("id").alias("row"), F.lit(100).alias("n"), F.lit(7).cast("bigint").alias("column"), F.lit(92).alias("left"), F.lit(0.08).alias("odd"), F.lit(92).alias("weight"))
    assert across(prefix, spark.createDataFrame([], "row bigint, component bigint"), 90).count() == 0


def test_two_exchanges_give_the_same(spark):
    from pyspark.sql import functions as F

    from haulframe.llm.ngram_join import _SIGNED, _sign, candidate_rows

    df = spark.createDataFrame(near_copies(5, 200), "doc_id bigint, text string").repartition(3)
    signed = df.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_sign(3), _SIGNED)
    rows = [sorted((r["row"], r["n"], r["lone"], r["prefix"], tuple(r["columns"])) for r in candidate_rows(df, signed, "text", 3, 90, 64, fan_out).collect()) for fan_out in (64, 8)]
    assert rows[0] == rows[1] and len(rows[0]) > 20


def test_partners_of_a_row_are_dealt_over_blocks(spark, monkeypatch):
    from haulframe.llm import ngram_join

    docs = near_copies(6, 150)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 50)
    assert {r["doc_id"]: r["component_id"] for r in cluster(df).collect()} == dict(zip([d for d, _ in docs], plain.components(docs, 3, 90)))


def test_odd_rows(odd):
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["n_shingles"]) for r in cluster(odd).collect())
    assert got == sorted((str(d), str(c), len(plain.shingles(t, 3))) for (d, t), c in zip(TEXTS, plain.components(TEXTS, 3, 90)))


def test_keep_one(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((str(r["doc_id"]), (r["text"] or "null")[:20]) for r in kept.collect())
    # 4 is a copy of 3, 6 nearly one of 5; of the texts with id 9 one each stays, and the copy without an id goes
    want = [(d, t) for n, (d, t) in enumerate(TEXTS) if n not in (4, 6, 10, 12)]
    assert got == sorted((str(d), (t or "null")[:20]) for d, t in want)


def test_no_rows(none):
    assert cluster(none).count() == 0 and keep_one(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_group_of_near_copies_stays_linear(spark):
    from haulframe.llm.ngram_join import candidate_rows, links
    from haulframe.llm.ngram_join import _SIGNED, _sign
    from pyspark.sql import functions as F

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    signed = df.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_sign(3), _SIGNED)
    rows = candidate_rows(df, signed, "text", 3, 90)
    n = len({t for _, t in docs})
    assert rows.count() == n and n - 1 <= links(rows).count() <= 2 * n
    assert {r["component_id"] for r in cluster(df).collect()} == {0}
