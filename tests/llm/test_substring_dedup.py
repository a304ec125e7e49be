import hashlib
import random

import plain
import pytest
from plain import TEXTS

from haulframe.llm.substring_dedup import remove_repeated


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    docs = [(rng.choice([None, *range(60)]), " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for _ in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted((str(r["doc_id"]), r["text"], r["kept_text"], r["n_words"], r["n_removed"]) for r in remove_repeated(df, width=4).collect())
    want = sorted((str(d), t, " ".join(k), len(plain.words(t)), len(plain.words(t)) - len(k)) for (d, t), k in zip(docs, plain.kept_words(docs, 4)))
    assert got == want


def test_odd_rows(odd):
    done = remove_repeated(odd)
    assert done.columns == [*odd.columns, "kept_text_", "n_words_", "n_removed_"]
    got = sorted((str(r["doc_id"]), hashlib.md5(r["kept_text_"].encode()).hexdigest(), r["source"][:6], r["n_words_"]) for r in done.collect())
    assert got == sorted((str(d), hashlib.md5(" ".join(k).encode()).hexdigest(), "source", len(plain.words(t))) for (d, t), k in zip(TEXTS, plain.kept_words(TEXTS, 13)))


def test_no_rows(none):
    assert remove_repeated(none).count() == 0


def test_a_hot_passage_over_many_partitions(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.range(2000).selectExpr("id AS doc_id", f"concat('own', id, ' {passage} tail', id) AS text").repartition(40)
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeated(df).collect()}
    assert got.pop(0) == 0 and set(got.values()) == {60}


@pytest.mark.parametrize("fan_out", [64, 8])
def test_two_exchanges_give_the_same(spark, fan_out):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(60)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["kept_text"] for r in remove_repeated(df, width=4, buckets=64, fan_out=fan_out).collect()}
    assert got == {d: " ".join(k) for (d, _), k in zip(docs, plain.kept_words(docs, 4))}


def test_packing_takes_no_longer_with_more_buckets():
    import time

    import numpy as np

    from haulframe.llm import incidence

    hashes = np.random.default_rng(0).integers(0, 2**63, 1 << 18).astype(np.uint64) * np.uint64(2)
    owners, took = np.arange(len(hashes)), {}
    for buckets in (16, 1 << 20):
        first = incidence.coarse(buckets)
        assert first <= incidence.FAN_OUT and buckets // first <= incidence.FAN_OUT
        began = time.perf_counter()
        batch = incidence.pack(incidence.top(hashes, first), hashes, owners)
        took[buckets] = time.perf_counter() - began
        assert batch.num_rows <= first and sorted(incidence.joined(batch["hashes"], np.uint64)) == sorted(hashes)
    assert took[1 << 20] < 5 * took[16] + 0.1


def test_owners_have_the_same_bucket_in_both_places(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from haulframe.llm import incidence

    ids = [0, 1, -1, 7, 2**62, -(2**62)]
    df = spark.createDataFrame([(i,) for i in ids], "o bigint")
    for buckets in (16, 1 << 22):
        assert [r[0] for r in df.select(incidence.owner_bucket_column(F.col("o"), buckets)).collect()] == incidence.owner_bucket(np.array(ids), buckets).tolist()
