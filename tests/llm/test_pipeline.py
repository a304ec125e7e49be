"""Each stage by its plain version on its own input, and the whole on odd rows."""

import importlib
from collections import Counter

import plain
import pytest
from plain import TEXTS

from haulframe.llm import langid

pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Input and result of every stage on the smallest tables, written and read again as the driver does."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        out[name] = (docs.collect(), spark.read.parquet(f"{folder}/{name}"))
        docs = out[name][1]
    return out


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_order_and_columns(steps):
    assert list(steps) == ["language", "near_duplicates", "substrings", "decontaminate", "pieces"]
    for name, (_, result) in steps.items():
        assert result.columns[:5] == COLUMNS and (name == "pieces" or result.columns == COLUMNS)


def test_language(spark, steps, sf_dir):
    before, after = steps["language"]
    network = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    import pyarrow as pa

    mean, _ = langid.pooled(network, pa.array([r["text"] for r in before]))
    want = [r["doc_id"] for r, p in zip(before, mean) if any(c.isalpha() for c in r["text"] or "") and p.max() >= pipeline.LEAST_SCORE]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want) and len(want) >= 0.98 * len(before)


def test_near_duplicates(steps):
    before, after = steps["near_duplicates"]
    rows = pairs(before)
    want = [d for (d, _), c in zip(rows, plain.components(rows, 5, 80)) if d == c]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want) and len(want) < len(rows)


def test_substrings(steps):
    before, after = steps["substrings"]
    want = {}
    for (d, t), kept in zip(pairs(before), plain.kept_words(pairs(before), 13)):
        if kept or not plain.words(t):
            want[d] = t if len(kept) == len(plain.words(t)) else " ".join(kept)
    got = {r["doc_id"]: r for r in after.collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    changed = [r for d, r in got.items() if dict(pairs(before))[d] != r["text"]]
    assert all(r["n_chars"] == len(r["text"]) for r in changed)


def test_decontaminate(spark, steps, sf_dir):
    before, after = steps["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        w = plain.alnum_words(t)
        for j in range(len(w) - 12):
            grams.setdefault(tuple(w[j : j + 13]), i)
    exact = set()
    for d, t in pairs(before):
        w = plain.alnum_words(t)
        if any(tuple(w[j : j + 13]) in grams for j in range(len(w) - 12)):
            exact.add(d)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after.collect()}
    assert exact and exact <= gone
    near = plain.overlaps([p for p in pairs(before) if p[0] in gone], items, 13, 2)
    assert {d for d, _ in near} == gone


def test_pieces(steps):
    before, after = steps["pieces"]
    rows = after.collect()
    assert len(rows) == len(before) and all(r["lossless"] and len(r["piece_ids"]) for r in rows)


def test_run_is_all_stages(spark, steps, sf_dir):
    got = pipeline.run(spark, sf_dir).select("doc_id", "piece_ids").collect()
    assert Counter(map(str, got)) == Counter(map(str, steps["pieces"][1].select("doc_id", "piece_ids").collect()))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows(spark, odd, none, sf_dir, name):
    stage = dict(pipeline.STAGES)[name]
    done = stage(spark, odd, sf_dir)
    assert done.columns[: len(odd.columns)] == odd.columns and (name == "pieces" or len(done.columns) == len(odd.columns))
    assert 0 < done.count() <= len(TEXTS)
    assert stage(spark, none, sf_dir).count() == 0
