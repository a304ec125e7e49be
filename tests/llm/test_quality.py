"""The quality classifier and the quality rules."""

import plain
import pytest
import numpy as np
from plain import TEXTS
from pyspark.sql import functions as F

from haulframe.llm import quality_classifier as qc
from haulframe.llm import quality_rules as qr
from haulframe.llm.text_statistics import NAMES, with_statistics


def test_rules_become_the_same_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(int)
    model = qc.fit(x, y, np.ones(300))
    want = 1 / (1 + np.exp(-(model.bias + sum(w * qc._holds(r, x) for r, w in zip(model.rules, model.weights)))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in NAMES))
    got = [r[0] for r in df.select(qc.expression(model, {n: n for n in NAMES})).collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.95 and len(model.rules) < 150
    assert qc.fit(x[:0], y[:0], np.ones(0)) is None
    assert 0 < 1 / (1 + np.exp(-qc.fit(x[:5], np.ones(5), np.ones(5)).bias)) < 1


def test_statistics(spark):
    df = spark.createDataFrame([(1, "Ab ab ab\nAb 12!"), (2, None)], "i int, text string")
    got = {r["i"]: r.asDict() for r in with_statistics(df, "text", {n: n for n in NAMES}).collect()}
    assert np.isclose(got[1]["distinct_words"], 3 / 5) and np.isclose(got[1]["same_as_before"], 1 / 5) and np.isclose(got[1]["upper"], 2 / 15)
    assert np.isclose(got[1]["commonest_word"], 2 / 5) and np.isclose(got[1]["words_a_line"], 2.5) and got[1]["exclaim"] == 1 / 15
    assert all(v == 0 for k, v in got[2].items() if k != "i")


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (9, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    model = qc.train(odd, labels)
    got = qc.score(odd, model)
    assert got.columns == [*(c for c in odd.columns if c != "text"), "score__", "predicted_"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score__"] <= 1 and r["predicted_"] == (r["score__"] >= 0.7) for r in rows)
    assert qc.score(none, model).count() == 0 and qc.train(odd, labels.limit(0)) is None
    assert {r["score__"] for r in qc.score(odd, None).collect()} == {0.5}


def test_classifier_held_out(spark, sf001):
    got = qc.op1_quality_classifier(spark, sf001).join(spark.read.parquet(f"{sf001}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    area = np.mean([(np.array(good) > b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad])
    assert bad and area > 0.9 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


def counts(text):
    w = plain.words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeats = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if plain.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeats)


def test_rules_on_odd_rows(spark, odd, none):
    some = spark.createDataFrame([(20, "a b c d e f a b c d e f " * 9), (21, "x\nx\n\n \ny\nx"), (22, "a b c d e a b c d e"), (23, "# <b> | a*b")], "doc_id bigint, text string")
    for df, rows in ((odd, TEXTS), (some, [tuple(r) for r in some.collect()])):
        got = qr.judge(df).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted((str(d), *counts(t)) for d, t in rows)
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert qr.judge(none).count() == 0


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(qr._distance([F.lit(x) for x in p], q), qr._distance([F.lit(x) for x in q], q)).head()
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = sum(a * np.log2(a / c) if a else 0 for a, c in zip(p, m)) / 2 + sum(b * np.log2(b / c) for b, c in zip(q, m)) / 2
    assert np.isclose(got[0], np.sqrt(want)) and got[1] == 0


@pytest.mark.parametrize("text, kept", [("the cat sat on the mat and it was a very fine day in the garden of the old house by the river", True), ("||| ### *** ||| ### *** ||| ### *** $$$ %%% &&& ||| ### *** ||| ### *** ||| ### *** $$$ %%% &&& ||| #1# *2* ||| ### *3*", False), ("few words", False)])
def test_verdicts(spark, text, kept):
    assert qr.judge(spark.createDataFrame([(text,)], "text string")).head()["kept"] is kept


def test_no_python_in_the_plan(spark, sf_dir):
    from haulframe.llm import license_scan

    for query in (qr.op6_quality_rules, license_scan.op3_license_scan):
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rules_agree_with_labels(spark, sf001):
    got = qr.op6_quality_rules(spark, sf001).join(spark.read.parquet(f"{sf001}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1 and not r["base_failed"]], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.98 * len(good) and sum(r["kept"] for r in bad) < 0.15 * len(bad)


def test_columns_named_like_helpers_stay(spark):
    from haulframe.llm import quality_rules

    row = quality_rules.judge(spark.createDataFrame([("a b c", "x", "y")], "text string, measured string, __measured string")).head()
    assert (row["measured"], row["__measured"], row["n_words"], row["kept"]) == ("x", "y", 3, False)
