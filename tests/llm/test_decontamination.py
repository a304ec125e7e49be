import itertools
import random

import plain
import pytest
from plain import TEXTS

from haulframe.llm.decontamination import MASKS, SUBSTITUTIONS, WINDOW, drop_contaminated, overlaps


def test_masks_hit_every_window_with_two_substitutions():
    for changed in itertools.combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(all(at + p not in changed for p in mask) for mask in MASKS for at in range(WINDOW - mask[-1]))


def cases(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"b{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate([14, 20, 40, 13, 9, 7, 25])]
    docs = []
    for d in range(80):
        w = [f"b{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.7:
            v = rng.choice(items)[1].split()
            a = rng.randrange(len(v))
            v = v[a : a + rng.randrange(8, 40)]
            for _ in range(rng.randrange(5)):
                v[rng.randrange(len(v))] = "other"
            at = rng.randrange(len(w))
            w[at:at] = v
        docs.append((d, ", ".join(w).upper()))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_version(spark, seed):
    docs, items = cases(seed)
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(d, i) for d, i in plain.overlaps(docs, items, WINDOW, SUBSTITUTIONS) if len(plain.alnum_words(items[i][1])) >= WINDOW}
    short = {i for i, t in items if len(plain.alnum_words(t)) < WINDOW}
    rows = overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["item_id"] not in short} == want
    assert all(r["n_equal"] <= r["n_words"] for r in rows)
    assert {r["doc_id"] for r in drop_contaminated(df, bench).collect()} == {d for d, _ in docs} - {r["doc_id"] for r in rows}


def test_the_whole_registered_query(spark, sf001):
    from haulframe.llm.decontamination import op5_decontamination

    docs, bench = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontamination(spark, sf001).collect()}
    items = {r["item_id"]: " ".join(plain.alnum_words(r["text"])) for r in bench.collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if f" {t} " in f" {' '.join(plain.alnum_words(r['text']))} "}
    assert exact and exact <= got


def test_spans(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Start here: {item.upper()}! then more"), (2, " ".join(f"q{i}" if i != 9 else "z" for i in range(20)))], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in overlaps(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect())
    assert got == [(1, 7, 2, 20, 20), (2, 7, 0, 20, 19)]


def test_odd_rows(spark, odd, none):
    fox = TEXTS[9][1]
    bench = spark.createDataFrame([(1, fox), (1, fox), (2, None), (3, ""), (None, "seven words are too few to tell")], "item_id bigint, text string")
    rows = overlaps(odd, bench).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["9", "9", "None"] * 2)
    left = drop_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == len(TEXTS) - 3
    assert overlaps(none, bench).count() == 0 and drop_contaminated(none, bench).count() == 0
    assert overlaps(odd, bench.limit(0)).count() == 0 and drop_contaminated(odd, bench.limit(0)).count() == len(TEXTS)


def test_short_items(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, WINDOW)]
    docs, exact = [], set()
    for n, t in items:
        for changed in [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            words = ["z" if k in changed else w for k, w in enumerate(t.split())]
            for before, after in (("", ""), ("two before ", " and three after")):
                if n < 8 and not changed:
                    exact.add((len(docs), n))
                docs.append((len(docs), before + " ".join(words).upper() + after))
    want = plain.overlaps(docs, items, WINDOW, SUBSTITUTIONS) | exact
    assert {i for _, i in want} == set(range(1, WINDOW))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = overlaps(df, bench).collect()
    assert len(rows) == len(want) and {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert all(r["n_words"] == r["item_id"] for r in rows)
    assert {r["doc_id"] for r in drop_contaminated(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("seed", range(3))
def test_short_items_equal_plain_version(spark, seed):
    docs, items = cases(seed)
    rng = random.Random(seed)
    items += [(len(items) + i, " ".join(f"b{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate([8, 10, 11, 12, 3, 2, 1])]
    for i, t in items:
        docs.append((len(docs), f"before {t} after"))
    spaced = {d: f" {' '.join(plain.alnum_words(t))} " for d, t in docs}
    want = plain.overlaps(docs, items, WINDOW, SUBSTITUTIONS) | {(d, i) for d, w in spaced.items() for i, t in items if len(t.split()) < 8 and f" {t} " in w}
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in overlaps(df, bench).collect()} == want


def test_a_full_filter_and_small_groups_change_nothing(spark, monkeypatch):
    """With a filter that lets nearly everything through, and few texts and words at a time, the overlaps are the same."""
    from haulframe.llm import decontamination

    docs, items = cases(5)
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, overlaps(df, bench).collect()))
    for name, value in (("FILTER_BITS", 8), ("GROUP_TEXTS", 2), ("COMPARED", 50)):
        monkeypatch.setattr(decontamination, name, value)
    monkeypatch.setattr(decontamination, "MOST_NAMED", 0)
    assert sorted(map(tuple, overlaps(df, bench).collect())) == want and want


@pytest.mark.parametrize("there, here", [([3, 9, 4], [1]), (range(50), range(0, 40, 2)), ([7], [0, 5, 6]), (range(0, 90, 3), range(5, 60))])
def test_shifts(there, here):
    import numpy as np

    from haulframe.llm.decontamination import shifts

    assert shifts(np.array(there), np.array(here)).tolist() == sorted({a - b for a in there for b in here})


def test_long_texts_of_one_word(spark):
    import time

    text = "again " * 20_000
    df, bench = spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(2, text)], "item_id bigint, text string")
    began = time.perf_counter()
    rows = overlaps(df, bench).collect()
    assert len(rows) == 2 * (20_000 - WINDOW) + 1 and max(r["n_equal"] for r in rows) == 20_000
    assert time.perf_counter() - began < 90
