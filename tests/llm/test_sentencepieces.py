import os
import random

import numpy as np
import pyarrow as pa
import pytest
from plain import TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from haulframe.llm import sentencepieces as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="the model file isn't here")
CASES = ["", " ", "  a  b ", "日本語𠮷\u0000 <0x0A> <s>", "x" * 300 + " " + "ab" * 90, None, "▁a ▁", "\r\n;\r", "é" * 60, "aaaa    bbbb\t\t" * 20, "The quick brown fox.\nJumps over 12345 dogs!"]


@pytest.fixture(scope="module")
def exact():
    return sp.Encoder(sp.Model.load(dropout=0.0))


@pytest.fixture(scope="module")
def varied():
    return sp.Encoder(sp.Model.load())


def test_without_dropout_it_is_the_library(exact):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = [t for t in CASES if t is not None and "▁" not in t]
    assert exact.encode(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_round_trip(exact, varied):
    column = pa.array(CASES, pa.string())
    for encoder in (exact, varied):
        assert encoder.decode(encoder.encode(column)).to_pylist() == CASES


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text_round_trips(varied, texts):
    column = pa.array(texts, pa.string())
    assert varied.decode(varied.encode(column)).to_pylist() == texts


def test_seeds_and_occurrences_vary(varied):
    text = pa.array([" ".join(["international understanding"] * 50)])
    ids = varied.encode(text)
    assert ids == varied.encode(text)
    other = sp.Encoder(sp.Model.load(seed=1)).encode(text)
    assert ids != other
    plain = sp.Encoder(sp.Model.load(dropout=0.0)).encode(text)
    assert len(ids.values) > len(plain.values)
    full = sp.Encoder(sp.Model.load(dropout=1.0)).encode(pa.array(["hello"]))
    assert len(full.values) == len("▁hello")  # every merge is skipped


def test_a_text_is_coded_alike_wherever_it_stands(varied):
    texts = [f"some words {i} and others" for i in range(40)]
    whole = varied.encode(pa.array(texts)).to_pylist()
    assert [varied.encode(pa.array([t])).to_pylist()[0] for t in texts] == whole


def test_agenda_and_matrix_agree(varied, exact):
    """Units merged together step by step give what one unit's agenda gives."""
    rng = random.Random(5)
    for encoder in (exact, varied):
        chars = encoder.model.chars()
        units = ["".join(rng.choice("theanionsr ") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
        keys = np.arange(len(units), dtype=np.uint64) * np.uint64(977)
        sizes = np.array([len(u) for u in units])
        symbols = np.full((len(units), sizes.max()), -1, np.int32)
        for i, u in enumerate(units):
            symbols[i, : len(u)] = chars[[ord(c) for c in u]]
        merged, counts = encoder._merge_together(keys, symbols.copy(), sizes.astype(np.int32))
        for i in range(len(units)):
            assert encoder._merge_alone(keys[i], symbols[i, : sizes[i]]).tolist() == merged[i, : counts[i]].tolist()


def test_frames(spark, odd, none):
    model = sp.Model.load()
    coded = sp.encode(odd, model)
    assert coded.columns == [*odd.columns, "piece_ids_"]
    back = sp.decode(coded, model, "piece_ids_").select("text", "decoded").collect()
    assert len(back) == len(TEXTS) and all(r["text"] == r["decoded"] for r in back)
    done = sp.round_trip(odd, model)
    assert sorted(str(r["lossless_"]) for r in done.collect()) == sorted("None" if t is None else "True" for _, t in TEXTS)
    assert sp.round_trip(none, model).count() == 0


def test_the_whole_registered_query(spark, sf001):
    got = sp.op2_sentencepieces(spark, sf001)
    assert got.where("NOT lossless").count() == 0 and got.count() == spark.read.parquet(f"{sf001}/documents.parquet").count()


def test_every_occurrence_draws_its_own_merges(varied):
    """A word of ten letters has many segmentations, in one text and over several."""
    one = varied.encode(pa.array([" ".join(["government"] * 3000)])).to_pylist()[0]
    several = varied.encode(pa.array([f"government {i}" for i in range(3000)]))
    assert len({tuple(x[: len(x) - 1]) for x in several.to_pylist()}) > 20
    words, word = set(), []
    first = varied.model.pieces
    for i in one:
        if first[i].startswith(b" ") and word:
            words.add(tuple(word))
            word = []
        word.append(i)
    assert len(words) > 20


def _plain_course(encoder, key, symbols):
    """The agenda one merge at a time: the cheapest pair whose draw doesn't skip it, the leftmost of equals."""
    import numpy as np

    at = list(range(len(symbols) + 1))
    while True:
        best = None
        for i in range(len(symbols) - 1):
            merged, cost = encoder.model.look_up(np.array([symbols[i]]), np.array([symbols[i + 1]]))
            if np.isfinite(cost[0]) and not encoder._skipped(np.array([key]), *(np.array([at[i + j]]) for j in range(3)))[0]:
                if best is None or cost[0] < best[0]:
                    best = cost[0], i, int(merged[0])
        if best is None:
            return symbols
        symbols = [*symbols[: best[1]], best[2], *symbols[best[1] + 2 :]]
        at = [*at[: best[1] + 1], *at[best[1] + 2 :]]


def test_agenda_with_dropout_equals_a_plain_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from haulframe.llm import sentencepieces as sp

    encoder = sp.Encoder(sp.Model.load(dropout=0.3))
    seen = []
    whole = encoder._segment

    def watched(units, points, starts, sizes, back, keys):
        ids, per = whole(units, points, starts, sizes, back, keys)
        seen.append((points, starts, sizes, back, keys, ids, per))
        return ids, per

    monkeypatch.setattr(encoder, "_segment", watched)
    texts = ["internationalization of the internationalization " * 20, "the quick brown fox, the lazy dog " * 9, "Übergrößenträger " * 3 + "x" * 70, "\U0002000b odd ▁ ones"]
    encoder.encode(pa.array(texts))
    points, starts, sizes, back, keys, ids, per = seen[0]
    ends = np.cumsum(per)
    assert len(back) > 100
    for k, u in enumerate(back):
        symbols = _plain_course(encoder, keys[k], encoder.model.chars()[points[starts[u] : starts[u] + sizes[u]]].tolist())
        plain, _ = encoder.model.as_ids(np.array(symbols, np.int32), np.array([len(symbols)]))
        assert plain.tolist() == ids[ends[k] - per[k] : ends[k]].tolist()
