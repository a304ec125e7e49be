import numpy as np
import pyarrow as pa
import pytest
from plain import TEXTS

from haulframe.llm import folds, langid

EN = "the cat and the dog went to the house with a friend for this and that on the way of the world"
DE = "der hund und die katze gingen mit einem freund in das haus für dieses und jenes auf dem weg der welt"


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], rng, 4)
    for w in ("table", "recurrent", "output", "bias"):
        setattr(net, w, getattr(net, w).astype(np.float64))
    rows, labels = rng.integers(97, 100, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss, gradients = net.gradients(rows, labels)
    assert abs(loss + np.log(net.positions(rows)[:, np.arange(5), labels]).mean()) < 1e-6
    for w, g in zip(net.weights(), gradients):
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 60)]:
            w[at] += 1e-4
            up = net.gradients(rows, labels)[0]
            w[at] -= 2e-4
            down = net.gradients(rows, labels)[0]
            w[at] += 1e-4
            assert abs((up - down) / 2e-4 - g[at]) < 1e-4


@pytest.fixture(scope="module")
def network():
    return langid.fit([EN] * 5 + [DE] * 5, ["en"] * 5 + ["de"] * 5, steps=150)


def plain_positions(network, read):
    """The recurrence one byte and one unit at a time, from both ends; probabilities at every byte."""
    h = network.recurrent.shape[1]
    states = []
    for d in (0, 1):
        state, out = np.zeros(h), []
        for c in read if d == 0 else read[::-1]:
            g = state @ network.recurrent[d]
            x = network.table[d][c]
            z, r = (0.5 + 0.5 * a / (1 + abs(a)) for a in (x[k : k + h] + g[k : k + h] for k in (0, h)))
            a = x[2 * h :] + r * g[2 * h :]
            n = a / (1 + abs(a))
            state = (1 - z) * n + z * state
            out.append(state)
        states.append(out if d == 0 else out[::-1])
    logits = np.array([np.concatenate((f, b)) @ network.output + network.bias for f, b in zip(*states)])
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("text", ["hund, the 123 KATZE!", "a", (EN + " " + DE + "\n") * 3, "x" * 700])
def test_pooling_is_the_mean_over_letter_positions(network, text):
    mean, letters = langid.pooled(network, pa.array([text]))
    raw = text.lower().encode()
    total = np.zeros(2)
    for at in range(0, len(raw), langid.CORE):
        own = raw[at : at + langid.CORE]
        width = -(-len(own) // langid.STEP) * langid.STEP
        read = [raw[i] if 0 <= i < len(raw) else 32 for i in range(at - langid.CONTEXT, at + width + langid.CONTEXT)]
        p = plain_positions(network, read)[langid.CONTEXT :][: len(own)]
        total += p[[97 <= c <= 122 or c >= 128 for c in own]].sum(0)
    n = sum(97 <= c <= 122 or c >= 128 for c in raw)
    assert letters[0] == n and np.allclose(mean[0], total / n, atol=1e-4)
    # a text's result doesn't depend on its neighbours
    many, _ = langid.pooled(network, pa.array([EN, text, DE * 50, None, text, "z" * 500]))
    assert np.allclose(many[1], mean[0], atol=1e-5) and np.allclose(many[4], mean[0], atol=1e-5)


def test_neighbouring_words_count(network):
    """A word of both languages is read by what stands around it."""
    found, _ = langid.pooled(network, pa.array(["in", "der hund in das haus", "the cat in a house"]))
    assert found[1].argmax() != found[2].argmax()
    states = [network.positions(np.frombuffer(t.encode().ljust(48), np.uint8)[None, :])[20:22, 0] for t in ("der hund und die    in", "the cat and the dog in")]
    assert np.abs(states[0] - states[1]).max() > 1e-3


def test_odd_rows(spark, odd, none, network):
    found = langid.predict(odd, network)
    assert found.columns == [*odd.columns, "lang_pred_", "score__"]
    got = {(r["doc_id"], r["text"]): (r["lang_pred_"], r["score__"]) for r in found.collect()}
    for d, t in TEXTS:
        name, score = got[d, t]
        assert (name == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= score <= 1 and (name != "und" or score == 0)
    assert langid.predict(none, network).count() == 0
    assert {r["lang_pred_"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.train(none) is None


def test_nothing_is_learned_from_the_held_out_fold(spark):
    import zlib

    docs = spark.createDataFrame([(i, EN, "en") for i in range(40)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", folds.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}
    only = docs.where(folds.held_out())
    assert only.count() and langid.train(only) is None


def test_sample_is_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS i", "id % 3 AS l")
    got = folds.bounded_sample(rows, "l", "i", 50)
    assert len(got) == 150 and got == folds.bounded_sample(rows.repartition(7), "l", "i", 50)
    assert len(folds.bounded_sample(rows.where("i < 9"), "l", "i", 50)) == 9
    assert folds.bounded_sample(rows.limit(0), "l", "i", 50) == []
    hot = rows.where("i < 9").union(spark.range(5000).selectExpr("1 AS i", "1 AS l"))
    assert len(folds.bounded_sample(hot, "l", "i", 50)) == 9
    with pytest.raises(ValueError):
        folds.bounded_sample(rows, "l", "i", 50, most_labels=2)


def test_held_out_accuracy(spark, sf001):
    got = langid.op4_langid(spark, sf001).join(spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_short_texts(spark, sf001):
    """Held-out texts cut to 40 characters: the network still knows nearly all."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    network = langid.train(docs)
    short = docs.where(folds.held_out()).selectExpr("doc_id", "lang", "substring(text, 1, 40) AS text").where("lang IS NOT NULL AND length(trim(text)) > 20")
    got = langid.predict(short, network).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.85 * len(got)
