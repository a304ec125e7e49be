"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions and labels every position with a distribution
over the languages; a document's probabilities are the mean over its letter positions. Texts of any
length are read whole, in windows of at most ``CORE`` bytes: each direction begins ``CONTEXT`` bytes
before the window (with blanks beyond the text's ends), so its state comes over word and window bounds.
All windows of a length are read at the same time. Training is backpropagation through time in numpy on
a bounded sample: at most ``DOCS_PER_LANGUAGE`` labelled documents of each language outside the held-out
fold, with ``PIECES_PER_DOCUMENT`` pieces of ``PIECE`` bytes each, drawn by a hash of their place.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is every text if
nothing could be learned. Rows without a language, and rows of the held-out fold, are not learned from;
of documents with the same id and language one is. Repeated texts get equal results. An input without rows
gives none. Columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm import tokens
from haulframe.llm.folds import bounded_sample, held_out
from haulframe.llm.storage import free_name

DOCS_PER_LANGUAGE = 300
PIECES_PER_DOCUMENT = 12
PIECE = 64
#: Bytes of a window, and before it in reading order; windows are as long as their text needs, in steps of STEP.
CORE, CONTEXT, STEP = 224, 16, 16
HIDDEN = 16
STEPS = 400
BATCH = 128
UNKNOWN = "und"
#: Windows that are read at the same time.
TOGETHER = 1024

_BLANK = 0x20
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def _squashed(x: np.ndarray) -> np.ndarray:
    """Softsign, from -1 to 1: what tanh does in other such networks, without its cost."""
    return x / (1 + np.abs(x))


def _probabilities(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


@dataclass
class Network:
    """Weights: per direction an input table (byte to gates), recurrent weights; and the output layer."""

    languages: list[str]
    table: np.ndarray  # 2, 256, 3 H: update gate, reset gate, candidate
    recurrent: np.ndarray  # 2, H, 3 H
    output: np.ndarray  # 2 H, L
    bias: np.ndarray  # L

    @staticmethod
    def new(languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
        f = np.float32
        return Network(languages, rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f), rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(f), rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(f), np.zeros(len(languages), f))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.output, self.bias]

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position of rows of bytes, all of one length: (T, B, L)."""
        b, t = rows.shape
        h, kind = self.recurrent.shape[1], self.table.dtype
        # by gate and direction, so that all arrays below lie together; the reset gate is doubled, its matrix halved
        table = np.ascontiguousarray(self.table.reshape(2, 256, 3, h).transpose(2, 0, 1, 3))
        recurrent = np.ascontiguousarray(self.recurrent.reshape(2, h, 3, h).transpose(2, 0, 1, 3))
        recurrent[2] *= 0.5
        columns = np.ascontiguousarray(rows.T).astype(np.intp)
        states = np.empty((2, t, b, h), kind)
        state = np.zeros((2, b, h), kind)
        x, g = np.empty((3, 2, b, h), kind), np.empty((3, 2, b, h), kind)
        gates, n, work, candidate = x[:2], x[2], g[:2], g[2]
        for s in range(t):
            for k in range(3):
                np.take(table[k, 0], columns[s], axis=0, out=x[k, 0], mode="clip")
                np.take(table[k, 1], columns[t - 1 - s], axis=0, out=x[k, 1], mode="clip")
            np.matmul(state, recurrent, out=g)
            gates += work
            np.abs(gates, out=work)
            work += 1
            gates /= work
            gates += 1
            candidate *= gates[1]
            n += candidate
            np.abs(n, out=candidate)
            candidate += 1
            n /= candidate
            state -= n
            gates[0] *= 0.5
            state *= gates[0]
            state += n
            states[0, s], states[1, t - 1 - s] = state[0], state[1]
        logits = states[0] @ self.output[:h]
        logits += states[1] @ self.output[h:]
        logits += self.bias
        return _probabilities(logits)

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions of rows of bytes, and its gradients by backpropagation through time."""
        b, t = rows.shape
        h = self.recurrent.shape[1]
        order = np.stack((rows.T, rows.T[::-1]))  # as each direction reads
        state = np.zeros((2, b, h), self.table.dtype)
        states, kept = np.zeros((2, t, b, h), self.table.dtype), []
        for s in range(t):
            x = np.stack((self.table[0][order[0, s]], self.table[1][order[1, s]]))
            g = state @ self.recurrent
            zr = 0.5 * _squashed(x[..., : 2 * h] + g[..., : 2 * h]) + 0.5
            z, r = zr[..., :h], zr[..., h:]
            n = _squashed(x[..., 2 * h :] + r * g[..., 2 * h :])
            kept.append((state, z, r, n, g[..., 2 * h :]))
            state = n + z * (state - n)
            states[:, s] = state
        both = np.concatenate((states[0], states[1][::-1]), 2)
        p = _probabilities(both @ self.output + self.bias)
        loss = float(-np.log(p[:, np.arange(b), labels] + 1e-9).mean())
        p[:, np.arange(b), labels] -= 1
        p /= b * t
        to_output = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2])
        back = p @ self.output.T
        given = np.stack((back[..., :h], back[::-1, :, h:]))
        to_recurrent = np.zeros_like(self.recurrent)
        flow = np.zeros((2, b, h), self.table.dtype)
        gates = np.empty((2, t, b, 3 * h), self.table.dtype)
        for s in range(t - 1, -1, -1):
            state, z, r, n, g = kept[s]
            flow = flow + given[:, s]
            dn = flow * (1 - z) * (1 - np.abs(n)) ** 2
            dz = flow * (state - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dn * g * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            gates[:, s] = np.concatenate((dz, dr, dn), 2)
            recurrent = np.concatenate((dz, dr, dn * r), 2)
            to_recurrent += np.swapaxes(state, 1, 2) @ recurrent
            flow = flow * z + recurrent @ np.swapaxes(self.recurrent, 1, 2)
        to_table = np.zeros_like(self.table)
        for d in (0, 1):
            read = order[d].ravel()
            ranked = np.argsort(read, kind="stable")
            begins = np.flatnonzero(np.concatenate(([True], read[ranked][1:] != read[ranked][:-1])))
            to_table[d][read[ranked][begins]] = np.add.reduceat(gates[d].reshape(-1, 3 * h)[ranked], begins, axis=0)
        return loss, [to_table, to_recurrent, to_output, p.sum((0, 1))]


def some_pieces(column: pa.Array, most: int) -> list[list[bytes]]:
    """At most so many pieces with a letter of each text, drawn by a hash of their place; the last one may be short."""
    out = []
    for part in tokens.slices(column, lower=True):
        letters = np.concatenate(([0], np.cumsum(_LETTER[part.data] > 0)))
        for a, b in zip(part.bounds[:-1], part.bounds[1:]):
            starts = np.arange(a, b, PIECE)
            ends = np.minimum(starts + PIECE, b)
            places = np.flatnonzero(letters[ends] > letters[starts])
            drawn = np.sort(places[np.argsort(tokens.mix(places.astype(np.uint64)), kind="stable")[:most]])
            out.append([part.data[starts[i] : ends[i]].tobytes() for i in drawn])
    return out


def fit(texts: list[str], langs: list[str], **options) -> Network | None:
    """A network learned from whole texts."""
    return fit_pieces(some_pieces(pa.array(texts, pa.string()), 1 << 40), langs, **options)


def fit_pieces(pieces: list[list[bytes]], langs: list[str], seed: int = 11, steps: int = STEPS) -> Network | None:
    """A network trained with Adam, as many pieces of each language in every step; None without any."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    found = [(p, names.index(lang)) for ps, lang in zip(pieces, langs) for p in ps]
    if not found:
        return None
    rows = np.frombuffer(b"".join(p.center(PIECE, b" ") for p, _ in found), np.uint8).reshape(-1, PIECE)
    labels = np.array([k for _, k in found])
    by_label = [x for x in (np.flatnonzero(labels == k) for k in range(len(names))) if len(x)]
    network = Network.new(names, rng)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    for step in range(1, steps + 1):
        some = np.concatenate([rng.choice(x, max(1, BATCH // len(by_label))) for x in by_label])
        # half of the steps see the beginnings of pieces only, as texts may be short
        width = PIECE if step % 2 else PIECE // 4 + int(rng.integers(PIECE // 2))
        _, gradients = network.gradients(rows[some][:, (PIECE - width) // 2 :][:, :width], labels[some])
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(network.weights(), gradients, moments):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            w -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-7))
    return network


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE) -> Network | None:
    """A network learned from a bounded sample of the labelled documents outside the held-out fold."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    plain = known.select(F.col(doc_id).cast("bigint").alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))

    def shorten(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tokens.frugal(batches):
                pieces = pa.array(some_pieces(batch.column(3), PIECES_PER_DOCUMENT), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pieces], names=["i", "l", "__place", "pieces"])

        return rows.select("i", "l", "__place", "t").mapInArrow(run, "i bigint, l string, __place bigint, pieces array<binary>")

    rows = bounded_sample(plain, "l", "i", per_language, shorten=shorten)
    return fit_pieces([[bytes(u) for u in r["pieces"]] for r in rows], [r["l"] for r in rows])


def pooled(network: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of each text over its letter positions, and how many it has."""
    sums, counts = [np.zeros((0, len(network.languages)))], [np.zeros(0)]
    for part in tokens.slices(column, lower=True):
        sizes = np.diff(part.bounds)
        windows = -(-sizes // CORE)
        owner = np.repeat(np.arange(part.n), windows)
        nth = tokens.ragged(np.zeros(part.n, np.int64), windows)
        first = part.bounds[:-1][owner] + nth * CORE
        size = np.minimum(part.bounds[1:][owner] - first, CORE)
        width = -(-size // STEP) * STEP
        total, letters = np.zeros((len(first), len(network.languages))), np.zeros(len(first))
        for w in np.unique(width):
            same = np.flatnonzero(width == w)
            for some in np.array_split(same, -(-len(same) // TOGETHER)):
                # from before the window to after it; blanks beyond the text
                at = first[some][:, None] + np.arange(-CONTEXT, int(w) + CONTEXT)[None, :]
                inside = (at >= part.bounds[owner[some]][:, None]) & (at < part.bounds[owner[some] + 1][:, None])
                rows = np.where(inside, part.data[np.where(inside, at, 0)], np.uint8(_BLANK))
                own = rows[:, CONTEXT : CONTEXT + int(w)].T
                weight = _LETTER[own] * (np.arange(int(w))[:, None] < size[some][None, :])
                p = network.positions(rows)[CONTEXT : CONTEXT + int(w)]
                total[some] = np.einsum("tbl,tb->bl", p, weight)
                letters[some] = weight.sum(0)
        sums.append(np.stack([np.bincount(owner, weights=total[:, k], minlength=part.n) for k in range(total.shape[1])], 1))
        counts.append(np.bincount(owner, weights=letters, minlength=part.n))
    sums, counts = np.concatenate(sums), np.concatenate(counts)
    return sums / np.maximum(counts, 1)[:, None], counts


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the names are lengthened if docs has them)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pred, score, letter = (free_name(n, docs.columns) for n in ("lang_pred", "score", "has_letter"))
    if network is None:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    at, n = [x.lower() for x in docs.columns].index(text.lower()), len(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(network)
    names = np.array([*network.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.frugal(batches):
            mean, _ = pooled(sent.value, batch.column(at))
            some = batch.column(n).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(some, mean.argmax(1), len(names) - 1)
            made = [*batch.columns[:n], pa.array(names[best], pa.string()), pa.array(np.where(some, np.clip(mean.max(1), 0, 1), 0.0))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    has_letter = F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False))
    return docs.withColumn(letter, has_letter).mapInArrow(run, schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    network = train(docs)
    return predict(docs.select("doc_id", "text"), network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
