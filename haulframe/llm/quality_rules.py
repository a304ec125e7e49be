"""Quality rules in DataFrame functions only: repetition counts and distribution divergence.

Besides the counted rules, a document's histogram of character classes and its histogram of common
words are compared with those of each reference language by the Jensen-Shannon distance (base 2, from
0 to 1). A document is kept if in one and the same language both distances are within their bounds.
Short texts have noisy histograms: below ``MIN_CHARS`` characters or ``MIN_WORDS`` words the
respective distance is not judged. Everything is computed inside the row: no shuffle, no Python.

Defined results: null or empty text has no words, zero counts, fails the base rule and is not kept.
Repeated rows get equal results, a null doc_id is carried through, and an input without rows gives none.
Very long texts are measured whole. Columns of the input that bear a result's name are replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm.storage import free_name

WINDOW = 5
MIN_WORDS = 40
MIN_CHARS = 80
#: A distance may be the first number plus the second over the root of the characters (words): what sampling adds.
CLASS_BOUND = (0.15, 1.5)
WORD_BOUND = (0.24, 0.3)

# single characters, not ranges: Java's patterns look those up in a table
_SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]+"
_WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"

#: Character classes, each taken out of what the ones before it have left; the rest is beyond ASCII.
CLASSES = (r"[a-z]+", _SPACE, r"[A-Z]+", r"[0-9]+", r"[.,;:!?'\x22()-]+", r"[\x00-\x7F]+")


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes (in order of CLASSES, then the rest) and of the commonest words of running text."""

    classes: tuple[float, ...]
    words: dict[str, float]


# Approximate, rounded shares of running prose in four languages, not counted from a corpus.
REFERENCES = {
    "en": Reference((0.795, 0.165, 0.018, 0.002, 0.018, 0.001, 0.001), {"the": 0.055, "of": 0.029, "and": 0.024, "to": 0.021, "a": 0.017, "in": 0.016, "is": 0.010, "that": 0.009, "it": 0.008, "for": 0.008}),
    "de": Reference((0.790, 0.140, 0.030, 0.002, 0.020, 0.001, 0.017), {"der": 0.045, "die": 0.032, "und": 0.025, "in": 0.018, "den": 0.012, "von": 0.011, "zu": 0.010, "das": 0.010, "mit": 0.008, "sich": 0.007}),
    "fr": Reference((0.770, 0.160, 0.018, 0.002, 0.020, 0.001, 0.029), {"de": 0.050, "la": 0.028, "le": 0.022, "et": 0.019, "les": 0.016, "des": 0.013, "en": 0.012, "un": 0.010, "du": 0.009, "une": 0.008}),
    "es": Reference((0.785, 0.165, 0.018, 0.002, 0.018, 0.001, 0.011), {"de": 0.055, "la": 0.032, "que": 0.027, "el": 0.023, "en": 0.021, "y": 0.018, "los": 0.013, "las": 0.010, "se": 0.010, "del": 0.010}),
}


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def at(ranked: Column) -> Column:
            same = F.filter(ranked, lambda e, i: (e["h"] == F.get(ranked, i - 1)["h"]) | (e["h"] == F.get(ranked, i + 1)["h"]))
            return F.array_sort(F.transform(same, lambda e: e["p"]))

        def total(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, _let(_let(ranked, at), total)).otherwise(F.lit(0).cast("bigint"))

    def windows(hashed: Column) -> Column:
        rolled = F.transform(hashed, lambda h, i: F.xxhash64(h, *(F.get(hashed, i + j) for j in range(1, WINDOW))))
        return F.slice(rolled, 1, F.greatest(F.size(hashed) - (WINDOW - 1), F.lit(0)))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)


def _distance(shares: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms; reference shares are above 0."""
    terms = []
    for p, q in zip(shares, reference):
        middle = (p + q) / 2
        terms.append(F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + q * F.log2(F.lit(q) / middle))
    return F.sqrt(F.greatest(reduce(add, terms) / 2, F.lit(0.0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, per language, class_<name> and word_<name> distances.

    Columns of docs that have one of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    common = sorted({w for r in REFERENCES.values() for w in r.words})

    def of_words(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(common))
        counts = _let(hits, lambda h: F.array(*(_count(h, c) for c in common)))
        return F.struct(F.size(words).cast("bigint").alias("n_words"), _repeat_words(words).alias("n_repeat_words"), counts.alias("common"))

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")

    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(_WORD)))
    held = free_name("measured", docs.columns)
    made = docs.withColumn(held, F.struct(
        _let(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), of_words).alias("words"),
        _let(lines, of_lines).alias("n_dup_lines"),
        F.length(F.regexp_replace(t, _SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _left_lengths(t).alias("left"),
    ))
    m = F.col(held)
    total = F.greatest(m["left"][0], F.lit(1))
    classes = [(m["left"][i] - m["left"][i + 1]) / total for i in range(len(CLASSES))] + [m["left"][len(CLASSES)] / total]
    n_words = F.greatest(m["words"]["n_words"], F.lit(1))
    out = {name: m["words"][name] for name in ("n_words", "n_repeat_words")} | {name: m[name] for name in ("word_chars", "n_symbols", "n_dup_lines")}
    for name, reference in REFERENCES.items():
        shares = [m["words"]["common"][common.index(w)] / n_words for w in reference.words]
        shares.append(1 - reduce(add, shares))
        out[f"class_{name}"] = _distance(classes, list(reference.classes))
        out[f"word_{name}"] = _distance(shares, [*reference.words.values(), 1 - sum(reference.words.values())])
    return made.withColumns(out).drop(held)


def _left_lengths(t: Column) -> Column:
    """Array of lengths: of the text, and of what is left after each class in turn is taken out."""

    def step(left: Column, rest: tuple[str, ...], lengths: list[Column]) -> Column:
        lengths = [*lengths, F.length(left)]
        if not rest:
            return F.array(*lengths)
        return _let(F.regexp_replace(left, rest[0], ""), lambda x: step(x, rest[1:], lengths))

    return _let(t, lambda x: step(x, CLASSES, []))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure(docs) with base_failed and kept."""
    few, many = F.col("n_words") < MIN_WORDS, F.col("word_chars") >= MIN_CHARS
    class_bound = CLASS_BOUND[0] + CLASS_BOUND[1] / F.sqrt(F.greatest("word_chars", F.lit(1)))
    word_bound = WORD_BOUND[0] + WORD_BOUND[1] / F.sqrt(F.greatest("n_words", F.lit(1)))
    close = [(~many | (F.col(f"class_{n}") <= class_bound)) & (few | (F.col(f"word_{n}") <= word_bound)) for n in REFERENCES]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a | b, close))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same rules in DuckDB's SQL."""
    common = sorted({w for r in REFERENCES.values() for w in r.words})

    def distance(shares: list[str], reference: list[float]) -> str:
        terms = [f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}) / 2)) ELSE 0.0 END + {q!r} * log2({q!r} / (({p} + {q!r}) / 2)))" for p, q in zip(shares, reference)]
        return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    n = len(CLASSES)
    shares = [f"((length(l{i}) - length(l{i + 1})) / greatest(length(l0), 1)::DOUBLE)" for i in range(n)] + [f"(length(l{n}) / greatest(length(l0), 1)::DOUBLE)"]
    counts = ", ".join(f"(count(*) FILTER (lower(x) = '{w}'))::DOUBLE AS c_{i}" for i, w in enumerate(common))
    close = []
    for r in REFERENCES.values():
        words = [f"(coalesce(c_{common.index(w)}, 0) / greatest(n_words, 1))" for w in r.words]
        words.append("(1 - (" + " + ".join(words) + "))")
        close.append(f"((word_chars < {MIN_CHARS} OR {distance(shares, list(r.classes))} <= {CLASS_BOUND[0]} + {CLASS_BOUND[1]} / sqrt(greatest(word_chars, 1))) AND (n_words < {MIN_WORDS} OR {distance(words, [*r.words.values(), 1 - sum(r.words.values())])} <= {WORD_BOUND[0]} + {WORD_BOUND[1]} / sqrt(greatest(n_words, 1))))")
    steps = "SELECT doc_id, t AS l0 FROM texts"
    for i in range(n):
        steps = f"SELECT *, regexp_replace(l{i}, '{quoted(CLASSES[i])}', '', 'g') AS l{i + 1} FROM ({steps})"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM texts),
dups AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
common AS (SELECT doc_id, {counts} FROM (SELECT doc_id, unnest(w) AS x FROM texts) GROUP BY doc_id),
lefts AS ({steps}),
base AS (
    SELECT texts.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
    FROM texts LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND ({' OR '.join(close)}) AS kept
FROM judged LEFT JOIN common USING (doc_id) JOIN lefts USING (doc_id)
"""


OP6_SQL = _sql()
