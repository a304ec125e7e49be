"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

The regression is trained in numpy on a small labelled table (or another one of that kind) and judges what
no rule decides. The table is made by a rule: subjects that blocklists name and subjects that they don't,
as hosts and paths of several shapes; it has nothing from any table that is judged. Features are the hashes
of all 3- to 5-byte n-grams of host and path, counted and scaled to unit length; weights and bias are
learned. Blocked rows weigh a little less than the others together, so that a url of which no n-gram is
known is allowed.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and gets the
verdict of the regression's bias. Repeated rows get equal verdicts, and an input without rows gives
none; a very long url is read whole. Columns of the input are kept; of clashing names the result's are
lengthened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm import tokens
from haulframe.llm.storage import free_name

BITS = 16
SIZES = (3, 4, 5)
THRESHOLD = 0.5
#: What the blocked rows of the table weigh together.
BLOCKED_SHARE = 0.45
#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Subjects of blocklists and of other sites.
BLOCKED_SUBJECTS = "casino poker slots jackpot betting roulette bingo lottery pills viagra pharmacy steroids adult porn escort webcam xxx nude spam linkfarm doorway payday loans replica warez keygen crack torrent malware phishing adserver tracking popunder clickbait banner".split()
ALLOWED_SUBJECTS = "news weather travel music history science library school university museum garden recipe cooking chess cinema theatre poetry painting sports cycling hiking mountains river harbour railway architecture astronomy physics chemistry biology medicine hospital council parliament economy finance housing farming forest fishing sailing photography literature language grammar dictionary encyclopedia software linux forum maps journal research statistics standards archive festival orchestra football tennis animals birds nature climate energy".split()
_TLDS = ("net", "org", "info", "io", "co", "eu")
_SHAPES = ("{0}.{2}/", "www.{0}{1}.{2}/index.html", "{0}-{1}.{2}/{1}/", "blog.{0}.{2}/en/{3}", "{1}-{0}.{2}/fr/{3}", "m.{0}.{2}/{1}/{3}.html", "shop.{1}{0}.{2}/de/", "{0}.{1}.{2}/es/{3}")


# Words that stand beside the subjects.
BLOCKED_BESIDES = "cheap online best free win bonus discount hot".split()
ALLOWED_BESIDES = "city daily open public club guide home world".split()


def labelled(subjects: list[str], besides: list[str]) -> list[str]:
    """Hosts with paths on these subjects, each beside three of the words, in all shapes in turn."""
    out = []
    for i, one in enumerate(subjects):
        for j in range(3):
            out.append(_SHAPES[(3 * i + j) % len(_SHAPES)].format(one, besides[(i + 3 * j) % len(besides)], _TLDS[(i + j) % len(_TLDS)], 100 + 37 * (i % 11) + j))
    return out


BLOCKED, ALLOWED = tuple(labelled(BLOCKED_SUBJECTS, BLOCKED_BESIDES)), tuple(labelled(ALLOWED_SUBJECTS, ALLOWED_BESIDES))

_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice its number of texts, and of all n-grams the text and the hashed bucket."""
    for part in tokens.slices(column):
        owners = np.repeat(np.arange(part.n), np.diff(part.bounds))
        codes = tokens.mix(part.data.astype(np.uint64) + np.uint64(1))
        texts, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in SIZES:
            n = max(len(codes) - size + 1, 0)
            rolled = np.full(n, size, np.uint64)
            for j in range(size):
                rolled = rolled * _ROLL + codes[j : j + n]
            at = np.flatnonzero(owners[:n] == owners[size - 1 :]) if n else np.zeros(0, np.int64)
            texts.append(owners[at])
            buckets.append((tokens.mix(rolled[at]) >> np.uint64(64 - BITS)).astype(np.int64))
        yield part.n, np.concatenate(texts), np.concatenate(buckets)


@dataclass
class Regression:
    weights: np.ndarray
    bias: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Of being blocked, for texts of host and path."""
        out = [np.zeros(0)]
        for n, texts, buckets in _grams(column):
            keys, counts = np.unique(texts << BITS | buckets, return_counts=True)
            owners = keys >> BITS
            length = np.sqrt(np.bincount(owners, weights=counts.astype(np.float64) ** 2, minlength=n))
            total = np.bincount(owners, weights=counts * self.weights[keys & (1 << BITS) - 1], minlength=n)
            out.append(1 / (1 + np.exp(-(total / np.maximum(length, 1) + self.bias))))
        return np.concatenate(out)


def train(blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED, penalty: float = 2e-4, rate: float = 10.0, steps: int = 1500) -> Regression:
    """Gradient descent on the mean log loss with a squared penalty; the table fits the driver by its kind."""
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    x = np.zeros((len(y), 1 << BITS))
    done = 0
    for n, texts, buckets in _grams(pa.array([*blocked, *allowed], pa.string())):
        np.add.at(x, (done + texts, buckets), 1)
        done += n
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    share = np.where(y == 1, BLOCKED_SHARE / max(len(blocked), 1), (1 - BLOCKED_SHARE) / max(len(allowed), 1))
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    w, b = np.zeros(len(used)), 0.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w -= rate * (x.T @ error + penalty * w)
        b -= rate * error.sum()
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Regression(weights, float(b))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column."""
    pattern, u = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(u, pattern, 1), upper, lower), F.regexp_extract(u, pattern, 2)


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, f"{name}{start}") if rule is None else rule.when(fits, f"{name}{start}")
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def judge(pages: DataFrame, model: Regression, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, blocked (the regression's probability) and verdict."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names: list[str] = []
    for n in ("host", "path", "rule", "verdict", "blocked"):
        names.append(free_name(n, [*pages.columns, *names]))
    host, path, rule, verdict, blocked = names
    cut = pages.withColumns(dict(zip((host, path), parts(F.col(url)))))
    cut = cut.withColumns(dict(zip((rule, verdict), decided(F.col(host), F.col(path), rules))))
    schema = T.StructType([*cut.schema.fields, T.StructField(blocked, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    at = len(pages.columns)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in tokens.frugal(batches):
            p = sent.value.probabilities(pc.binary_join_element_wise(batch.column(at), batch.column(at + 1), ""))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.array(p)], arrow)], schema=arrow)

    scored = cut.mapInArrow(run, schema)
    return scored.withColumn(verdict, F.coalesce(F.col(verdict), F.when(F.col(blocked) >= THRESHOLD, "block").otherwise("allow")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train()).select("page_id", "host", "path", "rule", "verdict")
