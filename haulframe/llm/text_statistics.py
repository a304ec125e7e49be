"""Per-document statistics of whole texts, vectorised over the bytes of many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from haulframe.llm import tokens

_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _EXCLAIM, _MARK, _OTHER, _BEYOND = range(9)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _POINT
_CLASS[ord("!")] = _EXCLAIM
_CLASS[[ord(c) for c in "#*$%&|<>"]] = _MARK
_CLASS[128:] = _BEYOND
_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True

NAMES = (
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "space", "point", "exclaim", "mark", "other", "beyond",
    "distinct_words", "same_as_before", "commonest_word", "upper_words", "distinct_windows", "words_a_line", "distinct_lines",
)


def _per_document(owners: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owners, weights=values, minlength=n).astype(np.float64)


def _distinct(owners: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and how often its commonest one occurs."""
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    begins = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, owners[begins], np.diff(np.append(begins, len(order))))
    return _per_document(owners[begins], n), most


def statistics(part: tokens.Slice) -> np.ndarray:
    """A row for each document of the slice, a column for each of NAMES; zeros where there is nothing to divide by."""
    n = part.n
    sizes = np.diff(part.bounds)
    classes = np.bincount(np.repeat(np.arange(n), sizes) * 9 + _CLASS[part.data], minlength=9 * n).reshape(n, 9)
    words = part.word_hashes()
    owners = part.owners()
    n_words = np.diff(part.word_bounds).astype(np.float64)
    per_word = 1 / np.maximum(n_words, 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owners[1:] == owners[:-1])
    first, second = part.data[part.starts], part.data[np.minimum(part.starts + 1, len(part.data) - 1)] if len(words) else part.starts
    shouted = (_CLASS[first] == _UPPER) & (_CLASS[second] == _UPPER) if len(words) else same
    distinct, most = _distinct(owners, words, n)
    windows, at = part.windows(words, 5)
    window_owners = owners[at]
    n_windows = _per_document(window_owners, n)
    distinct_windows, _ = _distinct(window_owners, windows, n)
    starts, ends, bounds = tokens.split_words(part.data, part.bounds, _LINE_END)
    lines = tokens.Slice(0, part.data, part.bounds, starts, ends, bounds)
    n_lines = np.diff(bounds).astype(np.float64)
    distinct_lines, _ = _distinct(lines.owners(), lines.word_hashes(), n)
    shares = classes / np.maximum(sizes, 1)[:, None]
    letters = sizes - classes[:, _SPACE]
    return np.stack([
        np.log1p(sizes), np.log1p(n_words), letters * per_word, *shares[:, [_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _EXCLAIM, _MARK, _OTHER, _BEYOND]].T,
        distinct * per_word, _per_document(owners, n, same) * per_word, most * per_word, _per_document(owners, n, shouted) * per_word,
        distinct_windows / np.maximum(n_windows, 1), n_words / np.maximum(n_lines, 1), distinct_lines / np.maximum(n_lines, 1),
    ], 1)


def with_statistics(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """docs without its text column and with the statistics under the given names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = [c.lower() for c in docs.columns].index(text.lower())
    schema = T.StructType([f for i, f in enumerate(docs.schema.fields) if i != at] + [T.StructField(names[x], T.DoubleType()) for x in NAMES])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.frugal(batches):
            found = np.concatenate([np.zeros((0, len(NAMES))), *(statistics(p) for p in tokens.slices(batch.column(at)))])
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *(pa.array(x) for x in found.T)], arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)
