"""Hash-bucketed incidence lists: (hash, owner) pairs packed into one binary row per batch and bucket.

Packing keeps a shuffled pair at about ten bytes instead of a whole row each. The bucket is the top
bits of the hash, so all pairs of a hash meet in one group, and as every batch first keeps one pair
per hash, the pairs of the hottest hash number at most the batches, not the documents.

The number of buckets grows with the text, but one exchange tells at most ``FAN_OUT`` of them apart, so
that a packed row doesn't shrink to single pairs. Beyond that, ``split`` divides each of these once more
in a second exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm import tokens

PACKED = "bucket bigint, hashes binary, owners binary, counts binary"
PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])

#: Pairs that a map task gathers before it packs them.
PACK_PAIRS = 3 << 18
#: Buckets that one exchange tells apart; a power of two.
FAN_OUT = 4096


def coarse(buckets: int, fan_out: int = FAN_OUT) -> int:
    """How many buckets the first of the exchanges tells apart."""
    return buckets if buckets <= fan_out else 1 << ((buckets.bit_length() - 1) + 1) // 2


def top(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each uint64 hash: its top bits."""
    return (hashes >> np.uint64(65 - int(buckets).bit_length())).astype(np.int64)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def spread(owners: np.ndarray) -> np.ndarray:
    """XXH64 of int64 owners with seed 42, which is Spark's xxhash64."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = _rotated(owners.astype(np.int64).view(np.uint64) * two, 31) * one
    x = _rotated(x ^ (five + np.uint64(50)), 27) * one + four
    x ^= x >> np.uint64(33)
    x *= two
    x ^= x >> np.uint64(29)
    x *= three
    x ^= x >> np.uint64(32)
    return x


def owner_bucket(owners: np.ndarray, buckets: int) -> np.ndarray:
    return top(spread(owners), buckets)


def owner_bucket_column(owner: Column, buckets: int) -> Column:
    """The same as a column expression over a bigint."""
    return F.shiftrightunsigned(F.xxhash64(owner), 65 - int(buckets).bit_length())


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[0]:bounds[1]], ... as binary, without a loop."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def pack(to: np.ndarray, hashes: np.ndarray, owners: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket in to that has pairs. Pairs of a bucket keep their order, which compresses owners."""
    order = np.argsort(to, kind="stable")
    to, hashes, owners = to[order], hashes[order], owners[order]
    begins, _ = group_ids(to)
    bounds = np.append(begins, len(to))
    more = pa.nulls(len(begins), pa.binary()) if counts is None else _binary(counts[order].astype(np.int32), bounds)
    return pa.RecordBatch.from_arrays([pa.array(to[begins]), _binary(hashes, bounds), _binary(owners, bounds), more], schema=PACKED_ARROW)


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """All values of a packed column, one after the other."""
    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, offsets, data = chunk.buffers()
        if len(chunk) and data is not None:
            at = np.frombuffer(offsets, np.int32)
            raw = np.frombuffer(data, np.uint8)[at[chunk.offset] : at[chunk.offset + len(chunk)]]
            out.append(np.frombuffer(raw.tobytes(), kind) if raw.ctypes.data % 8 else raw.view(kind))
    return np.concatenate(out) if out else np.zeros(0, kind)


def split(packed: DataFrame, buckets: int, by_owner: bool = False, fan_out: int = FAN_OUT) -> DataFrame:
    """Packed rows by the coarse buckets, now by all buckets; unchanged where one exchange was enough.

    Rows of negative buckets are passed on as they are.
    """
    first = coarse(buckets, fan_out)
    if first == buckets:
        return packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pairs = 0

        def again() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            hashes, owners = joined(table["hashes"], np.uint64), joined(table["owners"], np.int64)
            counts = joined(table["counts"], np.int32) if table["counts"].null_count < table.num_rows else None
            return pack(owner_bucket(owners, buckets) if by_owner else top(hashes, buckets), hashes, owners, counts)

        for batch in tokens.frugal(batches):
            own = batch.column(0).to_numpy(zero_copy_only=False) >= 0
            if not own.all():
                yield batch.filter(pa.array(~own))
                batch = batch.filter(pa.array(own))
            if batch.num_rows:
                held.append(batch)
                pairs += batch.column(1).nbytes // 8
            if pairs > PACK_PAIRS:
                yield again()
                held, pairs = [], 0
        if held:
            yield again()

    return packed.repartition(first, "bucket").mapInArrow(run, PACKED)


def owned(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Owners, hashes, counts of a bucket of owners, in order of owners, and where each owner begins (and the last ends)."""
    owners, hashes = joined(table.column("owners"), np.int64), joined(table.column("hashes"), np.uint64)
    counted = table.column("counts").null_count < table.num_rows
    order = np.argsort(owners, kind="stable")
    owners = owners[order]
    begins, _ = group_ids(owners)
    return owners, hashes[order], joined(table.column("counts"), np.int32)[order] if counted else None, np.append(begins, len(owners))


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that occur more than once, in order of the hashes."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    twice = np.zeros(len(ranked), bool)
    if len(ranked):
        same = ranked[1:] == ranked[:-1]
        twice[1:] |= same
        twice[:-1] |= same
    return order[twice]


def group_ids(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the run of each value."""
    if not len(ranked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1
