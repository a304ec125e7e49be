"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a merge-type model file (its path is a parameter; the driver reads it and
broadcasts the tables). Encoding is the agenda algorithm: of all neighbouring symbols whose
concatenation is a piece, the one with the best score is merged first, the leftmost of equals. With
dropout, a keyed hash of (seed, text, place in it, unit, first, middle and last character) decides for
each candidate merge whether the agenda skips it, so a text encodes alike on every run and retry, and
differently with another seed. Every occurrence of a unit draws its own merges.

A text is cut into units between two characters that stand together in no piece, where no merge can
cross. All units of a slice go through the agenda at the same time; the course of merges and skips is
remembered as a tree, so that occurrences which draw alike share its work. Unknown characters become byte
pieces. Decoding gives back every text exactly; so U+2581, which the model uses for spaces, is
itself written as bytes.

Defined results: a null text has null ids and decodes to null; an empty text has no ids. Repeated
texts have equal ids. Columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm import tokens
from haulframe.llm.storage import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20240607

#: Units are kept in rows of these widths; those of more characters are segmented one by one with a heap.
WIDTHS = (4, 8, 16, 48)
#: A unit that occurs so often in a slice is remembered; rarer ones are merged without that, as it costs more than one use saves.
SHARED = 2
#: Bytes of text whose units are looked at together.
ENCODE_BYTES = 1 << 20
#: The remembered courses are forgotten between slices once they have more nodes; what is computed stays the same.
AGENDA_NODES = 200_000

_NONE = np.float32(np.inf)
_SPACE_MARK = 0x2581


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


@dataclass
class Model:
    """Tables of a vocabulary; everything in it is bounded by the vocabulary's size."""

    pieces: list[bytes]  # what each id decodes to
    byte_ids: np.ndarray  # of the 256 bytes
    char_ids: dict[int, int]  # of single characters; the space stands for its mark
    pairs: np.ndarray  # uint64 keys in a hash table, or the maximum where free
    merged: np.ndarray  # id that the pair becomes
    cost: np.ndarray  # minus its score
    probes: int
    cuts: np.ndarray  # bool, by two neighbouring bytes at a character bound
    dropout: float = DROPOUT
    seed: int = SEED
    _chars: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def load(path: str = MODEL, **options) -> Model:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.get_piece_size()
        names = [processor.id_to_piece(i) for i in range(n)]
        is_byte = [processor.is_byte(i) for i in range(n)]
        plain = {names[i]: i for i in range(n) if not (is_byte[i] or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))}
        byte_ids = np.full(256, -1, np.int32)
        pieces = []
        for i in range(n):
            if is_byte[i]:
                byte_ids[int(names[i][3:5], 16)] = i
            pieces.append(bytes([int(names[i][3:5], 16)]) if is_byte[i] else names[i].replace(chr(_SPACE_MARK), " ").encode() if names[i] in plain else b"")
        if (byte_ids < 0).any():
            raise ValueError(f"{path} has no byte pieces; it can't decode every text")
        cuts = np.ones((256, 256), bool)
        left, right, merged, cost = [], [], [], []
        for name, i in plain.items():
            text = name.replace(chr(_SPACE_MARK), " ")
            for a, b in zip(text, text[1:]):
                cuts[a.encode()[-1], b.encode()[0]] = False
            for j in range(1, len(name)):
                a, b = plain.get(name[:j]), plain.get(name[j:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i), cost.append(-processor.get_score(i))
        chars = {ord(name): i for name, i in plain.items() if len(name) == 1}
        chars[0x20] = chars.pop(_SPACE_MARK)
        table = _hash_table(_pair_key(np.array(left), np.array(right)), np.array(merged, np.int32), np.array(cost, np.float32))
        return Model(pieces, byte_ids, chars, *table, cuts, **options)

    def chars(self) -> np.ndarray:
        """Id of every code point, or less than 0: minus one minus the code point."""
        if self._chars is None:
            self._chars = -1 - np.arange(0x110000, dtype=np.int32)
            self._chars[list(self.char_ids)] = list(self.char_ids.values())
        return self._chars

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and cost of the merge of two symbols; cost is infinite where there is none."""
        key = _pair_key(left, right)
        mask = np.int64(len(self.pairs) - 1)
        slot = (tokens.mix(key) >> np.uint64(1)).astype(np.int64) & mask
        at = np.full(len(key), -1, np.int64)
        for step in range(self.probes):
            here = (slot + step) & mask
            at = np.where(self.pairs[here] == key, here, at)
        known = (at >= 0) & (left >= 0) & (right >= 0)
        return self.merged[at], np.where(known, self.cost[at], _NONE)

    def as_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of symbols (given one after the other) and how many each has: unknown characters become their bytes."""
        unknown = symbols < 0
        if not unknown.any():
            return symbols, counts
        raw = [chr(-1 - s).encode() for s in symbols[unknown].tolist()]
        spread = np.ones(len(symbols), np.int64)
        spread[unknown] = [len(x) for x in raw]
        ids = np.repeat(symbols, spread)
        ids[np.repeat(unknown, spread)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.concatenate(([0], np.cumsum(spread)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends)


def _hash_table(keys: np.ndarray, merged: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    size = 1 << int(4 * len(keys)).bit_length()
    free = np.uint64((1 << 64) - 1)
    table, to_merged, to_cost = np.full(size, free), np.zeros(size, np.int32), np.full(size, _NONE, np.float32)
    slot = (tokens.mix(keys.copy()) >> np.uint64(1)).astype(np.int64) & (size - 1)
    left, probes = np.arange(len(keys)), 0
    while len(left):
        here = (slot[left] + probes) & (size - 1)
        empty = table[here] == free
        _, first = np.unique(here, return_index=True)
        take = np.zeros(len(left), bool)
        take[first] = True
        take &= empty
        table[here[take]], to_merged[here[take]], to_cost[here[take]] = keys[left[take]], merged[left[take]], cost[left[take]]
        left, probes = left[~take], probes + 1
    return table, to_merged, to_cost, probes


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters begin, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
    lead = padded[at]
    tail = [padded[at + j] & 0x3F for j in (1, 2, 3)]
    code = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | tail[0], np.where(lead < 0xF0, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])))
    return at, code


class _Grown:
    """A numpy array that rows are added to."""

    def __init__(self, shape: tuple[int, ...], kind: type):
        self.n, self.held = 0, np.zeros((1024, *shape), kind)

    def __len__(self) -> int:
        return self.n

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            more = np.zeros((max(2 * len(self.held), self.n + len(rows)), *self.held.shape[1:]), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def rows(self) -> np.ndarray:
        return self.held[: self.n]


class Agenda:
    """The agenda's course over units, remembered as a tree.

    A node is a unit with some merges done and some skipped; it names the candidate that the agenda gives out
    next (first, middle and last character), or is a leaf if there is none. Whether an occurrence goes on at
    ``take`` (the candidate is merged) or at ``skip`` is drawn for that occurrence, so all draw on their own,
    but a course that another occurrence took before needs no merging again.
    """

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[int, int] = {}
        self.place, self.take, self.skip = _Grown((3,), np.int32), _Grown((), np.int32), _Grown((), np.int32)
        self.kind, self.row, self.best = _Grown((), np.int8), _Grown((), np.int32), _Grown((), np.int8)
        self.at, self.counts, self.pool = _Grown((), np.int64), _Grown((), np.int64), _Grown((), np.int32)
        # per width: symbols, first character of each symbol, merged symbol and its cost; how many symbols
        self.states = [(_Grown((w,), np.int32), _Grown((w + 1,), np.int16), _Grown((w,), np.int32), _Grown((w,), np.float32), _Grown((), np.int16)) for w in WIDTHS]

    def _offer(self, symbols: np.ndarray, merged: np.ndarray, cost: np.ndarray, sizes: np.ndarray, rows: np.ndarray, i: np.ndarray) -> None:
        """Candidates of symbol i of the rows and its right neighbour."""
        fits = (i >= 0) & (i + 1 < sizes[rows])
        gone = rows[(i >= 0) & ~fits], i[(i >= 0) & ~fits]
        rows, i = rows[fits], i[fits]
        merged[rows, i], cost[rows, i] = self.model.look_up(symbols[rows, i], symbols[rows, i + 1])
        cost[gone] = _NONE

    def _add(self, kind: int, symbols: np.ndarray, firsts: np.ndarray, merged: np.ndarray, cost: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the new nodes with these states."""
        n, every = len(self.take), np.arange(len(sizes))
        best = cost.argmin(1)
        leaf = ~(cost[every, best] < _NONE)
        last = np.minimum(best + 2, firsts.shape[1] - 1)
        place = np.stack((firsts[every, best], firsts[every, best + 1], firsts[every, last]), 1).astype(np.int32)
        place[leaf] = -1
        self.row.add(len(self.states[kind][4]) + every)
        for held, rows in zip(self.states[kind], (symbols, firsts, merged, cost, sizes)):
            held.add(rows)
        none = np.full(len(sizes), -1)
        for held, rows in ((self.place, place), (self.take, none), (self.skip, none), (self.kind, np.full(len(sizes), kind)), (self.best, best)):
            held.add(rows)
        ids, counts = self.model.as_ids(symbols[leaf][np.arange(symbols.shape[1])[None, :] < sizes[leaf][:, None]], sizes[leaf].astype(np.int64))
        at, per = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        per[leaf], at[leaf] = counts, len(self.pool) + np.cumsum(counts) - counts
        self.pool.add(ids), self.at.add(at), self.counts.add(per)
        return n + every

    def roots(self, units: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The root of each unit; -1 for those neither known nor wanted, or of more characters than there are widths for."""
        out = np.array([self.known.get(u, -1) for u in units.tolist()], np.int64)
        low, chars = 0, self.model.chars()
        for kind, width in enumerate(WIDTHS):
            new = np.flatnonzero((out < 0) & wanted & (sizes > low) & (sizes <= width))
            low = width
            if len(new):
                n = sizes[new].astype(np.int16)
                symbols = np.full((len(new), width), -1, np.int32)
                symbols[np.arange(width)[None, :] < n[:, None]] = chars[points[tokens.ragged(starts[new], sizes[new])]]
                firsts = np.broadcast_to(np.arange(width + 1, dtype=np.int16), (len(new), width + 1))
                merged, cost = np.zeros((len(new), width), np.int32), np.full((len(new), width), _NONE, np.float32)
                self._offer(symbols, merged, cost, n, *np.nonzero(np.arange(width)[None, :] + 1 < n[:, None]))
                out[new] = self._add(kind, symbols, firsts, merged, cost, n)
                self.known.update(zip(units[new].tolist(), out[new].tolist()))
        return out

    def _grow(self, nodes: np.ndarray, skipped: np.ndarray) -> None:
        """Adds the next nodes of these, where their candidate is skipped or not."""
        for kind in np.unique(self.kind.rows[nodes]):
            mine = self.kind.rows[nodes] == kind
            parents, skip = nodes[mine], skipped[mine]
            rows, best = self.row.rows[parents], self.best.rows[parents].astype(np.int64)
            symbols, firsts, merged, cost, sizes = (x.rows[rows] for x in self.states[kind])
            cost[skip, best[skip]] = _NONE
            every = np.flatnonzero(~skip)
            if len(every):
                b, width = best[every], symbols.shape[1]
                symbols[every, b] = merged[every, b]
                # all that stands right of the merge moves one place to the left
                columns = np.arange(width + 1)[None, :]
                after, from_it = np.minimum(columns + (columns > b[:, None]), width), columns + (columns >= b[:, None])
                firsts[every] = np.take_along_axis(firsts[every], after, 1)
                symbols[every] = np.take_along_axis(symbols[every], np.minimum(after[:, :width], width - 1), 1)
                from_it = np.minimum(from_it[:, :width], width - 1)
                merged[every], cost[every] = np.take_along_axis(merged[every], from_it, 1), np.take_along_axis(cost[every], from_it, 1)
                sizes[every] -= 1
                for i in (b - 1, b):
                    self._offer(symbols, merged, cost, sizes, every, i)
            new = self._add(int(kind), symbols, firsts, merged, cost, sizes)
            self.skip.rows[parents[skip]] = new[skip]
            self.take.rows[parents[~skip]] = new[~skip]

    def walk(self, node: np.ndarray, keys: np.ndarray, skips) -> np.ndarray:
        """The leaf of each occurrence from its root on."""
        node = node.copy()
        going = np.arange(len(node))
        while True:
            place = self.place.rows[node[going]]
            some = place[:, 0] >= 0
            going, place = going[some], place[some]
            if not len(going):
                return node
            at = node[going]
            skipped = skips(keys[going], place[:, 0], place[:, 1], place[:, 2])
            after = np.where(skipped, self.skip.rows[at], self.take.rows[at])
            new = np.flatnonzero(after < 0)
            if len(new):
                wanted = np.unique(at[new] * 2 + skipped[new])
                for some_wanted in np.array_split(wanted, len(wanted) // 16384 + 1):
                    self._grow(some_wanted >> 1, (some_wanted & 1).astype(bool))
                after[new] = np.where(skipped[new], self.skip.rows[at[new]], self.take.rows[at[new]])
            node[going] = after

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all leaves, and of each node where they begin and how many they are."""
        return self.pool.rows, self.at.rows, self.counts.rows


class Encoder:
    """Segments texts with a model; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.limit = np.uint64(min(int(model.dropout * 2**64), 2**64 - 1))
        self.lengths = np.array([len(x) for x in model.pieces], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(model.pieces), np.uint8)
        self.agenda = Agenda(model)

    def _skipped(self, unit: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not self.limit:
            return np.zeros(len(unit), bool)
        place = (first.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ last.astype(np.uint64)
        return tokens.mix(unit ^ tokens.mix(place + np.uint64(self.model.seed & (2**64 - 1)))) < self.limit

    def _candidates(self, unit, symbols, firsts, i, rows):
        """Id and cost of merging symbol i of the rows with its right neighbour."""
        merged, cost = self.model.look_up(symbols[rows, i], symbols[rows, i + 1])
        some = np.flatnonzero(cost < _NONE)
        r, c = rows[some], i[some]
        cost[some[self._skipped(unit[r], firsts[r, c], firsts[r, c + 1], firsts[r, c + 2])]] = _NONE
        return merged, cost

    def _merge_together(self, unit: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All units of a matrix at the same time: each step takes the best merge of every row."""
        n, width = symbols.shape
        firsts = np.broadcast_to(np.arange(width + 2, dtype=np.int32), (n, width + 2)).copy()
        symbols = np.concatenate((symbols, np.full((n, 1), -1, np.int32)), 1)
        cost = np.full((n, width + 1), _NONE, np.float32)
        merged = np.zeros((n, width + 1), np.int32)
        rows, i = np.nonzero(np.arange(width)[None, :] + 1 < sizes[:, None])
        merged[rows, i], cost[rows, i] = self._candidates(unit, symbols, firsts, i, rows)
        out, out_sizes = symbols.copy(), sizes.copy()
        names = np.arange(n)
        while len(names):
            best = cost.argmin(1)
            going = cost[np.arange(len(names)), best] < _NONE
            if not going.all():
                done = ~going
                out[names[done], : symbols.shape[1]], out_sizes[names[done]] = symbols[done], sizes[done]
                names, unit, symbols, firsts, cost, merged, sizes, best = (x[going] for x in (names, unit, symbols, firsts, cost, merged, sizes, best))
                if not len(names):
                    break
            every = np.arange(len(names))
            symbols[every, best] = merged[every, best]
            # all that stands right of the merge moves one place to the left
            columns = np.arange(symbols.shape[1])[None, :]
            symbols = np.take_along_axis(symbols, np.minimum(columns + (columns > best[:, None]), symbols.shape[1] - 1), 1)
            moved = np.minimum(columns + (columns >= best[:, None]), symbols.shape[1] - 1)
            cost, merged = np.take_along_axis(cost, moved, 1), np.take_along_axis(merged, moved, 1)
            columns = np.arange(firsts.shape[1])[None, :]
            firsts = np.take_along_axis(firsts, np.minimum(columns + (columns > best[:, None]), firsts.shape[1] - 1), 1)
            sizes = sizes - 1
            for i in (best - 1, best):
                valid = (i >= 0) & (i + 1 < sizes)
                rows = np.flatnonzero(valid)
                merged[rows, i[rows]], cost[rows, i[rows]] = self._candidates(unit, symbols, firsts, i[rows], rows)
                rows = np.flatnonzero((i >= 0) & ~valid)
                cost[rows, i[rows]] = _NONE
        return out[:, :width], out_sizes

    def _merge_alone(self, unit: np.uint64, symbols: np.ndarray) -> np.ndarray:
        """One unit of any length with an agenda."""
        n = len(symbols)
        symbol, before, after = symbols.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        end = list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int, int]] = []

        def offer(left: np.ndarray, right: np.ndarray) -> None:
            ids, cost = self.model.look_up(np.array([symbol[i] for i in left]), np.array([symbol[i] for i in right]))
            some = np.flatnonzero(cost < _NONE)
            if len(some):
                l, r = np.array(left)[some], np.array(right)[some]
                skip = self._skipped(np.full(len(l), unit), l, r, np.array([end[i] for i in r]))
                for a, b, x, c, s in zip(l.tolist(), r.tolist(), ids[some].tolist(), cost[some].tolist(), skip):
                    if not s:
                        heapq.heappush(agenda, (c, a, b, end[b], x))

        if n > 1:
            offer(np.arange(n - 1), np.arange(1, n))
        alive = [True] * n
        while agenda:
            _, a, b, stop, x = heapq.heappop(agenda)
            if not (alive[a] and alive[b] and after[a] == b and end[b] == stop and end[a] == b):
                continue
            symbol[a], alive[b], after[a], end[a] = x, False, after[b], end[b]
            if after[a] >= 0:
                before[after[a]] = a
            near = [(before[a], a), (a, after[a])]
            near = [p for p in near if min(p) >= 0]
            if near:
                offer([p[0] for p in near], [p[1] for p in near])
        return np.array([symbol[i] for i in range(n) if alive[i]], np.int32)

    def _apart(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of occurrences that share nothing, one after the other, and how many each has."""
        chars = self.model.chars()
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        low = 0
        for width in (1, 4, 6, 8, 10, 12, 16, 24, WIDTHS[-1]):
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for some in np.array_split(which, max(1, len(which) * width >> 17)):
                if len(some):
                    symbols = np.full((len(some), width), -1, np.int32)
                    symbols[np.arange(width)[None, :] < sizes[some][:, None]] = chars[points[tokens.ragged(starts[some], sizes[some])]]
                    symbols, counts = self._merge_together(keys[some], symbols, sizes[some].astype(np.int32))
                    results.append((some, symbols[np.arange(width)[None, :] < counts[:, None]], counts.astype(np.int64)))
        for one in np.flatnonzero(sizes > WIDTHS[-1]):
            symbols = self._merge_alone(keys[one], chars[points[starts[one] : starts[one] + sizes[one]]])
            results.append((np.array([one]), symbols, np.array([len(symbols)])))
        which, counts = np.concatenate([r[0] for r in results]), np.concatenate([r[2] for r in results])
        flat, at = np.concatenate([r[1] for r in results]), np.cumsum(counts) - counts
        order = np.argsort(which)
        return flat[tokens.ragged(at[order], counts[order])], counts[order]

    def _segment(self, units: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, back: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences one after the other, and how many each has.

        units, starts, sizes: of the different units, hash and place of their characters in points.
        back, keys: of the occurrences, the number of the unit and what their merges are drawn by.
        """
        if len(self.agenda.take) > AGENDA_NODES:
            self.agenda = Agenda(self.model)
        node = self.agenda.roots(units, points, starts, sizes, np.bincount(back, minlength=len(units)) >= SHARED)[back]
        shared, apart = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        node[shared] = self.agenda.walk(node[shared], keys[shared], self._skipped)
        pool, at, counts = self.agenda.leaves()
        more, more_counts = self.model.as_ids(*self._apart(keys[apart], points, starts[back[apart]], sizes[back[apart]]))
        begin, per = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
        begin[shared], per[shared] = at[node[shared]], counts[node[shared]]
        begin[apart], per[apart] = len(pool) + np.cumsum(more_counts) - more_counts, more_counts
        return np.concatenate((pool, more))[tokens.ragged(begin, per)], per

    def _encode_slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # every text that isn't empty begins with one space more
        filled = np.diff(bounds) > 0
        data = np.insert(data, bounds[:-1][filled], 0x20)
        bounds = bounds + np.concatenate(([0], np.cumsum(filled)))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(filled), np.int64)
        first = np.zeros(len(data), bool)
        first[1:] = self.model.cuts[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        first[bounds[:-1][filled]] = True
        starts = np.flatnonzero(first)
        part = tokens.Slice(0, data, bounds, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, bounds))
        hashes = part.word_hashes()
        owners = part.owners()
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
        whole = tokens.mix(sums[part.word_bounds[1:]] - sums[part.word_bounds[:-1]])
        place = (np.arange(len(starts)) - part.word_bounds[owners]).astype(np.uint64)
        drawn = tokens.mix(whole[owners] + place * np.uint64(0x9E3779B97F4A7C15))
        keys = tokens.mix(hashes + drawn)
        units, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        # characters of the different units only
        lengths = (part.ends - part.starts)[where]
        at, points = _code_points(data[tokens.ragged(part.starts[where], lengths)])
        ends = np.searchsorted(at, np.cumsum(lengths))
        sizes = np.diff(ends, prepend=0)
        ids, per_unit = self._segment(units, points, ends - sizes, sizes, back, keys)
        return ids.astype(np.int32), np.diff(np.concatenate(([0], np.cumsum(per_unit)))[part.word_bounds])

    def encode(self, column: pa.Array) -> pa.Array:
        """Lists of ids; null where the text is null."""
        offsets, raw = tokens.text_buffers(column)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, j in tokens.spans(offsets, ENCODE_BYTES):
            found = self._encode_slice(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(found[0]), counts.append(found[1])
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids)), mask=column.is_null() if column.null_count else None)

    def decode(self, column: pa.Array) -> pa.Array:
        """Texts of lists of ids."""
        offsets = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        lengths = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))[offsets - offsets[0]]
        data = self.bytes[tokens.ragged(self.starts[ids], lengths)]
        filled = ends[1:] > ends[:-1]
        keep = np.ones(len(data), bool)
        keep[ends[:-1][filled]] = data[ends[:-1][filled]] != 0x20
        gone = np.concatenate(([0], np.cumsum(~keep)))
        bounds = ends - gone[ends]
        text = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[keep].tobytes())])
        if column.null_count:
            text = pa.compute.if_else(column.is_valid(), text, None)
        return text.cast(pa.string())


_kept: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder per Python worker and broadcast model."""
    if id(sent.value) not in _kept:
        _kept.clear()
        _kept[id(sent.value)] = Encoder(sent.value)
    return _kept[id(sent.value)]


def _mapped(df: DataFrame, model: Model, columns: list[tuple[str, T.DataType]], work) -> DataFrame:
    """df and some columns more, which work makes of an encoder and a batch, a few MB at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(list(df.schema.fields))
    for name, kind in columns:
        schema = schema.add(free_name(name, schema.names), kind)
    arrow = to_arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        for whole in tokens.frugal(batches):
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                made = [*batch.columns, *work(encoder, batch)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _at(df: DataFrame, column: str) -> int:
    return [x.lower() for x in df.columns].index(column.lower())


def encode(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with piece_ids (array of int)."""
    at = _at(docs, text)
    return _mapped(docs, model, [("piece_ids", T.ArrayType(T.IntegerType()))], lambda encoder, batch: [encoder.encode(batch.column(at))])


def decode(df: DataFrame, model: Model, ids: str = "piece_ids") -> DataFrame:
    """df with decoded (string)."""
    at = _at(df, ids)
    return _mapped(df, model, [("decoded", T.StringType())], lambda encoder, batch: [encoder.decode(batch.column(at))])


def round_trip(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with piece_ids and lossless (whether decoding them gave the text), in one pass."""
    import pyarrow.compute as pc

    at = _at(docs, text)

    def work(encoder: Encoder, batch: pa.RecordBatch) -> list[pa.Array]:
        ids = encoder.encode(batch.column(at))
        return [ids, pc.equal(encoder.decode(ids), batch.column(at))]

    return _mapped(docs, model, [("piece_ids", T.ArrayType(T.IntegerType())), ("lossless", T.BooleanType())], work)


def op2_sentencepieces(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = round_trip(docs, Model.load(path))
    return done.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "lossless", "piece_ids")
