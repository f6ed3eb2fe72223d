"""SentencePiece encoding and decoding by suffix-array matching.

Text is cut where no piece can reach across (before a run of word marks, and
around line feeds); the distinct stretches of a batch are concatenated and
indexed by a suffix array, sorted as deep as the longest piece. Every piece of
the vocabulary is binary-searched for its range of occurrences; the resulting
edges (start, end, piece) are sorted by position and relaxed.

For a byte-pair model the relaxation has an exact form: a prefix of a text has
one encoding, so one edge into each position is right, namely the one whose
piece can follow the last piece of the encoding of what lies before it. Two
pieces can follow each other if merging their joint text never merges across
the seam, which is settled once for each pair by replaying their merges side
by side. Results are those of the usual merge loop, piece by piece.

Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

MARK = "▁"

_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

#: Distinct stretches that a task keeps encoded; beyond it the store starts anew.
KEPT = 300_000
#: Pairs of pieces that are known to follow each other, kept likewise.
PAIRS = 1_000_000
#: Characters of new stretches that are indexed at a time.
BATCH = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {5: 4, 1: 8}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a byte-pair SentencePiece model with byte fallback."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.bytes_of: list[bytes] = []
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_ids = [-1] * 256
        self.prefix = True
        kinds = []
        for field, value in _fields(model):
            if field == 1:
                got = dict(_fields(value))
                score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
                kinds.append((got.get(1, b"").decode(), score, got.get(3, 1)))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("only byte-pair models are supported")
            elif field == 3:
                got = dict(_fields(value))
                self.prefix = bool(got.get(3, 1))
                if got.get(2) or got.get(4, 1) or not got.get(5, 1):
                    raise ValueError("only models without normalisation are supported")
        for i, (piece, score, kind) in enumerate(kinds):
            self.pieces.append(piece)
            self.bytes_of.append(piece.replace(MARK, " ").encode() if kind == 1 else b"")
            if kind == 1:
                self.rank[piece] = (-score, i)
            elif kind == 6:
                byte = int(_BYTE_PIECE.fullmatch(piece)[1], 16)
                self.byte_ids[byte], self.bytes_of[i] = i, bytes([byte])
            elif kind in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
        if any(MARK in piece.lstrip(MARK) for piece in self.rank):
            raise ValueError("only models whose pieces have marks at their front alone are supported")
        if min(self.byte_ids) < 0:
            raise ValueError("only models with byte fallback are supported")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Encoder:
    """Encodes batches of texts; keeps the encodings of stretches it has met."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.depth = max(map(len, v.rank))
        named = sorted(v.rank)
        self.ids = np.array([v.rank[p][1] for p in named])
        self.sizes = np.array([len(p) for p in named])
        self.named = named
        self.size_of = np.ones(len(v.pieces) + 2, np.int64)  # by piece id; the two beyond: unknown character, start
        self.size_of[self.ids] = self.sizes
        self.unknown, self.start = len(v.pieces), len(v.pieces) + 1
        self.merges: dict[int, tuple] = {}
        self.follows: dict[int, bool] = {}
        chars = sorted({c for p in named for c in p})
        self.code = {c: i + 1 for i, c in enumerate(chars)}  # 0 ends a stretch
        self.code_points = np.array([ord(c) for c in chars], np.uint32)
        self.other = len(chars) + 1
        bits = self.other.bit_length()
        self.per = 64 // bits
        self.bits = bits
        self.piece_keys = self._piece_keys()
        self.isolated = "\n" not in self.code
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    # matching

    def _piece_keys(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest packed key of texts that begin with each piece, word by word."""
        words = -(-self.depth // self.per)
        low = np.zeros((len(self.named), words * self.per), np.uint64)
        high = np.full_like(low, (1 << self.bits) - 1)
        for i, p in enumerate(self.named):
            low[i, : len(p)] = high[i, : len(p)] = [self.code[c] for c in p]
        return [(self._pack(low[:, k * self.per : (k + 1) * self.per]), self._pack(high[:, k * self.per : (k + 1) * self.per])) for k in range(words)]

    def _pack(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(columns), np.uint64)
        for k in range(columns.shape[1]):
            out = out << np.uint64(self.bits) | columns[:, k]
        return out

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and index of the piece of each occurrence in the concatenated text."""
        n, words = len(codes), len(self.piece_keys)
        padded = np.zeros(n + words * self.per, np.uint64)
        padded[:n] = codes
        keys = []
        for k in range(words):
            key = np.zeros(n, np.uint64)
            for j in range(k * self.per, (k + 1) * self.per):
                key = key << np.uint64(self.bits) | padded[j : j + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        lo, hi = np.zeros(len(self.named), np.int64), np.full(len(self.named), n, np.int64)
        todo = np.arange(len(self.named))
        for k, (least, most) in enumerate(self.piece_keys):
            held = keys[k][suffixes]
            if k == 0:
                lo, hi = np.searchsorted(held, least, "left"), np.searchsorted(held, most, "right")
            else:
                todo = todo[(self.sizes[todo] > k * self.per) & (hi[todo] > lo[todo])]
                lo[todo], hi[todo] = _bisect(held, lo[todo], hi[todo], least[todo], False), _bisect(held, lo[todo], hi[todo], most[todo], True)
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(self.named)), counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return suffixes[np.repeat(lo, counts) + within], which

    # relaxing

    def _merges(self, i: int) -> tuple[list, list, list] | None:
        """Ranks of the merges that make a piece, and its first and last part before each; None if they make another."""
        if i in self.merges:
            return self.merges[i]
        rank, parts = self.v.rank, list(self.v.pieces[i])
        ranks, first, last = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = min(((rank[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in rank), default=None)
            if found is None:
                break
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            ranks.append(found[0])
            first.append(parts[0])
            last.append(parts[-1])
        out = (ranks, first, last) if len(parts) == 1 else None
        self.merges[i] = out
        return out

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces gives these two pieces."""
        right = self._merges(b)
        if right is None:
            return False
        if a >= self.unknown:
            return True
        left = self._merges(a)
        rank, end = self.v.rank, (float("inf"), 0)
        i = j = 0
        while True:
            across = rank.get(left[2][i] + right[1][j])
            one = left[0][i] if i < len(left[0]) else end
            two = right[0][j] if j < len(right[0]) else end
            if across is not None and across < one and across <= two:
                return False
            if one == end and two == end:
                return True
            if one <= two:
                i += 1
            else:
                j += 1

    def _encode_new(self, stretches: list[str]) -> None:
        """Adds the encodings of stretches to the store, in their order."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer("\0".join([*stretches, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.code_points, points), len(self.code_points) - 1)
        known = self.code_points[at] == points
        codes = np.where(known, at + 1, self.other)
        codes[first + sizes] = 0
        start, which = self._edges(codes)
        strange = np.flatnonzero(codes == self.other)
        start = np.concatenate((start, strange))
        piece = np.concatenate((self.ids[which], np.full(len(strange), self.unknown)))
        stop = start + self.size_of[piece]
        home = np.repeat(first, sizes + 1)
        level = stop - home[start]
        order = np.argsort(level, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        bounds = np.searchsorted(level[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(len(codes) + 1, -1, np.int64)
        last[first] = self.start
        if len(self.follows) > PAIRS:
            self.follows.clear()
        follows, wide = self.follows, len(self.size_of)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            before = last[start[a:b]]
            open_ = np.flatnonzero(before >= 0) + a
            pairs, back = np.unique(last[start[open_]] * wide + piece[open_], return_inverse=True)
            good = np.zeros(len(pairs), bool)
            for k, pair in enumerate(pairs.tolist()):
                ok = follows.get(pair)
                if ok is None:
                    x, y = divmod(pair, wide)
                    ok = follows[pair] = y == self.unknown or self._can_follow(x, y)
                good[k] = ok
            taken = open_[good[back]]
            last[stop[taken]] = piece[taken]
        self._collect(stretches, first, sizes, last, points)

    def _collect(self, stretches, first, sizes, last, points) -> None:
        """Walks back from the ends of stretches and stores their pieces."""
        cursor, alive = first + sizes, np.flatnonzero(sizes)
        owners, found, places = [], [], []
        while len(alive):
            piece = last[cursor[alive]]
            if (piece < 0).any():
                raise AssertionError("a position without an encoding")
            cursor[alive] -= self.size_of[piece]
            owners.append(alive)
            found.append(piece)
            places.append(cursor[alive])
            alive = alive[cursor[alive] > first[alive]]
        if owners:
            owner, piece, place = map(np.concatenate, (owners, found, places))
        else:
            owner = piece = place = np.zeros(0, np.int64)
        order = np.lexsort((place, owner))
        owner, piece, place = owner[order], piece[order], place[order]
        strange = np.flatnonzero(piece == self.unknown)
        if len(strange):
            parts = [[self.v.byte_ids[x] for x in chr(p).encode("utf-8", "surrogatepass")] for p in points[place[strange]].tolist()]
            times = np.ones(len(piece), np.int64)
            times[strange] = [len(p) for p in parts]
            begin = np.cumsum(times) - times
            owner, wide = np.repeat(owner, times), np.repeat(piece, times)
            for k, ids in zip(begin[strange].tolist(), parts):
                wide[k : k + len(ids)] = ids
            piece = wide
        counts = np.bincount(owner, minlength=len(stretches)).astype(np.int64)
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        self.flat = np.concatenate((self.flat, piece.astype(np.int32)))

    # texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin and end."""
        if len(self.index) > KEPT:
            self._forget()
        begun, index = len(self.index), self.index
        rows: list[list[int]] = []
        for text in texts:
            row: list[int] = []
            for k, stretch in enumerate(self._stretches(text)):
                at = index.get(stretch)
                if at is None:
                    at = index[stretch] = len(index)
                row.append(at)
            rows.append(row)
        fresh = list(islice(index, begun, None))
        sizes = np.cumsum([len(s) for s in fresh])
        begin = 0
        while begin < len(fresh):  # bounded, so that edges take little memory; a longer stretch comes alone
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + BATCH, "right")))
            self._encode_new(fresh[begin:end])
            begin = end
        used = np.fromiter((x for row in rows for x in row), np.int64)
        counts = self.offsets[used + 1] - self.offsets[used]
        ends = np.cumsum(counts)
        take = np.repeat(self.offsets[used] - (ends - counts), counts) + np.arange(int(counts.sum()))
        stops = np.concatenate(([0], ends))[np.cumsum([0] + [len(r) for r in rows])]
        return self.flat[take], stops

    def _stretches(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.v.prefix:
            marked = MARK + marked
        if not self.isolated:
            return _RUNS.findall(marked)
        out: list[str] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                out.append("\n")
            out += _RUNS.findall(line)
        return out


def _bisect(held: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value in its own range of a sorted array."""
    lo, hi = lo.copy(), hi.copy()
    while len(todo := np.flatnonzero(lo < hi)):
        mid = (lo[todo] + hi[todo]) // 2
        up = held[mid] <= value[todo] if right else held[mid] < value[todo]
        lo[todo] = np.where(up, mid + 1, lo[todo])
        hi[todo] = np.where(up, hi[todo], mid)
    return lo


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col`` and ``keep`` with ``ids`` (array of int), ``n_tokens`` and ``round_trip``.

    ``round_trip`` says that decoding the ids gives the text back, word marks
    in it read as spaces. One row for each input row, repeated rows included;
    null and empty texts have no ids and round-trip. The model is read on the
    driver (``model_path`` need not exist elsewhere) and its vocabulary, whose
    size does not depend on the data, travels with the tasks. An empty table
    gives an empty result.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    Vocabulary(model)  # a wrong model fails here
    columns = [id_col, *keep]
    names = [f"k{i}" for i in range(len(columns))]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what earlier tasks of this worker left in cycles
        encoder = Encoder(Vocabulary(shared.value))
        decode = encoder.v.decode
        for batch in slices(batches, "text", 8 << 20):
            texts = batch.column("text").to_pylist()
            ids, stops = encoder.encode(texts)
            same = [decode(ids[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(texts, stops[:-1], stops[1:])]
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), lists, pa.array(np.diff(stops), pa.int64()), pa.array(same, pa.bool_())],
                [*names, "ids", "n_tokens", "round_trip"],
            )

    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, columns)) + ", ids array<int>, n_tokens long, round_trip boolean"
    source = docs.select(*[F.col(c).alias(n) for n, c in zip(names, columns)], text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "ids", "n_tokens", "round_trip")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of encoded documents; null ids give an empty text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Vocabulary(shared.value).decode
        for batch in batches:
            texts = [decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
