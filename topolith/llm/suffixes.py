"""Exact substring deduplication over sparse, deep-shallow sorted suffixes.

Every ``length``-byte window of a text that also starts in a document of a
smaller id is removed. Windows are too many to sort, so each is assigned to an
anchor inside it: the leftmost of its 16-byte strings with the least hash.
Equal windows have equal anchors at equal places, and an anchor stands for 18
windows on average.

1. Anchors are hashed and meet in buckets; those whose 16 bytes occur in one
   document only are dropped. Each task keeps one occurrence of what it has
   seen in several documents and settles the others itself, so that a bucket
   gets a string once a task at most, however frequent it is.
2. Around anchors that are left, the bytes of their windows are sent to
   buckets by anchor; again a task settles equal surroundings itself.
3. A bucket sorts the suffixes that begin at its anchors, and the reversed
   texts before them: by multikey quicksort (three-way partitions whose
   characters are words of eight bytes) down to a shallow depth, and each
   remaining group with a longer common prefix by a blind trie, which branches
   at first differing bytes only. From common-prefix lengths follow the classes of equal windows
   for each place of the anchor in the window; windows of a class go but for
   those of its least document.

Exact copies of whole texts are settled first by hash.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import stored
from .common import slices, text_or_empty, to_bytes

#: Bytes of a window, and of the strings that anchors are chosen from.
LENGTH, SEED = 50, 16
#: Text bytes in a group of documents and for a bucket of anchors, about; both grow in number with the input.
GROUP, BUCKET = 4 << 20, 16 << 20
#: Text bytes whose anchors a task gathers before it sends them on.
GATHER = 16 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LAST = np.iinfo(np.int64).max
# fixed values: the primes of XXH64
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
#: Parts that rows of one text are dealt to where they meet its hash.
SALTS = 16


# anchors


def _hashes(buffer: bytes) -> np.ndarray:
    n = len(buffer) - SEED + 1
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    with np.errstate(over="ignore"):
        h = words[:n] * _A
        h ^= h >> np.uint64(32)
        h ^= words[8 : 8 + n] * _B
        h *= _C
        h ^= h >> np.uint64(29)
        h *= _A
    return h


class Anchors:
    """Anchors of texts: text, place, hash, and first and last window of each."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        parts = []
        for group in _chunks(texts, length):
            parts.append(self._of(group, length))
        none = np.zeros(0, np.int64)
        cat = lambda i, kind=np.int64: np.concatenate([p[i] for p in parts]) if parts else none.astype(kind)
        self.text, self.place, self.first, self.last = (cat(i) for i in range(4))
        self.hash = cat(4, np.uint64)

    def _of(self, group: list[tuple[int, int, bytes]], length: int):
        buffer = b"".join(t for _, _, t in group)
        sizes = np.array([len(t) for _, _, t in group])
        starts = np.cumsum(sizes) - sizes
        h = _hashes(buffer)
        span = length - SEED + 1
        low = np.uint64((1 << 24) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < span:
            m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
        owner = (m & low).astype(np.int64)
        row = np.repeat(np.arange(len(group)), sizes)[: len(owner)]
        window = np.flatnonzero(np.arange(len(owner)) + length <= (starts + sizes)[row])
        owner, row = owner[window], row[window]
        head = np.ones(len(window), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(head)
        row = row[at]
        shift = np.array([begin for _, begin, _ in group], np.int64) - starts
        first = window[at] + shift[row]
        last = window[np.append(at[1:], len(window)) - 1] + shift[row] if len(at) else first
        text = np.array([i for i, _, _ in group], np.int64)[row]
        h = h[owner[at]]  # least hashes crowd at the low end; mixed again, they spread evenly over buckets
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31))) * _B
            h = (h ^ (h >> np.uint64(29))) * _C
        return text, owner[at] + shift[row], first, last, h


def _chunks(texts: list[bytes], length: int, limit: int = 1 << 20) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts with their places, in groups of bounded size; long texts in overlapping pieces."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - length + 1), limit):
            piece = t[begin : begin + limit + length - 1]
            if len(piece) < length:
                continue
            if group and held + len(piece) > limit:
                yield group
                group, held = [], 0
            group.append((i, begin, piece))
            held += len(piece)
    if group:
        yield group


# deep-shallow sorting


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by branching on first differing bytes alone.

    An inner node is a list [depth, children by byte]; a leaf is a string's
    number. The end of a string counts as a byte before all others.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for k in range(1, len(strings)):
            self._insert(k)

    def _at(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def _insert(self, k: int) -> None:
        node = self.root
        while isinstance(node, list):  # blindly: only branching bytes are looked at
            kids = node[1]
            byte = self._at(k, node[0])
            node = kids[byte] if byte in kids else next(iter(kids.values()))
        common = _common(self.strings[k], self.strings[node])
        parent, edge, below = None, 0, self.root
        while isinstance(below, list) and below[0] < common:
            parent, edge = below, self._at(k, below[0])
            below = below[1][edge]
        if isinstance(below, list) and below[0] == common:
            below[1][self._at(k, common)] = k
            return
        split = [common, {self._at(node, common): below, self._at(k, common): k}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def order(self) -> tuple[list[int], list[int]]:
        """Strings in order, and of each the length that it shares with the one before."""
        out, shared = [], []
        stack: list[tuple[list | int, int]] = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, list):
                kids = [node[1][c] for c in sorted(node[1])]
                stack.extend((kid, node[0]) for kid in reversed(kids[1:]))
                stack.append((kids[0], depth))
            else:
                out.append(node)
                shared.append(depth)
        return out, shared


def multikey_quicksort(characters: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of characters, each wide as a machine word; equal rows stay in order.

    A group of rows is parted by a pivot's character at the group's depth into
    rows below, at and above it; the rows at it go on one character deeper. All
    groups that are not done take their step side by side.
    """
    n, depths = characters.shape
    flat = np.ascontiguousarray(characters.T)
    order = np.arange(n)
    begin, size, depth = np.array([0]), np.array([n]), np.array([0])
    turn = 0
    while True:
        open_ = (size > 1) & (depth < depths)
        begin, size, depth = begin[open_], size[open_], depth[open_]
        if not len(begin):
            return order
        groups = np.repeat(np.arange(len(begin)), size)
        base = np.cumsum(size) - size
        at = np.arange(len(groups)) - base[groups] + begin[groups]
        rows = order[at]
        key = flat[depth[groups], rows]
        # the median of three, at places that differ from step to step
        turn += 1
        picks = np.sort(np.stack([key[base + (turn * odd) % size] for odd in (7919, 104729, 1299709)]), axis=0)[1]
        pivot = picks[groups]
        part = (key >= pivot).astype(np.int64) + (key > pivot)
        counts = np.bincount(groups * 3 + part, minlength=3 * len(begin)).reshape(-1, 3)
        inner = np.cumsum(counts, axis=1) - counts
        target = np.empty(len(at), np.int64)
        for k in range(3):
            mine = np.flatnonzero(part == k)
            before = np.cumsum(counts[:, k]) - counts[:, k]
            g = groups[mine]
            target[mine] = begin[g] + inner[g, k] + np.arange(len(mine)) - before[g]
        order[target] = rows
        begin = (begin[:, None] + inner).ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        size = counts.ravel()


def sort_suffixes(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings given by place and size in a buffer, and common-prefix lengths.

    ``common[i]`` is what the i-th string in order shares with the one before
    (-1 for the first).
    """
    n, shallow = len(begin), 2 * 8
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = begin[:, None] + np.arange(shallow)
    inside = np.arange(shallow) < size[:, None]
    heads = np.where(inside, buffer[np.minimum(at, len(buffer) - 1)], 0).astype(np.uint8)
    words = np.ascontiguousarray(heads).view(">u8").astype(np.uint64)
    held = np.minimum(size, shallow)
    # the length is the last character: a string's end comes before all bytes
    order = multikey_quicksort(np.column_stack((words, held.astype(np.uint64))))
    w, s = words[order], held[order]
    common = np.full(n, -1, np.int64)
    differ = w[1:] ^ w[:-1]
    in_first = _leading(differ[:, 0])
    shared = np.where(differ[:, 0] != 0, in_first, 8 + np.where(differ[:, 1] != 0, _leading(differ[:, 1]), 8))
    common[1:] = np.minimum(shared, np.minimum(s[1:], s[:-1]))
    # groups that agree to the shallow depth
    deep = (common >= shallow) & (s >= shallow)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    text = buffer.tobytes()
    for a, b in zip((edge[::2] - 1).tolist(), edge[1::2].tolist()):
        rows = order[a:b].tolist()
        seen: dict[bytes, list[int]] = {}
        for r in rows:
            x = int(begin[r])
            seen.setdefault(text[x + shallow : x + int(size[r])], []).append(r)
        strings = list(seen)
        if len(strings) == 1:
            common[a + 1 : b] = shallow + len(strings[0])
            continue
        ranked, depths = BlindTrie(strings).order()
        k = a
        for j, depth in zip(ranked, depths):
            mine = seen[strings[j]]
            order[k : k + len(mine)] = mine
            if k > a:
                common[k] = shallow + depth
            common[k + 1 : k + len(mine)] = shallow + len(strings[j])
            k += len(mine)
    return order, common


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the front of big-endian words."""
    out = np.full(len(x), 8, np.int64)
    for k in range(7, -1, -1):
        out[(x >> np.uint64(8 * (7 - k))) & np.uint64(255) != 0] = k
    return out


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each string; equal where the first ``depth`` bytes are."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows also occur with a smaller owner.

    Row i has the bytes from ``begin[i]`` on, with its anchor at ``offset[i]``
    in them. Result: a matrix with, in column l, the window that begins l
    bytes before the anchor; false where the bytes don't hold it whole.
    """
    n, most = len(begin), length - SEED + 1
    out = np.zeros((n, most), bool)
    if not n:
        return out
    right = sort_suffixes(buffer, begin + offset, size - offset)
    # the texts before anchors, read backwards, lie in the reversed buffer
    left = sort_suffixes(np.ascontiguousarray(buffer[::-1]), len(buffer) - (begin + offset), offset)
    rank = np.unique(owner, return_inverse=True)[1]
    for l in range(most):
        mine = np.flatnonzero((offset >= l) & (size - offset >= length - l))
        if len(mine) < 2:
            continue
        cls = _classes(*right, length - l)[mine] * (n + 1) + _classes(*left, l)[mine]
        order = np.lexsort((rank[mine], cls))
        c, r = cls[order], rank[mine][order]
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        least = r[np.flatnonzero(head)][np.cumsum(head) - 1]
        out[mine[order[r > least]], l] = True
    return out


# the distributed steps

_BLOBS = "key int, ord long, tag long, docs binary, a binary, b binary, c binary, d binary"
_NAMES = ["key", "ord", "tag", "docs", "a", "b", "c", "d"]
_MARK = np.uint32(0xFFFFFFFF)


class Documents:
    """Order and text hash of documents; rows elsewhere point at them by number.

    The hash tells rows of one id with different texts apart.
    """

    def __init__(self, ord_: np.ndarray, tag: np.ndarray):
        self.ord, self.tag = ord_, tag

    def pack(self, rows: np.ndarray) -> tuple[bytes, bytes]:
        """The documents that rows point at, orders as differences, and the rows among them."""
        known, rows = np.unique(rows, return_inverse=True)
        with np.errstate(over="ignore"):
            steps = np.diff(self.ord[known].view(np.uint64), prepend=np.uint64(0))
        narrow = np.uint16 if len(known) <= 1 << 16 else np.uint32
        return steps.tobytes() + self.tag[known].astype(np.uint32).tobytes(), rows.astype(narrow).tobytes()

    @staticmethod
    def unpack(table: list[dict]) -> tuple[Documents, np.ndarray]:
        """All documents of packed rows, and all rows' numbers among them."""
        ords, tags, rows, base = [], [], [], 0
        for r in table:
            n = len(r["docs"]) // 12
            with np.errstate(over="ignore"):
                ords.append(np.cumsum(np.frombuffer(r["docs"], np.uint64, n), dtype=np.uint64).view(np.int64))
            tags.append(np.frombuffer(r["docs"], np.uint32, n, 8 * n).astype(np.int64))
            rows.append(np.frombuffer(r["a"], np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64) + base)
            base += n
        return Documents(np.concatenate(ords), np.concatenate(tags)), np.concatenate(rows)

    def by_group(self, groups: int, rows: np.ndarray, *arrays: np.ndarray, shift: int = 0) -> list[tuple]:
        """Packed rows with up to three arrays, one for each group of documents."""
        out = []
        group = group_of(self.ord, self.tag, groups)[rows]
        order = np.lexsort((arrays[0], rows, group))
        group, rows, arrays = group[order], rows[order], [x[order] for x in arrays]
        for a, b in _stretches(group):
            blobs = [x[a:b].tobytes() for x in arrays] + [None] * (3 - len(arrays))
            out.append((int(group[a]) + shift, None, None, *self.pack(rows[a:b]), *blobs))
        return out


def group_of(ord_: np.ndarray, tag: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that each belongs to, as ``group_column`` has it; follows from id and text, so ids may share any factor."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in _PRIMES)
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        x = ord_.astype(np.int64).view(np.uint64) ^ (tag.astype(np.uint64) << np.uint64(31))
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(x * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), groups)


def group_column(groups: int, ord_: str = "ord", tag: str = "tag") -> Column:
    mixed = F.col(ord_).bitwiseXOR(F.shiftleft(F.col(tag), 31))
    return F.pmod(F.xxhash64(mixed), F.lit(groups)).cast("int")


def tag_column(text: str = "text") -> Column:
    """The low 32 bits of a text's hash."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def tags(texts: list[bytes]) -> np.ndarray:
    """The low 32 bits of what SQL's xxhash64 gives for texts."""
    return np.array([xxhash.xxh64_intdigest(t, 42) & 0xFFFFFFFF for t in texts], np.int64)


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of runs of equal values."""
    edge = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return list(zip([0, *edge], [*edge, len(x)])) if len(x) else []


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _passed_on(table: pa.Table, by: int) -> pa.Table:
    key = pa.array(table["key"].to_numpy() - by, pa.int32())
    return pa.Table.from_arrays([key, *(table[n].combine_chunks() for n in _NAMES[1:])], _NAMES)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _heads(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted values: which differ from the one before, where groups begin, each one's group."""
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    return head, np.flatnonzero(head), np.cumsum(head) - 1


def _gather(length: int, buckets: int, groups: int):
    """Step 1, in tasks: anchors to buckets; those seen in several documents to the documents' groups."""

    def send(parts: list[tuple]) -> pa.RecordBatch:
        h, rows, place, ords, marks = [], [], [], [], []
        base = 0
        for found_h, found_text, found_place, o, t in parts:
            h.append(found_h)
            rows.append(found_text + base)
            place.append(found_place)
            ords.append(o)
            marks.append(t)
            base += len(o)
        h, rows, place = map(np.concatenate, (h, rows, place))
        if not len(h):
            return _rows([])
        docs = Documents(np.concatenate(ords), np.concatenate(marks))
        order = np.argsort(h, kind="stable")
        h, rows, place = h[order], rows[order], place[order]
        head, first, group = _heads(h)
        owner = docs.ord[rows]
        known = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first))[group]
        out = docs.by_group(groups, rows[known], place[known], shift=buckets)
        go = ~known | head  # of a string known to be repeated, one mark
        h, rows, place = h[go], rows[go], np.where(known[go], _MARK, place[go])
        for x, y in _stretches(bucket := _bucket_of(h, buckets)):
            short = h[x:y] >> np.uint64(16)
            blobs = place[x:y], (short >> np.uint64(32)).astype(np.uint16), (short & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((int(bucket[x]), None, None, *docs.pack(rows[x:y]), *(b.tobytes() for b in blobs)))
        return _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        parts: list[tuple] = []
        held = 0
        for batch in slices(batches, "text", 4 << 20):
            texts = to_bytes(batch.column("text"))
            found = Anchors(texts, length)
            parts.append((found.hash, found.text.astype(np.int32), found.place.astype(np.uint32), batch.column("ord").to_numpy(), tags(texts)))
            del found
            held += sum(map(len, texts))
            if held >= GATHER:
                yield send(parts)
                parts, held = [], 0
        if parts:
            yield send(parts)

    return run


def _repeated(buckets: int, groups: int):
    """Step 1, in buckets: places of anchors whose string occurs in several documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:  # settled by a task already
            return _passed_on(table, buckets)
        packed = table.to_pylist()
        docs, rows = Documents.unpack(packed)
        place = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in packed])
        h = np.concatenate([np.frombuffer(r["c"], np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["d"], np.uint32) for r in packed])
        order = np.argsort(h, kind="stable")
        h, rows, place = h[order], rows[order], place[order]
        _, first, group = _heads(h)
        mark, owner = place == _MARK, docs.ord[rows]
        known = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | np.logical_or.reduceat(mark, first)
        go = known[group] & ~mark
        return _table(docs.by_group(groups, rows[go], place[go]))

    return run


def _by_document(table: pa.Table, *blobs: str) -> tuple[set, dict]:
    """Copies, named alone; and for the other documents what packed rows say of them."""
    rows = table.to_pylist()
    copies = {(r["ord"], r["tag"]) for r in rows if r["docs"] is None}
    packed = [r for r in rows if r["docs"] is not None]
    if not packed:
        return copies, {}
    docs, at = Documents.unpack(packed)
    values = [np.concatenate([np.frombuffer(r[b], np.uint32) for r in packed]) for b in blobs]
    order = np.lexsort((docs.tag[at], docs.ord[at]))
    at, values = at[order], [v[order] for v in values]
    ords, marks = docs.ord[at], docs.tag[at]
    edge = (np.flatnonzero((ords[1:] != ords[:-1]) | (marks[1:] != marks[:-1])) + 1).tolist()
    return copies, {(int(ords[a]), int(marks[a])): [v[a:b] for v in values] for a, b in zip([0, *edge], [*edge, len(at)])}


def _surroundings(length: int, buckets: int, groups: int):
    """Step 2: the bytes of the windows of repeated anchors, to buckets by anchor."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        copies, places = _by_document(right, "b")
        texts = to_bytes(left["text"].combine_chunks())
        names = list(zip(left["ord"].to_pylist(), tags(texts).tolist()))
        chosen = {name: k for k, name in enumerate(names) if name in places and name not in copies}  # equal rows once
        if not chosen:
            return _table([])
        names = sorted(chosen)
        texts = [texts[chosen[name]] for name in names]
        docs = Documents(*(np.array(x, np.int64) for x in zip(*names)))
        found = Anchors(texts, length)
        edge = np.searchsorted(found.text, np.arange(len(texts) + 1))
        at = np.flatnonzero(np.concatenate([np.isin(found.place[a:b], places[name][0]) for a, b, name in zip(edge, edge[1:], names)]))
        text, place, first, last, h = (x[at] for x in (found.text, found.place, found.first, found.last, found.hash))
        seen: dict[tuple[bytes, int], int] = {}
        around, settled = [], np.zeros(len(at), bool)
        for k, (t, p, f, l) in enumerate(zip(*(x.tolist() for x in (text, place, first, last)))):
            bytes_ = texts[t][f : l + length]
            around.append(bytes_)
            settled[k] = seen.setdefault((bytes_, p - f), names[t][0]) != names[t][0]  # texts come by id
        out, press = [], zstandard.ZstdCompressor(level=1).compress
        if settled.any():
            out = docs.by_group(groups, text[settled], first[settled].astype(np.uint32), (last[settled] + length).astype(np.uint32), shift=buckets)
        go = np.flatnonzero(~settled)
        bucket = _bucket_of(h[go], buckets)
        order = np.argsort(bucket, kind="stable")
        go, bucket = go[order], bucket[order]
        for x, y in _stretches(bucket):
            mine = go[x:y]
            small = np.concatenate((place[mine] - first[mine], last[mine] - first[mine])).astype(np.uint8)
            out.append((int(bucket[x]), None, None, *docs.pack(text[mine]), first[mine].astype(np.uint32).tobytes(), small.tobytes(), press(b"".join(around[k] for k in mine.tolist()))))
        return _table(out)

    return run


def _removals(length: int, buckets: int, groups: int):
    """Step 3: stretches of bytes to remove, for the groups of their documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return _passed_on(table, buckets)
        packed = table.to_pylist()
        docs, rows = Documents.unpack(packed)
        first = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in packed]).astype(np.int64)
        small = [np.frombuffer(r["c"], np.uint8).astype(np.int64) for r in packed]
        offset = np.concatenate([x[: len(x) // 2] for x in small])
        size = np.concatenate([x[len(x) // 2 :] for x in small]) + length
        buffer = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["d"]) for r in packed), np.uint8)
        gone = repeated_windows(buffer, np.cumsum(size) - size, size, offset, docs.ord[rows], length)
        # windows one after the other make one stretch; column l begins l bytes before the anchor
        steps = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(steps == 1)
        _, high = np.nonzero(steps == -1)
        anchor = (first + offset)[row]
        begin, end = anchor - (high - 1), anchor - low + length
        return _table(docs.by_group(groups, rows[row], begin.astype(np.uint32), end.astype(np.uint32)))

    return run


_OUT = {
    "n_bytes": ("long", pa.int64()),
    "n_removed": ("long", pa.int64()),
    "n_spans": ("long", pa.int64()),
    "kept_sha256": ("string", pa.string()),
    "kept_text": ("string", pa.string()),
    "spans": ("array<struct<begin:long,end:long>>", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
}


def _cut(text: bytes, begin: list[int], end: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes left, and the maximal stretches removed."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin, end)):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), merged


def _finish(length: int, outputs: tuple[str, ...]):
    make = {
        "n_bytes": lambda text, kept, gone: len(text),
        "n_removed": lambda text, kept, gone: len(text) - len(kept),
        "n_spans": lambda text, kept, gone: len(gone),
        "kept_sha256": lambda text, kept, gone: hashlib.sha256(kept).hexdigest(),
        "kept_text": lambda text, kept, gone: kept.decode("utf-8", "replace"),
        "spans": lambda text, kept, gone: [{"begin": a, "end": b} for a, b in gone],
    }
    kinds = [_OUT[n][1] for n in outputs]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        copies, stretches = _by_document(right, "b", "c")
        texts = to_bytes(left["text"].combine_chunks())
        columns: list[list] = [[] for _ in outputs]
        for o, tag, text in zip(left["ord"].to_pylist(), tags(texts).tolist(), texts):
            if (o, tag) in copies and len(text) >= length:
                kept, gone = b"", [(0, len(text))]
            else:
                kept, gone = _cut(text, *(x.tolist() for x in stretches.get((o, tag), (np.zeros(0), np.zeros(0)))))
            for column, n in zip(columns, outputs):
                column.append(make[n](text, kept, gone))
        return pa.Table.from_arrays([left["id"].combine_chunks(), *map(pa.array, columns, kinds)], ["id", *outputs])

    return run


def remove_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"),
) -> DataFrame:
    """What is left of each text without bytes that repeat a smaller document's.

    Outputs to choose from: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256``, ``kept_text`` (bytes left that are no
    UTF-8 any more become replacement characters) and ``spans``.

    One row for each input row. Null texts count as empty. Rows of one id
    don't remove each other's bytes; rows without an id (null) come after all
    others. Repeated rows get equal results; of equal texts that of the least id keeps all. Texts shorter than
    ``length`` bytes keep all; longer ones are read whole. ``length`` must lie
    between 17 and 271. Ids must be whole numbers. An empty table gives an
    empty result; other columns are left out, whatever their names.
    """
    if not SEED < length <= 255 + SEED:
        raise ValueError(f"length must be above {SEED} and at most {255 + SEED}")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), text_or_empty(text_col).alias("text"))
    salt = F.pmod(F.xxhash64("ord"), F.lit(SALTS)).alias("salt")
    hashed = base.select("ord", tag_column().alias("tag"), F.unhex(F.sha2("text", 256)).alias("h"), salt)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = (max(1, -(-total // size)) for size in (GROUP, BUCKET))

    key = group_column(groups).alias("key")
    blank = [F.lit(None).cast("binary").alias(n) for n in _NAMES[3:]]
    several = hashed.groupBy("h").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least <> most")
    # a text may have very many copies: they meet the least one's id in several parts
    several = several.select("h", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    copies = stored(hashed.join(several, ["h", "salt"]).where("ord > least").select(key, "ord", "tag", *blank).distinct())

    # one exchange of the texts serves both steps that need them: the plans of its two uses are equal
    keyed = base.withColumn("tag", tag_column()).select("id", "ord", "text", key)
    long_enough = base.where(F.octet_length("text") >= length)
    places = long_enough.select("ord", "text").mapInArrow(_gather(length, buckets, groups), _BLOBS).groupBy("key").applyInArrow(_repeated(buckets, groups), _BLOBS)
    around = keyed.groupBy("key").cogroup(places.unionByName(copies).groupBy("key")).applyInArrow(_surroundings(length, buckets, groups), _BLOBS)
    stretches = around.groupBy("key").applyInArrow(_removals(length, buckets, groups), _BLOBS)
    schema = f"id {kind}, " + ", ".join(f"{n} {_OUT[n][0]}" for n in outputs)
    return (
        keyed.groupBy("key")
        .cogroup(stretches.unionByName(copies).groupBy("key"))
        .applyInArrow(_finish(length, outputs), schema)
        .withColumnRenamed("id", id_col)
    )
