"""Benchmark passages in documents, by q-gram filtering and banded alignment.

Texts are lower-cased, and runs of ASCII characters other than letters and
digits count as one space. A leak is a stretch of ``window`` bytes of an item
(the whole item if shorter) that a document repeats with ``rate`` edits a byte
at most. Items shorter than a q-gram leak where a document has them as whole words.

By the q-gram lemma a stretch of w bytes with e edits shares at least
w + 1 - q - e * q of its q-grams with its copy, all within e diagonals. Shared
q-grams are found by looking up every q-gram of a document, counted in
overlapping bands of diagonals, and regions below the bound are passed over;
the others are aligned within their band, which settles them. Of a long item
only the part around the shared q-grams is aligned, a bounded number of windows at a time.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..operators.materialize import Stored
from .common import slices, text_or_empty

Q = 8
_FOLD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_WORDS = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FACTOR, _BITS = np.uint64(0x9E3779B97F4A7C15), 22
#: Cells of bytes that are scored at a time, bytes of an item's part above which it isn't scored but aligned at once, and windows aligned at a time.
CELLS, UNSCORED, WINDOWS = 1 << 20, 4096, 512

#: Bytes of items that are indexed and sent to executors at a time.
BLOCK = 16 << 20


@dataclass(frozen=True)
class Rule:
    """What counts as a leak: so many bytes in a row, so many edits a byte."""

    window: int = 96
    rate: float = 1 / 12


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


class Index:
    """The q-grams of benchmark items, and whole words of items of fewer than ``Q`` normal bytes."""

    def __init__(self, items: list[tuple[object, str]], rule: Rule = Rule()):
        self.ids = [i for i, _ in items]
        self.texts = [normal(t or "") for _, t in items]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.window = np.minimum(sizes, rule.window)
        self.edits = np.maximum(0, np.minimum((self.window * rule.rate).astype(np.int64), (self.window - Q) // Q))
        self.least = np.maximum(1, self.window + 1 - Q - self.edits * Q)
        self.reach = self.window + self.edits - Q  # from the first to the last of these q-grams
        self.step = int(self.edits.max(initial=0)) + 1
        grams, item, at = [], [], []
        for k, t in enumerate(self.texts):
            if len(t) >= Q:
                g = _grams(t)
                grams.append(g)
                item.append(np.full(len(g), k, np.int64))
                at.append(np.arange(len(g)))
        none = np.zeros(0, np.int64)
        grams = np.concatenate(grams) if grams else none.astype(np.uint64)
        order = np.argsort(grams, kind="stable")
        self.item = (np.concatenate(item) if item else none)[order]
        self.at = (np.concatenate(at) if at else none)[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by the number of words
        for k, t in enumerate(self.texts):
            if 0 < len(t) < Q:
                self.short.setdefault(t.count(b" ") + 1, {}).setdefault(t, []).append(k)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[_slot(self.grams)] = True

    def _dense(self, group: np.ndarray, place: np.ndarray, least: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which of the hits, sorted by group and place, lie in a stretch with enough hits."""
        n = len(place)
        end = np.arange(n) + least - 1
        inside = end < n
        end = np.minimum(end, n - 1)
        good = inside & (group[end] == group) & (place[end] - place <= reach)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, np.flatnonzero(good), 1)
        np.add.at(marks, end[good] + 1, -1)
        return np.cumsum(marks[:-1]) > 0

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normal text: item's place, edits of the best window, and where the copy begins and ends."""
        out = [self._words(t) for t in texts] if self.short else [[] for _ in texts]
        if not len(self.grams):
            return out
        gap = b"\n" * Q
        line = gap.join([*texts, b""])
        if len(line) < Q:
            return out
        begins = np.cumsum([0] + [len(t) + Q for t in texts])
        grams = _grams(line)
        hit = np.flatnonzero(self.table[_slot(grams)])
        g = grams[hit]
        k = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        same = self.grams[k] == g
        hit, k = hit[same], k[same]
        doc = np.searchsorted(begins, hit, "right") - 1
        least, reach = int(self.least[self.texts_with_grams].min()), int(self.reach.max())
        dense = self._dense(doc, hit, np.int64(least), np.int64(reach))
        hit, k, doc = hit[dense], k[dense], doc[dense]
        if not len(hit):
            return out
        times = self.count[k]
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[k], times) + within
        hit, doc, item = np.repeat(hit, times), np.repeat(doc, times), self.item[entry]
        band = (hit - self.at[entry]) // self.step
        # a band is two steps wide and begins at every step, so each hit is in two
        hit, doc, item = np.concatenate((hit, hit)), np.concatenate((doc, doc)), np.concatenate((item, item))
        band = np.concatenate((band, band - 1))
        order = np.lexsort((hit, band, item, doc))
        hit, doc, item, band = hit[order], doc[order], item[order], band[order]
        new = np.ones(len(hit), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        group = np.cumsum(new)
        keep = np.flatnonzero(self._dense(group, hit, self.least[item], self.reach[item]))
        if not len(keep):
            return out
        # stretches: the dense hits of a band, apart where they lie far from each other
        cut = np.flatnonzero((group[keep][1:] != group[keep][:-1]) | (hit[keep][1:] - hit[keep][:-1] > self.reach[item[keep][1:]])) + 1
        head, tail = keep[np.concatenate(([0], cut))], keep[np.concatenate((cut, [len(keep)])) - 1]
        mine = item[head]
        low = band[head] * self.step - self.edits[mine]
        # the part of the item whose windows can hold these hits
        sizes = np.array([len(t) for t in self.texts], np.int64)[mine]
        begin = np.maximum(0, hit[head] - (band[head] + 2) * self.step - self.reach[mine] - self.step)
        stop = np.minimum(sizes, hit[tail] - band[head] * self.step + Q + self.reach[mine] + self.step)
        whole = sizes <= 4 * self.window[mine]
        begin, stop = np.where(whole, 0, begin), np.where(whole, sizes, np.maximum(stop, begin + self.window[mine]))
        begin = np.minimum(begin, np.maximum(0, stop - self.window[mine]))
        fit = self._scores(line, mine, low, begin, stop) >= self.window[mine] - 4 * self.edits[mine]
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for h, t, b, x, y in zip(*(v[fit].tolist() for v in (head, tail, low, begin, stop))):
            d, i = int(doc[h]), int(item[h])
            lo, hi = int(hit[h] - begins[d]), int(hit[t] - begins[d])
            if any(x <= lo and hi <= y for x, y in done.get((d, i), ())):
                continue
            found = self._verify(texts[d], i, b - int(begins[d]), x, y)
            if found:
                done.setdefault((d, i), []).append(found[1:])
                out[d].append((i, *found))
        return out

    def _words(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """Short items that stand in a normal text as whole words, at their first places."""
        out: list[tuple[int, int, int, int]] = []
        starts = [0, *(k + 1 for k, c in enumerate(text) if c == 32)] if text else []
        for n, known in self.short.items():
            seen: dict[bytes, int] = {}
            for k in range(len(starts) - n + 1):
                end = starts[k + n] - 1 if k + n < len(starts) else len(text)
                if end - starts[k] < Q:
                    seen.setdefault(text[starts[k] : end], starts[k])
            for piece, at in seen.items():
                out += [(i, 0, at, at + len(piece)) for i in known.get(piece, ())]
        return out

    @property
    def texts_with_grams(self) -> np.ndarray:
        return np.flatnonzero(np.array([len(t) >= Q for t in self.texts]))

    @property
    def width(self) -> int:
        """Diagonals of an alignment less one: a band's, and the greatest number of edits on both sides."""
        return 4 * self.step

    def _scores(self, line: bytes, item: np.ndarray, low: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The best local scores of many parts of items, each on its band of diagonals, row by row side by side.

        Very long parts get the highest score: they are aligned in any case.
        """
        out = np.full(len(item), np.iinfo(np.int32).max, np.int32)
        a = np.frombuffer(line, np.uint8)
        ramp = 3 * np.arange(self.width + 1, dtype=np.int32)
        size = stop - begin
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= UNSCORED]
        k = 0
        while k < len(order):
            # as many as fit, of like lengths
            n = 1
            while k + n < len(order) and (n + 1) * (size[order[k + n]] + self.width + 1) <= CELLS and n < 512:
                n += 1
            mine, k = order[k : k + n], k + n
            rows = [self.texts[i][x:y] for i, x, y in zip(item[mine].tolist(), begin[mine].tolist(), stop[mine].tolist())]
            m = max(map(len, rows))
            letters = np.frombuffer(b"".join(t.ljust(m, b"\xfe") for t in rows), np.uint8).reshape(len(rows), m)
            src = (low + begin)[mine][:, None] + np.arange(m + self.width + 1)
            text = np.where((src >= 0) & (src < len(a)), a[np.clip(src, 0, len(a) - 1)], 255)
            last = np.zeros((len(rows), self.width + 1), np.int32)
            best = np.zeros(len(rows), np.int32)
            for r in range(m):
                row = last + np.where(text[:, r : r + self.width + 1] == letters[:, r : r + 1], 1, -3).astype(np.int32)
                row[:, :-1] = np.maximum(row[:, :-1], last[:, 1:] - 3)
                np.maximum(row, 0, out=row)
                last = np.maximum.accumulate(row + ramp, axis=1) - ramp
                np.maximum(best, last.max(axis=1), out=best)
            out[mine] = best
        return out

    def _verify(self, text: bytes, i: int, low: int, begin: int, stop: int) -> tuple[int, int, int] | None:
        """Fewest edits of a window of a part of an item on diagonals from ``low`` on, and where all good windows lie."""
        item, low = self.texts[i][begin:stop], low + begin
        at = text.find(item, max(0, low), max(0, low + self.width + len(item)))
        if at >= 0:  # the alignment without edits
            return 0, at, at + len(item)
        w, slack = int(self.window[i]), int(self.edits[i])
        found: list[tuple[int, int, int]] = []
        for k in range(0, len(item) - w + 1, WINDOWS):
            edits, first, last = _align(item[k : k + WINDOWS + w - 1], text, low + k, self.width, w)
            good = edits <= slack
            if good.any():
                found.append((int(edits.min()), int(first[good].min()), int(last[good].max())))
        return (min(f[0] for f in found), max(0, min(f[1] for f in found)), min(len(text), max(f[2] for f in found))) if found else None


def _grams(text: bytes) -> np.ndarray:
    return np.ndarray((len(text) - Q + 1,), "<u8", text, strides=(1,)).copy()


def _slot(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams * _FACTOR) >> np.uint64(64 - _BITS)).astype(np.int64)


def _align(item: bytes, text: bytes, low: int, width: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of an item its fewest edits within a band, and where that copy begins and ends.

    The band has diagonals (text's place less item's place) low to low +
    width. All windows advance together, a byte at a time.
    """
    m, n = len(item) - window + 1, len(text)
    a = np.frombuffer(item, np.uint8)
    src = np.arange(low, low + len(item) + width + 1)
    padded = np.where((src >= 0) & (src < n), np.frombuffer(text, np.uint8)[np.clip(src, 0, n - 1)], 255)  # in no UTF-8 text
    ramp = np.arange(width + 1)
    cost = np.zeros((m, width + 1), np.int32)
    start = np.broadcast_to(ramp, cost.shape)  # the diagonal that a copy begins on
    rows = np.arange(m)
    for t in range(window):
        at = rows[:, None] + t + ramp
        here = cost + (padded[at] != a[rows + t][:, None])
        over = np.full_like(cost, window + 1)
        over[:, :-1] = cost[:, 1:] + 1
        begun = np.where(over[:, :] < here, np.concatenate((start[:, 1:], start[:, -1:]), axis=1), start)
        here = np.minimum(here, over)
        least = np.minimum.accumulate(here - ramp, axis=1) + ramp
        # a byte of the text beside the item: the path comes from the last place that set the minimum
        source = np.maximum.accumulate(np.where(here == least, ramp, 0), axis=1)
        start = np.take_along_axis(begun, source, axis=1)
        cost = least
    best = cost.argmin(axis=1)
    return cost[rows, best], low + rows + start[rows, best], low + rows + window + best


def spans(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in a text (code points, whole words) of stretches of its normal form."""
    ends, at, words = [], 0, []
    for m in _WORDS.finditer(text):
        at += len(m[0].lower().encode("utf-8", "surrogatepass")) + 1
        ends.append(at)
        words.append(m.span())
    ends = np.array(ends)
    out = []
    for a, b in found:
        first = min(int(np.searchsorted(ends, a, "right")), len(words) - 1)
        final = min(int(np.searchsorted(ends, max(a, b - 1), "right")), len(words) - 1)
        out.append((words[first][0], words[final][1]))
    return out


_FOUND = "array<struct<item:{},edits:int,begin:int,end:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "leaks") -> DataFrame:
    """``docs`` with an array of leaks: item, edits of its best window, place in the text.

    All rows and columns stay; a column named ``out_col`` is replaced. Null
    texts count as empty and have no leaks; very long ones are read whole. Items are
    taken in blocks of ``BLOCK`` bytes (by rows of ``item_col``'s hash), one after the
    other: a block is fetched, sent out, and its leaks are written with the documents
    before the next one is, so that what travels and what a task holds is bounded
    however large the benchmark. Null items are left out, and those without letters
    and digits have no leaks; equal ones count each. An empty benchmark gives empty arrays.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_col].dataType
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK))
    name = "_leaks"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, F.array().cast(_FOUND.format(kind.simpleString())))
    held = None
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        block = sorted(((r["i"], r["t"]) for r in mine.collect()), key=lambda x: (str(x[0]), x[1]))
        shared = spark.sparkContext.broadcast(block)
        out = out.withColumn(name, F.concat(name, _finder(shared, rule, kind)(text_or_empty(text_col))))
        if part < parts - 1:
            following = Stored(out)
            shared.destroy()
            if held is not None:
                held.drop()
            held, out = following, following.df
    return out.withColumn(out_col, F.col(name)).drop(name)


def _finder(shared, rule: Rule, kind: DataType):
    schema = _FOUND.format(kind.simpleString())
    fields = [("item", to_arrow_type(kind)), ("edits", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]

    @F.arrow_udf(schema)
    def find(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.collect()  # what earlier tasks of this worker left in cycles
        index = Index(shared.value, rule)
        for whole in it:
            batch = pa.RecordBatch.from_arrays([whole], ["text"])
            rows = []
            for piece in slices([batch], "text", 4 << 20):
                texts = piece.column("text").to_pylist()
                for text, found in zip(texts, index.leaks([normal(t) for t in texts])):
                    at = spans(text, [(a, b) for _, _, a, b in found]) if found else []
                    rows.append([{"item": index.ids[i], "edits": e, "begin": a, "end": b} for (i, e, _, _), (a, b) in zip(found, at)])
            yield pa.array(rows, pa.list_(pa.struct(fields)))

    return find


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``contaminated``, the items found (sorted, each once) and the leaks, for every row.

    Repeated rows get equal results; null and empty texts are not contaminated;
    an empty table gives an empty result; other columns are left out.
    """
    found = find_leaks(docs.select(id_col, text_col), benchmark, rule, text_col)
    return found.select(
        id_col,
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item"]))).alias("items"),
        "leaks",
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """The documents without any leak, with their columns as they were, null and empty texts and repeated rows included."""
    mark = "_found"
    while mark in docs.columns:
        mark += "_"
    return find_leaks(docs, benchmark, rule, text_col, out_col=mark).where(F.size(mark) == 0).drop(mark)
