"""SimHash fingerprints and their exact linking by tiled comparison.

Fingerprints are compared exactly, without bands: equal fingerprints collapse
first, the rest fall into tiles by the population counts of their four 16-bit
words. Two fingerprints within ``radius`` bits have population counts whose
differences add up to ``radius`` at most, so that only such pairs of tiles
meet (an equi-join on the tile's key); all other pairs of tiles are skipped.
Within a pair of tiles numpy takes exclusive-or and bit counts of whole blocks.

Tiles are cut into blocks of bounded size, and a pair of blocks returns a
star for each component of its links instead of all of them, so that a group of n
near copies costs O(n) rows. Skipping is strong enough for about 10^8 distinct
fingerprints; work per pair of tiles then still grows with the square of a
tile's size, spread over blocks, so that more machines shorten it.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.materialize import stored
from .common import may_meet, slices, text_or_empty, to_bytes

#: Fingerprints in one block of a tile at most.
BLOCK = 2048


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text; zero for one without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle + 1]
    ends = np.concatenate((gaps, [len(line)]))[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(starts), step):
        pairs = zip(starts[i : i + step].tolist(), ends[i : i + step].tolist())
        h = np.array([digest(line[a:b], seed) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long), one row for each document.

    A null text counts as empty and gets fingerprint zero, as does a text of
    white space alone. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([simhash(x, shingle) for x in to_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")
    return out.withColumnRenamed("id", id_col)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the graph of links i-j over n nodes: its nodes and its least one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components that links between two blocks, or within one, make."""
    found_i, found_j, step = [], [], 256
    for k in range(0, len(a), step):
        near = np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            found_i.append(i)
            found_j.append(j)
    if not found_i:
        return a[:0], b[:0]
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    nodes = a if same else np.concatenate((a, b))
    i, j = _forest(len(nodes), i, j if same else j + len(a))
    return nodes[i], nodes[j]


def tile_links(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) of ``radius`` bits or fewer.

    Returns ``src`` and ``dst``: for each pair of blocks a star for each
    component of its links, so that components are those of all links.
    """
    word = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535))) for k in range(4)]
    # six bits for a count of 0 to 16; with the radius added, no step leaves its field
    fields = [(w + F.lit(radius)) * F.lit(1 << (6 * k)) for k, w in enumerate(word)]
    key = fields[0] + fields[1] + fields[2] + fields[3]
    steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    half = [s for s in steps if s > (0, 0, 0, 0)]
    offsets = [0] + [sum(x * (1 << (6 * k)) for k, x in enumerate(s)) for s in half]

    keyed = fps.select("fp", key.cast("long").alias("tile"))
    sizes = keyed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    blocks = stored(
        keyed.join(sizes, "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    left = blocks.select(
        F.explode(F.array(*[F.lit(x).cast("long") for x in offsets])).alias("step"),
        F.col("tile").alias("home"),
        F.col("part").alias("part_a"),
        F.col("fps").alias("a"),
    ).withColumn("tile", F.col("home") + F.col("step"))
    right = blocks.select("tile", F.col("part").alias("part_b"), F.col("fps").alias("b"))
    pairs = (
        left.join(right, "tile")
        .where("step <> 0 or part_a <= part_b")
        .select("a", "b", F.expr("step = 0 and part_a = part_b").alias("same"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k) for k in ("a", "b")]
            flat = [c.values.to_numpy().view(np.uint64) for c in cols]
            at = [c.offsets.to_numpy() for c in cols]
            src, dst = [], []
            for k, same in enumerate(batch.column("same").to_pylist()):
                a, b = (f[o[k] : o[k + 1]] for f, o in zip(flat, at))
                if len(a) == 1 and same:
                    continue
                x, y = _links(a, b, same, radius)
                if len(x):
                    src.append(x)
                    dst.append(y)
            if src:
                arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)]
                yield pa.RecordBatch.from_arrays(arrays, ["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Each document with its fingerprint and the component it belongs to.

    Returns ``id_col``, ``fp`` (long), ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that links of ``radius`` bits or fewer
    reach, the document itself included. One row for each input row: repeated
    rows stay; null and empty texts share fingerprint zero and are linked like
    any other; a null id is never the smallest unless a component has no
    other. Very long texts are read whole. An empty table gives an empty result;
    other columns are left out, whatever their names.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle))
    classes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    comp = connected_components(tile_links(classes.select("fp"), radius))
    labelled = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = stored(labelled.join(least, "component").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select(
        id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# texts that are alike, rather than fingerprints that are near

#: Tables of tiles, and least hashes that a tile's key has.
TABLES, ROWS = 6, 2
#: Fingerprints of a block, and texts and shingles of one that has these, at most, about.
FINGERPRINTS, TEXTS, SHINGLES = 2048, 1024, 1 << 21
#: Parts that rows of one class are dealt to.
SALTS = 8


def radius_for(similarity: float, bits: int = 64) -> int:
    """Bits in which fingerprints of texts of this similarity differ, but for one pair in a thousand.

    Sets with a Jaccard similarity s make an angle whose cosine is 2s / (1 + s)
    at least; a bit differs with a chance of that angle over pi.
    """
    chance = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * chance + 3 * math.sqrt(bits * chance * (1 - chance)))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; of the whole word sequence where that is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle + 1]
    ends = np.concatenate((gaps, [len(line)]))[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


#: Words of 64 bits in a wide fingerprint; the first is the fingerprint itself.
WORDS = 16
_TURN = np.array([1] + [(0xD6E8FEB86659FD93 * (2 * k + 1)) & (2**64 - 1) | 1 for k in range(1, WORDS)], np.uint64)


def _ones(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set. Three rows add up to one and a row of carries, until few are left."""
    counts, weight = np.zeros(64 * rows.shape[1], np.int64), 0
    while len(rows):
        carries = []
        while len(rows) > 24:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            t = a ^ b
            carries.append((a & b) | (t & c))
            rows = np.concatenate((t ^ c, rows[3 * m :]))
        bits = np.unpackbits(np.ascontiguousarray(rows, "<u8").view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8).astype(np.int64) << weight
        rows = np.concatenate(carries) if carries else rows[:0]
        weight += 1
    return counts


def _bits(h: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a set of hashes: of the hashes themselves, and of them mixed anew for each further word."""
    counts, step = np.zeros(64 * WORDS, np.int64), 1 << 13
    with np.errstate(over="ignore"):
        for i in range(0, len(h), step):
            x = h[i : i + step, None] * _TURN
            x[:, 1:] ^= x[:, 1:] >> np.uint64(32)
            counts += _ones(x)
    return np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view("<u8")


_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1 for k in range(TABLES * ROWS)], np.uint64)


def _tile_keys(h: np.ndarray) -> list[int]:
    """For each table a hash of the least of the set's hashes, mixed anew for each."""
    if not len(h):
        return [0] * TABLES
    with np.errstate(over="ignore"):
        mixed = np.array([(x := (h ^ (h >> np.uint64(29))) * odd, (x ^ (x >> np.uint64(32))).min())[1] for odd in _ODD], np.uint64)
        key = np.zeros(TABLES, np.uint64)
        for k in range(ROWS):
            key = (key ^ mixed[k::ROWS]) * _ODD[0]
            key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``th`` (the text's hash), ``cls`` (its shingles' hash), ``fp``, ``n`` (shingles), ``tiles`` and ``wide`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in slices(batches, "text", 4 << 20):
            cls, fps, sizes, tiles, wide = [], [], [], [], []
            for x in to_bytes(batch.column("text")):
                h = shingle_set(x, shingle)
                cls.append(xxhash.xxh64_intdigest(h.tobytes(), 1))
                words = _bits(h)
                fps.append(int(words[0]))
                wide.append(words.tobytes())
                sizes.append(len(h))
                tiles.append(_tile_keys(h))
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            arrays = [batch.column("id"), batch.column("th"), signed(cls), signed(fps), pa.array(sizes, pa.int64()), pa.array(tiles, pa.list_(pa.int64())), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "cls", "fp", "n", "tiles", "wide"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return source.mapInArrow(run, f"id {kind}, th long, cls long, fp long, n long, tiles array<long>, wide binary")


def _grams(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``cls`` and ``grams`` (hashes of its shingles) of each wanted class, from the text of the row that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in slices(batches, "text", 4 << 20):
            grams = [np.unique((shingle_set(x, shingle) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in to_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(grams, pa.binary())], ["cls", "grams"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    heads = wanted.select("cls", F.col("head.id").alias("head_id"), F.col("head.th").alias("head_th"))
    # only texts that may be wanted are moved
    rows = may_meet(rows, wanted.select("head.id", "head.th"), ["id", "th"], "may").where("may").drop("may")
    meets = rows["id"].eqNullSafe(heads["head_id"]) & (rows["th"] == heads["head_th"])
    return rows.join(heads, meets).select("cls", "text").mapInArrow(run, "cls long, grams binary").groupBy("cls").agg(F.first("grams").alias("grams"))


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def near_pairs(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, same: bool, similarity: float, radius: int, step: int = 256
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in two blocks of fingerprints (or in one, each pair once), and the bits in which they differ.

    Exclusive-or and bit counts of all pairs; blocks whose population counts
    differ beyond the radius are skipped, and pairs whose sizes can't be alike are left out.
    """
    ones = [np.bitwise_count(x).astype(np.int64) for x in (a, b)]
    if not len(a) or not len(b) or ones[0].min() - ones[1].max() > radius or ones[1].min() - ones[0].max() > radius:
        return
    for k in range(0, len(a), step):
        d = np.bitwise_count(a[k : k + step, None] ^ b[None, :])
        i, j = np.nonzero(d <= radius)
        d, i = d[i, j], i + k
        ok = np.minimum(size_a[i], size_b[j]) >= similarity * np.maximum(size_a[i], size_b[j])
        ok &= (i < j) if same else True
        if ok.any():
            yield i[ok], j[ok], d[ok]


def alike_links(fps: list[np.ndarray], grams: list[list[bytes]], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links between texts of one block, or of two, that connect all that are alike; numbers run on from the first block to the second.

    Of the near pairs, nearest first, shingles are compared unless other links
    connect the pair already.
    """
    same, shift = len(fps) == 1, 0 if len(fps) == 1 else len(fps[0])
    sets = [np.frombuffer(g, np.uint32) for block in grams for g in block]
    size = np.array([len(x) for x in sets])
    found = list(near_pairs(fps[0], fps[-1], size[: len(fps[0])], size[shift:], same, similarity, radius))
    if not found:
        return []
    i, j, d = map(np.concatenate, zip(*found))
    j = j + shift
    order = np.argsort(d, kind="stable")
    i, j = i[order], j[order]
    label, out, chunk = np.arange(len(sets)), [], 64
    while len(i):
        for x, y in zip(i[:chunk].tolist(), j[:chunk].tolist()):
            if label[x] != label[y] and _alike(sets[x], sets[y], similarity):
                out.append((x, y))
                label[label == max(label[x], label[y])] = min(label[x], label[y])
        i, j = i[chunk:], j[chunk:]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return out


def _near_in(blocks: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``at, tile, cls`` of the texts with another one within the radius, by wide fingerprints too, and of a size that lets them be alike."""
    far = radius_for(similarity, 64 * WORDS)
    sides = [c for c in ("a", "b") if c in blocks.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in batches:
            at, tile, found = [], [], []
            cols = {c: batch.column(c) for c in sides}
            flat = {c: [cols[c].values.field(k).to_numpy() for k in range(3)] for c in sides}
            for c in sides:
                flat[c].append(np.frombuffer(b"".join(cols[c].values.field(3).to_pylist()), "<u8").reshape(-1, WORDS))
            ends = {c: cols[c].offsets.to_numpy() for c in sides}
            for row, (x, y) in enumerate(zip(batch.column("at").to_pylist(), batch.column("tile").to_pylist())):
                held = [[v[ends[c][row] : ends[c][row + 1]] for v in flat[c]] for c in sides]
                one, two = held[0], held[-1]
                mark = [np.zeros(len(h[0]), bool) for h in held]
                for i, j, _ in near_pairs(one[1].view(np.uint64), two[1].view(np.uint64), one[2], two[2], len(held) == 1, similarity, radius):
                    for k in range(0, len(i), 1 << 15):
                        x1, x2 = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                        ok = np.bitwise_count(one[3][x1] ^ two[3][x2]).sum(axis=1, dtype=np.int64) <= far
                        mark[0][x1[ok]] = True
                        mark[-1][x2[ok]] = True
                for h, m in zip(held, mark):
                    cls = h[0][m]
                    found.append(cls)
                    at += [x] * len(cls)
                    tile += [y] * len(cls)
            cls = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(tile, pa.int64()), pa.array(cls, pa.int64())], ["at", "tile", "cls"])

    return blocks.mapInArrow(run, "at int, tile long, cls long")


def _alike_in(blocks: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links between classes, ``src`` and ``dst``."""
    sides = [c for c in ("a", "b") if c in blocks.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in batches:
            src, dst = [], []
            for row in range(batch.num_rows):
                held = [batch.column(c)[row].as_py() for c in sides]
                cls = [x["cls"] for block in held for x in block]
                fps = [np.array([x["fp"] for x in block], np.int64).view(np.uint64) for block in held]
                for i, j in alike_links(fps, [[x["grams"] for x in block] for block in held], similarity, radius):
                    src.append(cls[i])
                    dst.append(cls[j])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return blocks.select(*sides).mapInArrow(run, "src long, dst long")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id``, ``th`` (xxhash64 of the text) and ``component`` of each row, for texts whose shingles are alike.

    Components are those of links between texts whose sets of shingles have a
    Jaccard similarity of ``similarity`` or more. Texts with equal sets collapse
    first. Fingerprints of similar texts differ in ten of 64 bits on average,
    so that population counts alone skip little; tiles are texts that share two
    least hashes in one of six tables, which at 0.8 loses two pairs in a thousand.
    In a tile, and between the blocks of a large one, exclusive-or and bit counts leave
    the near pairs, first on 64 bits and then on 1,024; only their texts' shingles are sent to the tile, and decide. Tiles of very common shingles cost
    the square of their texts in bit counts, spread over pairs of blocks.

    Null and empty texts are alike. One row for each input row; an empty table gives an empty result.
    """
    radius = radius_for(similarity)
    marked = stored(_marks(docs, id_col, text_col, shingle)).withColumn("s", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)))
    head = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "th")).alias("head")
    classes = stored(marked.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("fp", "n", "tiles", "wide")], head))
    keyed = classes.where("n > 0").select("cls", "fp", "n", "wide", F.posexplode("tiles").alias("at", "tile"))
    tiles = keyed.groupBy("at", "tile").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    parts = F.ceil(F.col("texts") / F.lit(FINGERPRINTS)).cast("long")
    shared = keyed.join(tiles.select("at", "tile", parts.alias("parts")), ["at", "tile"])
    # fingerprints alone first: only texts that have a near one in their tile send their shingles there
    near = stored(_paired(_blocks(shared, "cls", "fp", "n", "wide"), lambda blocks: _near_in(blocks, similarity, radius)).distinct())
    wanted = stored(near.select("cls").distinct().join(classes.select("cls", "head"), "cls"))
    grams = _grams(docs, wanted, id_col, text_col, shingle)
    full = near.join(classes.select("cls", "fp", "n"), "cls")
    sizes = full.groupBy("at", "tile").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TEXTS), F.sum("n") / F.lit(SHINGLES))).cast("long").alias("parts"))
    blocks = stored(_blocks(full.join(sizes, ["at", "tile"]).join(grams, "cls"), "cls", "fp", "grams"))
    linked = connected_components(_paired(blocks, lambda held: _alike_in(held, similarity, radius)))
    spread = linked.select(F.col("node").alias("cls"), "component", _salts())
    return marked.select("id", "th", "cls", "s").join(spread, ["cls", "s"], "left").select("id", "th", F.coalesce("component", "cls").alias("component"))


def _salts() -> Column:
    """A row for each of the parts that rows of one class are dealt to, however many they are."""
    return F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])).alias("s")


def _blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """``at, tile, parts, part, block``: the texts of each tile, dealt to its parts."""
    return rows.groupBy("at", "tile", "parts", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct(*columns)).alias("block"))


def _paired(blocks: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``compare`` finds within each block (column ``a``), and between the blocks of a tile (``a`` and ``b``)."""
    large = blocks.where("parts > 1")
    other = large.select("at", "tile", F.col("part").alias("part_b"), F.col("block").alias("b"))
    within = compare(blocks.select("at", "tile", F.col("block").alias("a")))
    return within.unionByName(compare(large.withColumnRenamed("block", "a").join(other, ["at", "tile"]).where("part < part_b").select("at", "tile", "a", "b")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents left when one of each group of similar texts stays: that of the smallest id.

    Groups are those of ``similar_texts``. All columns come back as they are. Of
    several rows of one id in a group the one with the smallest text hash stays, and of
    rows equal in id and text one; rows of one id in different groups stay each. Rows
    without an id come after all others, so one of them stays only where its group has none with an
    id. An empty table gives an empty result.
    """
    held = stored(similar_texts(docs, id_col, text_col, shingle, similarity))
    nameless = F.col("id").isNull()
    heads = held.groupBy("component").agg(F.min(F.struct(nameless.alias("nameless"), "id", "th")).alias("head"), F.count(F.lit(1)).alias("size"))
    head = heads.select("component", "size", F.col("head.id").alias("head_id"), F.col("head.th").alias("head_th"))
    own = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("th") == F.col("head_th"))
    told = stored(held.join(head.where("size > 1"), "component").select("id", "th", own.alias("own")).groupBy("id", "th").agg(F.bool_or("own").alias("own"), F.count(F.lit(1)).alias("rows")))
    mark = "_th"
    while mark in docs.columns or mark + "_may" in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(text_or_empty(text_col)))
    # rows that stay as they are aren't moved: only those that may go or come in several rows meet what was found
    changed = told.where("not own or rows > 1")
    sought = changed.select(F.col("id").alias(id_col), F.col("th").alias(mark))
    sieved = may_meet(marked, sought, [id_col, mark], mark + "_may")
    still = sieved.where(~F.col(mark + "_may")).drop(mark, mark + "_may")
    met = sieved.where(mark + "_may").drop(mark + "_may")

    def meets(which: DataFrame):
        return met[id_col].eqNullSafe(which["_id"]) & (met[mark] == which["_text"])

    def named(where: str) -> DataFrame:
        return changed.where(where).select(F.col("id").alias("_id"), F.col("th").alias("_text"))

    # the heads of groups that come in several equal rows are dealt with apart
    away, several = named("true"), named("own")
    alone = met.join(away, meets(away), "left_anti")
    one = _first(met.join(several, meets(several), "left_semi"), [id_col, mark], [text_col])
    return still.unionByName(alone.unionByName(one).drop(mark))


def _first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    mark = "_row"
    while mark in df.columns:
        mark += "_"
    return df.withColumn(mark, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(mark) == 1).drop(mark)
