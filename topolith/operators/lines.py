"""Rules for lines. Inputs: ``fid, part, coords``, or the segments of such lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clean, is_box, orientation, segment_contains, unsure, whole
from . import exact
from .grid import grid_join, measured, with_line_box, with_ring_box, with_segment_box
from .materialize import stored
from .transforms import dedup_segments, drop_empty_segments, endpoints, explode_lines, inner_points, pinned

_SEGMENT = ("x1", "y1", "x2", "y2")


def _ordered(a: str, b: str) -> Column:
    """An order of two directed segments by their coordinates, which are distinct after deduplication."""
    return F.struct(*[F.col(a + n) for n in _SEGMENT]) < F.struct(*[F.col(b + n) for n in _SEGMENT])


def _ends(p: str) -> tuple[Column, Column]:
    """The lexicographically smaller and greater end of a segment."""
    one, two = (F.struct(F.col(p + x).alias("x"), F.col(p + y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2")))
    return F.least(one, two), F.greatest(one, two)


def _classified(pairs: DataFrame) -> DataFrame:
    a = [F.col("a_" + n) for n in _SEGMENT]
    b = [F.col("b_" + n) for n in _SEGMENT]
    turns = {"o1": orientation(*a, b[0], b[1]), "o2": orientation(*a, b[2], b[3]), "o3": orientation(*b, a[0], a[1]), "o4": orientation(*b, a[2], a[3])}
    pairs = pinned(pairs, **turns)
    (alo, ahi), (blo, bhi) = _ends("a_"), _ends("b_")
    pairs = pinned(pairs, lo=F.greatest(alo, blo), hi=F.least(ahi, bhi))
    lo, hi = F.col("lo"), F.col("hi")
    zero = F.expr("o1 = 0 and o2 = 0 and o3 = 0 and o4 = 0")
    proper = F.expr("((o1 > 0 and o2 < 0) or (o1 < 0 and o2 > 0)) and ((o3 > 0 and o4 < 0) or (o3 < 0 and o4 > 0))")

    def touch(o: str, p: str, i: str, s: str) -> Column:
        x, y = F.col(f"{p}_x{i}"), F.col(f"{p}_y{i}")
        return (F.col(o) == 0) & x.between(F.least(f"{s}_x1", f"{s}_x2"), F.greatest(f"{s}_x1", f"{s}_x2")) & y.between(
            F.least(f"{s}_y1", f"{s}_y2"), F.greatest(f"{s}_y1", f"{s}_y2")
        )

    touches = [("o1", "b", "1", "a"), ("o2", "b", "2", "a"), ("o3", "a", "1", "b"), ("o4", "a", "2", "b")]
    # 0 to 3: which end touches the other segment
    which = F.when(zero | proper, F.lit(None))
    for k, t in enumerate(touches):
        which = which.when(touch(*t), k)
    kind = F.when(zero & (lo < hi), "collinear").when(zero & (lo == hi), "improper").when(zero, F.lit(None)).when(proper, "proper")
    pairs = pinned(pairs, which=which)
    pairs = pinned(pairs, kind=kind.when(F.col("which").isNotNull(), "improper")).where("kind is not null")
    kind, x, y = F.col("kind"), F.when(zero, lo["x"]), F.when(zero, lo["y"])
    for k, t in enumerate(touches):
        x, y = x.when(F.col("which") == k, F.col(f"{t[1]}_x{t[2]}")), y.when(F.col("which") == k, F.col(f"{t[1]}_y{t[2]}"))
    # a proper crossing: a's first end moved along a by the share o3 / (o3 - o4)
    share = F.col("o3") / F.nullif(F.col("o3") - F.col("o4"), F.lit(0.0))
    x = x.otherwise(a[0] + share * (a[2] - a[0]))
    y = y.otherwise(a[1] + share * (a[3] - a[1]))
    out = pairs.select(
        "*",
        clean(x).alias("x"),
        clean(y).alias("y"),
        F.when(kind == "collinear", clean(hi["x"])).alias("to_x"),
        F.when(kind == "collinear", clean(hi["y"])).alias("to_y"),
    )
    return out.drop("o1", "o2", "o3", "o4", "lo", "hi", "which")


def segment_meetings(segments: DataFrame, cell: float | None = None, robust: bool = False) -> DataFrame:
    """All pairs of distinct directed segments that meet, each unordered pair once.

    Equal directed segments count once and segments of no length not at all.
    Columns: both segments (``a_`` and ``b_``), ``kind`` (proper: a point
    inside both; improper: a point that ends one; collinear: a common
    stretch), ``x, y`` and, for a stretch, ``to_x, to_y``, the greater end.

    Signs come from doubles, which are exact for integers below 2^25. With
    ``robust``, pairs whose signs rounding leaves open are decided by exact
    fractions, for which the join runs once more unless all coordinates are whole
    numbers of 24 bits, which leave none open.
    """
    given = drop_empty_segments(dedup_segments(segments))
    # measured before repeats go, which would take the exchange for that once more
    boxed = with_segment_box(drop_empty_segments(segments))
    every = whole(*(F.col(n) for n in _SEGMENT))
    *sizes, left_open = measured(boxed, F.count_if(~every)) if robust else (*measured(boxed), 0)
    pairs = grid_join(with_segment_box(given), order=_ordered("a_", "b_"), cell=cell, sizes=tuple(sizes))
    if not left_open:
        return _classified(pairs)
    a, b = [F.col("a_" + n) for n in _SEGMENT], [F.col("b_" + n) for n in _SEGMENT]
    open_ = unsure(*a, b[0], b[1]) | unsure(*a, b[2], b[3]) | unsure(*b, a[0], a[1]) | unsure(*b, a[2], a[3])
    sure = _classified(pairs.where(~open_))
    return sure.unionByName(_decided(pairs.where(open_)))


def _decided(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                kind, at = exact.meet(*(exact.point(r[p + x], r[p + y]) for p in ("a_", "b_") for x, y in (("x1", "y1"), ("x2", "y2"))))
                if kind != "none":
                    to = at[1] if kind == "collinear" else (None, None)
                    x, y, to_x, to_y = (None if v is None else float(v) for v in (*at[0], *to))
                    out.append({**r, "kind": kind, "x": x, "y": y, "to_x": to_x, "to_y": to_y})
            if out:
                fields = [*batch.schema, pa.field("kind", pa.string()), *[pa.field(n, pa.float64()) for n in ("x", "y", "to_x", "to_y")]]
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    # the work is in the kernel, not in the bytes by which partitions are merged; dealt by values, as other dealing sorts all rows first
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, *["a_" + c for c in _SEGMENT], *["b_" + c for c in _SEGMENT]).mapInArrow(run, f"{columns}, kind string, x double, y double, to_x double, to_y double")


def must_not_overlap(lines: DataFrame, cell: float | None = None) -> DataFrame:
    """The common stretch of each pair of collinear segments, smaller end first: ``x1, y1, x2, y2``."""
    return overlaps(segment_meetings(explode_lines(lines), cell))


def overlaps(meetings: DataFrame) -> DataFrame:
    return meetings.where("kind = 'collinear'").select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("to_x").alias("x2"), F.col("to_y").alias("y2"))


def must_not_overlap_with(lines: DataFrame, other: DataFrame, cell: float | None = None) -> DataFrame:
    """Segments of ``other`` that a segment of ``lines`` contains, in their direction, one row a pair.

    Containment only: partial overlaps and segments that contain one of
    ``lines`` are not found. Segments of no length are left out.
    """
    left, right = (with_segment_box(drop_empty_segments(explode_lines(df))) for df in (lines, other))
    pairs = grid_join(left, right, cell=cell).where(segment_contains("a_", "b_"))
    return pairs.select(F.col("b_fid").alias("fid"), *[F.col("b_" + n).alias(n) for n in _SEGMENT])


def must_not_self_overlap(lines: DataFrame, cell: float | None = None) -> DataFrame:
    """For each ordered pair of segments of one line of which the first contains the second, the second.

    Segments meet in tiles of their own line, so that a line of very many segments is no single group.
    """
    segs = with_segment_box(explode_lines(lines))
    pairs = grid_join(segs, order=F.col("a_seg") < F.col("b_seg"), cell=cell, same=("fid", "part"))
    second = pairs.where(segment_contains("a_", "b_")).select(F.col("b_fid").alias("fid"), *[F.col("b_" + n).alias(n) for n in _SEGMENT])
    first = pairs.where(segment_contains("b_", "a_")).select(F.col("a_fid").alias("fid"), *[F.col("a_" + n).alias(n) for n in _SEGMENT])
    return second.unionByName(first)


def must_not_intersect(lines: DataFrame, cell: float | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points at which lines intersect, each once, and collinear stretches, one a pair.

    Points are all proper crossings, and improper touches whose coordinate
    occurs at least twice among inner vertices. A touch at line ends or a
    single inner vertex is no intersection. ``digits`` rounds proper
    crossings before they are told apart. Meetings are found once and stored
    for both results.
    """
    meetings = stored(segment_meetings(explode_lines(lines), cell).select("kind", "x", "y", "to_x", "to_y"))
    return intersection_points(meetings, inner_points(lines), digits), overlaps(meetings)


def intersection_points(meetings: DataFrame, inner: DataFrame, digits: int | None = None) -> DataFrame:
    shown = (lambda c: clean(F.round(c, digits))) if digits is not None else clean
    proper = meetings.where("kind = 'proper'").select(shown(F.col("x")).alias("x"), shown(F.col("y")).alias("y"))
    repeated = inner.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    improper = meetings.where("kind = 'improper'").select("x", "y").join(repeated, ["x", "y"], "left_semi")
    return proper.unionByName(improper).distinct()


def must_not_have_dangles(lines: DataFrame, cell: float | None = None) -> DataFrame:
    """Ends of lines, repeats kept, that no other segment touches in a single point: ``fid, x, y``.

    An end that only lies on a collinear stretch stays a dangle.
    """
    meetings = segment_meetings(explode_lines(lines), cell)
    touched = meetings.where("kind = 'improper'").select("x", "y").distinct()
    return endpoints(lines).join(touched, ["x", "y"], "left_anti").select("fid", "x", "y")


def _in_box(coords: Column, box: str) -> Column:
    """Whether a line within a closed box has a point in its inside: some stretch does not run along one side."""
    side = [(k, F.col(box + end + k)) for k in "xy" for end in ("min", "max")]
    steps = F.zip_with(
        F.slice(coords, F.lit(1), F.size(coords) - 1),
        F.slice(coords, F.lit(2), F.size(coords) - 1),
        lambda p, q: F.struct(p.alias("p"), q.alias("q")),
    )
    along = lambda p, q: reduce(or_, [(p[k] == v) & (q[k] == v) for k, v in side])
    # a stretch of no length, as of a line of one place, counts by its place alone, along a side or not
    return F.exists(steps, lambda s: ~along(s["p"], s["q"]))


def _in_convex(coords: pa.Array, rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether polygons of one strictly convex ring contain their lines, and for which rows that is decided."""
    inside, done = np.zeros(len(coords), bool), np.zeros(len(coords), bool)
    of = rings.flatten() if rings.null_count else rings.values
    start = np.asarray(rings.offsets)
    single = (np.diff(start) == 1) & np.asarray(rings.is_valid()) & np.asarray(coords.is_valid())
    if coords.null_count or rings.null_count or of.null_count or coords.values.null_count or of.values.null_count:
        return inside, done
    xy = [f for v in (coords.values, of.values) for f in (v.field("x"), v.field("y"))]
    if any(f.null_count for f in xy) or not single.any():
        return inside, done
    x, y, rx, ry = (f.to_numpy(zero_copy_only=False) for f in xy)
    first, edge = np.asarray(coords.offsets), np.asarray(of.offsets)
    rows = np.flatnonzero(single)
    ring = start[rows]
    inside[rows], done[rows] = exact.in_convex(x, y, first[rows], np.diff(first)[rows], rx, ry, edge[ring], edge[ring + 1] - edge[ring])
    return inside, done


def must_be_inside(lines: DataFrame, polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """Lines that no single polygon contains: ``fid, part, coords``.

    A contained line has no point outside and does not run on the boundary
    alone. Candidates are pairs in which the polygon's box holds the line's;
    boxes are decided in columns, strictly convex polygons many at once where
    doubles leave no sign open, others exactly, pair by pair.
    """
    left = with_line_box(lines.where(F.size("coords") > 1).select("fid", "part", "coords"))
    right = with_ring_box(polygons.select("rings")).withColumn("box", is_box(F.col("rings")))
    pairs = grid_join(left, right, cell=cell).where("a_minx >= b_minx and a_maxx <= b_maxx and a_miny >= b_miny and a_maxy <= b_maxy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, done = _in_convex(batch.column("a_coords"), batch.column("b_rings"))
            left = np.flatnonzero(~done)
            some = batch.select(["a_coords", "b_rings"]).take(pa.array(left))
            for k, coords, rings in zip(left.tolist(), some.column("a_coords").to_pylist(), some.column("b_rings").to_pylist()):
                edges = exact.edges_of(exact.rings_of(rings))
                inside[k] = exact.line_inside([exact.point(c["x"], c["y"]) for c in coords], edges)
            yield pa.RecordBatch.from_arrays([batch.column("a_fid"), batch.column("a_part"), pa.array(inside, pa.bool_())], ["fid", "part", "inside"])

    boxed = pairs.where(F.col("b_box") & _in_box(F.col("a_coords"), "b_")).select(F.col("a_fid").alias("fid"), F.col("a_part").alias("part"))
    others = pairs.where("not b_box").select("a_fid", "a_part", "a_coords", "b_rings").mapInArrow(run, "fid long, part int, inside boolean").where("inside")
    return lines.join(boxed.unionByName(others.select("fid", "part")), ["fid", "part"], "left_anti").select("fid", "part", "coords")
