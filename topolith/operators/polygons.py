"""Rules for polygons. Inputs: ``fid, part, rings``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_box, segment_contains
from . import exact
from .grid import grid_join, measured, with_ring_box, with_segment_box
from .transforms import boundary_segments, box_rings, pinned

_BOX = ("minx", "miny", "maxx", "maxy")


def _prepared(polygons: DataFrame) -> DataFrame:
    return with_ring_box(polygons.select("fid", "part", "rings")).withColumn("box", is_box(F.col("rings")))


_SHARED = "fid_a long, fid_b long, piece int, rings array<array<struct<x:double,y:double>>>"


def _shared(pairs: DataFrame) -> DataFrame:
    """The area that each pair shares, one row a polygon of it: ``fid_a, fid_b, piece, rings``.

    Pairs of boxes have a closed form; other pairs are intersected exactly in
    Arrow batches. Pairs that only touch share no area and give no row.
    """
    both = F.col("a_box") & F.col("b_box")
    x0, y0 = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
    x1, y1 = F.least("a_maxx", "b_maxx"), F.least("a_maxy", "b_maxy")
    overlap = (x0 < x1) & (y0 < y1)
    boxes = pairs.where(both & overlap).select(
        F.col("a_fid").alias("fid_a"), F.col("b_fid").alias("fid_b"), F.lit(0).alias("piece"), box_rings(x0, y0, x1, y1).alias("rings")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                pieces = exact.intersection(exact.rings_of(r["a_rings"]), exact.rings_of(r["b_rings"]))
                for k, rings in enumerate(sorted(pieces)):
                    shown = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]
                    out.append({"fid_a": r["a_fid"], "fid_b": r["b_fid"], "piece": k, "rings": shown})
            kinds = [("fid_a", pa.int64()), ("fid_b", pa.int64()), ("piece", pa.int32()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    # the work is in the kernel, not in the bytes by which partitions are merged; dealt by keys, as other dealing sorts all rows first
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = pairs.where(~both & overlap).select("a_fid", "b_fid", "a_rings", "b_rings").repartition(n, "a_fid", "b_fid").mapInArrow(run, _SHARED)
    return boxes.unionByName(others)


def must_not_overlap(polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """The area shared by each unordered pair of polygons, the smaller key first."""
    order = F.struct("a_fid", "a_part") < F.struct("b_fid", "b_part")
    return _shared(grid_join(_prepared(polygons), order=order, cell=cell))


def must_not_overlap_with(polygons: DataFrame, other: DataFrame, cell: float | None = None) -> DataFrame:
    """The area shared by each polygon of one input with each of the other."""
    return _shared(grid_join(_prepared(polygons), _prepared(other), cell=cell))


_ENDS = ("lx", "ly", "hx", "hy")
#: Columns with the ones they are taken from, of edges as they stand and of turned ones.
_UNDIRECTED = (("lx", "x1", "x2"), ("ly", "y1", "y2"), ("hx", "x2", "x1"), ("hy", "y2", "y1"))
_DIRECTED = (("x1", "lx", "hx"), ("y1", "ly", "hy"), ("x2", "hx", "lx"), ("y2", "hy", "ly"))


def must_not_have_gaps(polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """Edges that contain no other edge: ``fid, x1, y1, x2, y2``.

    These are the edges that nothing borders on, the outer outline included.
    An edge longer than those it borders on passes while they don't. Edges
    with an equal one (in either direction) pass by an aggregate; only the
    others are joined.
    """
    edges = boundary_segments(polygons)
    turned = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")) > F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    # pinned, as filters on what is made of these would else repeat them in one method that is too long to be compiled
    undirected = pinned(pinned(edges, turned=turned), **{n: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)) for n, a, b in _UNDIRECTED})
    # plain columns and minima are aggregated in hash maps, structures by sorting; of a single edge the minima are its own
    grouped = undirected.groupBy(*_ENDS).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("fid", "part", "seg", "turned")])
    alone = grouped.where("n = 1").select("fid", "part", "seg", *[F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in _DIRECTED])
    shorter = grouped.select(*[F.col(c).alias(n) for c, n in zip(_ENDS, ("x1", "y1", "x2", "y2"))])
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    low, high = F.least(end("a_x1", "a_y1"), end("a_x2", "a_y2")), F.greatest(end("a_x1", "a_y1"), end("a_x2", "a_y2"))
    differs = (low != end("b_x1", "b_y1")) | (high != end("b_x2", "b_y2"))
    pairs = grid_join(with_segment_box(alone), with_segment_box(shorter), cell=cell, sizes=measured(with_segment_box(edges))).where(segment_contains("a_", "b_") & differs)
    held = pairs.select(F.col("a_fid").alias("fid"), F.col("a_part").alias("part"), F.col("a_seg").alias("seg")).distinct()
    return alone.join(held, ["fid", "part", "seg"], "left_anti").select("fid", "x1", "y1", "x2", "y2")
