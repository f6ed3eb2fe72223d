"""Rules for points. Inputs: ``fid, x, y`` (and any other columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crosses, on_segment, point_in_polygon, ring_edges
from .grid import grid_join, with_point_box, with_ring_box

_NUMBERS = "x is not null and y is not null and not isnan(x) and not isnan(y)"


def must_not_overlap(points: DataFrame) -> DataFrame:
    """``x, y`` for each unordered pair of coincident points: k of them give k(k-1)/2 rows.

    Counted, not joined, so that a place with very many points costs one
    aggregate; only the rows asked for are made, those of one place by many tasks.
    """
    counts = points.where(_NUMBERS).groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    later = counts.select("x", "y", F.explode(F.expr("sequence(2L, k)")).alias("i")).repartition("x", "y", "i")
    return later.select("x", "y", F.explode(F.expr("sequence(1L, i - 1)")).alias("j")).select("x", "y")


def must_not_overlap_with(points: DataFrame, other: DataFrame) -> DataFrame:
    """The left point for each pair of coincident points of two inputs."""
    right = other.where(_NUMBERS).groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"))
    return points.where(_NUMBERS).join(right, ["x", "y"]).select("fid", "x", "y", F.explode(F.expr("sequence(1L, _n)"))).select("fid", "x", "y")


#: Edges of a polygon that travel with it; those of larger ones are met on their own, in bands of so many.
INLINE, BAND = 64, 16


def must_be_inside(points: DataFrame, polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """Points that are strictly inside no polygon; ``polygons``: ``fid, part, rings``.

    Points that are no numbers lie nowhere and are left out. Candidates are
    places in a polygon's box. Small polygons bring their edges along; of a
    large one only its box travels, and a candidate meets the edges of the
    polygon's band at its height, whose crossings are counted by an aggregate.
    """
    known = points.where(_NUMBERS)
    boxed = with_ring_box(polygons.withColumn("n", F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r) - 1)))
    bands = F.ceil(F.col("n") / F.lit(BAND)).cast("double")
    boxed = boxed.withColumn("step", F.greatest((F.col("maxy") - F.col("miny")) / bands, F.lit(1e-300)))
    own = F.when(F.col("n") <= INLINE, ring_edges(F.col("rings")))
    places = with_point_box(known.select("x", "y").distinct())
    pairs = grid_join(places, boxed.select("fid", "part", "step", "minx", "miny", "maxx", "maxy", own.alias("edges")), cell=cell)
    x, y = F.col("a_x"), F.col("a_y")
    small = pairs.where(F.col("b_edges").isNotNull() & point_in_polygon(x, y, F.col("b_edges"))).select(x.alias("x"), y.alias("y"))

    band = lambda v: F.floor((v - F.col("miny")) / F.col("step"))
    edges = boxed.where(F.col("n") > INLINE).select("fid", "part", "miny", "step", F.explode(ring_edges(F.col("rings"))).alias("e"))
    low, high = F.least(F.col("e.y1"), F.col("e.y2")), F.greatest(F.col("e.y1"), F.col("e.y2"))
    edges = edges.select("fid", "part", "e", F.explode(F.sequence(band(low), band(high))).alias("band"))
    asked = pairs.where(F.col("b_edges").isNull()).select(
        x.alias("x"), y.alias("y"), F.col("b_fid").alias("fid"), F.col("b_part").alias("part"), F.col("b_miny").alias("miny"), F.col("b_step").alias("step")
    )
    e = {n: F.col(f"e.{n}") for n in ("x1", "y1", "x2", "y2")}
    met = asked.withColumn("band", band(F.col("y"))).join(edges.hint("merge"), ["fid", "part", "band"])
    large = (
        met.groupBy("x", "y", "fid", "part")
        .agg(F.bool_or(on_segment(F.col("x"), F.col("y"), *e.values())).alias("on"), F.count_if(crosses(F.col("x"), F.col("y"), *e.values())).alias("n"))
        .where("not on and n % 2 = 1")
        .select("x", "y")
    )
    return known.join(small.unionByName(large).distinct(), ["x", "y"], "left_anti").select("fid", "x", "y")
