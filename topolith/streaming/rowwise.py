"""Row transforms on streams.

Transforms that look at one row at a time carry over as they are; rules that
compare rows need all of them and don't. Points can be held against a fixed
table of polygons, as the polygons' side of that join doesn't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point_in_polygon, ring_edges
from ..operators.transforms import drop_empty_segments, endpoints, explode_lines, flatten_lines, flatten_points, flatten_polygons, inner_points, multiparts

TRANSFORMS = {f.__name__: f for f in (flatten_points, flatten_lines, flatten_polygons, explode_lines, endpoints, inner_points, drop_empty_segments, multiparts)}


def apply(stream: DataFrame, *names: str) -> DataFrame:
    """Transforms by name, one after the other."""
    for name in names:
        stream = TRANSFORMS[name](stream)
    return stream


def points_outside(stream: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points of a stream that are strictly inside none of a fixed table's polygons.

    A polygon is entered in each tile of side ``cell`` that its box meets, so
    the stream's side needs one tile and no state.
    """
    xs, ys = F.transform(F.get("rings", F.lit(0)), lambda c: c["x"]), F.transform(F.get("rings", F.lit(0)), lambda c: c["y"])
    tile = lambda c: F.floor(c / F.lit(cell)).cast("long")
    tiles = (
        polygons.select(ring_edges(F.col("rings")).alias("edges"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
        .withColumn("cx", F.explode(F.sequence(tile(F.col("x0")), tile(F.col("x1")))))
        .withColumn("cy", F.explode(F.sequence(tile(F.col("y0")), tile(F.col("y1")))))
    )
    placed = stream.withColumn("cx", tile(F.col("x"))).withColumn("cy", tile(F.col("y")))
    inside = (placed["cx"] == tiles["cx"]) & (placed["cy"] == tiles["cy"]) & point_in_polygon(placed["x"], placed["y"], tiles["edges"])
    return placed.join(tiles, inside, "left_anti").drop("cx", "cy")
