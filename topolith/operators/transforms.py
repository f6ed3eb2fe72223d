"""Row transforms: from features to points, lines, polygons and segments.

Keys: ``fid`` names a feature, ``part`` a part of it, ``seg`` a segment of a
line. Coordinates that are not numbers are left out where flat tables are
made, as nothing is equal to them. All transforms work row by row, so they
also run on streams, but for ``dedup_segments``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clean, coord, ring_edges
from ..schema import LINE_KINDS, MULTI_KINDS, POINT_KINDS, POLYGON_KINDS


def _parts(features: DataFrame, kinds: tuple[str, ...], wanted: str) -> DataFrame:
    """One row for each part; a feature of another kind is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"not {wanted}: feature "), F.col("fid").cast("string"), F.lit(" is a "), F.coalesce("kind", F.lit("null"))))
    checked = features.select("fid", F.when(F.col("kind").isin(*kinds), F.col("parts")).otherwise(wrong.cast(features.schema["parts"].dataType)).alias("parts"))
    return checked.select("fid", F.posexplode("parts").alias("part", "p"))


def flatten_points(features: DataFrame) -> DataFrame:
    """``fid, part, x, y`` of points and multipoints."""
    parts = _parts(features, POINT_KINDS, "a point")
    xy = F.element_at("p.coords", 1)
    return parts.select("fid", "part", clean(xy["x"]).alias("x"), clean(xy["y"]).alias("y")).where("not isnan(x) and not isnan(y)")


def flatten_lines(features: DataFrame) -> DataFrame:
    """``fid, part, coords`` of linestrings and multilinestrings."""
    return _parts(features, LINE_KINDS, "a line").select("fid", "part", F.col("p.coords").alias("coords"))


def flatten_polygons(features: DataFrame) -> DataFrame:
    """``fid, part, rings`` of polygons and multipolygons."""
    return _parts(features, POLYGON_KINDS, "a polygon").select("fid", "part", F.col("p.rings").alias("rings"))


def _pairs(coords: Column) -> Column:
    n = F.size(coords) - 1
    return F.zip_with(
        F.slice(coords, F.lit(1), n),
        F.slice(coords, F.lit(2), n),
        lambda p, q: F.struct(clean(p["x"]).alias("x1"), clean(p["y"]).alias("y1"), clean(q["x"]).alias("x2"), clean(q["y"]).alias("y2")),
    )


def explode_lines(lines: DataFrame) -> DataFrame:
    """Each line's segments, in its direction: ``fid, part, seg, x1, y1, x2, y2``; repeats stay."""
    out = lines.where(F.size("coords") > 1).select("fid", "part", F.posexplode(_pairs(F.col("coords"))).alias("seg", "s"))
    return out.select("fid", "part", "seg", "s.x1", "s.y1", "s.x2", "s.y2").where("not (isnan(x1) or isnan(y1) or isnan(x2) or isnan(y2))")


def endpoints(lines: DataFrame) -> DataFrame:
    """First and last vertex of each line; repeats stay. A line of fewer than two vertices is an error."""
    short = F.raise_error(F.concat(F.lit("fewer than two vertices: line "), F.col("fid").cast("string")))
    c = F.when(F.size("coords") > 1, F.col("coords")).otherwise(short.cast(lines.schema["coords"].dataType))
    ends = F.array(F.element_at(c, 1), F.element_at(c, -1))
    return lines.select("fid", "part", F.posexplode(ends).alias("end", "c")).select("fid", "part", "end", clean(F.col("c.x")).alias("x"), clean(F.col("c.y")).alias("y"))


def inner_points(lines: DataFrame) -> DataFrame:
    """Vertices strictly between the first and the last; a ring's seam isn't one."""
    inner = F.slice("coords", F.lit(2), F.greatest(F.size("coords") - 2, F.lit(0)))
    return lines.select("fid", "part", F.posexplode(inner).alias("at", "c")).select("fid", "part", "at", clean(F.col("c.x")).alias("x"), clean(F.col("c.y")).alias("y"))


def boundaries(polygons: DataFrame) -> DataFrame:
    """Each ring of a polygon as a line: ``fid, part, ring, coords``; ring 0 is the exterior."""
    return polygons.select("fid", "part", F.posexplode("rings").alias("ring", "coords"))


def boundary_segments(polygons: DataFrame) -> DataFrame:
    """All edges of polygons: ``fid, part, seg, x1, y1, x2, y2``."""
    out = polygons.select("fid", "part", F.posexplode(ring_edges(F.col("rings"))).alias("seg", "s"))
    return out.select("fid", "part", "seg", *[clean(F.col(f"s.{n}")).alias(n) for n in ("x1", "y1", "x2", "y2")])


def dedup_segments(segments: DataFrame) -> DataFrame:
    """Exactly equal segments once, the one of the least key; a reversed one is another segment."""
    key = F.struct("fid", "part", "seg")
    least = segments.groupBy("x1", "y1", "x2", "y2").agg(F.min(key).alias("k"))
    return least.select("k.fid", "k.part", "k.seg", "x1", "y1", "x2", "y2")


def drop_empty_segments(segments: DataFrame) -> DataFrame:
    return segments.where("not (x1 = x2 and y1 = y2)")


def multiparts(features: DataFrame) -> DataFrame:
    """Features of a multipart kind, even of a single part."""
    return features.where(F.col("kind").isin(*MULTI_KINDS))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often later expressions use them.

    Projections would be merged and their expressions repeated; a generator of
    one row keeps them apart and stays in generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def line_of(*xy: Column) -> Column:
    """An array of coordinates from x and y in turns."""
    return F.array(*[coord(x, y) for x, y in zip(xy[::2], xy[1::2])])


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The one ring of an axis-aligned box."""
    return F.array(line_of(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0))
