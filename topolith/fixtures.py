"""Geometry made from plain tables, for tests and registered queries.

The statements run alike in Spark and in other SQL engines. Coordinates are
integers or halves, so that orientation is exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.transforms import box_rings, line_of

TABLES = ("customer", "supplier", "nation", "part", "orders", "lineitem", "events")

SQL = {
    "fx_points": """
        SELECT c_custkey AS fid, CAST(floor(c_custkey / 4) AS DOUBLE) AS x, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 7 AS DOUBLE) AS y
        FROM customer""",
    "fx_points_other": """
        SELECT s_suppkey AS fid, CAST(s_suppkey * 4 AS DOUBLE) AS x, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 7 AS DOUBLE) AS y
        FROM supplier""",
    "fx_zones": """
        SELECT CAST(s_suppkey AS BIGINT) AS fid, CAST(s_suppkey * 4 AS DOUBLE) AS x0, CAST(s_suppkey % 3 AS DOUBLE) AS y0,
               CAST(s_suppkey * 4 + 5 AS DOUBLE) AS x1, CAST(s_suppkey % 3 + 3 AS DOUBLE) AS y1
        FROM supplier""",
    "fx_zones2": """
        SELECT CAST(s_suppkey AS BIGINT) AS fid, CAST(s_suppkey * 20 AS DOUBLE) AS x0, CAST(s_suppkey % 5 * 40 AS DOUBLE) AS y0,
               CAST(s_suppkey * 20 + 18 AS DOUBLE) AS x1, CAST(s_suppkey % 5 * 40 + 36 AS DOUBLE) AS y1
        FROM supplier""",
    # a band 200 high that grows to the right with the table
    "fx_seg": """
        SELECT l_orderkey AS fid, CAST(l_partkey AS DOUBLE) AS x1, CAST(l_suppkey * 3 % 200 AS DOUBLE) AS y1,
               CAST(l_partkey + l_linenumber - 4 AS DOUBLE) AS x2,
               CAST(l_suppkey * 3 % 200 + CAST(floor(l_quantity) AS BIGINT) % 7 - 3 AS DOUBLE) AS y2
        FROM lineitem""",
    "fx_seg_other": """
        SELECT l_orderkey AS fid, CAST(l_partkey AS DOUBLE) AS x1, CAST(l_suppkey * 3 % 200 AS DOUBLE) AS y1,
               CAST(l_partkey + (l_linenumber - 4) / 2.0 AS DOUBLE) AS x2,
               CAST(l_suppkey * 3 % 200 + (CAST(floor(l_quantity) AS BIGINT) % 7 - 3) / 2.0 AS DOUBLE) AS y2
        FROM lineitem""",
    # lines of twenty vertices, each within a window of its own that overlaps its neighbours'
    "fx_vertex": """
        SELECT CAST(floor(event_id / 20) AS BIGINT) AS fid, event_id AS ord, CAST(event_id * 7919 % 31 + CAST(floor(event_id / 20) AS BIGINT) * 20 AS DOUBLE) AS x,
               CAST(CAST(floor(abs(value)) AS BIGINT) % 29 AS DOUBLE) AS y
        FROM events""",
    "fx_zig": """
        SELECT o_orderkey AS fid, v.ord AS ord,
               CAST(CASE v.ord WHEN 0 THEN 0 WHEN 1 THEN 2 + o_custkey % 5 ELSE o_orderkey % 8 + 0.5 END AS DOUBLE) AS x,
               CAST(CASE v.ord WHEN 3 THEN 1 ELSE 0 END AS DOUBLE) AS y
        FROM orders CROSS JOIN (VALUES (0),(1),(2),(3)) AS v(ord)""",
    "fx_boxes": """
        SELECT p_partkey AS fid, CAST(p_partkey * 37 % 1000 + floor(p_partkey / 1000) * 1000 AS DOUBLE) AS x0, CAST(p_partkey * 53 % 997 AS DOUBLE) AS y0,
               CAST(p_partkey * 37 % 1000 + floor(p_partkey / 1000) * 1000 + 1 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 53 % 997 + 1 + p_partkey % 17 AS DOUBLE) AS y1
        FROM part""",
    "fx_boxes_other": """
        SELECT s_suppkey AS fid, CAST(s_suppkey * 41 % 1000 + floor(s_suppkey / 50) * 1000 AS DOUBLE) AS x0, CAST(s_suppkey * 59 % 997 AS DOUBLE) AS y0,
               CAST(s_suppkey * 41 % 1000 + floor(s_suppkey / 50) * 1000 + 60 AS DOUBLE) AS x1, CAST(s_suppkey * 59 % 997 + 60 AS DOUBLE) AS y1
        FROM supplier""",
    # unit cells side by side; those of some sizes are smaller and stand free
    "fx_cells": """
        SELECT p_partkey AS fid, p_partkey % 40 + CASE WHEN p_size % 5 = 0 THEN 0.25E0 ELSE 0.0E0 END AS x0, floor(p_partkey / 40) + CASE WHEN p_size % 5 = 0 THEN 0.25E0 ELSE 0.0E0 END AS y0,
               p_partkey % 40 + CASE WHEN p_size % 5 = 0 THEN 0.75E0 ELSE 1.0E0 END AS x1, floor(p_partkey / 40) + CASE WHEN p_size % 5 = 0 THEN 0.75E0 ELSE 1.0E0 END AS y1
        FROM part""",
    # rows of lines end to end, broken where one is raised; a spur at some nodes, else apart from them
    "fx_chain": """
        SELECT o_orderkey * 2 AS fid, CAST(o_orderkey % 50 AS DOUBLE) AS x1, floor(o_orderkey / 50) + CASE WHEN o_orderkey % 50 = 49 OR o_orderkey % 7 = 0 THEN 0.25E0 ELSE 0.0E0 END AS y1,
               CAST(o_orderkey % 50 + 1 AS DOUBLE) AS x2, floor(o_orderkey / 50) + CASE WHEN o_orderkey % 50 = 49 OR o_orderkey % 7 = 0 THEN 0.25E0 ELSE 0.0E0 END AS y2
        FROM orders
        UNION ALL
        SELECT o_orderkey * 2 + 1 AS fid, o_orderkey % 50 + CASE WHEN o_orderkey % 35 = 3 THEN 0.0E0 ELSE 0.25E0 END, floor(o_orderkey / 50) + CASE WHEN o_orderkey % 35 = 3 THEN 0.0E0 ELSE 0.5E0 END,
               o_orderkey % 50 + CASE WHEN o_orderkey % 35 = 3 THEN 0.0E0 ELSE 0.25E0 END, floor(o_orderkey / 50) + CASE WHEN o_orderkey % 35 = 3 THEN 0.5E0 ELSE 0.75E0 END
        FROM orders""",
    # four sides of a square as lines of their own, two of them backwards, and a line that meets every third square's upper right corner
    "fx_ring": """
        SELECT p_partkey * 5 + v.i AS fid,
               CAST(p_partkey % 100 * 3 + CASE v.i WHEN 1 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS DOUBLE) + CASE WHEN v.i = 4 AND p_partkey % 3 <> 0 THEN 0.25E0 ELSE 0.0E0 END AS x1,
               CAST(floor(p_partkey / 100) * 3 + CASE v.i WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS DOUBLE) + CASE WHEN v.i = 4 AND p_partkey % 3 <> 0 THEN 0.25E0 ELSE 0.0E0 END AS y1,
               CAST(p_partkey % 100 * 3 + CASE v.i WHEN 3 THEN 0 ELSE 2 END AS DOUBLE) + CASE WHEN v.i = 4 THEN 0.5E0 ELSE 0.0E0 END AS x2,
               CAST(floor(p_partkey / 100) * 3 + CASE v.i WHEN 0 THEN 0 ELSE 2 END AS DOUBLE) + CASE WHEN v.i = 4 THEN 0.5E0 ELSE 0.0E0 END AS y2
        FROM part CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS v(i)""",
    # an L: a lying box of width w and height 2, and a standing one of width 2 up to height h
    "fx_ells": """
        SELECT p_partkey AS fid, CAST(floor(p_partkey / 20) * 6 AS DOUBLE) AS x, CAST(p_partkey % 20 * 3 AS DOUBLE) AS y, CAST(3 + p_partkey % 4 AS DOUBLE) AS w, CAST(4 + p_partkey % 3 AS DOUBLE) AS h
        FROM part""",
    # a box of side s with a square hole of side 2 two units in
    "fx_frames": """
        SELECT p_partkey AS fid, CAST(floor(p_partkey / 20) * 5 AS DOUBLE) AS x, CAST(p_partkey % 20 * 4 AS DOUBLE) AS y, CAST(6 + p_partkey % 3 AS DOUBLE) AS s
        FROM part""",
    # a square on its corner, r from its middle
    "fx_diamonds": """
        SELECT p_partkey AS fid, CAST(floor(p_partkey / 20) * 5 AS DOUBLE) AS x, CAST(p_partkey % 20 * 4 AS DOUBLE) AS y, CAST(3 + p_partkey % 3 AS DOUBLE) AS r
        FROM part""",
    # short lines, level or upright, near the shapes above
    "fx_level": """
        SELECT o_orderkey AS fid, CAST(o_custkey % 21 + floor(o_orderkey / 60) * 3 AS DOUBLE) AS x1, CAST(o_orderkey % 60 + 0 AS DOUBLE) AS y1,
               CAST(o_custkey % 21 + floor(o_orderkey / 60) * 3 + CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_custkey % 3 ELSE 0 END AS DOUBLE) AS x2,
               CAST(o_orderkey % 60 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 + o_custkey % 3 END AS DOUBLE) AS y2
        FROM orders""",
    # a feature of each kind in turn; its shape follows from a corner (x, y) and a size s
    "fx_kinds": """
        SELECT p_partkey AS fid, CAST(p_partkey % 7 AS INT) AS k, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(floor(p_partkey / 100) AS DOUBLE) AS y,
               CAST(p_size AS DOUBLE) AS s
        FROM part""",
}

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the tables of a folder; nothing is registered in the session."""
    sql, args = SQL[name], {}
    for t in TABLES:
        if f" {t} " in f"{sql} ".replace("\n", " "):
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = _named(sql, t)
    return spark.sql(sql, **args)


def _named(sql: str, table: str) -> str:
    return sql.replace(f"FROM {table}", "FROM {" + table + "}")


def two_vertex_lines(segments: DataFrame) -> DataFrame:
    """``fid, part, coords`` of rows with ``fid, x1, y1, x2, y2``; rows of one fid become its parts."""
    coords = line_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    listed = segments.groupBy("fid").agg(F.sort_array(F.collect_list(coords)).alias("all"))
    return listed.select("fid", F.posexplode("all").alias("part", "coords"))


def vertex_lines(vertices: DataFrame) -> DataFrame:
    """``fid, part, coords`` of rows with ``fid, ord, x, y``; a line of one vertex is left out."""
    listed = vertices.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("all"))
    coords = F.transform("all", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return listed.where(F.size("all") > 1).select("fid", F.lit(0).alias("part"), coords.alias("coords"))


def box_polygons(boxes: DataFrame) -> DataFrame:
    """``fid, part, rings`` of rows with ``fid, x0, y0, x1, y1``."""
    return boxes.select("fid", F.lit(0).alias("part"), box_rings(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("rings"))


def ell_polygons(ells: DataFrame) -> DataFrame:
    """``fid, part, rings`` of rows of ``fx_ells``."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    ring = line_of(x, y, x + w, y, x + w, y + 2, x + 2, y + 2, x + 2, y + h, x, y + h, x, y)
    return ells.select("fid", F.lit(0).alias("part"), F.array(ring).alias("rings"))


def frame_polygons(frames: DataFrame) -> DataFrame:
    """``fid, part, rings`` of rows of ``fx_frames``: an exterior and a hole."""
    x, y, s = (F.col(c) for c in ("x", "y", "s"))
    outer, hole = (line_of(a, b, a + t, b, a + t, b + t, a, b + t, a, b) for a, b, t in ((x, y, s), (x + 2, y + 2, F.lit(2.0))))
    return frames.select("fid", F.lit(0).alias("part"), F.array(outer, F.reverse(hole)).alias("rings"))


def diamond_polygons(diamonds: DataFrame) -> DataFrame:
    """``fid, part, rings`` of rows of ``fx_diamonds``."""
    x, y, r = (F.col(c) for c in ("x", "y", "r"))
    return diamonds.select("fid", F.lit(0).alias("part"), F.array(line_of(x - r, y, x, y - r, x + r, y, x, y + r, x - r, y)).alias("rings"))


def kind_features(kinds: DataFrame) -> DataFrame:
    """Features of ``fx_kinds``: a point or line or box of size s at (x, y); in multiparts a second one 200 to the right."""
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    no_coords = F.lit(None).cast("array<struct<x:double,y:double>>")
    no_rings = F.lit(None).cast("array<array<struct<x:double,y:double>>>")

    def part(coords=no_coords, rings=no_rings):
        return F.struct(coords.alias("coords"), rings.alias("rings"))

    def shapes(dx: float):
        at = x + F.lit(dx)
        return [part(coords=line_of(at, y)), part(coords=line_of(at, y, at + s, y, at + s, y + s)), part(rings=box_rings(at, y, at + s, y + s))]

    near, far = shapes(0.0), shapes(200.0)
    parts = F.when(F.col("k") == 0, F.array(near[0]))
    for i in (1, 2):
        parts = parts.when(F.col("k") == i, F.array(near[i]))
    for i in range(3):
        parts = parts.when(F.col("k") == i + 3, F.array(near[i], far[i]))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1)
    return kinds.select("fid", kind.alias("kind"), parts.alias("parts"))
