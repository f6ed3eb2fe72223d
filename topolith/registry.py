"""Queries over the topology operators on the fixtures, and the same in plain SQL.

The SQL compares all pairs; it is the yardstick for results, not for plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import SQL, box_polygons, diamond_polygons, ell_polygons, fixture, frame_polygons, kind_features, two_vertex_lines, vertex_lines
from .functions import geometry as g
from .operators import lines, merge, points, polygons, transforms
from .plans import batch, formats
from .schema import RINGS
from .sources import drivers

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _with(*names: str, **more: str) -> str:
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


_LEAD = "lead({0}) OVER (PARTITION BY fid ORDER BY ord) AS {1}"
_STEPS = f"SELECT * FROM (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY ord) - 1 AS seg, x AS x1, y AS y1, {_LEAD.format('x', 'x2')}, {_LEAD.format('y', 'y2')} FROM {{0}}) t WHERE x2 IS NOT NULL"


def _zig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_lines(fixture(spark, sf_dir, "fx_zig"))


def _kinds(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    found = kind_features(fixture(spark, sf_dir, "fx_kinds"))
    return found.where(F.col("kind").isin(*wanted)) if wanted else found


# row transforms


@_query(_with("fx_zig", s=_STEPS.format("fx_zig")) + "SELECT fid, CAST(seg AS BIGINT) AS seg, x1, y1, x2, y2 FROM s")
def explode_linestrings(spark, sf_dir):
    return transforms.explode_lines(_zig(spark, sf_dir)).select("fid", F.col("seg").cast("long").alias("seg"), "x1", "y1", "x2", "y2")


@_query(_with("fx_zig") + "SELECT fid, CAST(CASE ord WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS end_no, x, y FROM fx_zig WHERE ord IN (0, 3)")
def linestring_endpoints(spark, sf_dir):
    return transforms.endpoints(_zig(spark, sf_dir)).select("fid", F.col("end").cast("long").alias("end_no"), "x", "y")


@_query(_with("fx_zig") + "SELECT fid, CAST(ord - 1 AS BIGINT) AS at_no, x, y FROM fx_zig WHERE ord IN (1, 2)")
def linestring_inner_points(spark, sf_dir):
    return transforms.inner_points(_zig(spark, sf_dir)).select("fid", F.col("at").cast("long").alias("at_no"), "x", "y")


@_query(
    _with("fx_kinds")
    + "SELECT fid, CAST(0 AS BIGINT) AS part, x, y FROM fx_kinds WHERE k IN (0, 3) UNION ALL SELECT fid, CAST(1 AS BIGINT), x + 200, y FROM fx_kinds WHERE k = 3"
)
def flatten_points(spark, sf_dir):
    return transforms.flatten_points(_kinds(spark, sf_dir, "Point", "MultiPoint")).select("fid", F.col("part").cast("long").alias("part"), "x", "y")


@_query(
    _with("fx_kinds")
    + "SELECT fid, CAST(0 AS BIGINT) AS part, CAST(3 AS BIGINT) AS n_points, x AS start_x, y AS start_y, 2 * s AS length FROM fx_kinds WHERE k IN (1, 4) "
    "UNION ALL SELECT fid, CAST(1 AS BIGINT), CAST(3 AS BIGINT), x + 200, y, 2 * s FROM fx_kinds WHERE k = 4"
)
def flatten_linestrings(spark, sf_dir):
    flat = transforms.flatten_lines(_kinds(spark, sf_dir, "LineString", "MultiLineString"))
    first = F.element_at("coords", 1)
    return flat.select(
        "fid", F.col("part").cast("long").alias("part"), F.size("coords").cast("long").alias("n_points"), first["x"].alias("start_x"), first["y"].alias("start_y"), g.line_length(F.col("coords")).alias("length")
    )


@_query(
    _with("fx_kinds")
    + "SELECT fid, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_rings, s * s AS area, x + s / 2 AS cx, y + s / 2 AS cy FROM fx_kinds WHERE k IN (2, 5) "
    "UNION ALL SELECT fid, CAST(1 AS BIGINT), CAST(1 AS BIGINT), s * s, x + 200 + s / 2, y + s / 2 FROM fx_kinds WHERE k = 5"
)
def flatten_polygons(spark, sf_dir):
    flat = transforms.flatten_polygons(_kinds(spark, sf_dir, "Polygon", "MultiPolygon"))
    middle = g.ring_centroid(F.get("rings", F.lit(0)))
    return flat.select(
        "fid", F.col("part").cast("long").alias("part"), F.size("rings").cast("long").alias("n_rings"), g.polygon_area(F.col("rings")).alias("area"), F.round(middle["x"], 6).alias("cx"), F.round(middle["y"], 6).alias("cy")
    )


@_query(
    _with("fx_boxes")
    + "SELECT fid, CAST(0 AS BIGINT) AS seg, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM fx_boxes UNION ALL SELECT fid, CAST(1 AS BIGINT), x1, y0, x1, y1 FROM fx_boxes "
    "UNION ALL SELECT fid, CAST(2 AS BIGINT), x1, y1, x0, y1 FROM fx_boxes UNION ALL SELECT fid, CAST(3 AS BIGINT), x0, y1, x0, y0 FROM fx_boxes"
)
def polygon_boundaries(spark, sf_dir):
    return transforms.boundary_segments(box_polygons(fixture(spark, sf_dir, "fx_boxes"))).select("fid", F.col("seg").cast("long").alias("seg"), "x1", "y1", "x2", "y2")


@_query(_with("fx_seg") + "SELECT DISTINCT x1, y1, x2, y2 FROM fx_seg")
def dedup_lines(spark, sf_dir):
    return transforms.dedup_segments(transforms.explode_lines(_seg(spark, sf_dir))).select("x1", "y1", "x2", "y2")


@_query(_with("fx_seg") + "SELECT fid, x1, y1, x2, y2 FROM fx_seg WHERE NOT (x1 = x2 AND y1 = y2)")
def drop_empty_lines(spark, sf_dir):
    return transforms.drop_empty_segments(transforms.explode_lines(_seg(spark, sf_dir))).select("fid", "x1", "y1", "x2", "y2")


@_query(
    _with("fx_kinds")
    + "SELECT fid, CASE k WHEN 0 THEN 'point' WHEN 3 THEN 'point' WHEN 1 THEN 'line' WHEN 4 THEN 'line' WHEN 2 THEN 'polygon' WHEN 5 THEN 'polygon' ELSE 'other' END AS family FROM fx_kinds"
)
def kind_predicates(spark, sf_dir):
    kind = F.col("kind")
    family = F.when(g.is_point(kind), "point").when(g.is_line(kind), "line").when(g.is_polygon(kind), "polygon").otherwise("other")
    return _kinds(spark, sf_dir).select("fid", family.alias("family"))


@_query(_with("fx_kinds") + "SELECT fid, CASE k WHEN 3 THEN 'MultiPoint' WHEN 4 THEN 'MultiLineString' ELSE 'MultiPolygon' END AS kind FROM fx_kinds WHERE k IN (3, 4, 5)")
def must_not_be_multipart(spark, sf_dir):
    return transforms.multiparts(_kinds(spark, sf_dir)).select("fid", "kind")


@_query(_with("fx_vertex", n="SELECT fid, count(*) AS n, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM fx_vertex GROUP BY fid") + "SELECT fid, minx, miny, maxx, maxy FROM n WHERE n > 1")
def line_envelopes(spark, sf_dir):
    found = vertex_lines(fixture(spark, sf_dir, "fx_vertex"))
    return found.select("fid", *[c.alias(n) for n, c in g.envelope(F.col("coords")).items()])


# rules for points


@_query(_with("fx_points") + "SELECT a.x AS x, a.y AS y FROM fx_points a JOIN fx_points b ON a.x = b.x AND a.y = b.y AND a.fid < b.fid")
def point_must_not_overlap(spark, sf_dir):
    return points.must_not_overlap(fixture(spark, sf_dir, "fx_points"))


@_query(_with("fx_points", "fx_points_other") + "SELECT a.fid AS fid, a.x AS x, a.y AS y FROM fx_points a JOIN fx_points_other b ON a.x = b.x AND a.y = b.y")
def point_must_not_overlap_with(spark, sf_dir):
    return points.must_not_overlap_with(fixture(spark, sf_dir, "fx_points"), fixture(spark, sf_dir, "fx_points_other"))


@_query(_with("fx_points", "fx_zones") + "SELECT fid, x, y FROM fx_points p WHERE NOT EXISTS (SELECT 1 FROM fx_zones z WHERE z.fid BETWEEN floor(p.x / 4) - 2 AND floor(p.x / 4) + 1 AND p.x > z.x0 AND p.x < z.x1 AND p.y > z.y0 AND p.y < z.y1)")
def point_must_be_inside(spark, sf_dir):
    return points.must_be_inside(fixture(spark, sf_dir, "fx_points"), box_polygons(fixture(spark, sf_dir, "fx_zones")))


# rules for lines


def _seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_vertex_lines(fixture(spark, sf_dir, "fx_seg"))


def _turn(a: str, p: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({p[0]} - {a}.y1) - ({a}.y2 - {a}.y1) * ({p[1]} - {a}.x1))"


#: Neighbouring squares of a plain grid, for SQL: boxes no wider than a square meet only across these.
_AROUND = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) AS k(i, j)"


def _square(box: int, *ends: str) -> str:
    """The square of the lower left corner of a box, as columns cx and cy."""
    x, y = (", ".join(c + e for e in ends) for c in "xy")
    least = "least({})" if len(ends) > 1 else "{}"
    return f"CAST(floor({least.format(x)} / {box}) AS BIGINT) AS cx, CAST(floor({least.format(y)} / {box}) AS BIGINT) AS cy"


def _near(step: str) -> str:
    """Rows of a step with squares, once for each neighbouring square."""
    return f"SELECT s.*, s.cx + k.i AS nx, s.cy + k.j AS ny FROM {step} s CROSS JOIN {_AROUND}"


def _meetings(source: str, box: int = 8) -> dict[str, str]:
    """Named steps that end in ``m``: all meetings of the distinct segments of a source, none wider or higher than ``box``."""
    lexic = lambda f, x, y: f"CASE WHEN {x}1 < {x}2 OR ({x}1 = {x}2 AND {y}1 <= {y}2) THEN {f}1 ELSE {f}2 END"
    other = lambda f, x, y: f"CASE WHEN {x}1 < {x}2 OR ({x}1 = {x}2 AND {y}1 <= {y}2) THEN {f}2 ELSE {f}1 END"
    touch = "{o} = 0 AND {p}x{i} BETWEEN least({s}x1, {s}x2) AND greatest({s}x1, {s}x2) AND {p}y{i} BETWEEN least({s}y1, {s}y2) AND greatest({s}y1, {s}y2)"
    touches = [touch.format(o=o, p=p, i=i, s=s) for o, p, i, s in (("o1", "b", 1, "a"), ("o2", "b", 2, "a"), ("o3", "a", 1, "b"), ("o4", "a", 2, "b"))]
    proper = "((o1 > 0 AND o2 < 0) OR (o1 < 0 AND o2 > 0)) AND ((o3 > 0 AND o4 < 0) OR (o3 < 0 AND o4 > 0))"
    line = "o1 = 0 AND o2 = 0 AND o3 = 0 AND o4 = 0"
    before = "lx < hx OR (lx = hx AND ly < hy)"
    ends = [("b", 1), ("b", 2), ("a", 1), ("a", 2)]
    at = lambda c: " ".join(f"WHEN {t} THEN {p}{c}{i}" for t, (p, i) in zip(touches, ends))
    return {
        "d": f"SELECT DISTINCT x1, y1, x2, y2 FROM {source} WHERE NOT (x1 = x2 AND y1 = y2)",
        "e": f"SELECT *, {_square(box, '1', '2')}, {lexic('x', 'x', 'y')} AS sx, {lexic('y', 'x', 'y')} AS sy, {other('x', 'x', 'y')} AS tx, {other('y', 'x', 'y')} AS ty FROM d",
        "n": _near("e"),
        "p": f"""SELECT a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
            {_turn("a", ("b.y1", "b.x1"))} AS o1, {_turn("a", ("b.y2", "b.x2"))} AS o2, {_turn("b", ("a.y1", "a.x1"))} AS o3, {_turn("b", ("a.y2", "a.x2"))} AS o4,
            CASE WHEN a.sx > b.sx OR (a.sx = b.sx AND a.sy > b.sy) THEN a.sx ELSE b.sx END AS lx,
            CASE WHEN a.sx > b.sx OR (a.sx = b.sx AND a.sy > b.sy) THEN a.sy ELSE b.sy END AS ly,
            CASE WHEN a.tx < b.tx OR (a.tx = b.tx AND a.ty < b.ty) THEN a.tx ELSE b.tx END AS hx,
            CASE WHEN a.tx < b.tx OR (a.tx = b.tx AND a.ty < b.ty) THEN a.ty ELSE b.ty END AS hy
            FROM n a JOIN e b ON b.cx = a.nx AND b.cy = a.ny AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
            AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
            AND (a.x1 < b.x1 OR (a.x1 = b.x1 AND (a.y1 < b.y1 OR (a.y1 = b.y1 AND (a.x2 < b.x2 OR (a.x2 = b.x2 AND a.y2 < b.y2))))))""",
        "q": f"""SELECT *, CASE WHEN {line} AND ({before}) THEN 'collinear' WHEN {line} AND lx = hx AND ly = hy THEN 'improper' WHEN {line} THEN NULL
            WHEN {proper} THEN 'proper' {" ".join(f"WHEN {t} THEN 'improper'" for t in touches)} END AS kind FROM p""",
        "m": f"""SELECT kind, hx AS to_x, hy AS to_y,
            CASE WHEN {line} THEN lx WHEN kind = 'proper' THEN ax1 + o3 / (o3 - o4) * (ax2 - ax1) {at("x")} END AS x,
            CASE WHEN {line} THEN ly WHEN kind = 'proper' THEN ay1 + o3 / (o3 - o4) * (ay2 - ay1) {at("y")} END AS y
            FROM q WHERE kind IS NOT NULL""",
    }


_VERTEX_STEPS = _STEPS.format("fx_vertex")


@_query(_with("fx_seg", **_meetings("fx_seg")) + "SELECT kind, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM m")
def segment_intersections(spark, sf_dir):
    found = lines.segment_meetings(transforms.explode_lines(_seg(spark, sf_dir)))
    return found.select("kind", g.clean(F.round("x", 6)).alias("x"), g.clean(F.round("y", 6)).alias("y"))


@_query(_with("fx_seg", **_meetings("fx_seg")) + "SELECT kind, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM m")
def segment_intersections_robust(spark, sf_dir):
    found = lines.segment_meetings(transforms.explode_lines(_seg(spark, sf_dir)), robust=True)
    return found.select("kind", g.clean(F.round("x", 6)).alias("x"), g.clean(F.round("y", 6)).alias("y"))


@_query(_with("fx_seg", **_meetings("fx_seg")) + "SELECT x AS x1, y AS y1, to_x AS x2, to_y AS y2 FROM m WHERE kind = 'collinear'")
def line_must_not_overlap(spark, sf_dir):
    return lines.must_not_overlap(_seg(spark, sf_dir))


def _contained(a: str, b: str) -> str:
    """SQL: segment a holds segment b."""
    box = " AND ".join(f"{b}.{c}{i} BETWEEN least({a}.{c}1, {a}.{c}2) AND greatest({a}.{c}1, {a}.{c}2)" for c in "xy" for i in (1, 2))
    return f"{box} AND {_turn(a, (f'{b}.y1', f'{b}.x1'))} = 0 AND {_turn(a, (f'{b}.y2', f'{b}.x2'))} = 0"


@_query(
    _with("fx_seg", "fx_seg_other", p=f"SELECT *, {_square(8, '1', '2')} FROM fx_seg", q=f"SELECT *, {_square(8, '1', '2')} FROM fx_seg_other", n=_near("p"))
    + f"SELECT b.fid AS fid, b.x1 + 0.0 AS x1, b.y1 + 0.0 AS y1, b.x2 + 0.0 AS x2, b.y2 + 0.0 AS y2 FROM n a JOIN q b ON b.cx = a.nx AND b.cy = a.ny AND {_contained('a', 'b')} "
    "WHERE NOT (a.x1 = a.x2 AND a.y1 = a.y2) AND NOT (b.x1 = b.x2 AND b.y1 = b.y2)"
)
def line_must_not_overlap_with(spark, sf_dir):
    return lines.must_not_overlap_with(_seg(spark, sf_dir), two_vertex_lines(fixture(spark, sf_dir, "fx_seg_other")))


@_query(
    _with("fx_zig", s=_STEPS.format("fx_zig"))
    + f"SELECT b.fid AS fid, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM s a JOIN s b ON a.fid = b.fid AND a.seg <> b.seg AND {_contained('a', 'b')} "
    "WHERE NOT (b.x1 = b.x2 AND b.y1 = b.y2 AND ((b.x1 = a.x1 AND b.y1 = a.y1) OR (b.x1 = a.x2 AND b.y1 = a.y2)))"
)
def line_must_not_self_overlap(spark, sf_dir):
    return lines.must_not_self_overlap(_zig(spark, sf_dir))


_INNER = "SELECT x, y FROM (SELECT fid, x, y, row_number() OVER (PARTITION BY fid ORDER BY ord) AS r, count(*) OVER (PARTITION BY fid) AS n FROM fx_vertex) t WHERE r > 1 AND r < n"


@_query(
    _with("fx_vertex", s=_VERTEX_STEPS, **_meetings("s", 64), i=f"SELECT x, y FROM ({_INNER}) v GROUP BY x, y HAVING count(*) > 1")
    + "SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM m WHERE kind = 'proper' UNION SELECT m.x, m.y FROM m JOIN i ON m.x = i.x AND m.y = i.y WHERE kind = 'improper'"
)
def line_must_not_intersect_points(spark, sf_dir):
    return lines.must_not_intersect(vertex_lines(fixture(spark, sf_dir, "fx_vertex")), digits=6)[0]


@_query(_with("fx_vertex", s=_VERTEX_STEPS, **_meetings("s", 64)) + "SELECT x AS x1, y AS y1, to_x AS x2, to_y AS y2 FROM m WHERE kind = 'collinear'")
def line_must_not_intersect_lines(spark, sf_dir):
    return lines.must_not_intersect(vertex_lines(fixture(spark, sf_dir, "fx_vertex")))[1]


def _dangles(name: str) -> str:
    return (
        _with(name, **_meetings(name), ends=f"SELECT fid, x1 AS x, y1 AS y FROM {name} UNION ALL SELECT fid, x2, y2 FROM {name}")
        + "SELECT fid, x + 0.0 AS x, y + 0.0 AS y FROM ends WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.kind = 'improper' AND m.x = ends.x AND m.y = ends.y)"
    )


@_query(_dangles("fx_chain"))
def line_must_not_have_dangles(spark, sf_dir):
    return lines.must_not_have_dangles(two_vertex_lines(fixture(spark, sf_dir, "fx_chain")))


@_query(_dangles("fx_seg"))
def line_must_not_have_dangles_crossing(spark, sf_dir):
    return lines.must_not_have_dangles(_seg(spark, sf_dir))


@_query(
    _with("fx_seg", "fx_zones2")
    + """SELECT fid, x1, y1, x2, y2 FROM fx_seg s WHERE NOT (x1 = x2 AND y1 = y2) AND NOT EXISTS (SELECT 1 FROM fx_zones2 z
    WHERE z.fid BETWEEN floor(s.x1 / 20) - 2 AND floor(s.x1 / 20) + 1 AND s.x1 BETWEEN z.x0 AND z.x1 AND s.x2 BETWEEN z.x0 AND z.x1 AND s.y1 BETWEEN z.y0 AND z.y1 AND s.y2 BETWEEN z.y0 AND z.y1
    AND NOT (s.x1 = s.x2 AND (s.x1 = z.x0 OR s.x1 = z.x1)) AND NOT (s.y1 = s.y2 AND (s.y1 = z.y0 OR s.y1 = z.y1)))"""
)
def line_must_be_inside(spark, sf_dir):
    segs = transforms.drop_empty_segments(fixture(spark, sf_dir, "fx_seg"))
    out = lines.must_be_inside(two_vertex_lines(segs), box_polygons(fixture(spark, sf_dir, "fx_zones2")))
    return _two_ends(out)


def _two_ends(found: DataFrame) -> DataFrame:
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    return found.select("fid", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


# rules for polygons


def _boxes_of(shared: DataFrame) -> DataFrame:
    ring = F.get("rings", F.lit(0))
    box = g.envelope(ring)
    return shared.select("fid_a", "fid_b", *[box[n].alias(n) for n in ("minx", "miny", "maxx", "maxy")], g.polygon_area(F.col("rings")).alias("area"))


_OVERLAP = """SELECT a.fid AS fid_a, b.fid AS fid_b, greatest(a.x0, b.x0) AS minx, greatest(a.y0, b.y0) AS miny, least(a.x1, b.x1) AS maxx, least(a.y1, b.y1) AS maxy,
    (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
    FROM {0} a JOIN {1} b ON greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)"""


@_query(_with("fx_boxes") + _OVERLAP.format("fx_boxes", "fx_boxes") + " AND a.fid < b.fid")
def polygon_must_not_overlap(spark, sf_dir):
    return _boxes_of(polygons.must_not_overlap(box_polygons(fixture(spark, sf_dir, "fx_boxes"))))


@_query(_with("fx_boxes", "fx_boxes_other") + _OVERLAP.format("fx_boxes", "fx_boxes_other"))
def polygon_must_not_overlap_with(spark, sf_dir):
    a, b = (box_polygons(fixture(spark, sf_dir, n)) for n in ("fx_boxes", "fx_boxes_other"))
    return _boxes_of(polygons.must_not_overlap_with(a, b))


@_query(
    _with("fx_boxes", t=_OVERLAP.format("fx_boxes", "fx_boxes") + " AND a.fid < b.fid") + "SELECT fid_a, fid_b, area FROM t"
)
def polygon_must_not_overlap_general(spark, sf_dir):
    """The same boxes with a vertex in the middle of a side, so that no closed form takes them; convex, they are cut by each other's edges."""
    boxes = fixture(spark, sf_dir, "fx_boxes")
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    ring = transforms.line_of(c[0], c[1], (c[0] + c[2]) / 2, c[1], c[2], c[1], c[2], c[3], c[0], c[3], c[0], c[1])
    return _shared_area(polygons.must_not_overlap(boxes.select("fid", F.lit(0).alias("part"), F.array(ring).alias("rings"))))


def _shared_area(shared: DataFrame) -> DataFrame:
    """What two polygons share may be several pieces; their areas are added."""
    return shared.groupBy("fid_a", "fid_b").agg(F.sum(g.polygon_area(F.col("rings"))).alias("area"))


def _common(a: str, b: str) -> str:
    """SQL: the area that boxes with columns x0, y0, x1, y1 share."""
    return f"greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"


_ELL_BOXES = "SELECT fid, x AS x0, y AS y0, x + w AS x1, y + 2 AS y1 FROM {0} UNION ALL SELECT fid, x, y + 2, x + 2, y + h FROM {0}"


@_query(
    _with("fx_ells", b=_ELL_BOXES.format("fx_ells"), c=f"SELECT *, {_square(8, '0')} FROM b")
    + f"SELECT a.fid AS fid_a, b.fid AS fid_b, sum({_common('a.', 'b.')}) AS area FROM c a CROSS JOIN {_AROUND} JOIN c b ON b.cx = a.cx + k.i AND b.cy = a.cy + k.j AND a.fid < b.fid GROUP BY a.fid, b.fid HAVING sum({_common('a.', 'b.')}) > 0"
)
def polygon_must_not_overlap_ells(spark, sf_dir):
    """L-shapes, which no closed form and no convex cut takes; SQL adds up the boxes they are made of."""
    return _shared_area(polygons.must_not_overlap(ell_polygons(fixture(spark, sf_dir, "fx_ells"))))


_FRAMED = " - ".join([_common("a.", "b."), _common("a.h", "b."), _common("a.", "b.h")]) + " + " + _common("a.h", "b.h")


@_query(
    _with("fx_frames", f="SELECT fid, x AS x0, y AS y0, x + s AS x1, y + s AS y1, x + 2 AS hx0, y + 2 AS hy0, x + 4 AS hx1, y + 4 AS hy1 FROM fx_frames", c=f"SELECT *, {_square(8, '0')} FROM f")
    + f"SELECT a.fid AS fid_a, b.fid AS fid_b, {_FRAMED} AS area FROM c a CROSS JOIN {_AROUND} JOIN c b ON b.cx = a.cx + k.i AND b.cy = a.cy + k.j AND a.fid < b.fid WHERE {_FRAMED} > 0"
)
def polygon_must_not_overlap_frames(spark, sf_dir):
    """Boxes with holes; SQL counts boxes less holes."""
    return _shared_area(polygons.must_not_overlap(frame_polygons(fixture(spark, sf_dir, "fx_frames"))))


@_query(
    _with("fx_diamonds", d="SELECT fid, x + y - r AS x0, x - y - r AS y0, x + y + r AS x1, x - y + r AS y1 FROM fx_diamonds", c=f"SELECT *, {_square(16, '0')} FROM d")
    + f"SELECT a.fid AS fid_a, b.fid AS fid_b, ({_common('a.', 'b.')}) / 2 AS area FROM c a CROSS JOIN {_AROUND} JOIN c b ON b.cx = a.cx + k.i AND b.cy = a.cy + k.j AND a.fid < b.fid WHERE {_common('a.', 'b.')} > 0"
)
def polygon_must_not_overlap_slanted(spark, sf_dir):
    """Squares on their corners; SQL turns them by 45 degrees."""
    return _shared_area(polygons.must_not_overlap(diamond_polygons(fixture(spark, sf_dir, "fx_diamonds"))))


@_query(
    _with("fx_level", "fx_diamonds")
    + """SELECT fid, x1, y1, x2, y2 FROM fx_level s WHERE NOT EXISTS (SELECT 1 FROM fx_diamonds d
    WHERE d.x BETWEEN s.x1 - 6 AND s.x1 + 6 AND abs(s.x1 - d.x) + abs(s.y1 - d.y) <= d.r AND abs(s.x2 - d.x) + abs(s.y2 - d.y) <= d.r)"""
)
def line_must_be_inside_slanted(spark, sf_dir):
    """Level and upright lines, which never run along a slanted edge."""
    return _two_ends(lines.must_be_inside(two_vertex_lines(fixture(spark, sf_dir, "fx_level")), diamond_polygons(fixture(spark, sf_dir, "fx_diamonds"))))


@_query(
    _with("fx_level", "fx_ells")
    + """SELECT fid, x1, y1, x2, y2 FROM fx_level s WHERE NOT EXISTS (SELECT 1 FROM fx_ells e WHERE e.x BETWEEN s.x1 - 8 AND s.x1 + 8 AND
    CASE WHEN y1 = y2 THEN s.x1 >= e.x AND s.y1 > e.y AND s.y1 < e.y + e.h AND s.x2 <= e.x + CASE WHEN s.y1 <= e.y + 2 THEN e.w ELSE 2 END AND NOT (s.y1 = e.y + 2 AND s.x1 >= e.x + 2)
    ELSE s.y1 >= e.y AND s.x1 > e.x AND s.x1 < e.x + e.w AND s.y2 <= e.y + CASE WHEN s.x1 <= e.x + 2 THEN e.h ELSE 2 END AND NOT (s.x1 = e.x + 2 AND s.y1 >= e.y + 2) END)"""
)
def line_must_be_inside_ells(spark, sf_dir):
    """Level and upright lines against L-shapes, along their edges and through their corners too."""
    return _two_ends(lines.must_be_inside(two_vertex_lines(fixture(spark, sf_dir, "fx_level")), ell_polygons(fixture(spark, sf_dir, "fx_ells"))))


_SIDES = """SELECT fid, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2 FROM fx_cells UNION ALL SELECT fid, x1, y0, x1, y1 FROM fx_cells
    UNION ALL SELECT fid, x1, y1, x0, y1 FROM fx_cells UNION ALL SELECT fid, x0, y1, x0, y0 FROM fx_cells"""


@_query(
    _with("fx_cells", s=_SIDES)
    + f"SELECT fid, x1, y1, x2, y2 FROM s a WHERE (SELECT count(*) FROM s b WHERE {_contained('a', 'b')}) < 2"
)
def polygon_must_not_have_gaps(spark, sf_dir):
    return polygons.must_not_have_gaps(box_polygons(fixture(spark, sf_dir, "fx_cells")))


# merging

_MERGE = f"""WITH RECURSIVE fx_chain AS ({SQL["fx_chain"]}),
ends AS (SELECT fid, x1 AS x, y1 AS y FROM fx_chain UNION ALL SELECT fid, x2, y2 FROM fx_chain),
free AS (SELECT x, y, min(fid) AS a, max(fid) AS b FROM ends GROUP BY x, y HAVING count(DISTINCT fid) = 2),
link AS (SELECT a, b FROM free UNION ALL SELECT b, a FROM free),
reach AS (SELECT fid, fid AS other FROM fx_chain UNION SELECT r.fid, l.b FROM reach r JOIN link l ON r.other = l.a),
part AS (SELECT fid, min(other) AS component FROM reach GROUP BY fid)
SELECT CAST(component AS BIGINT) AS fid, CAST(count(*) AS BIGINT) AS members, CAST(count(*) + 1 AS BIGINT) AS n_points, sum(abs(x2 - x1) + abs(y2 - y1)) AS length
FROM part JOIN fx_chain USING (fid) GROUP BY component"""


@_query(_MERGE)
def merge_linestrings(spark, sf_dir):
    merged = merge.merge_lines(two_vertex_lines(fixture(spark, sf_dir, "fx_chain")))
    return merged.select("fid", "members", F.size("coords").cast("long").alias("n_points"), g.line_length(F.col("coords")).alias("length"))


_CORNER = {a + b: f"({'x' if a == 'l' else 'x + 2'}) || ' ' || ({'y' if b == 'l' else 'y + 2'})" for a in "lh" for b in "lh"}
_STICK = "(x + 2) || '.5 ' || (y + 2) || '.5'"


def _through(*at: str) -> str:
    return " || ', ' || ".join(_CORNER.get(a, a) for a in at)


@_query(
    f"""WITH corner AS (SELECT p_partkey AS k, p_partkey % 100 * 3 AS x, CAST(floor(p_partkey / 100) AS BIGINT) * 3 AS y FROM part)
    SELECT CAST(k * 5 AS BIGINT) AS fid, CAST(5 AS BIGINT) AS members, 'LINESTRING (' || {_through("hh", "lh", "ll", "hl", "hh", _STICK)} || ')' AS wkt FROM corner WHERE k % 3 = 0
    UNION ALL SELECT CAST(k * 5 AS BIGINT), CAST(4 AS BIGINT), 'LINESTRING (' || {_through("ll", "lh", "hh", "hl", "ll")} || ')' FROM corner WHERE k % 3 <> 0
    UNION ALL SELECT CAST(k * 5 + 4 AS BIGINT), CAST(1 AS BIGINT), 'LINESTRING (' || (x + 2) || '.25 ' || (y + 2) || '.25, ' || {_STICK} || ')' FROM corner WHERE k % 3 <> 0"""
)
def merge_rings(spark, sf_dir):
    """Sides of squares become rings; one that a stick ends on begins there, and the stick goes on from it in the next round."""
    merged = merge.merge_lines(two_vertex_lines(fixture(spark, sf_dir, "fx_ring")))
    parts = F.array(F.struct("coords", F.lit(None).cast(RINGS).alias("rings")))
    return merged.select("fid", "members", formats.to_wkt(F.lit("LineString"), parts).alias("wkt"))


# reports, drivers and formats


def _report_specs(spark: SparkSession, sf_dir: str) -> list[batch.RuleSpec]:
    boxes = lambda n: box_polygons(fixture(spark, sf_dir, n))
    return [
        batch.RuleSpec("point", "must-not-overlap", {"points": fixture(spark, sf_dir, "fx_points")}),
        batch.RuleSpec("point", "must-be-inside", {"points": fixture(spark, sf_dir, "fx_points"), "polygons": boxes("fx_zones")}),
        batch.RuleSpec("line", "must-not-have-dangles", {"lines": two_vertex_lines(fixture(spark, sf_dir, "fx_chain"))}),
        batch.RuleSpec("polygon", "must-not-overlap", {"polygons": boxes("fx_boxes")}),
        batch.RuleSpec("polygon", "must-not-have-gaps", {"polygons": boxes("fx_cells")}),
        batch.RuleSpec("geometry", "must-not-be-multipart", {"features": _kinds(spark, sf_dir)}),
    ]


def _count(rule: str, kind: str, key: str) -> str:
    body = _SQL[key]
    return f"SELECT '{rule}' AS rule, '{kind}' AS kind, CAST(count(*) AS BIGINT) AS n FROM ({body}) t"


@_query(
    "SELECT rule, kind, n FROM ("
    + " UNION ALL ".join(
        [
            _count("1-must-not-overlap", "Point", "point_must_not_overlap"),
            _count("2-must-be-inside", "Point", "point_must_be_inside"),
            _count("3-must-not-have-dangles", "Point", "line_must_not_have_dangles"),
            _count("4-must-not-overlap", "Polygon", "polygon_must_not_overlap"),
            _count("5-must-not-have-gaps", "LineString", "polygon_must_not_have_gaps"),
        ]
    )
    + f" UNION ALL SELECT '6-must-not-be-multipart', kind, CAST(count(*) AS BIGINT) FROM ({_SQL['must_not_be_multipart']}) t GROUP BY kind) u WHERE n > 0"
)
def rule_summary(spark, sf_dir):
    return batch.summary(batch.run_batch(_report_specs(spark, sf_dir)))


@_query(_with("fx_points", e="SELECT a.x AS x, a.y AS y FROM fx_points a JOIN fx_points b ON a.x = b.x AND a.y = b.y AND a.fid < b.fid") + "SELECT 'must-not-overlap' AS rule, 'Point' AS kind, 'POINT (' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ')' AS wkt FROM e")
def batch_report(spark, sf_dir):
    found = batch.run_rule(batch.RuleSpec("point", "must-not-overlap", {"points": fixture(spark, sf_dir, "fx_points")}))
    return found.select("rule", "kind", formats.to_wkt(F.col("kind"), F.col("parts")).alias("wkt"))


@_query(
    "SELECT * FROM (VALUES ('GeoJSON', 'geojson json', TRUE, TRUE), ('GeoJSONSeq', 'geojsonl geojsons', TRUE, TRUE), ('ESRI Shapefile', 'shp', TRUE, TRUE), "
    "('GPKG', 'gpkg', TRUE, TRUE), ('CSV', 'csv', TRUE, TRUE), ('Parquet', 'parquet', TRUE, TRUE)) AS t(driver, extensions, can_read, can_write)"
)
def list_drivers(spark, sf_dir):
    return drivers.list_drivers(spark)


@_query(_with("fx_kinds") + "SELECT fid, 'POINT (' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ')' AS wkt FROM fx_kinds WHERE k = 0")
def geojson_round_trip(spark, sf_dir):
    """Points written as GeoJSON text and parsed again."""
    found = _kinds(spark, sf_dir, "Point").select("fid", formats.to_geojson(F.col("kind"), F.col("parts")).alias("geometry"))
    back = formats.from_geojson(found, "geometry")
    return back.select("fid", formats.to_wkt(F.col("kind"), F.col("parts")).alias("wkt"))

