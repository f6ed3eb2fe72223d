"""Queries over sources, sinks, reports and commands: written, read back, and the same in plain SQL.

Files go to a folder of their own in the shared folder of the session.
"""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __main__ as commands
from .fixtures import box_polygons, fixture
from .functions import geometry as g
from .operators import transforms
from .operators.materialize import shared_dir
from .plans import batch, formats
from .registry import _kinds, _query, _with
from .schema import RINGS
from .sources import binary, drivers, readers, writers

_SINGLE = ("Point", "LineString", "Polygon")
_ALL = (*_SINGLE, "MultiPoint", "MultiLineString", "MultiPolygon")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/topolith/files/{uuid.uuid4().hex}"


def _wkt(features: DataFrame) -> DataFrame:
    return features.select("kind", formats.to_wkt(F.col("kind"), F.col("parts")).alias("wkt"))


def _shape(family: str, shift: int = 0) -> str:
    """SQL: the coordinates of a part of ``fx_kinds``."""
    at = lambda x, y: f"({x} + {shift}) || ' ' || ({y})"
    if family == "Point":
        return at("x", "y")
    if family == "LineString":
        return "'(' || " + " || ', ' || ".join((at("x", "y"), at("x + s", "y"), at("x + s", "y + s"))) + " || ')'"
    return "'((' || " + " || ', ' || ".join((at("x", "y"), at("x + s", "y"), at("x + s", "y + s"), at("x", "y + s"), at("x", "y"))) + " || '))'"


def _wkt_sql(*kinds: str) -> str:
    """SQL: kind and text of the features of ``fx_kinds`` of some kinds."""
    out = []
    for kind in kinds:
        k = _ALL.index(kind)
        family = _SINGLE[k % 3]
        body = _shape(family) if k < 3 else f"{_shape(family)} || ', ' || {_shape(family, 200)}"
        if k >= 3 or family == "Point":
            body = f"'(' || {body} || ')'"
        out.append(f"SELECT '{kind}' AS kind, '{kind.upper()} ' || {body} AS wkt FROM v WHERE k = {k}")
    return _with("fx_kinds", v="SELECT k, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(s AS BIGINT) AS s FROM fx_kinds") + " UNION ALL ".join(out)


def _read_back(spark: SparkSession, sf_dir: str, name: str, *kinds: str, layers: bool = False) -> DataFrame:
    path = f"{_folder(spark)}/{name}"
    writers.write_features(_kinds(spark, sf_dir, *kinds), path)
    if not layers:
        return _wkt(readers.read_features(spark, path))
    out = None
    for kind in kinds:
        found = _wkt(readers.read_features(spark, path, layer=kind))
        out = found if out is None else out.unionByName(found)
    return out


# sources and sinks


@_query(_wkt_sql(*_ALL))
def source_geojson(spark, sf_dir):
    return _read_back(spark, sf_dir, "a.geojson", *_ALL)


@_query(_wkt_sql(*_ALL))
def source_geojson_lines(spark, sf_dir):
    return _read_back(spark, sf_dir, "a.geojsonl", *_ALL)


@_query(_wkt_sql(*_ALL))
def source_csv(spark, sf_dir):
    return _read_back(spark, sf_dir, "a.csv", *_ALL)


@_query(_wkt_sql(*_ALL))
def source_parquet(spark, sf_dir):
    return _read_back(spark, sf_dir, "a.parquet", *_ALL)


@_query(_wkt_sql(*_ALL))
def source_geopackage(spark, sf_dir):
    """A layer for each kind, read by name."""
    return _read_back(spark, sf_dir, "a.gpkg", *_ALL, layers=True)


@_query(_wkt_sql("MultiPoint"))
def source_shapefile_points(spark, sf_dir):
    return _read_back(spark, sf_dir, "a.shp", "MultiPoint")


@_query(_wkt_sql("LineString", "MultiLineString"))
def source_shapefile_lines(spark, sf_dir):
    return _read_back(spark, sf_dir, "a.shp", "LineString", "MultiLineString")


@_query("SELECT kind, n_rings, area FROM (" + _with("fx_kinds") + "SELECT 'Polygon' AS kind, CAST(1 AS BIGINT) AS n_rings, s * s AS area FROM fx_kinds WHERE k = 2 UNION ALL SELECT 'MultiPolygon', CAST(2 AS BIGINT), 2 * s * s FROM fx_kinds WHERE k = 5) t")
def source_shapefile_polygons(spark, sf_dir):
    """Rings turn round in this format; kind, rings and area stay."""
    path = f"{_folder(spark)}/a.shp"
    writers.write_features(_kinds(spark, sf_dir, "Polygon", "MultiPolygon"), path)
    area = F.aggregate(F.transform("parts", lambda p: g.polygon_area(p["rings"])), F.lit(0.0), lambda a, v: a + v)
    rings = F.aggregate(F.transform("parts", lambda p: F.size(p["rings"])), F.lit(0), lambda a, v: a + v)
    return readers.read_features(spark, path).select("kind", rings.cast("long").alias("n_rings"), area.alias("area"))


@_query(_with("fx_points") + "SELECT fid, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM fx_points")
def source_csv_points(spark, sf_dir):
    """Columns x and y; another column stays an attribute."""
    path = f"{_folder(spark)}/a.csv"
    fixture(spark, sf_dir, "fx_points").select("fid", "x", "y").withColumnRenamed("fid", "name").write.csv(path, header=True)
    found = readers.read_features(spark, path)
    return found.select(F.col("name").cast("long").alias("fid"), formats.to_wkt(F.col("kind"), F.col("parts")).alias("wkt"))


@_query(_wkt_sql(*_ALL))
def source_parquet_binary(spark, sf_dir):
    """Well-known binary in a column."""

    @F.arrow_udf("binary")
    def told(kinds, parts):
        import pyarrow as pa

        return pa.array([binary.to_wkb(k, p) for k, p in zip(kinds.to_pylist(), parts.to_pylist())], pa.binary())

    path = f"{_folder(spark)}/a.parquet"
    _kinds(spark, sf_dir, *_ALL).select(told("kind", "parts").alias("geometry")).write.parquet(path)
    return _wkt(readers.read_features(spark, path))


@_query(_with("fx_kinds") + "SELECT CASE k WHEN 6 THEN 'none' ELSE 'some' END AS geometry, count(*) AS n, count(DISTINCT fid) AS ids FROM fx_kinds GROUP BY CASE k WHEN 6 THEN 'none' ELSE 'some' END")
def materialised_ids(spark, sf_dir):
    """Every feature of a file gets an id of its own, those without a geometry too."""
    path = f"{_folder(spark)}/a.geojsonl"
    writers.write_features(_kinds(spark, sf_dir), path)
    found = readers.require_features(readers.read_features(spark, path))
    return found.groupBy(F.when(F.col("kind").isNull(), "none").otherwise("some").alias("geometry")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fid").alias("ids"))


# reference systems and drivers


@_query("SELECT * FROM (VALUES ('plain', 'none', 'missing', TRUE), ('same', 'EPSG:4326', 'same', TRUE), ('other', 'EPSG:31370', 'different', FALSE)) AS t(file, crs, compared, valid)")
def reference_systems(spark, sf_dir):
    """Probed from files, compared with and validated against EPSG:4326."""
    folder, rows = _folder(spark), []
    for name, epsg in (("plain", None), ("same", 4326), ("other", 31370)):
        writers.write_features(_kinds(spark, sf_dir, "Point"), f"{folder}/{name}.gpkg", epsg=epsg)
        found = readers.probe_crs(spark, f"{folder}/{name}.gpkg")
        try:
            readers.validate_crs(found, "EPSG:4326")
            valid = True
        except ValueError:
            valid = False
        rows.append((name, found or "none", readers.compare_crs(found, "EPSG:4326"), valid))
    return spark.createDataFrame(rows, "file string, crs string, compared string, valid boolean")


@_query(
    "SELECT * FROM (VALUES ('a.json', 'GeoJSON'), ('b.GEOJSON', 'GeoJSON'), ('c.geojsonl', 'GeoJSONSeq'), ('d.geojsons', 'GeoJSONSeq'), ('e.shp', 'ESRI Shapefile'), ('f/g.gpkg', 'GPKG'), "
    "('h.i.csv', 'CSV'), ('j.parquet/', 'Parquet'), ('k.son', 'error'), ('l', 'error'), ('m.d/n', 'error')) AS t(path, driver)"
)
def driver_inference(spark, sf_dir):
    def told(path: str) -> str:
        try:
            return drivers.driver_for(path).name
        except ValueError:
            return "error"

    paths = ["a.json", "b.GEOJSON", "c.geojsonl", "d.geojsons", "e.shp", "f/g.gpkg", "h.i.csv", "j.parquet/", "k.son", "l", "m.d/n"]
    return spark.createDataFrame([(p, told(p)) for p in paths], "path string, driver string")


@_query("SELECT * FROM (VALUES ('a', 'GeoJSON'), ('b', 'GPKG'), ('c', 'ESRI Shapefile')) AS t(path, driver)")
def driver_of_content(spark, sf_dir):
    """Files without extensions."""
    folder, rows = _folder(spark), []
    some = _kinds(spark, sf_dir, "LineString")
    for path, name in (("a", "GeoJSON"), ("b", "GPKG"), ("c", "ESRI Shapefile")):
        writers.write_features(some, f"{folder}/{path}", name)
        rows.append((path, drivers.driver_of_content(spark, f"{folder}/{path}").name))
    return spark.createDataFrame(rows, "path string, driver string")


# errors: export, accessors, reports, commands

_PAIRS = "SELECT a.x AS x, a.y AS y FROM fx_points a JOIN fx_points b ON a.x = b.x AND a.y = b.y AND a.fid < b.fid"


def _point_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.run_rule(batch.RuleSpec("point", "must-not-overlap", {"points": fixture(spark, sf_dir, "fx_points")}))


def _two_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = batch.RuleSpec("polygon", "must-not-have-gaps", {"polygons": box_polygons(fixture(spark, sf_dir, "fx_boxes"))})
    return batch.run_batch([batch.RuleSpec("point", "must-not-overlap", {"points": fixture(spark, sf_dir, "fx_points")}), polygons])


@_query(_with("fx_points", e=_PAIRS) + "SELECT 'must-not-overlap' AS rule, 'Point' AS kind, count(*) AS n FROM e HAVING count(*) > 0")
def error_export(spark, sf_dir):
    """Errors as GeoJSON keep their rule."""
    path = f"{_folder(spark)}/errors.geojson"
    writers.write_features(_point_errors(spark, sf_dir), path)
    rule = F.get_json_object("properties", "$.rule").alias("rule")
    return readers.read_features(spark, path).groupBy(rule, "kind").agg(F.count(F.lit(1)).alias("n"))


@_query(_with("fx_points", e=_PAIRS) + "SELECT 'Point' AS kind, 2 * count(*) + (SELECT count(*) FROM fx_points) AS n FROM e")
def error_export_to_a_known_layer(spark, sf_dir):
    """Errors, twice, go to the layer of their kind that the file has."""
    path = f"{_folder(spark)}/a.gpkg"
    points = fixture(spark, sf_dir, "fx_points")
    writers.write_features(batch._points(points), path, layer="mine")
    for _ in range(2):
        writers.write_features(_point_errors(spark, sf_dir), path, mode="append")
    return readers.read_features(spark, path, layer="mine").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_SIDES = " UNION ALL ".join(
    f"SELECT {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM fx_boxes" for x1, y1, x2, y2 in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x0", "y1", "x1", "y1"), ("x0", "y0", "x0", "y1"))
)
_HELD = "SELECT count(*) FROM s b WHERE b.x1 >= a.x1 AND b.x2 <= a.x2 AND b.y1 >= a.y1 AND b.y2 <= a.y2"
_TWO = {"s": _SIDES, "e": _PAIRS, "gaps": f"SELECT * FROM s a WHERE ({_HELD}) < 2"}


@_query(_with("fx_points", "fx_boxes", **_TWO) + "SELECT 'Point' AS kind, count(*) AS n FROM e UNION ALL SELECT 'LineString', count(*) FROM gaps")
def batch_export(spark, sf_dir):
    """All rules' errors in one file, a layer for each kind."""
    path = f"{_folder(spark)}/errors.gpkg"
    writers.write_features(_two_rules(spark, sf_dir), path, epsg=4326)
    both = readers.read_features(spark, path, layer="Point").unionByName(readers.read_features(spark, path, layer="LineString"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query(_with("fx_points", "fx_boxes", **_TWO) + "SELECT 'Point' AS kind, count(*) AS n, count(*) = 0 AS valid FROM e UNION ALL SELECT 'LineString', count(*), count(*) = 0 FROM gaps UNION ALL SELECT 'Polygon', 0, TRUE")
def error_accessors(spark, sf_dir):
    errors = _two_rules(spark, sf_dir)
    rows = []
    for kind in ("Point", "LineString", "Polygon"):
        mine = batch.errors_of(errors, kind)
        rows.append((kind, mine.count(), batch.is_valid(mine)))
    return spark.createDataFrame(rows, "kind string, n long, valid boolean")


def _report(*rules: tuple[str, str, str]) -> str:
    """SQL: the lines of a report on rules, each with the label and the step of its errors."""
    lines, at = [], 0
    for rule, label, step in rules:
        for text in ("repeat('=', 60)", f"'{rule}'", "repeat('=', 60)", f"(SELECT CASE WHEN count(*) = 0 THEN 'No topology errors found.' ELSE count(*) || ' {label} errors' END FROM {step})"):
            lines.append(f"SELECT CAST({at} AS BIGINT) AS line, {text} AS text")
            at += 1
    return " UNION ALL ".join(lines)


def _lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "line long, text string")


@_query(_with("fx_points", "fx_boxes", **_TWO) + _report(("1-must-not-overlap", "Point", "e"), ("2-must-not-have-gaps", "Linestring", "gaps")))
def report_text(spark, sf_dir):
    return _lines_of(spark, batch.summary_text(_two_rules(spark, sf_dir), ["1-must-not-overlap", "2-must-not-have-gaps"]))


def _said(spark: SparkSession, *words: str) -> str:
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        commands.main([*words], spark)
    return held.getvalue()


def _point_file(spark: SparkSession, sf_dir: str) -> str:
    path = f"{_folder(spark)}/points.parquet"
    writers.write_features(batch._points(fixture(spark, sf_dir, "fx_points")), path)
    return path


@_query(_with("fx_points", e=_PAIRS) + _report(("must-not-overlap", "Point", "e")))
def command_rule(spark, sf_dir):
    return _lines_of(spark, _said(spark, "point", "must-not-overlap", f"points={_point_file(spark, sf_dir)}"))


@_query(_with("fx_points", e=_PAIRS, none="SELECT 1 AS a WHERE 1 = 0") + _report(("1-must-not-overlap", "Point", "e"), ("2-must-not-be-multipart", "MultiPoint", "none")))
def command_batch(spark, sf_dir):
    path = _point_file(spark, sf_dir)
    return _lines_of(spark, _said(spark, "batch", f"point must-not-overlap points={path}", f"geometry must-not-be-multipart features='{path}'"))


@_query(_with("fx_kinds") + "SELECT 'LineString' AS kind, 2 * count(*) AS n FROM fx_kinds WHERE k = 1")
def command_explode(spark, sf_dir):
    """Lines of a file to a file of their segments, with the time it took."""
    folder = _folder(spark)
    writers.write_features(_kinds(spark, sf_dir, "LineString"), f"{folder}/lines.geojsonl")
    said = _said(spark, "utilities", "explode-linestrings", f"lines={folder}/lines.geojsonl", "--out", f"{folder}/out.geojsonl", "--elapsed")
    if not said.strip().endswith(" s"):
        raise AssertionError(said)
    return readers.read_features(spark, f"{folder}/out.geojsonl").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT * FROM (VALUES (0, 'GeoJSON: geojson json'), (1, 'GeoJSONSeq: geojsonl geojsons'), (2, 'ESRI Shapefile: shp'), (3, 'GPKG: gpkg'), (4, 'CSV: csv'), (5, 'Parquet: parquet')) AS t(line, text)")
def command_drivers(spark, sf_dir):
    return _lines_of(spark, _said(spark, "drivers", "write")).select(F.col("line").cast("int").alias("line"), "text")


# casts and rings


@_query(
    _with("fx_points", "fx_boxes")
    + "SELECT 'Point' AS kind, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM fx_points UNION ALL "
    "SELECT 'LineString', 'LINESTRING (' || CAST(x0 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ', ' || CAST(x1 AS BIGINT) || ' ' || CAST(y0 AS BIGINT) || ')' FROM fx_boxes"
)
def casts_to_features(spark, sf_dir):
    sides = transforms.boundary_segments(box_polygons(fixture(spark, sf_dir, "fx_boxes"))).where("seg = 0")
    return _wkt(batch._points(fixture(spark, sf_dir, "fx_points")).unionByName(batch._segments(sides)))


@_query(
    _with("fx_boxes", v="SELECT fid, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM fx_boxes")
    + "SELECT fid, TRUE AS closed, 'LINESTRING (' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ')' AS wkt FROM v"
)
def rotated_rings(spark, sf_dir):
    boxes = fixture(spark, sf_dir, "fx_boxes")
    ring = F.get(transforms.box_rings(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), F.lit(0))
    moved = boxes.select("fid", g.rotated(ring, F.col("x1"), F.col("y1")).alias("coords"))
    parts = F.array(F.struct("coords", F.lit(None).cast(RINGS).alias("rings")))
    return moved.select("fid", g.is_closed(F.col("coords")).alias("closed"), formats.to_wkt(F.lit("LineString"), parts).alias("wkt"))
