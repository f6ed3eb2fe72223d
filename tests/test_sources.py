import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from topolith.plans import batch, formats
from topolith.schema import FEATURES
from topolith.sources import binary, drivers, readers, writers

P = {"coords": [{"x": 1.0, "y": 2.0}], "rings": None}
L = {"coords": [{"x": 0.0, "y": 0.0}, {"x": 1.5, "y": 2.0}], "rings": None}
A = {"coords": None, "rings": [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]}
ALL = [("Point", [P]), ("LineString", [L]), ("Polygon", [A]), ("MultiPoint", [P, P]), ("MultiLineString", [L, L]), ("MultiPolygon", [A, A])]


def _features(spark, *given):
    rows = [(k, kind, [(p["coords"] and [(c["x"], c["y"]) for c in p["coords"]], p["rings"] and [[(c["x"], c["y"]) for c in r] for r in p["rings"]]) for p in parts]) for k, (kind, parts) in enumerate(given)]
    return spark.createDataFrame(rows, FEATURES)


def _plain(df):
    return sorted(((r["kind"], [p.asDict(recursive=True) for p in r["parts"]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["a.geojson", "a.geojsonl", "a.csv", "a.parquet", "a.gpkg"])
def test_round_trip_of_every_kind(spark, tmp_path, name):
    given = _features(spark, *ALL)
    path = str(tmp_path / name)
    writers.write_features(given, path)
    layers = [None] if not name.endswith("gpkg") else [k for k, _ in ALL]
    found = [x for layer in layers for x in _plain(readers.read_features(spark, path, layer=layer))]
    assert sorted(found, key=str) == sorted(ALL, key=str)


def test_wkb_round_trip_and_big_endian():
    for kind, parts in ALL:
        assert binary.from_wkb(binary.to_wkb(kind, parts)) == (kind, parts)
    assert binary.from_wkb(struct.pack(">BI2d", 0, 1, 1.0, 2.0)) == ("Point", [P])
    assert binary.from_wkb(struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 9.0)) == ("Point", [P])


def test_geojson_of_any_shape(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [1, 2, 3]}},
            {"type": "Feature", "properties": None, "geometry": None},
            {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0], [1.5, 2]]}]}},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    found = readers.read_features(spark, str(tmp_path / "a.json")).collect()
    assert sorted(str(r["kind"]) for r in found) == ["LineString", "None", "Point", "Point"]
    assert json.loads(next(r for r in found if r["properties"] == '{"name":"a"}')["properties"]) == {"name": "a"}
    (tmp_path / "b.geojson").write_text('{"type":"Point","coordinates":[1,2]}')
    assert _plain(readers.read_features(spark, str(tmp_path / "b.geojson"))) == [("Point", [P])]


@pytest.mark.parametrize(
    "text,n,split",
    [
        ('{ "type": "FeatureCollection", "features": [\n{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}},\r\n{"type":"Feature","properties":{},"geometry":null}\n]\n}', 2, True),
        ('{"type":"FeatureCollection","features":[\n]}', 0, True),
        ('{"type":"FeatureCollection","features":[\n{"type":"Feature","properties":{},"geometry":{"type":"Point",\n"coordinates":[1,2]}}\n]}', 1, False),
        ('{"type":"FeatureCollection","features":[\n{"type":"Feature","properties":{},"geometry":null}\n],"name":"a"}', 1, False),
        ('{"name":"a","features":[{"type":"Feature","properties":{},"geometry":null}],"type":"FeatureCollection"}', 1, False),
    ],
)
def test_collections_by_lines_or_whole(spark, tmp_path, text, n, split):
    (tmp_path / "a.geojson").write_text(text)
    path = str(tmp_path / "a.geojson")
    assert (readers._feature_lines(spark, path) is not None) == split
    assert readers.read_features(spark, path).count() == n


def test_shapefiles_are_written_with_their_index(spark, tmp_path):
    path = str(tmp_path / "a.shp")
    hole = {"coords": None, "rings": [A["rings"][0], [{"x": 2.0, "y": 1.0}, {"x": 3.0, "y": 1.0}, {"x": 3.0, "y": 2.0}, {"x": 2.0, "y": 1.0}]]}
    given = _features(spark, ("Polygon", [hole]), ("MultiPolygon", [A, {"coords": None, "rings": [[{"x": c["x"] + 9, "y": c["y"]} for c in A["rings"][0]]]}]))
    writers.write_features(given.withColumn("rule", F.lit("a-rule")), path)
    found = readers.read_features(spark, path).orderBy("fid").collect()
    assert [r["kind"] for r in found] == ["Polygon", "MultiPolygon"] and [len(p["rings"]) for p in found[0]["parts"]] == [2]
    index = (tmp_path / "a.shx").read_bytes()
    data = path and (tmp_path / "a.shp").read_bytes()
    for k in range(2):
        offset, words = struct.unpack_from(">ii", index, 100 + 8 * k)
        assert struct.unpack_from(">ii", data, 2 * offset) == (k + 1, words)
    assert struct.unpack_from(">i", data, 24)[0] * 2 == len(data) and b"a-rule" in (tmp_path / "a.dbf").read_bytes()
    with pytest.raises(ValueError, match="family"):
        writers.write_features(_features(spark, ("Point", [P]), ("LineString", [L])), str(tmp_path / "b.shp"))
    with pytest.raises(FileExistsError):
        writers.write_features(given, path)


def test_features_go_to_a_known_layer(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    writers.write_features(_features(spark, ("Point", [P])), path, layer="mine")
    errors = _features(spark, ("Point", [P]), ("LineString", [L])).withColumn("rule", F.lit("r"))
    writers.write_features(errors, path, mode="append")
    db = sqlite3.connect(path)
    assert db.execute("SELECT rule FROM mine ORDER BY fid").fetchall() == [(None,), ("r",)]
    assert db.execute("SELECT rule FROM LineString").fetchall() == [("r",)]
    with pytest.raises(FileExistsError):
        writers.write_features(errors, path)
    writers.write_features(errors, path, mode="overwrite")
    assert sqlite3.connect(path).execute("SELECT count(*) FROM gpkg_contents").fetchone() == (2,)


def test_formats_by_content_and_rules_by_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from topolith.__main__ import main

    for name, driver in (("a", "GeoJSON"), ("b", "GPKG"), ("c", "ESRI Shapefile")):
        writers.write_features(_features(spark, ("Point", [P]), ("Point", [P])), str(tmp_path / name), driver)
        assert drivers.driver_of_content(spark, str(tmp_path / name)).name == driver
    rules = f"point must-not-overlap points={tmp_path}/a\n\ngeometry must-not-be-multipart features={tmp_path}/b\nsummary\nnothing after it\n"
    monkeypatch.setattr("sys.stdin", io.StringIO(rules))
    main(["batch", "--by-content"], spark)
    said = capsys.readouterr().out
    assert "1-must-not-overlap" in said and "2-must-not-be-multipart" in said and "1 Point errors" in said


def _shp(records):
    body = b""
    for k, r in enumerate(records, 1):
        body += struct.pack(">ii", k, len(r) // 2) + r
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body


def test_shapefiles(spark, tmp_path):
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    far = [(9, 9), (9, 10), (10, 10), (9, 9)]
    flat = lambda *runs: struct.pack(f"<{sum(map(len, runs)) * 2}d", *[v for run in runs for p in run for v in map(float, p)])
    poly = struct.pack("<i4d2i3i", 5, 0, 0, 10, 10, 3, 14, 0, 5, 10) + flat(outer, hole, far)
    point = struct.pack("<i2d", 1, 1.0, 2.0)
    line = struct.pack("<i4d2i1i", 3, 0, 0, 1.5, 2, 1, 2, 0) + flat([(0, 0), (1.5, 2)])
    many = struct.pack("<i4di", 8, 1, 2, 1, 2, 2) + flat([(1, 2), (1, 2)])
    (tmp_path / "a.shp").write_bytes(_shp([poly, point, line, many, struct.pack("<i", 0)]))
    (tmp_path / "a.prj").write_text("LOCAL")
    found = readers.read_features(spark, str(tmp_path / "a.shp")).orderBy("fid").collect()
    assert [r["kind"] for r in found] == ["MultiPolygon", "Point", "LineString", "MultiPoint", None]
    assert [len(p["rings"]) for p in found[0]["parts"]] == [2, 1]
    assert readers.probe_crs(spark, str(tmp_path / "a.shp")) == "LOCAL"


def test_reference_systems(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    writers.write_features(_features(spark, ("Point", [P])), path, epsg=4326)
    assert readers.probe_crs(spark, path) == "EPSG:4326"
    assert readers.compare_crs("a", "a") == "same" and readers.compare_crs("a", None) == "missing"
    readers.validate_crs("a", None)
    with pytest.raises(ValueError, match="a and b"):
        readers.validate_crs("a", "b")


def test_drivers():
    assert drivers.driver_for("x/y.GeoJSON").name == "GeoJSON"
    assert drivers.driver_for("x", "gpkg").name == "GPKG"
    for bad in (("x",), ("x.son",), ("x.json", "nope")):
        with pytest.raises(ValueError):
            drivers.driver_for(*bad)


def test_wkt(spark):
    given = _features(spark, *ALL)
    texts = [r[0] for r in given.orderBy("fid").select(formats.to_wkt(F.col("kind"), F.col("parts"))).collect()]
    assert texts[0] == "POINT (1 2)" and texts[1] == "LINESTRING (0 0, 1.5 2)"
    assert [readers.from_wkt(t) for t in texts] == ALL
    assert readers.from_wkt("POINT Z (1 2 3)") == ("Point", [P])
    with pytest.raises(ValueError):
        readers.from_wkt("CIRCLE (1 2)")


def test_batches_reports_and_command_line(spark, tmp_path, capsys):
    from topolith.__main__ import main

    path = str(tmp_path / "p.geojson")
    writers.write_features(_features(spark, ("Point", [P]), ("Point", [P])), path)
    out = str(tmp_path / "e.gpkg")
    assert main(["point", "must-not-overlap", f"points={path}", "--out", out, "--elapsed"], spark) == 0
    said = capsys.readouterr().out
    assert "1 Point errors" in said and " s" in said
    assert sqlite3.connect(out).execute("SELECT rule FROM Point").fetchall() == [("must-not-overlap",)]
    main(["batch", f"point must-not-overlap points={path}", f"geometry must-not-be-multipart features={path}"], spark)
    said = capsys.readouterr().out
    assert "1-must-not-overlap" in said and "No topology errors found." in said
    lines = str(tmp_path / "l.geojson")
    writers.write_features(_features(spark, ("LineString", [L]), ("MultiLineString", [{"coords": [{"x": 1.5, "y": 2.0}, {"x": 9.0, "y": 9.0}], "rings": None}])), lines)
    merged = str(tmp_path / "m.geojson")
    main(["utilities", "merge-linestrings", f"lines={lines}", "--out", merged], spark)
    assert len(readers.read_features(spark, merged).collect()) == 1
    main(["drivers", "read"], spark)
    assert "ESRI Shapefile: shp" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["point", "no-such-rule", f"points={path}"], spark)


def test_specs_are_checked(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0)], "fid long, x double, y double")
    with pytest.raises(ValueError, match="no rule"):
        batch.run_rule(batch.RuleSpec("point", "nope", {}))
    with pytest.raises(ValueError, match="takes points, other"):
        batch.run_rule(batch.RuleSpec("point", "must-not-overlap-with", {"points": df}))
    with pytest.raises(ValueError, match="reference"):
        batch.run_rule(batch.RuleSpec("point", "must-not-overlap-with", {"points": df, "other": df}, {"points": "EPSG:1", "other": "EPSG:2"}))
    with pytest.raises(ValueError, match="twice"):
        batch.run_batch([batch.RuleSpec("point", "must-not-overlap", {"points": df})] * 2)
    found = batch.run_rule(batch.RuleSpec("point", "must-not-overlap", {"points": df.unionAll(df)}))
    assert not batch.is_valid(found) and batch.errors_of(found, "Point").count() == 1 and batch.errors_of(found, "Polygon").count() == 0
