"""Reading datasets as features: ``fid, kind, parts``, with attributes where the format has them.

Ids are fixed when a dataset is read: they are written with the rows, so that
a later recomputation can't change them under a self-join.
"""

from __future__ import annotations

import contextlib
import json
import re
import sqlite3
import tempfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import stored
from ..plans.formats import parts_of_variant
from .binary import from_gpkg, from_wkb, shapefile
from .drivers import driver_for

_COORD = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.struct([("coords", pa.list_(_COORD)), ("rings", pa.list_(pa.list_(_COORD)))]))
_SCHEMA = "kind string, parts array<struct<coords:array<struct<x:double,y:double>>,rings:array<array<struct<x:double,y:double>>>>>"


def read_features(spark: SparkSession, path: str, driver: str | None = None, layer: str | None = None) -> DataFrame:
    """The features of a dataset. Without ``layer`` the first one is read.

    A feature without a geometry has null kind and parts. A collection as a
    geometry becomes one feature for each member.
    """
    d = driver_for(path, driver)
    if not d.can_read:
        raise ValueError(f"{d.name} can't be read")
    return _with_ids(_READERS[d.name](spark, path, layer))


def _with_ids(df: DataFrame) -> DataFrame:
    held = stored(df.withColumn("fid", F.monotonically_increasing_id()))
    return held.select("fid", *[c for c in held.columns if c != "fid"])


def _expanded(df: DataFrame) -> DataFrame:
    """Variant geometries to kind and parts, collections to their members."""
    members = F.when(
        F.try_variant_get("g", "$.type", "string") == "GeometryCollection", F.try_variant_get("g", "$.geometries", "array<variant>")
    ).otherwise(F.array("g"))
    out = df.withColumn("g", F.explode_outer(members))
    kind, parts = parts_of_variant(F.col("g"))
    return out.select(*[c for c in df.columns if c != "g"], kind.alias("kind"), parts.alias("parts"))


def _geojson(spark: SparkSession, path: str, layer: str | None) -> DataFrame:
    """A collection with a feature on each line is split among tasks; any other document is parsed whole."""
    listed = _feature_lines(spark, path)
    if listed is not None:
        return _members(listed)
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.try_variant_get("v", "$.type", "string")
    features = F.when(kind == "FeatureCollection", F.try_variant_get("v", "$.features", "array<variant>")).otherwise(F.array("v"))
    return _members(v.select(F.explode(features).alias("f")))


def _feature_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The features of a collection whose first line opens their list, if each other line is one feature or closes the list."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "[\r\t]", " ")).alias("value"))
    head = lines.first()
    if head is None or not re.search(r'"features"\s*:\s*\[$', head["value"]):
        return None
    body = lines.where(~F.col("value").isin("", "]", "}", "]}", "] }", head["value"]))
    parsed = body.select(F.try_parse_json(F.regexp_replace("value", ",$", "")).alias("f"))
    whole = F.col("f").isNotNull() & F.coalesce(F.try_variant_get("f", "$.type", "string") == "Feature", F.lit(False))
    return parsed if parsed.where(~whole).isEmpty() else None


def _members(features: DataFrame) -> DataFrame:
    own = F.try_variant_get("f", "$.type", "string") == "Feature"
    g = F.when(own, F.try_variant_get("f", "$.geometry", "variant")).otherwise(F.col("f"))
    return _expanded(features.select(g.alias("g"), F.to_json(F.try_variant_get("f", "$.properties", "variant")).alias("properties")))


def _geojson_lines(spark: SparkSession, path: str, layer: str | None) -> DataFrame:
    """One feature a line: such files are split among tasks."""
    text = spark.read.text(path).where("length(trim(value)) > 0")
    return _members(text.select(F.parse_json(F.regexp_replace("value", "^\x1e", "")).alias("f")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _parsed(df: DataFrame, parse) -> DataFrame:
    """Rows of one binary column to kind and parts; ``parse`` gives geometries, or none, one after the other.

    A file's bytes are read where Arrow holds them, and of its features some thousands are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = iter(parse(data.as_buffer()) if data.is_valid else [None])
                while some := list(islice(rows, 5_000)):
                    kinds = pa.array([r and r[0] for r in some], pa.string())
                    yield pa.RecordBatch.from_arrays([kinds, pa.array([r and r[1] for r in some], _PARTS)], ["kind", "parts"])

    return df.mapInArrow(run, _SCHEMA)


def _shapefile(spark: SparkSession, path: str, layer: str | None) -> DataFrame:
    return _parsed(_files(spark, path), lambda data: (g for _, g in shapefile(memoryview(data))))


def _gpkg(spark: SparkSession, path: str, layer: str | None) -> DataFrame:
    def parse(data: pa.Buffer):
        # by a file of the task's own, as the database in memory would be another copy of it
        with tempfile.TemporaryDirectory() as folder:
            with open(f"{folder}/file.gpkg", "wb") as f:
                f.write(data)
            with contextlib.closing(sqlite3.connect(f"{folder}/file.gpkg")) as db:
                table, column = _gpkg_layer(db, layer)
                for (blob,) in db.execute(f'SELECT "{column}" FROM "{table}"'):
                    yield from_gpkg(blob) if blob is not None else None

    return _parsed(_files(spark, path), parse)


def _gpkg_layer(db: sqlite3.Connection, layer: str | None) -> tuple[str, str]:
    rows = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    found = [r for r in rows if layer is None or r[0] == layer]
    if not found:
        raise ValueError(f"no layer {layer or ''}".rstrip())
    return found[0]


_NUMBER = r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def from_wkt(text: str):
    """Kind and parts of well-known text; further ordinates are left out."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\)|EMPTY)\s*$", text, re.S | re.I)
    names = {k.upper(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}
    if not m or m[1].upper() not in names:
        raise ValueError(f"not well-known text: {text[:60]}")
    kind = names[m[1].upper()]
    if m[2].upper() == "EMPTY":
        return kind, []
    nested = re.sub(rf"({_NUMBER})((?:\s+{_NUMBER})+)", lambda n: "[" + ",".join(n[0].split()) + "]", m[2]).replace("(", "[").replace(")", "]")
    body = json.loads(re.sub(r"(?<=[\[,])\s*\.", "0.", nested))
    line = lambda a: [{"x": float(p[0]), "y": float(p[1])} for p in a]
    part = lambda coords=None, rings=None: {"coords": coords, "rings": rings}
    if kind == "Point":
        return kind, [part(line(body))]
    if kind == "LineString":
        return kind, [part(line(body))]
    if kind == "Polygon":
        return kind, [part(rings=[line(r) for r in body])]
    if kind == "MultiPoint":
        return kind, [part(line(p if isinstance(p[0], list) else [p])) for p in body]
    if kind == "MultiLineString":
        return kind, [part(line(a)) for a in body]
    return kind, [part(rings=[line(r) for r in a]) for a in body]


def _wkt_column(df: DataFrame, column: str) -> DataFrame:
    names = [c for c in df.columns if c != column]

    @F.arrow_udf(_SCHEMA.replace("kind string, parts", "struct<kind:string,parts:").replace(": array", ":array") + ">")
    def parse(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else from_wkt(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r and r[0] for r in rows], pa.string()), pa.array([r and r[1] for r in rows], _PARTS)], ["kind", "parts"])

    return df.withColumn("_g", parse(F.col(column))).select(*names, "_g.kind", "_g.parts")


def _csv(spark: SparkSession, path: str, layer: str | None) -> DataFrame:
    """A column named ``wkt`` or ``geometry``, or ``x`` and ``y``; others are attributes."""
    df = spark.read.csv(path, header=True)
    named = {c.lower(): c for c in df.columns}
    for name in ("wkt", "geometry"):
        if name in named:
            return _wkt_column(df, named[name])
    if not {"x", "y"} <= set(named):
        raise ValueError(f"{path} has neither a column wkt nor columns x and y")
    xy = F.struct(F.col(named["x"]).cast("double").alias("x"), F.col(named["y"]).cast("double").alias("y"))
    part = F.struct(F.array(xy).alias("coords"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("rings"))
    return df.select(*[c for c in df.columns if c not in (named["x"], named["y"])], F.lit("Point").alias("kind"), F.array(part).alias("parts"))


def _parquet(spark: SparkSession, path: str, layer: str | None) -> DataFrame:
    """``kind`` and ``parts``, or a column ``geometry`` of well-known binary; other columns stay."""
    df = spark.read.parquet(path)
    if {"kind", "parts"} <= set(df.columns):
        return df.drop("fid")
    column = next((c for c in ("geometry", "geom", "wkb") if c in df.columns and df.schema[c].dataType.simpleString() == "binary"), None)
    if column is None:
        raise ValueError(f"{path} has no geometry")
    names = [c for c in df.columns if c not in (column, "fid")]

    @F.arrow_udf(_SCHEMA.replace("kind string, parts", "struct<kind:string,parts:").replace(": array", ":array") + ">")
    def parse(blobs: pa.Array) -> pa.Array:
        rows = [None if b is None else from_wkb(b) for b in blobs.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r and r[0] for r in rows], pa.string()), pa.array([r and r[1] for r in rows], _PARTS)], ["kind", "parts"])

    return df.withColumn("_g", parse(F.col(column))).select(*names, "_g.kind", "_g.parts")


_READERS = {"GeoJSON": _geojson, "GeoJSONSeq": _geojson_lines, "ESRI Shapefile": _shapefile, "GPKG": _gpkg, "CSV": _csv, "Parquet": _parquet}


def require_features(df: DataFrame) -> DataFrame:
    """The features, unless there are none."""
    if df.isEmpty():
        raise ValueError("no geometry in this dataset")
    return df


# reference systems


def probe_crs(spark: SparkSession, path: str, driver: str | None = None) -> str | None:
    """The reference system of a dataset's first layer, as its format names it; None where it has none."""
    d = driver_for(path, driver)
    if d.name == "GPKG":
        db = sqlite3.connect(":memory:")
        db.deserialize(_files(spark, path).first()["content"])
        row = db.execute(
            "SELECT s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id ORDER BY g.rowid"
        ).fetchone()
        return f"{row[0]}:{row[1]}" if row and row[1] and row[1] > 0 else None
    if d.name == "ESRI Shapefile":
        folder, _, name = path.rpartition("/")
        found = spark.read.format("binaryFile").option("pathGlobFilter", name.rsplit(".", 1)[0] + ".prj").load(folder or ".").select("content").take(1)
        return found[0]["content"].decode().strip() if found else None
    return None


def compare_crs(a: str | None, b: str | None) -> str:
    """``same``, ``different``, or ``missing`` where one is unknown."""
    if a is None or b is None:
        return "missing"
    return "same" if a == b else "different"


def validate_crs(a: str | None, b: str | None) -> None:
    """Different reference systems are an error; a missing one fits any."""
    if compare_crs(a, b) == "different":
        raise ValueError(f"different reference systems: {a} and {b}")
