"""Writing features and errors."""

from __future__ import annotations

import os
import re
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import Stored
from ..plans.formats import to_geojson_feature, to_wkt
from .binary import ShapeWriter, shape_record, to_gpkg
from .drivers import driver_for


def write_features(df: DataFrame, path: str, driver: str | None = None, layer: str | None = None, epsg: int | None = None, mode: str = "errorifexists") -> None:
    """Writes ``kind, parts`` and, where there is one, ``rule``.

    GeoJSONSeq, CSV and Parquet are written by all tasks into a folder of the
    given path, and Parquet is split by kind. GeoJSON, GPKG and Shapefile are single
    files: tasks write the records into the shared folder, where the driver reads
    them piece by piece, and the file is then moved to its place, on any file system
    that Spark knows. ``mode`` is ``errorifexists``,
    ``overwrite`` or ``append``; features are appended to a GPKG's layer of
    their kind, wherever there is one, whatever its name.
    """
    d = driver_for(path, driver)
    if not d.can_write:
        raise ValueError(f"{d.name} can't be written")
    extra = {"rule": F.col("rule")} if "rule" in df.columns else {}
    if d.name == "Parquet":
        df.withColumn("part_of", F.col("kind")).write.mode(mode).partitionBy("part_of").parquet(path)
    elif d.name == "CSV":
        df.select(*extra, to_wkt(F.col("kind"), F.col("parts")).alias("wkt")).write.mode(mode).csv(path, header=True)
    elif d.name == "GeoJSONSeq":
        df.select(to_geojson_feature(F.col("kind"), F.col("parts"), **extra)).write.mode(mode).text(path)
    elif d.name == "GeoJSON":
        features = df.select(to_geojson_feature(F.col("kind"), F.col("parts"), **extra).alias("f"))
        _single(df, path, mode, lambda f: _geojson(f, features))
    elif d.name == "GPKG":
        _single(df, path, mode, lambda f: _gpkg(f, df, layer, epsg), may_append=True)
    else:
        _shapefile(df, path, mode, epsg)


class _Place:
    """A path on any file system that Spark knows."""

    def __init__(self, df: DataFrame, path: str):
        sc = df.sparkSession.sparkContext
        self.jvm = sc._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(sc._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def fetch(self, local: str) -> None:
        self.fs.copyToLocalFile(False, self.path, self.jvm.org.apache.hadoop.fs.Path("file://" + local), True)

    def put(self, local: str) -> None:
        """Copied beside the place and moved there, so that readers never see half a file."""
        held = self.jvm.org.apache.hadoop.fs.Path(self.path.getParent() or ".", f".{self.path.getName()}.{uuid.uuid4().hex}")
        self.fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path("file://" + local), held)
        if self.exists():
            self.fs.delete(self.path, False)
        if not self.fs.rename(held, self.path):
            self.fs.delete(held, False)
            raise OSError(f"{self.path.toString()} can't be written")


def _single(df: DataFrame, path: str, mode: str, write, may_append: bool = False) -> None:
    place = _Place(df, path)
    there = place.exists()
    if there and mode == "errorifexists":
        raise FileExistsError(path)
    if mode == "append" and not may_append:
        raise ValueError(f"{path} can't be appended to")
    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/file"
        if there and mode == "append":
            place.fetch(local)
        write(local)
        place.put(local)


def _pieces(held: Stored) -> Iterator[list[dict]]:
    """The rows of a stored table in the order of its partitions, some at a time; none come as results of tasks."""
    folder = _Place(held.df, held.path)
    names = [f.getPath().getName() for f in folder.fs.listStatus(folder.path)]
    for name in sorted((n for n in names if n.startswith("part-")), key=lambda n: (int(re.match(r"part-(\d+)", n)[1]), n)):
        with tempfile.TemporaryDirectory() as local:
            _Place(held.df, f"{held.path}/{name}").fetch(f"{local}/piece")
            with pq.ParquetFile(f"{local}/piece") as piece:
                for batch in piece.iter_batches(batch_size=4096):
                    yield batch.to_pylist()


def _records(df: DataFrame, record: Callable[[str, list[dict]], bytes | None]) -> Stored:
    """``kind, record, rule`` of features, made by tasks; features without parts have no record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record(k, p) if p else None for k, p in zip(batch.column("kind").to_pylist(), batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(made, pa.binary()), batch.column("rule")], ["kind", "record", "rule"])

    rule = F.col("rule") if "rule" in df.columns else F.lit(None).cast("string").alias("rule")
    return Stored(df.where("kind is not null").select("kind", "parts", rule).mapInArrow(run, "kind string, record binary, rule string")).keep()


def _geojson(path: str, features: DataFrame) -> None:
    held = Stored(features).keep()
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write('{"type":"FeatureCollection","features":[')
            before = ""
            for rows in _pieces(held):
                for r in rows:
                    f.write(before + "\n" + r["f"])
                    before = ","
            f.write("\n]}\n")
    finally:
        held.drop()


def _shapefile(df: DataFrame, path: str, mode: str, epsg: int | None) -> None:
    """One family of kinds in a ``.shp`` with its index and its table of rules."""
    if mode == "append":
        raise ValueError(f"{path} can't be appended to")
    base = path[: -len(".shp")] if path.lower().endswith(".shp") else path
    if mode == "errorifexists" and _Place(df, path).exists():
        raise FileExistsError(path)
    held = _records(df.where("size(parts) > 0"), shape_record)
    try:
        with tempfile.TemporaryDirectory() as folder:
            with ShapeWriter(f"{folder}/s") as out:
                for rows in _pieces(held):
                    for r in rows:
                        out.put(r["kind"], r["record"], r["rule"])
            for end in ("dbf", "shx", "shp"):
                _Place(df, path if end == "shp" else f"{base}.{end}").put(f"{folder}/s.{end}")
    finally:
        held.drop()


_GPKG = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL);
"""


def _gpkg(path: str, df: DataFrame, layer: str | None, epsg: int | None) -> None:
    held = _records(df, to_gpkg)
    try:
        _layers(path, held, layer, epsg)
    finally:
        held.drop()


def _layers(path: str, held: Stored, layer: str | None, epsg: int | None) -> None:
    """One layer for each kind, in one transaction; ``layer`` names the layer of a single kind.

    Kinds that the file has a layer of already go there.
    """
    new = not os.path.exists(path)
    db = sqlite3.connect(path, isolation_level=None)
    if new:
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("PRAGMA user_version = 10300")
    db.execute("BEGIN")
    if new:
        for statement in _GPKG.split(";"):
            db.execute(statement)
    srs = epsg or 0
    if epsg:
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{epsg}", epsg, epsg))
    kinds = [r["kind"] for r in held.df.select("kind").distinct().collect()]
    known = {row[0]: row[1:] for row in db.execute("SELECT geometry_type_name, table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid DESC")}
    homes: dict[str, tuple[str, str, int]] = {}
    for kind in sorted(kinds):
        if kind.upper() in known:
            homes[kind] = known[kind.upper()]
            if "rule" not in [c[1] for c in db.execute(f'PRAGMA table_info("{homes[kind][0]}")')]:
                db.execute(f'ALTER TABLE "{homes[kind][0]}" ADD COLUMN rule TEXT')
            continue
        name = layer if layer and len(kinds) == 1 else kind
        homes[kind] = (name, "geom", srs)
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, rule TEXT)')
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, kind.upper(), srs))
    for rows in _pieces(held):
        for kind in kinds:
            name, column, own = homes[kind]
            # a record's bytes 4 to 8 are its reference system: that of the layer
            told = ((r["record"][:4] + struct.pack("<i", own) + r["record"][8:], r["rule"]) for r in rows if r["kind"] == kind and r["record"] is not None)
            db.executemany(f'INSERT INTO "{name}" ("{column}", rule) VALUES (?, ?)', told)
    db.execute("COMMIT")
    db.close()
