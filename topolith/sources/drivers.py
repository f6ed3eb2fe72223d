"""The formats that can be read and written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Driver:
    name: str
    extensions: tuple[str, ...]
    can_read: bool
    can_write: bool


DRIVERS = (
    Driver("GeoJSON", ("geojson", "json"), True, True),
    Driver("GeoJSONSeq", ("geojsonl", "geojsons"), True, True),
    Driver("ESRI Shapefile", ("shp",), True, True),
    Driver("GPKG", ("gpkg",), True, True),
    Driver("CSV", ("csv",), True, True),
    Driver("Parquet", ("parquet",), True, True),
)


def list_drivers(spark: SparkSession, read: bool | None = None, write: bool | None = None) -> DataFrame:
    """``driver, extensions, can_read, can_write``, restricted to those that read or write if asked."""
    rows = [
        (d.name, " ".join(d.extensions), d.can_read, d.can_write)
        for d in DRIVERS
        if (read is None or d.can_read == read) and (write is None or d.can_write == write)
    ]
    return spark.createDataFrame(rows, "driver string, extensions string, can_read boolean, can_write boolean")


def driver_for(path: str, name: str | None = None) -> Driver:
    """The driver of a name, else of the path's extension; both must match exactly."""
    if name is not None:
        found = [d for d in DRIVERS if d.name.lower() == name.lower()]
        if not found:
            raise ValueError(f"no driver {name}")
        return found[0]
    last = path.rstrip("/").rsplit("/", 1)[-1]
    extension = last.rsplit(".", 1)[1].lower() if "." in last else ""
    if not extension:
        raise ValueError(f"{path} has no extension; name a driver")
    found = [d for d in DRIVERS if extension in d.extensions]
    if not found:
        raise ValueError(f"no driver for .{extension}")
    return found[0]


def driver_of_content(spark: SparkSession, path: str) -> Driver:
    """The driver that a file's first bytes tell, whatever its name."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(sc._jsc.hadoopConfiguration()).open(place)
    try:
        head = bytes(stream.readNBytes(16))
    finally:
        stream.close()
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if head.startswith(b"SQLite format 3"):
        name = "GPKG"
    elif head.startswith(b"PAR1"):
        name = "Parquet"
    elif head[:4] == (9994).to_bytes(4, "big"):
        name = "ESRI Shapefile"
    elif text.startswith(b"\x1e"):
        name = "GeoJSONSeq"
    elif text.startswith(b"{"):
        name = "GeoJSON"
    else:
        name = "CSV"
    return driver_for(path, name)
