"""Geometry as text, in columns: WKT and GeoJSON, both ways where columns can do it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COORDS, RINGS


def _number(v: Column) -> Column:
    """Whole numbers without a point, others in the shortest form that reads back the same."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def _list(items: Column, left: str, right: str, sep: str = ", ") -> Column:
    return F.concat(F.lit(left), F.array_join(items, sep), F.lit(right))


def _told(kind: Column, parts: Column, one, left: str, right: str, label) -> Column:
    """Text of each kind: ``one`` tells a coordinate, ``label`` wraps the body of a kind."""
    coords = lambda p: _list(F.transform(p["coords"], one), left, right)
    rings = lambda p: _list(F.transform(p["rings"], lambda r: _list(F.transform(r, one), left, right)), left, right)
    points = _list(F.transform(parts, lambda p: one(F.get(p["coords"], F.lit(0)))), left, right)
    first = F.get(parts, F.lit(0))
    return (
        F.when(kind == "Point", label("Point", one(F.get(first["coords"], F.lit(0)))))
        .when(kind.isin("LineString", "Line"), label("LineString", coords(first)))
        .when(kind == "Polygon", label("Polygon", rings(first)))
        .when(kind == "MultiPoint", label("MultiPoint", points))
        .when(kind == "MultiLineString", label("MultiLineString", _list(F.transform(parts, coords), left, right)))
        .when(kind == "MultiPolygon", label("MultiPolygon", _list(F.transform(parts, rings), left, right)))
    )


def to_wkt(kind: Column, parts: Column) -> Column:
    """Well-known text; null for kinds without one part at least."""
    one = lambda c: F.concat_ws(" ", _number(c["x"]), _number(c["y"]))

    def label(name: str, body: Column) -> Column:
        body = F.concat(F.lit("("), body, F.lit(")")) if name == "Point" else body
        return F.concat(F.lit(name.upper() + " "), body)

    return F.when(F.size(parts) > 0, _told(kind, parts, one, "(", ")", label))


def to_geojson(kind: Column, parts: Column) -> Column:
    """A GeoJSON geometry; null for kinds without one part at least."""
    one = lambda c: F.concat(F.lit("["), _number(c["x"]), F.lit(","), _number(c["y"]), F.lit("]"))
    label = lambda name, body: F.concat(F.lit('{"type":"' + name + '","coordinates":'), body, F.lit("}"))
    return F.when(F.size(parts) > 0, _told(kind, parts, one, "[", "]", label))


def to_geojson_feature(kind: Column, parts: Column, **properties: Column) -> Column:
    told = F.to_json(F.struct(*[v.alias(k) for k, v in properties.items()])) if properties else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), told, F.lit(',"geometry":'), F.coalesce(to_geojson(kind, parts), F.lit("null")), F.lit("}"))


def _part(coords: Column | None = None, rings: Column | None = None) -> Column:
    no_coords, no_rings = F.lit(None).cast(COORDS), F.lit(None).cast(RINGS)
    return F.struct((no_coords if coords is None else coords).alias("coords"), (no_rings if rings is None else rings).alias("rings"))


def _xy(p: Column) -> Column:
    return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def parts_of_variant(geometry: Column) -> tuple[Column, Column]:
    """Kind and parts of a GeoJSON geometry held as a variant; further ordinates are left out."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    at = lambda depth: F.try_variant_get(geometry, "$.coordinates", "array<" * depth + "double" + ">" * depth)
    line = lambda a: F.transform(a, _xy)
    rings = lambda a: F.transform(a, line)
    parts = (
        F.when(kind == "Point", F.array(_part(F.array(_xy(at(1))))))
        .when(kind == "LineString", F.array(_part(line(at(2)))))
        .when(kind == "Polygon", F.array(_part(rings=rings(at(3)))))
        .when(kind == "MultiPoint", F.transform(at(2), lambda p: _part(F.array(_xy(p)))))
        .when(kind == "MultiLineString", F.transform(at(3), lambda a: _part(line(a))))
        .when(kind == "MultiPolygon", F.transform(at(4), lambda a: _part(rings=rings(a))))
    )
    return kind, parts


def from_geojson(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``kind`` and ``parts`` in place of a column of GeoJSON geometries; both null where it is none."""
    out = df.withColumn("_v", F.try_parse_json(F.col(column)))
    kind, parts = parts_of_variant(F.col("_v"))
    return out.select(*[c for c in df.columns if c not in (column, "kind", "parts")], kind.alias("kind"), parts.alias("parts"))
