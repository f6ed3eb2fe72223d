"""Types of the data model.

A feature has a kind and parts; a part is a list of coordinates (points and
linestrings) or a list of rings (polygons: the exterior, then holes). Rules
work on flat tables made from features: points, lines, polygons, segments.
"""

from __future__ import annotations

from pyspark.sql import types as T

COORD = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
COORDS = T.ArrayType(COORD)
RINGS = T.ArrayType(COORDS)
PART = T.StructType([T.StructField("coords", COORDS), T.StructField("rings", RINGS)])

#: One row for each feature of a dataset.
FEATURES = T.StructType(
    [T.StructField("fid", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(PART))]
)

POINT_KINDS = ("Point", "MultiPoint")
LINE_KINDS = ("LineString", "MultiLineString", "Line")
POLYGON_KINDS = ("Polygon", "MultiPolygon")
MULTI_KINDS = ("MultiPoint", "MultiLineString", "MultiPolygon")

#: Errors of any rule: what it found, and the geometry in the same form as a feature's.
ERRORS = T.StructType(
    [T.StructField("rule", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(PART))]
)
