"""Small literal geometry for tests."""

from pyspark.sql import DataFrame, SparkSession


def lines(spark: SparkSession, *coords) -> DataFrame:
    rows = [(k, 0, [tuple(map(float, p)) for p in c]) for k, c in enumerate(coords)]
    return spark.createDataFrame(rows, "fid long, part int, coords array<struct<x:double,y:double>>")


def points(spark: SparkSession, *xy) -> DataFrame:
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "fid long, x double, y double")


def polygons(spark: SparkSession, *rings) -> DataFrame:
    rows = [(k, 0, [[tuple(map(float, p)) for p in r] for r in rs]) for k, rs in enumerate(rings)]
    return spark.createDataFrame(rows, "fid long, part int, rings array<array<struct<x:double,y:double>>>")


def square(x, y, side=1.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def rows(df: DataFrame, *columns) -> list:
    return sorted(tuple(r) for r in df.select(*columns).collect())


def shapes(df: DataFrame) -> list:
    return sorted([(c["x"], c["y"]) for c in r["coords"]] for r in df.collect())
