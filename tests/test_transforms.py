import pytest
from pyspark.sql import functions as F

from tests.helpers import lines, polygons, rows, square
from topolith import fixtures, registry, registry_io  # noqa: F401
from topolith.functions import geometry as g
from topolith.operators import transforms as t
from topolith.operators.components import connected_components
from topolith.streaming import rowwise


def test_explode_keeps_direction_and_repeats(spark):
    found = t.explode_lines(lines(spark, [(0, 0), (1, 0), (0, 0), (1, 0)]))
    assert rows(found, "seg", "x1", "x2") == [(0, 0.0, 1.0), (1, 1.0, 0.0), (2, 0.0, 1.0)]
    assert t.dedup_segments(found).count() == 2


def test_ends_and_inner_points(spark):
    given = lines(spark, [(0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)])
    assert rows(t.endpoints(given), "fid", "x") == [(0, 0.0), (0, 2.0), (1, 5.0), (1, 6.0)]
    assert rows(t.inner_points(given), "fid", "x") == [(0, 1.0)]
    with pytest.raises(Exception, match="fewer than two vertices"):
        t.endpoints(lines(spark, [(0, 0)])).collect()


def test_flatten_refuses_other_kinds(spark):
    kinds = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0), (2, 1, 1.0, 2.0, 3.0)], "fid long, k int, x double, y double, s double")
    features = fixtures.kind_features(kinds)
    assert t.flatten_points(features.where("fid = 1")).count() == 1
    with pytest.raises(Exception, match="not a point: feature 2 is a LineString"):
        t.flatten_points(features).collect()


def test_rings(spark):
    given = polygons(spark, [square(0, 0, 4), square(1, 1)])
    assert t.boundary_segments(given).count() == 8 and t.boundaries(given).count() == 2
    area, middle = given.select(g.polygon_area(F.col("rings")), g.ring_centroid(F.col("rings")[0])).first()
    assert area == 15 and (middle["x"], middle["y"]) == (2, 2)
    ring = lines(spark, square(0, 0), [(0, 0), (1, 1)])
    moved = ring.select(g.rotated(F.col("coords"), F.lit(1.0), F.lit(1.0)).alias("c")).collect()
    assert [tuple(c) for c in moved[0]["c"]] == [(1, 1), (0, 1), (0, 0), (1, 0), (1, 1)]
    assert [tuple(c) for c in moved[1]["c"]] == [(0, 0), (1, 1)]


@pytest.mark.parametrize("n", [1, 2, 17, 60])
def test_components_of_paths_and_stars(spark, n):
    path = [(i, i + 1) for i in range(0, n)]
    star = [(1000, 1000 + i) for i in range(1, n + 1)]
    edges = spark.createDataFrame(path + star + [(5000, 5000), (None, 3)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n + 1)}
    assert connected_components(edges.where("src < 0")).count() == 0


def test_streams(spark, tmp_path):
    given = lines(spark, [(0, 0), (1, 0), (2, 0)])
    given.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    out = rowwise.apply(stream, "explode_lines", "drop_empty_segments")
    out.writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("segments").count() == 2
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 9.0, 9.0), (2, 0.0, 0.5)], "fid long, x double, y double")
    points.write.parquet(str(tmp_path / "pts"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "pts"))
    out = rowwise.points_outside(stream, polygons(spark, [square(0, 0)]), 1.0)
    out.writeStream.format("memory").queryName("outside").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["fid"] for r in spark.table("outside").collect()) == [1, 2]


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for table in fixtures.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    order = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    expected = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=str) == expected
