"""What keeps rules and files within memory on large tables, looked at on small ones."""

import pyarrow as pa
import pytest

from topolith.operators import exact, lines, polygons
from topolith.operators.transforms import boundary_segments
from topolith.sources import readers, writers

from .helpers import polygons as polygons_of
from .helpers import lines as lines_of
from .helpers import rows, square


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _small_file(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_no_side_of_a_grid_join_is_broadcast(spark, tmp_path):
    """However small the file is: its rows, rings and tiles may be many times as large."""
    p = _small_file(polygons_of(spark, [square(0, 0, 3)], [square(1, 1, 3)]), tmp_path / "p")
    l = _small_file(lines_of(spark, [(0, 0), (1, 1)], [(5, 5), (6, 6)]), tmp_path / "l")
    for found in (polygons.must_not_overlap(p), polygons.must_not_overlap_with(p, p), lines.must_be_inside(l, p)):
        assert "BroadcastHashJoin" not in _plan(found)


def test_undirected_edges_are_aggregated_in_hash_maps(spark, tmp_path):
    p = _small_file(polygons_of(spark, [square(0, 0)], [square(1, 0)], [square(5, 5)]), tmp_path / "p")
    found = polygons.must_not_have_gaps(p)
    assert "SortAggregate" not in _plan(found)
    # directions stay: the common edge passes, all others are there as they stand
    edges = rows(boundary_segments(p).where("not (x1 = 1 and x2 = 1 and y1 + y2 = 1)"), "fid", "x1", "y1", "x2", "y2")
    assert rows(found, "fid", "x1", "y1", "x2", "y2") == edges


@pytest.mark.parametrize("name", ["a.geojson", "a.gpkg", "a.shp"])
def test_single_files_are_written_without_sending_features_to_the_driver(spark, tmp_path, monkeypatch, name):
    line = [([(float(k), 0.0), (float(k), 1.0)], None) for k in range(3)]
    df = spark.createDataFrame([("LineString", [p]) for p in line], "kind string, parts array<struct<coords:array<struct<x:double,y:double>>,rings:array<array<struct<x:double,y:double>>>>>")

    def refused(*_, **__):
        raise AssertionError("features come as results of tasks")

    with monkeypatch.context() as m:
        m.setattr(type(df), "toLocalIterator", refused)
        writers.write_features(df.coalesce(1), str(tmp_path / name))
    found = readers.read_features(spark, str(tmp_path / name))
    assert [[c["x"] for c in r["parts"][0]["coords"]] for r in found.orderBy("fid").collect()] == [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]


def test_features_of_a_file_are_not_held_all_at_once():
    made = []

    def parse(data):
        for k in range(20_000):
            made.append(k)
            yield "Point", [{"coords": [{"x": float(k), "y": 0.0}], "rings": None}]

    class Held:
        """Stands for a frame: gives the function that tasks run."""

        def mapInArrow(self, run, schema):
            return run

    out = readers._parsed(Held(), parse)(iter([pa.RecordBatch.from_pylist([{"content": b"x"}], pa.schema([("content", pa.binary())]))]))
    assert next(out).num_rows < 20_000 and len(made) < 20_000
    assert sum(b.num_rows for b in out) + 5_000 == 20_000


def test_lines_in_convex_polygons_are_decided_many_at_once(spark, monkeypatch):
    """As the exact kernel decides them, and without it."""
    diamond = [(3.0, 0.0), (6.0, 3.0), (3.0, 6.0), (0.0, 3.0), (3.0, 0.0)]
    coords = [[(2, 2), (4, 4)], [(3, 0), (6, 3)], [(4, 1), (5, 2)], [(3, 3), (3, 3)], [(3, 0), (3, 0)], [(0, 3), (6, 3)], [(1, 2), (1, 5)], [(4, 1), (5, 2), (3, 3)]]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    told = lambda c: [{"x": float(x), "y": float(y)} for x, y in c]
    for ring in (diamond, diamond[::-1]):
        inside, done = lines._in_convex(pa.array([told(c) for c in coords], kind), pa.array([[told(ring)]] * len(coords), pa.list_(kind)))
        exactly = [exact.line_inside([exact.point(*map(float, p)) for p in c], exact.edges_of(exact.rings_of([told(ring)]))) for c in coords]
        assert done.all() and inside.tolist() == exactly == [True, False, False, True, False, True, False, True]
    # an L-shape, and numbers that doubles leave open, go to the exact kernel
    ell = told([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)])
    fine = told([(0.1, 0.1), (0.7, 0.1), (0.7, 0.7), (0.1, 0.1)])
    _, done = lines._in_convex(pa.array([told([(1, 1), (3, 1)]), told([(0.3, 0.3), (0.4, 0.4)])], kind), pa.array([[ell], [fine]], pa.list_(kind)))
    assert not done.any()


def test_robust_meetings_of_whole_numbers_take_one_join(spark):
    whole = lines_of(spark, [(0, 0), (4, 4)], [(0, 4), (4, 0)], [(2, 2), (6, 6)])
    fine = lines_of(spark, [(0.1, 0.1), (0.7, 0.7)], [(0.3, 0.3), (0.9, 0.2)])
    for df, kernel in ((whole, False), (fine, True)):
        found = lines.segment_meetings(lines.explode_lines(df), robust=True)
        assert ("MapInArrow" in _plan(found)) == kernel
    assert rows(lines.segment_meetings(lines.explode_lines(whole), robust=True), "kind", "x", "y") == [("collinear", 2.0, 2.0), ("improper", 2.0, 2.0), ("proper", 2.0, 2.0)]
