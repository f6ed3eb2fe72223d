import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.helpers import lines, polygons, rows, square
from topolith.operators import exact
from topolith.operators import lines as rule
from topolith.operators.grid import grid_join
from topolith.operators.transforms import explode_lines

SEGMENT = ("x1", "y1", "x2", "y2")


def test_overlap_is_told_from_the_smaller_end(spark):
    found = rule.must_not_overlap(lines(spark, [(1, 1), (4, 4)], [(4, 4), (2, 2)]))
    assert rows(found, *SEGMENT) == [(2.0, 2.0, 4.0, 4.0)]


def test_overlap_with_keeps_the_direction(spark):
    found = rule.must_not_overlap_with(lines(spark, [(1, 1), (4, 4)]), lines(spark, [(4, 4), (2, 2)]))
    assert rows(found, *SEGMENT) == [(4.0, 4.0, 2.0, 2.0)]


def test_self_overlap_keeps_the_direction(spark):
    found = rule.must_not_self_overlap(lines(spark, [(1, 1), (4, 4), (2, 2)]))
    assert rows(found, *SEGMENT) == [(4.0, 4.0, 2.0, 2.0)]


def test_equal_lines_do_not_overlap_but_reversed_ones_do(spark):
    assert rule.must_not_overlap(lines(spark, [(0, 0), (2, 0)], [(0, 0), (2, 0)])).count() == 0
    assert rule.must_not_overlap(lines(spark, [(0, 0), (2, 0)], [(2, 0), (0, 0)])).count() == 1


def test_collinear_touch_in_a_point_is_no_overlap(spark):
    assert rule.must_not_overlap(lines(spark, [(0, 0), (1, 0)], [(1, 0), (2, 0)])).count() == 0


def test_partial_overlap_keeps_its_dangles(spark):
    given = lines(spark, [(0, 0), (2, 0)], [(1, 0), (3, 0)])
    assert rows(rule.must_not_overlap(given), *SEGMENT) == [(1.0, 0.0, 2.0, 0.0)]
    assert rule.must_not_have_dangles(given).count() == 4


def test_t_junction_is_neither_dangle_nor_intersection(spark):
    given = lines(spark, [(0, 0), (2, 0)], [(1, 0), (1, 1)])
    assert rows(rule.must_not_have_dangles(given), "x", "y") == [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]
    at, along = rule.must_not_intersect(given)
    assert at.count() == along.count() == 0


def test_crossing_is_one_point(spark):
    at, along = rule.must_not_intersect(lines(spark, [(0, 0), (2, 2)], [(0, 2), (2, 0)]))
    assert rows(at, "x", "y") == [(1.0, 1.0)] and along.count() == 0


def test_shared_inner_vertex_is_one_point(spark):
    at, _ = rule.must_not_intersect(lines(spark, [(0, 0), (1, 1), (2, 0)], [(0, 2), (1, 1), (2, 2)]))
    assert rows(at, "x", "y") == [(1.0, 1.0)]


def test_single_inner_vertex_touch_is_no_intersection(spark):
    at, _ = rule.must_not_intersect(lines(spark, [(0, 0), (1, 1), (2, 0)], [(0, 1), (1, 1)]))
    assert at.count() == 0


def test_closed_ring_has_no_dangles(spark):
    assert rule.must_not_have_dangles(lines(spark, square(0, 0))).count() == 0


def test_dangles_keep_repeats(spark):
    assert rule.must_not_have_dangles(lines(spark, [(0, 0), (1, 0)], [(0, 0), (1, 0)])).count() == 4


def test_lines_inside(spark):
    area = polygons(spark, [square(0, 0, 4)], [square(4, 0, 4)], [square(10, 0, 6), square(12, 2, 2)])
    given = lines(
        spark,
        [(1, 1), (3, 3)],  # 0 inside
        [(0, 0), (4, 0)],  # 1 along an edge
        [(0, 1), (4, 1)],  # 2 a chord from edge to edge
        [(3, 1), (5, 1)],  # 3 over two neighbours
        [(11, 3), (15, 3)],  # 4 through a hole
        [(0, 0), (4, 0), (4, 4), (2, 2)],  # 5 along edges, then inside
        [(11, 1), (15, 1)],  # 6 inside beside the hole
        [(12, 2), (14, 2)],  # 7 along the hole's edge
    )
    assert [r[0] for r in rows(rule.must_be_inside(given, area), "fid")] == [1, 3, 4, 7]


def _random_lines(seed, n=60, size=12):
    r = random.Random(seed)
    return [[(r.randrange(size), r.randrange(size)) for _ in range(r.choice((2, 2, 3)))] for _ in range(n)]


@pytest.mark.parametrize("seed,cell", [(1, None), (2, 0.7), (3, 5.0), (4, 100.0)])
def test_meetings_equal_brute_force(spark, seed, cell):
    given = lines(spark, *_random_lines(seed))
    found = rule.segment_meetings(explode_lines(given), cell)
    segs = sorted({tuple(r) for r in explode_lines(given).select(*SEGMENT).collect() if r[:2] != r[2:]})
    want = []
    for i, s in enumerate(segs):
        for t in segs[i + 1 :]:
            kind, at = exact.meet(exact.point(*s[:2]), exact.point(*s[2:]), exact.point(*t[:2]), exact.point(*t[2:]))
            if kind != "none":
                want.append((kind, *(round(float(v), 6) for p in at for v in p)))
    got = [(r["kind"], *(round(v, 6) for v in (r["x"], r["y"], r["to_x"], r["to_y"]) if v is not None)) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_robust_signs_decide_near_collinear_triples(spark):
    # a point so near to a line that doubles call it collinear
    a, b = (0.1, 0.1), (0.1 + 2**-52 * 8 + 12.0, 0.1 + 12.0)
    given = lines(spark, [a, b], [(0.5, 0.5), (0.5, 3.0)], [(12.0, 12.0), (24.0, 24.0)])
    found = {(r["kind"]) for r in rule.segment_meetings(explode_lines(given), robust=True).collect()}
    segs = [tuple(r) for r in explode_lines(given).select(*SEGMENT).collect()]
    want = set()
    for i, s in enumerate(segs):
        for t in segs[i + 1 :]:
            kind = exact.meet((Fraction(s[0]), Fraction(s[1])), (Fraction(s[2]), Fraction(s[3])), (Fraction(t[0]), Fraction(t[1])), (Fraction(t[2]), Fraction(t[3])))[0]
            want |= {kind} - {"none"}
    assert found == want


@pytest.mark.parametrize("cell", [None, 0.5, 3.0])
def test_grid_join_equals_cross_join(spark, cell):
    r = random.Random(7)
    box = lambda k: (k, x := r.uniform(-9, 9), y := r.uniform(-9, 9), x + r.choice((0, 0.1, 1, 15)), y + r.choice((0, 0.2, 2, 11)))
    schema = "fid long, minx double, miny double, maxx double, maxy double"
    a, b = (spark.createDataFrame([box(k) for k in range(n)], schema) for n in (70, 50))
    meet = "a_minx <= b_maxx and b_minx <= a_maxx and a_miny <= b_maxy and b_miny <= a_maxy"
    left, right = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for df, p in ((a, "a_"), (b, "b_")))
    want = rows(left.crossJoin(right).where(meet), "a_fid", "b_fid")
    assert rows(grid_join(a, b, cell=cell), "a_fid", "b_fid") == want
    own = left.crossJoin(a.select(*[F.col(c).alias("b_" + c) for c in a.columns])).where(meet).where("a_fid < b_fid")
    assert rows(grid_join(a, order=F.col("a_fid") < F.col("b_fid"), cell=cell), "a_fid", "b_fid") == rows(own, "a_fid", "b_fid")


def test_grid_join_shuffles_by_tile_and_makes_no_cartesian_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = lines(spark, *_random_lines(5))
        plan = rule.segment_meetings(explode_lines(given))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "SortMergeJoin" in plan
