import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import polygons, rows, square
from topolith.functions import geometry as g
from topolith.operators import exact
from topolith.operators import polygons as rule

SEGMENT = ("x1", "y1", "x2", "y2")


def _areas(df):
    return sorted(round(r[0], 9) for r in df.select(g.polygon_area(F.col("rings"))).collect())


def test_inner_square_is_the_overlap(spark):
    found = rule.must_not_overlap(polygons(spark, [square(0, 0)], [square(0.25, 0.25, 0.5)]))
    assert _areas(found) == [0.25]
    found = rule.must_not_overlap_with(polygons(spark, [square(0, 0)]), polygons(spark, [square(0.25, 0.25, 0.5)]))
    assert _areas(found) == [0.25]


def test_touching_polygons_do_not_overlap(spark):
    given = polygons(spark, [square(0, 0)], [square(1, 0)], [square(2, 1)], [[(1, 1), (0, 2), (1, 2), (1, 1)]])
    assert rule.must_not_overlap(given).count() == 0


def test_holes_are_honoured(spark):
    ring = [square(0, 0, 6), square(1, 1, 4)]
    found = rule.must_not_overlap(polygons(spark, ring, [square(2, 2, 2)]))
    assert found.count() == 0
    found = rule.must_not_overlap(polygons(spark, ring, [square(0, 0, 6)]))
    assert _areas(found) == [20.0]


def test_an_overlap_may_have_several_pieces(spark):
    comb = [(0, 0), (7, 0), (7, 3), (5, 3), (5, 1), (4, 1), (4, 3), (3, 3), (3, 1), (2, 1), (2, 3), (0, 3), (0, 0)]
    found = rule.must_not_overlap(polygons(spark, [comb], [[(0, 2), (8, 2), (8, 4), (0, 4), (0, 2)]]))
    assert _areas(found) == [1.0, 2.0, 2.0]


def test_triangles(spark):
    found = rule.must_not_overlap(polygons(spark, [[(0, 0), (4, 0), (0, 4), (0, 0)]], [[(0, 0), (0, 4), (4, 4), (0, 0)]]))
    assert _areas(found) == [4.0]


@pytest.mark.parametrize("seed", range(12))
def test_areas_add_up(seed):
    """Over a grid of cells, the areas of the intersections add up to the polygon's own."""
    r = random.Random(seed)
    n = r.randrange(3, 8)
    pts = sorted({(r.randrange(12), r.randrange(12)) for _ in range(n)})
    if len(pts) < 3:
        return
    cx, cy = sum(p[0] for p in pts) / len(pts), sum(p[1] for p in pts) / len(pts)
    import math

    ring = sorted(pts, key=lambda p: (math.atan2(p[1] - cy, p[0] - cx), p))
    ring.append(ring[0])
    poly = exact.rings_of([[{"x": float(x), "y": float(y)} for x, y in ring]])
    if not poly or exact.area(poly[0]) == 0:
        return
    total = 0
    for x in range(0, 12, 3):
        for y in range(0, 12, 4):
            cell = exact.rings_of([[{"x": float(a), "y": float(b)} for a, b in [(x, y), (x + 3, y), (x + 3, y + 4), (x, y + 4), (x, y)]]])
            for piece in exact.intersection(poly, cell):
                total += exact.area(piece[0]) + sum(exact.area(h) for h in piece[1:])
    assert total == exact.area(poly[0])


@pytest.mark.parametrize("seed", range(8))
def test_convex_polygons_give_what_the_general_way_gives(seed):
    r = random.Random(seed)

    def hull():
        pts = sorted({(float(r.randrange(9)), float(r.randrange(9))) for _ in range(9)})
        out = []
        for part in (pts, pts[::-1]):
            side = []
            for p in part:
                while len(side) > 1 and exact.turn(exact.point(*side[-2]), exact.point(*side[-1]), exact.point(*p)) <= 0:
                    side.pop()
                side.append(p)
            out += side[:-1]
        return exact.rings_of([[{"x": x, "y": y} for x, y in [*out, out[0]]]])

    one, two = hull(), hull()
    assert exact.is_convex(one[0]) and exact.is_convex(two[0])
    quick = exact.intersection(one, two)
    hole = [[p for p in one[0]], []]  # an empty second ring sends it the general way
    assert quick == exact.intersection(hole, two)


def test_a_lone_polygon_is_all_gaps(spark):
    assert rule.must_not_have_gaps(polygons(spark, [square(0, 0)])).count() == 4


def test_neighbours_share_an_edge(spark):
    assert rule.must_not_have_gaps(polygons(spark, [square(0, 0)], [square(1, 0)])).count() == 6


def test_a_long_edge_passes_and_the_short_ones_it_faces_do_not(spark):
    long = [(0, 0), (1, 0), (1, 2), (0, 2), (0, 0)]
    found = rows(rule.must_not_have_gaps(polygons(spark, [long], [square(1, 0)], [square(1, 1)])), *SEGMENT)
    assert (1.0, 0.0, 1.0, 2.0) not in found
    assert (1.0, 1.0, 1.0, 0.0) in found and (1.0, 2.0, 1.0, 1.0) in found
