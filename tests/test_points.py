import pytest

from tests.helpers import points, polygons, rows, square
from topolith.operators import points as rule

ONE, HALF = [square(0, 0)], [square(0.25, 0.25, 0.5)]


def test_coincident_points_are_reported_once_a_pair(spark):
    found = rule.must_not_overlap(points(spark, (181.2, 51.79), (181.2, 51.79), (184, 53)))
    assert rows(found, "x", "y") == [(181.2, 51.79)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5])
def test_multiplicity_is_that_of_unordered_pairs(spark, k):
    found = rule.must_not_overlap(points(spark, *[(1, 2)] * k, (9, 9)))
    assert found.count() == k * (k - 1) // 2


def test_overlap_with_another_input_counts_every_pair(spark):
    found = rule.must_not_overlap_with(points(spark, (1, 1), (1, 1), (2, 2)), points(spark, (1, 1), (1, 1), (1, 1), (3, 3)))
    assert found.count() == 6
    assert rows(found.distinct(), "fid", "x", "y") == [(0, 1.0, 1.0), (1, 1.0, 1.0)]


def test_points_inside_are_valid(spark):
    found = rule.must_be_inside(points(spark, (0.01, 0.01), (0.5, 0.5)), polygons(spark, ONE, HALF))
    assert found.count() == 0


def test_boundary_points_are_outside(spark):
    found = rule.must_be_inside(points(spark, (0, 0), (-1, -1), (999, 999), (0.5, 0.5), (0.5, 0)), polygons(spark, ONE, HALF))
    assert rows(found, "x", "y") == [(-1.0, -1.0), (0.0, 0.0), (0.5, 0.0), (999.0, 999.0)]


def test_holes_are_outside(spark):
    ring = [square(0, 0, 4), square(1, 1, 2)]
    found = rule.must_be_inside(points(spark, (2, 2), (1, 2), (0.5, 0.5)), polygons(spark, ring))
    assert rows(found, "x", "y") == [(1.0, 2.0), (2.0, 2.0)]


def test_points_that_are_no_numbers_are_left_out(spark):
    bad = points(spark, (float("nan"), 1), (float("nan"), 1), (0.0, -0.0), (-0.0, 0.0))
    assert rule.must_not_overlap(bad).count() == 1


def test_empty_inputs(spark):
    none = points(spark, (1, 1)).where("fid < 0")
    assert rule.must_not_overlap(none).count() == 0
    assert rule.must_be_inside(none, polygons(spark, ONE)).count() == 0
    assert rule.must_be_inside(points(spark, (1, 1)), polygons(spark, ONE).where("fid < 0")).count() == 1


@pytest.mark.parametrize("teeth", [3, 40, 300])
def test_polygons_of_few_and_many_edges(spark, teeth):
    """A comb with a hole: between its teeth is outside, in them inside; vertices, edges and the hole are neither."""
    comb = [(0, 0), (4 * teeth, 0)]
    for k in reversed(range(teeth)):
        comb += [(4 * k + 4, 10), (4 * k + 2, 2), (4 * k, 10)]
    rings = [[*comb, (0, 0)], [(0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5), (0.5, 0.5)]]
    asked = [(4 * k + dx, y) for k in range(teeth) for dx in (0, 1, 2, 3) for y in (0, 1.5, 2, 5, 9, 10, 11)] + [(0.75, 0.75), (0.5, 0.75)]

    def inside(x, y):
        if (x, y) in ((0.75, 0.75), (0.5, 0.75)) or not 0 < x < 4 * teeth or y <= 0:
            return False
        return y < 2 + 4 * abs(x % 4 - 2)

    found = {(r["x"], r["y"]) for r in rule.must_be_inside(points(spark, *asked), polygons(spark, rings)).collect()}
    assert found == {(float(x), float(y)) for x, y in asked if not inside(x, y)}
