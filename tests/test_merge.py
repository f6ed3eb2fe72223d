import pytest

from tests.helpers import lines, shapes
from topolith.operators.merge import merge_lines


def _merged(spark, *given):
    return shapes(merge_lines(lines(spark, *given)))


def test_one_line_stays(spark):
    assert _merged(spark, [(0, 0), (1, 1)]) == [[(0.0, 0.0), (1.0, 1.0)]]


def test_two_and_three_lines_end_to_end(spark):
    assert _merged(spark, [(0, 0), (1, 1)], [(1, 1), (2, 2)]) == [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]
    found = _merged(spark, [(9.5, 60.1), (9.6, 60.2)], [(9.7, 60.3), (9.6, 60.2)], [(9.7, 60.3), (9.8, 60.4)])
    assert found == [[(9.5, 60.1), (9.6, 60.2), (9.7, 60.3), (9.8, 60.4)]]


def test_disjoint_lines_stay(spark):
    assert len(_merged(spark, [(0, 0), (1, 1)], [(5, 5), (6, 6)])) == 2


def test_chain_and_a_disjoint_line(spark):
    found = _merged(spark, [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(2, 0), (3, 0)], [(9, 9), (8, 8)])
    assert found == [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], [(9.0, 9.0), (8.0, 8.0)]]


def test_three_lines_at_a_node_stay(spark):
    assert len(_merged(spark, [(0, 0), (1, 1)], [(1, 1), (2, 2)], [(1, 1), (2, 0)])) == 3


def test_a_line_through_a_node_keeps_it(spark):
    assert len(_merged(spark, [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, -1), (1, 0), (1, 1)])) == 3


def test_a_ring_of_three_lines_closes(spark):
    assert _merged(spark, [(0, 0), (1, 0)], [(1, 0), (0, 1)], [(0, 1), (0, 0)]) == [[(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]


def test_two_arcs_with_both_ends_in_common_close(spark):
    found = _merged(spark, [(0, 0), (1, 1), (2, 0)], [(2, 0), (1, -1), (0, 0)])
    assert len(found) == 1 and found[0][0] == found[0][-1] == (0.0, 0.0) and len(found[0]) == 5


def test_a_stick_on_two_arcs_merges_after_they_have_closed(spark):
    """Three lines meet at (2, 0); once the arcs are one ring, two do."""
    found = _merged(spark, [(0, 0), (1, 1), (2, 0)], [(2, 0), (1, -1), (0, 0)], [(2, 0), (3, 0)])
    assert len(found) == 1 and len(found[0]) == 6


def test_lollipop(spark):
    found = _merged(spark, [(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (-1, 0)])
    assert len(found) == 1 and len(found[0]) == 5


@pytest.mark.parametrize("n", [2, 9, 40])
def test_long_chains_in_any_order(spark, n):
    parts = [[(i, 0), (i + 1, 0)] if i % 3 else [(i + 1, 0), (i, 0)] for i in range(n)]
    found = _merged(spark, *(parts[::2] + parts[1::2]))
    assert found == [[(float(i), 0.0) for i in range(n + 1)]]


def test_members_and_ids(spark):
    got = merge_lines(lines(spark, [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(7, 7), (8, 8)])).collect()
    assert sorted((r["fid"], r["members"]) for r in got) == [(0, 2), (2, 1)]
