"""Scalar geometry as columns: everything here stays in generated code or higher-order functions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LINE_KINDS, POINT_KINDS, POLYGON_KINDS


def is_point(kind: Column) -> Column:
    return kind.isin(*POINT_KINDS)


def is_line(kind: Column) -> Column:
    return kind.isin(*LINE_KINDS)


def is_polygon(kind: Column) -> Column:
    return kind.isin(*POLYGON_KINDS)


def clean(value: Column) -> Column:
    """Negative zero becomes zero, so that equal coordinates hash alike."""
    return value + F.lit(0.0)


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """Positive if a, b, c turn left; zero if they are on one line.

    Differences and products are doubles: exact for integers below 2^25. See
    ``unsure`` for the error's bound and ``exact`` for a way around it.
    """
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def unsure(ax, ay, bx, by, cx, cy) -> Column:
    """Whether rounding could have changed the sign of ``orientation``; it can't for whole numbers of 24 bits, see there."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    bound = (F.abs(left) + F.abs(right)) * F.lit(3.3306690738754716e-16)
    return (F.abs(left - right) <= bound) & (bound > 0) & ~whole(ax, ay, bx, by, cx, cy)


def whole(*values: Column) -> Column:
    """Whether all are whole numbers of 24 bits at most, whose differences, products and sums of two products are exact."""
    return reduce(and_, [(F.abs(v) <= F.lit(float(1 << 24))) & (v == F.rint(v)) for v in values])


def in_box(px, py, ax, ay, bx, by) -> Column:
    return (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx)) & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by))


def on_segment(px, py, ax, ay, bx, by) -> Column:
    """Whether a point lies on a closed segment."""
    return in_box(px, py, ax, ay, bx, by) & (orientation(ax, ay, bx, by, px, py) == 0)


def segment_contains(a: str, b: str) -> Column:
    """Whether segment a holds both ends of segment b; arguments are prefixes of x1, y1, x2, y2.

    A single point as b must lie strictly inside of a.
    """
    c = {p + n: F.col(p + n) for p in (a, b) for n in ("x1", "y1", "x2", "y2")}
    seg = (c[a + "x1"], c[a + "y1"], c[a + "x2"], c[a + "y2"])
    inside = on_segment(c[b + "x1"], c[b + "y1"], *seg) & on_segment(c[b + "x2"], c[b + "y2"], *seg)
    point = (c[b + "x1"] == c[b + "x2"]) & (c[b + "y1"] == c[b + "y2"])
    at_end = ((c[b + "x1"] == seg[0]) & (c[b + "y1"] == seg[1])) | ((c[b + "x1"] == seg[2]) & (c[b + "y1"] == seg[3]))
    return inside & ~(point & at_end)


def coord(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def envelope(coords: Column) -> dict[str, Column]:
    """Bounding box of an array of coordinates."""
    xs, ys = F.transform(coords, lambda c: c["x"]), F.transform(coords, lambda c: c["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def is_closed(coords: Column) -> Column:
    first, last = F.element_at(coords, 1), F.element_at(coords, -1)
    return (first["x"] == last["x"]) & (first["y"] == last["y"])


def rotated(coords: Column, x: Column, y: Column) -> Column:
    """A closed ring that starts at one of its vertices; any other line stays as it is."""
    open_ = F.slice(coords, 1, F.size(coords) - 1)
    at = F.array_position(open_, coord(x, y)).cast("int")
    moved = F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, F.lit(1), at - 1), F.array(coord(x, y)))
    return F.when(is_closed(coords) & (at > 0), moved).otherwise(coords)


def ring_edges(rings: Column) -> Column:
    """All edges of a polygon as structs x1, y1, x2, y2."""

    def edges(ring: Column) -> Column:
        return F.zip_with(
            F.slice(ring, F.lit(1), F.size(ring) - 1),
            F.slice(ring, F.lit(2), F.size(ring) - 1),
            lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
        )

    return F.flatten(F.transform(rings, edges))


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right crosses an edge: one going up with the point to its left, or down with it to its right."""
    turn = orientation(x1, y1, x2, y2, px, py)
    return ((y1 <= py) & (y2 > py) & (turn > 0)) | ((y1 > py) & (y2 <= py) & (turn < 0))


def point_in_polygon(px: Column, py: Column, edges: Column) -> Column:
    """Whether a point lies strictly inside; holes don't count as inside, nor does any boundary."""
    on_edge = F.exists(edges, lambda e: on_segment(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crosses(px, py, e["x1"], e["y1"], e["x2"], e["y2"]), 1).otherwise(0))
    return ~on_edge & (crossings % 2 == 1)


def is_box(rings: Column) -> Column:
    """A single ring of four sides along the axes, begun at any corner in any direction."""
    ring = F.get(rings, F.lit(0))
    at = lambda i, k: F.get(ring, F.lit(i))[k]
    turns = [
        (at(0, a) == at(1, a)) & (at(2, a) == at(3, a)) & (at(1, b) == at(2, b)) & (at(0, b) == at(3, b)) & (at(0, b) != at(1, b)) & (at(1, a) != at(2, a))
        for a, b in (("x", "y"), ("y", "x"))
    ]
    closed = (at(0, "x") == at(4, "x")) & (at(0, "y") == at(4, "y"))
    return F.coalesce((F.size(rings) == 1) & (F.size(ring) == 5) & closed & (turns[0] | turns[1]), F.lit(False))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, positive if it runs counter-clockwise."""
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    )
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / 2


def polygon_area(rings: Column) -> Column:
    """Area without holes."""
    return F.aggregate(
        F.transform(rings, lambda r, i: F.abs(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, v: a + v
    )


def ring_centroid(ring: Column) -> Column:
    """Centroid of the area of a closed ring, as a coordinate."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("w"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")),
    )
    total = lambda k: F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["w"] * e[k])
    area = F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["w"])
    return coord(total("x") / (3 * area), total("y") / (3 * area))


def line_length(coords: Column) -> Column:
    steps = F.zip_with(
        F.slice(coords, F.lit(1), F.size(coords) - 1),
        F.slice(coords, F.lit(2), F.size(coords) - 1),
        lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])),
    )
    return F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)
