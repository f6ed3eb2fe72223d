"""Exact arithmetic on doubles, for the few cases that rounding leaves open, and polygon kernels.

These are plain Python functions on lists; the distributed operators send
them only pairs of geometries whose boxes meet.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

Point = tuple[int | Fraction, int | Fraction]


def number(v: float) -> int | Fraction:
    """A double as an exact number; whole ones as integers, which are faster."""
    return int(v) if v.is_integer() else Fraction(v)


def point(x: float, y: float) -> Point:
    return number(x), number(y)


def middle(p: Point, q: Point) -> Point:
    return Fraction(p[0] + q[0], 2), Fraction(p[1] + q[1], 2)


def turn(a: Point, b: Point, c: Point) -> int:
    """Sign of the orientation of three points."""
    d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (d > 0) - (d < 0)


def between(p: Point, a: Point, b: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meet(a: Point, b: Point, c: Point, d: Point) -> tuple[str, tuple]:
    """How two segments meet: ``none``, ``proper`` and ``improper`` with a point, ``collinear`` with a segment."""
    if not (max(a[0], b[0]) >= min(c[0], d[0]) and max(c[0], d[0]) >= min(a[0], b[0]) and max(a[1], b[1]) >= min(c[1], d[1]) and max(c[1], d[1]) >= min(a[1], b[1])):
        return "none", ()
    o1, o2, o3, o4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if not (o1 or o2 or o3 or o4):
        lo, hi = max(min(a, b), min(c, d)), min(max(a, b), max(c, d))
        return ("none", ()) if lo > hi else ("improper", (lo,)) if lo == hi else ("collinear", (lo, hi))
    if o1 * o2 < 0 and o3 * o4 < 0:
        t = Fraction((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0]))
        return "proper", ((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])),)
    for o, p, q, r in ((o1, c, a, b), (o2, d, a, b), (o3, a, c, d), (o4, b, c, d)):
        if o == 0 and between(p, q, r):
            return "improper", (p,)
    return "none", ()


Rings = list[list[Point]]


def rings_of(rings) -> Rings:
    """Closed rings with exact coordinates, repeated vertices once; exterior counter-clockwise, holes clockwise."""
    out = []
    for k, ring in enumerate(rings or ()):
        pts: list[Point] = []
        for c in ring or ():
            p = point(c["x"], c["y"])
            if not pts or p != pts[-1]:
                pts.append(p)
        if len(pts) > 1 and pts[0] != pts[-1]:
            pts.append(pts[0])
        if len(pts) < 4:
            continue
        if (area(pts) < 0) == (k == 0):
            pts.reverse()
        out.append(pts)
    return out


def area(ring: list[Point]) -> Fraction:
    return Fraction(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])), 2)


def edges_of(rings: Rings) -> list[tuple[Point, Point]]:
    return [(p, q) for ring in rings for p, q in zip(ring, ring[1:])]


def locate(p: Point, edges: list[tuple[Point, Point]], boxes: np.ndarray | None = None) -> int:
    """1 inside, 0 on the boundary, -1 outside. With their boxes, only edges at the point's height and to its right are looked at."""
    odd = False
    if boxes is not None:
        x, y = float(p[0]), float(p[1])
        edges = [edges[k] for k in np.flatnonzero((boxes[1] <= y) & (boxes[3] >= y) & (boxes[2] >= x)).tolist()]
    for a, b in edges:
        o = turn(a, b, p)
        if o == 0 and between(p, a, b):
            return 0
        if a[1] <= p[1] < b[1] and o > 0 or b[1] <= p[1] < a[1] and o < 0:
            odd = not odd
    return 1 if odd else -1


def boxes_of(edges: list[tuple[Point, Point]]) -> np.ndarray:
    """Least and greatest x and y of each edge, in doubles; rounding may widen a box but not lose a point that it is asked for."""
    xy = np.array([(float(p[0]), float(p[1]), float(q[0]), float(q[1])) for p, q in edges]).reshape(-1, 4)
    return np.stack((np.minimum(xy[:, 0], xy[:, 2]), np.minimum(xy[:, 1], xy[:, 3]), np.maximum(xy[:, 0], xy[:, 2]), np.maximum(xy[:, 1], xy[:, 3])))


def _near(boxes: np.ndarray, a: Point, b: Point) -> list[int]:
    """Edges whose boxes meet a segment's; conversions to doubles keep the order, so none is lost."""
    ax, ay, bx, by = float(a[0]), float(a[1]), float(b[0]), float(b[1])
    return np.flatnonzero((boxes[0] <= max(ax, bx)) & (boxes[2] >= min(ax, bx)) & (boxes[1] <= max(ay, by)) & (boxes[3] >= min(ay, by))).tolist()


def _cuts(a: Point, b: Point, edges: list[tuple[Point, Point]], boxes: np.ndarray) -> list[Point]:
    """A segment's ends and all points at which edges touch it, in its direction."""
    found = {a, b}
    for k in _near(boxes, a, b):
        found.update(meet(a, b, *edges[k])[1])
    return sorted(found, reverse=a > b)


def line_inside(coords: list[Point], edges: list[tuple[Point, Point]]) -> bool:
    """Whether a polygon contains a line: nothing outside, and not all on the boundary."""
    coords = [p for k, p in enumerate(coords) if not k or p != coords[k - 1]]
    boxes = boxes_of(edges)
    if len(coords) == 1:
        return locate(coords[0], edges, boxes) > 0
    inner = False
    for a, b in zip(coords, coords[1:]):
        cuts = _cuts(a, b, edges, boxes)
        for p, q in zip(cuts, cuts[1:]):
            where = locate(middle(p, q), edges, boxes)
            if where < 0:
                return False
            inner = inner or where > 0
    return inner


#: Whole numbers up to this have exact orientations in doubles.
WHOLE = float(1 << 24)


def _signs(ax, ay, bx, by, px, py, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of orientations, and where they are sure: of whole numbers always, of others beyond the rounding's bound."""
    left, right = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    bound = (np.abs(left) + np.abs(right)) * 3.3306690738754716e-16
    return np.sign(left - right), whole | (np.abs(left - right) > bound) | (bound == 0)


def _ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners of runs of numbers, and the numbers."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


def in_convex(x, y, first, n, rx, ry, rfirst, rn) -> tuple[np.ndarray, np.ndarray]:
    """For many lines and closed rings at once, whether a strictly convex ring contains its line, and where that is decided.

    Line k has the vertices ``first[k]`` to ``first[k] + n[k]`` of ``x, y``, its ring those of ``rx, ry`` from ``rfirst[k]`` on.
    Left open are rings of other shapes and lines with orientations that doubles leave open. A line within a convex
    ring runs along the boundary where both ends of a stretch lie on one edge's line, as does a line of one place.
    """
    count = len(n)
    with np.errstate(over="ignore", invalid="ignore"):
        plain = lambda v: (np.abs(v) <= WHOLE) & (np.floor(v) == v)
        whole = np.ones(count, bool)
        owner, at = _ragged(first, n)
        np.logical_and.at(whole, owner, plain(x[at]) & plain(y[at]))
        rowner, rat = _ragged(rfirst, rn)
        np.logical_and.at(whole, rowner, plain(rx[rat]) & plain(ry[rat]))
        done = (rn >= 4) & (n >= 1)
        last = rfirst + np.maximum(rn, 1) - 1
        done &= (rx[rfirst] == rx[last]) & (ry[rfirst] == ry[last])
        # all turns to one side, and once around: edges change their lexical direction twice
        edge, a = _ragged(rfirst, np.maximum(rn - 1, 0))
        b = a + 1
        c = np.where(b == last[edge], rfirst[edge] + 1, b + 1)
        turn, sure = _signs(rx[a], ry[a], rx[b], ry[b], rx[c], ry[c], whole[edge])
        to_left = np.bincount(edge, turn > 0, count) == rn - 1
        to_right = np.bincount(edge, turn < 0, count) == rn - 1
        up = lambda i, j: (rx[j] > rx[i]) | (rx[j] == rx[i]) & (ry[j] > ry[i])
        changes = np.bincount(edge, up(a, b) != up(b, c), count)
        done &= (to_left | to_right) & (np.bincount(edge, ~sure, count) == 0) & (changes == 2)
        side = np.where(to_left, 1.0, -1.0)
        # each vertex of a line with each edge of its ring
        edges = np.where(done, rn - 1, 0)
        vertex, e = _ragged(rfirst[owner], edges[owner])
        row, p = owner[vertex], at[vertex]
        turn, sure = _signs(rx[e], ry[e], rx[e + 1], ry[e + 1], x[p], y[p], whole[row])
        turn = turn * side[row]
        done &= np.bincount(row, ~sure, count) == 0
        inside = np.bincount(row, turn < 0, count) == 0
        # a stretch, or the one place, that lies along no edge
        following = np.where(at + 1 < first[owner] + n[owner], at + 1, np.where(n[owner] == 1, at, -1))
        q = following[vertex]
        go = q >= 0
        along, _ = _signs(rx[e[go]], ry[e[go]], rx[e[go] + 1], ry[e[go] + 1], x[q[go]], y[q[go]], whole[row[go]])
        on = np.bincount(vertex[go], (turn[go] == 0) & (along == 0), len(owner))
        free = np.bincount(owner, (following >= 0) & (on == 0), count) > 0
    return inside & free, done


def is_convex(ring: list[Point]) -> bool:
    """Whether a counter-clockwise ring never turns right and winds once."""
    open_ = ring[:-1]
    n = len(open_)
    if any(turn(open_[k - 1], open_[k], open_[(k + 1) % n]) < 0 for k in range(n)):
        return False
    # a ring that winds more than once changes its vertical direction more than twice
    ups = [q[1] > p[1] for p, q in zip(ring, ring[1:]) if q[1] != p[1]]
    return sum(a != b for a, b in zip(ups, ups[1:] + ups[:1])) == 2


def _clipped(one: list[Point], two: list[Point]) -> list[Rings]:
    """What two convex polygons share: the first, cut by each edge of the second."""
    points = one[:-1]
    for a, b in zip(two, two[1:]):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
        kept: list[Point] = []
        for k, p in enumerate(points):
            before, now, q = side[k - 1], side[k], points[k - 1]
            if before * now < 0:
                t = Fraction(before, before - now)
                kept.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if now >= 0:
                kept.append(p)
        points = [p for k, p in enumerate(kept) if p != kept[k - 1]]
        if len(points) < 3:
            return []
    ring = [*points, points[0]]
    return [[_simplified(ring)]] if area(ring) > 0 else []


def intersection(one: Rings, two: Rings) -> list[Rings]:
    """Polygons with area that two polygons share, each as its exterior and holes.

    Both boundaries are cut at all their meetings. A piece bounds the result
    if the result lies on one side of it only: beside a piece of its own
    boundary a polygon lies to the left (rings run so), elsewhere on both
    sides or on none. The pieces are then linked, turning clockwise as far
    as possible at each vertex, into simple rings. Two convex polygons without
    holes are simply cut by each other's edges.
    """
    if len(one) == len(two) == 1 and is_convex(one[0]) and is_convex(two[0]):
        return _clipped(one[0], two[0])
    ea, eb = edges_of(one), edges_of(two)
    boxes = boxes_of(ea), boxes_of(eb)
    own = [set(), set()]
    for k, (mine, others) in enumerate(((ea, eb), (eb, ea))):
        for a, b in mine:
            cuts = _cuts(a, b, others, boxes[1 - k])
            own[k].update(zip(cuts, cuts[1:]))

    def side(piece: tuple[Point, Point], k: int, edges) -> tuple[bool, bool]:
        p, q = piece
        if piece in own[k]:
            return True, (q, p) in own[k]
        if (q, p) in own[k]:
            return False, True
        at = locate(middle(p, q), edges, boxes[k]) > 0
        return at, at

    pieces: set[tuple[Point, Point]] = set()
    for p, q in own[0] | own[1]:
        (al, ar), (bl, br) = side((p, q), 0, ea), side((p, q), 1, eb)
        left, right = al and bl, ar and br
        if left and not right:
            pieces.add((p, q))
        elif right and not left:
            pieces.add((q, p))
    return _assembled(pieces)


def _assembled(pieces: set[tuple[Point, Point]]) -> list[Rings]:
    starts: dict[Point, list[Point]] = {}
    for p, q in pieces:
        starts.setdefault(p, []).append(q)
    left = set(pieces)
    rings: Rings = []
    for first in sorted(pieces):
        if first not in left:
            continue
        ring, (p, q) = [first[0]], first
        while (p, q) in left:
            left.discard((p, q))
            ring.append(q)
            ways = [w for w in starts.get(q, ()) if (q, w) in left]
            if not ways:
                break
            p, q = q, min(ways, key=lambda w: _Clockwise(q, p, w)) if len(ways) > 1 else ways[0]
        if len(ring) > 3 and ring[0] == ring[-1]:
            rings.append(_simplified(ring))
    outer = [r for r in rings if area(r) > 0]
    holes = [r for r in rings if area(r) < 0]
    out = [[r] for r in outer]
    for h in holes:
        probe = middle(h[0], h[1])
        around = [k for k, r in enumerate(outer) if locate(probe, edges_of([r])) >= 0]
        if around:
            out[min(around, key=lambda k: area(outer[k]))].append(h)
    return out


class _Clockwise:
    """Orders directions out of a point by the clockwise angle from the way back."""

    def __init__(self, at: Point, back: Point, to: Point):
        self.back = (back[0] - at[0], back[1] - at[1])
        self.to = (to[0] - at[0], to[1] - at[1])

    def _half(self) -> int:
        cross = self.back[0] * self.to[1] - self.back[1] * self.to[0]
        dot = self.back[0] * self.to[0] + self.back[1] * self.to[1]
        return 0 if cross < 0 or cross == 0 and dot < 0 else 1

    def __lt__(self, other: _Clockwise) -> bool:
        if self._half() != other._half():
            return self._half() < other._half()
        return self.to[0] * other.to[1] - self.to[1] * other.to[0] < 0


def _simplified(ring: list[Point]) -> list[Point]:
    """Without vertices in the middle of a straight stretch; begins at the least vertex."""
    open_ = ring[:-1]
    n = len(open_)
    kept = [p for k, p in enumerate(open_) if turn(open_[k - 1], p, open_[(k + 1) % n]) != 0] or open_
    k = kept.index(min(kept))
    return [*kept[k:], *kept[: k + 1]]
