"""Merging of lines that meet end to end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import on_segment
from .components import connected_components
from .grid import grid_join, with_point_box, with_segment_box
from .materialize import Stored
from .transforms import endpoints, explode_lines

_LINES = "fid long, part int, coords array<struct<x:double,y:double>>, members long"


def merge_lines(lines: DataFrame, cell: float | None = None, max_rounds: int = 50) -> DataFrame:
    """Lines merged at nodes that exactly two lines touch, both with an end.

    A node that a third line touches, anywhere along it, stays, as does one
    that a line passes through. Lines count as they stand: when two have
    merged into one, a node may become free, so rounds follow until none is
    left (one or two as a rule). A ring made of several lines closes.

    Returns ``fid`` and ``part`` (the least of the merged ones), ``coords``
    and ``members``. An open line starts at its smaller end; a merged ring
    starts at a node that other lines touch, if there is one, else at its
    least vertex, and runs towards the smaller neighbour of that. Lines that merge with none keep their direction. Lines of
    fewer than two vertices are left out.

    A round is three exchanges for the touches, O(log n) small joins for the
    components, and one exchange that brings a component's lines together in
    a sorted partition, where they are read as a stream; a component is as
    large as the line that it makes.
    """
    held = Stored(lines.where(F.size("coords") > 1).select("fid", F.col("part").cast("int").alias("part"), "coords", F.lit(1).cast("long").alias("members")))
    for _ in range(max_rounds):
        keyed = held.df.withColumn("id", _key())
        nodes = Stored(_nodes(keyed, cell))
        free = nodes.df.where("lines = 2 and ends")
        if free.isEmpty():
            nodes.drop()
            return held.df
        edges = free.select(F.col("least").alias("src"), F.col("most").alias("dst"))
        component = connected_components(edges)
        merged = Stored(_round(keyed, nodes.df, component))
        held.drop()
        nodes.drop()
        held = merged
    raise RuntimeError(f"lines still merge after {max_rounds} rounds")


def _key() -> Column:
    """A line's name in one number. Two lines of one number would only share a group; chains are told apart by places."""
    return F.xxhash64("fid", "part")


def _nodes(lines: DataFrame, cell: float | None) -> DataFrame:
    """For each place at which lines end: how many lines touch it, and whether all do with an end."""
    at = endpoints(lines.select("fid", "part", "coords")).select("x", "y").distinct()
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    caps = lines.select("fid", "part", *[f[k].alias(n + k) for n, f in (("s", first), ("e", last)) for k in "xy"])
    segments = with_segment_box(explode_lines(lines.select("fid", "part", "coords")))
    touches = grid_join(with_point_box(at), segments, cell=cell).where(
        on_segment(*(F.col(c) for c in ("a_x", "a_y", "b_x1", "b_y1", "b_x2", "b_y2")))
    )
    touches = touches.select(F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("b_fid").alias("fid"), F.col("b_part").alias("part")).distinct()
    ended = touches.join(caps, ["fid", "part"]).withColumn("end", F.expr("(x = sx and y = sy) or (x = ex and y = ey)"))
    return ended.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("lines"),
        F.bool_and("end").alias("ends"),
        F.min(_key()).alias("least"),
        F.max(_key()).alias("most"),
    )


def _round(lines: DataFrame, nodes: DataFrame, component: DataFrame) -> DataFrame:
    parts = lines.join(component.withColumnRenamed("node", "id"), "id")
    stay = lines.join(component.select(F.col("node").alias("id")), "id", "left_anti").select("fid", "part", "coords", "members")
    ends = parts.select("component", F.explode(F.array(F.element_at("coords", 1), F.element_at("coords", -1))).alias("c"))
    ends = ends.select("component", "c.x", "c.y").distinct()
    # what a component has to know of its nodes: where it may join, and where others touch it
    known = ends.join(nodes, ["x", "y"])
    at = lambda k: F.transform("coords", lambda c: c[k])
    left = parts.select("component", F.lit(1).alias("line"), "fid", "part", "members", at("x").alias("xs"), at("y").alias("ys"))
    right = known.select(
        "component",
        F.lit(0).alias("line"),
        F.expr("cast(lines = 2 and ends as long)").alias("fid"),
        F.expr("cast(lines > 2 as int)").alias("part"),
        F.lit(0).cast("long").alias("members"),
        F.array("x").alias("xs"),
        F.array("y").alias("ys"),
    )
    # a component's nodes and lines stand one after the other in a partition, which holds one component at a time
    dealt = left.unionByName(right).repartition("component").sortWithinPartitions("component", "line", "fid", "part")
    return stay.unionByName(dealt.mapInArrow(_chains, _LINES))


_ARROW = pa.schema(
    [("fid", pa.int64()), ("part", pa.int32()), ("coords", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("members", pa.int64())]
)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, lines, free, touched = None, [], set(), set()
    out: list[dict] = []
    vertices = 0

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, _ARROW)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("component", "line", "fid", "part", "members", "xs", "ys")]
        for component, line, fid, part, members, xs, ys in zip(*columns):
            if component != key:
                out += _chain(lines, free, touched)
                vertices += sum(len(r[3]) for r in lines)
                key, lines, free, touched = component, [], set(), set()
                if vertices > 100_000:
                    yield table()
                    out, vertices = [], 0
            if line:
                lines.append((fid, part, members, list(zip(xs, ys))))
            else:
                if fid:
                    free.add((xs[0], ys[0]))
                if part:
                    touched.add((xs[0], ys[0]))
    out += _chain(lines, free, touched)
    if out:
        yield table()


def _chain(rows: list[tuple], free: set, touched: set) -> list[dict]:
    """Joins the lines of one component at its free nodes: walks from line to line, each once."""
    at: dict[tuple, list[int]] = {}
    for k, (_, _, _, c) in enumerate(rows):
        for p in {c[0], c[-1]}:
            if p in free:
                at.setdefault(p, []).append(k)
    used = [False] * len(rows)

    def walk(k: int, end: tuple) -> list[tuple[int, bool]]:
        """The lines that follow line k at one of its ends, and whether each is turned round."""
        path = []
        while len(ways := at.get(end, ())) == 2:
            following = ways[0] if ways[1] == k else ways[1]
            if used[following]:
                break
            used[following] = True
            c = rows[following][3]
            turned = c[0] != end
            path.append((following, turned))
            k, end = following, c[0] if turned else c[-1]
        return path

    out = []
    for k, (_, _, _, c) in enumerate(rows):
        if used[k]:
            continue
        used[k] = True
        after = walk(k, c[-1])
        before = walk(k, c[0]) if c[0] != c[-1] else []  # a ring has one end
        path = [(j, not turned) for j, turned in reversed(before)] + [(k, False)] + after
        coords: list[tuple] = []
        for j, turned in path:
            piece = rows[j][3][::-1] if turned else rows[j][3]
            coords += piece[1:] if coords else piece
        if len(path) == 1:
            pass
        elif coords[0] == coords[-1]:
            start = min([p for p in coords if p in touched] or coords)
            i = coords.index(start)
            coords = coords[i:-1] + coords[: i + 1] if i else coords
            if coords[-2] < coords[1]:
                coords = coords[::-1]
        elif coords[-1] < coords[0]:
            coords = coords[::-1]
        fid, part = min((rows[j][0], rows[j][1]) for j, _ in path)
        out.append({"fid": fid, "part": part, "coords": [{"x": x, "y": y} for x, y in coords], "members": sum(rows[j][2] for j, _ in path)})
    return out
