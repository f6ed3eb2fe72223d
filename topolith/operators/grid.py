"""Spatial joins as equi-joins on tiles of grids of several sizes.

A geometry belongs to the level whose tiles are at least as wide and high as
its bounding box, so that it meets four tiles at most however large it is. It
is also entered at every coarser level in use, and a pair is looked for at the
level of its larger member. A pair that shares several tiles counts in one:
that of the lower left corner of the common part of both boxes (Dittrich and
Seeger, ICDE 2000), so nothing has to be deduplicated. Candidate pairs have
intersecting boxes; exact predicates come after the join.

The plan has an exchange for each side, on the tile; hot tiles are split by
adaptive execution, as any skewed join. No side is broadcast: the planner judges
a side by the bytes of its files, which say little of the rows and rings that
are made of them, and a side of a few MB would fill the driver and each task.
Where both sides of a self-join need the same columns, they share an exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("minx", "miny", "maxx", "maxy")
#: Coarsest level over the finest.
LEVELS = 24


def segment_box() -> list[Column]:
    return [
        F.least("x1", "x2").alias("minx"),
        F.least("y1", "y2").alias("miny"),
        F.greatest("x1", "x2").alias("maxx"),
        F.greatest("y1", "y2").alias("maxy"),
    ]


def with_segment_box(segments: DataFrame) -> DataFrame:
    return segments.select("*", *segment_box())


def with_ring_box(polygons: DataFrame) -> DataFrame:
    """Bounding box of the exterior."""
    xs, ys = F.transform(F.get("rings", F.lit(0)), lambda c: c["x"]), F.transform(F.get("rings", F.lit(0)), lambda c: c["y"])
    return polygons.select("*", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def with_line_box(lines: DataFrame) -> DataFrame:
    xs, ys = F.transform("coords", lambda c: c["x"]), F.transform("coords", lambda c: c["y"])
    return lines.select("*", F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def with_point_box(points: DataFrame) -> DataFrame:
    return points.select("*", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))


def _side() -> Column:
    return F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))


def measured(*sides: DataFrame | Column) -> tuple:
    """The greatest mean and the greatest of the sides of the inputs' boxes, in one job; after the inputs further sums over them may be asked for."""
    more = [c.alias(f"more_{k}") for k, c in enumerate(s for s in sides if isinstance(s, Column))]
    frames = [s for s in sides if not isinstance(s, Column)]
    rows = [_known(df).agg(F.avg(_side()).alias("mean"), F.max(_side()).alias("most"), *more) for df in frames]
    found = reduce(DataFrame.unionAll, rows).collect()
    sums = [sum(r[f"more_{k}"] or 0 for r in found) for k in range(len(more))]
    return max(float(r["mean"] or 0.0) for r in found), max(float(r["most"] or 0.0) for r in found), *sums


def _known(df: DataFrame) -> DataFrame:
    return df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in BOX))


def _level(cell: float) -> Column:
    raw = F.ceil(F.log2(F.greatest(_side(), F.lit(cell)) / F.lit(cell))).cast("int")
    # rounding in the logarithm must not leave a side wider than its tile
    raw = F.when(_side() > F.lit(cell) * F.pow(F.lit(2.0), raw), raw + 1).otherwise(raw)
    return F.least(raw, F.lit(LEVELS))


def _size(level: Column, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), level)


def _tiles(df: DataFrame, level: Column, cell: float) -> DataFrame:
    """A row for each tile that a box meets at a level."""
    tile = lambda c: F.floor(F.col(c) / _size(F.col("_lv"), cell)).cast("long")
    return (
        df.withColumn("_lv", level)
        .withColumn("_cx", F.explode(F.sequence(tile("minx"), tile("maxx"))))
        .withColumn("_cy", F.explode(F.sequence(tile("miny"), tile("maxy"))))
    )


def _prefixed(df: DataFrame, prefix: str, same: tuple[str, ...]) -> DataFrame:
    shared = [F.col(c).alias("_k_" + c) for c in same]
    return df.select(*[F.col(c).alias(c if c in ("_lv", "_cx", "_cy") else prefix + c) for c in df.columns], *shared)


def _meet(home: DataFrame, probe: DataFrame, cell: float, same: tuple[str, ...]) -> DataFrame:
    pairs = home.join(probe.hint("merge"), ["_lv", "_cx", "_cy", *["_k_" + c for c in same]])
    lower = {c: F.greatest(F.col(f"a_min{c}"), F.col(f"b_min{c}")) for c in "xy"}
    upper = {c: F.least(F.col(f"a_max{c}"), F.col(f"b_max{c}")) for c in "xy"}
    size = _size(F.col("_lv"), cell)
    return pairs.where(
        (lower["x"] <= upper["x"])
        & (lower["y"] <= upper["y"])
        & (F.floor(lower["x"] / size) == F.col("_cx"))
        & (F.floor(lower["y"] / size) == F.col("_cy"))
    )


def grid_join(a: DataFrame, b: DataFrame | None = None, order: Column | None = None, cell: float | None = None, same: tuple[str, ...] = (), sizes: tuple[float, float] | None = None) -> DataFrame:
    """Pairs of rows with intersecting (closed) boxes; columns come back prefixed ``a_`` and ``b_``.

    Inputs carry ``minx, miny, maxx, maxy``; rows where one is null or no
    number are left out. Without ``b``, pairs are unordered pairs of rows of
    ``a`` told apart by ``order`` (a boolean column over both prefixes that
    holds for exactly one of two orders). ``cell`` is the finest tile's side,
    by default twice the mean side of the boxes. Only rows equal in the columns
    ``same`` are paired, if any are given. ``sizes`` is what ``measured`` gives for
    the inputs, or for rows of which all boxes are, where these cost less to read.
    """
    own = b is None
    sides = [_known(a)] if own else [_known(a), _known(b)]
    if own and order is None:
        raise ValueError("a self-join needs an order")
    mean, widest = sizes or measured(*sides)
    cell = cell or (2 * mean if mean > 0 else 1.0)
    top = 0
    while cell * 2.0**top < widest and top < LEVELS:
        top += 1
    if top == LEVELS:
        raise ValueError(f"boxes are too unlike in size for tiles of {cell}; pass a larger cell")

    def entered(df: DataFrame, prefix: str, levels: Column) -> DataFrame:
        df = df.withColumn("_own", _level(cell))
        return _prefixed(_tiles(df.withColumn("_at", F.explode(levels)), F.col("_at"), cell), prefix, same)

    if top == 0:
        at = F.array(F.lit(0))
        left = entered(sides[0], "a_", at)
        right = entered(sides[0] if own else sides[1], "b_", at)
        out = _meet(left, right, cell, same)
        out = out.where(order) if own else out
    else:
        home, probe = F.array(F.col("_own")), F.sequence(F.col("_own"), F.lit(top))
        left, right = entered(sides[0], "a_", home), entered(sides[0] if own else sides[1], "b_", probe)
        out = _meet(left, right, cell, same)
        if own:
            # the larger one is at home; its mate may be smaller or as large, and either may come first
            out = out.where((F.col("b__own") < F.col("a__own")) | order)
            swap = ~order & (F.col("b__own") < F.col("a__own"))
            names = [c for c in sides[0].columns]
            out = out.select(
                *[F.when(swap, F.col("b_" + n)).otherwise(F.col("a_" + n)).alias("a_" + n) for n in names],
                *[F.when(swap, F.col("a_" + n)).otherwise(F.col("b_" + n)).alias("b_" + n) for n in names],
            )
        else:
            finer = _meet(entered(sides[1], "b_", home), entered(sides[0], "a_", probe), cell, same).where("a__own < b__own")
            keep = [*["a_" + c for c in sides[0].columns], *["b_" + c for c in sides[1].columns]]
            out = out.select(*keep).unionByName(finer.select(*keep))
    return out.select(*["a_" + c for c in sides[0].columns], *["b_" + c for c in (sides[0] if own else sides[1]).columns])
