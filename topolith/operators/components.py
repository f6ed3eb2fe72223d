"""Connected components by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014):
large-star and small-star steps until the edge set is a forest of stars, which
takes O(log^2 n) rounds. Minima are plain aggregates with map-side combine
and the neighbours come back by an equi-join on the node and a part of its
neighbours, which adaptive execution can split further, so that a centre with
very many neighbours needs no single large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .materialize import Stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph given by its edges.

    ``edges`` holds two columns of one orderable type. Returns ``node`` and
    ``component`` (the smallest node of the component), one row for each node
    that has an edge to another node. Rows with a null end and loops are left
    out; repeated edges count once; an empty table gives an empty result.
    """
    lo, hi = F.least(src, dst), F.greatest(src, dst)
    given = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(hi.alias("u"), lo.alias("v"))
        .distinct()
    )
    held, before = _told(given)
    for _ in range(max_rounds):
        if not before["n"]:
            break
        following, after = _told(_small_star(_large_star(held.df)))
        held.drop()
        held = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = held.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(held.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _told(edges: DataFrame) -> tuple[Stored, dict]:
    """Edges written, and what tells them from other sets of edges, found while they are written."""
    seen = Observation()
    marks = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("v", "u")).alias("xor"),
    ]
    return Stored(edges.observe(seen, *marks)), seen.get


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _min_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _pairs(df: DataFrame, u: Column, v: Column) -> DataFrame:
    return df.select(u.alias("u"), v.alias("v")).where("u <> v").distinct()


#: Parts that a node's neighbours are dealt to where they meet its minimum.
_SALTS = 4


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects every neighbour larger than a node to the node's minimum."""
    near = _both(edges)
    least = _min_of(near).select("u", F.least("u", "m").alias("m"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(_SALTS)])).alias("s"))
    larger = near.where("v > u").withColumn("s", F.pmod(F.xxhash64("v"), F.lit(_SALTS)))
    return _pairs(larger.join(least, ["u", "s"]), F.col("v"), F.col("m"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _min_of(down)
    joined = down.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
