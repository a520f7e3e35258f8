"""Connected components by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with m, the smallest v of u. A u with over a thousandth of ``total`` rows, of which there
    are under a thousand, gets it by a broadcast, so that no task holds all rows of a hub."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hub = F.col("n") * 1000 > F.lit(total)
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    return rows.join(hubs, "u").unionAll(rows.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m").hint("merge"), "u"))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("m")).withColumnRenamed("m", "v").distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Links of a node to its smallest neighbour, and of the others to that one. ``total`` is no more than
    the rows of ``e`` in the round before."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(e, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, space: Workspace, rounds: int = 100) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (u, v) except roots.

    Each round is written to the shared folder, so lineage stays one round long.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = space.write(e, "edges-0"), None
    total = e.count()
    for i in range(1, rounds + 1):
        if total:
            e = space.write(_large_star(e, total), f"large-{i}")
            total = e.count()
        e = space.write(_small_star(e, max(total, 1)), f"edges-{i}")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        total = state[0]
        space.drop(f"large-{i}")
        if i > 1:
            space.drop(f"edges-{i - 1}")
        if state == before or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
