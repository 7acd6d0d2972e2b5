"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdata.plans.storage import SMALL_ROWS, broadcast_if_small, drop, in_tasks, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) for every node on an edge (``most`` edges, if known); self-loops and repeats don't matter.

    Each round links nodes to the least neighbour they know; it ends when every node hangs on its root, after about as many
    rounds as the logarithm of the longest path. Edges that hang on their roots from the start need none. Each round's edges are
    written, so a lost executor costs one round at most. Least neighbours of few edges are broadcast, which saves most of a small
    round's shuffles; those of more are shuffled. Nothing but a count comes to the driver otherwise. An empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e if most is None else in_tasks(e, most))
    while True:
        n = 2 * e.count()  # nodes and next edges at most
        few = n <= SMALL_ROWS
        # Done if no node hangs on two others and no root hangs on anything.
        many = in_tasks(e.groupBy("u").count(), n).where("count > 1").limit(1).count()
        above = e.select(F.col("u").alias("w"))
        deep = 0 if many else e.join(F.broadcast(above) if few else above, F.col("v") == F.col("w"), "left_semi").limit(1).count()
        if not many and not deep:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(in_tasks(e.select("v", "v").distinct(), n))
        # Large star: each neighbour above a node goes to the least of the node and its neighbours.
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        least = in_tasks(least, n)
        large = both.where("v > u").join(F.broadcast(least) if few else least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its lower neighbours go to the least of these.
        low = in_tasks(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"), n)
        hung = large.join(F.broadcast(low) if few else low, F.col("u") == F.col("c"))
        new = hung.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(in_tasks(new.where("u <> v").distinct(), n))
        drop(e)
        e = new


def join_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` after further edges ``a, b`` (both written tables): only the roots that these touch are linked anew.

    A node's root stays the smallest node of its component. Nodes of ``edges`` that ``roots`` doesn't have are added.
    """
    def root_of(side: str) -> Column:
        return F.coalesce(F.col(f"root_{side}"), F.col(side))

    known, n = broadcast_if_small(roots), 2 * edges.count()
    named = lambda side: known.select(F.col("node").alias(f"node_{side}"), F.col("root").alias(f"root_{side}"))
    new = edges.join(named("a"), F.col("a") == F.col("node_a"), "left").join(named("b"), F.col("b") == F.col("node_b"), "left")
    moved = connected_components(new.select(root_of("a").alias("a"), root_of("b").alias("b")), most=n).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = F.broadcast(moved) if n <= SMALL_ROWS else moved
    seen = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    seen = in_tasks(seen, n)
    fresh = seen.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.select("node", "root").union(fresh).join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
