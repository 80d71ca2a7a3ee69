"""Connected components as DataFrame rounds (large star, small star)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.plans.runtime import staged, unstage

#: Up to so many edges the least neighbours are broadcast, being at most two to an edge; beyond it, only those of hot nodes are.
BROADCAST_EDGES = 50_000
#: A node with more than one in HOT_SHARE of all edge ends is hot, so there are at most HOT_SHARE hot nodes.
HOT_SHARE = 1000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """Label every node that has an edge to another node with the smallest node it reaches.

    Returns (node, component). Self edges and rows with a null end are ignored; repeated edges do no harm.
    Alternates large-star and small-star rounds, which end in stars after O(log^2 n) rounds. Each round aggregates
    min() per node with map-side combining, so a node of very high degree never meets in one task as a list; when the minimum is joined
    back, that of a hot node is broadcast, so its edges don't meet either. Each round's edges are written to the shared folder, and the round's before are deleted.
    """
    u, v = F.col(src), F.col(dst)
    e = staged(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct(), "edges")
    size, open_ = _state(e)
    for _ in range(max_rounds):
        if not open_:
            break
        large = _large_star(e, size, broadcast_edges)
        after = staged(_small_star(large, size, broadcast_edges), "edges")
        unstage(e)
        e = after
        size, open_ = _state(e)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    # in a settled forest of stars every hi has one lo, the least of its component
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    """(edges, nodes that keep them from being stars around their least nodes: larger end of two edges, or larger end of one and smaller end of another)."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = nodes.agg(F.sum("up").alias("size"), F.count_if(F.col("up") + F.col("down") > 1).alias("open")).first()
    return r["size"] or 0, r["open"]


def _with_least(rows: DataFrame, least: DataFrame, key: str, size: int, broadcast_edges: int) -> DataFrame:
    """rows joined to least (key, m, _n: rows of the key)."""
    if size <= broadcast_edges:
        return rows.join(F.broadcast(least.drop("_n")), key)
    hot = F.col("_n") * HOT_SHARE > F.lit(2 * size)
    few = F.broadcast(least.where(hot).drop("_n"))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(least.where(~hot).drop("_n"), key))


def _large_star(e: DataFrame, size: int, broadcast_edges: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = e.select(F.col("hi").alias("n"), F.col("lo").alias("x")).union(e.select("lo", "hi"))
    least = both.groupBy("n").agg(F.min("x").alias("m"), F.count("*").alias("_n")).select("n", F.least("n", "m").alias("m"), "_n")
    return _edges(_with_least(both.where("x > n"), least, "n", size, broadcast_edges), F.col("x"), F.col("m"))


def _small_star(e: DataFrame, size: int, broadcast_edges: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("_n"))
    down = _with_least(e, least, "hi", size, broadcast_edges)
    return _edges(down.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))), F.col("hi"), F.col("lo"))


def _edges(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.select(a.alias("hi"), b.alias("lo")).where("hi != lo").distinct()
