"""Clusters of observations: components, numbering, guarded attachment, confidence and conflicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import ErConfig
from evidentia.functions.text import folded
from evidentia.plans.components import connected_components
from evidentia.plans.groups import map_groups
from evidentia.plans.runtime import staged

CLUSTER = "case_id STRING, cluster_id STRING, obs_id STRING, member_ord BIGINT"


def components(obs: DataFrame, edges: DataFrame, bounded: bool = True) -> DataFrame:
    """(case_id, obs_id, ord, component): the least `ord` that merging edges connect an observation with.

    bounded: edges per case are capped, so a case's union-find fits in a task; else the components are found in rounds over all
    cases at once.
    """
    merging = edges.where("merges").select("case_id", F.col("ord_a").alias("a"), F.col("ord_b").alias("b"))
    if bounded:

        def unite(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            for a, b in rows:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
            yield from ((*key, x, find(x)) for x in list(up))

        comps = map_groups(merging, ["case_id"], ["a", "b"], unite, "case_id STRING, ord BIGINT, component BIGINT")
    else:
        node = lambda c: F.struct(F.col("case_id"), F.col(c).alias("ord"))
        found = connected_components(merging.select(node("a").alias("src"), node("b").alias("dst")))
        comps = found.select(F.col("node.case_id").alias("case_id"), F.col("node.ord").alias("ord"), F.col("component.ord").alias("component"))
    return obs.select("case_id", "obs_id", "ord").join(comps, ["case_id", "ord"], "left").withColumn("component", F.coalesce("component", "ord"))


def numbered(comps: DataFrame) -> DataFrame:
    """cluster_id C1, C2, ... in the order of each cluster's first observation; members in string order."""
    number = F.dense_rank().over(Window.partitionBy("case_id").orderBy("component"))
    member = F.row_number().over(Window.partitionBy("case_id", "component").orderBy("obs_id"))
    return comps.select("case_id", F.concat(F.lit("C"), number).alias("cluster_id"), "obs_id", member.cast("long").alias("member_ord"))


def attachments(clusters: DataFrame, edges: DataFrame, cfg: ErConfig, keep: Callable[[DataFrame, str], DataFrame] = staged) -> tuple[DataFrame, DataFrame]:
    """Fold each case's likely and possible edges, in order (obs_id_1, obs_id_2), over its clusters.

    An edge with a single observation at an end moves it to the other end's cluster if the weight is high enough, else both ends
    get a candidate mention of each other. Which ends are single is settled before the edge changes anything. The fold depends
    on its order, so it runs per case, over the edges with an end that starts out single. Returns moves (case_id, obs_id, to, n: their order) and
    mentions (case_id, obs_id, mention_ord, candidate_alias, score, reasons). `keep` writes the fold's result, which both read.
    """
    sizes = clusters.groupBy("case_id", "cluster_id").agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, ["case_id", "cluster_id"]).select("case_id", "obs_id", "cluster_id", "size")
    e = edges.where("classification in ('likely', 'possible')").select("case_id", "obs_id_1", "obs_id_2", "alias_1", "alias_2", "weight", "reasons")
    for i in "12":
        e = e.join(placed.withColumnsRenamed({"obs_id": f"obs_id_{i}", "cluster_id": f"cluster_{i}", "size": f"size_{i}"}), ["case_id", f"obs_id_{i}"])
    # a cluster that has more than one member never becomes single, so other edges do nothing
    e = e.where("size_1 = 1 or size_2 = 1")
    least = cfg.attachment_threshold

    def fold(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        of: dict[str, str] = {}
        size: dict[str, int] = {}
        n = 0
        for seq, (one, two, alias_1, alias_2, weight, reasons, cluster_1, cluster_2, size_1, size_2) in enumerate(rows):
            for x, c, k in ((one, cluster_1, size_1), (two, cluster_2, size_2)):
                of.setdefault(x, c), size.setdefault(c, k)
            single = [size[of[x]] == 1 for x in (one, two)]
            for i, (is_single, x, y, ax, ay) in enumerate(((single[0], one, two, alias_1, alias_2), (single[1], two, one, alias_2, alias_1))):
                if is_single and weight >= least:
                    size[of[x]] -= 1
                    of[x] = of[y]
                    size[of[x]] += 1
                    yield (*key, "move", of[x], x, 2 * seq + i, None, None, None)
                elif is_single:
                    yield (*key, "mention", None, x, n, ay, weight, reasons)
                    yield (*key, "mention", None, y, n + 1, ax, weight, reasons)
                    n += 2

    made = map_groups(e, ["case_id"], ["obs_id_1", "obs_id_2", "alias_1", "alias_2", "weight", "reasons", "cluster_1", "cluster_2", "size_1", "size_2"], fold, "case_id STRING, kind STRING, cluster_id STRING, obs_id STRING, n BIGINT, candidate_alias STRING, score DOUBLE, reasons ARRAY<STRING>", order=["obs_id_1", "obs_id_2"])
    made = keep(made, "attachments")
    moves = made.where("kind = 'move'").select("case_id", "obs_id", F.col("cluster_id").alias("to"), "n")
    mentions = made.where("kind = 'mention'").select("case_id", "obs_id", F.col("n").alias("mention_ord"), "candidate_alias", F.round("score", 4).alias("score"), "reasons")
    return moves, mentions


def moved(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    """Clusters after the moves: those that moved come last in their cluster, in the order of their moves."""
    after = clusters.join(moves, ["case_id", "obs_id"], "left").select("case_id", F.coalesce("to", "cluster_id").alias("cluster_id"), "obs_id", "n", "member_ord")
    order = Window.partitionBy("case_id", "cluster_id").orderBy(F.col("n").asc_nulls_first(), "member_ord")
    return after.select("case_id", "cluster_id", "obs_id", F.row_number().over(order).cast("long").alias("member_ord"))


def attach(clusters: DataFrame, edges: DataFrame, cfg: ErConfig) -> tuple[DataFrame, DataFrame]:
    """Members after the fold, and mentions."""
    moves, mentions = attachments(clusters, edges, cfg)
    return moved(clusters, moves), mentions


def confidence(clusters: DataFrame, obs: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, cluster_id, size, cluster_confidence): the confirmed edges' weights inside, weighted by their ends' mean confidence, or else the members' mean confidence."""
    member = clusters.join(obs.select("case_id", "obs_id", "confidence"), ["case_id", "obs_id"])
    size = member.groupBy("case_id", "cluster_id").agg(F.count("*").alias("size"), F.avg("confidence").alias("mean"))
    where = clusters.select("case_id", "obs_id", "cluster_id")
    w = (F.col("confidence_a") + F.col("confidence_b")) / 2.0
    inside = (
        edges.where("classification = 'confirmed'")
        .join(where.withColumnsRenamed({"obs_id": "obs_id_1", "cluster_id": "c1"}), ["case_id", "obs_id_1"])
        .join(where.withColumnsRenamed({"obs_id": "obs_id_2", "cluster_id": "c2"}), ["case_id", "obs_id_2"])
        .where("c1 = c2")
        .groupBy("case_id", F.col("c1").alias("cluster_id"))
        .agg(F.sum(w).alias("tw"), F.sum(w * F.col("weight")).alias("ws"))
    )
    by = F.when((F.col("size") > 1) & (F.coalesce("tw", F.lit(0.0)) > 0), F.col("ws") / F.col("tw")).otherwise(F.col("mean"))
    return size.join(inside, ["case_id", "cluster_id"], "left").select("case_id", "cluster_id", "size", by.alias("cluster_confidence"))


def physical_impossibilities(clusters: DataFrame, obs: DataFrame) -> DataFrame:
    """One row for each cluster that is in two places in one second, with the earliest such second. A grouping, not a self-join."""
    placed = clusters.join(obs.select("case_id", "obs_id", folded(F.col("location")).alias("loc"), "time_offset_sec"), ["case_id", "obs_id"]).where("loc != ''")
    at = placed.groupBy("case_id", "cluster_id", "time_offset_sec").agg(F.min("loc").alias("lo"), F.max("loc").alias("hi")).where("lo != hi")
    return at.groupBy("case_id", "cluster_id").agg(F.min("time_offset_sec").alias("at_sec"))


def oversized(sizes: DataFrame, factor: float) -> DataFrame:
    """Clusters larger than their case's mean size plus factor population deviations (1.0 where the case has one cluster)."""
    per = sizes.groupBy("case_id").agg(F.avg("size").alias("m"), F.stddev_pop("size").alias("s"), F.count("*").alias("k"))
    limit = F.col("m") + factor * F.when(F.col("k") >= 2, F.col("s")).otherwise(1.0)
    return sizes.join(per, "case_id").withColumn("threshold", limit).where(F.col("size") > F.col("threshold")).select("case_id", "cluster_id", "size", "threshold")


def conflicts(clusters: DataFrame, obs: DataFrame, conf: DataFrame, cfg: ErConfig) -> DataFrame:
    """(case_id, cluster_id, type, detail, cluster_confidence, size, threshold): what needs a person's eye."""
    none = F.lit(None)

    def rows(df: DataFrame, kind: str, detail: Column, c: Column = none, s: Column = none, t: Column = none) -> DataFrame:
        return df.select("case_id", "cluster_id", F.lit(kind).alias("type"), detail.alias("detail"), c.cast("double").alias("cluster_confidence"), s.cast("long").alias("size"), t.cast("double").alias("threshold"))

    place = physical_impossibilities(clusters, obs)
    low = conf.where(F.col("cluster_confidence") < cfg.cluster_confidence_floor)
    big = oversized(conf.select("case_id", "cluster_id", "size"), cfg.oversized_cluster_factor)
    return (
        rows(place, "physical_impossibility", F.format_string("%s is in different places at second %d", "cluster_id", "at_sec"))
        .unionByName(rows(low, "low_confidence", F.format_string("%s has confidence %.3f", "cluster_id", "cluster_confidence"), F.round("cluster_confidence", 4)))
        .unionByName(rows(big, "oversized_cluster", F.format_string("%s has %d members", "cluster_id", "size"), none, F.col("size"), F.round("threshold", 1)))
    )
