"""Canonical entities and the result document."""

from __future__ import annotations

import json
import time
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import ErConfig
from evidentia.operators import blocking, clusters, intake, scoring
from evidentia.plans.runtime import staged, unstage
from evidentia.schema import RAW


def numbered(members: DataFrame) -> DataFrame:
    """(case_id, cluster_id, entity_id): entity_1, entity_2 ... in the string order of cluster ids (C1, C10, C2)."""
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("cluster_id"))
    return members.select("case_id", "cluster_id").distinct().withColumn("entity_id", F.concat(F.lit("entity_"), n))


def aliases(members: DataFrame, obs: DataFrame) -> DataFrame:
    """(case_id, cluster_id, aliases, primary_alias): raw aliases in the order they are first seen; the most frequent, of equals the first seen."""
    seen = members.join(obs.select("case_id", "obs_id", "entity"), ["case_id", "obs_id"]).groupBy("case_id", "cluster_id", "entity").agg(F.count("*").alias("n"), F.min("member_ord").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "entity"))), lambda x: x["entity"])
    best = F.min_by("entity", F.struct((-F.col("n")).alias("n"), "first"))
    return seen.groupBy("case_id", "cluster_id").agg(listed.alias("aliases"), best.alias("primary_alias"))


def rollup(members: DataFrame, obs: DataFrame) -> DataFrame:
    """Per cluster: mentions, sorted distinct modalities, locations, roles and sources (observation ids), first and last time, span."""
    rows = members.join(obs.select("case_id", "obs_id", "modality", "location", "role", "ts_epoch"), ["case_id", "obs_id"])
    distinct = lambda c: F.array_sort(F.collect_set(c))
    valid = F.when(F.col("ts_epoch") > 0, F.col("ts_epoch"))
    shown = lambda c: F.coalesce(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    out = rows.groupBy("case_id", "cluster_id").agg(
        F.count("*").alias("total_mentions"),
        distinct("modality").alias("modalities"),
        distinct(F.when(F.col("location") != "", F.col("location"))).alias("locations"),
        distinct("role").alias("roles"),
        distinct("obs_id").alias("sources"),
        F.min(valid).alias("_lo"),
        F.max(valid).alias("_hi"),
    )
    return out.withColumn("earliest_timestamp", shown(F.col("_lo"))).withColumn("latest_timestamp", shown(F.col("_hi"))).withColumn("time_span_seconds", F.coalesce((F.col("_hi") - F.col("_lo")).cast("long"), F.lit(0))).drop("_lo", "_hi")


def touching(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the cluster of either end, each once for each cluster it touches, and the ends that lie there (the ends are exploded, so it is an equi-join)."""
    ends = edges.withColumn("obs_id", F.explode(F.array("obs_id_1", "obs_id_2")))
    hit = ends.join(members.select("case_id", "obs_id", "cluster_id"), ["case_id", "obs_id"])
    keep = ["alias_1", "alias_2", "weight", "classification", "hard_negative", "reasons"]
    return hit.groupBy("case_id", "cluster_id", "obs_id_1", "obs_id_2").agg(*(F.first(c).alias(c) for c in keep), F.collect_set("obs_id").alias("ends"))


def edge_counts(touched: DataFrame) -> DataFrame:
    yes = F.col("classification") == "confirmed"
    out = touched.groupBy("case_id", "cluster_id").agg(
        F.count_if(yes).alias("confirmed_edges"),
        F.count_if(F.col("classification").isin("likely", "possible")).alias("candidate_edges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(yes, F.col("ends")))))).alias("confirmed_mentions"),
    )
    return out


def candidate_mentions(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """(case_id, cluster_id, candidate_mentions): of mentions alike in alias and two decimals of the score, the first."""
    rows = mentions.join(members, ["case_id", "obs_id"])
    w = Window.partitionBy("case_id", "cluster_id", "candidate_alias", F.bround("score", 2)).orderBy("member_ord", "mention_ord")
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    listed = F.array_sort(F.collect_list(F.struct("member_ord", "mention_ord", "candidate_alias", "score", "reasons")))
    return first.groupBy("case_id", "cluster_id").agg(F.transform(listed, lambda x: F.struct(x["candidate_alias"].alias("candidate_alias"), x["score"].alias("score"), x["reasons"].alias("reasons"))).alias("candidate_mentions"))


def cluster_documents(members: DataFrame, obs: DataFrame, touched: DataFrame) -> DataFrame:
    """Per cluster: size, distinct aliases, sorted observation ids, and the edges that touch it."""
    rows = members.join(obs.select("case_id", "obs_id", "entity"), ["case_id", "obs_id"])
    base = rows.groupBy("case_id", "cluster_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("entity")).alias("aliases"), F.array_sort(F.collect_list("obs_id")).alias("obs_ids"))
    cls = F.col("classification")
    one = lambda c: F.when(c, 1).otherwise(0)
    edge = F.struct(
        "obs_id_1", "obs_id_2", "alias_1", "alias_2", F.round("weight", 4).alias("weight"), F.lit(1).alias("support"),
        F.struct(one(cls == "confirmed").alias("confirmed"), one(cls.isin("likely", "possible")).alias("candidate"), one(cls == "rejected").alias("rejected")).alias("classifications"),
        "hard_negative", F.when(cls == "rejected", F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"),
    )
    listed = touched.groupBy("case_id", "cluster_id").agg(F.array_sort(F.collect_list(edge)).alias("_e"))
    drop = lambda x: x.dropFields("obs_id_1", "obs_id_2")
    return base.join(listed, ["case_id", "cluster_id"], "left").select("*", F.coalesce(F.transform("_e", drop), F.array()).alias("edges")).drop("_e")


class Resolution:
    """The resolver's stages over raw observations of any number of cases, as DataFrames: obs, pairs, edges, clusters, members, mentions, conflicts, entities, documents.

    Each is made when it is first asked for. Stages that later ones read many times are written once to the shared folder, so that plans stay
    small and lost executors cost no more than their tasks; close() deletes them.
    """

    def __init__(self, raw: DataFrame, cfg: ErConfig | None = None, must_merge: DataFrame | None = None, must_not_merge: DataFrame | None = None, soft_hints: DataFrame | None = None, scorers: dict | None = None, large_cases: bool = True):
        self.cfg = cfg = cfg or ErConfig()
        if cfg.temporal_window_sec <= 0 or cfg.max_temporal_gap_sec <= cfg.temporal_window_sec:
            raise ValueError("needs 0 < temporal_window_sec < max_temporal_gap_sec")
        self.raw, self.must_merge, self.must_not_merge, self.soft_hints, self.scorers, self.large_cases = raw, must_merge, must_not_merge, soft_hints, scorers, large_cases
        self.quarantine = intake.quarantine(raw)
        self._kept: list[DataFrame] = []

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        self._kept.append(staged(df, name))
        return self._kept[-1]

    def close(self) -> None:
        """Delete what was written on the way; nothing of this resolution can be read afterwards."""
        unstage(*self._kept)

    @cached_property
    def obs(self) -> DataFrame:
        return self._staged(intake.observations(self.raw, self.cfg.check_duplicates), "observations")

    @cached_property
    def pairs(self) -> DataFrame:
        return blocking.candidates(self.obs, self.cfg, self.must_merge, self.must_not_merge, self.large_cases)

    @cached_property
    def edges(self) -> DataFrame:
        return self._staged(scoring.edges(self.pairs, self.cfg, self.soft_hints, self.scorers), "scored_edges")

    @cached_property
    def components(self) -> DataFrame:
        return clusters.components(self.obs, self.edges, self.cfg.max_pairs is not None)

    @cached_property
    def clusters(self) -> DataFrame:
        return self._staged(clusters.numbered(self.components), "clusters")

    @cached_property
    def _attached(self) -> tuple[DataFrame, DataFrame]:
        moves, mentions = clusters.attachments(self.clusters, self.edges, self.cfg, self._staged)
        return self._staged(clusters.moved(self.clusters, moves), "members"), mentions

    @property
    def members(self) -> DataFrame:
        return self._attached[0]

    @property
    def mentions(self) -> DataFrame:
        return self._attached[1]

    @cached_property
    def confidence(self) -> DataFrame:
        return self._staged(clusters.confidence(self.members, self.obs, self.edges), "confidence")

    @cached_property
    def conflicts(self) -> DataFrame:
        return clusters.conflicts(self.members, self.obs, self.confidence, self.cfg)

    @cached_property
    def touched(self) -> DataFrame:
        return self._staged(touching(self.members, self.edges), "touched")

    def entities(self) -> DataFrame:
        """One row per canonical entity."""
        key = ["case_id", "cluster_id"]
        texts = F.array().cast("array<string>")
        out = numbered(self.members).join(aliases(self.members, self.obs), key).join(rollup(self.members, self.obs), key).join(self.confidence.select(*key, F.round("cluster_confidence", 4).alias("confidence_score")), key)
        out = out.join(edge_counts(self.touched), key, "left").join(candidate_mentions(self.members, self.mentions), key, "left")
        none = F.array().cast("array<struct<candidate_alias:string,score:double,reasons:array<string>>>")
        return out.select(
            *key, "entity_id", "aliases", "primary_alias", "total_mentions", F.coalesce("confirmed_mentions", texts).alias("confirmed_mentions"), F.coalesce("candidate_mentions", none).alias("candidate_mentions"), "confidence_score",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("confirmed_edges", "candidate_edges")), "modalities", "locations", "roles", "sources", "earliest_timestamp", "latest_timestamp", "time_span_seconds",
        )

    def cluster_documents(self) -> DataFrame:
        return cluster_documents(self.members, self.obs, self.touched)

    def documents(self, timings: dict[str, float] | None = None) -> DataFrame:
        """One result document per case that has an observation, also one whose rows are all in quarantine. timings: seconds by stage, as timings() gives them, to be told in each."""
        def gathered(df: DataFrame, name: str, order: str) -> DataFrame:
            fields = [c for c in df.columns if c != "case_id"]
            inner = [c for c in fields if name != "canonical_entities" or c != "cluster_id"]
            rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*inner).alias("_v"))))
            return df.groupBy("case_id").agg(F.transform(rows, lambda x: x["_v"]).alias(name))

        cases = self.raw.select(F.coalesce(F.when(F.col("case_id") != "", F.col("case_id")), F.lit(intake.NO_CASE)).alias("case_id")).distinct()
        out = cases.join(gathered(self.entities(), "canonical_entities", "cluster_id"), "case_id", "left").join(gathered(self.cluster_documents(), "clusters", "cluster_id"), "case_id", "left")
        out = out.join(self.conflicts.groupBy("case_id").agg(F.count("*").alias("conflicts_detected")), "case_id", "left")
        n = F.coalesce("conflicts_detected", F.lit(0))
        return out.select(
            "case_id", F.when(n > 0, "awaiting_human_validation").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error_message"),
            F.coalesce(F.size("canonical_entities"), F.lit(0)).alias("entity_count"), "canonical_entities", "clusters", n.alias("conflicts_detected"),
            F.lit(json.dumps(self.cfg.echo())).alias("configuration"), F.lit(sum(timings.values()) if timings else None).cast("double").alias("total_processing_time_sec"), F.from_json(F.lit(json.dumps(timings) if timings else None), "map<string,double>").alias("stage_timings"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        )

    def failed_documents(self, message: str) -> DataFrame:
        """Documents of the same shape that say a resolution failed, one for each case of the raw rows."""
        none = lambda t: F.lit(None).cast(t)
        cases = self.raw.select(F.coalesce(F.when(F.col("case_id") != "", F.col("case_id")), F.lit(intake.NO_CASE)).alias("case_id")).distinct()
        nothing = Resolution(self.raw.sparkSession.createDataFrame([], RAW), self.cfg)
        shape = {f.name: f.dataType for f in nothing.documents().schema}
        nothing.close()
        own = {"case_id": F.col("case_id"), "status": F.lit("failed"), "error_message": F.lit(message), "entity_count": F.lit(0), "conflicts_detected": F.lit(0), "configuration": F.lit(json.dumps(self.cfg.echo())), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
        return cases.select(*(own.get(c, none(t)).cast(t).alias(c) for c, t in shape.items()))

    def timeline(self) -> DataFrame:
        """What a timeline stage reads."""
        return self.documents().select("case_id", "canonical_entities", "clusters", "conflicts_detected")

    def timings(self) -> dict[str, float]:
        """Seconds of each stage, run on its own in turn up to and with it (a plan has no stages of its own to time)."""
        out = {}
        for name, df in (("stage_1_intake", intake.dedup(intake.clean(self.raw))), ("stage_2_normalization", self.obs), ("stage_3_blocking", self.pairs), ("stage_6_classification", self.edges), ("stage_8_clustering", self.clusters), ("stage_9_attachment", self.members), ("stage_10_conflict_detection", self.conflicts), ("stage_11_labeling", self.entities()), ("stage_12_packaging", self.documents())):
            t = time.time()
            df.write.format("noop").mode("overwrite").save()
            out[name] = round(time.time() - t, 6)
        return out


def resolve_entities(cases: DataFrame, cfg: ErConfig | None = None, report_failure: bool = False, **constraints) -> DataFrame:
    """Result documents of case documents (case_id, observations). report_failure: resolve now, and if that fails give documents that say so."""
    r = Resolution(intake.flatten(cases), cfg, **constraints)
    if not report_failure:
        return r.documents()
    try:
        return staged(r.documents(), "documents")
    except Exception as e:  # noqa: BLE001  whatever a stage or a plugged-in scorer raises
        return r.failed_documents(str(e).splitlines()[0])
