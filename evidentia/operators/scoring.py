"""Similarity features of candidate pairs, their weighted sum, and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import config as C
from evidentia.config import ErConfig
from evidentia.functions.similarity import token_set, token_sort
from evidentia.functions.text import folded, words
from evidentia.operators.blocking import cross_modal, gap, same_role


def _lits(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def mention_consistency(cfg: ErConfig) -> Column:
    same_loc = (F.col("location_a") != "") & (F.col("location_b") != "") & (folded(F.col("location_a")) == folded(F.col("location_b")))
    near, within = gap() <= cfg.temporal_window_sec, gap() <= cfg.max_temporal_gap_sec
    alike = F.when(near & same_loc, 0.85).when(within, 0.45).otherwise(0.20)
    same_alias = F.col("entity_norm_a") == F.col("entity_norm_b")
    return F.when(F.col("modality_a") == F.col("modality_b"), F.when(same_alias, alike).otherwise(0.30)).otherwise(F.when(near, 0.78).when(within, 0.42).otherwise(0.10))


def temporal(cfg: ErConfig) -> Column:
    w, g = float(cfg.temporal_window_sec), float(cfg.max_temporal_gap_sec)
    return F.when(gap() > g, 0.0).when(gap() <= w, 1.0 - gap() / w).otherwise(0.3 * (1.0 - (gap() - w) / (g - w)))


def location(set_ratio: Column) -> Column:
    a, b = folded(F.col("location_a")), folded(F.col("location_b"))
    return F.when((a == "") | (b == ""), 0.35).when(a == b, 1.0).otherwise(set_ratio)


def interaction() -> Column:
    lo, hi = F.least(F.lower("modality_a"), F.lower("modality_b")), F.greatest(F.lower("modality_a"), F.lower("modality_b"))
    base = reduce(lambda w, kv: w.when((lo == kv[0][0]) & (hi == kv[0][1]), kv[1]), C.MODALITY_PAIRS.items(), F).otherwise(0.30)
    ra, rb = F.lower("role_a"), F.lower("role_b")
    opposed = reduce(lambda x, y: x | y, [((ra == p) & (rb == q)) | ((ra == q) & (rb == p)) for p, q in C.OPPOSED_ROLES])
    return F.when(opposed, base * 0.55).otherwise(base)


def modality() -> Column:
    return F.when(cross_modal(), 0.82).otherwise(0.40)


def opposite_actions(a: Column, b: Column) -> Column:
    """0.5 if the one text has an action and the other its opposite, else 1. Only listed actions count."""
    ta, tb = (F.array_intersect(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w+\b"), F.lit(0)), _lits(C.ACTIONS)) for x in (a, b))
    has = F.array_contains
    hit = reduce(lambda x, y: x | y, [(has(ta, p) & has(tb, q)) | (has(ta, q) & has(tb, p)) for p, q in C.OPPOSITES])
    return F.when(hit, 0.5).otherwise(1.0)


def _any(tokens: Column, of: list[str]) -> Column:
    return F.arrays_overlap(tokens, _lits(of))


def coreference(cfg: ErConfig, location_ratio: Column, content_ratio: Column) -> Column:
    """Heuristic score that two mentions are one entity; ratios are columns, so that each is computed once."""
    la, lb = folded(F.col("location_a")), folded(F.col("location_b"))
    placed = (la != "") & (lb != "")
    ca, cb = words(F.col("content_a")), words(F.col("content_b"))
    near = gap() <= cfg.temporal_window_sec
    topical = F.size(F.array_intersect(F.array_intersect(ca, cb), _lits(C.TOPICAL)))

    def phase(t: Column) -> Column:
        return F.when(_any(t, C.EXITING), "exit").when(_any(t, C.ENTERING), "inside").when(_any(t, C.APPROACHING), "approach").otherwise("other")

    score = F.when(cross_modal(), 0.45).otherwise(0.32)
    for when, add in (
        (F.lit(True), F.when(near, 0.25).otherwise(0.10)),
        (placed & (location_ratio >= 0.45), F.lit(0.10)),
        (placed & (F.size(F.array_intersect(F.array_intersect(words(la), words(lb)), _lits(C.PLACES))) > 0), F.lit(0.08)),
        (content_ratio >= 0.35, F.lit(0.08)),
        (topical > 0, F.least(F.lit(0.14), 0.05 * topical)),
        ((_any(ca, C.ENTERING) & _any(cb, C.ENTERING)) | (_any(ca, C.EXITING) & _any(cb, C.EXITING)), F.lit(0.10)),
        (near & (phase(ca) == phase(cb)) & (phase(ca) != "other"), F.lit(0.08)),
    ):
        score = score + F.when(when, add).otherwise(0.0)
    return F.when(F.col("entity_norm_a") == F.col("entity_norm_b"), 1.0).when(~same_role(), 0.12).when(gap() > cfg.max_temporal_gap_sec, 0.05).otherwise(F.least(F.lit(1.0), score))


def with_ratios(pairs: DataFrame) -> DataFrame:
    """Adds the fuzzy ratios: places, whole contents, contents' first 120 characters (in string order), aliases. One pass through Arrow."""
    cut = [F.substring(F.col(f"content_{s}"), 1, 120) for s in "ab"]
    return pairs.select(
        "*",
        token_set(folded(F.col("location_a")), folded(F.col("location_b"))).alias("location_ratio"),
        token_set(F.col("content_a"), F.col("content_b")).alias("content_ratio"),
        token_set(F.least(*cut), F.greatest(*cut)).alias("context_ratio"),
        token_sort(F.col("entity_norm_a"), F.col("entity_norm_b")).alias("lexical"),
    )


def features(pairs: DataFrame, cfg: ErConfig, scorers: dict | None = None) -> DataFrame:
    """Adds the eight features. scorers: column functions of the pair that replace `context` or `entity_coreference`.

    Contents' penalty for opposite actions counts twice with the built-in context score (double_penalty), once with a scorer's.
    """
    scorers = scorers or {}
    cut = [F.substring(F.col(f"content_{s}"), 1, 120) for s in "ab"]
    penalty = opposite_actions(*cut)
    own = F.col("context_ratio") * penalty * (penalty if cfg.double_penalty else F.lit(1.0))
    context = scorers["context"](pairs) * penalty if "context" in scorers else own
    coref = scorers["entity_coreference"](pairs) if "entity_coreference" in scorers else coreference(cfg, F.col("location_ratio"), F.col("content_ratio"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return with_ratios(pairs).select(
        "*",
        unit(coref).alias("entity_coreference"),
        mention_consistency(cfg).alias("mention_consistency"),
        temporal(cfg).alias("temporal"),
        location(F.col("location_ratio")).alias("location"),
        unit(context).alias("context"),
        interaction().alias("interaction"),
        modality().alias("modality"),
    )


def score(pairs: DataFrame, cfg: ErConfig, soft_hints: DataFrame | None = None) -> DataFrame:
    """Adds weight (the composite, at most 1) and reasons (features over one half, in order)."""
    total = F.lit(0.0)
    for f in C.FEATURES:
        total = total + C.WEIGHTS[f] * F.col(f)
    lo, hi = F.least("entity_norm_a", "entity_norm_b"), F.greatest("entity_norm_a", "entity_norm_b")
    if soft_hints is not None:
        pairs = pairs.withColumn("alias_lo", lo).withColumn("alias_hi", hi).join(soft_hints, ["case_id", "alias_lo", "alias_hi"], "left").drop("alias_lo", "alias_hi")
        total = total + F.coalesce(F.col("hint"), F.lit(0.0))
    out = pairs.withColumn("weight", F.least(F.lit(1.0), total)).withColumn("reasons", F.array_compact(F.array(*(F.when(F.col(f) > 0.5, F.lit(f)) for f in C.FEATURES))))
    return out.drop("hint") if soft_hints is not None else out


def classify(scored: DataFrame, cfg: ErConfig) -> DataFrame:
    w = F.col("weight")
    cls = F.when(w >= cfg.confirmed_threshold, "confirmed").when(w >= cfg.candidate_threshold_high, "likely").when(w >= cfg.candidate_threshold_low, "possible").otherwise("rejected")
    return scored.withColumn("classification", cls).withColumn("hard_negative", F.lit(False))


def edges(pairs: DataFrame, cfg: ErConfig, soft_hints: DataFrame | None = None, scorers: dict | None = None) -> DataFrame:
    """Scored and classified pairs: obs_id_1/2 with their aliases, features, weight, reasons, classification and `merges`."""
    out = classify(score(features(pairs, cfg, scorers), cfg, soft_hints), cfg)
    swap = F.col("obs_id_1") != F.col("obs_id_a")
    out = out.withColumn("alias_1", F.when(swap, F.col("entity_norm_b")).otherwise(F.col("entity_norm_a"))).withColumn("alias_2", F.when(swap, F.col("entity_norm_a")).otherwise(F.col("entity_norm_b")))
    return out.withColumn("merges", merges(cfg))


def merges(cfg: ErConfig) -> Column:
    """Whether an edge puts its ends in one cluster: confirmed, or not rejected and guarded by alias, role, gap and scores."""
    held = (F.col("classification") != "rejected") & (gap() <= cfg.max_temporal_gap_sec) & (F.col("weight") >= cfg.merge_composite_min)
    alike = (F.col("entity_norm_a") == F.col("entity_norm_b")) | (same_role() & (F.col("entity_coreference") >= cfg.cross_modal_merge_min))
    return (F.col("classification") == "confirmed") | (held & alike)
