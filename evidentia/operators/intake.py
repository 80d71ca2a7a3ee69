"""Intake and normalisation: raw observations to clean, distinct, time-aligned ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import alias_norm, epoch

NO_CASE = "UNKNOWN_CASE"


def flatten(cases: DataFrame) -> DataFrame:
    """Case documents (case_id, observations array) to raw rows with their place `ord` in the document."""
    o = "obs_id entity role modality location content timestamp confidence".split()
    case = F.coalesce(F.when(F.col("case_id") != "", F.col("case_id")), F.lit(NO_CASE))
    rows = cases.select(case.alias("case_id"), F.posexplode("observations").alias("ord", "o"))
    return rows.select("case_id", F.col("ord").cast("long").alias("ord"), *(F.col(f"o.{c}").cast("string").alias(c) for c in o))


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _reason() -> Column:
    return (
        F.when(F.col("obs_id").isNull(), "no obs_id")
        .when(F.col("entity").isNull(), "no entity")
        .when(F.col("confidence").isNotNull() & _number(F.col("confidence")).isNull(), "confidence is no number")
    )


def quarantine(raw: DataFrame) -> DataFrame:
    """Rows that intake leaves out, with the reason."""
    return raw.withColumn("reason", _reason()).where("reason is not null").select("case_id", "ord", "obs_id", "entity", "confidence", "reason")


def clean(raw: DataFrame) -> DataFrame:
    """Well-formed rows with defaults and the confidence between 0 and 1 (a missing one is 0.5)."""
    conf = F.coalesce(_number(F.col("confidence")), F.lit(0.5))
    return raw.where(_reason().isNull()).select(
        F.coalesce(F.when(F.col("case_id") != "", F.col("case_id")), F.lit(NO_CASE)).alias("case_id"),
        "ord",
        "obs_id",
        "entity",
        *(F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (("role", "unknown"), ("modality", "unknown"), ("location", ""), ("content", ""), ("timestamp", ""))),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"),
    )


def fingerprint() -> Column:
    return F.sha2(F.concat_ws("|", "entity", "modality", "location", "content", "timestamp"), 256)


def dedup(obs: DataFrame, by_fingerprint: bool = True) -> DataFrame:
    """One row per fingerprint, the most confident (the first of equals), at the place of the first of them.

    Without by_fingerprint: one row per obs_id, the last, at the place of the first. A case's (obs_id) is a key afterwards: of
    rows of different fingerprints that share an obs_id the last stays, as the later one hides the earlier in every look-up.
    """
    key = fingerprint() if by_fingerprint else F.col("obs_id")
    best = [F.col("confidence").desc(), F.col("ord")] if by_fingerprint else [F.col("ord").desc()]
    w = Window.partitionBy("case_id", "_key")
    out = obs.withColumn("_key", key).withColumn("_rank", F.row_number().over(w.orderBy(*best))).withColumn("_first", F.min("ord").over(w))
    out = out.where("_rank = 1").withColumn("ord", F.col("_first")).drop("_key", "_rank", "_first")
    if by_fingerprint:
        last = Window.partitionBy("case_id", "obs_id").orderBy(F.col("ord").desc())
        out = out.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
    return out


def normalize(obs: DataFrame) -> DataFrame:
    """Adds entity_norm, ts_epoch and time_offset_sec: seconds since the case's earliest valid time, 0 where the time is invalid.

    The earliest time is a grouped minimum joined back, so a large case is aggregated where it lies.
    """
    timed = obs.withColumn("entity_norm", alias_norm(F.col("entity"))).withColumn("ts_epoch", epoch(F.col("timestamp")))
    base = timed.where("ts_epoch > 0").groupBy("case_id").agg(F.min("ts_epoch").alias("_base"))
    return timed.join(base, "case_id", "left").withColumn("time_offset_sec", F.when(F.col("ts_epoch") > 0, (F.col("ts_epoch") - F.col("_base")).cast("long")).otherwise(F.lit(0).cast("long"))).drop("_base")


def observations(raw: DataFrame, check_duplicates: bool = True) -> DataFrame:
    return normalize(dedup(clean(raw), check_duplicates))
