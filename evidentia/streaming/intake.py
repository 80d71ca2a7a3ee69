"""Streaming intake: observations as they arrive, cleaned, distinct, and resolved case by case in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.config import ErConfig
from evidentia.functions.text import epoch
from evidentia.operators.entities import Resolution
from evidentia.operators.intake import clean, fingerprint


def distinct_stream(raw: DataFrame, late: str = "1 hour") -> DataFrame:
    """Clean rows of a stream of raw observations, the first of each fingerprint within the watermark; rows without a valid time are kept apart by batch intake."""
    rows = clean(raw).withColumn("event_time", F.timestamp_seconds(epoch(F.col("timestamp"))))
    return rows.where("event_time > timestamp_seconds(0)").withColumn("fp", fingerprint()).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["case_id", "fp"]).drop("fp")


def counts_by_window(rows: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Observations of each case and modality in windows of event time."""
    return rows.groupBy(F.window("event_time", width), "case_id", "modality").agg(F.count("*").alias("n"))


def resolve_stream(raw: DataFrame, sink: Callable[[DataFrame, int], None], cfg: ErConfig | None = None, **options):
    """A streaming query that resolves the cases of each micro-batch and hands their entities to the sink, which must read them before it returns. A case is resolved within its batch."""

    def each(batch: DataFrame, number: int) -> None:
        r = Resolution(batch, cfg)
        try:
            sink(r.entities(), number)
        finally:
            r.close()

    return raw.writeStream.foreachBatch(each).options(**options).start()
