"""Shared pieces of the training-data operators: table access and Arrow batch handling."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds as Python objects at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(key, make):
    """make()'s value, made once in each Python worker."""
    store = sys.__dict__.setdefault("_evidentia_held", {})
    if key not in store:
        store[key] = make()
    return store[key]


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, texts): runs of rows of about `most` bytes; null texts come as empty ones."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_string_view(col.type):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end, [t or "" for t in col.slice(start, end - start).to_pylist()]
        start = end


def plain(rows: DataFrame, own: set[str]) -> tuple[DataFrame, list[str]]:
    """(rows with every column but those in `own` renamed c0_, c1_ ..., the names before): an extra column may have any name, dots and those of the operator's own columns included. toDF(*names) names them back."""
    names = rows.columns
    return rows.toDF(*(c if c in own else f"c{i}_" for i, c in enumerate(names))), names


#: Rows of a side table that may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 100_000
SALTS = 32


def attach(df: DataFrame, stats: DataFrame, keys: list[str], most: int = BROADCAST_ROWS, spread: list[str] | None = None) -> DataFrame:
    """Left join of per-key statistics (one row per key, no null keys) to rows whose keys may be very uneven.

    The statistics are counted first. Up to `most` rows they are broadcast; beyond it both sides are salted: a row takes one of
    SALTS copies of its key's statistics, by the hash of the columns `spread` (all, if not given), so that a hot key is dealt to SALTS tasks.
    """
    if stats.limit(most + 1).count() <= most:
        return df.join(F.broadcast(stats), keys, "left")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*map(F.col, spread or df.columns)), F.lit(SALTS)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def sample_ids(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of distinct, non-null keys, those with the least hash, as a local table: bounded, and the same however rows are partitioned."""
    got = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(most)
    return rows.sparkSession.createDataFrame(got.collect(), rows.schema)


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


#: A key with more than one in HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def join_labels(rows: DataFrame, labels: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """Inner join of rows to labels (one row per key; `n`: the rows that have the key), without a hot key meeting in one task.

    Labels of hot keys, at most HOT_SHARE by the definition of hot, are broadcast; the others are joined by a shuffle.
    """
    total = labels.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_SHARE > F.lit(total)
    few = F.broadcast(labels.where(hot).drop(n))
    cold = rows.join(few.select(key), key, "left_anti").join(labels.where(~hot).drop(n), key)
    return rows.join(few, key).unionByName(cold)
