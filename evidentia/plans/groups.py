"""Grouped maps over sorted partitions: a function per group, without pandas and without a group larger than its bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, by: list[str], values: list[str], fn: Callable[[tuple, list[tuple]], Iterator[tuple]], schema: str, order: list[str] | None = None) -> DataFrame:
    """fn(key, rows of values) for each group of `by`, dealt by hash and sorted by `order`; a group is in memory whole, so it must be bounded."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = df.sparkSession.createDataFrame([], schema).schema
    types, k = to_arrow_schema(out), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        made: list[tuple] = []
        for key, group in groupby(rows, key=itemgetter(slice(0, k))):
            made += fn(key, [r[k:] for r in group])
            if len(made) > 20_000:
                yield _batch(made, types)
                made = []
        yield _batch(made, types)

    dealt = df.select(*by, *values).repartition(*by).sortWithinPartitions(*by, *(order or values[:1]))
    return dealt.mapInArrow(run, out)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, types, strict=True)], schema=types)
