"""Case files: reading documents, and writing whole cases, observations alone, and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.intake import flatten
from evidentia.schema import CASE
from evidentia.synth.generate import observations_only


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw observations of JSON case documents (one document a file, or one a line). Values are read as text and coerced by intake."""
    return flatten(spark.read.schema(CASE).option("multiLine", multi_line).option("primitivesAsString", True).json(path))


def write_cases(docs: DataFrame, path: str) -> None:
    """Whole case documents, one a line, by domain."""
    docs.write.mode("overwrite").partitionBy("domain").json(path)


def write_observations_only(docs: DataFrame, path: str) -> None:
    """Case documents without truth and noise tags: what the resolver reads."""
    observations_only(docs).write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def print_cases(docs: DataFrame, most: int = 20) -> None:
    """The first `most` documents on the console, as indented JSON."""
    for r in docs.select(F.to_json(F.struct(*docs.columns), {"pretty": "true"})).take(most):
        print(r[0])
