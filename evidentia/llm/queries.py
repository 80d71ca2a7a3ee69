"""The queries of the training-data operators, and the SQL of those that SQL can express.

Each applies its operator, with production parameters, to its whole table and derives the columns of its contract.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, chroma, langid, linedup, neighbours, packing, quality, secrets, simhash, toxicity
from evidentia.llm.common import table

JSON_VOCABULARY = "byte_bpe_50k.json"
RANK_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page (markup, address, host) and every document (text; its source takes the host's place)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), none.alias("html"), "text", none.alias("url"), F.col("source").alias("site"))
    rows = rows.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "html", none.alias("text"), "url", none.alias("site")))
    return langid.identify(rows, langid.fit(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line: exact copies of any length, near copies from linedup.LEAST_CHARS on."""
    return linedup.line_classes(table(spark, sf_dir, "documents"), exact=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.fit(docs), digests=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings, so each turn of `conversations` is rendered as one; the operator reads only that media column."""
    return chroma.recording_classes(chroma.render(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]), ["conv_id", "turn"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_VOCABULARY))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_VOCABULARY), public_tokenizers.PATTERN, digests=True)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_line_dedup, op4_quality, op5_secrets, op6_simhash, op7_chroma, op8_packing, op9_neighbours, op10_byte_bpe)}
ORACLE_SQL: dict[str, str] = {}
