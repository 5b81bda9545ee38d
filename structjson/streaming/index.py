"""Token tables of streams: documents are independent, so the scanner needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import find_eq
from ..schema import BuildOptions
from ..sources.index import index_json


def read_json_stream(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, json`` of new text files, a document a line; the id is a hash of the line."""
    lines = spark.readStream.format("text").load(path)
    return lines.select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("json"))


def index_stream(docs: DataFrame, options: BuildOptions | None = None, **names: str) -> DataFrame:
    return index_json(docs, options=options, **names)


def find_eq_stream(docs: DataFrame, key: str, literal: str, **names: str) -> DataFrame:
    """Objects whose ``key`` equals ``literal``; only documents that can hold the key are scanned."""
    return find_eq(index_json(docs, only_keys=[key], **names), key, literal)
