"""From raw documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structjson.llm import jaccard, mixing, packing, quality
from structjson.llm.common import written
from structjson.llm.queries import table, tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares four fifths of its five-word shingles."""
    return jaccard.keep_one(docs, size=5, similarity=0.8)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again, none more than twice."""
    return mixing.mix(docs, max_repeats=2.0).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("source_mixing", mixed_documents),
    ("best_fit_packing", packed_sequences),
]

#: The classifier, the tokenizer and the bins are beyond SQL; the tests run the stages on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
