"""Composable sets of key tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import ORDER, key_test, keys_named, sorted_join


@dataclass(frozen=True)
class KeyHits:
    """A lazy set of tokens ``(doc_id, tok)`` over a token table.

    ``test`` is the condition that the rows are of the table's tokens, if there is one
    (``once``: each pair once). Sets of one table that have it combine into one filter,
    others by merge joins.
    """

    tokens: DataFrame
    rows: DataFrame
    test: Column | None = field(default=None, compare=False)
    once: bool = False

    @classmethod
    def named(cls, tokens: DataFrame, name: str, depth: int | None = None) -> KeyHits:
        return cls(tokens, keys_named(tokens, name, depth), key_test(name, depth))

    @classmethod
    def all(cls, tokens: DataFrame) -> KeyHits:
        return cls._of(tokens, F.lit(True))

    @classmethod
    def _of(cls, tokens: DataFrame, test: Column, once: bool = False) -> KeyHits:
        rows = tokens.where(test).select(*ORDER)
        return cls(tokens, rows.distinct() if once else rows, test, once)

    def _filters(self, other: KeyHits) -> bool:
        return self.tokens is other.tokens and self.test is not None and other.test is not None

    def at_depth(self, depth: int) -> KeyHits:
        return self.and_(KeyHits._of(self.tokens, F.col("depth") == depth))

    def and_(self, other: KeyHits) -> KeyHits:
        if self._filters(other):
            return KeyHits._of(self.tokens, self.test & other.test, self.once)
        return KeyHits(self.tokens, self.rows.join(sorted_join(other.rows), ORDER, "left_semi"))

    def or_(self, other: KeyHits) -> KeyHits:
        if self._filters(other):
            return KeyHits._of(self.tokens, self.test | other.test, True)
        return KeyHits(self.tokens, self.rows.union(other.rows).distinct())

    def count(self) -> DataFrame:
        return self.rows.groupBy("doc_id").agg(F.count("*").alias("n"))

    def first(self) -> DataFrame:
        return self.rows.groupBy("doc_id").agg(F.min("tok").alias("tok"))

    def last(self) -> DataFrame:
        return self.rows.groupBy("doc_id").agg(F.max("tok").alias("tok"))

    def collected(self) -> DataFrame:
        """``doc_id, toks``: each document's hits in order."""
        return self.rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("tok")).alias("toks"))

    def ordered(self) -> DataFrame:
        return self.rows.orderBy(*ORDER)
