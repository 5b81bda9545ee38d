"""Row types of the token table, build options and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

OBJECT, ARRAY, KEY, STRING, SCALAR, OBJECT_END, ARRAY_END = "Object", "Array", "Key", "String", "Scalar", "ObjectEnd", "ArrayEnd"

#: One row for each token of a document. Positions are bytes, ends exclusive.
TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("tok", T.IntegerType()),
    T.StructField("raw_kind", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("coarse_end", T.LongType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("close_of", T.IntegerType()),
    T.StructField("tape", T.IntegerType()),
    T.StructField("key", T.StringType()),
    T.StructField("val_tok", T.IntegerType()),
    T.StructField("val_text", T.StringType()),
    T.StructField("text", T.StringType()),
])


@dataclass(frozen=True)
class BuildOptions:
    """What an index holds. Without ``keys``, roles, key names and values stay null.

    The other three are accepted for completeness; their columns are always there.
    ``container_text`` keeps the raw text of objects and arrays beside their tokens,
    which equality with a whole object or array needs.
    """

    keys: bool = True
    roles: bool = True
    close_of: bool = True
    tape: bool = False
    container_text: bool = True

    @classmethod
    def minimal(cls) -> BuildOptions:
        return cls(keys=False, roles=False, close_of=False, tape=False)

    @classmethod
    def keys_only(cls) -> BuildOptions:
        return cls(keys=True, roles=True, close_of=False, tape=False)

    @classmethod
    def with_tape(cls) -> BuildOptions:
        return cls(keys=True, roles=True, close_of=True, tape=True)


class ParseError(ValueError):
    """A document that has no token table: underflow, unterminated string or unclosed container."""
