"""Scalar functions over raw JSON text, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPELLINGS = {'"': r'\\"', "\\": r"\\\\", "/": r"(?:/|\\/)", "\n": r"(?:\n|\\n)", "\t": r"(?:\t|\\t)", "\r": r"(?:\r|\\r)", "\b": r"(?:\x08|\\b)", "\f": r"(?:\f|\\f)"}
_NUMBER = r"\A[+-]?((?i:inf|infinity|nan)|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\z"


def _quoted(literal: str) -> str:
    """A regular expression for the string values that equal a literal."""
    return r'(?s)\A"' + "".join(_SPELLINGS.get(c) or re.sub(r"([^\w\s])", r"\\\1", c) for c in literal) + r'"\z'


def json_string_eq(value: Column, literal: str) -> Column:
    """Whether a raw value's text equals ``literal``.

    Of a quoted value its unescaped body counts, else the raw text, so the literal
    ``1`` equals both ``1`` and ``"1"``. A body with a ``\\u`` escape equals nothing.
    """
    quoted = value.startswith('"') & value.endswith('"') & (F.length(value) >= 2)
    if not any(c in _SPELLINGS for c in literal):
        return F.when(quoted, value == F.lit(f'"{literal}"')).otherwise(value == F.lit(literal))
    return F.when(quoted, value.rlike(_quoted(literal))).otherwise(value == F.lit(literal))


value_matches = json_string_eq


def parse_f64(text: Column) -> Column:
    """The text as a double, null if it is no number; infinities and NaN are numbers."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_i64(text: Column) -> Column:
    """The text as a long; fractions are cut off, what lies beyond is the nearest long, NaN is 0."""
    f = parse_f64(text)
    whole = F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("bigint"))
    limit = 9223372036854775807
    cut = F.when(F.isnan(f), F.lit(0)).when(f >= 9.223372036854775807e18, F.lit(limit)).when(f <= -9.223372036854775808e18, F.lit(-limit - 1)).otherwise(
        F.when(F.abs(f) < 9.223372036854775807e18, f).cast("bigint")
    )
    return F.coalesce(whole, F.when(f.isNotNull(), cut))


def json_number_eq(value: Column, literal: str) -> Column:
    """Whether both are numbers and equal; NaN equals nothing."""
    a, b = parse_f64(value), parse_f64(F.lit(literal))
    return F.coalesce((a == b) & ~F.isnan(a), F.lit(False))


def valid_utf8(data: Column) -> Column:
    """Whether binary data is UTF-8."""
    return F.is_valid_utf8(data.cast("string"))


def span_length(start: Column, end: Column) -> Column:
    """Length of a byte span, 0 if its end is first."""
    return F.greatest(end - start, F.lit(0))


def slice_bytes(json: Column, start: Column, end: Column) -> Column:
    """The raw text of a byte span."""
    return F.substring(json.cast("binary"), (start + 1).cast("int"), span_length(start, end).cast("int")).cast("string")


def multi_key_pattern(keys: list[str]) -> str:
    """One expression that finds any of ``"key":``, case-sensitively, without an index."""
    quoted = [re.sub(r"([^\w\s])", r"\\\1", f'"{k}":') for k in dict.fromkeys(keys)]
    return "|".join(quoted) or "(?!)"  # no keys match nowhere
