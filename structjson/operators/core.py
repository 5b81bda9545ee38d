"""Key layer, navigation, lookups and fused queries over a token table.

Everything is by document: each join and aggregation has ``doc_id`` among its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import json_number_eq, multi_key_pattern, value_matches

ORDER = ["doc_id", "tok"]


def sorted_join(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is to be a merge join.

    Columns of tokens are stored so small that the planner would broadcast millions of
    rows by way of the driver.
    """
    return rows.hint("merge")


def _per_doc(docs: DataFrame, found: DataFrame, value: str, default) -> DataFrame:
    """A figure for every document, ``default`` for those without tokens."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(sorted_join(found), "doc_id", "left").select("doc_id", F.coalesce(value, F.lit(default)).alias(value))


# Figures of a document.

def token_count(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    return _per_doc(docs, tokens.groupBy("doc_id").agg(F.count("*").alias("n")), "n", 0)


def max_depth(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    return _per_doc(docs, tokens.groupBy("doc_id").agg(F.max("depth").alias("max_depth")), "max_depth", 0)


def all_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.select(*ORDER)


def spans(tokens: DataFrame, exact: bool = True) -> DataFrame:
    """``doc_id, tok, start, end``; inexact ends of strings and scalars are the next token's start."""
    return tokens.select(*ORDER, "start", (F.col("end") if exact else F.col("coarse_end")).alias("end"))


def navigation(tokens: DataFrame) -> DataFrame:
    """Each token's kind, depth, first byte, parent, close, tape number and bound value."""
    return tokens.select(*ORDER, "kind", "depth", F.col("start").alias("byte_offset"), "parent", "close_of", "tape", "val_tok")


def value_for_key(tokens: DataFrame) -> DataFrame:
    return tokens.where("role = 'Key'").select(*ORDER, "val_tok")


# Keys.

def key_test(name: str, depth: int | None = None) -> Column:
    test = (F.col("role") == "Key") & (F.col("key") == name)
    return test if depth is None else test & (F.col("depth") == depth)


def keys_named(tokens: DataFrame, name: str, depth: int | None = None) -> DataFrame:
    return tokens.where(key_test(name, depth)).select(*ORDER)


def has_key(docs: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    return _per_doc(docs, tokens.where(F.col("key") == name).groupBy("doc_id").agg(F.lit(True).alias("has_key")), "has_key", False)


contains_key = has_key


def has_keys(tokens: DataFrame) -> Column:
    """Whether the key layer was built: of a non-empty table, roles are there."""
    return F.max(F.col("role").isNotNull())


def keys_seen(tokens: DataFrame) -> DataFrame:
    """``doc_id, key, first_tok``: distinct keys; sorting by ``first_tok`` gives the order they are first seen in."""
    return tokens.where("role = 'Key'").groupBy("doc_id", "key").agg(F.min("tok").alias("first_tok"))


def count_key(docs: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    return _per_doc(docs, tokens.where(F.col("key") == name).groupBy("doc_id").agg(F.count("*").alias("n")), "n", 0)


def _ranges(tokens: DataFrame, roots: DataFrame, compat: bool) -> DataFrame:
    """``doc_id, root, last`` of anchors; a leaf is alone (compat: it reaches to the document's end)."""
    at = roots.select(*ORDER).distinct().join(sorted_join(tokens.select(*ORDER, "close_of")), ORDER)
    if not compat:
        return at.select("doc_id", F.col("tok").alias("root"), F.coalesce("close_of", "tok").alias("last"))
    ends = tokens.groupBy("doc_id").agg(F.max("tok").alias("final"))
    return at.join(sorted_join(ends), "doc_id").select("doc_id", F.col("tok").alias("root"), F.coalesce("close_of", "final").alias("last"))


def descendants(tokens: DataFrame, roots: DataFrame, compat: bool = False, among: DataFrame | None = None) -> DataFrame:
    """The tokens of the subtrees of ``roots``, roots and closes included, each once; of ``among`` if it is given.

    One pass over each document in token order: a token is inside if some root at or
    before it ends at or after it.
    """
    held = tokens.where("close_of is not null").select(*ORDER, "close_of")
    own = F.lit(2**31 - 1) if compat else F.col("tok")
    ends = roots.select(*ORDER).distinct().join(sorted_join(held), ORDER, "left").select(*ORDER, F.coalesce("close_of", own).alias("last"), F.lit(0).alias("asks"))
    rows = (tokens if among is None else among).select(*ORDER, F.lit(None).cast("int").alias("last"), F.lit(1).alias("asks"))
    upto = Window.partitionBy("doc_id").orderBy("tok").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.union(ends).withColumn("until", F.max("last").over(upto)).where("asks = 1 and until >= tok").select(*ORDER)


def keys_named_in(tokens: DataFrame, name: str, roots: DataFrame, compat: bool = False) -> DataFrame:
    """Key tokens of that name inside each root: ``doc_id, root, tok``."""
    # A root that is neither a container nor such a key holds none.
    may = tokens if compat else tokens.where(F.col("close_of").isNotNull() | key_test(name))
    r, t = _ranges(may, roots, compat).alias("r"), keys_named(tokens, name).alias("t")
    inside = (F.col("t.doc_id") == F.col("r.doc_id")) & F.col("t.tok").between(F.col("r.root"), F.col("r.last"))
    return t.join(sorted_join(r), inside).select("t.doc_id", "r.root", "t.tok")


def field_of(tokens: DataFrame, parents: DataFrame | None, name: str) -> DataFrame:
    """``doc_id, parent, tok``: value of the first direct key of that name; parents without one drop out.

    Without ``parents``, of every token.
    """
    k = tokens.where((F.col("role") == "Key") & (F.col("key") == name)).select("doc_id", "parent", F.col("tok").alias("k"), "val_tok")
    if parents is not None:
        k = k.join(sorted_join(parents.select("doc_id", F.col("tok").alias("parent")).distinct()), ["doc_id", "parent"], "left_semi")
    return k.where("parent is not null").groupBy("doc_id", "parent").agg(F.min_by("val_tok", "k").alias("tok")).where("tok is not null")


def children(tokens: DataFrame, parents: DataFrame) -> DataFrame:
    """Tokens whose innermost container is one of ``parents``."""
    p = parents.select("doc_id", F.col("tok").alias("parent")).distinct()
    return tokens.join(sorted_join(p), ["doc_id", "parent"], "left_semi").select(*ORDER)


# Fused queries.

def find_eq(tokens: DataFrame, key: str, literal: str) -> DataFrame:
    """``doc_id, key_tok, tok``: the object of every ``key`` whose value equals ``literal``.

    A bag: duplicate keys of an object give it twice. ``key_tok`` is the order of results.
    """
    hit = (F.col("role") == "Key") & (F.col("key") == key) & value_matches(F.col("val_text"), literal)
    return tokens.where(hit).select("doc_id", F.col("tok").alias("key_tok"), F.col("parent").alias("tok"))


def find_num_eq(tokens: DataFrame, key: str, literal: str) -> DataFrame:
    """Like :func:`find_eq`, comparing as numbers."""
    hit = (F.col("role") == "Key") & (F.col("key") == key) & json_number_eq(F.col("val_text"), literal)
    return tokens.where(hit).select("doc_id", F.col("tok").alias("key_tok"), F.col("parent").alias("tok"))


def find_eq_compound(tokens: DataFrame, conds: list[tuple[str, str]]) -> DataFrame:
    """``doc_id, key_tok, tok``: objects where for each condition some key of that name equals its literal.

    A row for each occurrence of the first condition's key in a qualifying object,
    whatever that occurrence's value. No conditions give no rows.
    """
    if not conds:
        return tokens.where("false").select("doc_id", F.col("tok").alias("key_tok"), F.col("parent").alias("tok"))
    keys = tokens.where((F.col("role") == "Key") & F.col("key").isin(*{k for k, _ in conds}))
    one = lambda k, lit: (F.col("key") == k) & value_matches(F.col("val_text"), lit)
    met = [F.bool_or(F.coalesce(one(k, lit), F.lit(False))).alias(f"c{i}") for i, (k, lit) in enumerate(conds)]
    firsts = F.collect_list(F.when(F.col("key") == conds[0][0], F.col("tok"))).alias("firsts")
    objects = keys.groupBy("doc_id", "parent").agg(*met, firsts)
    for i in range(len(conds)):
        objects = objects.where(F.col(f"c{i}"))
    return objects.select("doc_id", F.explode("firsts").alias("key_tok"), F.col("parent").alias("tok"))


# Byte positions and ancestry.

def _as_of(tokens: DataFrame, probes: DataFrame, found: Column) -> DataFrame:
    """``doc_id, pos, tok``: ``found`` of the last token that starts at or before each probe, null before the first.

    An as-of join in one sort: probes and tokens of a document share a window.
    """
    t = tokens.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("probe"), F.struct(found.cast("int").alias("tok")).alias("at"))
    p = probes.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("probe"), F.lit(None).cast("struct<tok:int>").alias("at"))
    w = Window.partitionBy("doc_id").orderBy("pos", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.union(p).withColumn("at", F.last("at", True).over(w)).where("probe = 1").select("doc_id", "pos", F.col("at.tok").alias("tok"))


def token_at(tokens: DataFrame, probes: DataFrame) -> DataFrame:
    """``doc_id, pos, tok``: the last token that starts at or before each probe, null before the first."""
    return _as_of(tokens, probes, F.col("tok"))


def container_at_byte(tokens: DataFrame, probes: DataFrame) -> DataFrame:
    """``doc_id, pos, tok``: the innermost container around each probe. On a closing bracket it is the outer one.

    That is the last token at or before the probe if it opens one, else its parent.
    """
    return _as_of(tokens, probes, F.when(F.col("close_of").isNotNull(), F.col("tok")).otherwise(F.col("parent"))).distinct()


def value_token_at(tokens: DataFrame, probes: DataFrame) -> DataFrame:
    """``doc_id, pos, tok`` where the token at a probe is a string or scalar, else null."""
    return _as_of(tokens, probes, F.when(F.col("raw_kind").isin("Quote", "Scalar"), F.col("tok")))


def ancestors(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """``doc_id, tok, ancestor, depth, tape``: containers around each anchor; falling depth is innermost first."""
    a = anchors.select(*ORDER).distinct().alias("a")
    c = tokens.where("close_of is not null").select("doc_id", "tok", "close_of", "depth", "tape").alias("c")
    around = (F.col("a.doc_id") == F.col("c.doc_id")) & (F.col("c.tok") < F.col("a.tok")) & (F.col("a.tok") < F.col("c.close_of"))
    return a.join(sorted_join(c), around).select("a.doc_id", "a.tok", F.col("c.tok").alias("ancestor"), "c.depth", "c.tape")


def parents_as_tape(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    return ancestors(tokens, anchors).select(*ORDER, F.col("tape").alias("parent_tape"), "depth")


# Without an index.

def multi_key_scan(docs: DataFrame, keys: list[str], id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """``doc_id, hit, pattern, byte_offset`` of each ``"key":`` in the raw text, in order, none overlapping."""
    keys = list(dict.fromkeys(keys))
    parts = F.regexp_extract_all(F.col(json_col), F.lit(f"(?s).*?({multi_key_pattern(keys)})"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(parts).alias("hit", "piece"))
    found = F.regexp_extract("piece", f"({multi_key_pattern(keys)})\\z", 1)
    upto = F.sum(F.octet_length("piece")).over(Window.partitionBy("doc_id").orderBy("hit").rowsBetween(Window.unboundedPreceding, 0))
    names = F.array(*[F.lit(f'"{k}":') for k in keys])
    return rows.select("doc_id", "hit", (F.array_position(names, found) - 1).cast("int").alias("pattern"), (upto - F.octet_length(found)).alias("byte_offset"))
