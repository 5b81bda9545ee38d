"""Driver queries over the supplied tables, each with equivalent SQL.

Documents ``E`` are the events' ``props``; documents ``O`` nest an order's lines:
``{"o_orderkey":1,"status":"O","lines":[{"n":1,"flag":"N"},...]}``. Documents ``V``,
made from the events' numbers, hold escapes, fractions, repeated keys and errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import core
from .operators.hits import KeyHits
from .plans import algebra
from .plans.algebra import OpPlan, Or, And, Sub, LoadKey, LoadDepth, run_count, run_first
from .schema import BuildOptions
from .sources.index import index_errors, index_json, stored_index


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(  # noqa: E741
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")))).alias("lines")
    )
    return o.join(core.sorted_join(l), o.o_orderkey == l.l_orderkey).select(
        F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct("o_orderkey", "status", "lines")).alias("json")
    )


#: By number modulo 6, with the number in the place of @.
ODD = (
    '{"a\\nb":@,"k":"x\\"y","\\u0041":"t\\\\"}', '{"v":@.5,"v":-1e3,"w":" @","v":"0.25"}', '{"x":[1,@', '}{"x":@}', '{"x":"ab@', '[{"k":"x"},{"k":@,"k":"@"},[]]',
)
#: What keeps a document of each kind from being scanned.
ODD_ERRORS = (None, None, "unclosed container", "underflow", "unterminated string", None)


def odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"))
    kind = F.element_at(F.array(*map(F.lit, ODD)), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    return e.select("doc_id", F.replace(kind, F.lit("@"), F.col("doc_id").cast("string")).alias("json"))


def _case(values: tuple, of: str = "event_id") -> str:
    shown = ["NULL::VARCHAR" if v is None else "'" + v + "'" for v in values]
    return f"CASE {of} % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(shown)) + " END"


_V_DOCS = f"docs AS (SELECT event_id AS doc_id, replace({_case(ODD)}, '@', event_id::VARCHAR) AS j FROM events WHERE event_id % 6 IN (0, 1, 5))"
_E_DOCS = "docs AS (SELECT event_id AS doc_id, props AS j FROM events)"
_O_DOCS = """docs AS (SELECT o_orderkey AS doc_id, to_json({'o_orderkey': o_orderkey, 'status': any_value(o_orderstatus),
  'lines': list({'n': l_linenumber, 'flag': l_returnflag} ORDER BY l_linenumber, l_returnflag)})::VARCHAR AS j
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
_TOKENS = r"""pieces AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT doc_id,
  regexp_extract_all(j, '"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[ \t\n\r]+|[^{}\[\]:," \t\n\r]+') AS p FROM docs)),
placed AS MATERIALIZED (SELECT *, (sum(strlen(t)) OVER w - strlen(t))::BIGINT AS start FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
solid AS MATERIALIZED (SELECT doc_id, t, start, start + strlen(t) AS "end", (row_number() OVER w - 1)::INT AS tok,
  (sum(CASE WHEN t IN ('{','[') THEN 1 WHEN t IN ('}',']') THEN -1 ELSE 0 END) OVER w - CASE WHEN t IN ('{','[') THEN 1 ELSE 0 END)::INT AS depth,
  lead(t) OVER w AS nt, lead(t, 2) OVER w AS vt, lead(start) OVER w AS ns,
  (sum(CASE WHEN t IN (':',',') THEN 0 ELSE 1 END) OVER w - 1)::INT AS vals
  FROM placed WHERE trim(t, E' \t\n\r') <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
opens AS MATERIALIZED (SELECT doc_id, tok, depth, t FROM solid WHERE t IN ('{','[')),
closes AS MATERIALIZED (SELECT doc_id, tok, depth, start FROM solid WHERE t IN ('}',']')),
toks AS MATERIALIZED (SELECT s.*, o.tok AS parent, o.t AS owner, CASE WHEN s.t IN ('{','[') THEN c.tok END AS close_of,
  CASE WHEN s.t IN ('{','[') THEN c.start END AS close_start,
  CASE WHEN o.t = '{' AND s.t LIKE '"%' AND s.nt = ':' THEN s.t[2:-2] END AS key
  FROM solid s ASOF LEFT JOIN opens o ON s.doc_id = o.doc_id AND s.depth - 1 = o.depth AND s.tok > o.tok
  ASOF LEFT JOIN closes c ON s.doc_id = c.doc_id AND s.depth = c.depth AND s.tok < c.tok)"""


def _sql(docs: str, body: str) -> str:
    return f"WITH {({'E': _E_DOCS, 'O': _O_DOCS, 'V': _V_DOCS})[docs]},\n{_TOKENS}\n{body}"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(
    name: str, docs: str, body: str | None, raw_sql: str | None = None, only: list[str] | None = None, cols: str | None = None,
    stored: bool = False, options: BuildOptions | None = None,
):
    """Registers a query of ``(docs, tokens)``.

    ``cols`` are the columns that it needs beside the token number; ``stored`` says
    that it reads the tokens several times.
    """

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = {"E": events, "O": orders, "V": odd}[docs](spark, sf_dir)
            t = index_json(d, only_keys=only, columns=None if cols is None else cols.split(), options=options or BuildOptions(container_text=False))
            return f(d, stored_index(t) if stored else t)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if raw_sql or body:
            ORACLE_SQL[name] = raw_sql or _sql(docs, body)
        return f

    return register


_FOUND = "role key val_text parent"


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``$..find(k == "69")``: only documents that can hold the key are scanned."""
    return core.find_eq(index_json(events(spark, sf_dir), only_keys=["k"], columns=_FOUND.split()), "k", "69")


QUERIES["find_eq_events"] = _flagship
ORACLE_SQL["find_eq_events"] = _sql("E", "SELECT doc_id, tok AS key_tok, parent AS tok FROM toks WHERE key = 'k' AND trim(vt, '\"') = '69'")

_query("find_eq_nested", "O", "SELECT doc_id, tok AS key_tok, parent AS tok FROM toks WHERE key = 'flag' AND vt = '\"R\"'", only=["flag"], cols=_FOUND)(
    lambda d, t: core.find_eq(t, "flag", "R"))
_query("find_eq_type_blind", "O", "SELECT doc_id, tok AS key_tok, parent AS tok FROM toks WHERE key = 'n' AND trim(vt, '\"') = '2'", only=["n"], cols=_FOUND)(
    lambda d, t: core.find_eq(t, "n", "2"))
_query("find_num_eq", "O", "SELECT doc_id, tok AS key_tok, parent AS tok FROM toks WHERE key = 'n' AND try_cast(vt AS DOUBLE) = 2", only=["n"], cols=_FOUND)(
    lambda d, t: core.find_num_eq(t, "n", "2.0"))
_query("find_eq_compound_nested", "O", """, met AS MATERIALIZED (SELECT doc_id, parent FROM toks WHERE key IN ('n', 'flag') GROUP BY ALL
 HAVING bool_or(key = 'n' AND vt = '1') AND bool_or(key = 'flag' AND vt = '"A"'))
 SELECT a.doc_id, a.tok AS key_tok, a.parent AS tok FROM toks a JOIN met USING (doc_id, parent) WHERE a.key = 'n'""", only=["n", "flag"], cols=_FOUND)(
    lambda d, t: core.find_eq_compound(t, [("n", "1"), ("flag", "A")]))
_query("count_key", "O", "SELECT doc_id, count(*) FILTER (WHERE key = 'n') AS n FROM toks GROUP BY doc_id", only=["n"], cols="key")(lambda d, t: core.count_key(d, t, "n"))
_query("has_key", "E", "SELECT doc_id, coalesce(bool_or(key = 'k'), false) AS has_key FROM toks GROUP BY doc_id", only=["k"], cols="key")(lambda d, t: core.has_key(d, t, "k"))
_query("keys_seen", "O", "SELECT doc_id, key, min(tok) AS first_tok FROM toks WHERE key IS NOT NULL GROUP BY ALL", cols="role key")(lambda d, t: core.keys_seen(t))
_query("keys_named_depth", "O", "SELECT doc_id, tok FROM toks WHERE key = 'flag' AND depth = 3", only=["flag"], cols="role key depth")(lambda d, t: core.keys_named(t, "flag", 3))
_query("keys_named_in", "O", """, r AS MATERIALIZED (SELECT doc_id, tok, close_of FROM toks WHERE t = '['), k AS MATERIALIZED (SELECT doc_id, tok FROM toks WHERE key = 'n')
 SELECT k.doc_id, r.tok AS root, k.tok FROM k JOIN r ON k.doc_id = r.doc_id WHERE k.tok BETWEEN r.tok AND r.close_of""", cols="role key raw_kind close_of", stored=True)(lambda d, t: core.keys_named_in(t, "n", t.where("raw_kind = '['")))
_KIND = """CASE t WHEN '{' THEN 'Object' WHEN '[' THEN 'Array' WHEN '}' THEN 'ObjectEnd' WHEN ']' THEN 'ArrayEnd' WHEN ':' THEN NULL WHEN ',' THEN NULL
 ELSE CASE WHEN key IS NOT NULL THEN 'Key' WHEN t LIKE '"%' THEN 'String' ELSE 'Scalar' END END"""
_ROLE = """CASE WHEN t IN (':',',','}',']') THEN 'None' WHEN key IS NOT NULL THEN 'Key' WHEN owner = '[' THEN 'Elem' WHEN owner IS NULL AND t IN ('{','[') THEN 'None' ELSE 'Value' END"""
_query("token_table", "O", f"SELECT doc_id, tok, {_ROLE} AS role, {_KIND} AS kind, depth, start, key FROM toks", cols="role kind depth start key")(
    lambda d, t: t.select("doc_id", "tok", "role", "kind", "depth", "start", "key"))
_query("token_count", "O", "SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id", cols="")(lambda d, t: core.token_count(d, t))
_query("max_depth", "O", "SELECT doc_id, max(depth) AS max_depth FROM toks GROUP BY doc_id", cols="depth")(lambda d, t: core.max_depth(d, t))
_query("all_tokens", "E", "SELECT doc_id, tok FROM toks", cols="")(lambda d, t: core.all_tokens(t))
_SPAN = "CASE WHEN t.close_of IS NOT NULL THEN t.close_start + 1 ELSE {} END"
_query("byte_spans", "O", f"SELECT doc_id, tok, start, ({_SPAN.format('\"end\"')})::BIGINT AS \"end\" FROM toks t", cols="start end")(lambda d, t: core.spans(t))
_query("byte_spans_coarse", "E", f"SELECT doc_id, tok, start, ({_SPAN.format('CASE WHEN t.t IN (chr(125), chr(93), chr(58), chr(44)) THEN start + 1 ELSE coalesce(ns, start + 1) END')})::BIGINT AS \"end\" FROM toks t", cols="start coarse_end")(
    lambda d, t: core.spans(t, exact=False))
_query("tape_index", "O", "SELECT doc_id, tok, CASE WHEN t NOT IN (':',',') THEN vals END AS tape FROM toks", cols="tape")(lambda d, t: t.select("doc_id", "tok", "tape"))
_query("parent_close", "O", "SELECT doc_id, tok, parent, close_of FROM toks", cols="parent close_of")(lambda d, t: t.select("doc_id", "tok", "parent", "close_of"))
_query("value_for_key", "O", "SELECT doc_id, tok, tok + 2 AS val_tok FROM toks WHERE key IS NOT NULL", cols="role val_tok")(lambda d, t: core.value_for_key(t))
_query("slices", "E", """SELECT t.doc_id, tok, substr(j, start::INT + 1, (CASE WHEN close_of IS NOT NULL THEN close_start + 1 ELSE "end" END - start)::INT) AS text
 FROM toks t JOIN docs USING (doc_id)""", cols="text", options=BuildOptions())(lambda d, t: t.select("doc_id", "tok", "text"))
_query("field_of", "O", "SELECT doc_id, parent, min(tok) + 2 AS tok FROM toks WHERE key = 'status' GROUP BY doc_id, parent", cols="role key raw_kind parent val_tok", stored=True)(
    lambda d, t: core.field_of(t, t.where("raw_kind = '{'"), "status"))
_query("children", "O", "SELECT doc_id, tok FROM toks WHERE owner = '['", cols="raw_kind parent", stored=True)(
    lambda d, t: core.children(t, t.where("raw_kind = '['")))
_query("descend_by_key", "O", """, r AS MATERIALIZED (SELECT doc_id, tok, close_of FROM toks WHERE t = '['), k AS MATERIALIZED (SELECT doc_id, tok FROM toks WHERE key = 'flag')
 SELECT k.doc_id, k.tok FROM k JOIN r ON k.doc_id = r.doc_id WHERE k.tok BETWEEN r.tok AND r.close_of""", cols="role key parent val_tok close_of", stored=True)(lambda d, t: OpPlan().all().field("lines").descend().by_key("flag").run(t))
_query("within", "O", """SELECT t.doc_id, t.tok FROM toks t JOIN (SELECT doc_id, tok, close_of FROM toks WHERE t = '[') r
 ON t.doc_id = r.doc_id AND t.tok BETWEEN r.tok AND r.close_of WHERE t.key = 'n'""", cols="role key parent val_tok close_of", stored=True)(
    lambda d, t: OpPlan().by_key("n").within(core.field_of(t, t.where("tok = 0"), "lines")).run(t))
_query("plan_and", "O", "SELECT doc_id, tok FROM toks WHERE key = 'n' AND depth = 3", cols="role key depth")(lambda d, t: OpPlan().push(And(LoadKey("n"), LoadDepth(3))).run(t))
_query("plan_or", "O", "SELECT doc_id, tok FROM toks WHERE key IN ('n', 'status')", cols="role key", stored=True)(lambda d, t: OpPlan().push(Or(LoadKey("n"), LoadKey("status"))).run(t))
_query("plan_sub", "O", "SELECT doc_id, tok FROM toks WHERE depth = 1 AND key IS DISTINCT FROM 'status'", cols="role key depth", stored=True)(
    lambda d, t: OpPlan().push(Sub(LoadDepth(1), LoadKey("status"))).run(t))
_query("plan_first", "O", "SELECT doc_id, min(tok) AS tok FROM toks WHERE key = 'n' GROUP BY doc_id", cols="role key")(lambda d, t: OpPlan().by_key("n").first().run(t))
_query("plan_last", "O", "SELECT doc_id, max(tok) AS tok FROM toks WHERE key = 'n' GROUP BY doc_id", cols="role key")(lambda d, t: OpPlan().by_key("n").last().run(t))
_query("plan_nth", "O", "SELECT doc_id, tok FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok) AS r FROM toks WHERE key = 'n') WHERE r = 2", cols="role key")(
    lambda d, t: OpPlan().by_key("n").nth(1).run(t))
_query("plan_count", "O", "SELECT doc_id, count(*) FILTER (WHERE key = 'n')::INT AS tok FROM toks GROUP BY doc_id", cols="role key", stored=True)(lambda d, t: OpPlan().by_key("n").count().run(t))
_query("run_first", "O", "SELECT doc_id, min(tok) AS tok FROM toks WHERE key = 'flag' GROUP BY doc_id", cols="role key")(lambda d, t: run_first(OpPlan().by_key("flag"), t))
_query("run_count", "O", "SELECT doc_id, count(*) AS n FROM toks WHERE key = 'flag' GROUP BY doc_id", cols="role key")(lambda d, t: run_count(OpPlan().by_key("flag"), t))
_query("at_depth", "O", "SELECT doc_id, tok FROM toks WHERE depth = 2", cols="depth")(lambda d, t: OpPlan().at_depth(2).run(t))
_query("value_eq", "O", "SELECT doc_id, tok + 2 AS tok FROM toks WHERE key = 'status' AND vt = '\"F\"'", cols="role key parent val_tok text", stored=True)(
    lambda d, t: OpPlan().all().field("status").value_eq("F").run(t))
_query("hits_and_or", "O", "SELECT doc_id, count(*) AS n FROM toks WHERE key IN ('n', 'flag') AND depth = 3 GROUP BY doc_id", cols="role key depth")(
    lambda d, t: KeyHits.named(t, "n").or_(KeyHits.named(t, "flag")).and_(KeyHits.all(t)).at_depth(3).count())
_query("hits_first_last", "O", "SELECT doc_id, min(tok) AS tok, max(tok) AS last_tok FROM toks WHERE key = 'flag' GROUP BY doc_id", cols="role key", stored=True)(
    lambda d, t: KeyHits.named(t, "flag").first().join(core.sorted_join(KeyHits.named(t, "flag").last().withColumnRenamed("tok", "last_tok")), "doc_id"))
_PROBES = "probes AS (SELECT doc_id, unnest([3, 17, 40]) AS pos FROM docs)"


def _probes(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.explode(F.array(*map(F.lit, (3, 17, 40))).cast("array<bigint>")).alias("pos"))


_query("token_at", "O", None, _sql("O", f", {_PROBES} SELECT p.doc_id, p.pos::BIGINT AS pos, t.tok FROM probes p ASOF LEFT JOIN toks t ON p.doc_id = t.doc_id AND p.pos >= t.start"), cols="start")(
    lambda d, t: core.token_at(t, _probes(d)))
_query("container_at_byte", "O", None, _sql("O", f""", {_PROBES} SELECT p.doc_id, p.pos::BIGINT AS pos, max(t.tok) AS tok FROM probes p
 LEFT JOIN toks t ON p.doc_id = t.doc_id AND t.start <= p.pos AND p.pos < t.close_start GROUP BY ALL"""), cols="start close_of parent")(lambda d, t: core.container_at_byte(t, _probes(d)))
_query("value_token_at", "O", None, _sql("O", f""", {_PROBES} SELECT p.doc_id, p.pos::BIGINT AS pos, CASE WHEN t.t NOT IN ('{{','}}','[',']',':',',') THEN t.tok END AS tok
 FROM probes p ASOF LEFT JOIN toks t ON p.doc_id = t.doc_id AND p.pos >= t.start"""), cols="start raw_kind")(lambda d, t: core.value_token_at(t, _probes(d)))
_query("ancestors", "O", """, a AS MATERIALIZED (SELECT doc_id, tok FROM toks WHERE key = 'flag'),
 c AS MATERIALIZED (SELECT doc_id, tok, close_of, depth, vals FROM toks WHERE close_of IS NOT NULL)
 SELECT a.doc_id, a.tok, c.tok AS ancestor, c.depth, c.vals AS tape FROM a JOIN c ON a.doc_id = c.doc_id WHERE c.tok < a.tok AND a.tok < c.close_of""", cols="key close_of depth tape", stored=True)(lambda d, t: core.ancestors(t, t.where("key = 'flag'")))
_query("parents_as_tape", "O", """, a AS MATERIALIZED (SELECT doc_id, tok FROM toks WHERE key = 'n'),
 c AS MATERIALIZED (SELECT doc_id, tok, close_of, depth, vals FROM toks WHERE close_of IS NOT NULL)
 SELECT a.doc_id, a.tok, c.vals AS parent_tape, c.depth FROM a JOIN c ON a.doc_id = c.doc_id WHERE c.tok < a.tok AND a.tok < c.close_of""", cols="key close_of depth tape", stored=True)(lambda d, t: core.parents_as_tape(t, t.where("key = 'n'")))
_query("json_number_eq", "E", "SELECT doc_id, tok, try_cast(vt AS DOUBLE) = 42 AS eq FROM toks WHERE key = 'k'", cols="key val_text")(
    lambda d, t: t.where("key = 'k'").select("doc_id", "tok", values.json_number_eq(F.col("val_text"), "42.0").alias("eq")))
_query("parse_f64", "E", "SELECT doc_id, tok, try_cast(vt AS DOUBLE) AS f FROM toks WHERE key = 'k'", cols="key val_text")(
    lambda d, t: t.where("key = 'k'").select("doc_id", "tok", values.parse_f64(F.col("val_text")).alias("f")))
_query("parse_i64", "E", "SELECT doc_id, tok, try_cast(vt AS BIGINT) AS i FROM toks WHERE key = 'k'", cols="key val_text")(
    lambda d, t: t.where("key = 'k'").select("doc_id", "tok", values.parse_i64(F.col("val_text")).alias("i")))
_query("multi_key_scan", "E", "SELECT doc_id, 0::INT AS hit, 1::INT AS pattern, start AS byte_offset FROM toks WHERE key = 'k'", cols="")(
    lambda d, t: core.multi_key_scan(d, ["x", "k"]))
_query("multi_key_hits", "O", """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS hit, CASE key WHEN 'flag' THEN 0 ELSE 1 END AS pattern,
 start AS byte_offset FROM toks WHERE key IN ('flag', 'n')""", cols="")(lambda d, t: core.multi_key_scan(d, ["flag", "n"]))
_query("validate_utf8", "E", None, "SELECT event_id AS doc_id, event_id % 3 <> 0 AS valid FROM events", cols="")(
    lambda d, t: d.select("doc_id", values.valid_utf8(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("7BFFFE7D"))).otherwise(F.col("json").cast("binary"))).alias("valid")))
_query("index_errors", "V", None, f"SELECT event_id AS doc_id, {_case(ODD_ERRORS)} AS error FROM events", cols="")(lambda d, t: index_errors(d))
_query("odd_tokens", "V", "SELECT doc_id, tok, depth, start, parent FROM toks", cols="depth start parent")(lambda d, t: t.select("doc_id", "tok", "depth", "start", "parent"))
_query("decoded_keys", "V", r"SELECT doc_id, replace(replace(key, '\n', chr(10)), '\u0041', 'A') AS key, min(tok) AS first_tok FROM toks WHERE key IS NOT NULL GROUP BY ALL", cols="role key")(
    lambda d, t: core.keys_seen(t))
_query("find_eq_escaped", "V", r"""SELECT doc_id, tok AS key_tok, parent AS tok FROM toks WHERE key = 'k' AND vt = '"x\"y"'""", only=["k"], cols=_FOUND)(
    lambda d, t: core.find_eq(t, "k", 'x"y'))
_query("find_num_eq_fractions", "V", "SELECT doc_id, tok AS key_tok, parent AS tok FROM toks WHERE key = 'v' AND vt = '-1e3'", only=["v"], cols=_FOUND)(
    lambda d, t: core.find_num_eq(t, "v", "-1000.0"))
_query("parse_f64_fractions", "V", "SELECT doc_id, tok, try_cast(CASE WHEN vt LIKE '\"%' THEN NULL ELSE vt END AS DOUBLE) AS f FROM toks WHERE key = 'v'", only=["v"], cols="key val_text")(
    lambda d, t: t.where("key = 'v'").select("doc_id", "tok", values.parse_f64(F.col("val_text")).alias("f")))
_query("parse_i64_fractions", "V", "SELECT doc_id, tok, trunc(try_cast(CASE WHEN vt LIKE '\"%' THEN NULL ELSE vt END AS DOUBLE))::BIGINT AS i FROM toks WHERE key = 'v'", only=["v"], cols="key val_text")(
    lambda d, t: t.where("key = 'v'").select("doc_id", "tok", values.parse_i64(F.col("val_text")).alias("i")))
_query("span_length", "V", "SELECT doc_id, tok, (CASE WHEN close_of IS NOT NULL THEN close_start + 1 ELSE \"end\" END - start)::BIGINT AS len, false AS is_empty FROM toks", cols="start end")(
    lambda d, t: t.select("doc_id", "tok", values.span_length(F.col("start"), F.col("end")).alias("len"), (values.span_length(F.col("start"), F.col("end")) == 0).alias("is_empty")))
_query("minimal_options", "E", "SELECT doc_id, tok, depth, NULL::VARCHAR AS role, NULL::VARCHAR AS key FROM toks", cols="depth role key", options=BuildOptions.minimal())(
    lambda d, t: t.select("doc_id", "tok", "depth", "role", "key"))
_query("has_keys", "E", "SELECT doc_id, true AS has_keys FROM toks GROUP BY doc_id", cols="role")(lambda d, t: t.groupBy("doc_id").agg(core.has_keys(t).alias("has_keys")))
_query("hits_collected", "O", "SELECT doc_id, string_agg(tok::VARCHAR, ',' ORDER BY tok) AS toks FROM toks WHERE key = 'n' GROUP BY doc_id", cols="role key")(
    lambda d, t: KeyHits.named(t, "n").collected().select("doc_id", F.array_join(F.col("toks").cast("array<string>"), ",").alias("toks")))
_query("hits_in_order", "O", "SELECT doc_id, tok FROM toks WHERE key = 'n' ORDER BY doc_id, tok", cols="role key")(lambda d, t: KeyHits.named(t, "n").ordered())
_query("plan_anchor", "O", "SELECT doc_id, tok FROM toks WHERE key = 'n'", cols="role key close_of", stored=True)(lambda d, t: OpPlan().anchor(0).descend().by_key("n").run(t))
_query("plan_optimized", "O", "SELECT doc_id, tok FROM toks WHERE key = 'n' AND depth = 3", cols="role key depth")(
    lambda d, t: OpPlan().all().by_key("n").by_key("n").at_depth(3).optimize().run(t))
_OPS = (LoadKey("n"), LoadDepth(1), algebra.LoadAll(), algebra.FieldOf("n"), algebra.Descendants(), algebra.AllChildren(), algebra.ValueEqLit("1"), algebra.First(), algebra.Nth(0), algebra.Count())


def _op_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinality class and demand of the steps of plans."""
    rows = [(type(o).__name__, algebra.card_class(o).value, algebra.supports_demand(o)) for o in _OPS]
    return spark.createDataFrame(rows, "op string, card string, demand boolean")


QUERIES["op_classes"] = _op_classes
ORACLE_SQL["op_classes"] = """SELECT * FROM (VALUES ('LoadKey', 'constant', false), ('LoadDepth', 'constant', false), ('LoadAll', 'constant', false), ('FieldOf', 'subset', false),
 ('Descendants', 'expand', false), ('AllChildren', 'expand', false), ('ValueEqLit', 'subset', false), ('First', 'reduce', true), ('Nth', 'reduce', true), ('Count', 'reduce', true)) v(op, card, demand)"""
