import json

import pytest
from pyspark.sql import functions as F

from structjson import queries
from structjson.functions import values
from structjson.operators import core
from structjson.operators.hits import KeyHits
from structjson.plans.algebra import And, CardClass, Count, LoadDepth, LoadKey, LoadOne, OpPlan, Or, Sub, card_class, run_count, run_first, supports_demand
from structjson.schema import BuildOptions
from structjson.sources.index import explain_index, index_errors, index_json, read_index, stored_index, write_index
from structjson.streaming.index import find_eq_stream
from tests.reader import around, below, read, some_documents

ROOMS = '{"hall":{"lamp":"on","w":[3]},"attic":{"lamp":"off"},"shed":{"lamp":"on"}}'


@pytest.fixture(scope="module")
def one(spark):
    def build(doc, **options):
        docs = spark.createDataFrame([(1, doc)], "doc_id long, json string")
        return docs, index_json(docs, options=BuildOptions(**options)).cache()

    return build


def toks(df, col="tok"):
    return sorted(r[col] for r in df.collect())


@pytest.fixture(scope="module")
def many(spark):
    """Documents, their tokens by the reader of the tests, and their stored token table."""
    texts = some_documents(11, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, json string")
    return docs, dict(enumerate(texts)), {i: read(t) for i, t in enumerate(texts)}, stored_index(index_json(docs))


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def every(read_docs, test):
    """``(doc, tok)`` of the tokens that pass ``test(tokens, number, token)``."""
    return sorted((i, n) for i, ts in read_docs.items() for n, t in enumerate(ts) if test(ts, n, t))


def bare(text):
    return json.loads(text) if text.startswith('"') else text


def test_table_equals_reader(many):
    _, texts, want, t = many
    raw = {'"': "Quote", "s": "Scalar"}
    got = pairs(t.select("doc_id", "tok", "raw_kind", "start", "end", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("close_of", F.lit(-1)).alias("close_of"), F.coalesce("key", F.lit("-")).alias("key"), F.coalesce("val_tok", F.lit(-1)).alias("val_tok"), "text"),
                "doc_id", "tok", "raw_kind", "start", "end", "depth", "parent", "close_of", "key", "val_tok", "text")
    none = lambda x, other=-1: other if x is None else x
    assert got == sorted(
        (i, n, raw.get(x.raw, x.raw), x.start, x.end, x.depth, none(x.parent), none(x.close), none(x.key, "-"), none(x.value), x.text(texts[i]))
        for i, ts in want.items() for n, x in enumerate(ts)
    )


def test_find_eq_equals_brute_force(many):
    _, texts, want, t = many
    for key, literal in (("lamp", "on"), ("size", "1"), ("rug", 'a"b'), ("w", "{}"), ("w", "[]")):
        found = sorted((i, n, x.parent) for i, ts in want.items() for n, x in enumerate(ts) if x.key == key and bare(ts[x.value].text(texts[i])) == literal)
        assert pairs(core.find_eq(t, key, literal), "doc_id", "key_tok", "tok") == found
    number = sorted((i, n) for i, ts in want.items() for n, x in enumerate(ts) if x.key == "size" and ts[x.value].text(texts[i]) in ("1", "1.0"))
    assert pairs(core.find_num_eq(t, "size", "1"), "doc_id", "key_tok") == number and number


def test_compound_equals_brute_force(many):
    _, texts, want, t = many
    conds = [("lamp", "on"), ("size", "1")]
    holds = lambda i, ts, obj: all(any(x.key == k and x.parent == obj and bare(ts[x.value].text(texts[i])) == lit for x in ts) for k, lit in conds)
    for these in (conds, conds[:1]):
        conds = these
        found = sorted((i, n, x.parent) for i, ts in want.items() for n, x in enumerate(ts) if x.key == "lamp" and holds(i, ts, x.parent))
        assert pairs(core.find_eq_compound(t, conds), "doc_id", "key_tok", "tok") == found
    assert core.find_eq_compound(t, []).count() == 0


def test_keys_equal_brute_force(many):
    docs, _, want, t = many
    count = {i: sum(x.key == "lamp" for x in ts) for i, ts in want.items()}
    assert dict(pairs(core.count_key(docs, t, "lamp"), "doc_id", "n")) == count
    assert dict(pairs(core.has_key(docs, t, "lamp"), "doc_id", "has_key")) == {i: n > 0 for i, n in count.items()}
    assert pairs(core.keys_named(t, "size", 2), "doc_id", "tok") == every(want, lambda ts, n, x: x.key == "size" and x.depth == 2)
    firsts = {}
    for i, ts in want.items():
        for n, x in enumerate(ts):
            if x.key is not None:
                firsts.setdefault((i, x.key), n)
    assert pairs(core.keys_seen(t), "doc_id", "key", "first_tok") == sorted((*k, n) for k, n in firsts.items())
    fields = {}
    for i, ts in want.items():
        for x in ts:
            if x.key == "rug":
                fields.setdefault((i, x.parent), x.value)
    assert pairs(core.field_of(t, t.where("raw_kind = '{'"), "rug"), "doc_id", "parent", "tok") == sorted((*k, v) for k, v in fields.items())
    inside = sorted((i, r, n) for i, ts in want.items() for r, y in enumerate(ts) if y.raw == "[" for n in below(ts, r) if ts[n].key == "w")
    assert pairs(core.keys_named_in(t, "w", t.where("raw_kind = '['")), "doc_id", "root", "tok") == inside
    assert dict(pairs(core.max_depth(docs, t), "doc_id", "max_depth")) == {i: max(x.depth for x in ts) for i, ts in want.items()}


def test_positions_equal_brute_force(spark, many):
    _, texts, want, t = many
    at = [(i, p) for i, text in texts.items() for p in range(-1, len(text) + 2)]
    probes = spark.createDataFrame(at, "doc_id long, pos long")

    def last(i, p):
        return max((n for n, x in enumerate(want[i]) if x.start <= p), default=None)

    def container(i, p):
        return max((n for n, x in enumerate(want[i]) if x.close is not None and x.start <= p < want[i][x.close].start), default=None)

    got = lambda f: {(r.doc_id, r.pos): r.tok for r in f(t, probes).collect()}
    assert got(core.token_at) == {(i, p): last(i, p) for i, p in at}
    assert got(core.container_at_byte) == {(i, p): container(i, p) for i, p in at}
    assert got(core.value_token_at) == {(i, p): n if (n := last(i, p)) is not None and want[i][n].raw in '"s' else None for i, p in at}


def test_ancestors_equal_brute_force(many):
    docs, texts, want, t = many
    held = sorted((i, n, a) for i, ts in want.items() for n, x in enumerate(ts) if x.raw == "s" for a in around(ts, n))
    scalars = t.where("raw_kind = 'Scalar'")
    assert pairs(core.ancestors(t, scalars), "doc_id", "tok", "ancestor") == held
    tape = {(r.doc_id, r.tok): r.tape for r in t.collect()}
    assert pairs(core.parents_as_tape(t, scalars), "doc_id", "tok", "parent_tape") == sorted((i, n, tape[i, a]) for i, n, a in held)
    cut = t.join(docs, "doc_id").select("doc_id", "tok", values.slice_bytes(F.col("json"), F.col("start"), F.col("end")).alias("s"))
    assert pairs(cut, "doc_id", "tok", "s") == sorted((i, n, x.text(texts[i])) for i, ts in want.items() for n, x in enumerate(ts))
    assert "Object" in explain_index(t, 1)


def test_plans_equal_brute_force(many):
    _, texts, want, t = many
    run = lambda plan: pairs(plan.run(t), "doc_id", "tok")
    under = lambda ts, n, test: any(test(ts[a]) for a in (n, *around(ts, n)) if ts[a].close is not None or a == n)
    assert run(OpPlan().anchor(0).children()) == every(want, lambda ts, n, x: x.parent == 0)
    assert run(OpPlan().at_depth(2).children()) == every(want, lambda ts, n, x: x.parent is not None and ts[x.parent].depth == 2)
    values_of = {(i, y.value) for i, ts in want.items() for y in ts if y.key == "lamp" and y is next(z for z in ts if z.key == "lamp" and z.parent == y.parent)}
    subtree = {(i, m) for i, v in values_of for m in below(want[i], v)}
    assert run(OpPlan().all().field("lamp")) == sorted(values_of)
    assert run(OpPlan().all().field("lamp").descend()) == sorted(subtree)
    assert run(OpPlan().all().field("lamp").descend().by_key("w")) == sorted(x for x in subtree if want[x[0]][x[1]].key == "w")
    assert run(OpPlan().all().field("lamp").value_eq("on")) == sorted(x for x in values_of if bare(want[x[0]][x[1]].text(texts[x[0]])) == "on")
    assert run(OpPlan().by_key("w").within(5)) == sorted((i, n) for i, ts in want.items() if len(ts) > 5 for n in below(ts, 5) if ts[n].key == "w")
    lamps = {i: [n for n, x in enumerate(ts) if x.key == "lamp"] for i, ts in want.items()}
    assert run(OpPlan().by_key("lamp").first()) == [(i, x[0]) for i, x in lamps.items() if x]
    assert run(OpPlan().by_key("lamp").last()) == [(i, x[-1]) for i, x in lamps.items() if x]
    assert run(OpPlan().by_key("lamp").nth(1)) == [(i, x[1]) for i, x in lamps.items() if len(x) > 1]
    assert run(OpPlan().by_key("lamp").count()) == [(i, len(x)) for i, x in lamps.items()]
    assert pairs(run_first(OpPlan().by_key("lamp"), t), "doc_id", "tok") == [(i, x[0]) for i, x in lamps.items() if x]
    assert pairs(run_count(OpPlan().by_key("lamp"), t), "doc_id", "n") == [(i, len(x)) for i, x in lamps.items() if x]
    assert run(OpPlan((Sub(LoadKey("lamp"), LoadDepth(1)),))) == every(want, lambda ts, n, x: x.key == "lamp" and x.depth != 1)
    assert run(OpPlan((Or(LoadKey("lamp"), LoadKey("w")),))) == every(want, lambda ts, n, x: x.key in ("lamp", "w"))


def test_compat_subtree_of_a_leaf_reaches_the_end(many):
    _, _, want, t = many
    leaf = t.where("tok = 1 and raw_kind = 'Quote'")
    assert pairs(core.descendants(t, leaf, compat=True), "doc_id", "tok") == sorted((i, n) for i, ts in want.items() if ts[1].raw == '"' for n in range(1, len(ts)))


def test_optimizer_keeps_results(many):
    _, _, _, t = many
    assert OpPlan().all().by_key("rug").optimize().ops == (LoadKey("rug"),)
    assert OpPlan().by_key("rug").by_key("w").optimize().ops == (And(LoadKey("rug"), LoadKey("w")),)
    kept = OpPlan().at_depth(1).by_key("rug").by_key("rug")
    assert pairs(kept.optimize().run(t), "doc_id", "tok") == pairs(OpPlan().by_key("rug").at_depth(1).run(t), "doc_id", "tok")
    assert card_class(Count()) is CardClass.REDUCE and supports_demand(Count())
    with pytest.raises(ValueError):
        OpPlan().count().first()


def test_hits_equal_brute_force(many):
    _, _, want, t = many
    lamp, w = KeyHits.named(t, "lamp"), KeyHits.named(t, "w")
    both = every(want, lambda ts, n, x: x.key in ("lamp", "w"))
    assert pairs(lamp.or_(w).rows, "doc_id", "tok") == both and lamp.and_(w).rows.count() == 0
    assert pairs(lamp.at_depth(2).rows, "doc_id", "tok") == every(want, lambda ts, n, x: x.key == "lamp" and x.depth == 2)
    mine = {i: [n for n, x in enumerate(ts) if x.key == "lamp"] for i, ts in want.items()}
    assert pairs(lamp.collected(), "doc_id", "toks") == [(i, x) for i, x in mine.items() if x]
    assert pairs(lamp.first(), "doc_id", "tok") == [(i, x[0]) for i, x in mine.items() if x]
    assert pairs(lamp.last(), "doc_id", "tok") == [(i, x[-1]) for i, x in mine.items() if x]
    assert [(r.doc_id, r.tok) for r in lamp.ordered().collect()] == [(i, n) for i, x in mine.items() for n in x]
    assert pairs(lamp.count(), "doc_id", "n") == [(i, len(x)) for i, x in mine.items() if x]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_not_broadcast(many):
    _, _, want, t = many
    lamp, w = KeyHits.named(t, "lamp"), KeyHits.named(t, "w")
    filtered = lamp.or_(w).and_(KeyHits.all(t)).at_depth(1)
    given = KeyHits(t, lamp.or_(w).rows).and_(KeyHits(t, t.select("doc_id", "tok"))).at_depth(1)
    assert "Join" not in plan_of(filtered.count()) and "Broadcast" not in plan_of(given.count())
    keys = every(want, lambda ts, n, x: x.key in ("lamp", "w") and x.depth == 1)
    assert keys and pairs(filtered.rows, "doc_id", "tok") == pairs(given.rows, "doc_id", "tok") == keys


def test_set_operations_are_not_broadcast(many):
    _, _, want, t = many
    lamp = lambda x: x.key == "lamp"
    one = lambda x: x.depth == 1
    for op, test in ((And, lambda x: lamp(x) and one(x)), (Or, lambda x: lamp(x) or one(x)), (Sub, lambda x: lamp(x) and not one(x))):
        filtered = OpPlan((op(LoadKey("lamp"), LoadDepth(1)),)).run(t)
        tokens_of = t.select("doc_id", "tok", "depth")  # sides of which one is given as rows
        joined = OpPlan((op(LoadKey("lamp"), LoadOne(tokens_of.where("depth = 1"))),)).run(t)
        assert "Join" not in plan_of(filtered)
        assert pairs(filtered, "doc_id", "tok") == pairs(joined, "doc_id", "tok") == every(want, lambda ts, n, x: test(x))  # noqa: B023
    nested = OpPlan((Sub(LoadDepth(1), Or(LoadKey("lamp"), And(LoadKey("w"), LoadDepth(1)))),))
    assert pairs(nested.run(t), "doc_id", "tok") == every(want, lambda ts, n, x: x.depth == 1 and x.key not in ("lamp", "w"))


def test_keys_inside_roots_are_not_broadcast(many):
    _, _, want, t = many
    inside = core.keys_named_in(t, "w", t)  # every token is a root, leaves and the keys themselves too
    ends = lambda ts, a: a if ts[a].close is None else ts[a].close
    assert "Broadcast" not in plan_of(inside) + plan_of(core.keys_named_in(t, "w", t, compat=True))
    assert pairs(inside, "doc_id", "root", "tok") == sorted((i, a, n) for i, ts in want.items() for n, x in enumerate(ts) if x.key == "w" for a in range(n + 1) if ends(ts, a) >= n)


def test_loads_in_a_row_are_not_broadcast(many):
    _, _, want, t = many
    at_one = every(want, lambda ts, n, x: x.key == "lamp" and x.depth == 1)
    for plan in (OpPlan().all().by_key("lamp").by_key("lamp").at_depth(1), OpPlan().by_key("lamp").at_depth(1), OpPlan().all().all().at_depth(1).by_key("lamp")):
        assert "Join" not in plan_of(plan.run(t)) and pairs(plan.run(t), "doc_id", "tok") == at_one
    after = OpPlan().at_depth(1).children().by_key("lamp").at_depth(2).run(t)  # loads that narrow what a step has made
    assert pairs(after, "doc_id", "tok") == every(want, lambda ts, n, x: x.key == "lamp" and x.depth == 2)
    below_one = OpPlan().at_depth(1).descend().by_key("lamp").at_depth(2).run(t)
    assert pairs(below_one, "doc_id", "tok") == every(want, lambda ts, n, x: x.key == "lamp" and x.depth == 2)
    assert OpPlan().by_key("lamp").by_key("w").run(t).count() == 0


def test_joins_by_document_are_not_broadcast(many):
    docs, _, _, t = many
    opens = t.where("close_of is not null")
    found = (
        core.token_count(docs, t), core.descendants(t, opens), core.field_of(t, opens, "lamp"), core.children(t, opens), core.ancestors(t, t),
        OpPlan().all().field("lamp").value_eq("on").run(t), OpPlan().by_key("w").within(opens).count().run(t),
        OpPlan((And(LoadKey("lamp"), LoadOne(t.where("depth = 1"))),)).run(t), OpPlan().at_depth(1).children().by_key("lamp").run(t),
    )
    assert [x for x in map(plan_of, found) if "Join" not in x or "Broadcast" in x] == []


def test_order_documents_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "O"), (2, "F")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, "N"), (1, 2, "R")], "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = queries.orders(spark, str(tmp_path))
    assert "Broadcast" not in plan_of(docs)
    assert pairs(docs, "doc_id", "json") == [(1, '{"o_orderkey":1,"status":"O","lines":[{"n":1,"flag":"N"},{"n":2,"flag":"R"}]}')]


def test_columns_on_demand(spark):
    docs = spark.createDataFrame([(1, '{"w":[1,{"w":"\\u0041"}]}'), (2, '\\{"w":2}'), (3, None)], "doc_id long, json string")
    whole = index_json(docs)
    some = index_json(docs, columns=["key", "depth"])
    assert some.columns == ["doc_id", "tok", "depth", "key"]
    assert pairs(some.fillna("-"), *some.columns) == pairs(whole.select(*some.columns).fillna("-"), *some.columns)
    assert pairs(index_json(docs, only_keys=["w"], columns=["val_text"]), "doc_id", "tok", "val_text") == pairs(whole.where("key = 'w'"), "doc_id", "tok", "val_text")


def test_keys_with_odd_characters(spark):
    docs = spark.createDataFrame([(1, '{"a\\\\Eb":1,"c.d":2,"cxd":3}')], "doc_id long, json string")
    assert [r.pattern for r in core.multi_key_scan(docs, ["c.d", "a\\\\Eb"]).orderBy("hit").collect()] == [1, 0]
    assert core.multi_key_scan(docs, []).count() == 0


def test_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, "42"), (2, ""), (3, None), (4, "{")], "doc_id long, json string")
    t = index_json(docs)
    assert {(r.doc_id, r.n) for r in core.token_count(docs, t).collect()} == {(1, 0), (2, 0), (3, 0), (4, 0)}
    assert {r.doc_id: r.error for r in index_errors(docs).collect()} == {1: None, 2: None, 3: None, 4: "unclosed container"}
    with pytest.raises(Exception, match="unclosed container"):
        index_json(docs, mode="FAILFAST").collect()


def test_only_keys_finds_escaped_spellings(spark):
    docs = spark.createDataFrame([(1, '{"\\u006b":7}'), (2, '{"k":7}'), (3, '{"j":7}')], "doc_id long, json string")
    assert toks(core.find_eq(index_json(docs, only_keys=["k"]), "k", "7"), "doc_id") == [1, 2]


def test_values(spark):
    c = F.col("v")
    rows = spark.createDataFrame([(v,) for v in ('"he\\nllo"', '"hello"', "42", '"\\u0041"', "42.0", "3.9", "1e400", "x", "nan", " 42", "99999999999999999999", '"a/b"')], "v string")
    got = {r.v: r for r in rows.select("v", values.json_string_eq(c, "he\nllo").alias("nl"), values.json_string_eq(c, "A").alias("u"), values.json_string_eq(c, "a/b").alias("slash"), values.parse_f64(c).alias("f"), values.parse_i64(c).alias("i"), values.json_number_eq(c, "42").alias("n")).collect()}
    assert got['"he\\nllo"'].nl and not got['"hello"'].nl and not got['"\\u0041"'].u and got['"a/b"'].slash
    assert (got["3.9"].i, got["nan"].i, got["99999999999999999999"].i, got["x"].i, got[" 42"].f) == (3, 0, 9223372036854775807, None, None)
    assert got["42"].n and got["42.0"].n and not got["nan"].n and not got["x"].n and got["1e400"].f == float("inf")


def test_raw_scans(spark):
    docs = spark.createDataFrame([(1, '{"type":"é","actor":{},"repo" :1,"repo":2}')], "doc_id long, json string")
    rows = core.multi_key_scan(docs, ["type", "actor", "repo"]).orderBy("hit").collect()
    assert [(r.pattern, r.byte_offset) for r in rows] == [(0, 1), (1, 13), (2, 34)]
    data = spark.createDataFrame([(bytearray(b"hello"),), (bytearray(b"\xff\xfe"),)], "b binary")
    assert [r.v for r in data.select(values.valid_utf8(F.col("b")).alias("v")).collect()] == [True, False]


def test_stored_index_and_stream(spark, one, tmp_path):
    _, t = one(ROOMS)
    write_index(t, str(tmp_path / "i"))
    assert toks(core.find_eq(read_index(spark, str(tmp_path / "i")), "lamp", "on")) == [3, 25]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(ROOMS + '\n{"y":1}\n')
    stream = spark.readStream.format("text").load(str(tmp_path / "in")).select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("json"))
    q = find_eq_stream(stream, "lamp", "on").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert toks(spark.table("found")) == [3, 25]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, '{"k":1}', 5, "x")], "id long, body string, tok int, key string")
    assert toks(core.find_eq(index_json(docs, "id", "body"), "k", "1")) == [0]
