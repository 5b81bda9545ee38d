"""Nulls, repeats, ties, extremes and clashing names."""

import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from pyarrow import fs as pafs  # noqa: E402
from structjson.llm import common, embeddings, jaccard, mixing, packing, quality, warc  # noqa: E402
from structjson.llm.common import components, fresh_path  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mix_weight string, q_doc string, rep int, key int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y", 1, 2) for i, t, lang, s in rows], COLUMNS)


def test_weights_of_sources_of_very_different_size(spark):
    sizes = spark.createDataFrame([("a", 1000, 3), ("b", 10**13, 9), ("c", 0, 1), ("d", 1, 1)], "source string, tokens long, docs long")
    for options in ({"max_repeats": 2.0}, {"max_repeats": 1e6}, {"target_entropy": 0.5}, {"target_entropy": 1.0}, {"target_entropy": 0.0}):
        got = {r.source: r.weight for r in mixing.source_weights(sizes, **options).collect()}
        assert set(got) == {"a", "b", "d"} and min(got.values()) > 0 and abs(sum(got.values()) - 1) < 1e-9
        if "max_repeats" in options:
            budget = max(n / got[s] for s, n in (("a", 1000), ("b", 10**13), ("d", 1)))
            assert max(got[s] * budget / n for s, n in (("a", 1000), ("b", 10**13), ("d", 1))) <= options["max_repeats"] * 1.001
        else:
            h = -sum(w * math.log(w) for w in got.values()) / math.log(3)
            assert h >= options["target_entropy"] - 1e-9
    assert mixing.source_weights(sizes.limit(0), max_repeats=2.0).count() == 0


def test_exponent_equals_bisection(spark):
    n = [5, 80, 3000, 70_000, 70_000]
    live = spark.createDataFrame([(str(k), x, 1) for k, x in enumerate(n)], "source string, tokens long, docs long")

    def entropy(e):
        w = np.array([(x / sum(n)) ** e for x in n])
        w /= w.sum()
        return -(w * np.log(w)).sum()

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(mid) >= 0.9 * math.log(len(n)) else (lo, mid)
    assert abs(mixing.exponent(live, target_entropy=0.9)[0] - lo) < 1e-9


def test_mixing_odd_rows(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", None, None), (None, None, None, "t"), (3, "", "en", "t"), (4, "w " * 50_000, "en", "big")]
    got = mixing.mix(docs(spark, rows), max_repeats=3.0).collect()
    assert {(r.doc_id, r.source) for r in got} == {(i, s) for i, _, _, s in rows}
    assert all(isinstance(r.mix_weight, float) for r in got) and max(Counter((r.doc_id, r.source, r.mix_epoch) for r in got).values()) == 2


def test_quality_with_many_sites_is_the_same(spark, monkeypatch):
    rows = [(k % 35, ("good words of the house " if k % 2 else "$$$ BUY!!! ") * (1 + k % 5), None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}") for k in range(80)]
    rows += [(None, "x", None, None), (7, None, "en", "s1"), (8, "", None, "s2"), (9, "long " * 40_000, "de", "s0")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    shown = lambda df: sorted(str([r.doc_id, r.text and len(r.text), r.source, r.lang] + [round(r[c], 9) for c in ("q_doc", "q_host", "q_path", "q_score")] + [r.q_keep]) for r in df.collect())
    small = shown(quality.score_quality(d, labels))
    monkeypatch.setattr(quality, "SMALL_SITES", 0)
    assert len(small) == len(rows) and shown(quality.score_quality(d, labels)) == small
    assert quality.score_quality(d.limit(0), labels).count() == 0
    assert quality.score_quality(d, labels, sample=1).count() == len(rows)


def test_ids_that_repeat_with_other_vectors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 12))
    rows = [(5, a), (5, b), (9, b + 0.01), (5, b), (None, a), (11, -a), (12, a * 3)]
    vectors = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rep int, n long")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors, recall=0.9999).collect())
    # 5 (a) links with 12; each 5 (b) with the other and with 9; a row without an id and -a with nothing.
    assert got == Counter([(5, 1, 5, True), (12, 1, 5, False), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (11, 0, 11, True), (None, 0, None, True)])
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def _records(folder):
    store, root = pafs.FileSystem.from_uri(folder)
    for f in store.get_file_info(pafs.FileSelector(root)):
        if f.path.endswith(".gz"):
            with store.open_input_stream(f.path, compression=None) as raw:
                yield from (h for h, _ in warc.read_records(raw))


def test_archives_of_odd_ids(spark):
    big = "y" * 1200
    rows = [(-(2**63), "u", "a"), (2**63 - 1, "u", big), (7, "u", big), (7, "u", big), (7, "v", "b"), (None, "n", big), (None, "n", "c"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, record_type string, shard int")
    folder = fresh_path(spark, "warc")
    warc.write_archive(pages, folder, shard_bytes=500)
    got = Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archive(spark, folder).collect())
    top = 2**63 - 1
    assert got == Counter([
        (-(2**63), "u", "response", None, 1), (top, "u", "response", None, 1200), (7, "u", "revisit", top, 1200), (7, "u", "revisit", top, 1200),
        (7, "v", "response", None, 1), (None, "n", "response", None, 1200), (None, "n", "response", None, 1), (None, None, "response", None, 0),
    ])
    heads = list(_records(folder))
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    assert {h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h} <= {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}


def test_shards_hold_like_bytes_wherever_ids_lie(spark):
    ids = [*range(300), 10**15]
    pages = spark.createDataFrame([(i, "u", "x" * 100) for i in ids], "page_id long, url string, html string")
    for parts in (1, 5):
        folder = fresh_path(spark, "warc")
        made = warc.write_archive(pages.repartition(parts), folder, shard_bytes=1000).collect()
        assert Counter(r.records for r in made) == Counter({10: 30, 1: 1})
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, folder)  # an archive is not written over


def test_jaccard_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, words, "", ""), (2, words + " end", "", ""), (3, None, "", ""), (4, " \n", "", ""), (4, " \n", "", ""), (None, words, "", ""), (5, "one", "", ""), (6, "ONE", "", ""), (6, "ONE", "", "")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs(spark, rows)).collect())
    assert got == Counter([(1, 39_996, 1), (2, 39_997, 1), (3, 0, 3), (4, 0, 4), (4, 0, 4), (None, 39_996, None), (5, 1, 5), (6, 1, 5), (6, 1, 5)])
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs(spark, rows)).collect()) == ["1", "3", "4", "4", "5", "None"]
    assert jaccard.similar_documents(docs(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    assert {r.component for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_packing_odd_rows(spark):
    path = str(public_path())
    rows = [(1, "a b c", "", ""), (1, "a b c", "", ""), (None, None, "", ""), (2, "word " * 5000, "", "")]
    got = packing.pack(docs(spark, rows), path, capacity=64).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter({1: 2, None: 1, 2: 1})
    assert sum(r.length for r in got if r.doc_id == 2) == 5001 and packing.pack(docs(spark, rows).limit(0), path).count() == 0


def public_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """Rounds of tiny tasks took longer than all else on large groups of copies."""
    made, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, tag: made.append(tag) or write(df, tag))
    links = spark.sql("select id * 7919 % 1009 as a, (id + 1) * 7919 % 1009 as b from range(600) union all select id * 2 + 2000, id * 2 + 2002 from range(40)")
    one = {tuple(r) for r in components(links).collect()}
    assert len(made) == 1 and {c for _, c in one} == {0, 2000}
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    assert {tuple(r) for r in components(links).collect()} == one and len(made) > 2
