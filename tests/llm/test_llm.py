import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from structjson.llm import embeddings, html, images, jaccard, mixing, packing, quality, urls, warc  # noqa: E402
from structjson.llm.common import components, fresh_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tok string"


def docs(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), 0, "x") for i, t in texts], DOCS)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 3)]
    root = list(range(200))
    for _ in range(200):
        for a, b in links[:-1]:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root[n] for n in {x for a, b in links[:-1] if a != b for x in (a, b)}}


def test_mixing_uses_every_document_and_bounds_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), None) for i in range(400)]
    d = docs(spark, [(i, t) for i, t, _ in rows] + [(999, None), (1000, "")], lambda i: "big" if i < 300 else None if i % 2 else "small")
    got = mixing.mix(d, max_repeats=2.0, block_docs=50).collect()
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) == set(range(400)) | {999, 1000} and max(times.values()) <= 2
    assert len({r.mix_order for r in got if r.source == "big"}) == sum(t for i, t in times.items() if i < 300)
    tokens = {}
    for r in got:
        tokens[r.source] = tokens.get(r.source, 0) + r.mix_tokens
    weight = {r.source: r.mix_weight for r in got}
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - weight[s]) < 0.03 for s in weight)
    even = mixing.mix(d, target_entropy=0.999, budget=3000, block_docs=50).groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect()
    assert max(r.t for r in even) < 1.2 * min(r.t for r in even)
    assert mixing.mix(d.limit(0), max_repeats=2.0).count() == 0


def test_mixing_is_the_same_with_quotas_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, "a b c" * (1 + i % 3), "big" if i < 300 else f"s{i % 7}" if i < 360 else None) for i in range(380)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"target_entropy": 0.9, "budget": 900, "block_docs": 20}
    broadcast = sorted(mixing.mix(d, **options).collect(), key=str)
    monkeypatch.setattr(mixing, "SMALL_PLAN", 0)
    assert sorted(mixing.mix(d, **options).collect(), key=str) == broadcast
    assert 0 < len(broadcast) < len(rows) * 20


def test_urls(spark):
    rows = [
        (1, "https://A.Example.net/en/5?x=1"), (2, "http://x.net"), (3, "http://net/"), (4, None), (5, "nourl"), (6, "http://q.example.com/de/1"),
        (7, "http://q.org/fr/1"), (8, "http://q.org/fr"), (9, "http://best-casino.io/a/1"), (10, "http://ok.io/b/2"), (10, "http://ok.io/b/2"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, None, rules).collect())
    assert got == [
        (1, "a.example.net", "/en/5", "example.net/en/", "allow"), (2, "x.net", "", None, "allow"), (3, "net", "/", "net/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "q.example.com", "/de/1", "example.com/de/", "block"),
        (7, "q.org", "/fr/1", "org/fr/", "allow"), (8, "q.org", "/fr", None, "allow"), (9, "best-casino.io", "/a/1", None, "allow"),
        (10, "ok.io", "/b/2", None, "allow"), (10, "ok.io", "/b/2", None, "allow"),
    ]


def test_labelled_templates_are_rejected(spark):
    pages = spark.createDataFrame([(i, f"http://h.io/{'bad' if i % 2 else 'good'}/{i}") for i in range(80)], "page_id long, url string")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(80)], "page_id long, bad double")
    got = {r.page_id: (r.verdict, r.template) for r in urls.filter_urls(pages, labels, {}).collect()}
    assert all(got[i] == (("block", "/bad/**") if i % 2 else ("allow", "/good/**")) for i in range(80))


def test_main_text(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1>'
        "<p>One\n two<br>three.<p>Short.<form>Name</form><aside>See also</aside></article><section id=comments><p>I think that it is the best of all.</p></section>"
        "<script>var x='<p>no</p>'</script><footer>(c)</footer>"
    )
    assert html.main_text(page) == "Head & tail\n\nOne two three.\n\nShort."
    plain = "<body><div>Home | <a href=a>News</a></div><p>" + "It was the best of times and it was the worst of times for all of them. " * 3 + "</p><p>Yes.</p><p>" + "And that was the end of it, as he had said to the others in the house. " * 3 + "</p><div><a href=b>Next</a></div>"
    assert "Yes." in html.main_text(plain) and "News" not in html.main_text(plain) and "Next" not in html.main_text(plain)
    assert html.main_text(None) == html.main_text("") == ""
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.n_chars) for r in html.extract_text(pages).collect()} == {(1, len(html.main_text(page))), (2, 0)}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    words = ["the", "River,", "ÉTÉ!!", "x1", "don't", "日本", "<|endoftext|>", "a b", "Σας", " "]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(60))) for i in range(60)} | {100: None, 101: "", 102: "word " * 300}
    got = packing.pack(docs(spark, texts.items()), path, capacity=64).collect()
    tok = Tokenizer.from_file(path)
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == list(range(0, len(ids), 64)) and sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in mine)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 64 * 1.1 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_constraint(rule):
    rng = random.Random(3)
    hist = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 101), 40)}
    bins, seen = {}, {}
    for length, first, n, b, offset in packing.plan_bins(hist, 100, max_docs=5, max_attention=10_000, rule=rule):
        assert first == seen.get(length, 0)
        seen[length] = first + n
        for k in range(b, b + n):
            assert sum(bins.setdefault(k, [])) == offset
            bins[k].append(length)
    assert seen == hist
    assert all(sum(x) <= 100 and len(x) <= 5 and sum(y * y for y in x) <= 10_000 for x in bins.values())


def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices("the of and river house to walk slow tree in".split(), k=60)) for _ in range(120)]
    bad = ["!!! ".join(rng.choices("BUY NOW CHEAP $$$ ###".split(), k=60)) for _ in range(120)]
    d = docs(spark, [*enumerate(good + bad), (900, None), (901, "")], lambda i: None if i % 3 else f"s{i % 5}")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 240, 2)] + [(1, None)], "doc_id long, quality int")
    got = {r.doc_id: r.q_keep for r in quality.score_quality(d, labels).collect()}
    assert len(got) == 242 and sum(got[i] == (i < 120) for i in range(1, 240, 2)) >= 118
    assert quality.drop_low_quality(d, labels).columns == d.columns
    assert quality.score_quality(d, labels.limit(0)).where("q_keep is null").count() == 0


def _linked(sets, least):
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return root


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 150]))] for _ in range(20)]
    texts = {}
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        texts[i] = " ".join(w).upper() if i % 7 == 0 else "\t".join(w)
    texts |= {200: None, 201: "", 202: " \n", 203: "É x", 204: "é x"}
    sets = {}
    for i, t in texts.items():
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in (t or "").split()]
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    want = _linked(sets, 0.85)
    d = docs(spark, texts.items())
    got = {r.doc_id: r for r in jaccard.similar_documents(d, size=4, similarity=0.85).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.r_[a[:280], rng.integers(0, 2**63, 15).astype(np.uint64)])
    size = min(len(jaccard.dense_sketch(a)), len(jaccard.dense_sketch(b)))
    x, y = (jaccard.folded(jaccard.dense_sketch(s), size) for s in (a, b))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    bands = jaccard.Bands(17, 20)
    count, most = bands.count(bands.index(len(b)))
    assert len(np.intersect1d(jaccard.band_keys(a, 3, count, most), jaccard.band_keys(b, 3, count, most))) >= 1
    band = bands.index(280)
    shared = np.intersect1d(jaccard.band_keys(a, band, *bands.count(band)), jaccard.band_keys(b, band, *bands.count(band)))
    assert bands.bound(len(a), len(b)) >= len(np.setxor1d(a, b)) and len(shared) > bands.spare(band) > 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16))
    x = np.r_[x, x[:20] + rng.normal(0, 0.05, (20, 16)), x[:3]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), recall=0.9999).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.9
    assert [got[i].n_links for i in range(len(x))] == (s.sum(1) - 1).tolist()
    sets = {i: i for i in range(len(x))}
    for _ in range(10):
        sets = {i: min(sets[j] for j in np.flatnonzero(s[i])) for i in sets}
    assert {i: got[i].component_id for i in sets} == sets
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "é" * 600), (4, "http://a/4\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    folders = [fresh_path(spark, "warc") for _ in range(2)]
    made = [sorted(map(tuple, warc.write_archive(pages.repartition(3 - k), f, roll_bytes=400, shard_bytes=2000).collect())) for k, f in enumerate(folders)]
    assert made[0] == made[1] and len(made[0]) > 2
    got = {r.page_id: r for r in warc.read_archive(spark, folders[0]).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 7), 2: ("revisit", 7)}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert got[i].payload is None if i in (1, 2) else bytes(got[i].payload) == data
    empty = fresh_path(spark, "warc")
    assert warc.write_archive(pages.limit(0), empty).count() == 0 and warc.read_archive(spark, empty).count() == 0


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    big = [np.kron(rng.integers(0, 255, (12, 12)), np.ones((8, 8))).astype(np.uint8) for _ in range(6)]
    rows = [(i, 96, 96, bytearray(b.tobytes())) for i, b in enumerate(big)]
    crop = np.ascontiguousarray(big[2][8:, 8:])
    rows += [(10, 96, 96, bytearray(np.clip(big[0].astype(int) + 6, 0, 255).astype(np.uint8).tobytes())), (11, 88, 88, bytearray(crop.tobytes())), (12, 96, 96, None), (13, 96, 96, bytearray(96 * 96))]
    got = {r.image_id: r.component_id for r in images.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    assert got == {**{i: i for i in range(6)}, 10: 0, 11: 2, 12: 12, 13: 13}


def test_image_copies_of_one_slot(spark, monkeypatch):
    """Images that share slots with all others, of which only (k, k + 4) are copies."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 256, (8, 10, 16), dtype=np.uint8)
    bits[4:] = bits[:4] ^ (np.arange(16) % 4 == 0).astype(np.uint8)  # a bit of each slice
    bits[:, :2] = bits[0, :2]  # slots that all eight share
    places = [np.c_[rng.uniform(0, 90, (10, 2)), np.ones(10), np.zeros(10)].ravel().tolist() for _ in range(4)]
    rows = [(k, places[k % 4], bits[k].tobytes(), bytes([k])) for k in range(8)]
    made = spark.createDataFrame(rows, "image_id long, places array<float>, bits binary, digest binary")
    monkeypatch.setattr(images, "image_features", lambda *_: made)
    got = {r.image_id: r.component_id for r in images.image_copies(made).collect()}
    assert got == {k: k % 4 for k in range(8)}


def test_equal_images_are_copies(spark):
    small = bytearray(range(81))
    rows = [(1, 9, 9, small), (2, 9, 9, small), (3, 3, 27, small)]
    got = {r.image_id: r.component_id for r in images.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
