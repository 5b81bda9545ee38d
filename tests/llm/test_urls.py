import math
import random
import re

import pytest

pytest.importorskip("public_tokenizers")
from structjson.llm import common, urls  # noqa: E402


def _shape(path):
    out = re.sub(r"(?<=/)[0-9a-f]{8}-[0-9a-f-]{27}(?=[/.]|$)", "{uuid}", path)
    out = re.sub(r"(?<=/)(?=[a-z]*[0-9])[0-9a-f]{12,}(?=[/.]|$)", "{hex}", out)
    return re.sub(r"[0-9]+", "{n}", out)


def _brute(rows, labels, max_children=24, z=2.58, prior=12.0, reject_from=0.6, base_rate=0.1):
    """``id: (template, purity, verdict)``, node by node."""
    of = {}
    for i, b in labels:
        of.setdefault(i, []).append(b)
    of = {i: sum(b) / len(b) for i, b in of.items()}
    shapes = {}
    for i, host, path in rows:
        s = shapes.setdefault((host, _shape(path)), [0.0, 0])
        if i in of:
            s[0], s[1] = s[0] + of[i], s[1] + 1
    out = {}

    def cut(host, template, members, level):
        nb, nl = (sum(shapes[host, s][k] for s in members) for k in (0, 1))
        if not (1e-9 < nb < nl - 1e-9 and len(members) > 1):
            for s in members:
                out[host, s] = template if len(s.split("/")) <= level else template + "/**"
            return
        below = {}
        for s in members:
            parts = s.split("/")
            if len(parts) <= level:
                out[host, s] = template
            else:
                below.setdefault(parts[level], []).append(s)
        told = {}
        for seg, inner in below.items():
            cb, cl = (sum(shapes[host, s][k] for s in inner) for k in (0, 1))
            rn, rb, at = nl - cl, nb - cb, -1
            if cl and rn:
                se = math.sqrt(max(nb / nl * (1 - nb / nl), 1e-4) * (1 / cl + 1 / rn))
                if abs(cb / cl - rb / rn) > z * se:
                    at = min(7, int(math.asin(math.sqrt(cb / cl)) / (math.pi / 2) * 8))
            told.setdefault(at, []).append(seg)
        for at, segs in told.items():
            name = segs[0] if len(segs) == 1 else "(" + "|".join(sorted(segs)) + ")" if len(segs) <= max_children else "*" if at < 0 else f"*~{at}"
            cut(host, f"{template}/{name}", [s for g in segs for s in below[g]], level + 1)

    for host in {h for h, _ in shapes}:
        cut(host, "", [s for h, s in shapes if h == host], 1)
    overall = (sum(x[0] for x in shapes.values()) + base_rate * prior) / (sum(x[1] for x in shapes.values()) + prior)
    result = {}
    for i, host, path in rows:
        mine = out[host, _shape(path)]
        sums = lambda keep: [sum(x[k] for (h, s), x in shapes.items() if h == host and keep(h, s)) for k in (0, 1)]
        hb, hl = sums(lambda h, s: True)
        rate = (hb + prior * overall) / (hl + prior)
        tb, tl = sums(lambda h, s: out[h, s] == mine)
        purity = (tb + prior * rate) / (tl + prior)
        result[i] = (mine, round(purity, 9), "block" if host and purity >= reject_from else "allow")
    return result


def test_tree_equals_brute_force(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        host = rng.choice(["a.io", "a.io", "b.io", "c.io"])
        section = rng.choice(["news", "shop", "forum", f"s{rng.choice('abcdefghijklmnopqrstuvwxyz')}x"])
        path = f"/{section}/{rng.choice(['x', 'y', 'deep/er'])}/{rng.choice(['p', 'q'])}/{i}" if section != "forum" else f"/2024/05/en/{rng.choice(['win', 'talk'])}/{i}.html"
        rows.append((i, host, path))
        if rng.random() < 0.6:
            worse = (host == "a.io" and section == "shop") or "/win/" in path or (host == "b.io" and "/q/" in path)
            labels.append((i, float(rng.random() < (0.95 if worse else 0.05))))
    labels += [(3, 1.0), (3, 0.0), (None, 1.0), (7, None)]
    pages = spark.createDataFrame([(i, f"http://{h}{p}?x=/1", "t", 0.5) for i, h, p in rows], "page_id long, url string, template string, purity double")
    known = spark.createDataFrame(labels, "page_id long, bad double")
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in urls.filter_urls(pages, known, {}).collect()}
    want = _brute(rows, [x for x in labels if x[0] is not None and x[1] is not None])
    assert got == want
    assert {v for _, _, v in got.values()} == {"block", "allow"} and len({t for t, _, _ in got.values()}) > 8
    assert any("win" in t for t, _, v in got.values() if v == "block")  # the fourth segment decides


def test_odd_urls(spark):
    long = "http://long.io/" + "/".join(["seg"] * 300) + "/" + "x" * 50_000
    rows = [(1, long), (None, "http://n.io/1"), (3, None), (3, ""), (4, "http://"), (5, "://x/y"), (6, "HTTP://[::1]:80/ü?"), (1, long)]
    pages = spark.createDataFrame([(i, u, "h", "s", 1) for i, u in rows], "page_id long, url string, host string, shape string, n int")
    got = urls.filter_urls(pages, pages.selectExpr("page_id", "1.0 as bad"), {"x/y": "block"}).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id == 5] == [("x", "/y", "x/y", "block")]
    assert {(r.host, r.path, r.verdict) for r in got if r.page_id in (3, 4)} == {("", "", "allow")}
    assert urls.filter_urls(pages.limit(0), pages.selectExpr("page_id", "1.0 as bad"), {}).count() == 0


def test_hot_keys_join_like_others(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "i long, k string")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.spread_join(left, right, ["k"], "n", left.i, rows=7)
    assert sorted((r.i, r.k, r.n) for r in got.collect()) == sorted((r.i, r.k, r.n) for r in left.join(right, "k").collect())
