import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from structjson.llm import lm  # noqa: E402


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, ids string")


def _loss(flat, levels, ctx, target):
    return -float(lm.log_probabilities(lm.views(flat, levels), lm.paths(levels), ctx, target).sum(dtype=float)) / len(target)


def _random(levels, seed=0):
    rng = np.random.default_rng(seed)
    flat = lm.start(levels, np.ones(lm.SIDE**levels))
    return (flat + rng.normal(0, 0.3, flat.shape)).astype(np.float32)


@pytest.mark.parametrize("levels", [2, 3])
def test_probabilities_add_up_to_one(levels):
    size, flat = lm.SIDE**levels, _random(levels)
    rows = lm.context_rows(size, lm.shared_ids(levels))
    ids = np.array([5, 9, size - 1, 3, 100, 2])
    padded = np.concatenate([[0, 0], rows[ids], [0, 0]])
    ctx = np.repeat(lm.contexts(padded, np.array([4])), size, 1)
    every = lm.log_probabilities(lm.views(flat, levels), lm.paths(levels), ctx, np.arange(size))
    assert abs(np.exp(every).sum() - 1) < 1e-3
    model = lm.Model(levels, [], [], np.zeros(1), flat)
    one = lambda i: lm.log_probabilities(lm.views(flat, levels), lm.paths(levels), lm.contexts(padded, np.array([i + 2])), ids[i : i + 1])[0]
    assert abs(lm.score_ids(model, ids, chunk=4) - sum(float(one(i)) for i in range(len(ids)))) < 1e-3


def test_extreme_logits_stay_finite():
    flat = _random(2)
    lm.views(flat, 2)["nodes"][:, lm.HIDDEN :] = -500
    out = lm.log_probabilities(lm.views(flat, 2), lm.paths(2), np.zeros((4, 3), int), np.array([1, 2, 3]))
    assert np.isfinite(out).all()


def test_a_step_follows_the_gradient():
    """Adagrad's first step is against the gradient of the loss, found by differences, over its root."""
    rng = np.random.default_rng(1)
    levels, n = 2, 40
    flat = _random(levels)
    rows = lm.context_rows(lm.SIDE**levels, lm.shared_ids(levels))
    ids = rng.integers(1, lm.SIDE**levels, n)
    ctx, target = lm.contexts(np.concatenate([[0, 0], rows[ids], [0, 0]]), 2 + np.arange(n)), ids
    new, seen = lm.train(flat, levels, iter([(ctx, target)]), rate=0.1)
    assert seen == n
    moved = np.flatnonzero(new != flat)
    for at in [*rng.choice(moved, 40), *np.argsort(-np.abs(new - flat))[:10]]:
        up, down = flat.copy(), flat.copy()
        up[at] += 0.01
        down[at] -= 0.01
        g = (_loss(up, levels, ctx, target) - _loss(down, levels, ctx, target)) / 0.02
        assert abs((new - flat)[at] + 0.1 * g / np.sqrt(0.1 + g * g)) < 2e-4 + 0.02 * abs((new - flat)[at])
    ctx_table = lm.views(np.where(new != flat, 1, 0), levels)["ctx"].any(1)
    assert set(np.flatnonzero(ctx_table)) == set(ctx.ravel().tolist())


def test_training_sees_every_token_once(spark):
    texts = ["one", "two words", "three words here", " ".join(map(str, range(1000))), None, ""]
    d = docs(spark, list(enumerate(texts)))
    counts = lm.count_words(d)
    model = lm.vocabulary(counts)
    seen = spark.sparkContext.accumulator(0)
    real = lm.train

    def counted(flat, levels, batches, rate=0.1):
        out = real(flat, levels, batches, rate)
        seen.add(out[1])
        return out

    lm.train = counted
    try:
        lm.learned(lm.encoded(d, model, counts), model)
    finally:
        lm.train = real
    assert seen.value == sum(len((t or "").split()) for t in texts)


def test_learns_and_scores_every_row(spark):
    text = "the cat sat on a mat and then "
    mixed = " ".join(random.Random(1).sample((text * 60).split(), 480))
    rows = [(i, text * 60) for i in range(20)] + [(50, None), (51, " "), (52, mixed), (52, mixed), (None, "never seen")]
    out = lm.fit_and_score(docs(spark, rows), batch=64).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[0].n_tokens == 480
    assert got[0].mean_pll > got[52].mean_pll + 0.5
    assert got[50].pll == got[51].pll == 0 and got[50].mean_pll is None and np.isfinite(got[None].pll)
    assert lm.fit_and_score(docs(spark, rows).limit(0)).count() == 0
    model, counts = lm.fit(docs(spark, rows[:20]), batch=64)
    long = lm.score(docs(spark, [(1, text * 20_000)]), model, counts).first()
    assert long.n_tokens == 160_000 and abs(long.mean_pll - lm.score(docs(spark, rows[:1]), model, counts).first().mean_pll) < 0.05


@pytest.mark.parametrize("head", [0, 1, 1000])
def test_words_of_one_id_are_told_apart(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    shared = lm.shared_ids(2)
    bucket = lambda w: zlib.crc32(w.encode()) % shared
    once = next(f"x{i}" for i in range(10**5) if bucket(f"x{i}") == bucket("rare"))
    common = [f"w{i}" for i in range(lm.SIDE**2 - shared - 1)]
    d = docs(spark, [(1, " ".join(common * 5)), (2, f"rare rare rare {once}")])
    model, counts = lm.fit(d)
    assert model.levels == 2 and len(model.words) == len(common)
    alone = lm.score_ids(model, np.array([1 + bucket("rare")]))
    got = {r.doc_id: r.pll for r in lm.score(docs(spark, [(1, "rare"), (2, once)]), model, counts).collect()}
    assert abs(got[1] - alone - np.log(3 / 4)) < 1e-4 and abs(got[2] - alone - np.log(1 / 4)) < 1e-4


def test_vocabulary_grows_with_the_corpus(spark):
    words = spark.range(6000).selectExpr("concat('w', id) as word", "25 + id as n")
    model = lm.vocabulary(words)
    assert model.levels == 3 and len(model.words) == 4096 - 256
    assert model.words[0] == "w5999" and len(model.head) == 6000 - len(model.words)
    assert model.shared_total.sum() == sum(n for _, n in model.head)
    assert lm.vocabulary(words.limit(100)).levels == 2
    assert lm._least_count(words, 10**9) == 25 and 25 < lm._least_count(words, 3000) < 6025


def test_sums_by_row_cover_the_table():
    """Rows that occur nowhere get 0, so a step takes the whole table and nothing is sorted."""
    rng = np.random.default_rng(3)
    index, values = rng.integers(0, 40, 500), rng.normal(size=(500, 5)).astype(np.float32)
    got = lm._add_up(index, values, 50)
    want = np.array([values[index == k].astype(float).sum(0) for k in range(50)])
    assert got.dtype == np.float32 and got.shape == (50, 5) and np.allclose(got, want, atol=1e-5) and not got[40:].any()
