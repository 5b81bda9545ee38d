import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from structjson.llm import images  # noqa: E402


def _components(n, links):
    root = np.arange(n)
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root[root == y] = x
    return root


def _same(root):
    return (root[:, None] == root[None])[np.triu_indices(len(root), 1)]


def _rendered(vectors, side=64):
    grid = (vectors / np.sqrt((vectors**2).mean(1, keepdims=True))).reshape(-1, 8, 8).astype(np.float32)
    return np.rint(127.5 + 120 * np.tanh(1.5 * images._resize(grid, side / 8))).astype(np.uint8)


def test_candidates_cover_what_consensus_links():
    """Of the pairs that all-pairs consensus joins, directly or through others, nine tenths are found, and no other."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(24, 64)), 6, 0)
    x[np.arange(len(x)) % 6 > 0] += rng.normal(0, 0.25, (len(x) - 24, 64))
    rows = [(i, *d) for i, d in enumerate(images.describe(_rendered(x)))]
    met = [(i, j, *images.consensus(rows[i][1:], rows[j][1:])) for i in range(len(rows)) for j in range(i)]
    want = _same(_components(len(rows), [(i, j) for i, j, m, e in met if e >= 6 and e >= 0.5 * m]))
    one = list(images._copies(rows, None, 14, 6, 0.5))
    a, b = rows[:70], rows[70:]
    two = [*images._copies(a, None, 14, 6, 0.5), *images._copies(b, None, 14, 6, 0.5), *images._copies(a, b, 14, 6, 0.5)]
    for links in (one, two):
        got = _same(_components(len(rows), links))
        assert (want & got).sum() >= 0.9 * want.sum() and not (got & ~want).any()


@pytest.mark.parametrize("cut", [None, 5])
def test_slots_meet_like_brute_force(cut):
    rng = np.random.default_rng(6)
    n, c = 12, 9
    bits = rng.integers(0, 256, (n, c, 16), dtype=np.uint8)
    bits[6:] = bits[:6] ^ (rng.random((6, c, 16)) < 0.1).astype(np.uint8)
    places = [np.c_[rng.uniform(0, 60, (c, 2)), np.ones(c), rng.uniform(-3, 3, c)].astype(np.float32) for _ in range(6)] * 2
    lying = images._neighbours(places)
    words, _ = images._padded(list(bits))
    side = None if cut is None else (np.arange(n) >= cut).astype(int)
    group = np.arange(n) // 2
    got = {
        divmod(int(c), n) for k in range(images.SLICES)
        for codes in images._meetings(lying, images._pieces(words, k), group, side, words, 12, False) for c in codes
    }
    near = lambda x, y, p, q: np.bitwise_count(bits[x, p] ^ bits[y, q]).sum() <= 12
    flat = np.unpackbits(bits, axis=2)
    cut = lambda x, p, k: tuple(flat[x, p, k * images.SLICE : (k + 1) * images.SLICE])
    rows = [(x, p, r, lies, [(cut(x, p, k), cut(x, r, k)) for k in range(images.SLICES)]) for x, p, r, lies in zip(*(c.tolist() for c in lying))]
    want = {
        (x, y) for x, p, r, s, one in rows for y, q, u, t, two in rows
        if s == t and x < y and any(i == j for i, j in zip(one, two))
        and group[x] != group[y] and (side is None or side[x] != side[y]) and near(x, y, p, q) and near(x, y, r, u)
    }
    assert got == want and want


def test_images_in_odd_states(spark):
    small = bytearray(range(81))
    rows = [(1, 9, 9, small, "x"), (1, 9, 9, small, "y"), (None, 9, 9, small, "z"), (4, 9, 9, None, None), (5, None, 9, small, ""), (6, 0, 0, bytearray(), "e")]
    d = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, component_id string")
    got = sorted(((r.image_id or 0, r.n_corners, r.component_id) for r in images.image_copies(d).collect()), key=str)
    assert got == sorted([(0, 0, None), (1, 0, 1), (1, 0, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6)], key=str)
    assert images.image_copies(d.limit(0)).count() == 0


def test_matches_are_mutual_nearest_corners():
    """As corner by corner: ties go to the first corner, corners that an image lacks match nothing."""
    rng = np.random.default_rng(8)
    bits = [rng.integers(0, 4, (c, 16), dtype=np.uint8) * 85 for c in (9, 4, 7, 9, 2, 9)]
    bits[3] = bits[0][::-1] ^ (rng.random((9, 16)) < 0.1).astype(np.uint8)
    words, lacks = images._padded(bits)
    u, v = np.triu_indices(len(bits), 1)
    to, good = images._matches(words, lacks, u, v, 20)
    seen = 0
    for k, (x, y) in enumerate(zip(u, v)):
        d = np.bitwise_count(bits[x][:, None] ^ bits[y][None]).astype(int).sum(2)
        j = d.argmin(1)
        want = {(i, j[i]) for i in range(len(d)) if d[i, j[i]] <= 20 and d.argmin(0)[j[i]] == i}
        assert {(i, to[i, k]) for i in np.flatnonzero(good[:, k])} == want
        seen += len(want)
    assert seen


def _noisy(groups, seed, noise):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, 64)), 6, 0)
    x[np.arange(len(x)) % 6 > 0] += rng.normal(0, noise, (len(x) - groups, 64))
    return _rendered(x)


def test_components_do_not_depend_on_blocks(spark):
    """Nor on the order of the rows: as when one task compares all images by id."""
    rows = [(k, 64, 64, bytearray(x.tobytes())) for k, x in enumerate(_noisy(20, 11, 0.4))]
    all_of = [(k, *d) for k, d in enumerate(images.describe(_noisy(20, 11, 0.4)))]
    want = _components(len(rows), images._copies(all_of, None, 14, 6, 0.5))
    d = spark.createDataFrame(rows[::-1], "image_id long, width int, height int, pixels binary")
    for block in (6, 16, 8192):
        got = {r.image_id: r.component_id for r in images.image_copies(d, block=block).collect()}
        assert [got[k] for k in range(len(rows))] == want.tolist()
    assert len(set(want.tolist())) < len(rows)


def test_images_of_one_block_do_not_meet_again(monkeypatch):
    """What two blocks compare follows the images, however alike those of each block are."""
    rng = np.random.default_rng(3)
    places = np.c_[rng.uniform(0, 60, (9, 2)), np.ones(9), rng.uniform(-3, 3, 9)].astype(np.float32)
    one, two = rng.integers(0, 256, (2, 9, 16), dtype=np.uint8)
    a, b = [(0, places, one)], [(k, places, two) for k in range(1, 300)]
    rows = 300 * len(images._neighbours([places])[0])
    made, repeat = [0], np.repeat

    def counted(*args, **kwargs):
        out = repeat(*args, **kwargs)
        made[0] += np.size(out)
        return out

    monkeypatch.setattr(np, "repeat", counted)
    found = list(images._copies(a, b, 14, 6, 0.5))
    assert not any(0 in pair for pair in found)
    assert made[0] < 20 * images.SLICES * rows


@pytest.mark.parametrize("order", [2, 3, 5])
def test_two_points_are_on_one_line(spark, order):
    points = spark.range(order * order)
    rows = points.select("id", images.F.explode(images._lines(order, images.F.col("id"))).alias("at")).select("id", "at.*").collect()
    assert sorted({r.line for r in rows}) == list(range(order * (order + 1)))
    met = [(a.id, b.id) for a in rows for b in rows if a.line == b.line and (a.id < b.id or a.id == b.id and a.own < 0)]
    assert len(met) == len(set(met)) == order**2 * (order**2 + 1) // 2
    assert all(r.own in (r.id, -1) for r in rows)


def test_tasks_hold_about_two_blocks():
    assert [images._order(n, 8192) for n in (0, 1, 10_256, 51_282, 100_000, 1_000_000)] == [2, 2, 2, 3, 7, 61]
