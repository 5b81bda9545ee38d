import random

import pytest

pytest.importorskip("public_tokenizers")
from structjson.llm import packing  # noqa: E402


def _one_by_one(histogram, capacity, max_docs):
    """Best-fit decreasing, item by item: each goes to the bin that it leaves the least room in."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [b for b in bins if b[0] >= length and b[1] >= 1]
            if not fits:
                bins.append(fits_new := [capacity, max_docs])
                fits = [fits_new]
            best = min(fits, key=lambda b: b[0])
            best[0] -= length
            best[1] -= 1
    return len(bins)


def _bins(histogram, capacity, **options):
    runs = packing.plan_bins(histogram, capacity, **options)
    return len({b for _, _, n, first, _ in runs for b in range(first, first + n)})


def test_equal_items_fill_bins():
    assert _bins({100: 1000}, 2048) == 50 and _bins({1: 5000}, 2048) == 3 and _bins({2048: 7, 1: 1}, 2048) == 8
    assert _bins({100: 1000}, 2048, max_docs=4) == 250 and _bins({100: 1000}, 2048, max_attention=50_000) == 200


@pytest.mark.parametrize("seed", range(12))
def test_as_few_bins_as_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 128, 2048])
    histogram = {n: rng.randrange(1, 60) for n in rng.sample(range(1, capacity + 1), rng.choice([3, 10, 40]))}
    if seed % 3 == 0:
        histogram = {n: c for n, c in histogram.items() if n <= capacity // 3} or {1: 9}
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    assert least <= _bins(histogram, capacity) <= max(least, round(1.02 * _one_by_one(histogram, capacity, capacity)))


def test_chunks_have_the_tokenizer_s_ids():
    """Whichever way they are learned; every letter of Latin-1 occurs in words that skip the normaliser."""
    from structjson.llm.queries import tokenizer_path

    rng = random.Random(5)
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(2000)] + letters
    odd = ["été", "İ", "Ǆx", "Σσ", "a\xa0b", "a\x0bb", "a B", "it's", "x1y", "...", "漢字", "한글,", "ﬁn"]
    ids = packing.ChunkIds(tokenizer_path())
    own = lambda text: ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.word_ids([w.lower() for w in words]).tolist() == own(" ".join(words))
    for chunks in (words, [w + rng.choice("., !?)").strip() for w in words] + odd):
        ids.learn({c for c in chunks if c not in ids})
        assert all(ids[c] == b"".join(i.to_bytes(4, "little") for i in own(c)) for c in chunks)
    assert packing.split_chunks(" a\t\r\nb\xa0c  d\x0be\n") == ["a", "b\xa0c", "d\x0be"] and packing.split_chunks("\n ") == []
