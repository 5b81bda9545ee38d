"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts each token from the ``WINDOW`` tokens on both of its sides: a
table of hidden contributions for each place of the window, tanh, and a softmax along
a tree of classes. A word's id spells its path: digits of base ``SIDE``, most frequent
words first, so a level's softmax has ``SIDE`` ways. What leads to a node gates the
hidden units before that node's softmax. Vocabulary counts run over the whole corpus.

Training is parallel: every partition trains a copy on its own text in numpy, and the
copies are averaged, weighted by what they saw. So the model depends on how the
documents are split, within what such copies differ by.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

WINDOW = 2
SIDE = 16
#: Levels of the tree: as many as the frequent words need, within these.
LEVELS = (2, 3)
#: A word that occurs less often shares an id with others, by hash.
FREQUENT = 20
HIDDEN = 16
#: Words with a row of their own as a context; others share the same number of rows by hash.
CONTEXTS = 2048
PAD = 0
#: Words whose counts every task holds beside the vocabulary's; those of others are joined.
HEAD = 200_000
_ONES = np.ones(SIDE, np.float32)


@dataclass
class Model:
    """What :func:`fit` learns: words by rank, the share of each shared id's tokens, parameters."""

    levels: int
    words: list[str]
    head: list[tuple[str, int]]
    shared_total: np.ndarray  # tokens of each shared id
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @property
    def size(self) -> int:
        return SIDE**self.levels

    @property
    def shared(self) -> int:
        """Ids 1 and up that words share by hash; id 0 is the padding."""
        return shared_ids(self.levels)


def shared_ids(levels: int) -> int:
    return SIDE**levels // 16 - 1


def shapes(levels: int) -> dict[str, tuple[int, ...]]:
    """``nodes`` has a row for each inner node of the tree, by level: its gates, then its biases."""
    return {
        "ctx": (2 * WINDOW * 2 * CONTEXTS, HIDDEN), "b": (HIDDEN,), "w": (levels, HIDDEN, SIDE),
        "nodes": (sum(SIDE**k for k in range(levels)), HIDDEN + SIDE),
    }


def views(flat: np.ndarray, levels: int) -> dict[str, np.ndarray]:
    """Named parts of a flat parameter vector."""
    out, at = {}, 0
    for name, shape in shapes(levels).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(levels: int, frequency: np.ndarray, seed: int = 0) -> np.ndarray:
    """Small random parameters; the biases start at the frequencies of ids."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes(levels).values()), np.float32)
    p = views(flat, levels)
    p["ctx"][...] = rng.normal(0, 0.1, p["ctx"].shape)
    p["w"][...] = rng.normal(0, 0.1, p["w"].shape)
    p["nodes"][:, :HIDDEN] = rng.normal(1, 0.1, (len(p["nodes"]), HIDDEN))
    at = 0
    for k in range(levels):
        f = frequency.reshape(SIDE**k, SIDE, -1).sum(2)
        p["nodes"][at : at + SIDE**k, HIDDEN:] = np.log(f / f.sum(1, keepdims=True))
        at += SIDE**k
    return flat


def paths(levels: int) -> tuple[np.ndarray, np.ndarray]:
    """By level and id, the node on its way and which of the node's ways it takes."""
    ids = np.arange(SIDE**levels)
    nodes, ways, at = [], [], 0
    for k in range(levels):
        nodes.append(at + ids // SIDE ** (levels - k))
        ways.append(ids // SIDE ** (levels - k - 1) % SIDE)
        at += SIDE**k
    return np.array(nodes), np.array(ways)


class Ids(dict):
    """Ids of words: the vocabulary's, else one shared by hash. Remembers words for speed."""

    def __init__(self, words: list[str], levels: int):
        self.shared = shared_ids(levels)
        super().__init__((w, self.shared + 1 + k) for k, w in enumerate(words))

    def __missing__(self, word: str) -> int:
        return 1 + zlib.crc32(word.encode()) % self.shared


def context_rows(size: int, shared: int) -> np.ndarray:
    """The row of the context tables by id: the padding's, frequent words' own, and rows shared by hash."""
    ids = np.arange(size)
    rank = ids - shared - 1
    own = (rank >= 0) & (rank < CONTEXTS - 1)
    rows = np.where(own, 1 + rank, CONTEXTS + (ids * 40503 >> 4) % CONTEXTS)
    rows[PAD] = 0
    return rows


_SHIFTS = [k for k in range(-WINDOW, WINDOW + 1) if k]
_END = b"\0\0" * WINDOW


def contexts(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Context rows of the neighbours of the places ``at``, by place of the window; ``rows`` has padding around texts."""
    return np.stack([rows.take(at + k) + 2 * CONTEXTS * i for i, k in enumerate(_SHIFTS)])


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts with padding around each, and by id its text and its place in it.

    Each of ``texts`` ends with its padding.
    """
    sizes = np.array([len(x.as_buffer()) // 2 for x in texts], np.int64)
    ids = np.frombuffer(b"".join([_END, *(x.as_py() for x in texts)]), np.uint16).astype(np.int64)
    start = WINDOW + np.cumsum(sizes) - sizes
    whose = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(WINDOW, len(ids)) - np.repeat(start, sizes)
    return ids, np.concatenate([np.zeros(WINDOW, np.int64), whose]), np.concatenate([np.zeros(WINDOW, np.int64), place])


def _hidden(p: dict, ctx: np.ndarray) -> np.ndarray:
    h = p["ctx"].take(ctx[0], 0)
    for c in ctx[1:]:
        h += p["ctx"].take(c, 0)
    h += p["b"]
    return np.tanh(h, out=h)


def _ways(p: dict, h: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By level and place: below the root the node's row, the gated hidden units, and the logits of its ways."""
    of, root = p["nodes"].take(node[1:], 0), p["nodes"][0]
    gated = np.empty((len(node), *h.shape), h.dtype)
    np.multiply(h, root[:HIDDEN], out=gated[0])
    np.multiply(h, of[:, :, :HIDDEN], out=gated[1:])
    z = np.matmul(gated, p["w"])
    z[0] += root[HIDDEN:]
    z[1:] += of[:, :, HIDDEN:]
    return of, gated, np.minimum(z, 80, out=z)


def log_probabilities(p: dict, tree: tuple[np.ndarray, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log probability of each target id in its context."""
    _, _, z = _ways(p, _hidden(p, ctx), tree[0].take(target, 1))
    taken = z.reshape(-1).take(tree[1].take(target, 1) + np.arange(0, z.size, SIDE).reshape(z.shape[:2]))
    total = np.exp(z) @ _ONES
    if not total.min() > 1e-30:  # all ways of a node are far below zero
        most = z.max(2)
        return (taken - most - np.log(np.exp(z - most[:, :, None]) @ _ONES)).sum(0)
    return (taken - np.log(total)).sum(0)


def _add_up(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """For each of ``rows`` numbers, the sum of the rows of ``values`` whose ``index`` it is."""
    times = values.shape[1]
    cells = index[:, None] * times + np.arange(times)
    return np.bincount(cells.ravel(), values.ravel(), rows * times).astype(np.float32).reshape(rows, times)


def train(flat: np.ndarray, levels: int, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.1) -> tuple[np.ndarray, int]:
    """Adagrad over ``(contexts, targets)``; the new parameters and how many targets they saw."""
    flat = flat.copy()
    p, seen, tree = views(flat, levels), 0, paths(levels)
    square = views(np.full(len(flat), 0.1, np.float32), levels)

    def step(name: str, g: np.ndarray, at: slice = slice(None)) -> None:
        s = square[name][at]
        s += g * g
        g *= rate
        g /= np.sqrt(s)
        p[name][at] -= g

    for ctx, target in batches:
        n = len(target)
        h = _hidden(p, ctx)
        node, way = tree[0].take(target, 1), tree[1].take(target, 1)
        of, gated, z = _ways(p, h, node)
        np.exp(z, out=z)
        z /= (np.maximum(z @ _ONES, 1e-30) * np.float32(n))[:, :, None]
        z.reshape(-1)[np.arange(0, z.size, SIDE) + way.ravel()] -= np.float32(1 / n)
        back = np.matmul(z, p["w"].transpose(0, 2, 1))
        dh = back[0] * p["nodes"][0, :HIDDEN]
        for of_level, back_level in zip(of, back[1:]):
            dh += back_level * of_level[:, :HIDDEN]
        both = np.empty((levels, n, HIDDEN + SIDE), z.dtype)
        np.multiply(back, h, out=both[:, :, :HIDDEN])
        both[:, :, HIDDEN:] = z
        step("w", np.matmul(gated.transpose(0, 2, 1), z))
        step("nodes", np.ones((1, n), z.dtype) @ both[0], slice(0, 1))
        member = (node[1] == np.arange(1, 1 + SIDE)[:, None]).astype(np.float32)
        step("nodes", member @ both[1], slice(1, 1 + SIDE))
        if levels > 2:
            low = 1 + SIDE
            step("nodes", _add_up(node[2:].ravel() - low, both[2:].reshape(-1, HIDDEN + SIDE), len(p["nodes"]) - low), slice(low, None))
        dh *= 1 - h * h
        step("b", dh.sum(0))
        dh = dh.astype(np.float64)
        for low, c in zip(range(0, len(p["ctx"]), 2 * CONTEXTS), ctx):  # rows that occur nowhere get 0
            step("ctx", _add_up(c - low, dh, 2 * CONTEXTS), slice(low, low + 2 * CONTEXTS))
        seen += n
    return flat, seen


def score_ids(model: Model, ids: np.ndarray, chunk: int = 1024) -> float:
    """Summed log probability of every id of a text given both of its sides."""
    texts = pa.array([np.asarray(ids, np.uint16).tobytes() + _END], pa.binary())
    return float(_sums(model, paths(model.levels), context_rows(model.size, model.shared), texts, chunk)[0])


def _sums(model: Model, tree: tuple, rows_of: np.ndarray, texts: pa.Array, chunk: int = 1024) -> np.ndarray:
    """The summed log probability of each text's ids."""
    p, out = views(model.flat, model.levels), np.zeros(len(texts))
    ids, whose, _ = laid_out(texts)
    rows, places = rows_of.take(ids), np.flatnonzero(ids)
    for at in range(0, len(places), chunk):
        some = places[at : at + chunk]
        out += np.bincount(whose.take(some), log_probabilities(p, tree, contexts(rows, some), ids.take(some)), len(out))
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts; a partition adds up its words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update((text or "").split())
                if len(count) > 300_000:
                    yield flush()
                    count.clear()
        yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, words: int) -> int:
    """The least count at which there are no more than ``words`` words, to a sixteenth of a doubling."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    left, least = words, 2**62
    for r in sorted(counts.groupBy(step).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect(), reverse=True):  # a row for each step
        if r.k > left:
            break
        left, least = left - r.k, r.least
    return least


def vocabulary(counts: DataFrame, most_levels: int = LEVELS[1]) -> Model:
    """A model without parameters: the words with ids of their own, and the counts of ids."""
    frequent = counts.where(F.col("n") >= FREQUENT).count()
    levels = LEVELS[0]
    while levels < most_levels and SIDE**levels - shared_ids(levels) - 1 < frequent:
        levels += 1
    shared = shared_ids(levels)
    own = SIDE**levels - shared - 1
    found = counts.where(F.col("n") >= _least_count(counts, own + HEAD)).select("word", "n").toArrow()
    top = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    words, head = [w for w, _ in top[:own]], top[own:]
    total = np.zeros(shared + 1)
    bucket = (F.crc32(F.col("word").cast("binary")) % shared + 1).cast("int").alias("id")
    for i, n in counts.groupBy(bucket).agg(F.sum("n")).collect():  # a row for each shared id
        total[i] = n
    for word, n in top[:own]:
        total[1 + zlib.crc32(word.encode()) % shared] -= n
    frequency = np.full(SIDE**levels, 0.01)
    frequency[: shared + 1] += total
    frequency[shared + 1 : shared + 1 + len(words)] += [n for _, n in top[:own]]
    return Model(levels, words, head, total, start(levels, frequency))


def encoded(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``row, doc_id, n, ids, share`` of every row of ``docs``, as a written table.

    ``ids`` are unsigned 16-bit and end with padding; ``share`` sums the logs of words' shares of the ids
    that they have in common with others, by their counts in the corpus, one at least.
    """
    levels, words, head_words = model.levels, model.words, [w for w, _ in model.head]
    shared = model.shared
    log_total = np.log(np.maximum(model.shared_total, 1))
    head_ids = np.array([1 + zlib.crc32(w.encode()) % shared for w in head_words], np.int64)
    head_log = np.log([n for _, n in model.head]) - log_total[head_ids] if head_words else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SIDE**levels
        # Places: ids, then the head's words, and below zero what is in neither.
        places = _Places(Ids(words, levels), shared)
        places.update((w, size + k) for k, w in enumerate(head_words))
        id_at = np.concatenate([np.arange(shared, 0, -1), np.arange(size), head_ids]).astype(np.uint16)
        log_at = np.concatenate([-log_total[shared:0:-1], np.zeros(size), head_log])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, ids, share, tails = [], [], [], []
                for text in part.column(1):
                    tokens = (text.as_py() or "").split()
                    t = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens)) + shared
                    n.append(len(t))
                    ids.append(id_at[t].tobytes() + _END)
                    share.append(float(log_at[t].sum()))
                    tails.append([tokens[k] for k in np.flatnonzero(t < shared)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(share, pa.float64()), pa.array(tails, pa.list_(pa.string()))],
                    ["doc_id", "n", "ids", "share", "tail"],
                )

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, ids binary, share double, tail array<string>"
    )
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "encoded")
    # Words that occur once, or never, have a logarithm of 0.
    more = (
        made.select("row", F.explode("tail").alias("word")).join(counts.where("n > 1"), "word")
        .groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    )
    # Grouped once more, rows are known to be unique, so Catalyst leaves the join out where the share is not read.
    more = written(more, "shares").groupBy("row").agg(F.sum("more").alias("more"))
    return made.drop("tail").join(more, "row", "left").withColumn("share", F.col("share") + F.coalesce("more", F.lit(0.0))).drop("more")


class _Places(dict):
    """Places of words: a vocabulary or head word's, else minus the id shared by hash."""

    def __init__(self, ids: Ids, shared: int):
        super().__init__(ids)
        self.shared = shared

    def __missing__(self, word: str) -> int:
        n = -1 - zlib.crc32(word.encode()) % self.shared
        if len(self) < 700_000:
            self[word] = n
        return n


def learned(texts: DataFrame, model: Model, stride: int = 2, batch: int = 4096) -> Model:
    """``model`` with parameters trained on ``texts(ids)``: every token is a target once.

    Round ``k`` of ``stride`` trains on the places ``k, k + stride, ...`` of every text
    and averages the copies. Slices of them are added up in two steps, each of about
    the square root of their number, and the driver gets one copy.
    """
    flat, levels, rows_of = model.flat, model.levels, context_rows(model.size, model.shared)
    parts = 16
    for k in range(stride):

        def run(batches: Iterator[pa.RecordBatch], flat=flat, k=k) -> Iterator[pa.RecordBatch]:
            def windows():
                for record in batches:
                    for first in range(0, record.num_rows, 1000):
                        ids, _, place = laid_out(record.column(0).slice(first, 1000))
                        rows, places = rows_of.take(ids), np.flatnonzero((ids > 0) & (place % stride == k))
                        for at in range(0, len(places), batch):
                            some = places[at : at + batch]
                            yield contexts(rows, some), ids.take(some)

            new, seen = train(flat, levels, windows())
            if seen:
                cut = np.array_split(new * np.float32(seen), parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(parts), pa.int32()), pa.array([x.tolist() for x in cut], pa.list_(pa.float32())), pa.array([seen] * parts, pa.int64())],
                    ["part", "v", "seen"],
                )

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(pdf.v.iloc[0]))
            for v in pdf.v:
                total += v
            return pd.DataFrame({"part": [pdf.part.iloc[0]], "v": [total.astype(np.float32)], "seen": [pdf.seen.sum()]})

        schema = "part int, v array<float>, seen long"
        copies = written(texts.select("ids").mapInArrow(run, schema), "copies")
        salts = math.isqrt(copies.where("part = 0").count()) + 1
        salted = copies.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts))).groupBy("part", "salt").applyInPandas(lambda pdf: add(pdf), schema)
        sums = salted.groupBy("part").applyInPandas(lambda pdf: add(pdf), schema).collect()
        drop_written(copies)
        if sums:
            flat = np.concatenate([np.asarray(r["v"], np.float64) / r["seen"] for r in sorted(sums, key=lambda r: r["part"])]).astype(np.float32)
    return Model(model.levels, model.words, model.head, model.shared_total, flat)


def fit(docs: DataFrame, **options) -> tuple[Model, DataFrame]:
    """A model of all texts of ``docs`` and the counts ``word, n`` of all words."""
    counts = written(count_words(docs), "counts")
    model = vocabulary(counts)
    return learned(encoded(docs, model, counts), model, **options), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, pll, mean_pll`` of every row; tokens are runs of non-white-space.

    ``pll`` sums over all tokens of the whole text. A word that shares its id has
    the probability of the id times the word's share of that id's tokens in
    ``counts``, at least one of them. Null, empty or blank text has
    no tokens, a ``pll`` of 0 and a null mean. Ids may be null or repeat; other
    columns are left out; an empty table gives no rows.
    """
    return _scored(encoded(docs, model, counts), model)


def fit_and_score(docs: DataFrame, **options) -> DataFrame:
    """:func:`score` of ``docs`` under a model of themselves; texts are encoded once."""
    counts = written(count_words(docs), "counts")
    model = vocabulary(counts)
    texts = encoded(docs, model, counts)
    return _scored(texts, learned(texts, model, **options))


def _scored(texts: DataFrame, model: Model) -> DataFrame:
    """Scores of texts where they lie; only their sums meet the shares, so ids are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows_of = paths(model.levels), context_rows(model.size, model.shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sums = pa.array(_sums(model, tree, rows_of, part.column(3)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sums], ["row", "doc_id", "n_tokens", "sums"])

    scored = texts.select("row", "doc_id", "n", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, sums double")
    pll = (F.col("sums") + F.col("share")).alias("pll")
    scored = scored.join(texts.select("row", "share"), "row").select("doc_id", "n_tokens", pll)
    return scored.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll"))
