"""Vector best-fit packing of token sequences.

Every item has a demand vector (tokens, documents, attention cost) that depends
on its length alone, so a corpus is packed through its length histogram, of at
most ``capacity`` rows however many documents there are. The plan places whole
runs of equal items into whole runs of equal bins; pieces then find their bin by
their rank among the pieces of equal length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Chunks whose ids a worker keeps.
CACHE = 800_000


class ChunkIds(dict):
    """Ids of a run of non-space characters, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases and splits letters from punctuation before its
    merges, so a chunk of letters and a tail of ASCII punctuation is looked up as
    its lower-cased letters and its tail. Unknown words go to the tokenizer
    together: each ends with the one token of its own that closes a word. Words of
    Latin-1, which are in normal form, skip what they have behind them (``plain``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def parts(chunk: str) -> tuple[str, str]:
        stem = chunk.rstrip(punctuation)
        if not (stem.isalpha() and (stem.isascii() or is_normalized("NFC", stem)) and "\u03a3" not in stem):
            return "", ""  # sigma: str.lower() looks at its place in the word
        return stem.lower(), chunk[len(stem) :]

    def word_ids(self, words: list[str]) -> np.ndarray:
        """The ids of lower-cased words of letters, one after the other."""
        text = " ".join(words)
        try:
            text.encode("latin-1")
            tokenizer = self.plain
        except UnicodeEncodeError:
            tokenizer = self.tokenizer
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, chunks: set[str]) -> None:
        """Make every chunk known."""
        if len(self) + len(chunks) > CACHE:
            self.clear()
        words, rest = set(), []
        for c in chunks:
            word, tail = (c.lower(), "") if c.isascii() and c.isalpha() else self.parts(c)
            if word and word not in self and word.isalpha():
                words.add(word)
            if word and word != c:
                rest.append((c, word, tail))
        if words:
            words = list(words)
            ids = self.word_ids(words)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):
                buf, at = ids.tobytes(), 0
                for w, end in zip(words, (4 * ends).tolist()):
                    self[w] = buf[at:end]
                    at = end
        for c, word, tail in rest:
            if word in self:
                self[c] = self[word] + self[tail] if tail else self[word]

    def __missing__(self, chunk: str) -> bytes:
        ids = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids


_known: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The ids that this process has learned, kept from task to task."""
    if path not in _known:
        _known[path] = ChunkIds(path)
    return _known[path]


def split_chunks(text: str) -> list[str]:
    """What lies between blanks, tabs and line ends."""
    return list(filter(None, text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Tokenise each text, end it with ``end_id`` and cut what exceeds ``capacity``.

    Null text counts as empty. No token of this tokenizer spans white space, so
    ids are cached by chunk; chunks are cut at blanks, tabs and line ends only,
    which are white space in every definition.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                chunks = split_chunks(text)
                found = list(map(ids.get, chunks))
                if None in found:
                    ids.learn({c for c, x in zip(chunks, found) if x is None})
                    found = map(ids.__getitem__, chunks)
                buf = b"".join(found) + end
                for piece, at in enumerate(range(0, len(buf), 4 * capacity)):
                    part = buf[at : at + 4 * capacity]
                    for col, x in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan_bins(
    histogram: dict[int, int],
    capacity: int,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: count}``.

    Returns runs ``(length, first_rank, count, first_bin, offset)``: the pieces of
    that length with ranks from ``first_rank`` go, one each, to the bins from
    ``first_bin``, at ``offset``. A bin takes an item only where all three
    residual capacities hold it. Among those, ``rule="norm"`` takes the smallest
    weighted norm of what remains, ``rule="dot"`` the largest weighted product of
    demand and residual; ties go to the earliest bins.
    """
    caps = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], float)
    scale = np.asarray(weights, float)
    left, start, count, used = np.zeros((64, 3)), *(np.zeros(64, np.int64) for _ in range(3))
    n, bins, runs = 0, 0, []
    for length in sorted(histogram, reverse=True):
        demand, rest, rank = np.array([length, 1, length * length], float), histogram[length], 0
        if np.any(demand > caps):
            raise ValueError(f"an item of {length} tokens fits no empty bin")
        while rest:
            ok = np.flatnonzero((left[:n] >= demand).all(1))
            if len(ok):
                room = left[ok] / caps
                if rule == "norm":
                    score = (((room - demand / caps) * scale) ** 2).sum(1)
                else:
                    score = -(room * (demand / caps) * scale).sum(1)
                best = score.min()
                tied = ok[score <= best + 1e-15]
                i = tied[np.argmin(start[tied])]
            else:
                if n == len(start):
                    live = np.flatnonzero((left[:n] >= np.array([1, 1, 1])).all(1))
                    m = len(live)
                    grow = max(64, 2 * m)
                    left, start, count, used = (
                        np.concatenate([x[live], np.zeros((grow, *x.shape[1:]), x.dtype)]) for x in (left, start, count, used)
                    )
                    n = m
                i, n = n, n + 1
                # Bins that equal items fill to the last one that fits; what is left over opens one more.
                opened = max(1, rest // int((caps // demand).min()))
                left[i], start[i], count[i], used[i] = caps, bins, opened, 0
                bins += opened
            k = min(rest, int(count[i]))
            runs.append((length, rank, k, int(start[i]), int(used[i])))
            if k < count[i]:
                if n == len(start):
                    left, start, count, used = (np.concatenate([x, np.zeros_like(x)]) for x in (left, start, count, used))
                left[n], start[n], count[n], used[n] = left[i], start[i] + k, count[i] - k, used[i]
                count[i] = k
                n += 1
            left[i] -= demand
            used[i] += length
            rest, rank = rest - k, rank + k
    return runs


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
    end_id: int = 0,
) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. A document is its ids and ``end_id``; only one longer than
    ``capacity`` is cut. ``max_docs`` bounds the pieces of a sequence and
    ``max_attention`` the sum of their squared lengths; left out, neither binds.

    Null or empty text is a document of one token. Rows that repeat are packed
    each on its own; a null ``doc_id`` stays null; equal lengths are ranked by
    ``doc_id`` and ``piece``. Other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan_bins(counts, capacity, max_docs, max_attention, weights, rule)
    plan = spark.createDataFrame(runs, "length long, first_rank long, n long, first_bin long, offset long")
    # Ranks in two steps, so that a frequent length is not ranked by one task.
    buckets = max(16, sum(counts.values()) // 20_000)
    cell = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = cell.groupBy("length", "cell").count().select(
        "length", "cell",
        (F.sum("count").over(Window.partitionBy("length").orderBy("cell")) - F.col("count")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        cell.withColumn("within", within).join(before, ["length", "cell"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
    )
    p, r = F.broadcast(plan).alias("p"), ranked.alias("r")  # a few runs for each length
    return r.join(
        p,
        (F.col("r.length") == F.col("p.length"))
        & (F.col("r.rank") >= F.col("p.first_rank"))
        & (F.col("r.rank") < F.col("p.first_rank") + F.col("p.n")),
    ).select(
        "r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32",
        (F.col("p.first_bin") + F.col("r.rank") - F.col("p.first_rank")).alias("sequence_id"),
        F.col("p.offset").alias("offset"),
    )
