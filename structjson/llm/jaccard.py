"""Exact n-gram Jaccard join over parity sketches.

A document's set of word n-grams is XOR-hashed into a bit sketch: each n-gram
flips one bit. The Hamming distance of two sketches is never more than the
symmetric difference of the sets, which the similarity threshold bounds for sets
of a size band. So if a sketch is cut into more bands than that bound, two similar
documents agree on the bands beyond it (pigeonhole); those bands, kept sparse as
hashes of their odd bits, are the join keys. As similar documents agree on several,
each leaves out the bands that say least and then its most frequent keys, as many
as cannot be all that two agree on. A narrower dense sketch then discards
candidates by its own Hamming distance, and the sets decide.

A key may be shared by many documents. Each is first compared with the first of
its key only, which joins large groups of copies in linear time. Then keys whose
documents are still in several components compare across components, until every
pair that the sketches admit is linked, refuted or within one component.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, drop_path, drop_written, fresh_path, written

#: Rows of a key that one task holds when it compares across components.
BLOCK = 4000
#: More than there are size bands; a power of 2.
SIZE_BANDS = 128
_M = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, one function for each seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(_M[3] * (2 * seed + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_M[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_M[2])
        return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Small numbers for words, and the words' 64-bit hashes by number."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


class Shingler:
    """Sets of hashed word n-grams. Words are runs of other than blank and 9-13, A-Z lower-cased."""

    def __init__(self, size: int):
        self.size = size
        self._forget()

    def _forget(self) -> None:
        self.words, self.table, self.known = _Words(), np.zeros(0, np.uint64), 0

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode().lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(self.words) > 500_000:
            self._forget()
        ids = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))
        known = self.words.hashes
        if len(known) > self.known:
            if len(known) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros(max(4096, len(known)), np.uint64)])
            self.table[self.known : len(known)] = known[self.known :]
            self.known = len(known)
        h = self.table[ids]
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, _M[4] * n % 2**64, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out *= np.uint64(_M[k % 3])
                out += h[k : len(h) - n + 1 + k]
        return np.unique(_mix(out))


class Bands:
    """Size bands and the number of sketch bands in each, for a threshold ``num/den``."""

    def __init__(self, num: int, den: int, ratio: float = 1.25):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 2**40:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * ratio)))

    def index(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def smallest(self, n: int) -> int:
        """Size of the smallest set that can be similar to one of ``n``."""
        return max(1, -(-self.num * n // self.den))

    def bound(self, a: int, b: int) -> int:
        """Most that similar sets of these sizes differ by."""
        return (a + b) - 2 * (-(-self.num * (a + b) // (self.num + self.den)))

    def most(self, band: int) -> int:
        """Most that similar sets differ by if the smaller is of size band ``band``."""
        high = self.lows[band + 1] - 1
        other = self.den * high // self.num
        return max(self.bound(high, other - k) for k in range(3))  # the bound is not quite monotone

    def spare(self, band: int) -> int:
        """Of its keys, the most frequent that a set may leave out."""
        return self.most(band) // 8

    def count(self, band: int) -> tuple[int, int]:
        """Sketch bands in all, and those that each set keeps; two similar sets agree on over ``spare`` of these."""
        most = self.most(band)
        return most + 1 + most // 3, most + 1 + self.spare(band)

    def of(self, n: int) -> range:
        """The size bands in which a set of ``n`` meets its partners."""
        return range(self.index(self.smallest(n)), self.index(n) + 1)


def band_keys(shingles: np.ndarray, band: int, count: int, kept: int, seed: int = 0) -> np.ndarray:
    """The ``kept`` richest keys of the ``count`` bands of a sparse parity sketch of ``count`` * 2**20 bits.

    A key's low bits are the size band. Richest have most odd bits; the keys break
    ties, so all sets order the keys alike. Two sets that differ in ``m`` bands at
    most then agree on ``kept - m`` of their richest keys or more.
    """
    h = _mix(shingles, seed + 11)
    at = (h % np.uint64(count)) * np.uint64(1 << 20) + (h >> np.uint64(44))
    bits, times = np.unique(at, return_counts=True)
    bits = bits[times % 2 == 1]
    which = (bits >> np.uint64(20)).astype(np.int64)
    keys = _mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 32), seed + 23)
    odd = np.bincount(which, minlength=count)
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else which
    if len(cuts):
        keys[which[cuts]] ^= np.bitwise_xor.reduceat(_mix(bits, seed + 37), cuts)
    keys = (keys & ~np.uint64(SIZE_BANDS - 1)) | np.uint64(band)
    return keys[np.lexsort((keys, -odd))[:kept]]


def dense_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of 64 bits or more, two to four for each n-gram; halves fold onto each other by XOR."""
    size = max(64, 2 << math.ceil(math.log2(max(1, len(shingles)))))
    odd = np.bincount((_mix(shingles, 5) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as ``size`` bytes."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[d.split()[1]]) for c, d in zip(cols, schema.split(", "))], _columns(schema))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, k1, k2, sketch``: set size, 128-bit digest of the set, dense sketch."""
    schema = "doc_id long, n long, k1 long, k2 long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            out = [[], [], [], []]
            for text in batch.column(1):
                s = shingler(text.as_py())
                d = xxhash.xxh3_128_digest(s.tobytes())
                for c, x in zip(out, (len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), dense_sketch(s))):
                    c.append(x)
            yield _batch(schema, [batch.column(0), *out])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _key_rows(texts: DataFrame, size: int, bands: tuple[int, int]) -> DataFrame:
    """``key, rep, n`` for each sketch band of each document, in its size bands."""
    schema = "key long, rep long, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, b = Shingler(size), Bands(*bands)
        for batch in batches:
            reps, keys, ns, held = [], [], [], 0
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingler(text.as_py())
                for band in b.of(len(s)):
                    k = band_keys(s, band, *b.count(band))
                    keys.append(k.view(np.int64))
                    reps.append(np.full(len(k), rep))
                    ns.append(np.full(len(k), len(s), np.int32))
                    held += len(k)
                if held > 200_000:
                    yield _batch(schema, [np.concatenate(keys), np.concatenate(reps), np.concatenate(ns)])
                    reps, keys, ns, held = [], [], [], 0
            if held:
                yield _batch(schema, [np.concatenate(keys), np.concatenate(reps), np.concatenate(ns)])

    return texts.select("rep", "text").mapInArrow(run, schema)


def _telling_keys(rows: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """``rows`` without keys that one document has, and without the ``spare`` most frequent
    of each document and size band.

    Similar documents share more than ``spare`` keys of a size band. All documents
    order them alike, so the rarest that two share is among the most frequent of neither.
    """
    schema = "key long, rep long, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bands(*bands)
        spare = np.array([b.spare(k) for k in range(len(b.lows) - 1)])
        last, place = None, 0  # the last (rep, size band, key) and its place in its group
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            band = key & (SIZE_BANDS - 1)
            group = np.r_[True, (rep[1:] != rep[:-1]) | (band[1:] != band[:-1])]
            other = group | np.r_[True, key[1:] != key[:-1]]  # a document with several texts may repeat a key
            before = 0
            if last is not None and last[:2] == (rep[0], band[0]):
                group[0], other[0], before = False, last[2] != key[0], place + 1
            step = np.cumsum(other)
            at = np.maximum.accumulate(np.where(group, np.arange(len(key)), -1))
            places = np.where(at < 0, before - 1 + step, step - step[np.maximum(at, 0)])
            last, place = (rep[-1], band[-1], key[-1]), places[-1]
            keep = places >= spare[band]
            if keep.any():
                yield _batch(schema, [key[keep], rep[keep], n[keep]])

    many = rows.withColumn("docs", F.count("*").over(Window.partitionBy("key"))).where("docs > 1")
    return many.repartition("rep").sortWithinPartitions("rep", F.col("key").bitwiseAND(SIZE_BANDS - 1), F.desc("docs"), F.desc("key")).mapInArrow(run, schema)


def _shared_keys(rows: DataFrame) -> DataFrame:
    """``key, rep, n, first, first_n`` of the keys that several documents have; ``first`` is the smallest."""
    schema = "key long, rep long, n int, first long, first_n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row: it may share its key with the next batch
        lead = None  # (key, first, first_n) of the run that it ends
        for batch in batches:
            key, rep, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if last is not None:
                key, rep, n = (np.concatenate([[a], b]) for a, b in zip(last, (key, rep, n)))
            starts = np.r_[True, key[1:] != key[:-1]]
            run_of = np.cumsum(starts) - 1
            at = np.flatnonzero(starts)
            first, first_n = rep[at][run_of], n[at][run_of]
            size = np.bincount(run_of)[run_of]
            if lead is not None and lead[0] == key[0]:
                mine = run_of == 0
                first[mine], first_n[mine] = lead[1], lead[2]
                size[mine] += 1
            lead = (key[-1], first[-1], first_n[-1]) if (size[-1] > 1) else None
            last = (key[-1], rep[-1], n[-1])
            keep = (size > 1) & (np.arange(len(key)) < len(key) - 1)
            if keep.any():
                yield _batch(schema, [x[keep].astype(np.int64 if x.dtype != np.int32 else np.int32) for x in (key, rep, n, first, first_n)])
        if last is not None and lead is not None:
            yield _batch(schema, [[int(last[0])], [int(last[1])], [int(last[2])], [int(lead[1])], [int(lead[2])]])

    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, schema)


def _may_be_similar(num: int, den: int):
    """Rows ``a, b, na, nb, sa, sb`` to those whose sketches admit the threshold, as ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bands(num, den)
        for batch in batches:
            keep = []
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = x.as_py(), y.as_py()
                size = min(len(x), len(y))
                if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= b.bound(int(na[i]), int(nb[i])):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar. A text is sent once for each partner, or
    once for a few hundred of them: pairs are grouped by ``a``, in slices."""
    slices = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / 500).cast("int").alias("cuts"))
    sliced = pairs.join(slices, "a").withColumn("cut", F.pmod(F.xxhash64("b"), F.col("cuts")))
    members = sliced.join(texts.withColumnRenamed("rep", "b"), "b").select("a", "cut", F.lit(1).alias("kind"), "b", "text")
    heads = sliced.select("a", "cut").distinct().join(texts.withColumnRenamed("rep", "a"), "a").select("a", "cut", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, head, own = Shingler(size), None, []
        for batch in batches:
            out = [[], []]
            for a, cut, kind, b, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                s = shingler(text.as_py())
                if kind == 0:
                    own = [*own, s] if head == (a, cut) else [s]
                    head = (a, cut)
                    continue
                for o in own:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if den * both >= num * (len(o) + len(s) - both):
                        out[0].append(a)
                        out[1].append(b)
                        break
            yield _batch(schema, out)

    return heads.union(members).repartition("a", "cut").sortWithinPartitions("a", "cut", "kind").mapInArrow(run, schema)


def _across(num: int, den: int, most: int):
    """Pairs of one key's documents from different components that the sketches admit.

    Of those a document has with a component, the ``most`` nearest, and ``more`` = 1
    if there are others.
    """
    schema = "a long, b long, more int"

    def pairs(rows: list[tuple], b: Bands) -> Iterator[pa.RecordBatch]:
        comp = np.array([r[1] for r in rows])
        if (comp == comp[0]).all():
            return
        left_block, right_block = rows[0][2], rows[0][3]
        own = np.array([r[4] for r in rows])
        rep, n = np.array([r[5] for r in rows]), np.array([r[6] for r in rows], np.int64)
        size = min(len(r[7]) for r in rows)
        size = max(size, 8)
        x = np.stack([folded(r[7], size) for r in rows]).view(np.uint64)
        total_num, total_den = num, num + den
        for i in range(len(rows)):
            # The row with the smaller set looks for larger ones, so each pair is seen once.
            j = np.flatnonzero((comp != comp[i]) & ((n > n[i]) | ((n == n[i]) & (rep > rep[i]))) & (num * n <= den * n[i]))
            if left_block != right_block:
                j = j[own[j] != own[i]]
            if not len(j):
                continue
            d = np.bitwise_count(x[j] ^ x[i]).sum(1)
            sums = n[j] + n[i]
            ok = d <= sums - 2 * (-(-total_num * sums // total_den))
            j, d = j[ok], d[ok]
            if not len(j):
                continue
            order = np.lexsort((d, comp[j]))
            j = j[order]
            c = comp[j]
            place = np.arange(len(j)) - np.searchsorted(c, c)
            more = np.bincount(np.searchsorted(np.unique(c), c))[np.searchsorted(np.unique(c), c)] > most
            take = place < most
            yield _batch(schema, [np.minimum(rep[i], rep[j[take]]), np.maximum(rep[i], rep[j[take]]), more[take].astype(np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, held, key = Bands(num, den), [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                now = (row[0], row[2], row[3])
                if now != key:
                    if len(held) > 1:
                        yield from pairs(held, b)
                    held, key = [], now
                held.append(row)
        if len(held) > 1:
            yield from pairs(held, b)

    return run, schema


def _release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that are gone; it waits for the driver's collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bucketed(source: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The chosen texts as a table bucketed by ``rep``, so that joins on it do not move texts again."""
    spark = source.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"texts_{uuid.uuid4().hex}", fresh_path(spark, "texts")
    (
        source.repartition(buckets, "rep").join(chosen, "rep", "left_semi").write.option("compression", "zstd")
        .bucketBy(buckets, "rep").option("path", path).saveAsTable(name)
    )

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)

    return spark.table(name), drop


def _grown(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, component`` as links ``a, b`` join the components ``parts``, which stand for the links before."""
    if parts is not None:
        links = links.union(parts.select("node", "component"))
    return written(components(links), "parts")


def _parts(texts: DataFrame, sketches: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``rep, component`` of the texts that links join, from ``texts(rep, text)`` and ``sketches(rep, n, sketch)``."""
    spark = texts.sparkSession
    telling = written(_telling_keys(_key_rows(texts, size, (num, den)), (num, den)), "keys")
    _release(spark)
    shared = written(_shared_keys(telling), "keys")
    drop_written(telling)
    _release(spark)
    near = (F.col("n") * den >= F.col("first_n") * num) & (F.col("first_n") * den >= F.col("n") * num)
    star = shared.where(near & (F.col("rep") != F.col("first"))).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()

    def admitted(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_may_be_similar(num, den), "a long, b long").distinct()

    tried = written(admitted(star), "pairs")
    links = written(_verify(tried, texts, size, num, den), "similar")
    made, parts = [tried, links], None
    _release(spark)
    # Keys of three documents or more; of those with the same documents, one.
    sets = shared.groupBy("key").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.count("*").alias("size"))
    wide = written(shared.join(sets.where("size > 2").groupBy("x", "y", "size").agg(F.min("key").alias("key")).select("key", "size"), "key").select("key", "rep", "n", "size"), "keys")
    drop_written(shared)
    # A round hands on the `most` nearest of the candidates that a row has in another component.
    # `most` grows in every round and reaches the rows of a block, which leaves nothing open.
    most = 1
    while True:
        if parts is None or not links.isEmpty():
            parts = _grown(parts, links)
            made.append(parts)
        placed = wide.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "size", F.coalesce("component", "rep").alias("comp"))
        mixed = placed.groupBy("key", "size").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        open_rows = placed.drop("size").join(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("cuts")), "key").join(
            sketches.select("rep", "sketch"), "rep"
        )
        own = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
        blocks = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
            "key", "comp", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "n", "sketch"
        )
        run, schema = _across(num, den, most)
        found = blocks.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(run, schema)
        found = written(found.groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
        new = written(found.select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
        links = written(_verify(new, texts, size, num, den), "similar")
        made += [found, new, links]
        _release(spark)
        if found.where("more = 1").isEmpty():
            break  # every admitted pair across components is verified or refuted
        tried = tried.union(new)
        most *= 16 if links.isEmpty() else 2
    whole = _grown(parts, links)
    for table in (wide, *made):
        drop_written(table)
    return whole.withColumnRenamed("node", "rep")


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Documents link when the Jaccard similarity of their sets of distinct
    ``size``-word n-grams (the whole sequence where there are fewer words) is at
    least ``similarity``, compared as a fraction of hundredths. ``component_id`` is
    the smallest ``doc_id`` that links reach, its own included.

    Null, empty or blank text has an empty set and links with nothing; neither
    does a row without an id, whose component is null. Rows that repeat an id are
    one node with all its texts. Equal sets are one node too. Whole texts count.
    Other columns are left out; an empty table gives no rows.
    """
    num, den = round(similarity * 100), 100
    g = math.gcd(num, den)
    num, den = num // g, den // g
    sig = written(signatures(docs, size), "signatures")
    classes = sig.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    sketches = written(
        sig.join(classes, ["k1", "k2"]).where("doc_id = rep").select("rep", F.col("n").cast("int").alias("n"), "sketch", "k1", "k2")
        .dropDuplicates(["rep", "k1", "k2"]).drop("k1", "k2"), "sketches"
    )
    chosen = sketches.select("rep").distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts, drop_texts = _bucketed(source, chosen)

    try:
        parts = _parts(texts, sketches, size, num, den)
    finally:
        drop_texts()
    drop_written(sketches)
    known = classes.join(parts, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    return sig.join(known, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of similar documents.

    The row with the group's smallest ``doc_id`` stays; of rows that repeat that id
    all stay, and so do rows without an id or without words.
    """
    found = similar_documents(docs, **options)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
