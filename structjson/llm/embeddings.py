"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, written

#: Rows of a bucket that are compared by one task; larger buckets are cut into blocks.
BLOCK = 2000


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees at this distance."""
    c = width / distance
    phi = 0.5 * (1 + math.erf(-c / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables_for(rows: int, threshold: float, width: float, recall: float, per_bucket: int = 256) -> tuple[int, int]:
    """Projections a table and tables: buckets of unrelated unit vectors stay near
    ``per_bucket`` rows, and a pair at the threshold meets with chance ``recall``."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(max(1e-9, 2 - 2 * threshold)), width)
    k = max(2, round(math.log(max(4, rows / per_bucket)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


class _Hasher:
    def __init__(self, dim: int, k: int, tables: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(dim, k * tables))
        self.b = rng.uniform(0, width, k * tables)
        self.mult = rng.integers(1, 2**62, (tables, k), dtype=np.int64) | 1
        self.width, self.shape = width, (tables, k)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit code for each row and table."""
        q = np.floor((unit @ self.a + self.b) / self.width).astype(np.int64).reshape(len(unit), *self.shape)
        with np.errstate(over="ignore"):
            h = (q * self.mult).sum(2)
            h ^= (h >> 29) & 0x7FFFFFFFF
            return h * np.int64(-7046029254386353131)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places by the pairs."""
    root = np.arange(n)
    while len(i):
        m = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, width: float = 3.0, recall: float = 0.98, seed: int = 0
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    Two rows link when the cosine of their vectors, in double precision, reaches
    ``threshold``. Candidates share a bucket in one of several tables; ``recall``
    is the chance of that at the threshold itself, closer pairs meet more surely.
    Rows of equal vectors are one node with a multiplicity. Within a bucket all
    pairs are checked, in blocks; a pair counts in the first table where it meets,
    so links are summed up without being listed, and a bucket hands on one
    spanning link a row.

    A null vector, a zero one, or one that holds a null or a non-finite component
    links with nothing; so does a row without an id, whose component is null.
    Repeated rows count as other vectors, and rows that repeat an id with another vector
    link as their vector does. Vectors of several lengths link within
    their length only. Other columns are left out; an empty table gives no rows.
    """
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = F.coalesce(fine & F.exists(e, lambda x: x != 0), F.lit(False))
    zeroed = F.transform(e, lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(fine, F.xxhash64(zeroed)).alias("k1"), F.when(fine, F.md5(F.to_json(zeroed))).alias("k2"), F.when(fine, F.col("embedding")).alias("v"))
    keys = rows.select("vec_id", "k1", "k2")
    # A node is a class of equal vectors, under a number of its own: ids may repeat with other vectors.
    classes = keys.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    nodes = written(
        rows.where("k1 is not null").join(classes, ["k1", "k2"]).where("vec_id = least").dropDuplicates(["rep"]).select("rep", "mult", "v", F.size("v").alias("dim")), "vectors"
    )
    sizes = nodes.groupBy("dim").count().collect()  # one row for each vector length
    k, tables = tables_for(max([r[1] for r in sizes], default=0), threshold, width, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            vs = batch.column(1).to_pylist()
            out = [[] for _ in vs]
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                h = hashers.setdefault(dim, _Hasher(int(dim), k, tables, width, seed))
                for at, c in zip(which, h.codes(_unit([vs[i] for i in which]))):
                    out[at] = c.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["rep", "codes"])

    coded = written(
        nodes.select("rep", "v", "dim").mapInArrow(code, "rep long, codes array<long>").join(nodes, "rep"), "codes"
    )
    places = coded.select("rep", "dim", F.posexplode("codes").alias("t", "code"))
    large = places.groupBy("dim", "t", "code").count().where(F.col("count") > BLOCK).select(
        "dim", "t", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("cuts")
    )
    full = coded.select("rep", "mult", "v", "dim", "codes", F.posexplode("codes").alias("t", "code"))
    full = full.join(large, ["dim", "t", "code"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
    blocks = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "dim", "t", "code", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "mult", "v",
        F.slice("codes", F.lit(1), F.col("t")).alias("codes"),  # those of earlier tables, to count a pair once
    )

    def group(part: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """``rep, links, root`` for the rows of one bucket block that link."""
        t, b1, b2 = part[0][1], part[0][3], part[0][4]
        own = np.array([r[5] for r in part])
        rep, mult = np.array([r[6] for r in part]), np.array([r[7] for r in part])
        x = _unit([r[8] for r in part])
        codes = np.array([r[9] for r in part], np.int64)
        found_i, found_j = [], []
        for at in range(0, len(x), 1000):
            i, j = np.nonzero(x[at : at + 1000] @ x.T >= threshold)
            i += at
            ok = (i < j) & ((own[i] != own[j]) | (b1 == b2))
            found_i.append(i[ok])
            found_j.append(j[ok])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if not len(i):
            return None
        root = _local_roots(len(x), i, j)
        n = np.zeros(len(x), np.int64)
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            new = ~(codes[a] == codes[b]).any(1) if t else np.ones(len(a), bool)
            np.add.at(n, a[new], mult[b[new]])
            np.add.at(n, b[new], mult[a[new]])
        hit = np.unique(np.concatenate([i, j]))
        return rep[hit], n[hit], rep[root[hit]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        out: list = []

        def done():
            nonlocal out
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "n", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != key:
                    if len(held) > 1 and (r := group(held)):
                        out.append(r)
                    held, key = [], row[:5]
                held.append(row)
            if sum(len(x[0]) for x in out) > 50_000:
                yield done()
        if len(held) > 1 and (r := group(held)):
            out.append(r)
        yield done()

    cells = ["dim", "t", "code", "b1", "b2"]
    found = written(blocks.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(compare, "rep long, n long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.where("rep <> root").select("rep", "root").distinct(), "rep", "root").withColumnRenamed("node", "rep")
    smallest = parts.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("c"))
    known = classes.join(links, "rep", "left").join(parts.join(smallest, "component"), "rep", "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("c", "least").alias("c")
    )
    known = written(known, "known")
    for table in (coded, found, nodes):
        drop_written(table)
    # Vectors that link with nothing stay out of the join, where they would share one key.
    odd = keys.where("k1 is null").select("vec_id", F.lit(0).alias("n"), F.lit(None).cast("long").alias("c"))
    joined = keys.where("k1 is not null").join(known, ["k1", "k2"]).select("vec_id", "n", "c").unionByName(odd)
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
