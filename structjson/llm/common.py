"""What the pipeline operators share: written intermediate tables and components.

Intermediate tables cut lineage. They go below ``spark.checkpoint.dir``, which
a cluster must point at a folder that driver and executors share; only a local
master without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Links that one task joins; more take rounds of all tasks.
FEW_LINKS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one under a local master."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="structjson-")
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/structjson/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table written once below the shared folder, and read from there."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(df: DataFrame) -> None:
    """Delete the folder from which a frame of :func:`written` reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        drop_path(df.sparkSession, path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, salt: Column, rows: int = 100_000) -> DataFrame:
    """``left`` with its row of ``right``, whose column ``count`` has the left rows of each key.

    Keys of more than ``rows`` left rows are dealt out to several tasks by ``salt``;
    these keys are broadcast, 10,000 at most, as ``rows`` grows with the total.
    Keys are unique in ``right`` and not null.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    most = max(rows, total // 10_000 + 1)
    hot = F.broadcast(right.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_cuts")))
    cuts = F.coalesce("_cuts", F.lit(1))
    one = left.join(hot, keys, "left").withColumn("_part", F.pmod(salt, cuts).cast("int")).drop("_cuts")
    parts = F.explode(F.sequence(F.lit(0), cuts - 1))
    many = right.join(hot, keys, "left").withColumn("_part", parts).drop("_cuts")
    return one.join(many, [*keys, "_part"], "left").drop("_part")


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links ``u, v``, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[i] != root[j]).any():
        x, y = root[i[apart]], root[j[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if held:
        cols = least_reached(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``links`` of longs: rows ``(node, component)``.

    Up to ``FEW_LINKS`` links are joined by one task, as rounds cost more than they do. For
    more, alternates large-star and small-star steps (Kiveris et al., 2014), which end
    with each node linked to the smallest node of its component. Each round is
    written, so a lost executor costs one round; no round collects links. Rounds go on
    until none changes a link; each lowers the nodes that links point to, so they end.
    Only nodes that occur in ``links`` come back. Nulls and self links are ignored.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links"
    )
    if edges.count() <= FEW_LINKS:
        return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, component long")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u > v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u > v").distinct()
        )
        after = written(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(edges)
        edges = after
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
