"""Deterministic sharded WARC archives.

Records are range-sorted by id: shards are cut where the payload bytes of all rows
with smaller ids pass a multiple of the shard size, so they depend on the rows alone. Each shard is written in
order and rolled by compressed size under an attempt's own temporary name; the
manifest lists what successful tasks wrote, then files get their final names,
and the manifest's own renaming commits the archive. Every archive folder is a
URI that pyarrow's file systems and Spark both open.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, drop_written, written

#: Shards of an archive at most; more bytes than that many shards hold make larger shards, in files of the same size.
SHARDS = 1 << 20
MANIFEST = "shard long, seq int, temp string, file string, records long, bytes long, sha1 string"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(key: object, digest: str, n: object = 0) -> str:
    """The id of the ``n``-th record of a page with that payload, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}:{n}')}>"


def record_bytes(key, url, payload: bytes, digest: str, refers, date: str, n: object = 0) -> bytes:
    """One uncompressed record; a revisit (``refers`` set) carries no payload."""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(key, digest, n)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if key is not None:
        head.append(("X-Page-Id", str(key)))
    block = (_HTTP % len(payload)).encode()
    if refers is None:
        block += payload
    else:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page-Id", str(refers)),
        ]
    head += [
        ("WARC-Payload-Digest", sha), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def read_records(raw) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a gzip member stream."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield head, block


class _Rolled:
    """Writes records to numbered files of a shard; each closed file gives a manifest row."""

    def __init__(self, folder: str, shard: int, roll: int, level: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.level, self.seq, self.out = shard, roll, level, 0, None

    def add(self, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temp = f"_temporary/{self.shard:06d}-{self.seq:05d}-{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha1()
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.bytes >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield (self.shard, self.seq, self.temp, f"part-{self.shard:06d}-{self.seq:05d}.warc.gz", self.records, self.bytes, self.sha.hexdigest())
            self.seq += 1


def _bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The lowest id of each shard after the first, for ``sizes(page_id, bytes)``.

    Bytes are added up along the ids: within each range of a range partitioning, and
    over the ranges before it by their sums. The running sum of an id is the same for
    any such ranges. Only the first id of each shard comes to the driver.
    """
    ids = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("payload_bytes").alias("b"))
    ranged = written(ids.repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "sizes")
    parts = ranged.groupBy("part").agg(F.sum("b").alias("b")).withColumn(
        "before", F.sum("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    )
    total = parts.agg(F.sum("b")).first()[0] or 0
    step = max(shard_bytes, -(-total // SHARDS))
    along = F.sum("b").over(Window.partitionBy("part").orderBy("page_id")) - F.col("b")
    placed = ranged.withColumn("along", along).join(F.broadcast(parts.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    firsts = placed.groupBy(F.expr(f"(before + along) div {step}").alias("shard")).agg(F.min("page_id").alias("low")).where("shard > 0")
    out = sorted(r.low for r in firsts.collect())  # fewer than SHARDS
    drop_written(ranged)
    return out


def write_archive(
    pages: DataFrame,
    folder: str,
    roll_bytes: int = 64 << 20,
    shard_bytes: int = 16 << 20,
    revisit_from: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 5,
) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as an archive below ``folder``; returns its manifest.

    Of rows with equal payloads (SHA-1 and length) of at least ``revisit_from``
    bytes, those with the largest id are responses and the others revisit it;
    shorter payloads are always responses. ``shard_bytes`` of payload make a
    shard (one task), and its files are rolled at ``roll_bytes`` compressed. An id
    is never split, so rows that repeat one share a shard.

    A folder that holds a committed archive is not written to again.

    Null html is an empty payload, a null url leaves the target out. Rows with a
    null id are responses without a page id, spread over all shards, and are never
    referred to. Rows that repeat are written again, under record ids of their own. Other columns are ignored; no rows give no files.
    """
    spark = pages.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(conf)
    if store.exists(path(f"{folder}/manifest")):
        raise FileExistsError(f"{folder} holds a committed archive")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = pages.select("page_id", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    digests = written(digests, "digests")
    cuts = np.array(_bounds(digests, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(page: pd.Series, spread: pd.Series) -> pd.Series:
        lost = page.isna()
        place = np.searchsorted(cuts, page.fillna(0).astype("int64").to_numpy(), "right")
        return pd.Series(np.where(lost, spread.to_numpy() % (len(cuts) + 1), place).astype("int32"))

    # Rows without an id are no range; they go to all shards, by their content.
    shard = shard_of("page_id", F.pmod(F.xxhash64("url", "html"), F.lit(1 << 31)))
    same = (
        digests.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    revisits = (
        digests.where(F.col("payload_bytes") >= revisit_from).join(same, ["payload_digest", "payload_bytes"])
        .where("page_id < kept").select("page_id", "payload_digest", "kept").distinct()
    )
    rows = pages.select(shard.alias("shard"), "page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("kept")).union(
        revisits.select(shard_of("page_id", F.lit(0).cast("long")).alias("shard"), "page_id", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "payload_digest", "kept")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, to, times, done = None, (), {}, {}, []
        for batch in batches:
            cols = batch.columns
            for i in range(batch.num_rows):
                n, page, kind = cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py()
                if out is None or out.shard != n:
                    if out is not None:
                        done += out.close()
                    out = _Rolled(folder, n, roll_bytes, level)
                if key != (n, page):
                    key, to, times = (n, page), {}, {}
                if kind == 0:
                    to[cols[5][i].as_py()] = cols[6][i].as_py()
                    continue
                html = cols[4][i]
                data = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = hashlib.sha1(data).hexdigest()
                refers = to.get(digest) if len(data) >= revisit_from else None
                again = times[digest] = times.get(digest, -1) + 1
                if page is None:  # no order among them says which is which
                    again = f"{cols[3][i].as_py()}:{n}:{again}"
                done += out.add(record_bytes(page, cols[3][i].as_py(), data, digest, refers, date, again))
        if out is not None:
            done += out.close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names)

    parts = len(cuts) + 1
    manifest_path = f"{folder}/_temporary_manifest"
    (
        rows.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", F.xxhash64("url", "html"))
        .mapInArrow(write, MANIFEST).write.parquet(manifest_path)
    )
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for temp, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if store.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:  # else a lost task has moved it
                    store.move(f"{root}/{temp}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{temp}")
            yield batch

    manifest.select("temp", "file").mapInArrow(move, "temp string, file string").agg(F.count("*")).collect()
    if not store.rename(path(manifest_path), path(f"{folder}/manifest")):
        raise OSError(f"{folder}: the manifest could not be committed")
    drop_written(digests)
    drop_path(spark, f"{folder}/_temporary")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files of an archive."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").drop("temp")


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of a committed archive, its digests and lengths checked anew.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and
    ``payload`` (null for revisits). Each file is one stream, read record by record.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    schema += ", payload binary" if with_payload else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for head, block in read_records(raw):
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block does not match its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), head.get("WARC-Target-URI"), head["WARC-Type"], to and int(to), size, digest, None if revisit else payload)[: len(names)])
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    files = read_manifest(spark, folder)
    return files.select("file").repartition(max(1, files.count())).mapInArrow(read, schema)
