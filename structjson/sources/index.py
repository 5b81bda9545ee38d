"""Building, storing and reading token tables.

Whole batches of documents are scanned at once; what a query does not need is not
made (``columns``). A table that several steps of a query read is stored once
(:func:`stored_index`), so the text is scanned once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import TOKENS, BuildOptions, ParseError
from .scanner import scan
from .vectors import scan_many

#: Bytes of text, one document at least, that are scanned together.
CHUNK = 1 << 20


def _scanned(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(json_col).cast("binary").alias("json"))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Documents of a batch, with their ids, some ``CHUNK`` bytes at a time."""
    ids, docs, held = [], [], 0
    for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc_id)
        docs.append(data.as_py() or b"")
        held += len(docs[-1])
        if held >= CHUNK:
            yield ids, docs
            ids, docs, held = [], [], 0
    if docs:
        yield ids, docs


def index_json(
    df: DataFrame,
    id_col: str = "doc_id",
    json_col: str = "json",
    options: BuildOptions | None = None,
    only_keys: list[str] | None = None,
    mode: str = "PERMISSIVE",
    columns: list[str] | None = None,
) -> DataFrame:
    """The token table of ``df``, scanned batch by batch without a shuffle.

    A document that cannot be scanned has no tokens (:func:`index_errors` says why);
    ``mode="FAILFAST"`` raises instead. Null text has no tokens. ``only_keys`` skips
    documents that can hold none of these keys before they are scanned, and returns
    those keys' tokens only: enough for equality, counts and presence of the keys.
    ``columns`` names the columns to make beside ``doc_id`` and ``tok``; all are made
    without it. Works on streaming frames too.
    """
    o = options or BuildOptions()
    docs = _scanned(df, id_col, json_col)
    if only_keys is not None:
        # A key may be spelled with escapes, so a backslash keeps a document.
        text = F.col("json").cast("string")
        may = F.contains(text, F.lit("\\"))
        for k in only_keys:
            may = may | F.contains(text, F.lit(f'"{k}"'))
        docs = docs.where(may)
    made = TOKENS.names if columns is None else [c for c in TOKENS.names if c in ("doc_id", "tok", *columns)]
    shape = T.StructType([TOKENS[c] for c in made])
    schema = to_arrow_schema(shape)
    wanted = None if only_keys is None else list(only_keys)
    places = [TOKENS.names.index(c) - 1 for c in made[1:]]  # in what the scalar scanner gives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                doc, cols, rest = scan_many(texts, set(made[1:]), o.keys, o.container_text, wanted)
                numbers = pa.array(ids, pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([numbers, *(cols[c] for c in made[1:])], schema=schema)
                held: list[list] = [[] for _ in made]
                for i in rest.tolist():
                    found, error = scan(texts[i], o.keys, o.container_text)
                    if error:
                        if mode == "FAILFAST":
                            raise ParseError(f"document {ids[i]}: {error}")
                        continue
                    at = range(len(found[0])) if wanted is None else [k for k, name in enumerate(found[11]) if name in wanted]
                    held[0] += [ids[i]] * len(at)
                    for h, c in zip(held[1:], places):
                        h += [found[c][k] for k in at]
                if held[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)

    return docs.mapInArrow(run, shape)


def index_errors(df: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """``doc_id, error`` of every document; the error is null where the scan succeeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [scan(x.as_py() or b"", False, False)[1] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["doc_id", "error"])

    return _scanned(df, id_col, json_col).mapInArrow(run, "doc_id long, error string")


def stored_index(tokens: DataFrame) -> DataFrame:
    """A token table written once below ``spark.checkpoint.dir``, and read from there.

    What reads it prunes columns and row groups, and a lost executor costs no scan. Only
    a local master may leave that setting out. The files go with the folder.
    """
    spark = tokens.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="structjson-")
    path = f"{folder.rstrip('/')}/structjson/index-{uuid.uuid4().hex}"
    tokens.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(tokens.schema).parquet(path)


def write_index(tokens: DataFrame, path: str) -> None:
    """Store a token table, sorted by key within files so that a key's row groups can be skipped."""
    tokens.sortWithinPartitions("key", "doc_id", "tok").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(path)


def read_json_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``doc_id, json`` of a text source: a document a line, or a file. Ids are of no order."""
    lines = spark.read.text(path, wholetext=whole_files)
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("json"))


def explain_index(tokens: DataFrame, doc_id: int) -> str:
    """A document's token table as text."""
    rows = tokens.where(F.col("doc_id") == doc_id).orderBy("tok").collect()
    head = f"{'tok':>4} {'kind':<9} {'role':<5} {'depth':>5} {'start':>5} {'end':>5} {'parent':>6} {'close':>5} {'tape':>4}  text"
    show = lambda x: "-" if x is None else x
    return "\n".join([head, *(
        f"{r.tok:>4} {show(r.kind) if r.kind else r.raw_kind:<9} {show(r.role):<5} {r.depth:>5} {r.start:>5} {r.end:>5} "
        f"{show(r.parent):>6} {show(r.close_of):>5} {show(r.tape):>4}  {(r.text or '')[:40]}" for r in rows
    )])
