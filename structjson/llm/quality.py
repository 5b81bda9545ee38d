"""Quality classifier: document evidence shrunk through site-level posteriors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .stopwords import STOPWORDS

FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "bar", "mark", "comma_stop", "other_bytes",
    "distinct_words", "top_word", "stopwords", "distinct_lines", "symbol_words", "halves",
)
#: Site tables up to this many rows are broadcast.
SMALL_SITES = 100_000
#: Parts into which a join with more sites than that cuts each site.
SALTS = 32
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\_=+", b"|", b"!?", b",."), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7


def features(text: str | None) -> list[float]:
    """Figures of the whole text; all zero for null, empty or blank text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=8)
    n, size = len(words), max(1, raw.sum())
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(c for w, c in count.items() if not w[-1].isalnum() and w[-1] not in ",.;:")
    half = n // 2
    again = len(set(words[half:]) & set(words[:half])) / max(1, len(set(words[half:]))) if n >= 8 else 0.0
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, *(raw[1:8] / size).tolist(),
        len(count) / n, max(count.values()) / n, sum(count[w] for w in STOPWORDS & count.keys()) / n,
        len(set(lines)) / max(1, len(lines)), ends / n, again,
    ]


def with_features(docs: DataFrame, columns: list[str], name: str, weights: np.ndarray | None = None) -> DataFrame:
    """``columns`` of ``docs`` and the features of ``text`` (with ``weights``: their log odds) as ``name``."""
    kept = docs.select(*columns)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType() if weights is not None else T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                f = [features(x.as_py()) for x in part.column(part.num_columns - 1)]
                if weights is None:
                    new = pa.array(f, pa.list_(pa.float32()))
                else:
                    new = pa.array(np.asarray(f, np.float32).astype(float) @ weights[:-1] + weights[-1], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], names=schema.names)

    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights on raw features, the intercept last; Newton steps on standardised ones."""
    if len(y) == 0 or y.min() == y.max():
        return np.r_[np.zeros(len(FEATURES)), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))]
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag(np.r_[np.full(z.shape[1] - 1, l2), 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()]


def _logit(p):
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _shrunk(groups: DataFrame, parent_mean, key: list[str], name: str) -> DataFrame:
    """Posterior means of groups ``(n, s, parent)``; the prior's strength by moments.

    Between-group variance is that of group means about their parents, less what
    sampling within a group explains; it is one row, whatever the number of groups.
    """
    g = groups.withColumn("_m", parent_mean)
    spread = g.agg(
        (F.sum(F.col("n") * ((F.col("s") / F.col("n") - F.col("_m")) ** 2)) / F.sum("n")
         - F.avg(F.col("_m") * (1 - F.col("_m"))) * F.count("*") / F.sum("n")).alias("v"),
        F.avg(F.col("_m") * (1 - F.col("_m"))).alias("pq"),
    ).select(F.greatest(F.lit(2.0), F.least(F.lit(1e4), F.col("pq") / F.greatest(F.lit(1e-6), "v") - 1)).alias("k"))
    return g.crossJoin(F.broadcast(spread)).select(*key, ((F.col("s") + F.col("k") * F.col("_m")) / (F.col("n") + F.col("k"))).alias(name))


def score_quality(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = 20_000, keep_from: float = 0.5
) -> DataFrame:
    """Adds ``q_doc, q_host, q_path, q_score, q_keep`` to every row of ``docs(doc_id, text, ...)``.

    ``q_doc`` is a logistic classifier's probability that the text is good. It is
    fitted on ``labels(doc_id, quality)``, on ``sample`` labels and as many labelled
    rows at most (by hash of the id), which bounds what the driver holds. Sites are ``host``, and ``path``
    within it: their posterior means shrink a site's mean evidence towards its
    parent, the more the sparser it is. ``q_score`` adds to the document's log odds
    those of its path over the corpus, and ``q_keep`` says if it reaches ``keep_from``.

    Null or empty text has all features zero and is judged like any other. Null
    sites are sites of their own. Repeated rows are judged each, labels of an id
    that repeats are used each, null labels not at all. Without labels of both
    kinds the classifier is constant. Columns named ``q_*`` are replaced; an empty
    table gives no rows.
    """
    cols = [c for c in docs.columns if not c.startswith("q_")]
    slim = written(
        with_features(docs, list(dict.fromkeys(["doc_id", host, path])), "f").select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "f"), "features"
    )
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Ids may repeat on either side; of the joined rows too there are `sample` at most, the same in every run.
    rows = slim.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "f").select("f", "quality").limit(sample).collect()
    x = np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES))
    w = fit_logistic(x, np.array([r[1] for r in rows], float))
    weights = F.array(*[F.lit(float(a)) for a in w[:-1]])

    def log_odds(f):
        terms = F.zip_with(f, weights, lambda a, b: a.cast("double") * b)
        return F.aggregate(terms, F.lit(float(w[-1])), lambda a, b: a + b)

    p = 1 / (1 + F.exp(-log_odds(F.col("f"))))
    by_path = written(slim.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "sites")
    total = by_path.agg((F.sum("s") / F.sum("n")).alias("mean"))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).crossJoin(F.broadcast(total))
    hosts = _shrunk(by_host, F.col("mean"), ["host", "mean"], "q_host")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    below = by_path.join(hosts.withColumnRenamed("host", "_h"), same("host", "_h")).drop("_h")
    sites = written(
        _shrunk(below, F.col("q_host"), ["host", "path", "mean", "q_host"], "q_path").select(F.col("host").alias("_host"), F.col("path").alias("_path"), "mean", "q_host", "q_path"), "sites"
    )
    odds = F.col("_odds")
    score = 1 / (1 + F.exp(-(odds + _logit(F.col("q_path")) - _logit(F.col("mean")))))
    judged = with_features(docs, cols, "_odds", w)
    on = F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path"))
    if sites.count() <= SMALL_SITES:
        scored = judged.join(F.broadcast(sites), on, "left")
    else:  # a site may hold a third of all rows, so texts are dealt out by site and salt
        salted = sites.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        scored = judged.withColumn("_salt1", F.pmod(F.xxhash64("_odds", "doc_id"), F.lit(SALTS))).join(
            salted, on & (F.col("_salt1") == F.col("_salt2")), "left"
        )
    return scored.select(
        *cols, (1 / (1 + F.exp(-odds))).alias("q_doc"), "q_host", "q_path", score.alias("q_score"), (score >= keep_from).alias("q_keep")
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with their own columns."""
    return score_quality(docs, labels, **options).where("q_keep").select(*docs.columns)
