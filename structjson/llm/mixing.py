"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Digits of exact sums, so that weights do not hang on the order in which tasks add up.
EXACT = "decimal(38, 22)"
#: Exponents that one pass over the sources tries.
TRIED = 16
#: Quotas of up to this many sources are broadcast to the documents.
SMALL_PLAN = 100_000
#: Parts into which a join with more quotas than that cuts each source.
SALTS = 64


def token_count(text: Column) -> Column:
    """Runs of other than blank, tab, LF, VT, FF and CR; 0 for null."""
    words = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(F.filter(words, lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def _entropy(live: DataFrame, total: int, exponents: list[float]) -> list[float]:
    """Entropy of the weights under each exponent, in nats, by one aggregation."""
    share = F.col("tokens") / F.lit(float(total))
    sums = []
    for k, e in enumerate(exponents):
        w = F.pow(share, F.lit(e))
        sums += [F.sum(w.cast(EXACT)).alias(f"z{k}"), F.sum((w * F.log(w)).cast(EXACT)).alias(f"s{k}")]
    row = live.agg(*sums).first()
    return [math.log(row[f"z{k}"]) - float(row[f"s{k}"]) / float(row[f"z{k}"]) for k in range(len(exponents))]


def exponent(live: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, passes: int = 12) -> tuple[float, int]:
    """The exponent in [0, 1] that meets the target, and the tokens of all sources.

    The entropy falls as the exponent grows: a pass tries ``TRIED - 1`` exponents
    that cut the interval evenly and keeps the part where the target is crossed, so
    the work grows with the sources alone and none is held by the driver. A limit
    on repetitions hangs on the largest and the smallest source only.
    """
    total, least, most, n = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    lo, hi = 0.0, 1.0
    if not n:
        return 1.0, 0
    if max_repeats is not None:
        # With budget max(size / weight), the rarest source is used max/min of size^(1 - e) times.
        ratio = math.log(most) - math.log(least)
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ratio * (1 - mid) > math.log(max_repeats) else (lo, mid)
        return hi, total
    goal = target_entropy * math.log(n)
    for _ in range(passes):
        step = (hi - lo) / TRIED
        tried = [lo + step * k for k in range(1, TRIED)]
        met = sum(h >= goal for h in _entropy(live, total, tried))  # the first ones, as entropy falls
        lo, hi = lo + step * met, lo + step * (met + 1)
    return lo, total


def source_weights(sizes: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> DataFrame:
    """``source, tokens, docs, share, weight``: shares to the power of an exponent in [0, 1], normalised.

    The exponent is bisected to the largest that reaches ``target_entropy`` (a
    fraction of the entropy of equal weights), or to the smallest that keeps the
    repetitions within ``max_repeats`` when the budget lets every source be used
    once in full. Weights are not rounded. Sources without tokens get none.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    live = sizes.where("tokens > 0")
    e, total = exponent(live, target_entropy, max_repeats)
    share = F.col("tokens") / F.lit(float(max(1, total)))
    raw = live.withColumn("share", share).withColumn("w", F.pow("share", F.lit(e)))
    norm = raw.agg(F.sum(F.col("w").cast(EXACT)).cast("double").alias("z"))  # one row
    return raw.crossJoin(F.broadcast(norm)).select("source", "tokens", "docs", "share", (F.col("w") / F.col("z")).alias("weight"))


def order_hash(seed: int, *cols: Column) -> Column:
    """48 bits of MD5 that order a permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 12), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    block_docs: int = 2000,
    seed: int = 0,
) -> DataFrame:
    """Realise the target weights over ``docs(doc_id, text, source)``.

    Adds to every chosen row ``mix_weight, mix_tokens, mix_epoch, mix_block,
    mix_order``. A source's quota is its weight times ``budget`` tokens; left out,
    the budget is the smallest at which every document is used at least once.
    The quota buys whole epochs, then a prefix of the source's permutation: its
    blocks (of about ``block_docs`` documents, cut by hash range) and, within the
    last one, its documents, as long as they fit. Sorting by ``mix_order`` gives a
    new permutation of blocks and of their documents in each epoch.

    Null text has no tokens; a null source is a source of its own. Documents
    without tokens come once in each epoch. Repeated rows share a place and stay
    together. Clashing extra columns named ``mix_*`` are replaced. An empty table
    gives no rows.
    """
    cols = [c for c in docs.columns if not c.startswith("mix_")]
    base = docs.select(*cols, token_count(F.col("text")).alias("mix_tokens"), order_hash(seed, F.coalesce(F.col("doc_id"), F.lit(-1))).alias("_h"))
    # Read several times below, so counted once.
    slim = written(base.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "mix_tokens", "_h"), "sizes")
    sizes = written(slim.groupBy("source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    weights = source_weights(sizes, target_entropy, max_repeats)
    need = weights.agg(F.max(F.ceil(F.col("tokens") / F.col("weight"))).cast("long").alias("least"))
    quota = (
        weights.crossJoin(F.broadcast(need))
        .withColumn("quota", F.floor(F.col("weight") * (F.lit(budget) if budget is not None else F.col("least"))).cast("long"))
        .withColumn("quota", F.when(F.lit(budget is None), F.greatest("quota", "tokens")).otherwise(F.col("quota")))
        .select("source", "weight", "tokens", "docs", F.expr("quota div tokens").alias("epochs"), F.expr("quota % tokens").alias("rest"))
    )
    span = 1 << 48
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long")
    block_of = F.expr("_h div _width")
    quota = quota.withColumn("_width", F.ceil(F.lit(span) / blocks).cast("long"))
    # The permutation's prefix: sums by block, then hashes of the one block that the rest ends in.
    # No join may deal documents out by source alone, as one source may have a third of them.
    quota = written(quota, "shares")
    small = quota.count() <= SMALL_PLAN
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    if small:
        keyed = slim.join(F.broadcast(quota), "source")
    else:
        keyed = slim.withColumn("_salt", F.col("_h") % SALTS).join(quota.select("*", salts.alias("_salt")), ["source", "_salt"])
    keyed = keyed.withColumn("block", block_of)
    sums = keyed.groupBy("source", "block", "rest").agg(F.sum("mix_tokens").alias("bt"))
    upto = F.sum("bt").over(Window.partitionBy("source").orderBy("block"))
    last = sums.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("bt")).alias("room")), "block").alias("e"))
    edge = last.select("source", F.col("e.block").alias("block"), F.col("e.room").alias("room"))
    if small:
        edge = F.broadcast(edge)
    inside = keyed.join(edge, ["source", "block"]).groupBy("source", "block", "room", "_h").agg(F.sum("mix_tokens").alias("ht"))
    run = F.sum("ht").over(Window.partitionBy("source", "block").orderBy("_h"))
    cut = inside.withColumn("run", run).where("run > room").groupBy("source").agg(F.min("_h").alias("cut"))
    plan = quota.join(cut, "source", "left").select(F.col("source").alias("_s"), "weight", "epochs", "_width", F.coalesce("cut", F.lit(0)).alias("_cut"))
    plan = written(plan, "quotas")
    base = base.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    if small:
        dealt = base.join(F.broadcast(plan), "_s", "left")
    else:  # texts are dealt out by source and salt, as a source may be hot
        dealt = base.withColumn("_salt", F.col("_h") % SALTS).join(plan.select("*", salts.alias("_salt")), ["_s", "_salt"], "left")
    times = F.col("epochs") + (F.col("_h") < F.col("_cut")).cast("long")
    chosen = (
        dealt.withColumn("_times", F.when(F.col("weight").isNull(), 1).otherwise(times))
        .where("_times > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))))
        .withColumn("mix_block", F.coalesce(block_of, F.lit(0).cast("long")))
    )
    order = F.concat_ws(
        "-", F.lpad(F.col("mix_epoch").cast("string"), 6, "0"),
        F.lpad(F.conv(order_hash(seed + 1, F.col("_s"), F.col("mix_epoch"), F.col("mix_block")).cast("string"), 10, 16), 12, "0"),
        F.lpad(F.conv(order_hash(seed + 2, F.col("mix_epoch"), F.coalesce(F.col("doc_id"), F.lit(-1))).cast("string"), 10, 16), 12, "0"),
    )
    return chosen.select(*cols, F.coalesce("weight", F.lit(0.0)).alias("mix_weight"), "mix_tokens", "mix_epoch", "mix_block", order.alias("mix_order"))
