"""URL filter: explicit rules, then a path-template tree with labelled purity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups that siblings with rates of their own merge into: equal steps of the arcsine of the rate's root.
RATES = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule ``host/path`` fits its host and all subdomains where the URL's path
    starts with the rule's. Of equally long ones the alphabetically first wins.
    """
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules.items(), key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def shaped(path: Column) -> Column:
    """Path segments with their plainly variable parts as wildcards."""
    kinds = [
        (r"(?<=/)[0-9a-f]{8}-[0-9a-f-]{27}(?=[/.]|\z)", "{uuid}"),
        (r"(?<=/)(?=[a-z]*[0-9])[0-9a-f]{12,}(?=[/.]|\z)", "{hex}"),
        (r"[0-9]+", "{n}"),
    ]
    return reduce(lambda p, k: F.regexp_replace(p, *k), kinds, path)


def _names(child: DataFrame, max_children: int, z: float) -> DataFrame:
    """``host, template, seg, name`` of the siblings ``seg`` below each node.

    A sibling has a rate of its own if a two-proportion test tells its labels from
    those of all its other siblings; such ones merge by ``RATES`` steps of their
    rate, and all others with each other. What merges is named after its members, or
    by a wildcard if they are more than ``max_children``.
    """
    b, n, rb, rn = F.col("cb"), F.col("cl"), F.col("nb") - F.col("cb"), F.col("nl") - F.col("cl")
    rate, other, pool = b / n, rb / rn, F.col("nb") / F.col("nl")
    own = F.abs(rate - other) > z * F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-4)) * (1 / n + 1 / rn))
    step = F.least(F.lit(RATES - 1), F.floor(F.asin(F.sqrt(rate)) / (math.pi / 2) * RATES)).cast("int")
    told = F.when((n > 0) & (rn > 0) & own, step).otherwise(F.lit(-1))
    grouped = written(child.select("host", "template", "seg", told.alias("told")), "siblings")
    key = ["host", "template", "told"]
    sizes = grouped.groupBy(*key).agg(F.count("*").alias("kids"))
    lists = grouped.join(sizes.where(F.col("kids") <= max_children), key).groupBy(*key).agg(F.sort_array(F.collect_list("seg")).alias("segs"))
    listed = F.when(F.size("segs") == 1, F.col("segs")[0]).otherwise(F.concat(F.lit("("), F.array_join("segs", "|"), F.lit(")")))
    wild = F.when(F.col("told") < 0, F.lit("*")).otherwise(F.concat(F.lit("*~"), F.col("told").cast("string")))
    return grouped.join(sizes.join(lists, key, "left"), key).select("host", "template", "seg", F.coalesce(listed, wild).alias("name"))


def templates(shapes: DataFrame, max_children: int, z: float) -> DataFrame:
    """Adds ``template`` to ``shapes(host, shape, n, bad, labelled)``, level by level.

    A node whose labels are all good or all bad, or that holds one shape, is not cut
    further, as no test could tell its branches apart; what lies below it is ``/**``.
    Levels go on until no other node is left.
    """
    rest, level, done = shapes.withColumn("template", F.lit("")), 0, []
    while True:
        level += 1
        seg = F.get(F.split("shape", "/"), F.lit(level))
        node = rest.groupBy("host", "template").agg(F.sum("bad").alias("nb"), F.sum("labelled").alias("nl"), F.count("*").alias("many"))
        mixed = node.where("nb > 1e-9 and nb < nl - 1e-9 and many > 1").drop("many")
        now = written(rest.join(mixed, ["host", "template"], "left").withColumn("seg", seg), "templates")
        ended = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/**")))
        done.append(now.where("nl is null or seg is null").select("host", "shape", "n", "bad", "labelled", ended.alias("template")))
        cut = now.where("nl is not null and seg is not null")
        if cut.isEmpty():
            return reduce(DataFrame.union, done)
        child = cut.groupBy("host", "template", "seg", "nb", "nl").agg(F.sum("bad").alias("cb"), F.sum("labelled").alias("cl"))
        named = cut.join(_names(child, max_children, z), ["host", "template", "seg"])
        rest = named.select("host", "shape", "n", "bad", "labelled", F.concat("template", F.lit("/"), "name").alias("template"))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame | None,
    rules: dict[str, str],
    id_col: str = "page_id",
    max_children: int = 24,
    z: float = 2.58,
    prior: float = 12.0,
    reject_from: float = 0.6,
    base_rate: float = 0.1,
) -> DataFrame:
    """Judge the ``url`` of every row of ``pages``: ``id, url, host, path, rule, template, purity, verdict``.

    Where a rule fits, its verdict holds. Elsewhere the host's tree of path
    templates decides: a template is blocked if its share of bad labels, smoothed
    by ``prior`` labels at its host's rate (itself smoothed towards the rate of all
    labels, and that towards ``base_rate``), reaches ``reject_from``. ``labels(id, bad)`` says which rows are known
    good (0) or bad (1) and may be None; nothing else counts against a URL. A URL
    without a host is allowed.

    In the tree, numbers, hashes and UUIDs in a path are wildcards. Siblings keep
    apart if their labels differ by ``z`` standard errors from the rest of their
    node, else they merge; more than ``max_children`` merged ones become a wildcard.
    All segments of a path count as far as labels below its node differ.

    Null or malformed URLs give an empty host and path and no rule. Repeated rows
    are judged each; repeated labels of an id count by their mean, null labels and
    ids not at all. Statistics are over all rows, aggregated before they are
    shuffled. Other columns of ``pages`` are left out; an empty table gives no rows.
    """
    url = F.col("url")
    parsed = pages.select(F.col(id_col).alias("_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("shape", shaped(F.col("path")))
    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"))
    if labels is not None:
        known = labels.where(F.col("bad").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col("bad").cast("double")).alias("_bad"))
        strong = parsed.select("_id", "host", "shape").join(known, "_id").groupBy("host", "shape").agg(F.sum("_bad").alias("bad"), F.count("_bad").cast("double").alias("labelled"))
        shapes = shapes.join(strong, ["host", "shape"], "left").fillna(0.0, ["bad", "labelled"])
    else:
        shapes = shapes.withColumn("bad", F.lit(0.0)).withColumn("labelled", F.lit(0.0))
    shapes = written(shapes, "shapes")
    bad, labelled = shapes.agg(F.sum("bad"), F.sum("labelled")).first()
    overall = ((bad or 0.0) + base_rate * prior) / ((labelled or 0.0) + prior)
    t = written(templates(shapes, max_children, z), "templates")
    by_host = t.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("labelled").alias("hl")).select(
        "host", ((F.col("hb") + prior * overall) / (F.col("hl") + prior)).alias("host_rate")
    )
    rates = (
        t.groupBy("host", "template").agg(F.sum("bad").alias("tb"), F.sum("labelled").alias("tl")).join(by_host, "host")
        .select("host", "template", ((F.col("tb") + prior * F.col("host_rate")) / (F.col("tl") + prior)).alias("purity"))
    )
    judged = written(t.select("host", "shape", "n", "template").join(rates, ["host", "template"]), "judged")
    drop_written(shapes)
    name, says = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("host") != "") & (F.col("purity") >= reject_from), "block").otherwise("allow")
    return spread_join(parsed, judged, ["host", "shape"], "n", F.xxhash64("_id", "url")).select(
        F.col("_id").alias(id_col), "url", "host", "path", name.alias("rule"), "template", "purity", F.coalesce(says, method).alias("verdict")
    )
