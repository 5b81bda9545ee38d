"""The pipeline operators as queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, html, images, jaccard, lm, mixing, packing, quality, urls, warc
from .common import fresh_path

TOKENIZER = "word_bpe_49k.json"
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, small sources repeated at most twice."""
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=2.0).select(
        "doc_id", "source", "mix_weight", "mix_tokens", "mix_epoch", "mix_block", "mix_order"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path."""
    pages = table(spark, sf_dir, "pages")
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[/.?#]|\\z)', 1) as bigint)")
    docs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_doc"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1.0).otherwise(0.0).alias("bad"))
    labels = pages.select("page_id", number.alias("_doc")).join(docs, "_doc").select("page_id", "bad")
    return urls.filter_urls(pages, labels, URL_RULES)


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images; each vector is rendered as one, so near vectors are edited copies."""
    return images.image_copies(images.rendered(table(spark, sf_dir, "embeddings"))).withColumnRenamed("image_id", "vec_id")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels).select("doc_id", "source", "lang", "q_doc", "q_host", "q_path", "q_score", "q_keep")


def op7_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), size=4, similarity=0.85)


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can say: hosts, paths and explicit rules."""
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    name, says = urls.rule_for(host, path, URL_RULES)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), name.alias("rule"), says.alias("verdict"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_url_filter, op3_image_copies, op4_main_text, op5_best_fit_packing, op6_quality_classifier,
        op7_masked_lm_score, op8_ngram_jaccard_join, op9_embedding_near_duplicates, op10_warc_round_trip, url_rules,
    )
}

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_UPPER, _LOWER = f"'{urls.UPPER}'", f"'{urls.LOWER}'"
_FITS = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS says, '{r.partition('/')[0]}' AS rh, '/{r.partition('/')[2]}' AS rp" for r, v in URL_RULES.items())
_REACH = """near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

ORACLE_SQL: dict[str, str] = {
    "url_rules": f"""WITH p AS (SELECT page_id, coalesce({_REST}, '') AS r FROM pages),
q AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), {_UPPER}, {_LOWER}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules AS ({_FITS}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS verdict FROM q JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM q LEFT JOIN best USING (page_id)""",
    "op8_ngram_jaccard_join": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
sizes AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sets), items AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
met AS MATERIALIZED (SELECT i.doc_id AS a, j.doc_id AS b, count(*) AS k FROM items i JOIN items j ON i.x = j.x AND i.doc_id < j.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
{_REACH}
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sizes LEFT JOIN least ON a = doc_id""",
    "op9_embedding_near_duplicates": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  AND len([x FOR x IN embedding IF x <> 0]) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE v IS NOT NULL),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id < q.vec_id WHERE len(p.v) = len(q.v) AND list_dot_product(p.v, q.v) / p.norm / q.norm >= 0.9),
{_REACH}, many AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM e LEFT JOIN least ON least.a = vec_id LEFT JOIN many ON many.a = vec_id""",
    "op10_warc_round_trip": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to FROM q""",
}
