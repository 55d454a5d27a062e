"""The opN_ queries: each applies its operator to its whole table, and derives the columns that are asked for."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compact, decontaminate, mix, multiindex, neardup, pii, suffix, toxicity, url_filter, wrapper
from .common import table, written

#: The pseudonyms' key here; a user of the operator passes a secret of their own.
DEMO_KEY = b"tessera-demo-key"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, number of values by kind, the spans, and the pseudonymised text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, DEMO_KEY)
    return out.select("doc_id", F.size("pii").cast("long").alias("n_values"), *(_count(k).alias(f"n_{k}") for k in pii.KINDS), F.col("pii").alias("spans"), "text")


def op2_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op4_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.near_passages(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(written(toxicity.labelled(docs, table(spark, sf_dir, "labels")), "labelled"))
    out = toxicity.score(docs, lexicon, into="score")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_multiindex, op3_minhash, op4_wrapper, op5_suffix, op6_mix, op7_compact, op8_toxicity, op9_url_filter, op10_decontaminate)}

_RULES = ", ".join(f"('{v}', '{e.partition('/')[0]}', '/{e.partition('/')[2]}', '{e}')" for v, e in RULES)
ORACLES = {
    "op9_url_filter": rf"""
WITH r(verdict, rhost, rpath, rule) AS (VALUES {_RULES}),
s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
t AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT t.page_id, max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(rhost) * 10000 + length(rpath)) AS x FROM t JOIN r ON (t.host = r.rhost OR ends_with(t.host, '.' || r.rhost)) AND starts_with(t.path, r.rpath) GROUP BY t.page_id)
SELECT t.page_id, t.host, t.path, m.x.rule AS rule, coalesce(m.x.verdict, 'allow') AS verdict FROM t LEFT JOIN m USING (page_id)""",
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS i FROM d JOIN ks ON len(d.w) >= ks.k)),
hits AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
