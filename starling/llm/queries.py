"""The registered queries of the corpus operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, line_dedup, lm, packing, sharding, simhash, toxicity, url_filters

URL_RULES = [
    url_filters.Rule("allow", "org", "/"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
rules(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, budget=4)
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


OP7_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT kind, r, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
s AS (SELECT kind, r, id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM w WHERE len(w) > 0),
b AS (SELECT r, id AS item_id, len(g) AS n_shingles, unnest(g) AS g FROM s WHERE kind = 'b'),
d AS (SELECT r, id AS doc_id, unnest(g) AS g FROM s WHERE kind = 'd'),
m AS (SELECT d.r AS dr, b.r AS br, doc_id, item_id, n_shingles, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY ALL),
k AS (SELECT * FROM m WHERE n_shared >= ceil(0.8::DOUBLE * n_shingles - 1e-9)),
p AS (SELECT doc_id, item_id, max({'c': n_shared::DOUBLE / n_shingles, 'n': n_shingles, 's': n_shared}) AS x FROM k GROUP BY doc_id, item_id)
SELECT doc_id, item_id, x.n AS n_shingles, x.s AS n_shared, x.c AS containment FROM p
"""

TOXICITY_CHAIN = ["quality", "toxic"]
TOXICITY_THRESHOLD = 0.4


def judge_toxicity(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs with p_quality, p_toxic and rejected, by a chain learned from the labelled documents of the corpus."""
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXICITY_CHAIN)
    return toxicity.score(docs, chain, "toxic", TOXICITY_THRESHOLD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected documents with the probabilities of the chain; every document is scored."""
    judged = judge_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), spark, sf_dir)
    return judged.where("rejected").select("doc_id", F.col("rejected").alias("toxic"), "p_quality", "p_toxic")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(table(spark, sf_dir, "documents"), train=~lm.held_out(F.col("doc_id")))
    return out.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lm.held_out(F.col("doc_id"), 4, 2)
    out = langid.predict(docs, langid.train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_learned_partition_ann": op4_learned_partition_ann,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_lm_scoring": op10_lm_scoring,
}
SQL = {"op1_url_filters": OP1_SQL, "op3_line_dedup": OP3_SQL, "op7_benchmark_decontamination": OP7_SQL}
