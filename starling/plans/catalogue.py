"""Registered queries over the reference workload, with their SQL oracles.

Searches take as queries all rows whose id is divisible by 50, against all rows. Deleted and changed vectors are given by a
label, so that whole tables are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.embed import embedder
from ..operators import loadstats, overlay, quality, search, stats
from ..schema import from_embeddings

K = 10
GONE, CHANGED = 3, 7  # labels whose vectors are deleted or re-pointed in the overlay queries


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return from_embeddings(_t(spark, d, "embeddings"))


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _coarse(vectors: DataFrame) -> DataFrame:
    """Vectors of few levels: a deterministic approximation whose recall can be measured."""
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 8).cast("float")))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return search.exact(v, _queries(v), K)


def _approx(spark: SparkSession, d: str) -> DataFrame:
    c = _coarse(_vectors(spark, d))
    return search.exact(c, _queries(c), K)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """events as a request log: value is the latency."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "rejected").when(F.col("event_type") == "view", "incomplete").when(F.col("event_type") == "click", "skipped").otherwise("ok")
    return _t(spark, d, "events").withColumn("status", status).withColumn("latency_ms", F.col("value"))


# ------------------------------------------------------------------ SQL pieces

COS = "list_cosine_distance(q.{0}::DOUBLE[], v.{0}::DOUBLE[])"
COSINE = f"CASE WHEN isnan({COS}) THEN 1.0::DOUBLE ELSE {COS} END".format("e")
SUMSQ = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, v.e), lambda z: {0})), lambda p, s: p + s)"
L2 = "sqrt(" + SUMSQ.format("(z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE") + ")"
F32 = "1.0::DOUBLE - {0} / (sqrt({1}) * sqrt({2}))".format(SUMSQ.format("(z[1] * z[2])::DOUBLE"), SUMSQ.format("(z[1] * z[1])::DOUBLE"), SUMSQ.format("(z[2] * z[2])::DOUBLE"))
ROWS = "e AS (SELECT vec_id AS id, embedding AS e, label FROM embeddings)"
COARSE = "c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x * 8)::FLOAT) AS e, label FROM embeddings)"


def _ranked(name: str, dist: str = COSINE, source: str = "e", queries: str = "e", k: int = K, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position
  FROM (SELECT q.id AS query_id, v.id, {dist} AS distance FROM {queries} q CROSS JOIN {source} v WHERE q.id % 50 = 0 AND {where})) WHERE position <= {k})"""


TOP = f"WITH {ROWS}, {_ranked('r')} "
BOTH = f"WITH {ROWS}, {COARSE}, {_ranked('t')}, {_ranked('a', source='c', queries='c')}, cut AS (SELECT query_id, max(distance) AS cutoff FROM t GROUP BY query_id)"
PER = f"""{BOTH}, m AS (SELECT a.*, t.distance AS td, cutoff FROM a JOIN cut USING (query_id) LEFT JOIN t ON a.query_id = t.query_id AND a.id = t.id),
per AS (SELECT query_id, count(td) AS id_matches, count(*) FILTER (distance <= cutoff + 1e-6 * greatest(1.0, abs(cutoff))) AS distance_matches, count(*) AS returned,
  avg(abs(distance - td)) AS mean_error, max(abs(distance - td)) AS max_error FROM m GROUP BY query_id)"""
STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'rejected' WHEN 'view' THEN 'incomplete' WHEN 'click' THEN 'skipped' ELSE 'ok' END"
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ search


@query(TOP + "SELECT r.query_id, r.position, r.id, r.distance, 'vec://' || r.id AS url, e.label FROM r JOIN e USING (id)")
def knn_cosine_top10(spark, d):
    """Late materialisation, the payload is joined to the winners."""
    v = _vectors(spark, d)
    return search.exact(v, _queries(v), K).join(v.select("id", "url", "label"), "id").select("query_id", "position", "id", "distance", "url", "label")


@query(f"WITH {ROWS}, {_ranked('r', L2)} SELECT query_id, position, id, distance FROM r")
def knn_euclidean_top10(spark, d):
    """T6, F3."""
    v = _vectors(spark, d)
    return search.exact(v, _queries(v), K, "euclidean")


@query(f"WITH {ROWS}, {_ranked('r', F32)} SELECT query_id, position, id, distance FROM r")
def knn_cosine_f32_top10(spark, d):
    """F2."""
    v = _vectors(spark, d)
    return search.exact(v, _queries(v), K, "cosine_f32")


@query(TOP + "SELECT query_id, position, id, distance FROM r")
def knn_partitioned_merge(spark, d):
    """Equal to the global ranking."""
    v = _vectors(spark, d)
    return search.partitioned(v, _queries(v), K, F.pmod("id", F.lit(32)))


@query(TOP + "SELECT query_id, position, id, distance FROM r")
def knn_blocked_top10(spark, d):
    """T1-T5 with matrix products in tasks of bounded size and exact scores."""
    v = _vectors(spark, d)
    return search.blocked(v, _queries(v), K)


@query(TOP + "SELECT query_id, position, id, distance FROM r")
def knn_dedup_min(spark, d):
    """T4: the same candidates from two places."""
    once = search.exact(_vectors(spark, d), _queries(_vectors(spark, d)), K).drop("position")
    return search.merge([once, once.withColumn("distance", F.col("distance") + 1)], K)


@query(f"WITH {ROWS}, {_ranked('r', k=30)}, h AS (SELECT r.query_id, r.id, r.distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, r.id) AS position FROM r JOIN e USING (id) WHERE label <> {GONE}) SELECT query_id, position, id, distance AS score, 'vec://' || id AS url FROM h WHERE position <= {K}")
def knn_hydrated_backfill(spark, d):
    """Candidates taken before deletions, refilled from further ones."""
    v = _vectors(spark, d)
    return search.hydrate(search.exact(v, _queries(v), 3 * K), v.where(F.col("label") != GONE), K).drop("metadata")


@query(f"WITH {ROWS}, {_ranked('r', where=f'v.label <> {GONE}')} SELECT query_id, position, id, distance FROM r")
def knn_prefiltered(spark, d):
    """Excluded ids never enter the ranking."""
    v = _vectors(spark, d)
    return search.exact(search.without(v, v.where(F.col("label") == GONE)), _queries(v), K)


@query(f"WITH {ROWS}, l AS (SELECT id, CASE WHEN label = {CHANGED} THEN list_transform(e, lambda x: -x) ELSE e END AS e FROM e WHERE label <> {GONE}), {_ranked('r', source='l')} SELECT query_id, position, id, distance FROM r")
def knn_overlay_live(spark, d):
    """Base under tombstones and pending re-puts."""
    v = _vectors(spark, d)
    cols = ["id", "vector", "url", "metadata"]
    op = F.when(F.col("label") == GONE, "DELETE").otherwise("PUT")
    changes = v.where(F.col("label").isin(GONE, CHANGED)).select(F.lit(1).cast("long").alias("seq"), op.alias("op"), "id", F.transform("vector", lambda x: -x).alias("vector"), "url", "metadata")
    return search.exact(overlay.live(v.select(*cols), changes), _queries(v), K)


@query(f"WITH {ROWS}, {_ranked('r', where='v.label = q.label')} SELECT query_id, position, id, distance FROM r")
def knn_label_filter(spark, d):
    """Extension: a predicate on the payload before the ranking."""
    v = _vectors(spark, d)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "label")
    return search.exact(v, queries, K, same="label")


@query()
def knn_graph_top10(spark, d):
    """Approximate; recall is tested against the exact engine."""
    v = _vectors(spark, d)
    return search.graph(v, _queries(v), K)


@query()
def knn_ivf_top10(spark, d):
    v = _vectors(spark, d)
    return search.ivf(v, _queries(v), K)


@query(f"WITH {ROWS} SELECT q.id AS query_id, v.id, {COSINE} AS distance FROM e q CROSS JOIN e v WHERE q.id % 50 = 0")
def query_distances(spark, d):
    """The distances of the query set to all rows."""
    v = _vectors(spark, d)
    return search.score(v, _queries(v))


@query(f"WITH {ROWS}, {_ranked('r', k=5)} SELECT query_id, id, printf('%.1f', 100.0 * (1.0 - distance)) AS percent FROM r")
def similarity_percent(spark, d):
    """F5."""
    v = _vectors(spark, d)
    return search.exact(v, _queries(v), 5).select("query_id", "id", V.similarity_percent(F.col("distance")).alias("percent"))


# ------------------------------------------------------------------ store


@query("SELECT vec_id AS id, 'vec://' || vec_id AS url, label FROM embeddings WHERE vec_id = 7")
def get_by_id(spark, d):
    """S3: the id reaches the scan as a pushed filter."""
    return _vectors(spark, d).where("id = 7").select("id", "url", "label")


@query("SELECT DISTINCT vec_id AS id, label FROM embeddings JOIN (SELECT DISTINCT user_id * 7 AS id FROM events) u ON u.id = vec_id")
def multi_get_missing(spark, d):
    """Ids without a row are absent."""
    wanted = _t(spark, d, "events").select((F.col("user_id") * 7).alias("id")).distinct()
    return _vectors(spark, d).select("id", "label").join(wanted, "id").distinct()


@query("SELECT user_id AS id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def latest_per_key(spark, d):
    """Events as the feed, errors delete."""
    last = overlay.latest(_t(spark, d, "events").withColumnRenamed("user_id", "id"), "id", ["ts", "event_id"])
    return last.where("event_type <> 'error'").select("id", "event_id", "value")


@query("""WITH w AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id AS id, count(*) AS puts, count(*) FILTER (event_type = before) AS skipped FROM w GROUP BY user_id""")
def noop_put_dedup(spark, d):
    """Puts that repeat the key's value."""
    changes = _t(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.lit("PUT").alias("op"), F.col("event_type").alias("vector"))
    return overlay.effective(changes, "id", ["ts", "event_id"]).groupBy("id").agg(F.count("*").alias("puts"), F.count_if("noop").alias("skipped"))


PARTS = f"""WITH p AS (SELECT vec_id % 32 AS part, count(*) AS size, count(*) FILTER (label = {CHANGED}) AS pending, count(*) FILTER (label IN ({GONE}, {CHANGED})) AS tombstones FROM embeddings GROUP BY 1),
s AS (SELECT part, size, pending, tombstones, size - tombstones + pending AS live, size * (2 * (16 + 4 * 64) + 2 * 32 * 4 + 150) AS memory_bytes,
  pending >= greatest(256, ceil(size * 0.10::DOUBLE)) OR tombstones >= size * 0.20::DOUBLE AS due FROM p)"""


@query(PARTS + " SELECT part::BIGINT AS part, size, pending, tombstones, live, memory_bytes, due FROM s")
def partition_stats(spark, d):
    """A15, F15, X10, §2.9."""
    v = _vectors(spark, d).withColumn("part", F.pmod("id", F.lit(32)))
    return stats.partition_stats(v, v.where(F.col("label") == CHANGED), v.where(F.col("label").isin(GONE, CHANGED)), 64)


@query(PARTS + " SELECT count(*) AS partitions, sum(live)::BIGINT AS live, sum(pending)::BIGINT AS pending, sum(tombstones)::BIGINT AS tombstones, sum(memory_bytes)::BIGINT AS memory_bytes, count(*) FILTER (due) AS due FROM s")
def cluster_stats(spark, d):
    return stats.cluster_stats(partition_stats(spark, d))


@query(PARTS + " SELECT part::BIGINT AS part, due FROM s")
def compaction_decision(spark, d):
    """X10."""
    return partition_stats(spark, d).select("part", "due")


@query(PARTS + " SELECT count(*) FILTER (NOT due) AS active, count(*) AS total, count(*) FILTER (NOT due) / count(*)::DOUBLE AS coverage, count(*) FILTER (due) > 0 AS partial FROM s")
def coverage_ratio(spark, d):
    """Partitions due for compaction count as inactive here."""
    return stats.coverage(partition_stats(spark, d).select("part", (~F.col("due")).alias("active")))


@query("SELECT label, count(*) * (2 * (16 + 4 * 64) + 2 * 32 * 4 + 150) AS graph_bytes, count(*) * (16 + 4 * 64 + 100) AS brute_bytes FROM embeddings GROUP BY label")
def memory_estimate(spark, d):
    """F15."""
    n = _vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", V.memory_estimate(F.col("n"), 64).alias("graph_bytes"), V.memory_estimate(F.col("n"), 64, "brute").alias("brute_bytes"))


@query("SELECT user_id AS id, max(event_id) AS line, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def bulk_load_last_wins(spark, d):
    """S6e: of repeated ids the last line."""
    rows = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("line"), "value")
    return overlay.latest(rows, "id", ["line"])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) + (SELECT max(vec_id) FROM embeddings) AS id FROM documents")
def id_assignment(spark, d):
    """Ids for new rows after the largest one."""
    top = _vectors(spark, d).agg(F.max("id")).first()[0]
    return overlay.assign_ids(_t(spark, d, "documents").select("doc_id"), "doc_id", top)


@query("SELECT max(vec_id) AS max_id, count(*) AS n FROM embeddings")
def max_id(spark, d):
    """A14, A15."""
    return _vectors(spark, d).agg(F.max("id").alias("max_id"), F.count("*").alias("n"))


@query("SELECT page_id, coalesce(starts_with(url, 'http://') OR starts_with(url, 'https://'), false) AS link FROM pages")
def link_predicate(spark, d):
    """P6."""
    return _t(spark, d, "pages").select("page_id", V.is_link(F.col("url")).alias("link"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'unknown') AS source FROM events")
def metadata_source(spark, d):
    """F6."""
    return _t(spark, d, "events").select("event_id", V.metadata_source(F.col("props"), "k").alias("source"))


@query("SELECT vec_id AS id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda p, s: p + s)) AS norm FROM embeddings")
def vector_norms(spark, d):
    """F8."""
    return _vectors(spark, d).select("id", V.norm(F.col("vector")).alias("norm"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 40) || '... (' || length(text) || ' chars total)' END AS short FROM documents")
def truncated_text(spark, d):
    """F12."""
    return _t(spark, d, "documents").select("doc_id", V.truncate_text(F.col("text"), 40).alias("short"))


@query("SELECT event_type, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY event_type")
def largest_by(spark, d):
    """T9."""
    return _t(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query()
def embed_benchmark_text(spark, d):
    """F9, §2.11: search by text with the stand-in model."""
    items = _t(spark, d, "benchmark").where("text IS NOT NULL AND trim(text) <> ''")
    queries = items.select(F.col("item_id").alias("query_id"), embedder(dim=64)(F.col("text")).alias("vector"))
    return search.blocked(_vectors(spark, d), queries, 5)


# ------------------------------------------------------------------ quality


@query(f"{PER} SELECT query_id, id_matches, id_matches / {K}::DOUBLE AS recall FROM per")
def recall_at_k(spark, d):
    """A4, J3."""
    return quality.compare(_approx(spark, d), _truth(spark, d), K).select("query_id", "id_matches", "recall")


@query(f"{PER} SELECT query_id, distance_matches, distance_matches / {K}::DOUBLE AS distance_recall FROM per")
def distance_recall_at_k(spark, d):
    """A4, F14."""
    return quality.compare(_approx(spark, d), _truth(spark, d), K).select("query_id", "distance_matches", "distance_recall")


@query(f"{PER} SELECT query_id, round(mean_error, 9) AS mean_error, max_error FROM per")
def distance_error(spark, d):
    """A6."""
    return quality.compare(_approx(spark, d), _truth(spark, d), K).select("query_id", F.round("mean_error", 9).alias("mean_error"), "max_error")


@query(f"""{PER} SELECT count(*) AS queries, round(avg(id_matches / {K}::DOUBLE), 9) AS recall, round(avg(distance_matches / {K}::DOUBLE), 9) AS distance_recall,
  count(*) FILTER (id_matches = {K}) AS perfect, count(*) FILTER (id_matches = {K}) / count(*)::DOUBLE AS perfect_rate, count(*) FILTER (distance_matches = {K}) AS distance_perfect,
  count(*) FILTER (distance_matches = {K}) / count(*)::DOUBLE AS distance_perfect_rate, count(*) FILTER (returned <> {K}) AS incomplete FROM per""")
def perfect_queries(spark, d):
    """A3-A5, A7."""
    s = quality.summary(quality.compare(_approx(spark, d), _truth(spark, d), K), K)
    return s.withColumn("recall", F.round("recall", 9)).withColumn("distance_recall", F.round("distance_recall", 9))


@query(f"{BOTH} SELECT query_id, 'missing' AS kind, id FROM (SELECT query_id, id FROM t EXCEPT SELECT query_id, id FROM a) UNION ALL SELECT query_id, 'unexpected', id FROM (SELECT query_id, id FROM a EXCEPT SELECT query_id, id FROM t)")
def mismatch_report(spark, d):
    """J5, U2."""
    return quality.mismatches(_approx(spark, d), _truth(spark, d), K)


@query(f"WITH {ROWS}, {_ranked('r', where='v.label = q.label')} SELECT query_id, count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (isnan(distance)) AS bad FROM r GROUP BY query_id HAVING count(*) <> {K} OR count(DISTINCT id) <> count(*) OR count(*) FILTER (isnan(distance)) > 0")
def result_contract(spark, d):
    """T8 over the filtered search."""
    return quality.broken_contracts(knn_label_filter(spark, d), K)


@query(f"{BOTH} SELECT count(*) AS queries, count(*) FILTER (t.id = a.id) AS same, count(*) FILTER (t.id = a.id) / count(*)::DOUBLE AS agreement FROM t LEFT JOIN a ON t.query_id = a.query_id AND a.position = 1 WHERE t.position = 1")
def first_result_agreement(spark, d):
    """A13."""
    return quality.first_result_agreement(_approx(spark, d), _truth(spark, d))


# ------------------------------------------------------------------ load analytics


@query("SELECT event_type, count(value) AS n, min(value) AS min, round(avg(value), 6) AS avg, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    """A1, A2."""
    return loadstats.percentiles(_t(spark, d, "events"), "value", ["event_type"]).withColumn("avg", F.round("avg", 6))


@query(f"""WITH r AS (SELECT {STATUS} AS status FROM events),
c AS (SELECT count(*) FILTER (status = 'skipped') AS sk, count(*) FILTER (status <> 'skipped') AS offered, count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status IN ('ok', 'incomplete')) AS completed, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'incomplete') AS inc FROM r)
SELECT offered, rejected, offered - rejected AS accepted, completed, successful, errors, offered / 60.0::DOUBLE AS offered_rps, completed / 60.0::DOUBLE AS completed_rps,
  100.0::DOUBLE * rejected / offered AS rejected_pct, 100.0::DOUBLE * inc / completed AS incomplete_pct, sk / (offered + sk)::DOUBLE AS schedule_pressure FROM c""")
def load_accounting(spark, d):
    """A9."""
    return loadstats.accounting(_events(spark, d), "status", 60.0)


@query(f"""WITH r AS (SELECT ts, value, {STATUS} AS status FROM events)
SELECT least(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000), 599)::BIGINT AS second, count(*) FILTER (status <> 'skipped') AS offered, count(*) FILTER (status NOT IN ('skipped', 'rejected')) AS accepted,
  count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'incomplete') AS incomplete,
  round(coalesce(avg(value) FILTER (status IN ('ok', 'incomplete')), 0.0), 6) AS avg_latency_ms FROM r GROUP BY 1""")
def timeline_buckets(spark, d):
    """A8 with buckets of an hour, the last one taking what is later."""
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3_600_000_000
    return loadstats.timeline(_events(spark, d), elapsed, 600).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query(f"""WITH r AS (SELECT user_id % 8 AS client, value, {STATUS} AS status FROM events)
SELECT coalesce(client::VARCHAR, 'all') AS client, count(*) AS requests, count(*) FILTER (status = 'ok') AS successes, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'ok') / 60.0::DOUBLE AS qps, round(avg(value) FILTER (status = 'ok'), 6) AS avg_ms,
  quantile_disc(value, 0.5) FILTER (status = 'ok') AS p50, quantile_disc(value, 0.95) FILTER (status = 'ok') AS p95, quantile_disc(value, 0.99) FILTER (status = 'ok') AS p99 FROM r GROUP BY ROLLUP (client)""")
def client_rollup(spark, d):
    """Clients by user id."""
    r = _events(spark, d).withColumn("client", loadstats.client_of(F.col("user_id"), 8))
    return loadstats.client_rollup(r, "client", "latency_ms", "status", 60.0).withColumn("avg_ms", F.round("avg_ms", 6)).withColumn("client", F.coalesce(F.col("client").cast("string"), F.lit("all")))


@query("SELECT round(1000.0 * count(value) / sum(value), 6) AS qps FROM events")
def sequential_qps(spark, d):
    """A12."""
    return loadstats.sequential_qps(_t(spark, d, "events"), "value").select(F.round("qps", 6).alias("qps"))


_LE = ", ".join(f"({b}.0::DOUBLE)" for b in loadstats.SLO_MS) + ", ('Infinity'::DOUBLE)"
_HIST = f"WITH b(le) AS (VALUES {_LE}), h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events CROSS JOIN b GROUP BY 1, 2)"


@query(_HIST + " SELECT event_type, le, n FROM h")
def latency_histogram(spark, d):
    """Cumulative buckets over the SLO bounds."""
    return loadstats.histogram(_t(spark, d, "events"), "value", by=["event_type"])


@query(_HIST + """, t AS (SELECT *, 0.95 * max(n) OVER (PARTITION BY event_type) AS rank, lag(le, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS low, lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY le) AS under FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS o FROM t WHERE n >= rank)
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank::DOUBLE - under) / (n - under) END, 6) AS value FROM f WHERE o = 1""")
def histogram_quantile(spark, d):
    """A17."""
    h = loadstats.histogram(_t(spark, d, "events"), "value", by=["event_type"])
    return loadstats.histogram_quantile(h, 0.95, ["event_type"]).withColumn("value", F.round("value", 6))


@query("SELECT (epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) // 1000000)::BIGINT AS start, count(*) AS n, round(count(*) / 60.0::DOUBLE, 9) AS per_second FROM events GROUP BY time_bucket(INTERVAL 1 MINUTE, ts)")
def rate_1m(spark, d):
    """A17."""
    r = loadstats.rate(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return r.select(F.unix_seconds("start").alias("start"), "n", F.round("per_second", 9).alias("per_second"))


@query("SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS position, event_id FROM events")
def positions(spark, d):
    """K7: ranks from 1."""
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return _t(spark, d, "events").select("event_type", F.row_number().over(w).cast("long").alias("position"), "event_id")
