"""Latency and load analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: Upper bounds of the latency histogram in ms.
SLO_MS = [5, 10, 25, 50, 100, 250, 500, 1000, 2000]


def nearest_rank(column: str, p: float) -> Column:
    """A1: sorted[clamp(ceil(p n) - 1)]."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def percentiles(samples: DataFrame, value: str, by: list[str] | None = None, wanted: dict[str, float] | None = None) -> DataFrame:
    """A1, A2: count, min, avg, max and nearest-rank percentiles for each group."""
    ranks = [nearest_rank(value, p).alias(n) for n, p in (wanted or PERCENTILES).items()]
    aggregates = [F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("avg"), F.max(value).alias("max"), *ranks]
    return samples.groupBy(*by).agg(*aggregates) if by else samples.agg(*aggregates)


def latency_populations(requests: DataFrame) -> DataFrame:
    """A10: due_ns, start_ns, end_ns, status ('ok' or other) unfolded into (kind, ms), then A1 and A2 for each kind."""
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    ok = F.col("status") == "ok"
    kinds = F.array(
        F.struct(F.lit("service").alias("kind"), ms("start_ns", "end_ns").alias("ms")),
        F.struct(F.lit("service_ok").alias("kind"), F.when(ok, ms("start_ns", "end_ns")).alias("ms")),
        F.struct(F.lit("end_to_end").alias("kind"), ms("due_ns", "end_ns").alias("ms")),
        F.struct(F.lit("queue_wait").alias("kind"), ms("due_ns", "start_ns").alias("ms")),
    )
    return percentiles(requests.select(F.inline(kinds)).where("ms IS NOT NULL"), "ms", ["kind"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def accounting(requests: DataFrame, status: str, seconds: float) -> DataFrame:
    """Offered, rejected, accepted, completed, errors, skipped; rates over the generation window, 0 for zero denominators.
    status is one of ok, incomplete, error, rejected, skipped."""
    s = lambda *x: F.count_if(F.col(status).isin(*x))
    skipped, rejected = s("skipped"), s("rejected")
    offered = F.count("*") - skipped
    accepted = offered - rejected
    completed, ok, errors = s("ok", "incomplete"), s("ok"), s("error")
    window = F.lit(float(seconds))
    return requests.agg(
        offered.alias("offered"), rejected.alias("rejected"), accepted.alias("accepted"), completed.alias("completed"), ok.alias("successful"), errors.alias("errors"),
        _ratio(offered * F.lit(1.0), window).alias("offered_rps"), _ratio(completed * F.lit(1.0), window).alias("completed_rps"),
        _ratio(100.0 * rejected, offered).alias("rejected_pct"), _ratio(100.0 * s("incomplete"), completed).alias("incomplete_pct"),
        _ratio(skipped * F.lit(1.0), offered + skipped).alias("schedule_pressure"),
    )


def timeline(requests: DataFrame, elapsed: Column, buckets: int, latency: str = "latency_ms", status: str = "status") -> DataFrame:
    """Tumbling buckets from the phase's start; what is late goes to the last one."""
    bucket = F.least(F.floor(elapsed), F.lit(buckets - 1)).cast("long").alias("second")
    s = lambda *x: F.count_if(F.col(status).isin(*x))
    offered = F.count_if(F.col(status) != "skipped")
    return requests.groupBy(bucket).agg(
        offered.alias("offered"), (offered - s("rejected")).alias("accepted"), s("ok").alias("successful"), s("error").alias("errors"), s("incomplete").alias("incomplete"),
        F.coalesce(F.avg(F.when(F.col(status).isin("ok", "incomplete"), F.col(latency))), F.lit(0.0)).alias("avg_latency_ms"),
    )


def client_rollup(requests: DataFrame, client: str, latency: str, status: str, seconds: float) -> DataFrame:
    """A row for each client and one for all (client null); latencies over successes only."""
    ok = F.col(status) == "ok"
    good = F.when(ok, F.col(latency))
    samples = requests.withColumn("__good", good)
    ranks = [nearest_rank("__good", p).alias(n) for n, p in list(PERCENTILES.items())[:3]]
    return samples.rollup(client).agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("successes"), F.count_if(F.col(status) == "error").alias("errors"),
        (F.count_if(ok) / F.lit(float(seconds))).alias("qps"), F.avg("__good").alias("avg_ms"), *ranks,
    )


def client_spread(rollup: DataFrame, client: str) -> DataFrame:
    """Least, mean and largest rate of the clients."""
    return rollup.where(F.col(client).isNotNull()).agg(F.min("qps").alias("min_qps"), F.avg("qps").alias("avg_qps"), F.max("qps").alias("max_qps"))


def sequential_qps(samples: DataFrame, latency: str) -> DataFrame:
    """N over the sum of latencies (ms)."""
    return samples.agg((1000.0 * F.count(latency) / F.sum(latency)).alias("qps"))


def histogram(samples: DataFrame, value: str, bounds: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Cumulative buckets (le, n); the last bound is infinite."""
    bounds = bounds or SLO_MS
    cols = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds], F.struct(F.lit(float("inf")).alias("le"), F.count(value).alias("n")))
    grouped = samples.groupBy(*by).agg(cols.alias("h")) if by else samples.agg(cols.alias("h"))
    return grouped.select(*(by or []), F.inline("h"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Linear interpolation in the bucket that holds the rank; the highest finite bound beyond it."""
    arr = F.sort_array(F.collect_list(F.struct("le", "n")))
    g = buckets.groupBy(*by).agg(arr.alias("h")).withColumn("rank", F.lit(q) * F.element_at("h", -1)["n"])
    at = F.array_position(F.transform("h", lambda b: b["n"] >= F.col("rank")), True).cast("int")
    g = g.withColumn("at", at).withColumn("b", F.element_at("h", F.col("at")))
    low = F.when(F.col("at") == 1, F.lit(0.0)).otherwise(F.get("h", F.col("at") - 2)["le"])
    under = F.when(F.col("at") == 1, F.lit(0)).otherwise(F.get("h", F.col("at") - 2)["n"])
    inside = low + (F.col("b.le") - low) * (F.col("rank") - under) / (F.col("b.n") - under)
    return g.select(*by, F.when(F.element_at("h", -1)["n"] == 0, None).when(F.col("b.le") == float("inf"), low).otherwise(inside).alias("value"))


def rate(counter_events: DataFrame, ts: str, window: str = "1 minute") -> DataFrame:
    """Events a second in tumbling windows."""
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return counter_events.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def client_of(query_index: Column, clients: int) -> Column:
    """The client that takes a query."""
    return F.pmod(query_index, F.lit(clients))
