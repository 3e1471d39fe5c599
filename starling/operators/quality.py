"""Quality of results against a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import tolerance


def compare(actual: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """For each query of the truth: id matches, distance matches (within the k-th true distance and its tolerance),
    result size, both recalls, and the mean and largest absolute distance error over matched ids."""
    t = truth.where(F.col("position") <= k).select("query_id", "id", F.col("distance").alias("true_distance"), "position")
    cutoff = t.groupBy("query_id").agg(F.max("true_distance").alias("cutoff"))
    a = actual.where(F.col("position") <= k).select("query_id", "id", "distance")
    met = a.join(t.select("query_id", "id", "true_distance"), ["query_id", "id"], "left")
    error = F.abs(F.col("distance") - F.col("true_distance"))
    met = met.join(cutoff, "query_id")
    per = met.groupBy("query_id").agg(
        F.count("true_distance").alias("id_matches"),
        F.count_if(F.col("distance") <= F.col("cutoff") + tolerance(F.col("cutoff"))).alias("distance_matches"),
        F.count("*").alias("returned"),
        F.avg(error).alias("mean_error"),
        F.max(error).alias("max_error"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = cutoff.select("query_id").join(per, "query_id", "left").select("query_id", zero("id_matches"), zero("distance_matches"), zero("returned"), "mean_error", "max_error")
    return out.withColumn("recall", F.col("id_matches") / k).withColumn("distance_recall", F.col("distance_matches") / k)


def summary(compared: DataFrame, k: int) -> DataFrame:
    """A3-A7 over all queries."""
    n = F.count("*")
    share = lambda c: c / F.greatest(n, F.lit(1))
    perfect, near = F.count_if(F.col("id_matches") == k), F.count_if(F.col("distance_matches") == k)
    return compared.agg(
        n.alias("queries"), share(F.sum("id_matches") / k).alias("recall"), share(F.sum("distance_matches") / k).alias("distance_recall"),
        perfect.alias("perfect"), share(perfect).alias("perfect_rate"), near.alias("distance_perfect"), share(near).alias("distance_perfect_rate"),
        F.count_if(F.col("returned") != k).alias("incomplete"),
    )


def neighbor_recall(results: DataFrame, neighbors: DataFrame, k: int) -> DataFrame:
    """Recall against an array column of 0-based rows (stored id = row + 1), cut to k."""
    t = neighbors.select("query_id", F.posexplode("neighbors").alias("pos", "row")).where(F.col("pos") < k).select("query_id", (F.col("row") + 1).alias("id"))
    hits = results.where(F.col("position") <= k).join(t, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    width = t.groupBy("query_id").agg(F.count("*").alias("width"))
    return width.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("width")).alias("recall"))


def mismatches(actual: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, kind, id): true ids that are missing and returned ids that are unexpected."""
    t, a = (d.where(F.col("position") <= k).select("query_id", "id") for d in (truth, actual))
    kind = lambda d, name: d.select("query_id", F.lit(name).alias("kind"), "id")
    return kind(t.join(a, ["query_id", "id"], "left_anti"), "missing").unionAll(kind(a.join(t, ["query_id", "id"], "left_anti"), "unexpected"))


def broken_contracts(results: DataFrame, k: int) -> DataFrame:
    """Queries whose result isn't k rows with unique ids and finite distances."""
    fine = ~F.isnan("distance") & (F.abs("distance") < float("inf"))
    per = results.groupBy("query_id").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad"))
    return per.where((F.col("rows") != k) | (F.col("ids") != F.col("rows")) | (F.col("bad") > 0))


def uncovered_queries(queries: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Queries without a ground truth of at least k rows."""
    deep = truth.groupBy("query_id").count().where(F.col("count") >= k)
    return queries.join(deep, "query_id", "left_anti").select("query_id")


def first_result_agreement(actual: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the nearest result is the true nearest."""
    a, t = (d.where("position = 1").select("query_id", F.col("id").alias(n)) for d, n in ((actual, "got"), (truth, "want")))
    same = F.count_if(F.col("got").eqNullSafe(F.col("want")))
    return t.join(a, "query_id", "left").agg(F.count("*").alias("queries"), same.alias("same"), (same / F.greatest(F.count("*"), F.lit(1))).alias("agreement"))


def positions(results: DataFrame) -> DataFrame:
    """K7: rank from 1."""
    return results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
