"""Change log and overlay (K1-K5, K12, X1, X8-X11): latest state by key, live set, no-op puts, compaction rule, id allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """The last change of each key. One map-side combined aggregate; the order of arrival doesn't matter."""
    order = order or ["seq"]
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def live(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(base without tombstones and pending) plus pending."""
    last = latest(changes)
    pending = last.where("op = 'PUT'").select(*base.columns)
    return base.join(last.select("id"), "id", "left_anti").select(*base.columns).unionByName(pending)


def effective(changes: DataFrame, key: str = "id", order: list[str] | None = None, same: str = "vector") -> DataFrame:
    """Changes without puts that repeat the value that the key has already."""
    w = Window.partitionBy(key).orderBy(*(order or ["seq"]))
    before = F.lag(F.struct("op", same)).over(w)
    noop = (F.col("op") == "PUT") & before["op"].eqNullSafe(F.lit("PUT")) & before[same].eqNullSafe(F.col(same))
    return changes.withColumn("noop", F.coalesce(noop, F.lit(False)))


def needs_compaction(size: Column, pending: Column, tombstones: Column, add_ratio: float = 0.10, delete_ratio: float = 0.20, min_add: int = 256) -> Column:
    """X10."""
    add_limit = F.when(size == 0, F.lit(min_add)).otherwise(F.greatest(F.lit(min_add), F.ceil(size * F.lit(add_ratio))))
    return (pending >= add_limit) | ((size > 0) & (tombstones >= size * F.lit(delete_ratio)))


def assign_ids(rows: DataFrame, order: str, start: int = 0, into: str = "id", bucket_rows: int = 100_000) -> DataFrame:
    """Ids start + 1, start + 2, ... in the order of a numeric column. Buckets between approximate quantiles are numbered
    each by itself and offset by the sizes of the earlier ones, so no task sees all rows."""
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    cuts = rows.select(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order)))
    dealt = rows.withColumn("__b", bucket)
    sizes = dealt.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(order)))
    joined = ranked.join(F.broadcast(before), "__b")  # a row per bucket
    return joined.withColumn(into, (F.col("__r") + F.col("__before") + F.lit(start)).cast("long")).drop("__b", "__r", "__before")
