"""Partition and cluster statistics (A15, A16, F15, §2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import memory_estimate
from .overlay import needs_compaction


def partition_stats(base: DataFrame, pending: DataFrame, tombstones: DataFrame, dim: int, part: str = "part", engine: str = "graph") -> DataFrame:
    """A row for each partition: live vectors, pending, tombstones, memory estimate and whether it is due for compaction."""
    count = lambda d, name: d.groupBy(part).agg(F.count("*").alias(name))
    out = count(base, "size").join(count(pending, "pending"), part, "full").join(count(tombstones, "tombstones"), part, "full").na.fill(0)
    return out.select(
        part, "size", "pending", "tombstones", (F.col("size") - F.col("tombstones") + F.col("pending")).alias("live"),
        memory_estimate(F.col("size"), dim, engine).alias("memory_bytes"),
        needs_compaction(F.col("size"), F.col("pending"), F.col("tombstones")).alias("due"),
    )


def cluster_stats(partitions: DataFrame) -> DataFrame:
    return partitions.agg(
        F.count("*").alias("partitions"), F.sum("live").alias("live"), F.sum("pending").alias("pending"), F.sum("tombstones").alias("tombstones"),
        F.sum("memory_bytes").alias("memory_bytes"), F.count_if("due").alias("due"),
    )


def coverage(registry: DataFrame, active: str = "active") -> DataFrame:
    """Active over total partitions, 0 without any."""
    n, a = F.count("*"), F.count_if(active)
    return registry.agg(a.alias("active"), n.alias("total"), F.when(n == 0, F.lit(0.0)).otherwise(a / n).alias("coverage"), (a < n).alias("partial"))
