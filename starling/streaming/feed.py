"""The change feed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import overlay
from ..operators.store import VectorStore
from ..schema import CHANGES


def change_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A growing folder of change rows; back-pressure by files a trigger."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_stream(changes: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """The running latest change of each key (update or complete mode)."""
    return overlay.latest(changes, key, order)


def apply_to(store: VectorStore, skipped: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. A batch's changes are collapsed to the last of each id and appended as one commit, and the store
    compacts when it is due. Puts that repeat the stored vector stay in the log, as their url, metadata and seq count, but need no
    upkeep of an index; `skipped` hears how many there are in each batch. A batch that is run again after a failure appends rows with
    the same seq again, which the latest-by-seq rule makes harmless. Bad data fails for good; what else fails is tried again by the
    stream's restart (X6)."""

    def apply(batch: DataFrame, _: int) -> None:
        last = overlay.latest(batch)
        if skipped is not None:
            now = store.rows().select(F.col("id").alias("__id"), F.col("vector").alias("__v"))
            skipped(last.join(now, last["id"] == now["__id"]).where((F.col("op") == "PUT") & (F.col("vector") == F.col("__v"))).count())
        store._append(last)
        store.compact()

    return apply


def run_feed(changes: DataFrame, store: VectorStore, checkpoint: str) -> StreamingQuery:
    """Drain what is there, then stop; await termination is the readiness barrier."""
    return changes.writeStream.foreachBatch(apply_to(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timeline_stream(requests: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 second") -> DataFrame:
    """A8 on event time: tumbling counts and average latency."""
    w = F.window(ts, width)
    return requests.withWatermark(ts, late).groupBy(w).agg(
        F.count("*").alias("offered"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("latency_ms").alias("avg_latency_ms")
    )
