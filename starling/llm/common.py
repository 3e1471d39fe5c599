"""Shared pieces of the corpus operators: text normalisation, hashing, durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: [\x20\x09-\x0D], the white space of every operator here.
SPACES = " \t\n\x0b\x0c\r"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The share of the driver's largest heap from which it is tidied between jobs.
HEAP_SHARE = 0.5
SPACES_RE = r"[\x20\x09-\x0D]"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of an ASCII-lower-cased text; null text gives an empty array."""
    trimmed = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE + "+", -1))


def hash128(*c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same value, together 128 bits."""
    return F.xxhash64(*c), F.xxhash64(F.lit("second"), *c)


def workspace(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset (a local session), one of our own is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), f"starling-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/starling"


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, if its heap has grown. Spark gives up the broadcasts and shuffles of finished plans only when the
    driver's collector finds them, and those of many short jobs in a row grow old before it looks for them."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared workspace and read it back: cuts the lineage, survives lost executors,
    and gives the planner true sizes. The files stay until clear_workspace()."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the shuffle files aren't needed any more once the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What this Python worker keeps between the operator's tasks. Workers outlive a stage, so what they keep for other operators is
    given up, or it would stand beside the operator's own memory."""
    if operator not in _kept:
        _kept.clear()
    return _kept.setdefault(operator, {})


def clear_workspace(spark: SparkSession) -> None:
    """Delete what materialize() wrote; call it when no result that reads from it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(workspace(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_back(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n", most: int = 20_000) -> DataFrame:
    """rows with the columns of table, which has one row for each value of the (non-null) keys and in `count` how many of the rows have
    it. Keys of more than `most` rows (or 1/100,000 of all) are sent to the rows, at most 100,000 of them, so that no task gets all rows
    of such a key. Both sides must be cheap to read twice (materialised)."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) > F.lit(max(most, total // 100_000))
    hot = F.broadcast(table.where(is_hot).drop(count))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~is_hot).drop(count), keys)
    return rows.join(hot, keys).unionByName(cold)


def ranked(df: DataFrame, group: list[str], order: list[str], into: str, chunk_rows: int = 50_000) -> DataFrame:
    """Gapless ranks from 0 within each group, without giving a whole group to one task.

    Rows are dealt by a hash of `order` into as many chunks as the largest group needs to keep chunks near chunk_rows;
    a rank is the row's number in its chunk plus the sizes of the group's earlier chunks. The chunk table has one row per
    (group, chunk). df must be cheap to read twice (materialised). Rows equal in `order` are interchangeable."""
    from pyspark.sql import Window

    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-largest // chunk_rows))
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    if chunks == 1:
        return dealt.withColumn(into, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long")).drop("__chunk")
    sizes = dealt.groupBy(*group, "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy(*group, "__chunk").orderBy(*order)) - 1)
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*group, "__chunk"]]
    joined = local.alias("l").join(sizes.alias("s"), keys)
    return joined.select("l.*", (F.col("__local") + F.col("__before")).cast("long").alias(into)).drop("__chunk", "__local")
