"""Readers and writers of the delimited formats (S1-S10, K6-K9), the array-file data set (S9) and a synthetic source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import GROUND_TRUTH

HEADER = "id;url;embedding;metadata"
#: The first three semicolons separate; metadata may hold more of them.
_ROW = r"^([^;]*);([^;]*);([^;]*);(.*)$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the lines of text files without their headers and blank lines; `at` orders the lines of a file, however it
    is split. A single column of a separator that no text has keeps lines whole and lets the reader skip headers in one pass."""
    text = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("escape", "").csv(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return text.where("value IS NOT NULL").select(at.alias("at"), "value")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet vectors table, rows without a vector left out."""
    return spark.read.parquet(path).where("vector IS NOT NULL")


def read_dataset(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Id;url;[f, f, ...];metadata. Lines with fewer than three semicolons are dropped; empty metadata is null; a wrong
    dimension or a bad number fails the load and names the id; of repeated ids the last line counts."""
    parts = _lines(spark, path).where(F.col("value").rlike(_ROW))
    part = lambda i: F.regexp_extract("value", _ROW, i)
    rows = parts.select(
        "at", part(1).cast("long").alias("id"), part(2).alias("url"), V.parse_vector(part(3)).alias("v"), F.nullif(F.trim(part(4)), F.lit("")).alias("metadata")
    )
    wrong = F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(": incorrect vector dimension: "), F.size("v").cast("string"), F.lit(f", required: {dim}"))
    checked = rows.select("at", "id", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(wrong)).alias("vector"), "url", "metadata")
    last = checked.groupBy("id").agg(F.max_by(F.struct("vector", "url", "metadata"), "at").alias("x"))
    return last.select("id", "x.vector", "x.url", "x.metadata")


def dropped_lines(spark: SparkSession, path: str) -> int:
    """Lines that read_dataset drops, blank ones apart."""
    return _lines(spark, path).where(~F.col("value").rlike(_ROW)).count()


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, without the header; none is an error."""
    n = spark.read.text(path).where("trim(value) <> ''").count() - 1
    if n <= 0:
        raise ValueError(f"{path} has no rows")
    return n


def max_id(vectors: DataFrame) -> int:
    """S6f, A14."""
    return vectors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Id;url;[vector] with optional quotes and brackets. Empty files, repeated ids, mixed dimensions and values that aren't
    finite are errors."""
    pattern = r'^\s*"?([^;"]*)"?\s*;\s*"?([^;"]*)"?\s*;\s*"?([^"]*)"?\s*$'
    lines = _lines(spark, path).where(F.trim("value") != "")
    part = lambda i: F.trim(F.regexp_extract("value", pattern, i))
    rows = lines.select(part(1).cast("long").alias("id"), part(2).alias("url"), V.parse_vector(part(3)).alias("vector"))
    fine = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    seen = rows.agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(~fine).alias("bad")
    ).first()
    for wrong, what in ((seen["n"] == 0, "no queries"), (seen["ids"] < seen["n"], "repeated query ids"), (seen["low"] != seen["high"], "mixed dimensions"), (seen["bad"], "values that aren't finite")):
        if wrong:
            raise ValueError(f"{path}: {what}")
    return rows


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Exact header, positions 1..n in each query, finite distances."""
    text = spark.read.text(path)
    header = GROUND_TRUTH.replace(" long", "").replace(" int", "").replace(" double", "").replace(", ", ";")
    if text.first() is None or text.where(F.col("value") == header).count() == 0:
        raise ValueError(f"{path}: the header must be {header}")
    rows = spark.read.csv(path, sep=";", header=True, schema=GROUND_TRUTH, mode="FAILFAST", enforceSchema=False)
    due = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    bad = rows.withColumn("due", due).where("position IS NULL OR position <> due OR distance IS NULL OR isnan(distance) OR abs(distance) = double('Infinity')")
    if bad.limit(1).count():
        raise ValueError(f"{path}: positions must run from 1 and distances be finite")
    return rows


def dataset_line() -> Column:
    return F.concat_ws(";", F.col("id").cast("string"), F.coalesce("url", F.lit("")), V.vector_text(F.col("vector")), F.coalesce("metadata", F.lit("")))


def write_dataset(vectors: DataFrame, path: str, single: bool = False) -> None:
    """K6: a text file for each partition, each with the header; single: one file, for small exports only."""
    lines = vectors.where("vector IS NOT NULL").select(dataset_line().alias(HEADER))
    lines = lines.coalesce(1) if single else lines
    # a column named like the header, neither quoted nor escaped
    lines.write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "").option("emptyValue", "").csv(path)


def write_ground_truth(results: DataFrame, path: str) -> None:
    """K7: from (query_id, position, id, distance)."""
    rows = results.select("query_id", F.col("position").cast("int").alias("position"), F.col("id").alias("neighbor_id"), "distance")
    rows.repartitionByRange("query_id").sortWithinPartitions("query_id", "position").write.mode("overwrite").csv(path, sep=";", header=True)


def write_measurements(per_query: DataFrame, path: str) -> None:
    """K8: numbers with six decimals."""
    six = lambda c: F.format_string("%.6f", c).alias(c)
    cols = ["query_index", "query_id", "index_type", six("latency_ms"), "id_matches", "distance_matches", six("recall_at_k"), six("distance_recall_at_k")]
    per_query.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_timeline(timeline: DataFrame, path: str) -> None:
    """K9: seconds without any event are left out."""
    cols = ["second", "offered", "accepted", "successful", "errors", "incomplete", "avg_latency_ms"]
    timeline.where("offered + accepted + successful + errors + incomplete > 0").select(*cols).orderBy("second").write.mode("overwrite").csv(path, header=True)


def read_ann_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`train`, `test` and `neighbors` from Parquet tables (row, ...) in a folder, or from an HDF5 file if h5py is there.
    Stored ids are row + 1."""
    if not path.endswith((".h5", ".hdf5")):
        return {t: spark.read.parquet(f"{path}/{t}") for t in ("train", "test", "neighbors")}
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py; give a folder of Parquet tables instead") from e

    def slices(name: str):
        def read(batches):
            import pandas as pd

            with h5py.File(path, "r") as f:
                for b in batches:
                    for start in b["id"]:
                        rows = f[name][start : start + 10_000]
                        yield pd.DataFrame({"row": range(start, start + len(rows)), "values": list(rows)})

        return read

    with h5py.File(path, "r") as f:
        sizes = {t: f[t].shape[0] for t in ("train", "test", "neighbors")}
    kinds = {"train": "float", "test": "float", "neighbors": "long"}
    return {t: spark.range(0, n, 10_000).mapInPandas(slices(t), f"row long, values array<{kinds[t]}>") for t, n in sizes.items()}


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """Seeded normal vectors of unit length, each from its id alone."""

    def make(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = [np.random.default_rng([seed, int(i)]).normal(size=dim) for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "vector": [(r / (np.sqrt((r**2).sum()) or 1)).astype("float32") for r in rows]})

    return spark.range(1, n + 1).mapInPandas(make, "id long, vector array<float>")


def fetch_images(urls: DataFrame, url: str = "url", timeout_s: float = 10.0, limit: int = 20 << 20) -> DataFrame:
    """(url, content, error) over HTTP in bounded batches; anything but image/* is an error, as are empty bodies."""

    def fetch(batches):
        import pandas as pd
        from urllib.request import urlopen

        for b in batches:
            rows = []
            for u in b[url]:
                try:
                    if not str(u).startswith(("http://", "https://")):
                        raise ValueError("not a link")
                    with urlopen(u, timeout=timeout_s) as r:  # noqa: S310
                        if not (r.headers.get_content_type() or "").startswith("image/"):
                            raise ValueError("not an image")
                        body = r.read(limit + 1)
                    if not body or len(body) > limit:
                        raise ValueError("empty or too large")
                    rows.append((u, body, None))
                except Exception as e:  # a row's failure is its result
                    rows.append((u, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return urls.select(url).mapInPandas(fetch, "url string, content binary, error string")
