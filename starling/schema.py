"""Schemas and the hash partition column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITIONS = 32
VECTORS = "id long, vector array<float>, url string, metadata string"
#: A change: PUT carries the new values, DELETE only the id; seq orders the changes of an id.
CHANGES = "seq long, op string, id long, vector array<float>, url string, metadata string"
GROUND_TRUTH = "query_id long, position int, neighbor_id long, distance double"


def part_of(id_: Column, partitions: int = PARTITIONS) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(partitions)).cast("int")


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """The vectors table of the test data: id, vector, url, metadata, label."""
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("vec://"), F.col("vec_id").cast("string")).alias("url"),
        F.to_json(F.struct(F.concat(F.lit("label "), F.col("label").cast("string")).alias("source"))).alias("metadata"),
        "label",
    )
