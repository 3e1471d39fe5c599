"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
documents. Null texts count as empty, and an empty table passes through. Repeated rows are one document in the near-duplicate
stage and otherwise rows like any other. Columns beside those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.llm import decontam, line_dedup, packing, queries, simhash
from starling.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't reject."""
    return queries.judge_toxicity(docs.select(*COLUMNS), spark, sf_dir).where("NOT rejected").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that they lose; n_chars follows the text."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs.select("doc_id", "text")))
    changed = kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")))
    return changed.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept"))).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id (nulls
    last, then by a hash of the text); of rows that repeat it one."""
    marked = docs.select(*COLUMNS, line_dedup.text_mark(F.col("text")).alias("__mark"))
    found = simhash.similar_documents(marked.select("doc_id", "text"), width=5, similarity=0.8).withColumnRenamed("mark", "__mark")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__mark")).alias("x"))
    stays = materialize(first.select(F.col("x.doc_id").alias("__id"), F.col("x.__mark").alias("__m")), "stays")
    kept = marked.join(stays, marked["doc_id"].eqNullSafe(stays["__id"]) & (marked["__mark"] == stays["__m"]), "left_semi")
    again = kept.groupBy("doc_id", "__mark").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m"))
    again = materialize(again, "repeated")
    same = kept["doc_id"].eqNullSafe(again["__id"]) & (kept["__mark"] == again["__m"])
    one = kept.join(again, same, "left_semi").groupBy("doc_id", "__mark").agg(F.min(F.struct(*COLUMNS[1:])).alias("x"))
    return kept.join(again, same, "left_anti").select(*COLUMNS).unionAll(one.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in COLUMNS[1:]]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a token vocabulary are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
