import random

import pytest
from pyspark.sql import functions as F

from starling.llm import common


@pytest.mark.parametrize("chunk_rows", [7, 50_000])
def test_ranks_are_gapless_in_any_chunking(spark, chunk_rows):
    rng = random.Random(0)
    rows = [(rng.choice("abbb"), rng.randrange(50)) for _ in range(300)] + [(None, 1), (None, None)]
    df = common.materialize(spark.createDataFrame(rows, "g string, x int"), "ranked")
    by = {}
    for r in common.ranked(df, ["g"], ["x"], "n", chunk_rows).collect():
        by.setdefault(r["g"], []).append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == len(rows)


def test_join_back_sends_hot_keys(spark):
    rows = common.materialize(spark.createDataFrame([(i % 7 if i % 2 else 9, i) for i in range(200)], "k long, x int"), "rows")
    table = common.materialize(rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 10 AS y"), "table")
    for most in (20_000, 20, 0):
        got = common.join_back(rows, table, ["k"], most=most)
        assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted((r["k"], r["x"], r["k"] * 10) for r in rows.collect())


def test_words_and_case(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\x0b",), ("  One\x0cTWO É\n",), ("a b",)], "t string")
    got = [list(r["w"]) for r in df.select(common.words(F.col("t")).alias("w")).collect()]
    assert got == [[], [], [], ["one", "two", "É"], ["a b"]]


def test_workspace_follows_the_session(spark):
    assert common.workspace(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/starling"


@pytest.mark.parametrize("share, tidied", [(0.0, True), (1.0, False)])
def test_broadcasts_of_finished_jobs_go_once_the_heap_has_grown(spark, monkeypatch, share, tidied):
    monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.materialize(spark.range(5).join(spark.range(3).hint("broadcast"), "id"), "tidied")
    assert (full() > before) == tidied
