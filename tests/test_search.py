import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starling.errors import ValidationError, check_count, check_dimension
from starling.functions import vectors as V
from starling.functions.embed import embedder, fake_vector
from starling.operators import quality, search


def one_hot(n, i):
    return [1.0 if j == i else 0.0 for j in range(n)]


def table(spark, rows):
    full = [(i, v, f"img-{i}", "m") for i, v in rows]
    return spark.createDataFrame(full, "id long, vector array<float>, url string, metadata string")


def asks(spark, rows):
    return spark.createDataFrame(rows, "query_id long, vector array<float>")


@pytest.mark.parametrize("engine", ["exact", "blocked", "graph"])
def test_one_hot(spark, engine):
    v = table(spark, [(i, one_hot(16, i)) for i in range(5)])
    got = search.search(v, asks(spark, [(0, one_hot(16, 2))]), 3, engine).orderBy("position").collect()
    assert [r["position"] for r in got] == [1, 2, 3] and got[0]["id"] == 2
    assert abs(got[0]["score"]) < 1e-6 and all(abs(r["score"] - 1) < 1e-6 for r in got[1:])


def test_deleted_ids_never_appear(spark):
    v = table(spark, [(1, one_hot(16, 1)), (2, one_hot(16, 2))])
    gone = spark.createDataFrame([(1,)], "id long")
    got = search.search(v, asks(spark, [(0, one_hot(16, 1))]), 5, exclude=gone).collect()
    assert [r["id"] for r in got] == [2]


def test_edge_vectors_and_ties(spark):
    v = table(spark, [(4, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [-1.0, 0.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0])])
    got = search.exact(v, asks(spark, [(0, [2.0, 0.0])]), 9).orderBy("position").collect()
    assert [r["id"] for r in got] == [3, 4, 6, 5, 7]
    assert [r["distance"] for r in got][:4] == [0.0, 0.0, 1.0, 2.0] and math.isnan(got[4]["distance"])


def test_delta_overrides_base(spark):
    v = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    d = table(spark, [(1, [0.0, -1.0]), (9, [1.0, 0.1])])
    got = search.search(v, asks(spark, [(0, [1.0, 0.0])]), 3, delta=d).orderBy("position").collect()
    assert [r["id"] for r in got] == [9, 1, 2]


def test_counts_and_dimensions():
    assert check_count(None) == 5
    with pytest.raises(ValidationError):
        check_count(0)
    with pytest.raises(ValidationError, match="incorrect vector dimension: 3, required: 4"):
        check_dimension(3, 4)


def test_engines_agree_and_approximate_recall(spark, sf_dir):
    from starling.plans import catalogue

    e = catalogue._vectors(spark, sf_dir)
    q = catalogue._queries(e)
    truth = search.exact(e, q, 10).cache()
    key = lambda d: sorted((r["query_id"], r["position"], r["id"], r["distance"]) for r in d.collect())
    assert key(search.blocked(e, q, 10)) == key(truth) == key(search.partitioned(e, q, 10, F.pmod("id", F.lit(7))))
    for got, least in ((search.graph(e, q, 10), 0.95), (search.ivf(e, q, 10, probes=24), 0.8)):
        s = quality.summary(quality.compare(got, truth, 10), 10).first()
        assert s["recall"] >= least
    s = quality.summary(quality.compare(truth, truth, 10), 10).first()
    assert s["recall"] == s["distance_recall"] == s["perfect_rate"] == 1.0 and s["incomplete"] == 0


def test_graph_of_a_large_part():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    edges = search.build_graph(x, 12, 1.2)
    u, q = search._unit(x), search._unit(rng.normal(size=(30, 16)))
    i, j = search.graph_search(edges, u, q, 10, 6.0)
    truth = np.argsort(-(q @ u.T), axis=1)[:, :10]
    assert np.mean([b in truth[a] for a, b in zip(i, j)]) > 0.9


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0, 2)), min_size=1, max_size=60), st.integers(1, 5), st.integers(1, 4))
def test_partition_then_merge_is_global(rows, k, parts):
    best = lambda r: sorted({i: min(d for j, d in r if j == i) for i, _ in r}.items(), key=lambda x: (x[1], x[0]))[:k]
    split = [x for p in range(parts) for x in best([r for r in rows if r[0] % parts == p] or [(10**6 + p, 9.0)])]
    assert best([s for s in split if s[0] < 10**6]) == best(rows)


def test_text_functions(spark):
    df = spark.createDataFrame([('{"source": "x"}', [1.0, -0.5], "a" * 12), ("no json", [0.0, 0.0], "b"), (None, [3.0, 4.0], None)], "m string, v array<float>, s string")
    got = df.select(
        V.metadata_source(F.col("m")).alias("m"), V.vector_text(F.col("v")).alias("t"), V.parse_vector(V.vector_text(F.col("v"))).alias("v"),
        V.l2_normalize(F.col("v")).alias("n"), V.truncate_text(F.col("s"), 10).alias("s"),
    ).collect()
    assert [r["m"] for r in got] == ["x", "unknown", "unknown"]
    assert [r["t"] for r in got] == ["[1.0, -0.5]", "[0.0, 0.0]", "[3.0, 4.0]"] and [list(r["v"]) for r in got] == [[1.0, -0.5], [0.0, 0.0], [3.0, 4.0]]
    assert list(got[2]["n"]) == [0.6, 0.8] and list(got[1]["n"]) == [0, 0]
    assert got[0]["s"] == "a" * 10 + "... (12 chars total)" and got[1]["s"] == "b"


def test_sql_functions(spark):
    V.register(spark)
    r = spark.sql("SELECT cosine_distance(array(1f, 0f), array(0f, 2f)) c, euclidean_distance(array(1f, 0f), array(1f, 2f)) e, l2_normalize(array(0f, 5f)) n").first()
    assert r["c"] == 1.0 and r["e"] == 2.0 and list(r["n"]) == [0.0, 1.0]


def test_embedding(spark):
    a, b = fake_vector(b"x", 32), fake_vector(b"x", 32)
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9
    got = spark.createDataFrame([("x",)], "t string").select(embedder(dim=32)("t").alias("v")).first()["v"]
    assert np.allclose(got, a, atol=1e-6)


def test_quality_reports(spark):
    cols = "query_id long, position int, id long, distance double"
    truth = spark.createDataFrame([(1, 1, 10, 0.1), (1, 2, 11, 0.2), (2, 1, 12, 0.1), (2, 2, 13, 0.3)], cols)
    got = spark.createDataFrame([(1, 1, 10, 0.1), (1, 2, 14, 0.2), (2, 1, 13, 0.3)], cols)
    per = {r["query_id"]: r for r in quality.compare(got, truth, 2).collect()}
    assert (per[1]["id_matches"], per[1]["distance_matches"], per[2]["id_matches"], per[2]["returned"]) == (1, 2, 1, 1)
    assert sorted(map(tuple, quality.mismatches(got, truth, 2).collect())) == [(1, "missing", 11), (1, "unexpected", 14), (2, "missing", 12)]
    assert [r["query_id"] for r in quality.broken_contracts(got, 2).collect()] == [2]
    assert quality.first_result_agreement(got, truth).first()["agreement"] == 0.5
    n = spark.createDataFrame([(1, [9, 10]), (2, [0, 1])], "query_id long, neighbors array<long>")
    assert quality.neighbor_recall(got, n, 2).first()["recall"] == 0.25
    q = spark.createDataFrame([(1,), (5,)], "query_id long")
    assert [r[0] for r in quality.uncovered_queries(q, truth, 2).collect()] == [5]
    random.seed(0)


def test_registered_ivf_recall(spark):
    from starling.plans import catalogue

    d = "/root/testdata/sf0.1"
    e = catalogue._vectors(spark, d)
    s = quality.summary(quality.compare(catalogue.knn_ivf_top10(spark, d), search.exact(e, catalogue._queries(e), 10), 10), 10).first()
    assert s["recall"] >= 0.9


@pytest.mark.parametrize("metric", ["euclidean", "cosine_f32"])
def test_exact_beyond_the_sent_queries(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    e = table(spark, [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(200)] + [(900 + i, [0.0] * 6) for i in range(3)])
    q = e.where("id % 20 = 0").selectExpr("id AS query_id", "vector")
    rows = lambda: sorted(map(tuple, search.exact(e, q, 5, metric).collect()))
    want = rows()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    assert rows() == want


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "cosine_f32"])
def test_f1_score_by_blocks_gives_the_bits_of_the_expression(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    odd = [(900, [0.0] * 7), (901, [float("nan")] * 7), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (903, [1.0, 2.0]), (904, None), (905, [float("inf")] * 7), (906, [0.0] * 2)]
    e = table(spark, [(i, [float(x) for x in rng.normal(size=7)]) for i in range(60)] + odd)
    q = e.where("id % 9 = 0 OR id >= 900").selectExpr("id AS query_id", "vector")
    want = e.where("vector IS NOT NULL").crossJoin(q.withColumnRenamed("vector", "q")).select("query_id", "id", search.METRICS[metric](F.col("q"), F.col("vector")).alias("distance"))
    monkeypatch.setattr(search, "SCORE_CHUNK", 25)
    monkeypatch.setattr(search, "SCORE_BLOCK", 4)
    got = search.score(e, q, metric)
    assert "BroadcastNestedLoopJoin BuildRight, Cross" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda d: sorted((r["query_id"], r["id"], str(r["distance"])) for r in d.collect())
    assert key(got) == key(want)


def test_f1_only_the_result_of_score_grows_with_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    e = table(spark, [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)])
    q = e.where("id % 5 = 0").selectExpr("id AS query_id", "vector")
    want = e.crossJoin(q.withColumnRenamed("vector", "q")).select("query_id", "id", search.METRICS["cosine"](F.col("q"), F.col("vector")).alias("distance"))
    for name, value in (("SCORE_CHUNK", 40), ("SCORE_BLOCK", 4), ("BROADCAST_BYTES", 1_000)):  # 60 queries in three groups
        monkeypatch.setattr(search, name, value)
    sc = spark.sparkContext
    sc.setJobGroup("f1", "f1")
    got = sorted(map(tuple, search.score(e, q).collect()))
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("f1")]
    sc.setJobGroup("", "")
    stages = {s: sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s, info in stages.items() if info)
    assert got == sorted(map(tuple, want.collect()))
    assert 300 <= written < 400  # each vector once, besides what counting takes


def test_f1_written_pairs_take_little_more_than_their_distances(spark, tmp_path):
    rng = np.random.default_rng(9)
    e = table(spark, [(i, [float(x) for x in rng.normal(size=3)]) for i in range(1_003)])
    search.score(e, e.where("id % 3 = 0").selectExpr("id AS query_id", "vector")).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 1_003 * 335
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 8.5 * 1_003 * 335


@pytest.mark.parametrize("way", ["blocked", "same", "partitioned", "graph"])
def test_f1_searches_by_groups_of_queries_deal_each_vector_once(spark, monkeypatch, way):
    rng = np.random.default_rng(10)
    e = table(spark, [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [(900 + i, [0.5] * 5) for i in range(9)]).selectExpr("*", "id % 4 AS own")
    q = e.where("id % 5 = 0").selectExpr("id AS query_id", "vector", "own")
    same = "own" if way == "same" else None
    index = search.graph_index(e, 3)
    want = sorted(map(tuple, (search.search_graph(index, q, 6) if way == "graph" else search.exact(e, q, 6, same=same)).collect()))
    for name, value in (("CHUNK", 40), ("BLOCK", 5), ("TASKS", 3), ("HELD", 20)):  # 19 groups; a task gives out what it holds of several parts
        monkeypatch.setattr(search, name, value, raising=False)
    ways = {"partitioned": lambda: search.partitioned(e, q, 6, F.expr("nullif(own, 3)")), "graph": lambda: search.search_graph(index, q, 6)}
    got = ways.get(way, lambda: search.blocked(e, q, 6, same=same))()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan  # nothing is repeated for blocks
    assert sorted(map(tuple, got.collect())) == want and len(want) == 6 * q.count()


def test_f2_parts_are_searched_by_chunks_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    e = table(spark, [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [(900 + i, [0.5] * 5) for i in range(9)])
    q = e.where("id % 20 = 0").selectExpr("id AS query_id", "vector")
    want = sorted(map(tuple, search.exact(e, q, 6).collect()))
    monkeypatch.setattr(search, "CHUNK", 40)
    monkeypatch.setattr(search, "BLOCK", 5)
    monkeypatch.setattr(search, "_sent", lambda *a: pytest.fail("all queries are sent to every task"))
    assert sorted(map(tuple, search.partitioned(e, q, 6, F.pmod("id", F.lit(3))).collect())) == want


def test_f3_a_task_holds_few_distances_at_once():
    import tracemalloc

    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(10_000, 8)) * 8).astype(np.float32)
    tracemalloc.start()
    i, j = search._nearest(x[:1_000], x, np.arange(10_000), 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20 and len(i) == 10_000
