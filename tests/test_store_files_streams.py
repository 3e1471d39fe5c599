import random

import pytest
from pyspark.sql import functions as F

from starling.errors import NotFound, ValidationError
from starling.operators import loadstats, overlay
from starling.operators.store import VectorStore
from starling.schema import CHANGES
from starling.sources import files
from starling.streaming import feed


def test_dataset_csv(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("id;url;embedding;metadata\n1;u1;[1.0, 2.0];a;b\n\nbad;line\n2;u2;3,4;  \n1;u1b;[5, 6];last\n")
    rows = {r["id"]: r for r in files.read_dataset(spark, str(p), 2).collect()}
    assert set(rows) == {1, 2} and list(rows[1]["vector"]) == [5.0, 6.0] and rows[1]["url"] == "u1b" and rows[2]["metadata"] is None
    assert files.dropped_lines(spark, str(p)) == 1 and files.count_rows(spark, str(p)) == 4
    out = str(tmp_path / "out")
    v = spark.createDataFrame([(1, [1.5, -2.0], "u;".strip(";"), 'x;"y"'), (7, [0.0, 1e-5], "w", None)], "id long, vector array<float>, url string, metadata string")
    files.write_dataset(v, out)
    back = {r["id"]: r for r in files.read_dataset(spark, out, 2).collect()}
    assert {i: (list(r["vector"]), r["url"], r["metadata"]) for i, r in back.items()} == {r["id"]: (list(r["vector"]), r["url"], r["metadata"]) for r in v.collect()}


@pytest.mark.parametrize("line", ["5;u;[1, 2, 3];m", "5;u;[1, x];m"])
def test_bad_dataset_rows_fail(spark, tmp_path, line):
    p = tmp_path / "bad.csv"
    p.write_text(f"h;h;h;h\n{line}\n")
    with pytest.raises(Exception, match="5: incorrect vector dimension: 3, required: 2|CAST_INVALID_INPUT"):
        files.read_dataset(spark, str(p), 2).collect()


def test_query_and_truth_files(spark, tmp_path):
    q = tmp_path / "q.csv"
    q.write_text('id;url;v\n1;u;[1, 2]\n2;"w";"3, 4"\n')
    assert sorted((r["id"], list(r["vector"])) for r in files.read_queries(spark, str(q)).collect()) == [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    for bad in ("1;u;[1]\n1;u;[2]\n", "1;u;[1]\n2;u;[2, 3]\n", "1;u;[NaN]\n", ""):
        q.write_text("id;url;v\n" + bad)
        with pytest.raises(ValueError):
            files.read_queries(spark, str(q))
    out = str(tmp_path / "truth")
    r = spark.createDataFrame([(1, 1, 5, 0.25), (1, 2, 6, 0.5), (2, 1, 7, 0.0)], "query_id long, position int, id long, distance double")
    files.write_ground_truth(r, out)
    assert sorted(map(tuple, files.read_ground_truth(spark, out).collect())) == sorted(map(tuple, r.collect()))
    t = tmp_path / "bad_truth.csv"
    t.write_text("query_id;position;neighbor_id;distance\n1;1;5;0.1\n1;3;6;0.2\n")
    with pytest.raises(ValueError):
        files.read_ground_truth(spark, str(t))


def test_ann_dataset_and_synthetic(spark, tmp_path):
    v = files.synthetic(spark, 20, 8)
    assert v.count() == 20 and v.where(F.abs(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-5).count() == 0
    for t in ("train", "test", "neighbors"):
        v.write.parquet(f"{tmp_path}/{t}")
    assert files.read_ann_dataset(spark, str(tmp_path))["test"].count() == 20
    with pytest.raises(ImportError):
        files.read_ann_dataset(spark, "x.h5")


def test_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "store"), 2, 4)
    assert s.rows().count() == 0 and s.next_id() == 1
    a = s.add([1.0, 0.0], "u1")
    b = s.add([0.0, 1.0], "u2", "m")
    assert (a, b) == (1, 2) and s.get(2)["metadata"] == "m"
    with pytest.raises(ValidationError, match="incorrect vector dimension: 1, required: 2"):
        s.add([1.0], "u")
    for bad in (lambda: s.add([1.0, 1.0], " "), lambda: s.add(None, "u"), lambda: s.get(0), lambda: s.delete(-1)):
        with pytest.raises(ValidationError):
            bad()
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vector array<float>")
    assert s.search(q, 1).first()["id"] == 2
    s.delete(2)
    s.delete(2)
    with pytest.raises(NotFound):
        s.get(2)
    assert [r["id"] for r in s.search(q, 5).collect()] == [1]
    assert s.compact(force=True) and s.rows().count() == 1 and s.changes().count() == 0
    s.add_all(spark.createDataFrame([(1, [0.5, 0.5], "n", None), (9, [1.0, 1.0], "n", None)], "id long, vector array<float>, url string, metadata string"))
    assert s.get(1)["url"] == "n" and s.next_id() == 10 and s.get_all(spark.createDataFrame([(9,), (77,)], "id long")).count() == 1
    assert s.stats().first()["live"] == 2
    _, coverage = s.search_full(q, 1)
    assert coverage.first()["coverage"] == 1.0
    with pytest.raises(ValidationError):
        s.search(spark.createDataFrame([(0, [1.0])], "query_id long, vector array<float>"), 1)
    s.build_index(m=4)
    assert [r["id"] for r in s.search(q, 5, "graph").orderBy("position").collect()] == [r["id"] for r in s.search(q, 5).orderBy("position").collect()]
    s.delete(9)
    assert [r["id"] for r in s.search(q, 5, "graph").collect()] == [1]
    s.export_csv(str(tmp_path / "csv"))
    s.clear()
    assert s.rows().count() == 0
    assert s.load_csv(str(tmp_path / "csv")) == 1 and s.rows().count() == 1


def _log(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i + 1, rng.choice(["PUT", "PUT", "DELETE"]), rng.randrange(8)) for i in range(n)]
    full = [(s, op, i, [float(s % 3), 1.0] if op == "PUT" else None, "u", None) for s, op, i in rows]
    state = {}
    for s, op, i, v, *_ in full:
        state.pop(i, None)
        if op == "PUT":
            state[i] = v
    return spark.createDataFrame(full, CHANGES), state


def test_live_set_equals_replay(spark):
    base = spark.createDataFrame([(100, [9.0, 9.0], "b", None)], "id long, vector array<float>, url string, metadata string")
    for seed in range(3):
        changes, state = _log(spark, 40, seed)
        got = {r["id"]: list(r["vector"]) for r in overlay.live(base, changes).collect()}
        assert got == state | {100: [9.0, 9.0]}


def test_stream_equals_replay(spark, tmp_path):
    changes, state = _log(spark, 60, 7)
    src = str(tmp_path / "feed")
    for lo in (0, 20, 40):
        changes.where((F.col("seq") > lo) & (F.col("seq") <= lo + 20)).coalesce(1).write.mode("append").parquet(src)
    s = VectorStore(spark, str(tmp_path / "store"), 2, 2)
    feed.run_feed(feed.change_stream(spark, src, 1), s, str(tmp_path / "cp")).awaitTermination()
    assert {r["id"]: list(r["vector"]) for r in s.rows().collect()} == state
    q = feed.latest_stream(feed.change_stream(spark, src)).writeStream.format("memory").queryName("latest_changes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"] for r in spark.table("latest_changes").where("op = 'PUT'").collect()} == set(state)


def test_timeline_stream(spark, tmp_path):
    src = str(tmp_path / "req")
    rows = [(f"2024-01-01 00:00:0{i % 3}", "ok" if i % 2 else "error", float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "ts string, status string, latency_ms double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    out = feed.timeline_stream(spark.readStream.schema(df.schema).parquet(src), "ts")
    out.writeStream.format("memory").queryName("tl").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["offered"] for r in spark.table("tl").collect()) == [3, 3, 3]


def test_compaction_rule(spark):
    cases = [(0, 255, 0, False), (0, 256, 0, True), (10_000, 999, 0, False), (10_000, 1000, 0, True), (100, 0, 20, True), (100, 0, 19, False), (0, 0, 5, False)]
    df = spark.createDataFrame(cases, "size long, pending long, tomb long, want boolean")
    got = df.select("want", overlay.needs_compaction(F.col("size"), F.col("pending"), F.col("tomb")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_ids_in_buckets(spark):
    rows = spark.range(0, 500).withColumn("o", F.pmod(F.col("id") * 37, F.lit(499))).select("o").distinct()
    got = overlay.assign_ids(rows, "o", 10, bucket_rows=60).orderBy("o").collect()
    assert [r["id"] for r in got] == list(range(11, 11 + len(got)))


def test_percentiles_and_accounting(spark):
    for n in (1, 2, 5, 100):
        df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "x double")
        r = loadstats.percentiles(df, "x").first()
        for name, p in loadstats.PERCENTILES.items():
            assert r[name] == max(1, -(-int(p * 1000) * n // 1000))
    empty = spark.createDataFrame([], "status string, latency_ms double, due_ns long, start_ns long, end_ns long")
    a = loadstats.accounting(empty, "status", 60).first()
    assert a["offered"] == 0 and a["schedule_pressure"] == 0.0 and a["rejected_pct"] == 0.0
    req = spark.createDataFrame([("ok", 2.0, 0, 1_000_000, 3_000_000), ("error", 1.0, 0, 0, 1_000_000)], "status string, latency_ms double, due_ns long, start_ns long, end_ns long")
    kinds = {r["kind"]: r for r in loadstats.latency_populations(req).collect()}
    assert kinds["service"]["n"] == 2 and kinds["service_ok"]["n"] == 1 and kinds["end_to_end"]["max"] == 3.0
    spread = loadstats.client_spread(loadstats.client_rollup(req.withColumn("c", F.lit(1)), "c", "latency_ms", "status", 1.0), "c").first()
    assert spread["min_qps"] == spread["max_qps"] == 1.0
    t = loadstats.timeline(req, F.col("due_ns") * 1e-9, 5)
    files_out = t.collect()
    assert files_out[0]["offered"] == 2 and files_out[0]["avg_latency_ms"] == 2.0


def test_entry(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40
    assert e.entry(spark).count() == 100
