"""Changes of the store that must not be lost: X1, X3, X9, X11, K12, J8, and the kernels behind the exact engines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.errors import Conflict, NotFound, ValidationError
from starling.operators import search
from starling.operators.store import VectorStore
from starling.schema import CHANGES
from starling.streaming import feed

ROWS = "id long, vector array<float>, url string, metadata string"


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"), 2, 4)


def changes(spark, *rows):
    return spark.createDataFrame([(s, op, i, v, u, None) for s, op, i, v, u in rows], CHANGES)


def test_x9_a_put_with_an_equal_vector_still_changes_the_payload(spark, store):
    heard = []
    apply = feed.apply_to(store, heard.append)
    apply(changes(spark, (1, "PUT", 1, [1.0, 0.0], "old")), 0)
    apply(changes(spark, (2, "PUT", 1, [1.0, 0.0], "NEW")), 1)
    assert store.get(1)["url"] == "NEW" and heard == [0, 1]
    store.compact(force=True)
    apply(changes(spark, (3, "PUT", 1, [1.0, 0.0], "NEWER")), 2)
    assert store.get(1)["url"] == "NEWER" and store.partition_stats().agg(F.sum("pending")).first()[0] == 0


def test_x1_order_of_arrival_does_not_matter_after_compaction(spark, store):
    store._append(changes(spark, (20, "PUT", 1, [1.0, 0.0], "a"), (30, "DELETE", 3, None, None)))
    store.compact(force=True)
    store._append(changes(spark, (10, "PUT", 2, [0.0, 1.0], "late"), (15, "PUT", 1, [0.0, 1.0], "older"), (29, "PUT", 3, [0.0, 1.0], "older")))
    for _ in range(2):
        assert {(r["id"], r["url"]) for r in store.rows().collect()} == {(1, "a"), (2, "late")}
        assert store.get(1)["url"] == "a" and store.get(2)["url"] == "late"
        with pytest.raises(NotFound):
            store.get(3)
        store.compact(force=True)
    assert store.changes().count() == 0


def test_k12_ids_are_not_given_again(spark, store):
    assert (store.add([1.0, 0.0], "u"), store.add([0.0, 1.0], "u")) == (1, 2)
    store.delete(2)
    store.compact(force=True)
    assert store.add([1.0, 1.0], "u") == 3
    store.clear()
    store.prune()
    assert store.next_id() == 4 and store.rows().count() == 0


def test_x11_a_writer_that_dies_or_is_overtaken_changes_nothing(spark, store, tmp_path):
    store.add([1.0, 0.0], "u")
    store.compact(force=True)
    v = store._version()
    (tmp_path / "store/versions/99").write_text("99-half")  # died while it wrote the pointer
    again = VectorStore(spark, store.path, 2, 4)
    assert again._version() == v and again.rows().count() == 1
    assert again.compact(force=True) and again._version().number == 100
    with pytest.raises(Conflict):
        store._publish(store._no_rows(), v, v.commit, v.last_id)
    assert store.rows().count() == 1
    (tmp_path / "store/changes/commit=9").mkdir()  # a commit without _SUCCESS
    assert store.changes().count() == 0 and store.next_id() == 2
    for x in (tmp_path / "store/versions").iterdir():
        x.unlink()
    with pytest.raises(ValueError, match="no complete version"):
        VectorStore(spark, store.path, 2, 4)


def test_x5_j8_reconcile_builds_what_is_missing(spark, store):
    store.add_all(spark.createDataFrame([(i, [float(i), 1.0], "u", None) for i in range(1, 40)], ROWS))
    store.compact(force=True)
    first = store.reconcile(m=4)
    assert first["built"] == [0, 1, 2, 3] and store.reconcile() == {"dropped": [], "built": []}
    store._fs.delete(store._path(f"graph/{store._version().base}/part=2"), True)
    assert store.reconcile(m=4) == {"dropped": [], "built": [2]} and store.rebuild(m=4) is None
    q = spark.createDataFrame([(0, [5.0, 1.0])], "query_id long, vector array<float>")
    assert store.search(q, 1, "graph").first()["id"] == 5
    before = store._version()
    store.compact(force=True)
    store.prune(keep=1)
    assert not store._fs.exists(store._path(f"graph/{before.base}"))


def test_k2_repeated_ids_are_refused_and_text_is_searched(spark, store):
    row = (1, [1.0, 0.0], "u", None)
    with pytest.raises(ValidationError, match="once only"):
        store.add_all(spark.createDataFrame([row, row], ROWS))
    store.add_all(spark.createDataFrame([row], ROWS))
    texts = spark.createDataFrame([(7, "a text")], "query_id long, text string")
    assert store.search_text(texts, 1).first()["id"] == 1
    assert store.search_image(texts.select("query_id", F.encode("text", "UTF-8").alias("content")), 1).first()["id"] == 1
    with pytest.raises(Exception, match="blank"):
        store.search_text(spark.createDataFrame([(7, " ")], "query_id long, text string"), 1).collect()
    s = store.stats().first()
    assert s["backlog"] == 1 and s["version"] == 1


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "cosine_f32"])
def test_a_common_vector_gives_k_candidates_only(spark, metric):
    rng = np.random.default_rng(0)
    x = np.r_[np.tile([[0.1, 0.7, 0.3]], (500, 1)), rng.normal(size=(100, 3))].astype(np.float32)
    i, j = search._nearest(x[:3].astype(float), x.astype(float), np.arange(600)[::-1], 5, metric)
    assert len(i) <= 3 * 12
    rows = spark.createDataFrame([(n, v.tolist(), "u", None) for n, v in enumerate(x)], ROWS)
    q = rows.where("id IN (3, 520)").selectExpr("id AS query_id", "vector")
    want = search.top_k(search.score(rows, q, metric), 7).select("query_id", "position", "id", "distance")
    for got in (search.exact(rows, q, 7, metric), search.blocked(rows, q, 7, metric)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
