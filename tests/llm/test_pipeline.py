import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starling.llm import queries, toxicity
from test_native_operators import slow_items, slow_lines
from test_simhash_packing_sharding import slow_similar


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The tables before and after each stage."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, f in corpus_pipeline.STAGES:
        p = str(tmp_path_factory.mktemp("p") / name)
        f(spark, out[-1], sf_dir).write.parquet(p)
        out.append(spark.read.parquet(p))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_stages_against_brute_force(spark, sf_dir, stages):
    docs, clean, deduped, single, safe, packed = stages
    for t in stages[1:-1]:
        assert t.columns == docs.columns
    judged = queries.judge_toxicity(docs, spark, sf_dir)
    assert {d for d, _ in texts(clean)} == {r["doc_id"] for r in judged.where("NOT rejected").collect()}
    want = {d: (n, h) for d, _, n, h in slow_lines(texts(clean))}
    got = {r["doc_id"]: r["h"] for r in deduped.select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("h")).collect()}
    assert got == {d: h for d, (_, h) in want.items()}
    stay, want = {d for d, _ in texts(single)}, set(slow_similar(texts(deduped)).values())
    assert want <= stay and len(stay - want) <= 0.1 * (deduped.count() - len(want))  # candidates are sampled, links are exact
    bench = [(r["item_id"], r["text"]) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    hit = {d for d, *_ in slow_items(texts(single), bench)}
    assert {str(d) for d, _ in texts(safe)} == {str(d) for d, _ in texts(single)} - hit
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in texts(safe)}


def test_odd_tables(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e", None, "s", 9), (3, "x " * 50_000, "en", None, None), (4, "a b c d e", "en", "s", 9), (None, "p q r s t u", None, None, 1), (None, "entirely other words are here", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            table = f(spark, table, sf_dir)
        ids = [r["doc_id"] for r in table.where("piece = 0").collect()]
        assert not ids or sorted(map(str, ids)) == ["1", "3", "4", "None", "None"]


def test_run_gives_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert toxicity.SAMPLE_ROWS > 0
