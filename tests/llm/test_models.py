import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import ann, langid, lm, packing, toxicity
from starling.llm.queries import TOXICITY_CHAIN, op4_learned_partition_ann, tokenizer_path

ODD = [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "123 ... !!"), (None, "some words here"), (1005, "same row"), (1005, "same row"), (1006, "long " * 40_000)]
DOCS = "doc_id long, text string, score string, rejected string, h int, words int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCS)


# ------------------------------------------------------------------ language model


def slow_lm(rows, learn, discount=lm.DISCOUNT, order_bound=lm.NGRAMS):
    """(n_tokens, n_known, N, base, score) by nested dictionaries and recursion."""
    end = ("end",)
    texts = [(t or "").encode().lower().split() + [end] for _, t in rows]
    train = [t for t, use in zip(texts, learn) if use]
    c = {}
    for t in train:
        for w in t:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    base = lambda w: (c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
    grams = {}
    for t in train:
        s = [("start",), *t]
        for k in (2, 3):
            for i in range(len(s) - k + 1):
                grams[tuple(s[i : i + k])] = grams.get(tuple(s[i : i + k]), 0) + 1
    ok = lambda w: w in (("start",), end) or c.get(w, 0) >= n / order_bound
    kept = {g: x for g, x in grams.items() if x >= n / order_bound and all(map(ok, g))}
    kept = {g: x for g, x in kept.items() if len(g) == 2 or (g[:2] in kept and g[1:] in kept)}
    total = lambda h: len(train) if h == (("start",),) else c[h[0]] if len(h) == 1 else grams[h]

    def p(w, h):
        if not h:
            return base(w)
        nexts = [g[-1] for g in kept if g[:-1] == h]
        if not nexts:
            return p(w, h[1:])
        if (*h, w) in kept:
            return (kept[*h, w] - discount) / total(h)
        left = 1 - sum((kept[*h, x] - discount) / total(h) for x in nexts)
        return left / (1 - sum(p(x, h[1:]) for x in nexts)) * p(w, h[1:])

    out = []
    for t in texts:
        s = [("start",), *t]
        score = sum(math.log10(p(s[i], tuple(s[max(0, i - 2) : i]))) for i in range(1, len(s)))
        out.append((len(t), sum(w in c for w in t), n, sum(math.log10(base(w)) for w in t), score))
    return out


@pytest.mark.parametrize("bounds", [(1 << 20, 1 << 16), (40, 25)])
def test_lm_against_recursion(spark, bounds):
    rng = random.Random(1)
    vocabulary = "the of a to and in is it that was".split() + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[20] * 10 + [1] * 40, k=rng.randrange(1, 40)))) for i in range(60)] + ODD[:-1]
    docs = docs_of(spark, rows)
    learn = [r["h"] for r in docs.select((~lm.held_out(F.col("doc_id"))).alias("h")).collect()]
    got = lm.score_documents(docs, ~lm.held_out(F.col("doc_id")), *bounds).collect()
    want = slow_lm(rows, learn, order_bound=bounds[1])
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    a = sorted((tuple(r) for r in got), key=key)
    b = sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4:] for x in a], [x[4:] for x in b])


def test_lm_keeps_ngrams_that_occur_once(spark):
    docs = docs_of(spark, [(1, "filler " * 70_000), (2, "once only here"), (3, "once only there")])
    got = {r["doc_id"]: r for r in lm.score_documents(docs, F.col("doc_id") < 3).collect()}
    assert math.isclose(got[2]["score"], math.log10(0.25 / 2) + 3 * math.log10(0.25))
    assert got[3]["score"] > got[3]["base_score"]


def test_lm_over_many_slices_buckets_and_dealt_histories(spark, monkeypatch):
    for name, value in (("SLICE_TOKENS", 200), ("REQUESTS", 150), ("HISTORY", 20)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(2)
    rows = [(i, " ".join(["the of"] * (i % 3) + [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randrange(30))])) for i in range(60)] + ODD[:-1]
    docs = docs_of(spark, rows)
    learn = [r["h"] for r in docs.select((~lm.held_out(F.col("doc_id"))).alias("h")).collect()]
    got = sorted((tuple(r) for r in lm.score_documents(docs, ~lm.held_out(F.col("doc_id"))).collect()), key=str)
    want = sorted(((d, *w) for (d, _), w in zip(rows, slow_lm(rows, learn, order_bound=1 << 40))), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want] and np.allclose([x[4:] for x in got], [x[4:] for x in want])


def test_lm_long_text_and_common_pairs(spark, monkeypatch):
    for name, value in (("SLICE_TOKENS", 5_000), ("REQUESTS", 2_000), ("HISTORY", 300)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(3)
    long = " ".join("the of" if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(8_000))
    rows = [(1, long), (2, "the of " * 900), (3, long[:300]), (4, "never seen the of words"), (None, "the of w1"), (6, None), (6, None)]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in lm.score_documents(docs_of(spark, rows), F.col("doc_id").isin(1, 2, 6)).collect())
    grams, follow = {}, {}
    texts = [["<s>", *(t or "").split(), "</s>"] for _, t in rows]
    for (i, _), t in zip(rows, texts):
        for k in (1, 2, 3):
            for a in range(len(t) - k + 1) if i in (1, 2, 6) else ():
                g = tuple(t[a : a + k])
                if g[-1] != "<s>" and not (k == 1 and g[0] == "<s>"):
                    grams[g] = grams.get(g, 0) + 1
                    if grams[g] == 1:
                        follow.setdefault(g[:-1], []).append(g[-1])
    starts = sum(i in (1, 2, 6) for i, _ in rows)
    n, v, memo = sum(c for g, c in grams.items() if len(g) == 1), len(follow[()]), {}

    def p(w, h):
        if not h:
            return (grams.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))
        if h not in follow:
            return p(w, h[1:])
        total = starts if h == ("<s>",) else grams[h]
        if (*h, w) in grams:
            return (grams[*h, w] - lm.DISCOUNT) / total
        if h not in memo:
            memo[h] = (1 - sum((grams[*h, x] - lm.DISCOUNT) / total for x in follow[h])) / (1 - sum(p(x, h[1:]) for x in follow[h]))
        return memo[h] * p(w, h[1:])

    want = sorted((i or 0, len(t) - 1, sum(math.log10(p(t[a], tuple(t[max(0, a - 2) : a]))) for a in range(1, len(t)))) for (i, _), t in zip(rows, texts))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_lm_without_training_and_empty(spark):
    got = lm.score_documents(docs_of(spark, [(1, "a b")]), F.lit(False)).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"], got["score"]) == (3, 0, 0, 0.0, 0.0)
    assert lm.score_documents(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_lm_beats_its_base_on_held_out_text(spark, sf_dir):
    r = lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~lm.held_out(F.col("doc_id"))).where(lm.held_out(F.col("doc_id"))).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# ------------------------------------------------------------------ language identification


def test_language_held_out_accuracy_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = lm.held_out(F.col("doc_id"), 4, 2)
    net = langid.train(docs.where(~out))
    got = langid.predict(docs.where(out), net).join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    odd = langid.predict(docs_of(spark, ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert by[1001] == by[1002] == by[1003] == by[1004] == "und" and by[1005] != "und"
    assert langid.predict(docs_of(spark, ODD).limit(0), net).count() == 0
    nothing = langid.train(docs.limit(0))
    assert nothing is None and langid.predict(docs_of(spark, ODD), nothing).where("lang_pred <> 'und'").count() == 0


def test_windows_cover_whole_texts():
    raw = bytes(range(1, 256)) * 3
    w = langid.windows(raw)
    assert w.size >= len(raw) and w.tobytes()[: len(raw)] == raw.lower()


def test_network_gradients():
    rng = np.random.default_rng(1)
    w = np.where(rng.random((64, langid.WINDOW)) < 0.5, 97, rng.integers(98, 122, (64, langid.WINDOW))).astype(np.uint8)
    y = np.arange(64) % 2
    w[y == 1, ::3] = 122
    net = langid.train_network(w, y, ["a", "b"], epochs=60)
    assert (net.forward(w)[2].argmax(axis=1) == y).mean() == 1.0
    assert (net.filters * (1 - langid._mask()) == 0).all()


# ------------------------------------------------------------------ toxicity


def test_toxicity_held_out_and_odd_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    chain = toxicity.train(docs, labels.where(~fold), TOXICITY_CHAIN)
    r = toxicity.score(docs, chain, "toxic").join(labels.where(fold), "doc_id").agg(F.count_if(F.expr("rejected AND toxic = 1")), F.sum("toxic"), F.count_if(F.expr("rejected AND toxic = 0"))).first()
    assert r[0] / r[1] > 0.7 and r[2] <= 3
    odd = toxicity.score(docs_of(spark, ODD), chain, "toxic").collect()
    assert len(odd) == len(ODD) and not any(r["rejected"] for r in odd if not (r["text"] or "").strip())
    assert set(odd[0].asDict()) == {"doc_id", "text", "score", "h", "words", "p_quality", "p_toxic", "rejected"}
    assert toxicity.score(docs_of(spark, ODD).limit(0), chain, "toxic").count() == 0


def test_chain_uses_earlier_categories_and_survives_gaps(spark):
    rng = np.random.default_rng(0)
    a = rng.random(400) < 0.5
    rows = [np.array([5 if x else 6, 100 + i % 7], np.int32) for i, x in enumerate(a)]
    b = a.astype(float).copy()
    b[::10] = np.nan
    chain = toxicity.fit_chain(rows, {"first": a.astype(float), "second": b})
    assert abs(chain.models[1].dense[0]) > 0
    assert ((chain.log_odds(rows)[:, 1] > 0) == a).all()
    never = toxicity.fit_chain(rows, {"x": np.zeros(400)})
    assert (never.log_odds(rows) < -10).all()
    none = toxicity.train(docs_of(spark, [(1, "a b")]), spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"), TOXICITY_CHAIN)
    assert not toxicity.score(docs_of(spark, ODD), none, "toxic").where("rejected").count()


def test_toxicity_worker_memory(spark, monkeypatch):
    """A worker holds one batch's texts, the features of a slice, and nothing that an earlier operator kept."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 300), i -> concat('w', pmod(hash(id, i), 9999))), ' ') AS text")
    chain = toxicity.Chain(["toxic"], [toxicity.Linear(np.array([3, 7, 2000], np.int32), np.array([1.0, -2.0, 0.5]), np.zeros(0), 0.1)])
    whole = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, chain, "toxic").collect()}
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: found.append((self.toArrow().combine_chunks().to_batches()[0], f)))
    toxicity.score(docs, chain, "toxic")
    [(batch, run)] = found
    assert batch.schema.names == ["doc_id", "text"]  # each text once
    before = packing.encoder(tokenizer_path())
    assert packing.encoder(tokenizer_path()) is before
    tracemalloc.start()
    got, sizes = {}, []
    for b in run(iter([batch])):
        got |= dict(zip(b["doc_id"].to_pylist(), b["p_toxic"].to_pylist()))
        sizes.append(b.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == whole and max(sizes) <= toxicity.TOGETHER and peak < 12e6
    assert packing.encoder(tokenizer_path()) is not before


# ------------------------------------------------------------------ nearest neighbours


def slow_nearest(rows, modulus, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) and len(v) == 8]
    best = {}
    for i, v in fine:
        best.setdefault(i, []).append(v)
    out = []
    for i in best:
        if i % modulus == 0:
            q = min(best[i], key=lambda v: tuple(v))
            scored = sorted(((-max(float(q @ v) for v in best[j]), j) for j in best if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_ann_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    v = lambda: [float(np.float32(x)) for x in rng.normal(size=8)]
    rows = [(i, v()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(None, v()), (300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0, None] + [0.0] * 6), (380, [float("inf")] * 8), (400, [1.0, 2.0]), (420, [])]
    rows += [rows[0], rows[3], (3, v()), (20, v())]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, part string, v int")
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20).collect()
    want = slow_nearest(rows, 20, 20)
    assert [tuple(r)[:3] for r in sorted(map(tuple, got))] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in sorted(map(tuple, got))], [w[3] for w in want])
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(table.where("vec_id IN (0, 1)"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert [tuple(r)[:3] for r in few] == [(0, 1, 1)]


def test_ann_recall(spark):
    d = "/root/testdata/sf0.1"
    r = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(r["embedding"]).astype(float)
    ids = r["vec_id"].to_numpy()
    got = op4_learned_partition_ann(spark, d).toPandas()
    hits = n = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(top) & set(g["vec_id"]))
        n += 20
        assert g.sort_values("rank")["score"].is_monotonic_decreasing and len(g) == 20
    assert n == 20 * (ids % 20 == 0).sum() and hits / n >= 0.9


def _recall(spark, ids, x, k=20, modulus=20, **options):
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % modulus == 0, k, **options).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = n = 0
    for i in np.flatnonzero(ids % modulus == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(by[ids[i]]) & set(ids[np.lexsort((ids, -s))[:k]].tolist()))
        n += k
        assert len(by[ids[i]]) == k
    return hits / n


def test_ann_recall_on_clusters_through_learned_parts(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 24)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 24)) * 0.5 for c in centers]).astype(np.float32).astype(float)
    ids = rng.permutation(len(x))
    router = ann.fit(x, 24, parts=16)
    assert router.parts == 16 and router.probes < 16
    assert _recall(spark, ids, x, parts=16) >= 0.9
    assert _recall(spark, np.arange(500), x[:500]) >= 0.9  # the sizes of small tables


def test_ann_goes_on_to_further_parts_and_odd_rows_in_the_learned_path(spark):
    rng = np.random.default_rng(6)
    v = lambda: [float(np.float32(x)) for x in rng.normal(size=8)]
    rows = [(i, v()) for i in range(400)] + [(500 + i, [1.0] * 8) for i in range(30)]
    rows += [(None, v()), (600, None), (620, [0.0] * 8), (640, [float("nan")] * 8), (660, [1.0, None] + [0.0] * 6), (700, []), rows[0], (3, v()), (20, v())]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, part string, chunk int")
    x = np.array([r[1] for r in rows[:430]])
    one = ann.fit(x, 8, parts=8)
    one.probes = 1
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20, router=one).collect()
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(per) == {i for i in range(0, 400, 20)} | {500, 520} and all([p for p, *_ in sorted(l)] == list(range(1, 21)) for l in per.values())
    one.probes = one.parts
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20, router=one).collect()
    want = slow_nearest(rows, 20, 20)
    assert [tuple(r)[:3] for r in sorted(map(tuple, got))] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in sorted(map(tuple, got))], [w[3] for w in want])


def test_graph_parts_are_balanced():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(200, 16)) for c in centers])
    part = ann.cut_graph(x, ann.neighbours(x, x, 10, np.arange(len(x))), 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= 1600 / 8 * 1.05 + 1 and sizes.min() >= 1600 / 8 / 1.05 - 1
    assert ann.fit(x, 16, parts=8).probes < 8
