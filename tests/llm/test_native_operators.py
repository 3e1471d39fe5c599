import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.llm import decontam, line_dedup, url_filters
from starling.llm.queries import URL_RULES
from starling.llm.url_filters import Rule

DOCS = "doc_id long, text string, keep string, h1 int, pos int, w int, mark int, __id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], DOCS)


# ------------------------------------------------------------------ URL filters


def slow_verdict(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and re.match(".*".join(map(re.escape, r.path.split("*"))), path, re.S)]
    best = max(fits, key=lambda r: (len(r.text), r.action, r.text), default=None)
    return host, path, best.text if best else None, best.action if best else default


URLS = [
    None, "", "no scheme", "http://", "http://example.org", "http://EXAMPLE.org/es/1?q", "https://a.b.example.org/en/12", "https://example.org/en/2#x", "ftp://xexample.org/es/",
    "http://shop.com/de/", "http://shop.com/de", "http://shop.com/fr/a://b", "http://com/fr/", "http://net/fr/", "http://shop.com/\n/de/", "x://y.org?/es/", "http://ÉÀ.org/É", "http://a.com/" + "z/" * 3000,
]


@pytest.mark.parametrize("max_inline", [20_000, 0])
def test_urls_against_every_rule(spark, max_inline):
    rules = URL_RULES + [Rule("block", "example.org", "/*/x"), Rule("allow", "shop.com", "/de/"), Rule("block", "shop.com", "/de/")]
    rows = [(i, u, "was", i) for i, u in enumerate(URLS + URLS[:6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, size int")
    got = url_filters.judge_urls(pages, rules, max_inline=max_inline).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["size"]) for r in got) == sorted((i, *slow_verdict(u, rules), z) for i, u, _, z in rows)
    assert url_filters.judge_urls(pages.limit(0), rules, max_inline=max_inline).count() == 0


def test_rules_without_tokens_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string")
    assert url_filters.judge_urls(pages, [Rule("block", "", "/")]).first()["verdict"] == "block"
    assert url_filters.judge_urls(pages, [], default="block").first()["verdict"] == "block"
    assert {e["token"] for e in url_filters.index(URL_RULES)} == {"h:org", "p:es", "p:en", "p:fr", "p:de"}


# ------------------------------------------------------------------ line dedup


def slow_lines(rows, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    low = lambda d: -(10**18) if d is None else d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and low(d) != max(map(low, held[key(x)])))]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [100_000, 3])
def test_lines_against_brute_force(spark, hot):
    rng = random.Random(2)
    pool = [f"this is shared line number {i} é" for i in range(8)] + ["short", "", "  THIS is Shared line number 1 é\t", "exactly twenty chars", "nineteen characters"]
    rows = [(i, "\n".join(rng.choices(pool + [f"own line of document {i} here"], k=rng.randrange(1, 9)))) for i in range(60)]
    rows += [(None, pool[0] + "\n" + pool[0]), (70, None), (71, ""), (72, "\n\n"), (5, rows[5][1]), (5, pool[2]), (80, "\n".join(pool[i % 8] for i in range(3000)))]
    d = docs_of(spark, rows)
    out = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d, hot=hot))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(slow_lines(rows), key=key)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_lines_are_dropped_by_the_stream_and_by_hot_keys_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = lambda **o: line_dedup.keep_bitmaps(docs, **o).groupBy("doc_id").agg(F.sum(F.size(line_dedup.dropped_positions(F.col("keep")))).alias("n"))
    lines = docs.select(F.explode(F.transform(line_dedup.split_lines(F.col("text")), line_dedup.line_key)).alias("key"))
    hashes = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    assert line_dedup.hot_keys(hashes.where("h1 IS NOT NULL"), line_dedup.HOT).count() <= 1  # at most the empty line
    few = line_dedup.hot_keys(hashes, 40).count()
    assert few == hashes.groupBy("h1", "h2").count().where("count > 40").count() > 1
    stream, hot = (sorted(map(tuple, rows(**o).collect())) for o in ({}, {"hot": 2}))
    assert stream == hot and sum(n for _, n in stream) > 1000


def test_lines_beside_clashing_columns(spark):
    d = spark.createDataFrame([(i, "a line that all three share", "x", "y", "z", 1) for i in range(3)], "doc_id long, text string, kept string, own string, mark string, n_lines int")
    got = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).orderBy("doc_id").collect()
    assert [(r["kept"], r["own"], r["mark"], r["n_lines"], r["n_dropped"]) for r in got] == [("", "y", "z", 1, 1)] * 2 + [("a line that all three share", "y", "z", 1, 0)]


def test_bitmaps_are_sparse(spark):
    same = "a line that three documents share"
    text = "\n".join([same] + [f"line {i}" for i in range(500)] + [same])
    got = line_dedup.keep_bitmaps(docs_of(spark, [(1, text), (2, same), (3, same)])).orderBy("doc_id").collect()
    assert [(r["doc_id"], [w["word"] for w in r["keep"]]) for r in got] == [(1, [0, 7]), (2, [0])]


# ------------------------------------------------------------------ decontamination


def slow_items(docs, items, width=5, threshold=0.8):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    best = {}
    for d, t in docs:
        for i, u in items:
            a, b = sh(u), sh(t)
            if a and len(a & b) >= threshold * len(a) - 1e-9:
                best[d, i] = max(best.get((d, i), (0,)), (len(a & b) / len(a), len(a), len(a & b)))
    return sorted(((str(d), str(i), *v) for (d, i), v in best.items()))


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_items_against_brute_force(spark, broadcast_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice("aa bb cc dd ee ff gg hh".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 40)))) for i in range(25)] + [(None, "null id of five words or so"), (3, "second text of item three is this"), (90, None), (91, " \n"), (92, "One")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 200))]
        _, t = rng.choice(items)
        p = (t or "").upper().split()
        for _ in range(rng.randrange(3)):
            if p:
                p[rng.randrange(len(p))] = "zz"
        docs.append((i, "  ".join(w) + "\n" + "\t".join(p) + "\n" + "x " * rng.randrange(3)))
    docs += [(None, items[0][1]), (70, None), (71, ""), (72, "one"), (5, docs[5][1]), (5, items[2][1]), (73, "y " * 30_000 + items[1][1])]
    table = spark.createDataFrame([(*x, "c", 1) for x in items], "item_id long, text string, mark string, w int")
    d = docs_of(spark, docs)
    got = decontam.find_items(d, table, broadcast_bytes=broadcast_bytes).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["containment"], r["n_shingles"], r["n_shared"]) for r in got) == slow_items(docs, items)
    assert len({int(np.log2(r["n_shingles"])) for r in got}) >= 3
    clean = [(x, t) for x, t in docs if not slow_items([(x, t)], items)]
    stay = decontam.remove_contaminated(d, table, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in stay), key=str) == sorted(clean, key=str)
    assert decontam.find_items(d.limit(0), table).count() == decontam.find_items(d, table.limit(0)).count() == 0


def test_clean_rows_of_null_and_repeated_ids_stay(spark):
    items = spark.createDataFrame([(1, "this very item has exactly eight words inside")], "item_id long, text string")
    d = docs_of(spark, [(None, "x this very item has exactly eight words inside y"), (None, "a clean text"), (None, None), (4, "clean too"), (4, "this very item has exactly eight words inside")])
    got = decontam.remove_contaminated(d, items).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, "a clean text"), (None, None), (4, "clean too")], key=str)
    assert got[0]["keep"] == "x" and len(got[0]) == 8


def test_sketches_lose_no_item_of_any_class():
    for threshold in (0.5, 0.8, 0.9, 1.0):
        need = lambda n: n - int(np.ceil(threshold * n - 1e-9)) + 1  # noqa: E731, B023
        for n in range(1, 2000):
            assert need(2 ** (int(np.log2(n)) + 1) - 1) >= need(n)


def test_native_plans_have_no_python(spark):
    d = docs_of(spark, [(1, "a b c d e f")])
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (line_dedup.dedup_lines(d), decontam.find_items(d, items), url_filters.judge_urls(d.select(F.col("text").alias("url")), URL_RULES)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
