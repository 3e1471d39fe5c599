import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from starling.llm import packing, sharding, simhash
from starling.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, fp string, trie int"
ODD = [
    (1, None, "x", 1), (2, "", "x", 1), (3, " \n\t ", None, None), (None, "one two three four five six", "x", 1), (4, "one two three four five six", "y", 2),
    (4, "one two three four five six", "y", 2), (5, "Short text", "y", 2), (6, "é" * 30 + "   x  y\n\n\nz " + "w " * 5000, "y", 2), (7, "a <|endoftext|> b", "z", 3),
]


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], format(fps[i], "016x"), min(ids, default=None)))
    return out


def slow_similar(rows, width=5, similarity=0.8):
    """Smallest doc_id of each row's component, by all pairs of shingle sets."""
    sets, label = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b) - 1e-9 and bool(a) == bool(b):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(3000)], k=rng.randrange(60, 200)))) for i in range(60)]
    for i in range(240):
        words = rng.choice(rows[:60])[1].split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "Two words"), (504, "two words"), (505, "two"), (506, rows[3][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {}
    for r in simhash.similar_documents(docs).collect():
        got.setdefault(r["root"], []).append(r["doc_id"])
    mine = {d: min(ids) for ids in got.values() for d in ids}
    want = slow_similar(rows)
    assert set(mine) == set(want) and mine[501] == mine[502] == 500 and mine[504] == 503 and mine[505] == 505
    assert all(want[d] == want[m] for d, m in mine.items())  # no false link
    assert sum(mine[d] == m for d, m in want.items() if d != m) >= 0.97 * sum(d != m for d, m in want.items())
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_sampled_masks_catch_pairs_at_the_threshold():
    rng = random.Random(4)
    for n in (1000, 200_000):
        masks, found = simhash.sampled_masks(n, 0.8), 0
        for _ in range(300):
            d = sum(1 << b for b in range(64) if rng.random() < 0.1518)
            found += any(m & d == 0 for m in masks)
        assert found >= 0.75 * 300


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("ab bc cd de ef fg gh hi ij".split(), k=120)) for _ in range(12)]
    rows = [(r[0], r[1]) for r in ODD]
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(simhash.F.col("fp")), "component_id").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(slow_components(rows), key=key)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,spread", [(300, 64), (400, 9), (2000, 14)])
def test_trie_links_equal_brute_force(n, spread):
    rng = random.Random(n)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << rng.randrange(spread) for _ in range(1)) ^ (rng.getrandbits(spread) & rng.getrandbits(spread)) for _ in range(n)})

    def classes(edges):
        p = {x: x for x in fps}

        def find(x):
            while p[x] != x:
                p[x] = p[p[x]]
                x = p[x]
            return x

        for a, b in edges:
            p[find(a)] = find(b)
        out = {}
        for x in fps:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    brute = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    got = simhash.trie_links(np.array(fps, np.uint64), 4)
    assert classes(got) == classes(brute) and len(got) < len(fps)


def test_block_masks_keep_every_link():
    rng = random.Random(1)
    for n in (1, 10**5, 10**8, 10**12):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & d == 0 for m in masks)


def test_encoder_equals_whole_encoding(spark):
    e = packing.Encoder(tokenizer_path())
    texts = [r[1] or "" for r in ODD] + ["x\ny z\n\nw", " lead", "trail ", "tab\tbed x", "don't stop's 12 3,4..  é́ ñ\nüber", "\r\n a"]
    texts += [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert e.cuts
    for t in texts:
        assert e.encode(t) == e.encode_whole(t), t[:80]


@pytest.mark.parametrize("n,cap", [(0, 10), (1, 10), (200, 16), (3000, 1024)])
def test_minimum_bin_slack(n, cap):
    rng = random.Random(n)
    counts = {}
    for _ in range(n):
        x = rng.randint(1, cap)
        counts[x] = counts.get(x, 0) + 1
    plan = packing.fill_bins(counts, cap)
    left = dict(counts)
    for bins, used in plan:
        assert sum(a * k for a, k in used) <= cap
        for a, k in used:
            left[a] -= bins * k
    assert not any(left.values())
    bins = sum(b for b, _ in plan)
    assert bins <= math.ceil(sum(a * c for a, c in counts.items()) / cap) * 1.03 + 1


def test_packing_round_trip(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).select("doc_id", "text", "fp").withColumnRenamed("fp", "offset")
    path = tokenizer_path()
    placed = packing.pack_documents(docs, path).cache()
    rows = placed.collect()
    assert {r[0] for r in ODD} == {r["doc_id"] for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    packed = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed, path).collect()}
    for r in rows:
        part = packed[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert all(n == 1024 for _, n in long[1:]) and long[0][0] == 0
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_dynamic_program_fills_bins_as_exhaustive_search():
    rng = random.Random(9)
    for _ in range(40):
        cap = rng.randint(5, 24)
        counts = {}
        for _ in range(rng.randint(1, 9)):
            x = rng.randint(1, cap)
            counts[x] = counts.get(x, 0) + 1
        left = [n for n, c in counts.items() for _ in range(c)]
        for bins, used in packing.fill_bins(counts, cap):
            for _ in range(bins):
                own = [n for n, k in used for _ in range(k)]
                rest = list(left)
                rest.remove(max(left))
                sums = [sum(x for i, x in enumerate(rest) if mask >> i & 1) for mask in range(1 << len(rest))]
                assert sum(own) == max(left) + max(x for x in sums if x + max(left) <= cap) and max(left) in own
                for n in own:
                    left.remove(n)
        assert not left


def naive_differencing(sizes, k):
    tuples = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(tuples) > 1:
        tuples.sort(key=lambda t: t[0] - t[-1])
        a, b = tuples.pop(), tuples.pop()
        tuples.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return tuples[0]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_differencing_against_a_naive_loop_and_all_partitions(k):
    rng = random.Random(k)
    for _ in range(20):
        sizes = rng.sample(range(1, 10_000), 7 if k < 5 else 6)
        places, sums = sharding.difference([[s] + [0] * (k - 1) for s in sizes], k)
        got = [0] * k
        for s, p in zip(sizes, places):
            got[p[0]] += s
        assert sorted(got) == sorted(sums) == sorted(naive_differencing(sizes, k))
        best = min(max(sum(s for s, x in zip(sizes, label) if x == j) for j in range(k)) for label in itertools.product(range(k), repeat=len(sizes)))
        assert best <= max(got) <= best * 4 / 3 + 1


def test_sharding_in_buckets_of_any_size(spark):
    rng = random.Random(7)
    rows = [(i, f"{i} " + "x" * rng.randrange(400), "size", 1) for i in range(500)] + [(900 + i, "same text in a third of the rows", None, None) for i in range(250)]
    rows += [rows[0], (None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "fp AS size", "trie AS shard", "trie AS slot", "text AS h1", "1 AS n", "2 AS bytes")
    d = docs.selectExpr("octet_length(coalesce(text, '')) + 1L AS size", "xxhash64(text) AS h1").groupBy("h1").agg(sharding.F.sum("size").alias("bytes"))
    groups = sharding.materialize(d, "test-groups")
    for bucket_rows, fan in ((2, 200), (25, 100), (60, 10_000), (1000, 10_000)):
        placed = sharding.assign(groups, ["h1"], 4, bucket_rows, fan).join(groups, "h1")
        sizes = [r["b"] for r in placed.groupBy("shard").agg(sharding.F.sum("bytes").alias("b")).collect()]
        assert len(sizes) == 4 and max(sizes) < 1.02 * sum(sizes) / 4
    got = sharding.assign(groups, ["h1"], 4, bucket_rows=60).join(groups, "h1").groupBy("shard").agg(sharding.F.sum("bytes").alias("b"), sharding.F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == groups.count() and max(r["b"] for r in got) < 1.05 * sum(r["b"] for r in got) / 4
    out = sharding.shard_documents(docs, 4, 20).collect()
    assert len(out) == len(rows) and len({r["shard"] for r in out if (r["doc_id"] or 0) >= 900}) == 1


def test_differencing_small_cases():
    places, sums = sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]], 2)
    got = [0, 0]
    for size, p in zip((8, 7, 6, 5, 4), places):
        got[p[0]] += size
    assert sorted(got) == sorted(sums) and max(got) - min(got) <= 2
    assert sharding.difference([], 3)[1] == [0, 0, 0]


@pytest.mark.parametrize("bucket_rows", [40, 50_000])
def test_sharding(spark, bucket_rows):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(400), None, None) for i in range(600)] + [(r[0], r[1], "a", 1) for r in ODD]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_documents(docs, 16, bucket_rows).collect()
    assert len(got) == len(rows)
    sizes, slots, of = {}, {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(v) == 1 for k, v in of.items() if k[0] > 1)
    mean = sum(sizes.values()) / 16
    biggest = max(max(v for v in sizes.values()), mean)
    assert biggest == max(sizes.values()) and sorted(sizes.values())[-2] - min(sizes.values()) < 0.05 * mean
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_offsets_a_large_group_in_another_bucket(spark):
    rng = random.Random(6)
    rows = [(i, f"{i} " + "x" * rng.randrange(400), None, None) for i in range(600)] + [(-1, "y" * 6600, None, None)]
    sizes = {}
    for r in sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 16, 40).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 16 and max(sizes.values()) < 1.02 * sum(sizes.values()) / 16
