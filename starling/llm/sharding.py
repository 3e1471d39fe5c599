"""Sharding of indivisible groups by Karmarkar-Karp differencing (operator 9).

Documents with equal texts form a group, which stays whole. Sizes are UTF-8 bytes of the text plus 1. The law is `bytes`: shard
sizes near equal (as near as the largest group lets them be).

How: the state of differencing is a set of partial partitions, each an ordered tuple of k subset sums. Repeatedly the two with
the largest spread are combined, oppositely ordered, until one is left. Groups are dealt by hash into buckets of about
BUCKET; each bucket is differenced in a task of bounded memory into one partial partition, and a task differences those. Where there are
several buckets, a group with more than 1/LARGE of a shard's share of a bucket stays out of them and enters that differencing as a tuple
of its own, since its bucket could not offset it: fewer than LARGE * k such groups for each bucket. Where these can't offset each other
(a few giants), as large a share of the other groups, chosen by hash, stays out too as is needed to offset them. More than FAN tuples are dealt over
several tasks: those too wide for one of them are placed first, in the same way, and their partial partition, divided by the number of
tasks, is a tuple of every task, so that all together offset what no single one could. Texts are never shuffled: a group's key is a
128-bit hash with the size and CRC-32, and nothing but k sums reaches the driver.

Defined cases: a null text has size 1 and CRC 0, and null texts form a group of their own; null doc_ids and repeated rows are
rows like any other (slots of equal rows are interchangeable); an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash128, join_back, materialize, ranked

#: Groups differenced by one task, some 40 MB.
BUCKET = 50_000
#: Partial partitions differenced by one task, some 130 MB.
FAN = 200_000
LARGE = 4
ALONE = -1


def difference(tuples: list[list[int]], k: int) -> tuple[np.ndarray, list[int]]:
    """Karmarkar-Karp over partial partitions of k sums each: (for each tuple the shard of each of its k places, the sums)."""
    n = len(tuples)
    if not n:
        return np.zeros((0, k), np.int16), [0] * k
    child = np.zeros((2 * n - 1, k), np.int16)  # of a node's places, the places in its parent
    parent = np.full(2 * n - 1, -1, np.int64)
    sums: dict[int, list[int]] = {}
    heap = []
    for i, t in enumerate(tuples):
        order = sorted(range(k), key=lambda j: -t[j])
        child[i, order] = np.arange(k)  # place -> place when sorted downwards
        sums[i] = [t[j] for j in order]
        heap.append((sums[i][-1] - sums[i][0], i))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        a, b = sums.pop(x), sums.pop(y)
        c = [p + q for p, q in zip(a, reversed(b))]
        order = sorted(range(k), key=lambda j: -c[j])
        rank = np.empty(k, np.int16)
        rank[order] = np.arange(k)
        parent[x] = parent[y] = made
        child[x] = rank[child[x]]
        child[y] = rank[::-1][child[y]]
        child[made] = np.arange(k)
        sums[made] = [c[j] for j in order]
        heapq.heappush(heap, (sums[made][-1] - sums[made][0], made))
        made += 1
    for i in range(made - 2, -1, -1):  # from the root down: places become shards
        child[i] = child[parent[i]][child[i]]
    return child[:n], sums[made - 1]


def _held(placed: DataFrame, tuples: DataFrame, names: list[str], shards: int) -> list[int]:
    """Bytes of each shard."""
    parts = placed.join(tuples, names).select(F.inline(F.arrays_zip("shards", "sums"))).groupBy("shards").agg(F.sum("sums").alias("b"))
    sums = {r["shards"]: r["b"] for r in parts.collect()}  # a row for each shard
    return [sums.get(j, 0) for j in range(shards)]


def combine(tuples: DataFrame, names: list[str], shards: int, fan: int) -> DataFrame:
    """names (not null, as pandas would make them floats) and `shards`: for each tuple (names, sums) the shards of its places."""
    total = F.aggregate("sums", F.lit(0).cast("long"), lambda a, b: a + b)
    n, size = tuples.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    tasks = -(-max(1, n) // fan)
    held, placed = [0] * shards, None
    if tasks > 1:
        wide = (F.array_max("sums") - F.array_min("sums")) * (LARGE * shards * tasks) > F.lit(size)
        first = materialize(tuples.where(wide), "shard-wide")
        placed = materialize(combine(first, names, shards, 2 * fan), "shard-wide-places")
        held = [b // tasks for b in _held(placed, first, names, shards)]
        tuples = tuples.where(~wide)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ignore_index=True)
        places, _ = difference([held] + [list(map(int, x)) for x in pdf["sums"]], shards)
        own = np.empty(shards, np.int64)
        own[places[0]] = np.arange(shards)  # what was placed first keeps its shards
        return pdf[names].assign(shards=own[places[1:]].tolist())

    schema = ", ".join(f"`{n}` {t}" for n, t in tuples.select(*names).dtypes) + ", shards array<int>"
    dealt = tuples.withColumn("__task", F.pmod(F.xxhash64(F.lit("task"), *names), F.lit(tasks)))
    rest = dealt.groupBy("__task").applyInPandas(within, schema)
    return rest if placed is None else rest.unionByName(placed)


def assign(groups: DataFrame, keys: list[str], shards: int, bucket_rows: int = BUCKET, fan: int = FAN) -> DataFrame:
    """keys and `shard` of groups (materialised; non-null `keys` and total `bytes`)."""
    total, size = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_rows))
    alone = F.array(F.col("bytes"), *[F.lit(0).cast("long")] * (shards - 1)).alias("sums")
    is_large = F.lit(buckets > 1) & (F.col("bytes") * (LARGE * shards * buckets) > F.lit(size))
    if buckets > 1:
        large = materialize(groups.where(is_large).select(*keys, alone), "shard-large")
        held = _held(materialize(combine(large, keys, shards, fan), "shard-large-places"), large, keys, shards)
        share = min(1.0, 2 * shards * (max(held) - min(held)) / max(1, size))
        is_large = is_large | (F.pmod(F.xxhash64(F.lit("alone"), *keys), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    dealt = groups.where(~is_large).select(*keys, "bytes", F.pmod(F.xxhash64(F.lit("bucket"), *keys), F.lit(buckets)).cast("int").alias("bucket"))
    schema = ", ".join(f"{n} {t}" for n, t in dealt.dtypes) + ", label int"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", *keys], ascending=False, ignore_index=True)
        places, _ = difference([[int(b)] + [0] * (shards - 1) for b in pdf["bytes"]], shards)
        return pdf.assign(label=places[:, 0].astype("int32"))

    labelled = materialize(dealt.groupBy("bucket").applyInPandas(within, schema), "shard-labels")
    sums = labelled.groupBy("bucket").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("label") == i, F.col("bytes"))), F.lit(0)) for i in range(shards)]).alias("sums"))
    no_key = [F.lit(0).cast(t).alias(n) for n, t in groups.select(*keys).dtypes]
    tuples = materialize(sums.select("bucket", *no_key, "sums").unionAll(groups.where(is_large).select(F.lit(ALONE), *keys, alone)), "shard-tuples")
    placed = materialize(combine(tuples, ["bucket", *keys], shards, fan), "shard-places")
    joined = labelled.join(placed.where(F.col("bucket") != ALONE).select("bucket", "shards"), "bucket").select(*keys, F.get("shards", F.col("label")).alias("shard"))
    return joined.unionAll(placed.where(F.col("bucket") == ALONE).select(*keys, F.get("shards", F.lit(0)).alias("shard")))


def shard_documents(docs: DataFrame, shards: int = 16, bucket_rows: int = BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    h1, h2 = hash128(F.col("text"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = materialize(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), h1.alias("h1"), h2.alias("h2")),
        "shard-rows",
    )
    keys = ["h1", "h2", "size", "text_crc32"]
    groups = materialize(rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    own = materialize(assign(groups, keys, shards, bucket_rows).join(groups.select(*keys, "n"), keys), "shard-of-group")
    placed = materialize(join_back(rows, own, keys), "shard-placed")
    slots = ranked(placed, ["shard"], ["doc_id", "h1", "h2"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
