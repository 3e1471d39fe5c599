"""Approximate nearest neighbours over learned partitions (operator 4).

On a bounded sample, a graph of nearest neighbours (largest inner product) is cut into balanced parts; a small classifier
learns to tell from a vector which parts its neighbours are in. Every row is filed under its most probable part. A query is
routed to its `probes` most probable parts, whose rows are reranked by the exact measure, the inner product of the original
vectors in double precision. `probes` is the least that reaches target_recall on sample queries that the classifier wasn't
trained on; at worst it is all parts, which is exact.

How it runs: there is about one part for PART_ROWS rows (from LEAST_PARTS to MOST_PARTS). Rows of a part are dealt by hash into chunks of bounded
size; a row goes to one task, a query to the chunks of its parts. A task holds one chunk and streams the queries past it; each chunk
gives its own best k for each query, and a ranking over those gives the result. A query whose parts hold fewer than 10 k + 1
different ids goes on to its next probable parts until they do.

Defined cases: null ids and vectors that are null, empty, zero, of another dimension than most of the sample, or that hold null
or non-finite components take no part, neither as queries nor as candidates; ties go to the smaller id; several rows of one id
are one candidate with its best score, and one query with its smallest vector; fewer candidates than k: all are returned; tables of
up to 10 k different ids are searched whole; from fewer than 8 rows nothing is learned and there is one part; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_ROWS = 6_000
PART_ROWS, LEAST_PARTS, MOST_PARTS = 2_048, 16, 256
CHUNK, BLOCK = 32_768, 1_024


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def neighbours(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of x with the largest inner product to each q, without row own[i]."""
    out = np.empty((len(q), k), np.int64)
    for i in range(0, len(q), 512):
        s = q[i : i + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + 512]] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def cut_graph(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.05, passes: int = 10) -> np.ndarray:
    """Balanced parts of a neighbour graph: halving along principal directions, then moves to the part with most neighbours
    while sizes stay within the slack."""
    n = len(x)
    part = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        fresh = np.empty(n, np.int64)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            y = x[rows] - x[rows].mean(axis=0)
            _, vectors = np.linalg.eigh(y.T @ y)
            order = np.argsort(y @ vectors[:, -1], kind="stable")
            fresh[rows[order]] = 2 * p + (np.arange(len(rows)) >= len(rows) // 2)
        part = fresh
    ends = np.r_[np.c_[np.repeat(np.arange(n), near.shape[1]), near.ravel()], np.c_[near.ravel(), np.repeat(np.arange(n), near.shape[1])]]
    links = np.zeros((n, parts), np.int64)
    np.add.at(links, (ends[:, 0], part[ends[:, 1]]), 1)
    order = np.argsort(ends[:, 0], kind="stable")
    around = np.split(ends[order, 1], np.cumsum(np.bincount(ends[:, 0], minlength=n))[:-1])
    sizes = np.bincount(part, minlength=parts)
    low, high = n / parts / slack, n / parts * slack
    for _ in range(passes):
        gain = links.max(axis=1) - links[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            a = part[i]
            for b in np.argsort(-links[i], kind="stable")[:3]:
                if links[i, b] <= links[i, a]:
                    break
                if sizes[b] + 1 <= high and sizes[a] - 1 >= low:
                    part[i] = b
                    sizes[a] -= 1
                    sizes[b] += 1
                    np.add.at(links, (around[i], a), -1)
                    np.add.at(links, (around[i], b), 1)
                    moved += 1
                    break
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; probabilities of the parts."""

    layers: list[np.ndarray]
    dim: int
    parts: int
    probes: int

    def log_p(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1))
        w1, b1, w2, b2 = self.layers
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        return z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, rate: float = 3e-3) -> list[np.ndarray]:
    """Adam on the cross-entropy against the distribution of each row's neighbours over the parts."""
    rng = np.random.default_rng(0)
    d, p = x.shape[1], target.shape[1]
    scale = 1 / max(np.sqrt((x**2).sum(axis=1).mean()), 1e-12)
    layers = [rng.normal(0, 1, (d, hidden)) * scale, np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, p)), np.zeros(p)]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    t = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ layers[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate([x[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)]):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                layers[i] -= rate * (scale if i == 0 else 1) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-12)
    return layers


def fit(x: np.ndarray, dim: int, parts: int = 16, graph_k: int = 10, k: int = 20, target_recall: float = 0.95) -> Router:
    """x: sample vectors. A fifth of them is held out to find the number of probes."""
    parts = min(parts, len(x) // 4)
    if parts < 2:
        return Router([], dim, 1, 1)
    parts = 1 << int(math.log2(parts))
    held = np.arange(len(x)) % 5 == 0
    seen, asked = x[~held], x[held]
    graph_k = min(graph_k, len(seen) - 1)
    near = neighbours(seen, seen, graph_k, np.arange(len(seen)))
    part = cut_graph(seen, near, parts)
    target = np.zeros((len(seen), parts))
    np.add.at(target, (np.arange(len(seen)), part), 1)
    np.add.at(target, (np.repeat(np.arange(len(seen)), graph_k), part[near].ravel()), 1)
    router = Router(train_router(seen, target / (graph_k + 1)), dim, parts, parts)
    filed = np.argmax(router.log_p(seen), axis=1)
    truth = filed[neighbours(seen, asked, min(k, len(seen)))]
    order = np.argsort(-router.log_p(asked), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(place, truth, axis=1)
    recall = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(recall) >= min(target_recall, recall[-1])))
    return router


def fit_sample(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Router:
    """Fit on the sample_rows usable rows with the smallest hash of their id."""
    if "parts" not in options:
        options["parts"] = min(MOST_PARTS, max(LEAST_PARTS, 1 << round(math.log2(max(1, rows.count() / PART_ROWS)))))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()["v"].to_pylist()
    if not got:
        return Router([], 1, 1, 1)
    dim = Counter(map(len, got)).most_common(1)[0][0]
    return fit(np.array([x for x in got if len(x) == dim], np.float64), dim, **options)


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, score) of the k best rows of x, sorted by id, for each query, an id once, never the query's own."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    s = q @ x.T
    s[query_ids[:, None] == ids[None, :]] = -np.inf
    by_id = s if len(starts) == len(ids) else np.maximum.reduceat(s, starts, axis=1)
    least = -np.partition(-by_id, k - 1, axis=1)[:, k - 1] if by_id.shape[1] > k else np.full(len(q), -np.finfo(float).max)
    size = np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max())
    i, j = np.nonzero((s >= (least - 1e-12 * size)[:, None]) & (s > -np.inf))
    exact = np.concatenate([(q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], ids[j[order]], exact[order]
    if len(starts) < len(ids):  # the best row of an id only
        pair = np.unique(np.c_[i, j], axis=0, return_index=True)[1]
        pair.sort()
        i, j, exact = i[pair], j[pair], exact[pair]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return query_ids[i[rank < k]], j[rank < k], exact[rank < k]


def stream(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best of each query in each chunk, from rows (part, chunk, asks, vec_id, v) in this order: a chunk's vectors, then its queries."""
    at, ids, held, x = None, [], [], None
    for b in batches:
        part, chunk, asks, vec_id = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(part):
            continue
        v = matrix(b.column(4), dim)
        edge = np.flatnonzero((part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(part)]):
            if at != (part[s], chunk[s]):
                at, ids, held, x = (part[s], chunk[s]), [], [], None
            if not asks[s]:
                ids.append(vec_id[s:e])
                held.append(v[s:e])
                continue
            if not ids:
                continue
            if x is None:
                every = np.concatenate(ids)
                order = np.argsort(every, kind="stable")
                every, x, held = every[order], np.concatenate(held)[order], []
            for a in range(s, e, BLOCK):
                found = _best(vec_id[a : min(e, a + BLOCK)], v[a : min(e, a + BLOCK)], every, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, router: Router | None = None, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows to each row for which is_query (over id_col) holds."""
    rows = vectors.where(F.col(id_col).isNotNull() & is_query.isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    router = router or fit_sample(rows, **options)
    dim, array = router.dim, rows.schema["v"].dataType.simpleString()
    rows = rows.where(F.size("v") == dim)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.argmax(router.log_p(matrix(b.column(1), dim)), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    index = materialize(rows.mapInArrow(file, f"vec_id long, v {array}, asks boolean, part int"), "ann-index")
    # different ids of a part, an id that lies in several counted in one; at most MOST_PARTS rows
    sizes = np.zeros(router.parts, np.int64)
    for r in index.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = np.argsort(-router.log_p(matrix(b.column(1), dim)), axis=1, kind="stable")
            n = np.minimum(router.parts, np.maximum(router.probes, 1 + (np.cumsum(sizes[best], axis=1) < 10 * k + 1).sum(axis=1)))
            lists = pa.array([r[:c] for r, c in zip(best.tolist(), n.tolist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "parts"])

    queries = index.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(route, f"vec_id long, v {array}, parts array<int>")
    chunks = -(-(index.groupBy("part").count().agg(F.max("count")).first()[0] or 1) // CHUNK)
    x = index.select("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk"), F.lit(False).alias("asks"), "vec_id", "v")
    q = queries.select(F.explode("parts").alias("part"), "vec_id", "v").select("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(True).alias("asks"), "vec_id", "v")
    met = x.unionByName(q).repartition("part", "chunk").sortWithinPartitions("part", "chunk", "asks")
    met = met.mapInArrow(lambda batches: stream(batches, dim, k), "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # rows of one id may be in several parts
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
