"""Toxicity by a chain of linear classifiers (operator 8).

The categories of a label table are predicted one after another. Each category has a logistic model over the words of a text
and the log-odds of all earlier categories. In training these log-odds are out of fold: a document gets them from a model
that was fitted without it, so that later models see earlier predictions as they will be on unseen text.

Features are the distinct words of a whole text, lower-cased in A-Z, cut at white space and ASCII punctuation, and the first
PREFIXES bytes of longer ones (inflected and compound forms), hashed to 2**HASH_BITS; for each category the features are used
whose likelihood ratio is at least LEAST, the TOP ones at most. The models are fitted on at most sample_rows
labelled documents, chosen by a hash of doc_id (a documented bound; features of the sample, not texts, reach the driver). All
documents are scored, whole, in one pass without a shuffle; a worker holds the features of TOGETHER documents at a time.

Defined cases: null and empty texts have no words and are never toxic; a null label leaves a document out of that category's
training; several labels of a document count as their largest; without a positive or without a negative label a category's
probability is 0 or 1 as the labels say, 0 if there are none; repeated rows are scored each; an empty table gives an empty
result; other columns pass through untouched unless named like a result column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by

HASH_BITS = 21
TOP = 4096
LEAST = 15.0
PREFIXES = (4, 5, 6)
FOLDS = 5
SAMPLE_ROWS = 8_000
#: Documents that are scored and sent back together.
TOGETHER = 512
_LETTERS = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def features(raw: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the words and prefixes of a UTF-8 text."""
    words = set((raw or b"").translate(_LETTERS).split())
    found = [zlib.crc32(w) for w in words]
    for n in PREFIXES:
        salt = zlib.crc32(b"%d:" % n)
        found += [zlib.crc32(p, salt) for p in {w[:n] for w in words if len(w) > n}]
    return np.unique(np.array(found, np.uint32) & np.uint32((1 << HASH_BITS) - 1)).astype(np.int32)


@dataclass
class Linear:
    """Logistic regression over chosen hashes and a few dense columns."""

    chosen: np.ndarray  # hashes
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def log_odds(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        place = np.zeros(1 << HASH_BITS, np.int16)  # at most TOP hashes
        place[self.chosen] = np.arange(1, len(self.chosen) + 1)
        weights = np.r_[0.0, self.weights]
        return np.array([weights[place[r]].sum() for r in rows]).reshape(len(rows)) + dense @ self.dense + self.bias


def _select(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The hashes with the largest likelihood ratio between the classes, of those in at least 3 documents."""
    n = 1 << HASH_BITS
    pos, neg = (np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == v] or [np.zeros(0, np.int32)]), minlength=n).astype(float) for v in (1, 0))
    seen = np.flatnonzero(pos + neg >= 3)
    pos, neg = pos[seen], neg[seen]
    total, n1 = pos + neg, float(y.sum())
    n0 = len(y) - n1

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    e1, e0 = total * n1 / len(y), total * n0 / len(y)
    ratio = 2 * (part(pos, e1) + part(neg, e0) + part(n1 - pos, n1 - e1) + part(n0 - neg, n0 - e0))
    good = seen[ratio >= LEAST]
    return np.sort(good[np.argsort(-ratio[ratio >= LEAST], kind="stable")[:TOP]]).astype(np.int32)


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 3e-4) -> Linear:
    """Full-batch Adam on the L2-regularised log loss; the rarer class weighs more, by the square root of the ratio."""
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(0, np.int32), np.zeros(0), np.zeros(dense.shape[1]), 40.0 if len(y) and y[0] else -40.0)
    chosen = _select(rows, y)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    cols = [c[c >= 0] for c in (place[r] for r in rows)]
    flat, owner = np.concatenate(cols), np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    w = np.zeros(len(chosen) + dense.shape[1] + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    k = len(chosen)
    share = np.where(y > 0, np.sqrt((1 - y.mean()) / y.mean()), 1)
    share /= share.sum()
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat], minlength=len(rows)) + dense @ w[k:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        grad = np.concatenate([np.bincount(flat, g[owner], minlength=k), dense.T @ g, [g.sum()]])
        grad[:-1] += decay / 10 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Linear(chosen, w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def log_odds(self, rows: list[np.ndarray]) -> np.ndarray:
        """(documents, categories)."""
        out = np.zeros((len(rows), 0))
        for m in self.models:
            out = np.c_[out, np.clip(m.log_odds(rows, out), -40, 40)]
        return out


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray]) -> Chain:
    """labels: for each category in chain order 0, 1 or NaN."""
    fold = np.arange(len(rows)) % FOLDS
    dense = np.zeros((len(rows), 0))
    models = []
    for y in labels.values():
        known = ~np.isnan(y)
        take = lambda use: ([rows[i] for i in np.flatnonzero(use)], dense[use])
        models.append(fit(*take(known), y[known]))
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            own, rest = fold == f, (fold != f) & known
            unseen[own] = np.clip(fit(*take(rest), y[rest]).log_odds(*take(own)), -40, 40)
        dense = np.c_[dense, unseen]
    return Chain(list(labels), models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit a chain over label columns of 0 and 1, in this order."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(f"__y{i}") for i, c in enumerate(categories)])
    own = [f"__y{i}" for i in range(len(categories))]
    # the bound makes this side small enough to send: sample_rows ids
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("__id"), *own)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select(F.encode("text", "UTF-8").alias("text"), "doc_id", *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed = pa.array([features(x) for x in b.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([hashed, *b.columns[1:]], ["words", *b.schema.names[1:]])

    # repeated documents could exceed the bound: the limit holds for rows too
    table = joined.mapInArrow(run, "words array<int>, doc_id long, " + ", ".join(f"{c} double" for c in own))
    got = table.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toArrow()
    rows = [np.asarray(x.values) for x in got["words"]]
    return fit_chain(rows, {c: got[o].to_numpy().astype(float) for c, o in zip(categories, own)})


def judge(batch: pa.RecordBatch, text: int, chain: Chain, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The batch in slices, with the probability of each category and whether that of category `at` reaches the threshold."""
    names = [*batch.schema.names, *[f"p_{c}" for c in chain.categories], "rejected"]
    for start in range(0, batch.num_rows, TOGETHER):
        b = batch.slice(start, TOGETHER)
        rows = [features(x) for x in b.column(text).cast(pa.binary()).to_pylist()]
        p = 1 / (1 + np.exp(-chain.log_odds(rows)))
        toxic = (p[:, at] >= threshold) & np.array([len(r) > 0 for r in rows], bool)
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in p.T], pa.array(toxic)], names)


def score(docs: DataFrame, chain: Chain, reject: str, threshold: float = 0.5) -> DataFrame:
    """docs with p_<category> for each category and `rejected`: the probability of category `reject` is at least threshold."""
    names = [f"p_{c}" for c in chain.categories]
    at = chain.categories.index(reject)
    kept = [c for c in docs.columns if c not in (*names, "rejected")]
    text = kept.index("text") if "text" in kept else [c.lower() for c in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("toxicity")
        for b in batches:
            yield from judge(b, text, chain, at, threshold)

    schema = ", ".join([f"`{n}` {t}" for n, t in docs.select(*kept).dtypes] + [f"`{n}` double" for n in names] + ["rejected boolean"])
    return docs.select(*kept).mapInArrow(run, schema)
