"""Language identification with a convolutional network over bytes (operator 6).

Lower-cased (A-Z) UTF-8 bytes are embedded; filters of widths 2, 3 and 4 run over windows of WINDOW bytes; each filter's
largest response in a window goes to a softmax over the languages. The network is trained in numpy on a bounded sample of
labelled texts (SAMPLE_ROWS documents, at most WINDOWS_EACH windows of each, spread over the text; documented bounds). It is
applied to all windows of whole texts, in batches; a text's language is the one with the largest log-probability averaged over
its bytes.

Defined cases: a null or empty text, or one without a letter, is `und` with score 0; null languages are not learned from;
without anything to learn from, all is `und`; with one language, that one; ties go to the smaller name; repeated rows are
judged each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
SAMPLE_ROWS, WINDOWS_EACH, EPOCHS = 4_000, 4, 4
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_SPAN = max(WIDTHS)


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "ignore")))


def windows(raw: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes of a whole text; the last one is filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.lower().ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (_SPAN * EMBED, filters); narrower ones are zero at their end
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, w: np.ndarray) -> np.ndarray:
        x = self.embed[w]
        t = WINDOW - _SPAN + 1
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(w), t, _SPAN * EMBED), (s[0], s[1], s[2]))

    def forward(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patches, pooled responses before the rectifier, log-probabilities."""
        p = self.patches(w)
        pooled = (p.reshape(-1, p.shape[2]) @ self.filters).reshape(len(w), p.shape[1], -1).max(axis=1) + self.bias
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        z = z - z.max(axis=1, keepdims=True)
        return p, pooled, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _mask() -> np.ndarray:
    """Which filter weights there are."""
    return np.concatenate([np.repeat((np.arange(_SPAN) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)


def train_network(w: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 4e-3) -> Network:
    """w: windows; y: places in languages."""
    rng = np.random.default_rng(0)
    n = len(WIDTHS) * FILTERS
    mask = _mask()
    draw = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    net = Network(languages, draw(256, EMBED) * 0.5, draw(_SPAN * EMBED, n) * mask * 0.25, np.zeros(n, np.float32), draw(n, len(languages)) * 0.2, np.zeros(len(languages), np.float32))
    weights = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(a) for a in weights], [np.zeros_like(a) for a in weights]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(w)), max(1, len(w) // 64)):
            x = w[rows]
            p = net.patches(x)
            response = (p.reshape(-1, p.shape[2]) @ net.filters).reshape(len(x), p.shape[1], n)
            at = response.argmax(axis=1)  # (windows, filters)
            pooled = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + net.bias
            h = np.maximum(pooled, 0)
            z = h @ net.out + net.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(x)), y[rows]] -= 1
            g /= len(x)
            back = (g @ net.out.T) * (pooled > 0)
            best = p[np.arange(len(x))[:, None], at]  # the winning patches: (windows, filters, span * embed)
            to_patch = back[:, :, None] * net.filters.T[None]
            to_embed = np.zeros_like(net.embed)
            which = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(_SPAN)]
            np.add.at(to_embed, which.ravel(), to_patch.reshape(-1, EMBED))
            grads = [to_embed, np.einsum("bf,bfk->kf", back, best) * mask, back.sum(axis=0), h.T @ g, g.sum(axis=0)]
            step += 1
            for i, grad in enumerate(grads):
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.001 * (grad**2 - v[i])
                weights[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, windows_each: int = WINDOWS_EACH) -> Network | None:
    """Learn from the text and lang of the sample_rows labelled documents with the smallest hash of their text."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.encode("text", "UTF-8").alias("text"), "lang", F.xxhash64("text").alias("h"))
    some = labelled.select("h", "lang").orderBy("h", "lang").limit(sample_rows).agg(F.max("h").alias("top")).first()["top"]
    if some is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, str, bytes]] = []
            for raw, lang, h in zip(*(c.to_pylist() for c in b.columns)):
                if has_letter(raw):
                    w = windows(raw)
                    take = np.unique(np.linspace(0, len(w) - 1, windows_each).astype(int))
                    found += [(h, lang, w[i].tobytes()) for i in take]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 3, (pa.int64(), pa.string(), pa.binary()))], ["h", "lang", "w"])

    sample = labelled.where(F.col("h") <= some).mapInArrow(run, "h long, lang string, w binary")
    got = sample.orderBy("h", "lang", "w").limit(sample_rows * windows_each).toArrow()  # the limit holds for copies too
    if not got.num_rows:
        return None
    names = got["lang"].to_pylist()
    languages = sorted(set(names))
    w = np.frombuffer(b"".join(got["w"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train_network(w, np.array([languages.index(x) for x in names]), languages)


def judge(net: Network | None, texts: list[bytes | None], batch: int = 512) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    asked = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
    sums = np.zeros((len(texts), len(net.languages) if net else 0))
    held, owners = [], []

    def flush() -> None:
        if held:
            w, owner = np.concatenate(held), np.concatenate(owners)
            for i in range(0, len(w), batch):
                part = w[i : i + batch]
                np.add.at(sums, owner[i : i + batch], net.forward(part)[2] * (part > 0).sum(axis=1, keepdims=True))
            held.clear()
            owners.clear()

    for i in asked:
        w = windows(texts[i])
        held.append(w)
        owners.append(np.full(len(w), i))
        if sum(map(len, owners[-64:])) > 16 * batch or len(owners) >= 64:
            flush()
    flush()
    for i in asked:
        z = sums[i] / max(1, len(texts[i]))
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        langs[i], scores[i] = net.languages[best], p[best] / p.sum()
    return langs, scores


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = judge(net, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
