"""Language-model scoring with a weighted backoff automaton (operator 10).

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the whole text lower-cased in A-Z, then one end token. The model is an n-gram
model (`order` 3) with absolute discounting that backs off to the smoothed unigrams (c + 0.5) / (N + 0.5 (V + 1)), so its
probabilities over known tokens and one unknown sum to 1. Histories that continue are the states; an arc gives a token's
log-probability and the next state; a failure arc gives the backoff weight and a shorter history.

How: every n-gram of the training documents is in the model (`ngram_bound` can leave out rare ones), so the model grows with the
corpus and lies in tables, dealt by 64-bit hashes. Texts are cut into words once, into slices of about SLICE_TOKENS that hold their
distinct words. A slice asks for the counts of its words, then for its distinct trigrams (u, v, w), with their occurrences in its
training documents. These are dealt by the middle word: one task then sees all that follows v and all that follows (u, v), so it
knows the arcs and the failure weights of both states and answers with what the slice's traversal needs. A trigram comes once from
a slice. Words v with more than HISTORY occurrences are too much for one task: for them the bigrams (v, w) are added up first, dealt
by both words, and their trigrams are dealt by (u, v), those of a (u, v) with more than HISTORY occurrences by w as well. Only the
partial sums of such histories, at most 2 N / HISTORY of them, meet on the driver; beyond 5e10 tokens HISTORY grows with N, so that
there are 200,000 at most. Beside v, words are told apart by 40 bits of their hashes.

Defined cases: null and empty texts have the end token only; without training documents N and V are 0 and every token has
probability 1; a null doc_id is held out; repeated rows are scored each; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

VOCABULARY = 1 << 20
NGRAMS = 1 << 16
DISCOUNT = 0.75
SEED = 42
#: Tokens of a slice, n-grams that a task adds up at once, and occurrences of a history above which it is dealt further.
SLICE_TOKENS, REQUESTS, HISTORY = 1_000_000, 700_000, 300_000
#: Turns in which the trigrams are sent, so that fewer are on disk at once.
TURNS = 4
#: Histories that may meet on the driver.
SHARED = 100_000
NONE = -1
START, END, NOTHING = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == part, F.lit(True))


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


class _Places(dict):
    """word -> place by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


SLICES = "slice long, n_tokens long, n_words long, n_train long, doc_ids array<long>, lengths binary, train binary, words binary, places binary"


def cut(docs: DataFrame, train: Column) -> DataFrame:
    """Slices: documents with their lengths and whether they are learned from, hashes of distinct words, words of all texts by place."""
    limit = SLICE_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, ids, train, n = _Places(), [], [], [], 0

        def out() -> pa.RecordBatch:
            h = xxhash.xxh64_intdigest
            words = np.fromiter((h(w, SEED) for w in known), np.uint64, len(known))
            lengths = np.array([len(x) for x in held], np.int32)
            row = [uuid.uuid4().int >> 65, int(lengths.sum()), len(known), sum(train), ids, lengths.tobytes(), np.array(train, bool).tobytes(), words.tobytes(), _packed(np.concatenate(held))]
            names = ["slice", "n_tokens", "n_words", "n_train", "doc_ids", "lengths", "train", "words", "places"]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for b in batches:
            for doc_id, raw, use in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = tokens(raw.as_py())
                held.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                train.append(use)
                n += len(words) + 1
                if n >= limit:
                    yield out()
                    known, held, ids, train, n = _Places(), [], [], [], 0
        if held:
            yield out()

    own = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return own.mapInArrow(run, SLICES)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns compressed byte by byte place, as counts are mostly small; hashes repeat as they are."""
    return pa.compress(b"".join(x.tobytes() if x.dtype == np.uint64 else x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, *types: type) -> list[np.ndarray]:
    size = n * sum(np.dtype(t).itemsize for t in types)
    whole, at, out = np.frombuffer(pa.decompress(raw, size, codec="zstd", asbytes=True), np.uint8), 0, []
    for t in types:
        wide = np.dtype(t).itemsize
        part = whole[at : at + n * wide]
        out.append(part.view(t) if t == np.uint64 else np.ascontiguousarray(part.reshape(wide, n).T).reshape(-1).view(t))
        at += n * wide
    return out


#: The columns of requests. Of a word: its hash and its occurrences. Of an n-gram: 40 bits of its u and its w; occurrences;
#: those of (u, v) where that is dealt further; and those that give the shorter probability. N-grams are sorted by v, and each v of
#: a message comes with its occurrences and its number of rows.
WORD = {"hash": np.uint64, "k": np.uint32}
GRAM = {"u_low": np.uint32, "u_high": np.uint8, "w_low": np.uint32, "w_high": np.uint8, "k": np.uint32, "total": np.uint32, "lower": np.uint32}
MIDDLE = {"v": np.uint64, "c": np.uint32, "rows": np.uint32}
#: The columns of replies: counts of the n-gram and its history, and the log10 of what backs off, where it isn't in the model.
ANSWER = {1: {"c": np.uint32}, 2: {"c": np.uint32}, 3: {"c": np.uint32, "above": np.uint32, "rest": np.float64}}
MESSAGE = "bucket int, slice long, size int, middles int, body binary, heads binary"
REPLY = "level int, bucket int, slice long, size int, body binary, n long, v long, top long, shared binary"
#: Of the sums of a history: its key, the probability given to its continuations, and what the shorter history gives them.
SUMS = np.dtype([("history", np.uint64), ("given", np.float64), ("lower", np.float64)])


def _unpacked_all(bodies: pa.ChunkedArray, sizes: list[int], kinds: dict) -> dict[str, np.ndarray]:
    """The columns of all bodies, one after another."""
    parts = [_unpacked(raw.as_py(), n, *kinds.values()) for raw, n in zip(bodies, sizes)]
    return {name: np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, (name, t) in enumerate(kinds.items())}


def _short(h: np.ndarray) -> np.ndarray:
    """40 bits of a hash."""
    return h >> np.uint64(24)


def _low_high(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (_short(h) & np.uint64(0xFFFFFFFF)).astype(np.uint32), (_short(h) >> np.uint64(32)).astype(np.uint8)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal keys, in order of the key: a row of each, and each row's group."""
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _base(c: np.ndarray, model: dict) -> np.ndarray:
    return (c + 0.5) / (model["n"] + 0.5 * (model["v"] + 1))


def _log_weight(sums: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(1 - sums["given"], 1e-12) / np.maximum(1 - sums["lower"], 1e-12))


def _sums(at: np.ndarray, n: int, given: np.ndarray, lower: np.ndarray) -> np.ndarray:
    sums = np.zeros(n, SUMS)
    sums["given"], sums["lower"] = np.bincount(at, given, n), np.bincount(at, lower, n)
    return sums


class Slice:
    """The n-grams of a slice, and what is known of them from the replies so far."""

    def __init__(self, t: pa.Table, replies: pa.Table, model: dict):
        row = t.to_pylist()[0]
        self.id, self.doc_ids, self.model, self.replies = row["slice"], row["doc_ids"], model, replies
        words, lengths = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["lengths"], np.int32)
        start, end, nothing = (len(words) + i for i in range(3))
        self.words, self.hash = words, np.r_[words, START, END, NOTHING]
        # nothing, start, words, end of each text, one after another
        first = np.cumsum(np.r_[0, lengths + 3])[:-1]
        at = np.ones(int((lengths + 3).sum()), bool)
        at[first] = at[first + 1] = at[first + lengths + 2] = False
        self.seq = np.full(len(at), end, np.int64)
        self.seq[at] = _unpacked(row["places"], row["n_tokens"], np.int32)[0]
        self.seq[first], self.seq[first + 1] = nothing, start
        real = np.ones(len(at), bool)
        real[first] = real[first + 1] = False
        self.at = np.flatnonzero(real)  # of the tokens
        self.doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.use = np.frombuffer(row["train"], bool)[self.doc]
        self.nothing = nothing

    def heard(self, level: int, order: np.ndarray, of: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """The answers for the n-grams `of` n, which were sent in this order."""
        mine = self.replies.filter(pa.compute.equal(self.replies["level"], level)).sort_by("bucket")
        got = _unpacked_all(mine["body"], mine["size"].to_pylist(), ANSWER[level])
        out = {name: np.zeros(n, t) for name, t in ANSWER[level].items()}
        for name, x in got.items():
            out[name][of[order]] = x
        return out

    def dealt(self, level: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, and the order in which they are sent."""
        bucket = (key % np.uint64(self.model["buckets"][level])).astype(np.int32)
        return bucket, np.argsort(bucket, kind="stable")

    def one(self) -> tuple[dict, np.ndarray, np.ndarray]:
        w = self.seq[self.at[self.use]]
        k = np.bincount(w[w < len(self.words)], minlength=len(self.words))
        return {"hash": self.words, "k": k}, *self.dealt(1, _mix(self.words, END))

    def words_known(self) -> None:
        _, _, order = self.one()
        docs = self.model["docs"]
        every = np.arange(len(self.words))
        self.c1 = np.r_[self.heard(1, order, every, len(every))["c"].astype(np.int64), docs, docs, 0]  # the start's is a history's total
        self.hot = self.c1 >= self.model["most"]
        self.base = np.log10(_base(self.c1, self.model))

    def two(self) -> tuple[dict, np.ndarray, np.ndarray]:
        """Distinct bigrams (v, w) after words that are dealt further."""
        self.words_known()
        v, w, n = self.seq[self.at - 1], self.seq[self.at], len(self.hash)
        follows = np.flatnonzero(self.hot[v])
        self.pairs, at = np.unique(v[follows] * n + w[follows], return_inverse=True)
        v, w, k = self.pairs // n, self.pairs % n, np.bincount(at, self.use[follows], len(self.pairs)).astype(np.int64)
        parts = 1 + self.c1[v] // self.model["most"]
        bucket, order = self.dealt(2, _mix(_mix(self.hash[v], START), self.hash[w] % parts.astype(np.uint64)))
        low, high = _low_high(self.hash[w])
        none = np.zeros(len(v), np.uint32)
        return {"place": v, "u_low": none, "u_high": none, "w_low": low, "w_high": high, "k": k, "total": none, "lower": self.c1[w]}, bucket, order

    def _weights(self, level: int, keys: np.ndarray) -> np.ndarray:
        """log10 weights of histories that met on the driver; 0 for others."""
        known, weight = self.model["shared"][level]
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, weight[at], 0)

    def pairs_known(self) -> None:
        _, _, order = self.two()
        self.c2 = self.heard(2, order, np.arange(len(self.pairs)), len(self.pairs))["c"].astype(np.int64)
        v, w = self.pairs // len(self.hash), self.pairs % len(self.hash)
        away = self._weights(2, self.hash[v]) + self.base[w]
        self.p2 = np.where(self.c2 >= self.model["least"], np.log10(np.maximum(self.c2 - DISCOUNT, 0.01) / np.maximum(self.c1[v], 1)), away)

    def pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Places of bigrams among self.pairs; anything for those that aren't there."""
        return np.minimum(np.searchsorted(self.pairs, v * len(self.hash) + w), max(0, len(self.pairs) - 1))

    def three(self, low: int = 0, high: int | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
        """Distinct trigrams (u, v, w) that are asked for in the buckets from low up to high: where v is known and (u, v) may be."""
        self.pairs_known()
        u, v, w, n, least, most = self.seq[self.at - 2], self.seq[self.at - 1], self.seq[self.at], len(self.hash), self.model["least"], self.model["most"]
        buckets = np.uint64(self.model["buckets"][3])
        hot = np.flatnonzero(self.hot[v])
        total = np.zeros(len(hot), np.int64)
        both = self.hot[u[hot]]
        total[both] = self.c2[self.pair(u[hot[both]], v[hot[both]])]
        key = history = _mix(_short(self.hash[u[hot]]), self.hash[v[hot]])
        bucket = (_mix(self.hash, END) % buckets).astype(np.int32)[v]
        dealt = total >= most
        key = np.where(dealt, _mix(history, self.hash[w[hot]] % (1 + total // most).astype(np.uint64)), history)
        bucket[hot] = (_mix(key, END) % buckets).astype(np.int32)
        bucket[hot[(u[hot] == self.nothing) | both & (total < least)]] = NONE
        bucket[self.c1[v] == 0] = NONE
        # log10 of the shorter probability where it is known, of what backs off to it where that met on the driver
        self.known = np.zeros(len(v))
        self.known[hot] = self.p2[self.pair(v[hot], w[hot])] + np.where(dealt, self._weights(3, history), 0)
        self.known[self.c1[v] == 0] = self.base[w[self.c1[v] == 0]]
        self.asks = np.flatnonzero((bucket >= low) & (bucket < (buckets if high is None else high)))
        u, v, w = u[self.asks], v[self.asks], w[self.asks]
        if n < 1 << 21:
            pair = v * n + u
        else:  # a text of millions of different words
            long, pair = np.unique(v * n + u, return_inverse=True)
        first, self.triple = _groups(pair * n + w)
        here = np.zeros(len(self.doc), np.int64)
        here[hot[dealt]] = total[dealt]
        total = here[self.asks[first]]
        k = np.bincount(self.triple, self.use[self.asks], len(first)).astype(np.int64)
        bucket, u, v, w = bucket[self.asks[first]], u[first], v[first], w[first]
        lower, hot = self.c1[w], self.hot[v]
        lower[hot] = self.c2[self.pair(v[hot], w[hot])]
        (u_low, u_high), (w_low, w_high) = _low_high(self.hash[u]), _low_high(self.hash[w])
        return {"place": v, "u_low": u_low, "u_high": u_high, "w_low": w_low, "w_high": w_high, "k": k, "total": total, "lower": lower}, bucket, np.argsort(bucket, kind="stable")

    def scores(self) -> pa.Table:
        _, _, order = self.three()
        got = self.heard(3, order, np.arange(len(order)), len(order))
        arc = np.log10(np.maximum(got["c"] - DISCOUNT, 0.01) / np.maximum(got["above"], 1))
        log_p, kept = self.known, got["c"] >= self.model["least"]
        log_p[self.asks] = np.where(kept[self.triple], arc[self.triple], got["rest"][self.triple] + log_p[self.asks])
        w, n = self.seq[self.at], len(self.doc_ids)
        known, base, score = (np.bincount(self.doc, x, n) for x in (self.c1[w] > 0, self.base[w], log_p))
        columns = [pa.array(self.doc_ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in (np.bincount(self.doc, minlength=n), known)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def messages(self, level: int, low: int, high: int) -> pa.Table:
        """The requests of a level to the buckets from low up to high."""
        q, bucket, order = self.three(low, high) if level == 3 else self.two() if level == 2 else self.one()
        to, sizes = np.unique(bucket, return_counts=True)
        ends = np.cumsum(sizes)
        rows = []
        for t, a, b in zip(to.tolist(), (ends - sizes).tolist(), ends.tolist()):
            if low <= t < high:
                own = order[a:b]
                columns, heads, middles = {n: x[own] for n, x in q.items()}, None, 0
                if level > 1:
                    places, runs = np.unique(columns["place"], return_counts=True)
                    middles, heads = len(places), _packed(self.hash[places], self.c1[places].astype(np.uint32), runs.astype(np.uint32))
                kinds = WORD if level == 1 else GRAM
                rows.append((t, self.id, b - a, middles, _packed(*(columns[n].astype(d) for n, d in kinds.items())), heads))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=MESSAGE.split()[::2])


def _added(key: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of equal keys: a row, the sum of k, and each row's group."""
    first, at = _groups(key)
    return first, np.bincount(at, k, len(first)).astype(np.int64), at


def _answer(t: pa.Table, level: int, model: dict) -> pa.Table:
    """Adds up all requests of a bucket and answers them."""
    sizes, least = t["size"].to_pylist(), model["least"]
    q = _unpacked_all(t["body"], sizes, WORD if level == 1 else GRAM)
    shared, v, top = np.zeros(0, SUMS), 0, 0
    if level == 1:
        _, total, at = _added(q["hash"], q["k"])
        top = int(total.max(initial=0))
        v, out = int((total > 0).sum()), {"c": total[at]}
    else:
        heads = _unpacked_all(t["heads"], t["middles"].to_pylist(), MIDDLE)
        of, rows = _groups(heads["v"])[1], heads["rows"]
        of, middle, c1 = np.repeat(of, rows), np.repeat(heads["v"], rows), np.repeat(heads["c"].astype(float), rows)
        u, w = (q[x + "_low"].astype(np.uint64) | q[x + "_high"].astype(np.uint64) << np.uint64(32) for x in "uw")
        lower = q["lower"].astype(float)
        hot = c1 >= model["most"]
        vw_first, vw_total, vw = _added(_mix(middle, w), q["k"])
        # what follows v: arcs of the model and their sums
        kept = vw_total >= least
        rows = vw_first[kept]
        given, known = (vw_total[kept] - DISCOUNT) / c1[rows], _base(lower[rows], model)
        after = _sums(of[rows], int(of.max(initial=-1)) + 1, given, known)
        after["history"][of] = middle
        if level == 2:
            shared, out = after, {"c": vw_total[vw]}
        else:
            history = _mix(u, middle)
            uv_first, uv_total, uv = _added(history, q["k"])
            first, total, at = _added(_mix(history, w), q["k"])
            dealt = q["total"][uv_first] > 0  # (u, v) of which this bucket has a share
            above = np.where(dealt, q["total"][uv_first], uv_total)
            kept = total >= least
            rows = first[kept]
            below = np.where(hot, lower, vw_total[vw])
            sums = _sums(uv[rows], len(above), (total[kept] - DISCOUNT) / above[uv[rows]], (below[rows] - DISCOUNT) / c1[rows])
            p2 = np.where(vw_total[vw] >= least, np.log10(np.maximum(vw_total[vw] - DISCOUNT, 0.01) / np.maximum(c1, 1)), _log_weight(after)[of] + np.log10(_base(lower, model)))
            rest = np.where(dealt[uv] | (u == _short(NOTHING)), 0, _log_weight(sums)[uv]) + np.where(hot, 0, p2)
            c = total[at]
            out = {"c": c, "above": np.where(c >= least, above[uv], 0), "rest": np.where(c >= least, 0, rest)}
            sums["history"] = history[uv_first]
            shared = sums[dealt]
    n, ends = t.num_rows, np.cumsum(sizes).tolist()
    once = lambda x, other: [x] + [other] * (n - 1)
    bodies = [_packed(*(out[x][a:b].astype(d) for x, d in ANSWER[level].items())) for a, b in zip([0, *ends], ends)]
    return pa.table({
        "level": pa.array([level] * n, pa.int32()), "bucket": t["bucket"], "slice": t["slice"], "size": t["size"], "body": pa.array(bodies, pa.binary()),
        "n": pa.array(once(int(q["k"].sum()), 0), pa.int64()), "v": pa.array(once(v, 0), pa.int64()), "top": pa.array(once(top, 0), pa.int64()), "shared": pa.array(once(shared.tobytes() or None, None), pa.binary()),
    })


def _with_replies(slices: DataFrame, replies: DataFrame, f, schema: str) -> DataFrame:
    """f(slice row, its replies) of every slice."""
    empty = pa.schema([pa.field(x, pa.null()) for x in schema.split()[::2]]).empty_table()
    return slices.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(lambda a, b: f(a, b) if a.num_rows else empty, schema)


def ask(slices: DataFrame, replies: DataFrame, level: int, model: dict, turn: int = 0, turns: int = 1) -> DataFrame:
    """The replies of a level to all slices, those of one of `turns` equal ranges of buckets."""
    n = model["buckets"][level]
    low, high = n * turn // turns, n * (turn + 1) // turns
    sent = _with_replies(slices, replies, lambda t, heard: Slice(t, heard, model).messages(level, low, high), MESSAGE)
    return materialize(sent.groupBy("bucket").applyInArrow(lambda t: _answer(t, level, model), REPLY), f"lm-{level}")


def _shared(replies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Histories that were dealt further, sorted, and their log10 weights."""
    parts = np.concatenate([np.zeros(0, SUMS), *(np.frombuffer(r["shared"], SUMS) for r in replies.where("shared IS NOT NULL").select("shared").toLocalIterator())])
    sums = np.zeros(len(np.unique(parts["history"])), SUMS)
    sums["history"], at = np.unique(parts["history"], return_inverse=True)
    for x in ("given", "lower"):
        sums[x] = np.bincount(at, parts[x], len(sums))
    return sums["history"], _log_weight(sums)


def score_documents(docs: DataFrame, train: Column | None = None, vocabulary_bound: int | None = None, ngram_bound: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; the rows where `train` is true are learned from.
    By default all their n-grams are; given ngram_bound, those with at least N / ngram_bound occurrences. All words are counted and
    looked up in the same way, so vocabulary_bound changes nothing."""
    slices = materialize(cut(docs, F.lit(True) if train is None else train), "lm-slices")
    size = slices.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_tokens", "n_words", F.size("doc_ids"), "n_train")]).first()
    buckets = lambda n: max(1, -(-n // REQUESTS))
    none = (np.zeros(0, np.uint64), np.zeros(0))
    model = {"docs": size[3], "n": 0, "v": 0, "least": 1, "most": HISTORY, "shared": {2: none, 3: none}, "buckets": {1: buckets(size[1]), 2: buckets(size[0]), 3: buckets(size[0] + size[2])}}
    replies = ask(slices, docs.sparkSession.createDataFrame([], REPLY), 1, model)
    n, v, top = replies.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("v"), F.max("top"))]).first()
    model |= {"n": n + size[3], "v": v + (size[3] > 0)}
    model |= {"least": max(1, model["n"] / ngram_bound) if ngram_bound else 1, "most": max(HISTORY, model["n"] // SHARED)}
    turns = [(3, i, TURNS) for i in range(TURNS)]
    if max(top, size[3]) >= model["most"]:
        turns.insert(0, (2, 0, 1))
    answered = []
    for level, turn, of in turns:
        new = ask(slices, replies, level, dict(model), turn, of)
        answered.append(new)
        if level == 2:
            model["shared"] = model["shared"] | {2: _shared(new)}
            replies = replies.unionAll(new)
    model["shared"] = model["shared"] | {3: _shared(reduce(DataFrame.unionAll, answered).where("level = 3"))}
    replies = reduce(DataFrame.unionAll, [x for x, (level, _, _) in zip(answered, turns) if level == 3], replies)
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    scored = _with_replies(slices, replies, lambda t, heard: Slice(t, heard, model).scores(), schema)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
