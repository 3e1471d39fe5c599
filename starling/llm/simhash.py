"""SimHash near-duplicates: fingerprints, a binary trie self-join, and components (operator 5).

A text is lower-cased in A-Z and cut into words `[^\\x20\\x09-\\x0D]+`; its features are the shingles of `width` words, repeats
included, joined by one space (fewer words: the whole sequence). A fingerprint bit is 1 if more than half of the shingles'
XXH64 values (seed 42) have it. Documents link at `budget` or fewer differing bits; a component is what links reach.

How: equal fingerprints are collapsed first, so copies never meet each other. The distinct fingerprints enter several tries:
the 64 bits form b blocks, and of any two fingerprints within the budget at least b - budget blocks agree, so one trie is
rooted at each choice of b - budget blocks, whose value deals the fingerprints out to tasks (the levels above a root allow no
differing bit). b grows with the number of fingerprints so that about OCCUPANCY share a root; the result doesn't depend on b.
Below a root, node pairs of the trie are traversed together: the bits in which the two prefixes differ are accumulated and a
pair is pruned beyond the budget, or when both nodes already lie in one component, which keeps dense clusters from giving all
their pairs. Each root gives only the edges of a spanning forest. Components follow from repeated minimum labels with pointer
jumping over tables in the shared folder; nothing is collected.

Defined cases: null and empty texts and texts of white space have the fingerprint zero and link like any other; a null doc_id
is ignored as a component's smallest id (a component of null ids only has a null id); repeated rows stay repeated; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_back, kept_by, materialize, words
from .decontam import shingle_hashes
from .line_dedup import text_mark

OCCUPANCY = 16
SEED = 42
#: For links by similarity: differing bits that a candidate may have, members of a root that are compared each with each, and the
#: share of pairs that may share no root, of those that differ in as many bits as pairs at the threshold do on average;
#: masks at least, and masks whose links are found first.
CANDIDATE_BITS, FEW, MISSED, LEAST_MASKS, FIRST_MASKS = 14, 8, 0.01, 128, 8


def fingerprint(raw: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = (raw or b"").lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    hashed = xxhash.xxh64_intdigest
    values = np.fromiter((hashed(text[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 15):
        part = values[i : i + (1 << 15)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, carried columns): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *carry])

    raw = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"), *carry)
    return raw.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"`{n}` {t}" for n, t in docs.select(*carry).dtypes]]))


def trie_links(fps: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Of the fingerprints (distinct, uint64) that link within the budget, pairs that do and that span all these links, as values."""
    a = [int(x) for x in np.sort(fps)]
    n = len(a)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # A node is a range of the sorted values; its prefix ends above `bit`, the highest bit in which they differ.
    nodes: dict[tuple[int, int], list] = {}

    def node(lo: int, hi: int) -> list:
        """[lo, hi, bit, middle, in one component]"""
        if (lo, hi) not in nodes:
            bit = (a[lo] ^ a[hi - 1]).bit_length() - 1
            mid = lo
            if bit >= 0:
                left, right = lo, hi - 1  # the first value with that bit
                while left < right:
                    m = (left + right) // 2
                    left, right = (left, m) if a[m] >> bit & 1 else (m + 1, right)
                mid = left
            nodes[lo, hi] = [lo, hi, bit, mid, hi - lo == 1]
        return nodes[lo, hi]

    def whole(x: list) -> bool:
        if not x[4]:
            x[4] = node(x[0], x[3])[4] and node(x[3], x[1])[4] and find(x[0]) == find(x[3])
        return x[4]

    pairs: list[tuple[int, int]] = []
    todo: list[tuple] = [(node(0, n), None)]
    while todo:
        x, y = todo.pop()
        if y is None:
            if x[2] >= 0:
                left, right = node(x[0], x[3]), node(x[3], x[1])
                todo += [(x, "after"), (left, right), (right, None), (left, None)]
        elif y == "after":
            whole(x)
        else:
            top = max(x[2], y[2]) + 1
            if ((a[x[0]] ^ a[y[0]]) >> top).bit_count() > budget or whole(x) and whole(y) and find(x[0]) == find(y[0]):
                continue
            if top == 0:
                parent[max(find(x[0]), find(y[0]))] = min(find(x[0]), find(y[0]))
                pairs.append((a[x[0]], a[y[0]]))
            elif x[2] >= y[2]:
                todo += [(node(x[3], x[1]), y), (node(x[0], x[3]), y)]
            else:
                todo += [(x, node(y[3], y[1])), (x, node(y[0], y[3]))]
    return pairs


def block_masks(n: int, budget: int) -> list[int]:
    """Masks of the bits that are equal at a root, for n distinct fingerprints."""
    for b in range(budget + 1, 17):
        edges = [64 * i // b for i in range(b + 1)]
        if b == 16 or n <= OCCUPANCY << (64 * (b - budget) // b):
            blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
            return [sum(c) for c in combinations(blocks, b - budget)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sampled_masks(n: int, similarity: float) -> list[int]:
    """Masks for n fingerprints, each of so many random bits that few of them share a root by chance, and as many masks as let all but
    MISSED of the pairs of this Jaccard similarity share one."""
    agree = 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi  # of a bit, for sets of equal size
    bits = min(40, max(6, math.ceil(math.log2(max(2, n))) + 1))
    rng = random.Random(SEED)
    return [sum(1 << b for b in rng.sample(range(64), bits)) for _ in range(max(LEAST_MASKS, math.ceil(math.log(1 / MISSED) / agree**bits)))]


def close_pairs(fps: np.ndarray, group: np.ndarray, label: np.ndarray, budget: int) -> np.ndarray:
    """Pairs of the fingerprints (uint64, sorted by group) of one group and different labels within the budget: all pairs of groups of up
    to FEW members, those of the trie traversal of larger ones."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[: len(group)]
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= FEW, sizes)
    out = [np.zeros((0, 2), np.uint64)]
    for lag in range(1, FEW):
        i = np.flatnonzero(small[lag:] & (group[lag:] == group[:-lag]) & (label[lag:] != label[:-lag]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= budget]
        out.append(np.c_[fps[i], fps[i + lag]])
    for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        own = label[s : s + n]
        if (own != own[0]).any():
            of = dict(zip(fps[s : s + n].tolist(), own.tolist()))
            out.append(np.array([(a, b) for a, b in trie_links(fps[s : s + n], budget) if of[a] != of[b]], np.uint64).reshape(-1, 2))
    return np.concatenate(out)


def candidates(groups: DataFrame, masks: list[int], budget: int = CANDIDATE_BITS) -> DataFrame:
    """(src, dst): fingerprints of groups (fp, label) within the budget that share a root and have different labels."""
    roots = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    dealt = groups.select("fp", F.posexplode(roots).alias("trie", "root"), "label").repartition("trie", "root").sortWithinPartitions("trie", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        held = [np.zeros(0, np.int64)] * 4  # rows of the last root, which may go on in the next batch

        def out(fp: np.ndarray, trie: np.ndarray, root: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[0, (trie[1:] != trie[:-1]) | (root[1:] != root[:-1])][: len(fp)])
            both = close_pairs(fp.view(np.uint64), group, label, budget).view(np.int64)
            both = np.unique(np.sort(both, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])

        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            last = int(np.flatnonzero((held[1] != held[1][-1]) | (held[2] != held[2][-1]))[-1]) + 1 if len(held[0]) and (held[1][0] != held[1][-1] or held[2][0] != held[2][-1]) else 0
            if last:
                yield out(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield out(*held)

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def _marks(found: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of fingerprints as pairs of the texts (held: fp, first) that stand for them."""
    for end in ("src", "dst"):
        found = found.join(held.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_mark")), end)
    return found.select(F.col("src_mark").alias("src"), F.col("dst_mark").alias("dst"))


def _verified(own: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) of text marks whose shingle sets are similar enough, from the texts own(mark, text)."""
    pairs = materialize(pairs, "similar-pairs")
    met = pairs.select(F.explode(F.array("src", "dst")).alias("mark")).distinct()
    sets = own.join(met, "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text")).select("mark", words(F.col("text")).alias("w"))
    sets = materialize(sets.select("mark", shingle_hashes(F.col("w"), width).alias("h")), "similar-sets")
    for end in ("src", "dst"):
        pairs = pairs.join(sets.select(F.col("mark").alias(end), F.col("h").alias(f"{end}_set")), end)
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    enough = shared >= F.lit(similarity) * (F.size("src_set") + F.size("dst_set") - shared) - F.lit(1e-9)
    return materialize(pairs.where(enough).select("src", "dst"), "similar-links")


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, mark, root) of every row: rows of one root are copies or linked by texts whose distinct shingles of `width` words have at
    least this Jaccard similarity. Candidates come from tries rooted at sampled bits, and each is checked by its whole shingle sets,
    so that no link is false. At the very threshold about a fifth of the pairs is lost, as their bits scatter round the average, and
    the fewer the more similar they are (see the README). Texts without words are copies of each other."""
    text = F.when(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == "", F.lit("")).otherwise(F.col("text"))
    own = docs.select("doc_id", text.alias("text"), text_mark(F.col("text")).alias("own_mark"), text_mark(text).alias("mark"))
    digests = materialize(fingerprints(own, width, ("mark", "own_mark")), "similar")
    texts = materialize(digests.groupBy("mark").agg(F.first("fp").alias("fp"), F.count("*").alias("n")), "similar-texts")
    held = materialize(texts.groupBy("fp").agg(F.min("mark").alias("first")), "similar-distinct")
    # texts of one fingerprint meet its first one, and these stand for fingerprints
    same = texts.join(held, "fp").where("mark <> first").select(F.col("first").alias("src"), F.col("mark").alias("dst"))
    masks = sampled_masks(held.count(), similarity)
    first = _verified(own, same.unionAll(_marks(candidates(held.withColumn("label", F.col("fp")), masks[:FIRST_MASKS]), held)), width, similarity)
    labels = components(first)
    # what is linked already needs no more pairs, so that a large family of near copies gives few for each of its members
    known = held.join(labels, held["first"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "first").alias("label"))
    known = materialize(known, "similar-known")
    second = _verified(own, _marks(candidates(known, masks[FIRST_MASKS:]), held), width, similarity)
    labels = components(first.unionAll(second))
    rooted = texts.join(labels, texts["mark"] == labels["node"], "left").select("mark", "n", F.coalesce("label", "mark").alias("root"))
    out = join_back(digests, materialize(rooted, "similar-roots"), ["mark"])
    return out.select("doc_id", F.col("own_mark").alias("mark"), "root")


def links(groups: DataFrame, budget: int = 4) -> DataFrame:
    """(src, dst): spanning edges between the distinct fingerprints `fp` of groups."""
    masks = block_masks(groups.count(), budget)
    roots = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    dealt = groups.select("fp", F.posexplode(roots).alias("trie", "root"))
    dealt = dealt.repartition("trie", "root").sortWithinPartitions("trie", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("simhash")
        held: list[np.ndarray] = []  # of the last root, which may go on in the next batch
        at = None

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])

        def linked() -> list[tuple[int, int]]:
            fps = np.concatenate(held) if held else np.array([], np.int64)
            return trie_links(fps.view(np.uint64), budget) if len(fps) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            fp, trie, root = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.r_[True, (trie[1:] != trie[:-1]) | (root[1:] != root[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            found = []
            if at != (trie[0], root[0]):
                found += linked()
                held = []
            held.append(fp[: ends[0]].copy())
            if len(starts) > 1:
                found += linked()
                for s, e in zip(starts[1:-1].tolist(), ends[1:-1].tolist()):
                    if e - s > 1:
                        found += trie_links(fp[s:e].view(np.uint64), budget)
                held = [fp[starts[-1] :].copy()]
            at = (trie[-1], root[-1])
            if found:
                yield out(found)
        if found := linked():
            yield out(found)

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each end of an edge the smallest node that it reaches."""
    both = materialize(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("dst")).select("node", F.least("node", "dst").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        heard = both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("to")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["to"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        via = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        jumped = near.join(via, near["label"] == via["at"]).select("node", F.least("label", "jump").alias("label"), "old")
        labels = materialize(jumped, "labels")
        moved = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, carried columns) of every row; root, a fingerprint, tells components apart even where
    ids are null or repeated."""
    digests = materialize(fingerprints(docs, width, carry), "simhash")
    groups = materialize(digests.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    labels = components(links(groups, budget))
    in_groups = groups.join(labels, groups["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("root"))
    ids = in_groups.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    named = materialize(in_groups.join(ids, F.col("root") == F.col("of")).select("fp", "n", "component_id", "root"), "simhash-components")
    return join_back(digests, named, ["fp"]).select("doc_id", "fp", "component_id", "root", *carry)


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
