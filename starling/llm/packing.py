"""Best-fit packing of token sequences by minimum bin slack (operator 2).

Documents are tokenised, an end id is appended, and documents longer than the capacity are cut into full pieces; only the
first piece may be shorter. Pieces go into as few sequences of at most `capacity` tokens as minimum bin slack finds: for each
bin, opened by the longest piece left, a subset-sum dynamic program over the lengths that are left (a bitset of reachable
sums) finds the fullest feasible combination, which is then removed.

How: the search needs only how many pieces have each length, at most `capacity` numbers, so it runs on the driver whatever the
corpus, and a combination is removed as often as the counts allow at once. Pieces of the full capacity are sequences by themselves.
The others get gapless ranks among those of their length in the distributed table, and rank and length give sequence and offset from
the plan's intervals (at most a few ten thousand, whatever the corpus).

Tokenising caches by stretches between single spaces and line feeds, where this pre-tokeniser always cuts; a text with other
white space at such a cut, or with the string of a special token, is encoded whole.

Defined cases: a null text is empty and has the end id only; repeated rows give repeated pieces, which are interchangeable; an
empty table gives an empty result; other columns play no part; a null doc_id is kept as null.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by, materialize, ranked

#: Strings cached per worker, some 250 MB.
CACHE = 1_400_000
#: Texts whose new strings are looked up together.
TOGETHER = 128
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids of texts as little-endian uint32 bytes, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        newline = self.encode_whole("\n")
        pieces = str(self.tokenizer.pre_tokenizer)
        self.cuts = sys.byteorder == "little" and array("I").itemsize == 4 and len(newline) == 4 and "ByteLevel" in pieces and "Sequence" not in pieces and "add_prefix_space=False" in pieces and self.tokenizer.normalizer is None
        self.newline = newline
        self.marks = {x: self.encode_whole(x) for x in ",."}
        self.first: dict[str, bytes] = {}  # a line's first stretch, without a space before it
        self.rest: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts, whose new stretches are looked up together."""
        if not self.cuts:
            return [self.encode_whole(t) for t in texts]
        cut = [[x.split(" ") for x in t.split("\n")] for t in texts]
        new_first = {x[0] for lines in cut for x in lines if x[0] not in self.first}
        new_rest = {y for lines in cut for x in lines for y in x[1:] if y not in self.rest}
        if len(self.rest) + len(self.first) + len(new_rest) > CACHE:
            self.rest.clear()
            self.first.clear()
            new_first, new_rest = {x[0] for lines in cut for x in lines}, {y for lines in cut for x in lines for y in x[1:]}
        self._learn(self.first, set(filter(self._cuttable, new_first)), "")
        self._learn(self.rest, set(filter(self._cuttable, new_rest)), " ")
        out = []
        for text, lines in zip(texts, cut):
            try:
                out.append(self._joined(lines) if text else b"")
            except KeyError:  # a stretch that can't be cut off
                out.append(self.encode_whole(text))
        return out

    def _joined(self, lines: list[list[str]]) -> bytes:
        first, rest = self.first, self.rest.__getitem__
        return self.newline.join([first[x[0]] + b"".join(map(rest, x[1:])) for x in lines])

    def _cuttable(self, x: str) -> bool:
        return bool(x) and not x[0].isspace() and not x[-1].isspace() and not any(s in x for s in self.special)

    def _learn(self, into: dict[str, bytes], new: set[str], before: str) -> None:
        # a comma or full stop after a letter is a piece of its own
        ends = {x for x in new if x[-1] in ",." and len(x) > 1 and x[-2].isalpha()}
        bases = {x for x in (new - ends) | {x[:-1] for x in ends} if x not in into}
        # Latin letters only: one piece of the pre-tokeniser, which goes to the model as it is
        plain = {x for x in bases if x.isalpha() and (x.isascii() or max(x) < "\u0250")}
        merge = self.tokenizer.model.tokenize
        for x in plain:
            into[x] = array("I", [t.id for t in merge((before + x).encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        rest = list(bases - plain)
        if rest:
            ids = np.frombuffer(self.encode_whole("\n".join([before + x for x in rest])), "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0]).tolist()
            raw = ids.tobytes()
            into.update(zip(rest, [raw[4 * a : 4 * b] for a, b in zip([0] + [c + 1 for c in cuts], cuts + [len(ids)], strict=True)], strict=True))
        for x in ends:
            into[x] = into[x[:-1]] + self.marks[x[-1]]


def encoder(path: str) -> Encoder:
    """One per worker, until the worker runs another operator that keeps something or needs the memory."""
    kept = kept_by("packing")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one that may be shorter."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode_all, np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                rows: list[tuple] = []
                held: list[bytes] = []
                for doc, ids in zip(b.column(0).to_pylist(), encode([x or "" for x in b.column(1).to_pylist()])):
                    ids += end
                    for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * s : 4 * (s + n)]
                        rows.append((doc, i, s, n, zlib.crc32(part)))
                        if with_ids:
                            held.append(part)
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.cumsum([0] + [len(x) // 4 for x in held]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def fill_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over {length: pieces}: (bins, [(length, pieces in each bin)]) in order of removal."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    plan = []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for n, c in left.items():
            c = min(c - (n == longest), room // n if n <= room else 0)
            if c > 0:
                steps.append((n, reach))
                part = 1
                while c > 0:  # c copies as powers of two
                    part = min(part, c)
                    reach |= reach << (part * n)
                    c -= part
                    part *= 2
                reach &= mask
                if reach >> room & 1:
                    break
        total = reach.bit_length() - 1
        used = {longest: 1}
        for n, before in reversed(steps):
            while not before >> total & 1:
                total -= n
                used[n] = used.get(n, 0) + 1
        bins = min(left[n] // k for n, k in used.items())
        plan.append((bins, list(used.items())))
        for n, k in used.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
    return plan


def intervals(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, bins, first offset) for ranks among the pieces of a length, in order."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, used in plan:
        offset = 0
        for n, k in used:
            rows.append((n, taken.get(n, 0), sequence, bins, offset))
            taken[n] = taken.get(n, 0) + bins * k
            offset += n * k
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (materialised; with a unique choice of columns doc_id, piece, ids_crc32 and length) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    counts.pop(capacity, None)
    plan = fill_bins(counts, capacity)
    table = intervals(plan)
    big = max(counts.values(), default=0) + 1
    keys = table[:, 0] * big + table[:, 1]  # at most capacity times the rows, far below 2^63

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, length * big + rank, side="right") - 1]
            t = rank - row[:, 1]
            cols = [b.column(i) for i, c in enumerate(b.schema.names) if c != "__rank"]
            names = [c for c in b.schema.names if c != "__rank"]
            made = [pa.array(row[:, 2] + t % row[:, 3], pa.int64()), pa.array(row[:, 4] + t // row[:, 3] * row[:, 0], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *made], [*names, "sequence_id", "offset"])

    numbered = ranked(pieces.where(F.col("length") < capacity), ["length"], ["doc_id", "piece", "ids_crc32"], "__rank")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    after = F.monotonically_increasing_id() + F.lit(sum(bins for bins, _ in plan))
    full = pieces.where(F.col("length") == capacity).select("*", after.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(place, schema).unionAll(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(tokenize(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed ids: (sequence_id, ids, doc_ids), from the documents and their places. A sequence has at most `capacity` pieces."""
    pieces = tokenize(docs, tokenizer_path, capacity, end_id, with_ids=True).dropDuplicates(["doc_id", "piece", "ids_crc32"])
    p = pieces.select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), F.col("ids_crc32").alias("c"), "ids")
    same = placed["doc_id"].eqNullSafe(p["d"]) & (placed["piece"] == p["p"]) & (placed["ids_crc32"] == p["c"])
    rows = placed.join(p, same).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
