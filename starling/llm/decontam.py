"""Benchmark decontamination: short test items inside long documents (operator 7, native).

An item is found in a document if at least `threshold` of the item's distinct shingles of `width` words (lower-cased in A-Z,
cut at white space; fewer words: the whole sequence) are in the document.

How: containment of a short set in a long one is searched from the short side. Items are partitioned by size: class c holds those of
2^c to 2^(c+1) - 1 distinct shingles. A class has one sketch length k, that of its largest size m: m - ceil(threshold m) + 1, which is
not less than the length of any smaller size (each shingle more adds at most one to it). An item's MinHash sketch holds its k smallest
shingle hashes. Where the threshold is reached, at most n - ceil(threshold n) <= k - 1 of its n shingles are missing, so that at least
one of the sketch is in the document: no pair of any class is lost. The document's side of a class is a MinHash sketch too: its hashes
up to the largest that any sketch of the class holds, about k / m of them, and all of a class of single shingles. Each class is probed by
itself with these, on (class, hash); the pairs found are verified by the exact shingles, as strings, a document once for all its
candidates. The join sends the sketches or, where the item texts have more than `broadcast_bytes`, shuffles both sides; then shingles
that very many documents hold are dealt over SALTS tasks by document, against as many copies of their sketch rows.

Defined cases: null and empty texts have no shingles and are in no pair; items without words are never found; several items of
one item_id are searched each and the best containment counts; repeated documents of one doc_id likewise give one row; null ids
are ids like others (remove_contaminated keeps clean rows even where their doc_id is null or shared with a found row's); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

#: Bytes of item texts up to which sketches and shingles (about `width` times as much) are sent to all executors.
BROADCAST_BYTES = 8 << 20
#: Tasks over which a shingle's documents are dealt where sketches are shuffled.
SALTS = 16


def _positions(w: Column, width: int) -> Column:
    """Where shingles start; one at 0 for shorter sequences, none without words."""
    none = F.array().cast("array<int>")
    return F.when(F.size(w) == 0, none).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))))


def shingle_hashes(w: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the shingles; words beyond the end are null and don't change the hash."""
    return F.array_distinct(F.transform(_positions(w, width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])))


def shingles(w: Column, width: int) -> Column:
    """Distinct shingles as strings."""
    return F.array_distinct(F.transform(_positions(w, width), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))


def _mark(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketch_length(size: Column, threshold: float) -> Column:
    """Hashes that a sketch needs so that no item of the size is lost."""
    return (size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)) + 1).cast("int")


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_key, class, hash): the smallest hashes of each item (item_key, h), as many as its size class needs."""
    c = F.floor(F.log2(F.size("h").cast("double"))).cast("int")
    k = sketch_length(F.call_function("shiftleft", F.lit(2), F.col("class")) - 1, threshold)
    return items.withColumn("class", c).select("item_key", "class", F.explode(F.slice(F.array_sort("h"), F.lit(1), k)).alias("hash"))


def _matches(docs: DataFrame, items: DataFrame, width: int, threshold: float, broadcast_bytes: int) -> DataFrame:
    """(doc_id, mark, item_id, n_shingles, n_shared) of every row and item at or above the threshold."""
    whole = items.select(F.col("item_id"), words(F.col("text")).alias("w")).select("item_id", shingles(F.col("w"), width).alias("of_item"), shingle_hashes(F.col("w"), width).alias("h"))
    whole = whole.where(F.size("of_item") > 0).distinct().withColumn("item_key", F.xxhash64("item_id", "of_item"))
    whole = materialize(whole, "items")
    sketch = materialize(sketches(whole, threshold), "item-sketches")
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes
    tops = sketch.groupBy("class").agg(F.max("hash").alias("top")).orderBy("class").collect()  # a row for each power of two

    marked = docs.select("doc_id", "text", _mark(F.col("text")).alias("mark"))
    # words are a column of their own, not an expression that every lookup would evaluate again
    cut = marked.select("doc_id", "mark", words(F.col("text")).alias("w")).select("doc_id", "mark", shingle_hashes(F.col("w"), width).alias("h"))
    of_class = lambda r: F.struct(F.lit(r["class"]).alias("class"), F.filter("h", lambda x: x <= F.lit(r["top"])).alias("low"))
    none = F.array().cast("array<struct<class:int,low:array<bigint>>>")
    probes = cut.select("doc_id", "mark", F.inline(F.array(*map(of_class, tops)) if tops else none)).select("doc_id", "mark", "class", F.explode("low").alias("hash"))
    if small:
        pairs = probes.join(F.broadcast(sketch), ["class", "hash"])
    else:
        salted = probes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)))
        copies = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        pairs = salted.join(copies, ["class", "hash", "salt"])
    # one row a document and mark, however many items it may hold
    pairs = pairs.groupBy("doc_id", "mark").agg(F.collect_set("item_key").alias("keys"))
    pairs = materialize(pairs, "item-candidates").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "keys")

    met = marked.join(pairs, marked["doc_id"].eqNullSafe(pairs["__id"]) & (marked["mark"] == pairs["__mark"]))
    met = met.select("doc_id", "mark", "keys", words(F.col("text")).alias("w")).select("doc_id", "mark", "keys", shingles(F.col("w"), width).alias("of_doc"))
    of = whole.select("item_key", "item_id", "of_item")
    held = met.select("doc_id", "mark", "of_doc", F.explode("keys").alias("item_key"))
    checked = held.join(F.broadcast(of) if small else of, "item_key").select(
        "doc_id", "mark", "item_id", F.size("of_item").alias("n_shingles"), F.size(F.array_intersect("of_item", "of_doc")).alias("n_shared")
    )
    return checked.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)))


def find_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair at or above the threshold."""
    checked = _matches(docs, items, width, threshold, broadcast_bytes).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    best = F.max(F.struct("containment", "n_shingles", "n_shared")).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), F.col("b.n_shared").cast("long").alias("n_shared"), "b.containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows in which no item is found; a clean row stays also where a found one has its doc_id."""
    found = _matches(docs, items, width, threshold, broadcast_bytes).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (_mark(docs["text"]) == found["__mark"]), "left_anti")
