"""Line dedup over a corpus (operator 3, native): lines that many documents share stay in one document only.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends and lower-cased in A-Z. Keys of at least min_chars code
points that at least min_docs documents hold lose their lines in all documents but the one with the largest doc_id.

How: a key is a 128-bit hash; texts are cut once, and what follows reads a table of hashes. (1) The hashes are range-partitioned
with a secondary sort by document and position, and a window streams over them: the first document in that order keeps the line,
the third one settles that the line is shared. (2) Only keys that a task can't bear are kept out of that stream. Lines are counted by
coarse buckets of their hash, a small table; a key with more than `hot` lines must lie in a bucket with more than `hot`, so the lines of
those buckets alone are counted by key. By `hot` (HOT lines, or 1/HOT_KEYS of all lines where that is more) there are at most HOT_KEYS
such keys; their table (32 bytes a row) is broadcast and their lines are decided where they are. (3) Dropped positions are folded into
bit words of 64 lines; the result is one sparse keep bitmap for each document that loses lines: words not listed keep all their
lines. Text is never shuffled until the bitmaps are applied.

Defined cases: a null or empty text is one empty line; documents are told apart by doc_id, a null doc_id is one document below
all others; repeated rows (equal doc_id and text) get the same bitmap; lines repeated within the keeping document all stay;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, hash128, lower_ascii, materialize

#: Lines of one key above which it is kept out of the stream, and how many such keys there may be.
HOT, HOT_KEYS = 5_000, 100_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def text_mark(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hot_keys(lines: DataFrame, hot: int) -> DataFrame:
    """(h1, h2) of the keys with more than `hot` of the lines."""
    n = lines.count()
    bucket = F.pmod("h1", F.lit(max(1, 8 * n // hot)))
    crowded = lines.groupBy(bucket.alias("b")).count().where(F.col("count") > hot).select("b")  # at most n / hot rows
    near = lines.join(F.broadcast(crowded), bucket == F.col("b"), "left_semi")
    return near.groupBy("h1", "h2").count().where(F.col("count") > hot).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, text_mark, keep): for each document that loses lines its keep bitmap, an array of (word, bits); bit b of
    word w is 1 if line 64 w + b stays, and words that are not listed are all ones."""
    lines = docs.select(
        "doc_id", text_mark(F.col("text")).alias("text_mark"), F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("pos", "key")
    ).where(F.length("key") >= min_chars)
    h1, h2 = hash128(F.col("key"))
    # read again below (counts, hot lines, the sample of the range partitioning, the stream); a tenth of the text
    lines = materialize(lines.select("doc_id", "text_mark", "pos", h1.alias("h1"), h2.alias("h2")), "line-hashes")
    hottest = materialize(hot_keys(lines, max(hot, lines.count() // HOT_KEYS)), "hot-lines")

    hot_lines = lines.join(F.broadcast(hottest), ["h1", "h2"], "left_semi")
    held = hot_lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    held = held.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    at_once = hot_lines.join(F.broadcast(held), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "text_mark", "pos")

    order = [F.col("doc_id").desc_nulls_last(), F.col("text_mark"), F.col("pos")]
    cold = lines.join(F.broadcast(hottest), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    stream = Window.partitionBy("h1", "h2").orderBy(*order)
    opens = (F.row_number().over(stream) == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    cold = cold.select("h1", "h2", "doc_id", "text_mark", "pos", F.when(opens, 1).otherwise(0).alias("opens"))
    cold = cold.withColumn("place", F.sum("opens").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # of the document among those that hold the line
    cold = cold.withColumn("n_docs", F.max("place").over(Window.partitionBy("h1", "h2")))
    streamed = cold.where((F.col("n_docs") >= min_docs) & (F.col("place") > 1)).select("doc_id", "text_mark", "pos")

    dropped = at_once.unionAll(streamed)
    by_word = dropped.groupBy("doc_id", "text_mark", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)).cast("int"))).alias("gone")
    )
    return by_word.groupBy("doc_id", "text_mark").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")
    )


def dropped_positions(keep: Column) -> Column:
    """The line numbers that a keep bitmap drops."""
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(
        F.transform(keep, lambda w: F.transform(F.filter(bits, lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * 64 + b))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with `n_lines` before, `n_dropped` and `kept` (the text that stays) beside its own columns; those three replace columns of
    their names."""
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_mark").alias("__mark"), F.col("keep").alias("__keep"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    # the input's columns in a struct, so that no name of theirs meets one of these
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own")).withColumn("mark", text_mark(F.col("own.text")))
    joined = marked.join(b, F.col("own.doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    gone = F.coalesce(dropped_positions(F.col("__keep")), F.array().cast("array<int>"))
    out = joined.select("own", split_lines(F.col("own.text")).alias("lines"), gone.alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.coalesce("own.text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return out.select("own.*", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every document."""
    d = docs.select("doc_id", "text")
    return apply_bitmaps(d, keep_bitmaps(d, min_chars, min_docs)).select("doc_id", "n_lines", "n_dropped", "kept")
