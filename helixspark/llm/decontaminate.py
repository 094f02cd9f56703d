"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

A benchmark item of n words is looked for in windows of n words. A window's (and an item's) fingerprint is
the 64-bit SimHash of its five-word shingles, each with its count as weight. Fingerprints within RADIUS bits
are found by multi-index Hamming blocks: the 64 bits are cut into BLOCKS blocks, and by the pigeonhole
principle two fingerprints within RADIUS agree in some block up to RADIUS // BLOCKS bits (one less in the
blocks after the first RADIUS % BLOCKS + 1), so items are indexed under all values that near each block.
Candidates are verified exactly: the weighted Jaccard similarity of window and item (sum of smaller counts
over sum of larger) must be 0.8 or more. RADIUS leaves room for fingerprints' noise: at similarity 0.8 about 10
bits differ, with a standard deviation of 3.

Which windows get a fingerprint: a document's shingle is marked for a size if it occurs in some item of that size, wherever it stands there. A
window of w shingles and an item of m that have c in common (counts included) are c / (m + w - c) similar, so 0.8
takes c >= 4 / 9 (m + w), and c is at most the number of the window's marked shingles. All windows with so many
are fingerprinted; no other window can be similar. All shingles of all documents are tested. Tables of numbers are broadcast
only if they are small in bytes (``common.small``), else joined by a shuffle.

Defined results: an item under five words is one shingle of all its words and found where they stand in a row; null and empty
texts and items match nothing; a window that would
reach over a document's end is cut off there; repeated items and rows give a row each (rows of one doc_id and item the best); rows
without doc_id are looked through too, under a null doc_id; empty tables give an
empty result. Words are runs of letters and digits, lower-cased. Columns other than doc_id, item_id and text take no part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import private, scratch, small

WIDTH, SIMILAR = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 20, 8, 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def once(value: Column, f) -> Column:
    """f(value), an array, with value computed once however often f names it."""
    return F.flatten(F.transform(F.array(value), f))


def shingle_hashes(ws: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of width words of an array of words, in order; empty if there are fewer."""
    starts = F.sequence(F.lit(0), F.size(ws) - width)
    return F.when(F.size(ws) >= width, F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def shingles_by_width(ws: Column, widths: list[int]) -> Column:
    """array<struct<width, hs>>: the shingle hashes for each width."""
    return F.array(*[F.struct(F.lit(w).alias("width"), shingle_hashes(ws, w).alias("hs")) for w in widths])


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes; a repeated hash votes as often as it comes. Ties give 0."""
    vote = lambda b: F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.getbit(h, b).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: F.when(vote(b) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(acc))


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int")


def masks(reach: int) -> list[int]:
    """All block values with at most reach bits set."""
    return sorted(sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BLOCK_BITS), n))


def probes(fingerprint: Column) -> Column:
    """Every (block, value) under which an item is indexed."""
    each, more = divmod(RADIUS, BLOCKS)

    def near(k: int) -> Column:
        values = F.array(*[F.lit(m) for m in masks(each if k <= more else each - 1)])
        return F.transform(values, lambda m: F.struct(F.lit(k).alias("k"), block(fingerprint, k).bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[near(k) for k in range(BLOCKS)]))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of hashes; weights are counts."""
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))
    total = F.size(a) + F.size(b) - common
    return F.when(total > 0, common / total).otherwise(0.0)


def window_starts() -> Column:
    """The starts of all windows of n words with enough marked shingles: ``marks`` are their sorted
    positions, ``len`` is the number of the document's shingles and m that of a window's. Each start is made at its window's first mark."""
    m, marks = F.col("m"), F.col("marks")

    def enough(start: Column, i: Column) -> Column:
        lo, hi = F.greatest(start, F.lit(0)), F.least(start + m, F.col("len"))
        least = F.ceil((m + hi - lo) * 4 / F.lit(9.0) - 1e-9).cast("int")  # at least so many marks
        return (hi > lo) & F.coalesce(F.get(marks, i + least - 1) < hi, F.lit(False))

    def at(mark: Column, i: Column) -> Column:
        # a window has at most m / 9 shingles without a mark; one that is cut at the document's start has 4 / 5 m at least
        before = F.when(i == 0, -F.floor(m / 5).cast("int")).otherwise(F.get(marks, i - 1) + 1)
        first = F.when((i == 0) & (mark <= m / 9), before).otherwise(F.greatest(before, mark - F.floor(m / 9).cast("int"), F.lit(0)))
        return F.filter(F.sequence(first, mark), lambda s: enough(s, i))

    return F.flatten(F.transform(marks, at))


def places() -> list[Column]:
    """Two hashes of a row's id and text, by which it is found again."""
    return [F.xxhash64("doc_id", "text").alias("at"), F.xxhash64(F.lit(1), "text", "doc_id").alias("at2")]


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, at, at2, item_id, start, n_words, similarity): all windows with similarity 0.8 or more; start counts words from 0."""
    ws = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    sized = F.coalesce(*[F.when(F.least(F.size("ws"), F.lit(WIDTH)) == w, shingle_hashes(F.col("ws"), w)) for w in range(1, WIDTH + 1)])
    items = scratch(ws.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("ws").alias("n"), F.least(F.size("ws"), F.lit(WIDTH)).alias("width"), sized.alias("item_hs")), "texts")
    items = scratch(items.withColumn("item_print", simhash(F.col("item_hs"))), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # five numbers at most
    shingles = docs.select("doc_id", *places(), F.inline(once(words(F.col("text")), lambda ws: shingles_by_width(ws, widths or [WIDTH]))))
    anchors = scratch(items.select("width", "n", F.explode("item_hs").alias("h")).distinct(), "anchors")
    # row by row to hashes, which the join with the items' thins at once
    each = shingles.select("at", "width", F.size("hs").alias("len"), F.posexplode("hs").alias("p", "h"))
    marks = each.join(small(anchors), ["width", "h"]).groupBy("at", "width", "n", "len").agg(F.sort_array(F.collect_set("p")).alias("marks"))
    marks = scratch(marks.withColumn("m", F.col("n") - F.col("width") + 1).where(F.size("marks") * 5 >= F.col("m") * 4), "marks")
    wanted = scratch(marks.select("at", "width", "n", "m", F.explode(window_starts()).alias("start")).distinct(), "wanted")
    # the shingles of documents with windows, once for each
    held = scratch(shingles.join(small(wanted.select("at").distinct()), "at", "left_semi").dropDuplicates(["at", "at2", "width"]), "held")
    lo = F.greatest(F.col("start"), F.lit(0))
    hi = F.least(F.col("start") + F.col("m"), F.size("hs"))
    windows = held.join(wanted, ["at", "width"]).select("doc_id", "at", "at2", "start", "n", F.slice("hs", lo + 1, F.greatest(hi - lo, F.lit(0))).alias("window_hs"))
    windows = scratch(windows.where(F.size("window_hs") > 0).withColumn("window_print", simhash(F.col("window_hs"))), "windows")
    keyed = windows.select("at", "at2", "start", "n", "window_print", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), block(F.col("window_print"), k).alias("value")) for k in range(BLOCKS)])))
    index = scratch(items.select("item", "n", "item_print", F.inline(probes(F.col("item_print")))), "index")
    near = keyed.join(small(index), ["n", "k", "value"]).where(F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("at", "at2", "start", "n", "item").distinct()
    checked = near.join(windows.drop("window_print"), ["at", "at2", "start", "n"]).join(items.select("item", "item_id", "item_hs"), "item")
    sure = checked.select("doc_id", "at", "at2", "item_id", "start", F.col("n").alias("n_words"), weighted_similarity(F.col("item_hs"), F.col("window_hs")).alias("similarity"))
    return sure.where(F.col("similarity") >= SIMILAR)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each document and item the best window with
    similarity 0.8 or more, the earliest of equal ones."""
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "start", "n_words")).alias("best")
    return found(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.greatest(F.col("best.start"), F.lit(0)).alias("start"), F.col("best.n_words").alias("n_words"), (-F.col("best.less")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item, with the columns that they came with."""
    at, at2 = places()
    out, name = private(docs, at=at, at2=at2)
    rows = scratch(found(docs, benchmark).select(F.col("at").alias(name["at"]), F.col("at2").alias(name["at2"])).distinct(), "contaminated")
    return out.join(small(rows), [name["at"], name["at2"]], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
