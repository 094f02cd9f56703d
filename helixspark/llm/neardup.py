"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its weighted five-word shingles (weight: how often a shingle occurs). ProbMinHash lets each
shingle send arrivals of a Poisson process with its weight as rate; an arrival falls into a random one of
REGISTERS registers and a register keeps the shingle that arrived first. A document is done as soon as its
shingles' next arrivals all come after the latest of its registers (early termination). The share of equal
registers estimates the probability Jaccard similarity. A second sketch with all weights 1 estimates the plain one;
where no shingle occurs twice it is the same. Bands of registers of both give buckets, and texts that share a bucket
are candidates, which are then verified exactly.

Two texts are linked if the Jaccard similarity of their shingles, plain, weighted by counts (sum of the smaller
over sum of the larger) or of probabilities, is 0.8 or more, all computed exactly. The weighted one never exceeds that
of probabilities, so the two sketches answer to all three. Classes are the connected components.

How a large bucket is handled: texts with the same weighted shingles are merged before anything else. In each of STAR_ROUNDS
rounds every bucket names one member, its hub (from the second round on, one for each class of sizes), and every text is
compared with one hub only: that of most of its buckets among those outside its class. So a round costs one comparison a text, and groups of copies become one class.
Texts of one class need not be compared. The texts of what is still apart in a bucket are compared if they share a shingle of
both prefixes: a text's shingles are put in one order for all texts, rare ones first, and its prefix ends where it holds
more than 0.2 of its shingles and of their counts. Two linked texts have 0.8 of either's shingles, or of either's counts,
in common, so the first common shingle in that order lies in both prefixes: no link between texts that share a bucket
is lost, and unlike texts that share frequent passages hardly meet. At similarity 0.8 two texts share none of a
sketch's 30 buckets with a probability of 7 in a million (0.85: 5 in 100 million).

What is shuffled: band keys, ids, and the shingle hashes of the texts that share a bucket; texts themselves never.

Defined results: texts without a word (null, empty, only marks) are alone in their class; texts under five
words have one shingle, all their words; texts of equal shingles are always together. Work goes by text, so rows that repeat a doc_id
are looked at each: the same text is one class, another text has its own. class_id is the smallest doc_id of the class,
rows without one count for nothing in it (null if the class has no other). Columns other than doc_id and text do not take part.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.llm.common import bounded_batches, private, remembered, scratch, slices, small

WIDTH, SIMILAR = 5, 0.8
REGISTERS, BAND = 150, 5
#: Rounds of hubs before the comparison by prefixes.
STAR_ROUNDS = 2
WORD, SPACE = re.compile(r"\w+"), re.compile(r"\W")
#: Words that a worker remembers, and characters of a text that are cut into words at once.
CACHE_WORDS, PART_CHARS = 200_000, 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(text: str | None, memory: WordHashes) -> np.ndarray:
    """The hashes of a text's words in order; a long text is cut into words part by part."""
    parts, at, text = [], 0, (text or "").lower()
    while at < len(text):
        m = SPACE.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
        end = m.start() if m else len(text)
        words = WORD.findall(text[at:end] if at or m else text)
        parts.append(np.fromiter(map(memory.__getitem__, words), np.uint64, len(words)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def shingles(texts: list[str | None], memory: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of each text, sorted by text and hash."""
    words = [word_hashes(t, memory) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.concatenate(words)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(h))  # words from here to the text's end
    padded = np.append(h, np.zeros(WIDTH, np.uint64))
    sig = np.zeros(len(h), np.uint64)
    for k in range(WIDTH):
        word = np.where(left > k, padded[k : k + len(h)], np.uint64(k + 1))
        sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + word)
    starts = (left >= WIDTH) | ((np.repeat(sizes, sizes) < WIDTH) & (left == np.repeat(sizes, sizes)))
    owner, sig = owner[starts], sig[starts]
    order = np.lexsort((sig, owner))
    owner, sig = owner[order], sig[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(new)
    return owner[at], sig[at], np.diff(np.append(at, len(sig)))


def probminhash(texts: int, owner: np.ndarray, sig: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """texts x registers: the shingle hash that each register keeps; 0 in texts without shingles."""
    time = np.full(texts * registers, np.inf)
    kept = np.zeros(texts * registers, np.uint64)
    arrived = np.zeros(len(sig))
    state = mix(sig ^ np.uint64(0xD1B54A32D192ED03))
    alive = np.arange(len(sig))
    while len(alive):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        u = ((state >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53
        arrived = arrived - np.log(u) / weight[alive]
        slot = owner[alive] * registers + (mix(state) % np.uint64(registers)).astype(np.int64)
        earlier = np.flatnonzero(arrived < time[slot])
        np.minimum.at(time, slot[earlier], arrived[earlier])
        won = earlier[time[slot[earlier]] == arrived[earlier]]
        kept[slot[won]] = sig[alive[won]]
        latest = time.reshape(texts, registers).max(axis=1)
        go = arrived < latest[owner[alive]]
        alive, arrived, state = alive[go], arrived[go], state[go]
    return kept.reshape(texts, registers)


def band_keys(kept: np.ndarray, band: int = BAND) -> np.ndarray:
    """texts x bands of signed 64-bit keys."""
    bands = kept.shape[1] // band
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(kept), bands)).copy()
    for k in range(band):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + kept[:, k::band][:, :bands])
    return key.view(np.int64)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, float]:
    """Plain, weighted and probability Jaccard of two sorted weighted shingle sets (hashes, counts)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0, 0.0, 0.0
    x, y, total_x, total_y = a[1][ia].astype("f8"), b[1][ib].astype("f8"), int(a[1].sum()), int(b[1].sum())
    plain, least = len(ia) / (len(a[0]) + len(b[0]) - len(ia)), int(np.minimum(x, y).sum())
    if total_x == len(a[0]) and total_y == len(b[0]):
        return plain, plain, plain
    # sum over the common i of 1 / sum over all j of max(x_j / x_i, y_j / y_i): by the ratio, x counts up to i and y after it
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    larger = ((total_x - x.sum()) + np.cumsum(x)) / x + (total_y - np.cumsum(y)) / y
    return plain, least / (total_x + total_y - least), float((1 / larger).sum())


def word_memory() -> WordHashes:
    """The process's word hashes: a Python worker keeps them from one task to the next."""
    return remembered("word hashes", WordHashes)


def cut_shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]]:
    """Of each slice of a batch: its range of rows, their shingles, and each row's digest of them (None without a word)."""
    for lo, hi in slices(texts):
        owner, sig, count = shingles(texts[lo:hi].to_pylist(), word_memory())
        cut = np.searchsorted(owner, np.arange(hi - lo + 1))
        yield lo, hi, owner, sig, count, [xxhash.xxh3_128_digest(sig[i:j].tobytes() + count[i:j].tobytes()) if j > i else None for i, j in zip(cut, cut[1:])]


def sketch_bands(docs: DataFrame) -> DataFrame:
    """(doc_id, at, at2, h, keys): two hashes of the row's id and text, a digest of the weighted shingles and the band keys of
    both sketches, both null if there is no word."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, owner, sig, count, digests in cut_shingles(b.column(3)):
                texts = hi - lo
                keys = band_keys(probminhash(texts, owner, sig, count))
                n, total = np.bincount(owner, minlength=texts), np.bincount(owner, count, minlength=texts)
                again = np.flatnonzero(total > n)  # texts that repeat a shingle
                more = np.isin(owner, again)
                plain = band_keys(probminhash(len(again), np.searchsorted(again, owner[more]), sig[more], np.ones(int(more.sum()), np.int64)))
                both: list[np.ndarray | None] = [k if size else None for k, size in zip(keys, n)]
                for i, k in zip(again, plain):
                    both[i] = np.union1d(keys[i], k)
                own = [b.column(k)[lo:hi] for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(both, pa.list_(pa.int64()))], ["doc_id", "at", "at2", "h", "keys"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", *places(), "text").mapInArrow(sketched, "doc_id bigint, at bigint, at2 bigint, h binary, keys array<bigint>")


def places() -> list[Column]:
    """Two hashes of a row's id and text, by which it is found again; rows with both equal are the same."""
    return [F.xxhash64("doc_id", "text").alias("at"), F.xxhash64(F.lit(1), "text", "doc_id").alias("at2")]


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(at, h, s, w): the weighted shingles of each row's text as sorted arrays."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, owner, sig, count, digests in cut_shingles(b.column(1)):
                cut = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)), pa.int32())
                arrays = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (sig.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(digests, pa.binary()), *arrays], ["at", "h", "s", "w"])

    return docs.select("at", "text").mapInArrow(sets, "at bigint, h binary, s array<bigint>, w array<int>")


def parts(lists: pa.ListArray) -> list[np.ndarray]:
    flat, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(cut, cut[1:])]


@F.arrow_udf(T.BooleanType())
def alike(pairs: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in pairs:
        s, w, s_, w_ = map(parts, columns)
        yield pa.array([max(similarities((a.view(np.uint64), x), (b.view(np.uint64), y))) >= SIMILAR for a, x, b, y in zip(s, w, s_, w_)], pa.bool_())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of the edges (a, b); smaller labels spread
    over edges, and each round then jumps to the label's own label. Lineage is cut in every round."""
    both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        known = small(labels)
        spread = both.join(known.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = spread.join(known, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = known.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = scratch(step.join(up, "label").select("node", "was", F.least("label", "root").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels


def apart(labelled: DataFrame, *by: str) -> DataFrame:
    """The values of the columns by whose rows have different labels."""
    return labelled.groupBy(*by).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(*by)


def size_class(turn: int) -> Column:
    """Texts of one class have numbers of different shingles that allow SIMILAR; the classes' bounds move with the turn, and
    the first turn has one class, as texts that repeat shingles may be alike whatever their number."""
    return F.lit(0) if turn == 0 else F.floor(F.log(F.col("n")) / F.log(F.lit(1 / SIMILAR)) + turn / STAR_ROUNDS)


def star_pairs(labelled: DataFrame, turn: int, own: bool = False) -> DataFrame:
    """(a, b): each text and one hub outside its class, that of most of its buckets. labelled: key, node, n, label. A bucket has
    a hub for each class of sizes, a random member. With own (the part of a text that no other class has), a hub has little of
    that, and a text meets the one with the least: it is likest to all others."""
    rows = labelled.withColumn("size", size_class(turn))
    chance = F.xxhash64("node", F.lit(turn))
    rank = F.round(F.col("own") * 25 + F.pmod(chance, F.lit(1000)) / 1000).cast("bigint") if own else F.lit(0).cast("bigint")
    hubs = rows.groupBy("key", "size").agg(F.min(F.struct(rank.alias("rank"), chance.alias("chance"), "node", "label")).alias("hub"))
    hubs = hubs.select("key", "size", F.col("hub.rank").alias("rank"), F.col("hub.chance").alias("chance"), F.col("hub.node").alias("b"), F.col("hub.label").alias("other"))
    met = rows.join(hubs, ["key", "size"]).where(F.col("label") != F.col("other")).groupBy("node", "b", "rank", "chance").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.min(F.struct("rank", (-F.col("n")).alias("less"), "chance", "b")).alias("best"))
    return best.select(F.least("node", "best.b").alias("a"), F.greatest("node", "best.b").alias("b")).distinct()


def prefixes(sets: DataFrame) -> DataFrame:
    """(node, label, shingle, n, total, before, before_w, own): of each set (node, label, s, w) the prefix: its shingles in the order of
    how many sets have them, as far as it takes to hold more than 1 - SIMILAR of the set's shingles or of their counts; n and
    total are the set's shingles and counts, before and before_w those that come before a shingle, own its share of shingles in no
    other class. Shingles in sets of one
    label only come first in that order; no other class has them, so they are counted but not given."""
    rows = sets.select("node", "label", F.explode(F.arrays_zip("s", "w")).alias("x")).select("node", "label", F.col("x.s").alias("shingle"), F.col("x.w").alias("w"))
    rows = scratch(rows, "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle", "often")
    sizes = sets.select("node", F.size("s").alias("n"), F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("total"))
    every = Window.partitionBy("node")
    earlier = every.orderBy("often", "shingle").rowsBetween(Window.unboundedPreceding, -1)  # a running sum: linear
    found = rows.join(often, "shingle").select(
        "node", "label", "shingle", F.count("*").over(every).alias("common"), F.sum("w").over(every).alias("common_w"),
        F.count("*").over(earlier).alias("earlier"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("earlier_w"),
    )
    before, before_w = F.col("n") - F.col("common") + F.col("earlier"), F.col("total") - F.col("common_w") + F.col("earlier_w")
    found = found.join(sizes, "node").select("node", "label", "shingle", "n", "total", before.alias("before"), before_w.alias("before_w"), (1 - F.col("common") / F.col("n")).alias("own"))
    least = 1 - SIMILAR
    return found.where((F.col("before") <= least * F.col("n") + 1e-6) | (F.col("before_w") <= least * F.col("total") + 1e-6))


def possible() -> Column:
    """Can two sets that share a shingle of their prefixes be linked, if it is the first that they share? They have no more in common
    than what comes from it on. The probability Jaccard of sets that share parts r and r_ of their counts is at most
    r * r_ / (1 - (1 - r) * (1 - r_)); it is another than the plain one only where a set repeats shingles."""
    common = F.least(F.col("n") - F.col("before"), F.col("n_") - F.col("before_"))
    plain = common >= SIMILAR * (F.col("n") + F.col("n_") - common) - 1e-6
    r, r_ = 1 - F.col("before_w") / F.col("total"), 1 - F.col("before_w_") / F.col("total_")
    shares = r * r_ >= SIMILAR * (1 - (1 - r) * (1 - r_)) - 1e-6
    return plain | (((F.col("n") < F.col("total")) | (F.col("n_") < F.col("total_"))) & shares)


def prefix_pairs(prefix: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b): the texts of different classes that share a shingle of their prefixes and a bucket, and can be linked. buckets: node, keys.
    All texts with a shingle are met by those outside its largest class only, so a class of many costs no pairs within."""
    prefix = scratch(prefix.join(apart(prefix, "shingle"), "shingle"), "prefixes")
    sizes = prefix.groupBy("shingle", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("k", "label")).alias("top")).select("shingle", F.col("top.label").alias("top"))
    rows = prefix.join(buckets, "node").join(largest, "shingle")
    right = prefix.join(buckets, "node").select("shingle", *[F.col(c).alias(c + "_") for c in ("node", "label", "n", "total", "before", "before_w", "keys")])
    once = (F.col("label_") == F.col("top")) | (F.col("node") < F.col("node_"))
    met = rows.where("label <> top").join(right, "shingle").where((F.col("label") != F.col("label_")) & once & possible() & F.arrays_overlap("keys", "keys_"))
    return met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def linked(docs: DataFrame, nodes: DataFrame, star_rounds: int) -> DataFrame | None:
    """(node, label) of the texts that have a link: the smallest node of their component; None if there is no link."""
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    bands = scratch(bands.join(shared, "key").select("key", "node"), "bands")
    members = scratch(nodes.join(bands.select("node").distinct(), "node", "left_semi").select("node", "at", "h"), "members")
    texts = docs.select(*places()[:1], "text").join(small(members.select("at")), "at", "left_semi")
    # rows that are the same in id and text are one here
    sets = scratch(shingle_sets(texts).join(members, ["at", "h"]).dropDuplicates(["node"]).select("node", "s", "w"), "sets")
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("s_"), F.col("w").alias("w_"))
    sizes = scratch(sets.select("node", F.size("s").alias("n")), "sizes")
    labels = None

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("label", F.col("node")) if labels is None else df.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def compare(pairs: DataFrame) -> None:
        """Verify pairs and join the classes that the links found lie between."""
        nonlocal labels
        met = scratch(pairs, "met")
        found = scratch(sets.withColumnRenamed("node", "a").join(small(met), "a").join(right, "b").where(alike("s", "w", "s_", "w_")).select("a", "b"), "found")
        if found.isEmpty():
            return
        if labels is None:
            labels = components(found)
            return
        ends = labelled(found.select(F.col("a").alias("node"), "b")).select(F.col("b").alias("node"), F.col("label").alias("a"))
        joined = components(labelled(ends).select("a", F.col("label").alias("b")).where("a <> b").distinct())
        roots = small(joined.select(F.col("node").alias("label"), F.col("label").alias("root")))
        old = labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        labels = scratch(old.union(joined.join(small(labels.select("node")), "node", "left_anti")), "classes")

    for turn in range(star_rounds):
        compare(star_pairs(scratch(labelled(bands.join(small(sizes), "node")), "labelled"), turn))
    rest = scratch(labelled(bands), "labelled")
    rest = scratch(rest.join(apart(rest, "key"), "key"), "apart")
    if not rest.isEmpty():
        of_node = scratch(rest.groupBy("node", "label").agg(F.collect_set("key").alias("keys")), "buckets")
        ids = scratch(of_node.select("node", "label"), "rest")
        prefix = scratch(prefixes(sets.join(small(ids), "node")), "prefix").drop("label")
        for turn in range(1, star_rounds + 1):  # the shingles of prefixes are buckets too, and sharper ones
            rows = scratch(labelled(prefix.select(F.col("shingle").alias("key"), "node", "n", "own")), "labelled")
            compare(star_pairs(rows.join(apart(rows, "key"), "key"), turn, own=True))
        compare(prefix_pairs(labelled(prefix), of_node.select("node", "keys")))
    return labels


def texts_of(docs: DataFrame, star_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row, and of each text (h) its class: (h, class, first, at, at2), class a number, first the
    smallest doc_id of the text's rows and at, at2 the place of the row that has it."""
    sketches = scratch(sketch_bands(docs), "sketches")
    rows = sketches.where("h is not null").groupBy("h").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "at2")).alias("row"), F.any_value("keys").alias("keys")
    )
    nodes = scratch(rows.select(F.monotonically_increasing_id().alias("node"), "h", F.col("row.doc_id").alias("first"), F.col("row.at").alias("at"), F.col("row.at2").alias("at2"), "keys"), "nodes")
    labels = linked(docs, nodes, star_rounds)
    kept = nodes.select("node", "h", "first", "at", "at2")
    kept = kept.withColumn("class", F.col("node")) if labels is None else kept.join(small(labels), "node", "left").withColumn("class", F.coalesce("label", "node"))
    return sketches, scratch(kept.select("h", "class", "first", "at", "at2"), "texts")


def classes(docs: DataFrame, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id and class_id for each row of docs."""
    sketches, texts = texts_of(docs.select("doc_id", "text"), star_rounds)
    ids = texts.groupBy("class").agg(F.min("first").alias("class_id"))
    of_text = texts.join(ids, "class").select("h", "class_id")
    wordless = sketches.where("h is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return sketches.where("h is not null").join(of_text, "h").select("doc_id", "class_id").union(wordless)


def keep_one(docs: DataFrame, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """docs with one row of each class, that with the smallest doc_id (rows without one come last); rows without a
    word stay. Rows to leave out are told by hashes of id and text, so no text is shuffled unless rows repeat both."""
    sketches, texts = texts_of(docs.select("doc_id", "text"), star_rounds)
    firsts = texts.groupBy("class").agg(F.min(F.struct(F.col("first").isNull(), "first", "at", "at2")).alias("row")).select("row.at", "row.at2").withColumn("kept", F.lit(True))
    rows = sketches.where("h is not null").groupBy("at", "at2").agg(F.count("*").alias("copies")).join(firsts, ["at", "at2"], "left")
    marks = scratch(rows.select("at", "at2", F.coalesce("kept", F.lit(False)).alias("kept"), (F.col("copies") > 1).alias("again")).where("again or not kept"), "marks")
    at, at2 = places()
    out, name = private(docs, at=at, at2=at2)
    marked = small(marks).select(F.col("at").alias(name["at"]), F.col("at2").alias(name["at2"]), F.col("kept").alias("__kept"))
    keys = [name["at"], name["at2"]]
    single = out.join(marked, keys, "left_anti")
    if not marks.where("kept").isEmpty():
        again = out.join(marked.where("__kept"), keys, "left_semi").dropDuplicates(keys)
        single = single.union(again)
    return single.select(*[F.col(f"`{c}`") for c in docs.columns])
