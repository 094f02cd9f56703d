"""Spelling variants of a corpus's words, grouped by a symmetric-delete join.

Words are counted over all texts. Every word emits a key for itself and for each of its distinct single deletions; words that share a
key are candidates, an edit distance of exactly one is verified on the strings, and each word takes as its form the most frequent of
its near words if that is so many times as frequent. Forms are followed to their roots by joining links with themselves, which
doubles their reach each round.

A key is a hash of the deletion, found from running sums along the word, so a word of any length costs its length, not its square.
One key is shared by words that are one string with one letter put in, of which there are at most alphabet x (length + 1):
the pairs within a key don't grow with the corpus, nor with any word's frequency.

Defined results: a null text holds no words; a null doc_id counts as an empty string where the id is hashed. Repeated rows count as often as they
come. Ties of frequency go to the word that sorts first by code points. An empty table gives no rows. Other columns do not take part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import bounded_batches, scratch

#: Letters A-Z, a-z and U+00C0 to U+00FF in UTF-8, after bytes.lower(), which lowers only A-Z.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Where a long text may be cut: no byte of a run.
BORDER = re.compile(rb"[^a-z\x80-\xff]")
PART, MOST_HELD = 1 << 20, 200_000
#: One of so many (document, run) pairs loses a code point; words shorter or rarer take no part; a form is so many times as frequent.
ONE_OF, SHORTEST, RAREST, TIMES = 199, 6, 5, 5
PRIMES, BASES = (2147483647, 2147483629), (1_000_003, 998_244_353)


def parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        cut = BORDER.search(data, at + PART)
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def observed(doc_id, text: str) -> Counter:
    """The words of a text and their counts: its runs of letters, of which a hash with doc_id picks some to lose a code point."""
    found: Counter = Counter()
    data = text.encode("utf-8", "surrogatepass").lower()
    for part in parts(data):
        found.update(RUN.findall(part))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc = zlib.crc32
    changed = {r: h for r in found if not (h := crc(r, start)) % ONE_OF}
    moved = [(run, h, found.pop(run)) for run, h in changed.items()]  # all before any is added: a word can be another's deletion
    for run, h, n in moved:
        word = run.decode()
        at = h % len(word)
        found[(word[:at] + word[at + 1 :]).encode()] += n
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: all distinct words of the texts that are long and frequent enough."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kept = [w for w in held if len(w) >= SHORTEST and (w.isascii() or len(w.decode()) >= SHORTEST)]
            out = pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array([held[w] for w in kept], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text.is_valid:
                    held.update(observed(doc_id, text.as_py()))
                    if len(held) > MOST_HELD:
                        yield flush()
        yield flush()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, key): a 62-bit hash of each word and of each of its distinct single deletions.

    The hash is the sum of code points by powers of a base; a deletion's is the sum before it and, one power less, after it."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    deleted, selves = np.zeros(len(codes), np.uint64), np.zeros(len(words), np.uint64)
    for prime, base in zip(PRIMES, BASES):
        p = np.uint64(prime)
        powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
        done = 1
        while done < len(powers):  # doubled: the powers so far times the next one
            step = min(done, len(powers) - done)
            powers[done : done + step] = powers[:step] * np.uint64(pow(base, done, prime)) % p
            done += step
        before = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[place] % p)])
        after = np.concatenate([[np.uint64(0)], np.cumsum(np.where(place > 0, codes * powers[np.maximum(place, 1) - 1] % p, np.uint64(0)))])
        ends = starts + sizes
        at = np.arange(len(codes))
        whole = (before[ends] - before[starts]) % p
        one_less = (before[at] - before[starts[owner]] + after[ends[owner]] - after[at + 1]) % p
        selves, deleted = selves * np.uint64(1 << 31) + whole, deleted * np.uint64(1 << 31) + one_less
    distinct = np.ones(len(codes), bool)
    distinct[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)  # of a row of equal letters any gives the same deletion
    return np.concatenate([np.arange(len(words)), owner[distinct]]), np.concatenate([selves, deleted[distinct]]).astype(np.int64)


def keys(words: DataFrame) -> DataFrame:
    """(key, id) of each word and of its distinct single deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, strings = b.column(0).to_numpy(), b.column(1).to_pylist()
            lo, held = 0, 0
            for k, w in enumerate([*strings, None]):
                if w is None or k > lo and held + len(w) > PART // 8:
                    if k > lo:
                        owner, key = keys_of(strings[lo:k])
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[lo:k][owner])], names=["key", "id"])
                    lo, held = k, 0
                held += len(w or "")

    return words.select("id", "word").mapInArrow(run, "key bigint, id bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (a.id < b.id; structs of id, word, n) that differ by exactly one inserted, deleted or replaced code point."""
    shared = keys(words)
    pairs = shared.alias("x").join(shared.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id")).distinct()
    whole = F.struct("id", "word", "n")
    a, b = words.select(F.col("id").alias("a_id"), whole.alias("a")), words.select(F.col("id").alias("b_id"), whole.alias("b"))
    return pairs.join(a, "a_id").join(b, "b_id").filter(F.levenshtein("a.word", "b.word", 1) == 1).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """id and root (id) of each row of links (id, form_id): forms followed to the last. Each round doubles the reach; a form is several
    times as frequent as its word, so there are no circles and few rounds."""
    now = scratch(links.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        now = scratch(now.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the texts."""
    words = scratch(word_counts(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("near")), F.struct(F.col("b").alias("own"), F.col("a").alias("near")))).alias("p"))
    best = F.min(F.struct((-F.col("p.near.n")).alias("less"), F.col("p.near.word").alias("word"), F.col("p.near.id").alias("id")))
    near = scratch(both.groupBy(F.col("p.own.id").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near_words")
    found = scratch(
        words.join(near, "id", "left").withColumn("taken", -F.col("best.less") >= TIMES * F.col("n")).select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("taken"), F.col("best.id")).alias("form_id"), F.when(F.col("taken"), F.col("best.word")).alias("form"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.filter("form_id is not null")).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return found.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
