"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Codes: several rotations are learned on a bounded sample by iterative quantisation (alternating between the
sample's sign codes and the orthogonal rotation that fits them best); a vector's code is the signs of its
rotated components. A code is cut into substrings and each substring has its own index, from its value to
rows. By the pigeonhole principle a code within Hamming radius r of a query's agrees with it in some
substring up to floor(r / substrings) bits (one bit less from the (r mod substrings)+2nd on), so probing those buckets retrieves every
code within r; those are reranked by exact cosine in double precision.

The radius is set on the same sample, such that codes of true neighbours fall within it at the wanted rate.
All vectors are indexed once, in blocks dealt by a hash of their id; the stated query set passes by every block's index,
batch by batch, so a task holds one block and one batch of queries. Where a block has fewer than k codes within the radius, its k nearest codes are reranked too,
so a query always gets k rows if there are as many.

Defined results: vectors null, zero or with null or non-finite components (or of another length than most of
the sample) take no part; rows with equal id and vector are one; of rows with one id and different vectors the best counts, for
queries as for candidates; ties go to the smaller vec_id. Rows without id take no part; other columns neither.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows at most that rotations and radius are fitted on.
FIT_ROWS = 2000
ROTATIONS, SUBSTRING_BITS = 4, 16
WANTED_RATE = 0.985
BLOCK_ROWS, LEAST_BLOCKS = 16384, 96


@dataclass
class Codes:
    mean: np.ndarray  # d
    rotations: np.ndarray  # d x bits
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """n x substrings of unsigned 16-bit integers; x: unit vectors."""
        bits = (x - self.mean) @ self.rotations > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray, rounds: int, g: np.random.Generator) -> np.ndarray:
    """One learned rotation (d x d) by iterative quantisation; x: centred vectors."""
    r = np.linalg.qr(g.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """len(a) x len(b) distances of codes."""
    out = np.zeros((len(a), len(b)), np.int16)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def fit(sample: np.ndarray, k: int = 5, rotations: int = ROTATIONS, seed: int = 11) -> Codes:
    g = np.random.default_rng(seed)
    x = unit(sample)
    mean = x.mean(0)
    turn = np.hstack([quantise(x - mean, 25, g) for _ in range(rotations)])
    if pad := -turn.shape[1] % 16:
        turn = np.hstack([turn, g.normal(size=(x.shape[1], pad))])
    codes = Codes(mean, turn, turn.shape[1])
    asked = x[g.permutation(len(x))[:400]]
    sims = asked @ x.T
    sims[sims > 1 - 1e-12] = -2  # the query itself and its copies, which are at distance 0 anyway
    if len(x) > k:
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        found = np.take_along_axis(hamming(codes.encode(asked), codes.encode(x)), near, 1)
        codes.radius = int(np.ceil(np.quantile(found, WANTED_RATE)))
    return codes


@lru_cache(64)
def masks(reach: int) -> np.ndarray:
    """All 16-bit values with at most reach bits set."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= reach]


class MultiIndex:
    """The substring indexes of one block of rows: for each substring its values in order, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            values, counts = np.unique(codes[:, j], return_counts=True)
            self.tables.append((values, np.append(0, np.cumsum(counts)), np.argsort(codes[:, j], kind="stable")))

    def probed(self, values: np.ndarray, asked: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket) of every bucket within reach bits of a query's substring: the values near it are looked up, or
        where these are more than there are buckets, the buckets are compared with it."""
        if len(near := masks(reach)) >= len(values):
            return np.nonzero(np.bitwise_count(asked[:, None] ^ values[None, :]) <= reach)
        wanted = asked[:, None] ^ near[None, :]
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        q, k = np.nonzero(values[at] == wanted)
        return q, at[q, k]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """queries x rows: is the row's code within radius of the query's? Only probed buckets' rows are compared."""
        m = self.codes.shape[1]
        each, more = divmod(min(radius, 16 * m), m)
        hit = np.zeros((len(query), len(self.codes)), bool)
        for j, (values, first, rows) in enumerate(self.tables):
            reach = each if j <= more else each - 1
            if reach >= 0:
                q, bucket = self.probed(values, query[:, j], reach)
                sizes = first[bucket + 1] - first[bucket]
                within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hit[np.repeat(q, sizes), rows[np.repeat(first[bucket], sizes) + within]] = True
        q, r = np.nonzero(hit)
        dist = np.zeros(len(q), np.int16)
        for j in range(m):
            dist += np.bitwise_count(query[q, j] ^ self.codes[r, j])
        hit[q, r] = dist <= radius
        return hit


class Block:
    """A block of rows and its index, built once for all queries that come."""

    def __init__(self, codes: Codes, rows: np.ndarray, ids: np.ndarray):
        self.codes, self.rows, self.ids = codes, rows, ids
        self.norms = np.linalg.norm(rows, axis=1)
        self.index = MultiIndex(codes.encode(rows / self.norms[:, None]))

    def search(self, asked: np.ndarray, asked_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query id, row id, cosine) of each query's k best other ids of the block. An id of several rows counts by its best."""
        for lo in range(0, len(asked), 256):
            some = asked[lo : lo + 256]
            mine = self.codes.encode(unit(some))
            hit = self.index.within(mine, self.codes.radius)
            hit &= asked_ids[lo : lo + 256, None] != self.ids[None, :]
            for i, query in enumerate(some):
                own = int(asked_ids[lo + i])
                found = np.flatnonzero(hit[i])
                if len(np.unique(self.ids[found])) < k:  # the nearest codes beyond the radius fill up
                    others = np.flatnonzero(self.ids != own)
                    order = others[np.argsort(hamming(mine[i : i + 1], self.index.codes[others])[0], kind="stable")]
                    _, at = np.unique(self.ids[order], return_index=True)
                    found = np.union1d(found, np.flatnonzero(np.isin(self.ids, self.ids[order[np.sort(at)[:k]]])))
                sims = (self.rows[found] * query).sum(axis=1) / (self.norms[found] * np.linalg.norm(query))
                taken: set[int] = set()
                for b in np.lexsort((self.ids[found], -sims)):
                    if len(taken) == k:
                        break
                    if (other := int(self.ids[found[b]])) not in taken:
                        taken.add(other)
                        yield own, other, float(sims[b])


def usable(vector: Column) -> Column:
    return (
        vector.isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(vector, lambda v: v != 0)
    )


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row for which is_query holds."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda v: v.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    sample = good.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()  # bounded
    schema = "query_id bigint, vec_id bigint, score double"
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sample:
        return empty
    sizes = Counter(len(r.v) for r in sample)
    dim = min(sizes, key=lambda n: (-sizes[n], n))
    codes = fit(np.array([r.v for r in sample if len(r.v) == dim]), k)
    good = good.where(F.size("v") == dim)
    good = good.dropDuplicates(["id", "v"])  # a row that is repeated counts once, however often
    n = good.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks")).first()
    blocks = max(LEAST_BLOCKS, -(-n["rows"] // BLOCK_ROWS))
    rows = good.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    asks = good.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "asks", "id", "v")
    met = rows.union(asks).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block first its rows come, then the queries: the index is made once and the queries pass by it."""
        at, ids, vectors, block = None, [], [], None
        for b in batches:
            number, is_ask, of = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            v = b.column(3).flatten().to_numpy().reshape(len(of), dim)
            edge = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (is_ask[1:] != is_ask[:-1])))
            for lo, hi in zip(edge, np.append(edge[1:], len(of))):
                if number[lo] != at:
                    at, ids, vectors, block = number[lo], [], [], None
                if not is_ask[lo]:
                    ids.append(of[lo:hi].copy())
                    vectors.append(v[lo:hi].copy())
                elif ids:
                    block = block or Block(codes, np.vstack(vectors), np.concatenate(ids))
                    got = list(block.search(v[lo:hi], of[lo:hi], k))
                    cols = list(zip(*got)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return best_of(met.mapInArrow(search, schema), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the blocks gave, at most k a block and query row."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
