"""Coding regions by codon composition: windows on both strands, their correspondence analysis, and tests of the stretches between stops.

Windows are numbered from 0 within a strand and frame and start at ``frame + 1 + k * shift``; the last of a frame may be
short, as it is the first that passes the end. Strand F is the sequence as given, R its reverse complement, with places counted along it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S
from helixspark.functions.tails import t_tail
from helixspark.operators.ordered import range_join

SIZE, SHIFT, STOPS = 90, 30, ("taa", "tag", "tga")
#: Windows that a task holds at once.
CHUNK = 20_000
_CODE = np.full(256, -1, np.int16)
for _i, _b in enumerate(K.BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.upper())] = _i


def letters(seq: str, strand: str) -> np.ndarray:
    """Bases as numbers in the order acgt, -1 for anything else."""
    codes = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    return codes if strand == "F" else np.where(codes < 0, -1, 3 - codes)[::-1]


def window_chunks(codes: np.ndarray, frame: int, size: int, shift: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first window, windows x 64 counts of codons) of a frame. Each step between two windows' starts is
    counted once and windows add up their steps."""
    n = len(codes)
    if n <= frame:
        return
    last = max(0, (n - size - frame - 1) // shift + 1)
    step = math.gcd(size, shift)
    per, hop = size // step, shift // step
    for first in range(0, last + 1, CHUNK):
        upto = min(last + 1, first + CHUNK)
        lo = frame + first * shift
        part = codes[lo : lo + (upto - 1 - first) * shift + size]
        steps = (upto - 1 - first) * hop + per
        whole = part[: len(part) // 3 * 3].reshape(-1, 3).astype(np.int32)
        codon = np.where((whole >= 0).all(1), whole @ np.array([16, 4, 1], np.int32), 64)
        at = np.arange(len(codon)) // (step // 3)
        counts = np.bincount(at * 65 + codon, minlength=steps * 65)[: steps * 65].reshape(steps, 65)[:, :64]
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(counts, 0)])
        starts = np.arange(upto - first) * hop
        yield first, (sums[starts + per] - sums[starts]).astype(np.int32)


def _checked(size: int, shift: int) -> None:
    if size % 3 or shift % 3 or not 0 < shift <= size:
        raise ValueError("size and shift must be multiples of 3 and shift at most size")


def windows(df: DataFrame, keys: list[str], size: int = SIZE, shift: int = SHIFT, strands: str = "FR", seq: str = "seq") -> DataFrame:
    """keys, strand, frame, k, start, counts (array<int> over the 64 codons in alphabetical order) of all windows. Nothing is shuffled."""
    _checked(size, shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for strand in strands if text else "":
                    codes = letters(text, strand)
                    for frame in range(3):
                        for first, counts in window_chunks(codes, frame, size, shift):
                            n = len(counts)
                            ks = np.arange(first, first + n, dtype=np.int64)
                            own = [b.column(i).take(pa.array(np.full(n, row))) for i in range(len(keys))]
                            lists = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), 64).cast(pa.list_(pa.int32()))
                            cols = [*own, pa.array([strand] * n), pa.array(np.full(n, frame, np.int32)), pa.array(ks), pa.array(frame + 1 + ks * shift), lists]
                            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "strand", "frame", "k", "start", "counts"])

    source = df.select(*keys, seq)
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, strand string, frame int, k bigint, start bigint, counts array<int>")


def _axes(chunks: Iterable[np.ndarray], axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Eigenvalues, codons' coordinates and loads of a table of windows given in chunks; None if it has no codon."""
    total, cross = np.zeros(64), np.zeros((64, 64))
    for counts in chunks:
        x = counts[counts.sum(1) > 0].astype(float)
        total += x.sum(0)
        cross += x.T @ (x / x.sum(1)[:, None])
    if not total.sum():
        return None
    share = total / total.sum()
    scale = np.where(share > 0, 1 / np.sqrt(np.where(share > 0, share, 1)), 0)
    m = cross / total.sum() * scale[:, None] * scale - np.outer(np.sqrt(share), np.sqrt(share))
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    values, loads = values[::-1][:axes], (vectors[:, ::-1][:, :axes] * scale[:, None]).T
    loads = loads * np.where(loads[np.arange(len(loads)), np.abs(loads).argmax(1)] < 0, -1, 1)[:, None]
    return values, loads * np.sqrt(np.maximum(values, 0))[:, None], loads


def codon_axes(df: DataFrame, keys: list[str], axes: int = 4, size: int = SIZE, shift: int = SHIFT, seq: str = "seq") -> DataFrame:
    """keys, strand, values, codons, loads: the correspondence analysis of each sequence's windows, a table of windows x 64 codons.
    values are eigenvalues; codons the codons' coordinates on each axis; loads what a window's codon shares are multiplied with for its own
    coordinate. The table is summed to 64 x 64 products as it is made and never held. Axes turn so that the largest
    load is positive; absent codons have 0."""
    _checked(size, shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], {"strand": [], "values": [], "codons": [], "loads": []}
            for row, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for strand in "FR" if text else "":
                    codes = letters(text, strand)
                    found = _axes((counts for frame in range(3) for _, counts in window_chunks(codes, frame, size, shift)), axes)
                    if found is None:
                        continue
                    rows.append(row)
                    for name, x in zip(out, (strand, *(x.tolist() for x in found))):
                        out[name].append(x)
            kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64()))]
            own = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], names=[*keys, *out])

    source = df.select(*keys, seq)
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, strand string, values array<double>, codons array<array<double>>, loads array<array<double>>")


def inter_stop(df: DataFrame, keys: list[str], least: int = 150, strands: str = "FR", seq: str = "seq") -> DataFrame:
    """keys, strand, frame, before, stop: neighbouring stop codons of a frame (their first places, from 1) that lie more than least apart. The
    sequence's ends count as stops: one codon before the frame's first place, and its last whole codon."""
    both = F.array(*[F.struct(F.lit(s).alias("strand"), (F.lower(F.col(seq)) if s == "F" else S.revcomp(F.col(seq), ambiguous=True)).alias("s")) for s in strands])
    rows = df.where(F.length(seq) > 0).select(*keys, F.explode(both).alias("t")).select(*keys, "t.strand", "t.s", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("frame"))
    n, f = F.length("s"), F.col("frame")
    codons = F.when(f == 0, S.splitseq(F.col("s"), 0)).when(f == 1, S.splitseq(F.col("s"), 1)).otherwise(S.splitseq(F.col("s"), 2))
    inner = F.filter(F.transform(codons, lambda c, i: F.when(c.isin(*STOPS), f + 3 * i + 1)), lambda p: p.isNotNull())
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(f - 2), inner, F.array(n - F.pmod(n - f, F.lit(3)) - 2))))
    rows = rows.select(*keys, "strand", "frame", cuts.alias("c"))
    spans = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("before"), b.alias("stop")))
    return rows.select(*keys, "strand", "frame", F.explode(spans).alias("p")).select(*keys, "strand", "frame", F.col("p.before").cast("bigint").alias("before"), F.col("p.stop").cast("bigint").alias("stop")).where(F.col("stop") - F.col("before") > least)


def stretches(codes: np.ndarray, least: int) -> np.ndarray:
    """Rows frame, before and stop of the stretches of a strand of at least three letters, as ``inter_stop`` has them."""
    n, x = len(codes), np.where(codes < 0, 64, codes)  # with another letter in it a codon is 64 or above
    codon = 16 * x[:-2] + 4 * x[1:-1] + x[2:]
    at = np.flatnonzero(np.logical_or.reduce([codon == sum(int(_CODE[ord(c)]) * k for c, k in zip(stop, (16, 4, 1))) for stop in STOPS]))
    out = []
    for frame in range(3):
        cuts = np.concatenate([[frame - 2], at[at % 3 == frame] + 1, [n - (n - frame) % 3 - 2]])
        far = np.flatnonzero(cuts[1:] - cuts[:-1] > least)
        out.append([np.full(len(far), frame), cuts[far], cuts[far + 1]])
    return np.concatenate(out, 1)


def within(points: DataFrame, segments: DataFrame, keys: list[str], at: str, size: int, most_out: float) -> DataFrame:
    """Pairs of a window and a stretch of its strand in which it lies but for a share most_out of its size at either end."""
    spans = segments.withColumns({"low": F.ceil(F.col("before") - most_out * size).cast("bigint"), "high": F.floor(F.col("stop") - (1 - most_out) * size).cast("bigint")})
    return range_join(points, spans, [*keys, "strand"], at, "low", "high", 64 * size)


def welch_p(mean: list[Column], var: list[Column], n: list[Column]) -> Column:
    """p of Welch's test from two groups' moments; null if either has under two values or neither varies."""
    va, vb = F.try_divide(var[0], n[0]), F.try_divide(var[1], n[1])
    t = F.try_divide(mean[0] - mean[1], F.sqrt(va + vb))
    df = F.try_divide(F.pow(va + vb, 2.0), F.try_divide(va * va, n[0] - 1) + F.try_divide(vb * vb, n[1] - 1))
    return t_tail(t, df)


def score_tests(scored: DataFrame, segments: DataFrame, keys: list[str], size: int = SIZE, most_out: float = 0.2, level: float = 0.05) -> DataFrame:
    """keys, strand, frame, start, end, mean_1 to mean_3, p_a, p_b, cds: for each stretch between stops, whether the windows (keys, strand,
    w_frame, at, score) of its own frame differ from those of both other frames, at a level. p_a compares with the lower-numbered other frame. Windows
    meet stretches in a range join; per frame only three moments are kept. Without two windows in each frame p is null and cds false."""
    met = within(scored, segments, keys, "at", size, most_out)
    of = lambda f, g, n: f(F.when(F.col("w_frame") == g, F.col("score"))).alias(f"{n}_{g}")
    group = [*keys, "strand", "frame", "before", "stop"]
    sums = met.groupBy(*group).agg(*[of(f, g, n) for g in range(3) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    rows = segments.select(*group).join(sums, group, "left")
    pick = lambda n, own: [F.coalesce(*[F.when(F.col("frame") == g, F.col(f"{n}_{h}")) for g, h in enumerate(own)])]
    own, a, b = (0, 1, 2), (1, 0, 0), (2, 2, 1)
    p = lambda other: welch_p(pick("mean", own) + pick("mean", other), pick("var", own) + pick("var", other), pick("n", own) + pick("n", other))
    rows = rows.withColumns({"p_a": p(a), "p_b": p(b)})
    return rows.select(
        *keys, "strand", "frame", (F.col("before") + 3).alias("start"), (F.col("stop") + 2).alias("end"), *[F.col(f"mean_{g}").alias(f"mean_{g + 1}") for g in range(3)],
        "p_a", "p_b", F.coalesce((F.col("p_a") < level) & (F.col("p_b") < level), F.lit(False)).alias("cds"),
    )


def test_scores(df: DataFrame, keys: list[str], factor: int = 1, least: int = 150, most_out: float = 0.2, level: float = 0.05, size: int = SIZE, shift: int = SHIFT, seq: str = "seq") -> DataFrame:
    """score_tests on the windows' coordinates on an axis (1 to 4) of their sequence's correspondence analysis."""
    axes = codon_axes(df, keys, 4, size, shift, seq).select(*keys, "strand", F.get("loads", F.lit(factor - 1)).alias("load"))
    w = windows(df, keys, size, shift, seq=seq).withColumn("n", F.aggregate("counts", F.lit(0), lambda a, x: a + x)).where("n > 0").join(axes, [*keys, "strand"])
    score = F.aggregate(F.zip_with("counts", "load", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    scored = w.select(*keys, "strand", F.col("frame").alias("w_frame"), F.col("start").alias("at"), score.alias("score"))
    return score_tests(scored, inter_stop(df.where(F.length(seq) >= least), keys, least, seq=seq), keys, size, most_out, level)


def kruskal(counts: np.ndarray, codons: np.ndarray) -> np.ndarray:
    """Kruskal and Wallis's statistic, corrected for ties, of the codons' coordinates between the groups of each window (windows x groups x 64
    counts); nan where a group is empty or all are tied."""
    order = np.argsort(codons, kind="stable")
    level = np.flatnonzero(np.concatenate([[True], np.diff(codons[order]) != 0]))
    g = np.add.reduceat(counts[..., order].astype(float), level, 2)
    t, size = g.sum(1), g.sum(2)
    n = t.sum(1)
    rank = np.cumsum(t, 1) - (t - 1) / 2
    with np.errstate(all="ignore"):
        tied = 1 - (t**3 - t).sum(1) / (n**3 - n)
        h = (12 / (n * (n + 1)) * ((g @ rank[:, :, None])[:, :, 0] ** 2 / size).sum(1) - 3 * (n + 1)) / tied
    return np.where((tied > 0) & size.all(1), h, np.nan)


def test_codons(df: DataFrame, keys: list[str], factor: int = 1, least: int = 150, most_out: float = 0.2, win_share: float = 0.8, level: float = 0.01, size: int = SIZE, shift: int = SHIFT, seq: str = "seq") -> DataFrame:
    """keys, strand, frame, start, end, n, n_low, cds: for each stretch between stops, whether in more than win_share of the windows in it the codons'
    coordinates on an axis differ between the three frames (p < level). Only windows that are complete in all
    three frames take part; a stretch without any is no coding region. A sequence is read once, with its stretches, and nothing is shuffled; strands without stretches are left out."""
    _checked(size, shift)

    def taken(frames: list[Iterable], low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and counts (windows x frames x 64) of the windows that take part and lie in a stretch (from window low to high)."""
        for (first, c0), (_, c1), (_, c2) in zip(*frames):
            counts = np.stack([c[: min(map(len, (c0, c1, c2)))] for c in (c0, c1, c2)], 1)
            met = np.zeros(len(counts) + 1, np.int64)
            np.add.at(met, np.clip(low - first, 0, len(counts)), 1)
            np.add.at(met, np.clip(high + 1 - first, 0, len(counts)), -1)
            at = np.flatnonzero(np.cumsum(met[:-1]) > 0)
            at = at[(counts[at].sum(2) == size // 3).all(1)]
            if len(at):
                yield first + at, counts[at]

    def tested(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many windows take part in each stretch, and for how many p is below level."""
        made = lambda: [window_chunks(codes, f, size, shift) for f in range(3)]
        if len(codes) <= CHUNK * shift:
            frames = [list(f) for f in made()]
            parts = list(taken(frames, low, high))
            again = lambda: (frames, parts)
        else:  # not held but made again
            again = lambda: (made(), taken(made(), low, high))
        if next(iter(again()[1]), None) is None:
            return np.zeros((2, len(low)), np.int64)
        frames, parts = again()
        axis = _axes((counts for frame in frames for _, counts in frame), 4)[1][factor - 1]
        ks, hs = zip(*((k, kruskal(counts, axis)) for k, counts in parts))
        k = np.concatenate(ks)
        # the tail of the chi-squared law with two degrees of freedom
        passed = np.concatenate([[0], np.cumsum(np.exp(-np.concatenate(hs) / 2) < level)])
        a, z = np.searchsorted(k, low, "left"), np.searchsorted(k, high, "right")
        return np.stack([z - a, passed[z] - passed[a]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, strands, found = [], [], []
            for row, text in enumerate(b.column(len(keys)).to_pylist()):
                for strand in "FR" if text and len(text) >= max(3, least) else "":
                    codes = letters(text, strand)
                    spans = stretches(codes, least)
                    if not spans.shape[1]:
                        continue
                    _, before, stop = spans
                    # numbers of the first and the last window in a stretch
                    low = np.ceil((np.ceil(before - most_out * (size + 2)) - 1) / shift).astype(np.int64)
                    high = np.floor((np.floor(stop - (1 - most_out) * (size + 2)) - 1) / shift).astype(np.int64)
                    rows += [row] * len(before)
                    strands += [strand] * len(before)
                    found.append(np.concatenate([spans, tested(codes, low, np.maximum(high, low - 1))]))
            if rows:
                frame, before, stop, n, n_low = np.concatenate(found, 1)
                own = [b.column(k).take(pa.array(rows)) for k in range(len(keys))]
                out = [pa.array(strands), pa.array(frame.astype(np.int32)), *map(pa.array, (before + 3, stop + 2, n, n_low, n_low / np.maximum(n, 1) > win_share))]
                yield pa.RecordBatch.from_arrays([*own, *out], names=[*keys, "strand", "frame", "start", "end", "n", "n_low", "cds"])

    source = df.select(*keys, seq)
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, strand string, frame int, start bigint, end bigint, n bigint, n_low bigint, cds boolean")
