"""Walks along sequences and ordered events: cumulative skews, windows, islands, tests on marked positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S
from helixspark.operators.ordered import running


def walk(df: DataFrame, keys: list[str], order: list[str], step: Column, name: str = "walk") -> DataFrame:
    """df with the running sum of step along each key's order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(step).over(w))


def codon_skews(cds: DataFrame, seq: str = "seq") -> DataFrame:
    """cds with x = t - a and y = c - g at third codon positions."""
    third = S.every_third(F.col(seq), 3)
    n = lambda c: S.times(F.col("__third"), c).cast("bigint")
    return cds.withColumn("__third", third).withColumns({"x": n("t") - n("a"), "y": n("c") - n("g")}).drop("__third")


def projected_walk(walk: DataFrame, keys: list[str], order: str, kept: list[str] | None = None) -> DataFrame:
    """walk (keys, order, x, y: cumulated) with skew: its points projected on the main axis through zero; the sign follows y. The axis
    comes from three sums a key."""
    w = walk.select(*keys, order, *(kept or []), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    m = w.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    angle = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    p = w.join(m.select(*keys, F.cos(angle).alias("ux"), F.sin(angle).alias("uy")), keys).withColumn("skew", F.col("x") * F.col("ux") + F.col("y") * F.col("uy"))
    sign = p.groupBy(*keys).agg(F.when(F.covar_pop("skew", "y") < 0, -1.0).otherwise(1.0).alias("sign"))
    return p.join(sign, keys).select(*keys, order, *(kept or []), "x", "y", (F.col("skew") * F.col("sign")).alias("skew"))


def origin_walk(cds: DataFrame, keys: list[str], order: str, seq: str = "seq") -> DataFrame:
    """keys, order, x, y, skew: cumulated third-position skews of a genome's coding sequences in their order, projected."""
    steps = codon_skews(cds, seq).select(*keys, order, F.col("x").alias("dx"), F.col("y").alias("dy"))
    return projected_walk(running(steps, keys, [order], {"x": F.col("dx"), "y": F.col("dy")}), keys, order)


def gene_skews(genomes: DataFrame, genes: DataFrame, key: str, seq: str = "seq", rotation: int = 0) -> DataFrame:
    """key, gene, place, excess, x, y of genes (key, gene, start, end) of circular genomes (key, seq): the middle in kb, 1 on the strand given and -1 on the
    other (end before start), and t - a and c - g of the third codon positions, both read on the strand given.

    A gene whose ends lie more than half a genome apart wraps around: it runs on past the last base. With rotation the genome begins that
    many bases later. A genome is read once for all its genes: sums along each of three phases give any gene's counts by
    subtraction. Genes that reach beyond their genome are null in x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (text, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                codes = np.frombuffer((text or "").lower().encode("latin-1", "replace"), np.uint8)
                n, turn = len(codes), rotation % max(1, len(codes))
                codes = np.concatenate([codes[turn:], codes[:turn]])
                twice = np.concatenate([codes, codes])
                sums = []
                for plus, minus in (b"ta", b"cg"):
                    v = (twice == plus).astype(np.int32) - (twice == minus)
                    c = np.zeros(len(v) + 3, np.int32)  # of v at i, i - 3, i - 6, ...
                    for phase in range(3):
                        c[3 + phase :: 3] = np.cumsum(v[phase::3])
                    sums.append(c)
                start, end = (np.array([g[k] for g in own], np.int64) - rotation for k in ("start", "end"))
                start, end = np.where(start < 1, start + n, start), np.where(end < 1, end + n, end)
                good = (start >= 1) & (start <= n) & (end >= 1) & (end <= n)
                wraps = np.abs(end - start) > n / 2
                direct = np.where(wraps, start > end, start < end)
                # third positions from first up to last, in steps of 3, in the doubled genome
                first = np.where(direct, start + 2, 0)
                last = np.where(direct, np.where(wraps, end + n, end), np.where(wraps, start + n, start) - 2)
                low = np.where(direct, first, np.where(wraps, end, end))
                steps = np.where(direct, (last - first) // 3, (last - low) // 3)
                top = np.where(direct, first + 3 * steps, last)
                bottom = np.where(direct, first, last - 3 * steps)
                some = good & (steps >= 0) & (top <= 2 * n)
                t, u = np.where(some, top + 2, 0), np.where(some, bottom - 1, 0)
                x, y = (np.where(some, c[t] - c[u], 0) for c in sums) if n else (np.zeros(len(own), int),) * 2
                cols = [b.column(0).take(pa.array(np.full(len(own), row))), pa.array([g["gene"] for g in own], pa.int64()), pa.array((start + end) / 2000), pa.array(np.where(direct, 1, -1)), pa.array(x, pa.int64(), mask=~good), pa.array(y, pa.int64(), mask=~good)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "gene", "place", "excess", "x", "y"])

    sets = genes.groupBy(key).agg(F.collect_list(F.struct(F.col("gene").cast("bigint").alias("gene"), "start", "end")).alias("genes"))
    source = genomes.select(key, seq).join(sets, key)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, gene bigint, place double, excess bigint, x bigint, y bigint")


def genome_walk(genomes: DataFrame, genes: DataFrame, key: str, seq: str = "seq", rotation: int = 0) -> DataFrame:
    """key, place, gene, excess, x, y, skew: ``gene_skews`` cumulated by genes' middles and projected."""
    steps = gene_skews(genomes, genes, key, seq, rotation)
    moved = steps.select(key, "place", "gene", F.col("excess").alias("de"), F.coalesce("x", F.lit(0)).alias("dx"), F.coalesce("y", F.lit(0)).alias("dy"))
    walk = running(moved, [key], ["place", "gene"], {"x": F.col("dx"), "y": F.col("dy"), "excess": F.col("de")})
    return projected_walk(walk, [key], "place", ["gene", "excess"])


def rearranged(cds: DataFrame, keys: list[str], order: str, strand: str, seq: str = "seq") -> DataFrame:
    """keys, order, strand, place, gc_skew, at_skew: skews at third positions (0 where undefined), the coding sequences
    of the forward strand first."""
    third = S.every_third(F.col(seq), 3)
    n = lambda c: S.times(F.col("__third"), c).cast("double")
    skew = lambda p, q: F.coalesce(F.try_divide(n(p) - n(q), n(p) + n(q)), F.lit(0.0))
    rows = cds.withColumn("__third", third).select(*keys, order, strand, (F.col(strand) != "forward").alias("__back"), skew("g", "c").alias("gc_skew"), skew("a", "t").alias("at_skew"))
    return running(rows, keys, ["__back", order], {"place": F.lit(1)}).select(*keys, order, strand, "place", "gc_skew", "at_skew")


def cell_sums(points: DataFrame, keys: list[str], x: str, y: str, grid: int = 100) -> DataFrame:
    """keys, cell, lo, hi and the sums n, u, v, uu, uv, vv of u = x - lo and v = y over the cells of an even grid from a key's
    smallest x (lo) to its largest (hi); a point on a border belongs to the cell after it. At most grid rows a key, whatever its points."""
    span = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(span, keys).withColumns({"u": F.col(x).cast("double") - F.col("lo"), "v": F.col(y).cast("double")})
    cell = F.least(F.coalesce(F.floor(F.try_divide(F.col("u") * grid, F.col("hi") - F.col("lo"))), F.lit(0)), F.lit(grid - 1)).cast("int")
    sums = {"n": F.count("*").cast("double")} | {a: F.sum(a) for a in "uv"} | {a + b: F.sum(F.col(a) * F.col(b)) for a, b in ("uu", "uv", "vv")}
    return rows.groupBy(*keys, cell.alias("cell"), "lo", "hi").agg(*[e.alias(k) for k, e in sums.items()])


def breakpoint(points: DataFrame, keys: list[str], x: str, y: str, grid: int = 100) -> DataFrame:
    """keys, at, slope_left, slope_right, rss: the break of a continuous line of two pieces that fits best, among
    grid places. For a break b the line is intercept + left * x + change * max(x - b, 0); each place's fit is closed-form from sums over all
    points and over those beyond it, which are running sums over at most grid cells."""
    cells = cell_sums(points, keys, x, y, grid)
    every, names = Window.partitionBy(*keys), ("n", "u", "v", "uu", "uv", "vv")
    # the first border at or before a cell lies between it and the last cell that has points
    beyond = every.orderBy(F.desc("cell"))
    c = cells.withColumns({f"s_{k}": F.sum(k).over(every) for k in names} | {f"b_{k}": F.sum(k).over(beyond) for k in names} | {"before": F.coalesce(F.lag("cell").over(every.orderBy("cell")), F.lit(0))})
    c = c.withColumn("__border", F.explode(F.sequence(F.col("before") + 1, F.greatest("cell", F.col("before") + 1)))).where("__border <= cell")
    at = (F.col("hi") - F.col("lo")) * F.col("__border") / grid
    b = lambda k: F.col("b_" + k)
    c = c.withColumn("at", at).withColumns({"s_z": b("u") - F.col("at") * b("n"), "s_zz": b("uu") - 2 * F.col("at") * b("u") + F.col("at") * F.col("at") * b("n"), "s_uz": b("uu") - F.col("at") * b("u"), "s_zv": b("uv") - F.col("at") * b("v")})
    dev = lambda p, q: F.col("s_" + p + q) - F.col("s_" + p) * F.col("s_" + q) / F.col("s_n")
    c = c.select(*keys, "lo", "at", *[dev(*pq).alias("c_" + pq) for pq in ("uu", "zz", "vv", "uz", "uv", "zv")])
    det = F.col("c_uu") * F.col("c_zz") - F.col("c_uz") * F.col("c_uz")
    left = F.try_divide(F.col("c_uv") * F.col("c_zz") - F.col("c_zv") * F.col("c_uz"), det)
    change = F.try_divide(F.col("c_zv") * F.col("c_uu") - F.col("c_uv") * F.col("c_uz"), det)
    fit = c.where(det > 1e-9).select(*keys, (F.col("lo") + F.col("at")).alias("b"), left.alias("left"), change.alias("change"), (F.col("c_vv") - left * F.col("c_uv") - change * F.col("c_zv")).alias("rss"))
    return fit.groupBy(*keys).agg(F.min(F.struct("rss", "b", "left", "change")).alias("f")).select(*keys, F.col("f.b").alias("at"), F.col("f.left").alias("slope_left"), (F.col("f.left") + F.col("f.change")).alias("slope_right"), F.col("f.rss").alias("rss"))


def breakpoints(points: DataFrame, keys: list[str], x: str, y: str, breaks: int, grid: int = 100) -> DataFrame:
    """keys, breaks, slopes, rss: the cuts of x into breaks + 1 stretches, each with a line of its own, whose squared residuals are least among all
    cuts at grid places (dynamic programming over sums by cell), and the stretches' slopes. A stretch has three points at least;
    a key without so many gets null."""
    names = ["n", "u", "v", "uu", "uv", "vv"]
    cells = cell_sums(points, keys, x, y, grid).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("cell", *names))).alias("cells"))

    @F.pandas_udf("struct<cuts:array<int>,slopes:array<double>,rss:double>")
    def best(rows: pd.Series) -> pd.DataFrame:
        out = []
        for cells in rows:
            sums = np.zeros((grid + 1, 6))
            for c in cells:
                sums[c["cell"] + 1] += [c[k] for k in names]
            sums = np.cumsum(sums, 0)

            def line(a: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Squared residuals and slopes of stretches of cells from a up to each of b."""
                n, u, v, uu, uv, vv = (sums[b] - sums[a]).T
                with np.errstate(divide="ignore", invalid="ignore"):
                    cu, cuv, cv = uu - u * u / n, uv - u * v / n, vv - v * v / n
                    slope = np.where(cu > 1e-12 * np.maximum(uu, 1e-300), cuv / cu, 0)
                return np.where(n >= 3, np.maximum(cv - slope * cuv, 0), np.inf), slope

            rss = np.full((grid + 1, grid + 1), np.inf)
            for a in range(grid):
                rss[a, a + 1 :] = line(a, np.arange(a + 1, grid + 1))[0]
            total, came = rss[0].copy(), []
            for _ in range(breaks):
                ways = total[:, None] + rss  # the last stretch begins at the row's cell
                came.append(ways.argmin(0))
                total = ways.min(0)
            if not np.isfinite(total[grid]):
                out.append((None, None, None))
                continue
            cuts = [grid]
            for step in reversed(came):
                cuts.append(int(step[cuts[-1]]))
            cuts = [0, *reversed(cuts)]
            out.append((cuts[1:-1], [float(line(a, np.array([b]))[1][0]) for a, b in zip(cuts, cuts[1:])], float(total[grid])))
        return pd.DataFrame(out, columns=["cuts", "slopes", "rss"])

    found = cells.withColumn("f", best("cells"))
    return found.select(*keys, F.transform("f.cuts", lambda c: F.col("lo") + (F.col("hi") - F.col("lo")) * c / grid).alias("breaks"), F.col("f.slopes").alias("slopes"), F.col("f.rss").alias("rss"))


def islands(df: DataFrame, keys: list[str], order: list[str], inside: Column, value: Column) -> DataFrame:
    """keys, island, first, last, n, top, area: maximal runs of rows for which inside holds, in order. first and last
    are places in the key's order; area is by the trapezoid rule."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, *order, F.coalesce(inside, F.lit(False)).alias("in_"), value.cast("double").alias("v_"), F.row_number().over(w).alias("at_"))
    d = d.withColumn("grp_", F.sum((~F.col("in_")).cast("int")).over(w)).where("in_").withColumn("next_", F.lead("v_").over(Window.partitionBy(*keys, "grp_").orderBy("at_")))
    out = d.groupBy(*keys, "grp_").agg(F.min("at_").alias("first"), F.max("at_").alias("last"), F.count("*").alias("n"), F.max("v_").alias("top"), F.coalesce(F.sum((F.col("v_") + F.col("next_")) / 2), F.lit(0.0)).alias("area"))
    return out.withColumn("island", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).select(*keys, "island", "first", "last", "n", "top", "area")


def mark_tests(df: DataFrame, keys: list[str], order: list[str], mark: Column) -> DataFrame:
    """Five statistics of where marked rows lie in each key's order, with their standardised values: rank sum (sr),
    rank variance (vr), clustering about the median (cc), number of runs (ns), and gaps (gm)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    every = Window.partitionBy(*keys)
    d = df.select(*keys, *order, F.coalesce(mark, F.lit(False)).alias("is_m")).withColumns({"r": F.row_number().over(w), "change": (F.col("is_m") != F.lag("is_m").over(w)).cast("int")})
    d = d.withColumns({"all_n": F.count("*").over(every).cast("double"), "all_m": F.sum(F.col("is_m").cast("int")).over(every).cast("double")})
    marks = Window.partitionBy(*keys, "is_m").orderBy("r")
    d = d.withColumns({"k": F.row_number().over(marks), "gap": F.when(F.col("is_m"), F.col("r") - F.coalesce(F.lag("r").over(marks), F.lit(0)) - 1)})
    N, M, r, m = F.col("all_n"), F.col("all_m"), F.col("r"), F.col("is_m")
    mid = (F.col("k") == F.floor((M + 1) / 2)) | (F.col("k") == F.floor((M + 2) / 2))
    d = d.withColumn("median", F.avg(F.when(m & mid, r)).over(every))
    x_gm = (N - M) / (M + 1)
    total = lambda e: F.sum(F.when(m, e).otherwise(0.0))
    a = d.groupBy(*keys).agg(
        F.first("all_n").alias("all_n"), F.first("all_m").alias("all_m"), total(r.cast("double")).alias("sr"), total(F.pow(r - (N + 1) / 2, 2.0)).alias("vr"), total(F.abs(r - F.col("median"))).alias("cc"),
        (1 + F.sum(F.coalesce("change", F.lit(0)))).cast("double").alias("ns"), total(F.pow(F.col("gap") - x_gm, 2.0)).alias("gaps"), F.max(F.when(m, r)).alias("last"),
    )
    gm = F.try_divide(F.col("gaps") + F.pow(N - F.coalesce("last", F.lit(0)) - x_gm, 2.0), M)
    a = a.withColumn("gm", gm)
    floor = lambda e: F.floor(e).cast("double")
    two = 2 * M * (N - M)
    moments = {
        "sr": (M * (N + 1) / 2, M * (N + 1) * (N - M) / 12),
        "vr": (M * (N + 1) * (N - 1) / 12, M * (N - M) * (N + 1) * (N + 2) * (N - 2) / 180),
        "cc": ((N + 1) * floor(M / 2) * floor((M + 1) / 2) / (M + 1), F.when(M % 2 == 1, (M - 1) * (M + 3) * (N + 1) * (N - M) / (48 * (M + 2))).otherwise(M * (N + 1) * (N - M) * (M * M + 2 * M + 4) / (48 * (M + 1) * (M + 1)))),
        "ns": (two / N + 1, F.try_divide(two * (two - N), N * N * (N - 1))),
        "gm": ((N + 1) * (N - M) / ((M + 1) * (M + 2)), F.try_divide(4 * (N - M - 1) * (N + 1) * (N + 2) * (N - M), M * (M + 2) * (M + 2) * (M + 3) * (M + 4))),
    }
    z = {f"z_{k}": F.try_divide(F.col(k) - e, F.when(v > 0, F.sqrt(v))) for k, (e, v) in moments.items()}
    return a.withColumns(z).select(*keys, N.cast("bigint").alias("n"), M.cast("bigint").alias("m"), *moments, *z)


def window_codons(df: DataFrame, keys: list[str], size: int = 90, shift: int = 30, seq: str = "seq") -> DataFrame:
    """keys, frame, start, codon, n: codon counts in windows of size, moved by shift, in the three frames of the
    strand given. Windows that would pass the end are left out. Steps between windows are counted once and added up; nothing is shuffled."""
    from helixspark.operators.recstat import letters, window_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                codes = letters(text, "F") if text and len(text) >= size else ()
                for frame in range(3) if len(codes) else ():
                    for first, counts in window_chunks(codes, frame, size, shift):
                        whole = counts[: max(0, (len(codes) - size - frame) // shift + 1 - first)]
                        at, codon = np.nonzero(whole)
                        own = [b.column(i).take(pa.array(np.full(len(at), row))) for i in range(len(keys))]
                        yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), frame, "i4")), pa.array((frame + 1 + (first + at) * shift).astype("i4")), pa.array(codon.astype("i4")), pa.array(whole[at, codon].astype("i8"))], names=[*keys, "frame", "start", "codon", "n"])

    source = df.select(*keys, seq)
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    rows = source.mapInArrow(run, f"{kinds}, frame int, start int, codon int, n bigint")
    words = F.array(*[F.lit(w) for w in K.words(3)])
    out = rows.select(*keys, "frame", "start", F.get(words, F.col("codon")).alias("codon"), "n")
    return out.groupBy(*keys, "frame", "start", "codon").agg(F.sum("n").alias("n"))


def stop_segments(df: DataFrame, keys: list[str], stops: tuple[str, ...] = ("taa", "tag", "tga"), seq: str = "seq") -> DataFrame:
    """keys, frame, first, last: stretches of codons between stops (and the ends), in codon numbers from 1."""
    codons = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("frame"), S.splitseq(F.col(seq), k).alias("codons")) for k in range(3)])).alias("f"))
    cuts = F.concat(F.array(F.lit(0)), F.filter(F.transform("f.codons", lambda c, i: F.when(c.isin(*stops), i + 1)), lambda p: p.isNotNull()), F.array(F.size("f.codons") + 1))
    d = codons.where(F.size("f.codons") > 0).select(*keys, F.col("f.frame").alias("frame"), cuts.alias("cuts"))
    seg = F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts") - 1), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return d.select(*keys, "frame", F.explode(seg).alias("g")).where("g.first <= g.last").select(*keys, "frame", "g.first", "g.last")


def welch(groups: DataFrame, keys: list[str], a: str, b: str, group: str, value: str) -> DataFrame:
    """keys, t, df of Welch's test between two values of group."""
    stats = lambda g: [f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}_{g}") for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    s = groups.groupBy(*keys).agg(*stats(a), *stats(b))
    va, vb = F.try_divide(F.col(f"var_{a}"), F.col(f"n_{a}")), F.try_divide(F.col(f"var_{b}"), F.col(f"n_{b}"))
    df = F.try_divide(F.pow(va + vb, 2.0), F.try_divide(va * va, F.col(f"n_{a}") - 1) + F.try_divide(vb * vb, F.col(f"n_{b}") - 1))
    return s.select(*keys, F.try_divide(F.col(f"mean_{a}") - F.col(f"mean_{b}"), F.sqrt(va + vb)).alias("t"), df.alias("df"))


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, h, df: the Kruskal-Wallis statistic with correction for ties."""
    every, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    d = df.where(F.col(value).isNotNull()).withColumns({"n": F.count("*").over(every).cast("double"), "t": F.count("*").over(ties).cast("double")})
    d = d.withColumn("r", F.rank().over(w) + (F.col("t") - 1) / 2)
    tied = d.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    g = d.groupBy(*keys, group).agg((F.pow(F.sum("r"), 2.0) / F.count("*")).alias("part")).groupBy(*keys).agg(F.sum("part").alias("parts"), F.count("*").alias("groups"))
    n = F.col("n")
    h = F.try_divide(12 * F.col("parts"), n * (n + 1)) - 3 * (n + 1)
    return g.join(tied, keys).select(*keys, F.try_divide(h, 1 - F.try_divide(F.col("ties"), n * n * n - n)).alias("h"), (F.col("groups") - 1).cast("bigint").alias("df"))
