"""Allele profiles, fluorescence traces and growth curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.functions.sequence import shared_alleles


def matching_alleles(database: DataFrame, target: list[int], profile: str = "profile") -> DataFrame:
    """database with ``common``, the number of alleles (bits) that a profile shares with the target."""
    return database.withColumn("common", shared_alleles(F.col(profile), F.array(*[F.lit(x) for x in target])).cast("bigint"))


def hermite(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of a monotone cubic through points (Fritsch and Carlson) and the secants."""
    d = np.diff(y) / np.diff(x)
    m = np.concatenate([[d[0]], (d[1:] + d[:-1]) / 2, [d[-1]]])
    for k in range(len(d)):
        if d[k] == 0:
            m[k] = m[k + 1] = 0
        else:
            a, b = m[k] / d[k], m[k + 1] / d[k]
            if a < 0 or b < 0 or a * a + b * b > 9:
                t = 3 / np.sqrt(a * a + b * b) if a * a + b * b > 9 else 1
                m[k], m[k + 1] = t * max(a, 0) * d[k], t * max(b, 0) * d[k]
    return m, d


def peak_of(y: np.ndarray) -> tuple[float, float, float]:
    """(place, height, area) of the spline through a peak's values; places count from 0."""
    if len(y) <= 2:
        return float("nan"), float("nan"), float("nan")
    x = np.arange(len(y), dtype="f8")
    m, _ = hermite(x, y)
    t = np.linspace(0, 1, 101)[:, None]
    h = (2 * t**3 - 3 * t**2 + 1) * y[:-1] + (t**3 - 2 * t**2 + t) * m[:-1] + (-2 * t**3 + 3 * t**2) * y[1:] + (t**3 - t**2) * m[1:]
    best = np.unravel_index(h.argmax(), h.shape)
    return float(best[1] + t[best[0], 0]), float(h.max()), float(((y[:-1] + y[1:]) / 2 + (m[:-1] - m[1:]) / 12).sum())


def peaks(traces: DataFrame, key: str, order: str, value: str, threshold: float) -> DataFrame:
    """key, peak, first, last, place, height, area of the runs of values at or above threshold. Runs are found by
    windows; only a run's own values, as many as a peak is wide, go to Python."""
    from helixspark.operators.genome import islands

    runs = islands(traces, [key], [order], F.col(value) >= threshold, F.col(value)).select(key, "island", "first", "last")
    from pyspark.sql import Window

    ranked = traces.withColumn("at_", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    values = ranked.join(runs, key).where("at_ between first and last").groupBy(key, "island", "first", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", F.col(value).cast("double").alias("v")))), lambda p: p["v"]).alias("ys"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [peak_of(np.asarray(y, "f8")) for y in b["ys"]]
            out = b.drop(columns="ys")
            out[["place", "height", "area"]] = pd.DataFrame(found, index=out.index, columns=["place", "height", "area"])
            out["place"] += out["first"]
            yield out

    kind = traces.schema[key].dataType.simpleString()
    return values.mapInPandas(fitted, f"{key} {kind}, island int, first int, last int, place double, height double, area double")


def baseline(traces: DataFrame, key: str, value: str, most: float = 1000, bins: int = 512) -> DataFrame:
    """key, baseline: the mode of the values below most, from a Gaussian kernel density on a histogram. The
    histogram is a plain aggregate of at most bins rows a key."""
    below = traces.where(F.col(value) < most)
    span = below.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev(value).alias("sd"), F.count("*").alias("n"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    hist = below.join(span, key).groupBy(key, F.coalesce(place, F.lit(0)).alias("bin"), "lo", "hi", "sd", "n").agg(F.count("*").alias("c"))
    grid = hist.groupBy(key, "lo", "hi", "sd", "n").agg(F.collect_list(F.struct(((F.col("bin") + 0.5) / bins * (F.col("hi") - F.col("lo")) + F.col("lo")).alias("x"), "c")).alias("h"))
    width = 0.9 * F.col("sd") * F.pow("n", -0.2)
    density = lambda x: F.aggregate("h", F.lit(0.0), lambda acc, p: acc + p["c"] * F.exp(-F.pow((p["x"] - x) / F.when(width > 0, width).otherwise(1.0), 2.0) / 2))
    best = F.array_max(F.transform("h", lambda p: F.struct(density(p["x"]).alias("d"), (-p["x"]).alias("x"))))
    return grid.select(key, (-best["x"]).alias("baseline"))


def growth(df: DataFrame, time: str, size: str) -> DataFrame:
    """One row: slope and intercept of ln(size) on time (years), and the doubling time in months."""
    f = df.where(F.col(size) > 0).agg(F.regr_slope(F.ln(F.col(size)), F.col(time)).alias("slope"), F.regr_intercept(F.ln(F.col(size)), F.col(time)).alias("intercept"))
    return f.withColumn("doubling_months", F.try_divide(F.lit(12 * float(np.log(2))), F.col("slope")))


def mixture(df: DataFrame, value: str, parts: int = 2, rounds: int = 30) -> DataFrame:
    """p, mean, sd of a mixture of normal laws, by expectation-maximisation: each round is one aggregate of a few sums."""
    q = [r / (parts + 1) for r in range(1, parts + 1)]
    x = F.col(value).cast("double")
    data = df.where(x.isNotNull()).select(x.alias("x"))
    start = data.agg(F.percentile_approx("x", q).alias("q"), F.stddev("x").alias("sd")).first()
    law = [(1 / parts, m, start.sd or 1.0) for m in (start.q or [0.0] * parts)]
    for _ in range(rounds):
        dens = [F.lit(p / s) * F.exp(-F.pow((F.col("x") - m) / s, 2.0) / 2) for p, m, s in law]
        total = F.greatest(sum(dens, F.lit(0.0)), F.lit(1e-300))
        sums = data.agg(*[e.alias(f"{n}{k}") for k, d in enumerate(dens) for n, e in (("w", F.sum(d / total)), ("x", F.sum(d / total * F.col("x"))), ("xx", F.sum(d / total * F.col("x") * F.col("x"))))], F.count("*").alias("n")).first()
        new = []
        for k in range(parts):
            w = max(sums[f"w{k}"] or 0.0, 1e-9)
            m = (sums[f"x{k}"] or 0.0) / w
            new.append((w / max(sums["n"], 1), m, max(1e-6, (sums[f"xx{k}"] or 0.0) / w - m * m) ** 0.5))
        done = max(abs(a - b) for u, v in zip(law, new) for a, b in zip(u, v)) < 1e-7
        law = new
        if done:
            break
    return df.sparkSession.createDataFrame([(k + 1, *map(float, x)) for k, x in enumerate(law)], "part int, p double, mean double, sd double")


def bell(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """p: area, place and width of a normal curve, or of many (rows)."""
    area, place, width = np.moveaxis(p[..., None], -2, 0)
    return area / (width * np.sqrt(2 * np.pi)) * np.exp(-(((x - place) / width) ** 2) / 2)


def fit_bells(x: np.ndarray, y: np.ndarray, used: np.ndarray, width: float, places: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """Least squares by damped Gauss-Newton steps from the tallest value (or given places), for each row of x and y by itself; only what is used counts.
    A row ends where it no longer moves, can't be improved, or where its curve is too narrow for numbers."""
    y = np.where(used, y, 0.0)
    tallest = np.where(used, y, -np.inf).argmax(1)
    rows = np.arange(len(x))
    p = np.stack([width * np.sqrt(2 * np.pi) * np.maximum(y[rows, tallest], 1e-12), x[rows, tallest] if places is None else places, np.full(len(x), width)], 1)
    rest = lambda p, k: (((y[k] - bell(p, x[k])) * used[k]) ** 2).sum(1)
    damp, best, active = np.full(len(x), 1e-3), rest(p, rows), rows
    for _ in range(rounds):
        if not len(active):
            break
        q, on = p[active], used[active]
        g, u = bell(q, x[active]) * on, (x[active] - q[:, 1:2]) / q[:, 2:]
        j = np.stack([g / q[:, :1], g * u / q[:, 2:], g * (u * u - 1) / q[:, 2:]], 2)
        a, b = j.transpose(0, 2, 1) @ j, ((y[active] - g)[:, None] @ j)[:, 0]
        a = a + damp[active, None, None] * np.eye(3) * (a + 1e-300)
        fine = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1)
        active, q, a, b = active[fine], q[fine], a[fine], b[fine]
        left, size, right = np.linalg.svd(a)
        small = size <= np.finfo(float).eps * 3 * size[:, :1]
        along = np.where(small, 0.0, (b[:, None] @ left)[:, 0] / np.where(small, 1.0, size))
        step = (along[:, None] @ right)[:, 0]
        new = q + step
        rss = np.full(len(active), np.inf)
        whole = (new[:, 2] > 0) & (new[:, 0] != 0)
        rss[whole] = rest(new[whole], active[whole])
        better = rss <= best[active]
        still = np.abs(step).max(1, initial=0) <= 1e-12 * np.abs(q).max(1, initial=0)
        over = np.where(better, still, damp[active] > 1e12)
        moved = active[better]
        p[moved], best[moved] = new[better], rss[better]
        damp[active] = np.where(better, damp[active] / 5, damp[active] * 4)
        active = active[~over]
    return p


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The monotone cubic through points with slopes m (see ``hermite``), at places inside them."""
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    w = x[k + 1] - x[k]
    t = (at - x[k]) / w
    return (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * w * m[k] + (-2 * t**3 + 3 * t**2) * y[k + 1] + (t**3 - t**2) * w * m[k + 1]


def mode_below(y: np.ndarray, most: float) -> float:
    """The most common value below most: of the values in order the shortest half is kept, again and again. A few dozen values, many of them in
    a peak's feet, would pull the mode of a kernel density up."""
    v = np.sort(y[y < most])
    if not len(v):
        return 0.0
    while len(v) > 2:
        half = (len(v) + 1) // 2
        if half == len(v):
            break
        at = int((v[half - 1 :] - v[: len(v) - half + 1]).argmin())
        v = v[at : at + half]
    return float(v.mean())


def stutters_of(sets: list[tuple[np.ndarray, np.ndarray, float]], width: float = 3.5, most: float = 1000.0, reach: float = 6.0) -> list[dict[str, float] | None]:
    """Heights, areas and their ratios of an allele's peak at a place and of the smaller one before it, for each (x, y, place). A normal curve is fitted to the allele,
    another to what lies before its lower end; heights and areas are those of a spline through the data, reach widths around either, on its side of the valley
    between. Without a height or area of the allele's there is no ratio to it (nan)."""
    if not sets:
        return []
    n = max(len(x) for x, _, _ in sets)
    xs, ys, used = np.zeros((len(sets), n)), np.zeros((len(sets), n)), np.zeros((len(sets), n), bool)
    for k, (x, y, _) in enumerate(sets):
        floor = mode_below(y, most)
        xs[k, : len(x)], ys[k, : len(x)], used[k, : len(x)] = x, np.maximum(y, floor) - floor, True
    with np.errstate(all="ignore"):  # rows whose curve becomes too narrow end
        alleles = fit_bells(xs, ys, used, width, np.array([place for _, _, place in sets], float))
        before = used & (xs < np.floor(alleles[:, 1] - 6 * np.abs(alleles[:, 2]))[:, None])
        there = (before.sum(1) >= 4) & (np.where(before, ys, 0.0).max(1) > 0)
        smaller = np.full((len(sets), 3), np.nan)
        smaller[there] = fit_bells(xs[there], ys[there], before[there], width)
        return [_measures(xs[k, on], ys[k, on], smaller[k], alleles[k], reach) if there[k] else None for k, on in enumerate(used)]


def _measures(x: np.ndarray, y: np.ndarray, stutter: np.ndarray, allele: np.ndarray, reach: float) -> dict[str, float]:
    slopes, _ = hermite(x, y)
    # neither reaches beyond the lowest place between the two
    span = np.linspace(*np.clip([stutter[1], allele[1]], x[0], x[-1]), 2001)
    valley = float(span[spline(x, y, span, slopes).argmin()])

    def measured(p: np.ndarray, least: float, greatest: float) -> tuple[float, float, float]:
        lo, hi = max(least, p[1] - reach * abs(p[2])), min(greatest, p[1] + reach * abs(p[2]))
        if hi <= lo:
            return float("nan"), float("nan"), float("nan")
        at = np.linspace(lo, hi, 4001)
        v = spline(x, y, at, slopes)
        return float(at[v.argmax()]), float(v.max()), float(((v[1:] + v[:-1]) / 2).sum() * (at[1] - at[0]))

    (l1, h1, s1), (l2, h2, s2) = measured(stutter, x[0], valley), measured(allele, valley, x[-1])
    ratio = lambda a, b: a / b if b else float("nan")
    return {"rh": ratio(h1, h2), "rs": ratio(s1, s2), "l1": l1, "h1": h1, "s1": s1, "l2": l2, "h2": h2, "s2": s2, "p1": stutter[0], "mu1": stutter[1], "sd1": abs(stutter[2]), "p2": allele[0], "mu2": allele[1], "sd2": abs(allele[2])}


#: Alleles that are fitted at once.
FITTED = 512
STUTTER = ["rh", "rs", "l1", "h1", "s1", "l2", "h2", "s2", "p1", "mu1", "sd1", "p2", "mu2", "sd2"]


def stutters(traces: DataFrame, alleles: DataFrame, keys: list[str], at: str, value: str, before: int = 70, after: int = 20, width: float = 3.5, most: float = 1000.0) -> DataFrame:
    """keys, place and the stutter's measures (see ``stutters_of``) of alleles (keys, place) in traces (keys, at, value; at in whole numbers). Each allele
    meets only the values about it, in a range join; a group is one allele's before + after values. Values that are no finite numbers don't count. No measures where nothing lies before the peak."""
    from helixspark.operators.ordered import range_join

    around = alleles.select(*keys, F.col("place").cast("double").alias("place")).distinct()
    around = around.withColumns({"__low": F.floor(F.col("place") - before).cast("bigint"), "__high": F.floor(F.col("place") + after).cast("bigint")})
    points = traces.select(*keys, F.col(at).cast("bigint").alias("__at"), F.col(value).cast("double").alias("__value")).where(F.abs("__value") < float("inf"))
    met = range_join(points, around, keys, "__at", "__low", "__high", 4 * (before + after))
    # in so many parts: the values are few and the fits long, and Spark would put small parts together
    parts = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = met.repartition(parts, *keys, "place").groupBy(*keys, "place").agg(F.array_sort(F.collect_list(F.struct("__at", "__value"))).alias("xy"))
    sets = sets.select(*keys, "place", F.transform("xy", lambda p: p["__at"].cast("double")).alias("xs"), F.transform("xy", lambda p: p["__value"]).alias("ys"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list[dict[str, float] | None] = [None] * len(b)
            sets = []
            for k, (x, y, place) in enumerate(zip(b["xs"], b["ys"], b["place"])):
                x, once = np.unique(np.asarray(x, float), return_index=True)
                if len(x) > 8:
                    sets.append((k, (x, np.asarray(y, float)[once], place)))
            for lo in range(0, len(sets), FITTED):
                ks, some = zip(*sets[lo : lo + FITTED])
                for k, f in zip(ks, stutters_of(list(some), width, most)):
                    found[k] = f
            out = b.drop(columns=["xs", "ys"])
            for n in STUTTER:
                out[n] = [f[n] if f else None for f in found]
            yield out

    kinds = ", ".join(f"`{k}` {sets.schema[k].dataType.simpleString()}" for k in keys)
    return sets.mapInPandas(fitted, f"{kinds}, place double, " + ", ".join(f"{n} double" for n in STUTTER))
