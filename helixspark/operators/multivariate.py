"""Correspondence analysis of contingency tables with few columns and any number of rows.

Each task adds up its rows' column-by-column products; only the matrix of columns (64 x 64 for codons)
goes to the driver for its eigenvectors, and rows are then projected by an expression. Analyses between and within classes of columns
follow from the same matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Margins:
    """Of a table: total, column shares, and the sums over rows of x_i * x_j / (row sum * total)."""

    total: float
    share: np.ndarray
    cross: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        return np.where(self.share > 0, 1 / np.sqrt(np.where(self.share > 0, self.share, 1)), 0)

    def centred(self) -> np.ndarray:
        """Cross products of what independence does not explain; its trace is the table's inertia."""
        return self.cross * self.scale[:, None] * self.scale - np.outer(np.sqrt(self.share), np.sqrt(self.share))


def shares(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, x (counts as doubles), r (their sum) of the rows that have counts."""
    counts = table.select(key, F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("double") for c in columns]).alias("x"))
    return counts.withColumn("r", F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).where("r > 0")


def margins(counts: DataFrame, k: int) -> Margins | None:
    """Of shares' rows; a task sends k + 1 rows of k numbers, whatever it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, k)
            cross += x.T @ (x / x.sum(1)[:, None])
            sums += x.sum(0)
        rows = np.vstack([cross, sums])
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), k).cast(pa.list_(pa.float64()))], names=["i", "y"])

    parts = counts.select("x").mapInArrow(run, "i int, y array<double>").groupBy("i").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(k)])
    out = np.zeros((k + 1, k))
    for r in parts.collect():  # k + 1 rows
        out[r["i"]] = [r[f"y{j}"] for j in range(k)]
    total = out[k].sum()
    return Margins(float(total), out[k] / total, out[:k] / total) if total > 0 else None


def axes_of(m: np.ndarray, scale: np.ndarray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and what column shares are multiplied with for a row's coordinate; the largest is positive."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-values, kind="stable")[:axes]
    loads = vectors[:, order] * scale[:, None]
    loads *= np.where(loads[np.abs(loads).argmax(0), range(loads.shape[1])] < 0, -1, 1)
    return values[order], loads


def projected(counts: DataFrame, key: str, loads: np.ndarray) -> DataFrame:
    """key, axis_1, ... of shares' rows."""
    axis = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(s)) for s in loads[:, a]]), lambda x, s: x * s), F.lit(0.0), lambda acc, v: acc + v) / F.col("r") for a in range(loads.shape[1])]
    return counts.select(key, *[e.alias(f"axis_{a + 1}") for a, e in enumerate(axis)])


def correspondence(table: DataFrame, key: str, columns: list[str], axes: int = 2) -> tuple[DataFrame, list[float], dict[str, list[float]]]:
    """(key with axis_1 ..., the eigenvalues, each column's scores). Rows and columns without a count get null scores.
    Axes are turned so that the largest column score is positive."""
    counts = shares(table, key, columns)
    m = margins(counts, len(columns))
    if m is None:
        return table.select(key, *[F.lit(None).cast("double").alias(f"axis_{a + 1}") for a in range(axes)]), [], {}
    values, loads = axes_of(m.centred(), m.scale, axes)
    return projected(counts, key, loads), [float(v) for v in values], {c: [float(s) * float(np.sqrt(max(v, 0))) for s, v in zip(loads[i], values)] for i, c in enumerate(columns)}


def class_analysis(table: DataFrame, key: str, columns: list[str], classes: dict[str, str], part: str, axes: int = 2) -> tuple[DataFrame, list[float], dict[str, float]]:
    """Correspondence analysis split by classes of columns, as by codons' amino acids: (key with axis_1 ..., all eigenvalues, the inertias
    total, between and within, which add up).

    between: each column's share in a row is replaced by its class's share, spread as over the whole table: differences in the use
    of classes. within: what is left when that is taken away: differences in the use of columns inside their class. Both are linear in a
    row's shares, so they follow from the one matrix of sums, and rows are projected by an expression."""
    if part not in ("between", "within"):
        raise ValueError("part must be between or within")
    counts = shares(table, key, columns)
    m = margins(counts, len(columns))
    if m is None:
        return table.select(key, *[F.lit(None).cast("double").alias(f"axis_{a + 1}") for a in range(axes)]), [], {"total": 0.0, "between": 0.0, "within": 0.0}
    groups = sorted(set(classes[c] for c in columns))
    of = np.array([[classes[c] == g for g in groups] for c in columns], float)
    weight = of.T @ m.share
    spread = of * (m.share[:, None] / np.where(of @ weight > 0, of @ weight, 1)[:, None])  # columns x classes
    average = of @ spread.T  # a row's shares times this are its classes' shares, spread
    trivial = np.outer(np.sqrt(m.share), np.sqrt(m.share))
    between = (average.T @ m.cross @ average) * m.scale[:, None] * m.scale - trivial
    rest = np.eye(len(columns)) - average
    within = (rest.T @ m.cross @ rest) * m.scale[:, None] * m.scale
    inertia = {"total": float(np.trace(m.centred())), "between": float(np.trace(between)), "within": float(np.trace(within))}
    values, loads = axes_of(between if part == "between" else within, m.scale, len(columns))
    rows = projected(counts, key, ((average if part == "between" else rest) @ loads)[:, :axes])
    return rows, [float(v) for v in values], inertia


def relative_to_class(table: DataFrame, key: str, columns: list[str], classes: dict[str, str]) -> DataFrame:
    """The table with each column scaled to what independence within its class predicts from the key's class total:
    observed / expected counts of synonymous codons, free of amino-acid usage."""
    totals = table.agg(*[F.sum(F.col(f"`{c}`")).cast("double").alias(c) for c in columns]).first()
    of_class = {g: [c for c in columns if classes[c] == g] for g in set(classes[c] for c in columns)}
    out = []
    for c in columns:
        group = of_class[classes[c]]
        share = (totals[c] or 0.0) / max(sum(totals[d] or 0.0 for d in group), 1e-300)
        expected = sum((F.col(f"`{d}`") for d in group), F.lit(0)) * share
        out.append(F.try_divide(F.col(f"`{c}`").cast("double"), expected).alias(c))
    return table.select(key, *out)
