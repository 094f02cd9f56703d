"""Whitening of embeddings by their leading principal components, found by matrix-free block subspace iteration.

A pass of Spark multiplies the covariance with a block of directions, as X'(XQ) over centred rows, without ever forming
the covariance: each task sums its rows' share, the shares are added by dimension, and only a matrix of dimensions x
block width reaches the driver. There QR keeps the directions orthonormal and a Rayleigh-Ritz step over all directions so
far (their products are known, earlier blocks are kept) gives estimates of the eigenpairs and their residuals; the next block is what the
residuals add. The passes end once the residuals certify all k components, or once the directions span the whole
space, where the Rayleigh-Ritz step is exact. Beyond WIDEST directions the best estimates are kept and the rest goes.

Entries c become whole numbers x = floor(SCALE * c) + SHIFT, so sums, means and deviations are exact whatever the order of rows.

Defined results: rows whose vector is null, or holds a null or non-finite entry or one whose x is beyond 62 bits, take no part. Neither do
vectors of another length than most (ties: the shorter length), nor empty ones. Repeated rows count as often as they come. No rows, no
result. A component whose eigenvalue is no more than the residuals' tolerance has no whitened value (null) and stays out of identity_error;
a single row or equal rows have only such. Equal eigenvalues: any orthonormal basis of their space, one for all rows. A deviation beyond 38
digits is null. Other columns do not take part.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Residuals, as a share of the largest eigenvalue, that certify a component; directions kept at most; passes at most.
TOLERANCE, WIDEST, MOST_PASSES = 1e-13, 512, 2000
LIMIT = 2.0**62


@dataclass
class Whitening:
    """n rows' sums by dimension, unit eigenvectors (dimensions x k) by falling eigenvalue, and how they were certified."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    passes: int
    trace: float = 0.0
    identity_error: float | None = None
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def centred(self, x: np.ndarray) -> np.ndarray:
        base = [s // self.n for s in self.sums]
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, base)])
        return (x - np.array(base, np.int64)) - rest

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows x kept components."""
        return centred @ (self.vectors[:, self.kept] / np.sqrt(self.values[self.kept]))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Of each row the exact sum over dimensions of (n*x - S)^2."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        near, rest = x - base, [s - self.n * int(m) for s, m in zip(self.sums, base)]
        most = float(np.abs(near).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) < LIMIT:
            d = self.n * near - np.array(rest, np.int64)
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        wide = self.n * near.astype(object) - np.array(rest, object)
        return pa.array([decimal.Decimal(int(v)) if v < 10**38 else None for v in (wide * wide).sum(1)], pa.decimal128(38, 0))


def rows_of(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, x) of a batch's vectors that take part, by length."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        held = flat.reshape(-1, size) if len(rows) * size == len(flat) else flat[(ends[rows] - size)[:, None] + np.arange(size)]
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(SCALE * held) + SHIFT
            good = (np.isfinite(held) & (np.abs(x) < LIMIT)).all(1)
        if good.any():
            yield size, rows[good], np.floor(SCALE * held[good]).astype(np.int64) + SHIFT


def matrices(vectors: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, rows, x in rows_of(vectors):
        if n == size:
            yield rows, x


def totals(vectors: DataFrame) -> tuple[int, list[int]] | None:
    """Number of rows that take part and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for size, _, x in rows_of(b.column(0)):
                exact = float(np.abs(x).max()) * len(x) < LIMIT
                n, s = found.get(size, (0, np.zeros(size, object)))
                found[size] = n + len(x), s + (x.sum(0) if exact else x.astype(object).sum(0)).astype(object)
        for size, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([decimal.Decimal(int(v)) for v in s], pa.decimal128(38, 0))],
                names=["size", "dim", "n", "s"],
            )

    sums = vectors.mapInArrow(run, "size int, dim int, n bigint, s decimal(38,0)").groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = sums.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("sums")).orderBy(F.desc("n"), "size").limit(1).collect()
    return (best[0]["n"], [int(r["s"]) for r in best[0]["sums"]]) if best else None


def summed(vectors: DataFrame, share: Callable[[np.ndarray], np.ndarray], size: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of share(x), a matrix: one copy of it a task, added row by row of the matrix on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for _, x in matrices(b.column(0), size):
                total += share(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), shape[1]).cast(pa.list_(pa.float64()))], names=["i", "y"])

    parts = vectors.mapInArrow(run, "i int, y array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(shape[1])]).alias("y"))
    out = np.zeros(shape)
    for r in parts.collect():
        out[r["i"]] = r["y"]
    return out


def subspace(product: Callable[[np.ndarray], np.ndarray], size: int, k: int, block: int, tolerance: float = TOLERANCE, widest: int = WIDEST, seed: int = 11):
    """Leading eigenpairs of a symmetric matrix that is known by its product with a block: (values, vectors, residuals, passes)."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(block, size))))[0]
    basis = images = np.zeros((size, 0))
    for passes in range(1, MOST_PASSES + 1):
        y = product(q)
        basis, images = np.hstack([basis, q]), np.hstack([images, y])
        h = basis.T @ images
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        ritz, moved = basis @ u, images @ u
        wrong = moved - ritz * values
        residuals = np.linalg.norm(wrong[:, :k], axis=0)
        if basis.shape[1] == size or (residuals <= tolerance * abs(values[0])).all():
            return values[:k], ritz[:, :k], residuals, passes
        if basis.shape[1] + block > max(widest, 3 * block):
            basis, images = ritz[:, : 2 * block], moved[:, : 2 * block]
        # What the residuals of the leading estimates add; twice, as rounding leaves a part of the basis in them.
        new = wrong[:, : min(block, size - basis.shape[1])]
        new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new, r = np.linalg.qr(new)
        weak = np.abs(np.diag(r)) < 0.5  # directions that the others already have: any new ones in their place
        if weak.any():
            new[:, weak] = np.random.default_rng(seed + passes).standard_normal((size, int(weak.sum())))
            for _ in range(2):
                new[:, weak] -= basis @ (basis.T @ new[:, weak])
                new = np.linalg.qr(np.hstack([new[:, ~weak], new[:, weak]]))[0]
                weak = np.arange(new.shape[1]) >= new.shape[1] - int(weak.sum())
        q = new
    raise RuntimeError(f"residuals {residuals} after {passes} passes do not certify the components")


def fit(vectors: DataFrame, k: int = 8, block: int | None = None, tolerance: float = TOLERANCE) -> Whitening | None:
    """The whitening of a table of one column, the vectors; None if no row takes part. block: directions in a pass (default 2k)."""
    found = totals(vectors)
    if found is None:
        return None
    (n, sums), size = found, len(found[1])
    model = Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), np.zeros(0), 0)

    def product(q: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return c.T @ (c @ q)

        return summed(vectors, share, size, q.shape) / n

    values, directions, residuals, passes = subspace(product, size, min(k, size), block or 2 * k, tolerance)
    model = Whitening(n, sums, directions, values, residuals, passes, kept=values > max(tolerance, 1e-14 * size) * max(abs(values[0]), 1e-300))
    wide = int(model.kept.sum())

    def checks(x: np.ndarray) -> np.ndarray:
        c = model.centred(x)
        w = model.whitened(c)
        out = np.zeros((wide + 1, wide + 1))
        out[:wide, :wide], out[wide, :wide], out[wide, wide] = w.T @ w, w.sum(0), (c * c).sum()
        return out

    sums_of = summed(vectors, checks, size, (wide + 1, wide + 1)) / n
    model.trace = float(sums_of[wide, wide])
    mean = sums_of[wide, :wide]
    model.identity_error = float(np.abs(sums_of[:wide, :wide] - np.outer(mean, mean) - np.eye(wide)).max()) if wide else None
    return model


def whiten(df: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The id of each row that takes part, its deviation (decimal) and its whitened values (array<double>, one for each component)."""
    size, wide = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in matrices(b.column(1), size):
                w = np.full((len(x), wide), np.nan)
                w[:, model.kept] = model.whitened(model.centred(x))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), from_pandas=True), wide).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), model.deviations(x), lists], names=["id", "deviation", "whitened"])

    own = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_column)


def whitened_rows(df: DataFrame, k: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Fit on all of df and whiten it: one row for each vector and component."""
    model = fit(df.select(F.col(vector_column).cast("array<double>").alias("v")), k)
    if model is None:  # no row takes part
        model = Whitening(1, [0], np.zeros((1, 0)), np.zeros(0), np.zeros(0), 0)
    explained = [float(v / model.trace) if model.trace else 0.0 for v in model.values]
    rows = whiten(df, model, id_column, vector_column).select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_column,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(v) for v in explained or [0.0]]), F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
