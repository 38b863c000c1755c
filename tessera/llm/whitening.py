"""Whitening of embeddings: an exact fit list, its covariance, QDWH divide and conquer, and the projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, stage

EPS = float(np.finfo(np.float64).eps)
#: Codes beyond this are as little use as values that are not finite.
LARGEST = float(2**62)
WIDE = pa.decimal128(38, 0)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based, dynamically weighted Halley steps (QDWH)."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    try:
        least = 1.0 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        least = EPS
    low = min(1.0, max(least, EPS / n))  # a lower bound of the singular values
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if moved < 10 * EPS ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of eigenvalues above and below ``shift``; None where it doesn't part them."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(3):  # the range of the projector, and what is orthogonal to it
        basis = np.linalg.qr(projector @ basis)[0]
    whole = np.linalg.qr(basis, mode="complete")[0]
    above, below = whole[:, :k], whole[:, k:]
    return (above, below) if np.linalg.norm(below.T @ a @ above) <= 100 * n * EPS * size else None


def _divided(a: np.ndarray, size: float) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix, subspace by subspace."""
    n = len(a)
    if n == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= n * EPS * size:
        return np.eye(n)
    middle, spread = float(np.trace(a)) / n, float(np.linalg.norm(a - np.trace(a) / n * np.eye(n))) / np.sqrt(n)
    # the mean lies strictly within the spectrum; a shift on an eigenvalue parts nothing and another is taken
    for shift in (float(np.median(np.diag(a))), *(middle + t * spread for t in (0.0, 0.01, -0.01, 0.07, -0.07, 0.23, -0.23, 0.51, -0.51))):
        parts = _split(a, shift, size)
        if parts is not None:
            break
    else:
        return np.eye(n)  # eigenvalues that differ by rounding alone: any basis is one
    out = []
    for basis in parts:
        inner = basis.T @ a @ basis
        out.append(basis @ _divided((inner + inner.T) / 2, size))
    return np.hstack(out)


def principal_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix by spectral divide and conquer.

    Two Newton corrections at the end take the vectors from the subspaces' accuracy to that of the matrix.
    """
    a = (a + a.T) / 2
    size = float(np.linalg.norm(a))
    v = _divided(a, size) if size else np.eye(len(a))
    for _ in range(2):
        lack = np.eye(len(a)) - v.T @ v
        s = v.T @ a @ v
        values = np.diag(s) / (1 - np.diag(lack))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 2 * (np.linalg.norm(s - np.diag(np.diag(s))) + size * np.linalg.norm(lack))
        v = v + v @ np.where(apart, (s + values[None, :] * lack) / np.where(apart, gap, 1.0), lack / 2)
    v = v @ (3 * np.eye(len(a)) - v.T @ v) / 2  # corrections of close vectors are not quite orthogonal
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


@dataclass
class Whitening:
    """A fit: ``n`` distinct codes with sums ``sums``, components as columns with their ``variances``, and their shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: whole parts are taken off as integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2, exact."""
        whole, rest = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        away = max(int(np.abs(x.astype(np.float64) - np.array(whole, np.float64)).max(initial=0)) + 2, 1)
        if (self.n * away) ** 2 * len(whole) < 2**63:
            u = self.n * (x - np.array(whole, np.int64)) - np.array(rest, np.int64)
            return pa.array((u * u).sum(1), pa.int64()).cast(WIDE)
        u = self.n * (x.astype(object) - np.array(whole, object)) - np.array(rest, object)
        return pa.array([Decimal(int(s)) if s < 10**38 else None for s in (u * u).sum(1)], WIDE)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component, NaN where the component has no variance."""
        scale = np.where(self.variances > 0, np.sqrt(np.where(self.variances > 0, self.variances, 1.0)), np.nan)
        return self.centred(x) @ self.components / scale


def codes(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a null vector or one with an entry that is null or not finite.

    An entry too large for a long counts as not finite.
    """
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * 64 < LARGEST), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(64 * c.cast("double")) + 1000000))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _added(fit: DataFrame, width: int, made, rows: int, columns: int) -> np.ndarray:  # noqa: ANN001
    """The sum over the fit list of ``made`` (codes to a matrix rows x columns), added up in tasks, then by entry."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in parts:
            total += made(_matrix(batch.column(0), width))
        for i in range(rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(columns, i)), pa.array(np.arange(columns)), pa.array(total[i])], ["i", "j", "v"])

    out = np.zeros((rows, columns))
    for r in map_arrow(fit, batches, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in parts:
            x = _matrix(batch.column(0), width)
            high, low = x >> 32, x & (2**32 - 1)  # halves, so that no sum of a batch overflows
            total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, high.sum(0), low.sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(width)), pa.array([n] * width), pa.array([Decimal(t) for t in total], WIDE)], ["j", "n", "s"])

    found = map_arrow(fit, batches, "j bigint, n bigint, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("j").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def fit_whitening(vectors: DataFrame, column: str = "embedding", most: int = 16) -> Whitening | None:
    """Components of the covariance of the distinct codes of ``column``; None where no row has a code.

    Distinct codes are found by a grouping with partial aggregation, so copies cost one row a task, and written
    once. Their sums are exact; the covariance is of codes centred before they are multiplied, added up in tasks and then by
    entry; only a matrix of the vector's width comes to the driver, which splits its spectrum. A component whose variance is rounding
    alone has no whitened values. The error is measured over the fit list by whitening it. Vectors of
    another width than that of most distinct ones (the greater of equally frequent ones) are left out.
    """
    fit = stage(vectors.select(codes(F.col(column)).alias("x")).filter("x IS NOT NULL").distinct())
    widths = fit.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).first()
    if widths is None or widths["w"] == 0:
        return None
    width = widths["w"]
    fit = fit.filter(F.size("x") == width)
    n, sums = _sums(fit, width)
    held = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), [], None)

    def products(x: np.ndarray) -> np.ndarray:
        z = held.centred(x)
        return z.T @ z

    covariance = _added(fit, width, products, width, width) / n
    values, vectors_ = principal_components(covariance)
    k = min(most, width)
    trace = float(np.trace(covariance))
    variances = np.where(values[:k] > width * EPS * max(trace, 0.0), values[:k], 0.0)
    out = Whitening(n, sums, vectors_[:, :k].copy(), variances, [float(e) / trace if trace > 0 else None for e in values[:k]], None)

    def whitened(x: np.ndarray) -> np.ndarray:
        y = np.nan_to_num(out.whitened(x))
        return y.T @ y

    some = variances > 0
    if some.any():
        error = np.abs(_added(fit, width, whitened, k, k) / n - np.eye(k))
        out = Whitening(n, sums, out.components, variances, out.explained, float(error[np.ix_(some, some)].max()))
    return out


def whiten(vectors: DataFrame, fit: Whitening | None, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of each row with a code of the fit's width.

    One pass without a shuffle; the fit, of the vector's width times its components, is sent with the tasks. Repeated
    rows and ids give a row each, null ids stay null. ``whitened`` is null for a component without variance, ``deviation`` where it
    has over 38 digits. No fit (no vector at all) gives no row. Columns other than the two named ones are not read.
    """
    rows = vectors.select(F.col(id_col), codes(F.col(column)).alias("_x"))
    width = 0 if fit is None else len(fit.sums)
    rows = rows.filter(F.lit(fit is not None) & (F.size("_x") == width))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = _matrix(batch.column(1), width)
            y = fit.whitened(x)
            flat = pa.array(y.ravel(), pa.float64(), from_pandas=True)
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), fit.deviations(x), whitened], [batch.schema.names[0], "deviation", "whitened"])

    given = rows.schema[0]
    return map_arrow(rows, batches, f"`{given.name}` {given.dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def whitening_digest(whitened: DataFrame, fit: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    A ``deviation`` too large for a long is null.
    """
    explained = F.array(*[F.lit(e).cast("double") for e in (fit.explained if fit else [])]).cast("array<double>")
    rows = whitened.select("vec_id", F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_k")).alias("explained"), F.lit(fit.identity_error if fit else None).cast("double").alias("identity_error"),
    )
