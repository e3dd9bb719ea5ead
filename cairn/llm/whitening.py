"""Whitening of embeddings: distributed covariance, float32 eigenvectors, and their refinement by matrix products in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored

#: Longest vectors of which a covariance matrix is solved on the driver (512 MB of doubles).
MOST_DIMENSIONS = 8192
#: Largest entry of the integer grid.
MOST = 2.0**61
#: Rows that are multiplied together.
ROWS = 4096


class Whitening(NamedTuple):
    """A fitted whitening: rows of the fit list, sums per dimension, largest eigenvalues (falling), their unit eigenvectors (columns), trace, and the largest deviation of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float


# Refinement --------------------------------------------------------------------------------------


def sub_solve(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """Turns the columns of ``x`` inside each cluster of eigenvalues (neighbours at most ``gap`` apart) to the eigenvectors of the matrix projected on the cluster.

    The cluster's mean is taken off before, so that its small differences are what the small solve sees.
    """
    order = np.argsort(values, kind="stable")
    x, values = x[:, order], values[order]
    edges = np.r_[0, np.flatnonzero(np.diff(values) > gap) + 1, len(values)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo > 1:
            own = x[:, lo:hi]
            own = own @ np.linalg.inv(np.linalg.cholesky((own.T @ own).astype(np.float64))).T.astype(x.dtype)
            small = own.T @ (a @ own) - np.mean(values[lo:hi]) * np.eye(hi - lo, dtype=x.dtype)
            _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
            x[:, lo:hi] = own @ turn.astype(x.dtype)
    return x


def refined(a: np.ndarray, x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of approximate eigenvectors ``x`` of the symmetric ``a`` by matrix products in precision ``kind`` (Ogita and Aishima, 2018): vectors, eigenvalues, the largest correction, and the gap up to which eigenvalues count as one cluster.

    Pairs of eigenvalues too close for the correction are only made orthogonal; ``sub_solve`` turns them.
    """
    a, x = a.astype(kind), x.astype(kind)
    r = np.eye(x.shape[1], dtype=kind) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    # Frobenius norms bound the spectral norms of the method
    delta = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + np.abs(a).sum(0).max() * np.linalg.norm(r.astype(np.float64)))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= delta
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return x + x @ e, values, float(np.abs(e).max()), float(delta)


def eigen(a: np.ndarray, max_steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    The first vectors come from a float32 solve; corrections in double and then in extended precision square the error each time. Where
    a step leaves clusters, these are solved on their own. Vectors of equal eigenvalues are some orthonormal
    basis of their space.
    """
    a = (a + a.T) / 2
    scale = float(np.abs(a).max()) or 1.0
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    for step in range(max_steps):
        kind = np.float64 if step < 2 else np.longdouble
        x, values, change, delta = refined(a, x, kind)
        if step > 2 and change < 1e-17:
            break
        if np.diff(np.sort(values.astype(np.float64)), prepend=-np.inf).min() <= delta:
            x = sub_solve(a.astype(kind), x, values, delta)
    for _ in range(2):  # what close pairs lack in being orthogonal
        x = x @ (3 * np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    values = (x * (a.astype(np.longdouble) @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


# Spark -------------------------------------------------------------------------------------------


def grid(df: DataFrame, *, scale: float = 64.0, offset: int = 1_000_000, vector: str = "embedding") -> DataFrame:
    """``df`` with ``x``, each entry c (as double) as the integer floor(scale * c) + offset; rows with a null vector, or null or non-finite entries, go.

    Entries that give more than 2^61 on either side count as 2^61.
    """
    entry = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    rows = df.where(F.col(vector).isNotNull()).where(~bad)
    return rows.withColumn("x", F.transform(vector, lambda c: F.floor(F.greatest(F.least(entry(c) * scale, F.lit(MOST)), F.lit(-MOST))).cast("long") + F.lit(offset)))


def common_length(rows: DataFrame) -> int | None:
    """The commonest length of ``x``, of several the longest; None without rows."""
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return lengths["d"] if lengths else None


def _gram(fit: DataFrame, d: int, rows_to_z) -> np.ndarray:
    """The sum of z z' over the rows of ``fit``, z being what ``rows_to_z`` makes of a block of x vectors; a matrix per task, added up entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                z = rows_to_z(batch.column(0).slice(at, ROWS).flatten().to_numpy().reshape(-1, d))
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in total], pa.list_(pa.float64())), pa.array(range(len(total)), pa.int32())], names=["values", "line"])

    cells = fit.select("x").mapInArrow(run, "values array<double>, line int").select("line", F.posexplode("values").alias("at", "v"))
    sums = cells.groupBy("line", "at").agg(F.sum("v").alias("v")).toPandas()  # one matrix
    size = int(sums["line"].max()) + 1
    out = np.zeros((size, size))
    out[sums["line"], sums["at"]] = sums["v"]
    return out


def fit(rows: DataFrame, *, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (column x, from ``grid``) by up to ``components`` eigenvectors; None without rows.

    Sums are exact integers. The covariance is centred before it is multiplied, divisor n: a
    d-by-d matrix per task, added up by Spark. The solve runs on the driver on that one matrix, whose
    side is at most ``MOST_DIMENSIONS``. Components whose eigenvalue is nothing but rounding (below d * 1e-15 of the largest) are left out.
    """
    d = common_length(rows)
    if not d:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {MOST_DIMENSIONS} are whitened")
    unique = stored(rows.where(F.size("x") == d).select("x").distinct(), "whitening")
    n = unique.count()
    per = unique.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [0] * d
    for r in per.collect():  # a row per dimension
        sums[r["at"]] = int(r["s"])
    s = np.array(sums, object)
    whole, part = (s // n).astype(np.int64), np.array([(v % n) / n for v in sums])  # the mean, its whole part taken off in integers
    cov = _gram(unique, d, lambda x: (x - whole).astype(np.float64) - part) / n
    values, vectors = eigen(cov)
    some = values > max(d * 1e-15 * values[0], 0.0)
    values, vectors = values[some][:components], vectors[:, some][:, :components]
    error = 0.0
    if len(values):
        turn = vectors / np.sqrt(values)
        white = _gram(unique, d, lambda x: ((x - whole).astype(np.float64) - part) @ turn) / n
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, float(np.trace(cov)), error)


def whiten(rows: DataFrame, model: Whitening | None, *, vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row (column x, from ``grid``) and component of the model.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2, null where it doesn't fit in a long; ``whitened`` is the
    centred vector on the component over the root of its eigenvalue. Repeated rows and ids get their rows
    each; null ids stay null; vectors of another length than the fitted get none; without a model, or with components of no variance, there are none. Other columns are not read.
    """
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, values, vectors, trace, error = model
    d, k = len(sums), len(values)
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    part = np.array([r / n for r in rest])
    turn = vectors / np.sqrt(values)
    explained = values / trace
    high = 1 << 63

    def deviation(y: np.ndarray) -> list:
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if d * most * most < high:
            z = y * n - np.array(rest, np.int64)
            return (z * z).sum(1).tolist()
        exact = (sum((int(v) * n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y)
        return [v if v < high else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part_ = batch.slice(at, ROWS)
                m = part_.num_rows
                y = part_.column(1).flatten().to_numpy().reshape(m, d) - whole
                white = (y - part) @ turn
                take = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part_.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation(y), pa.int64()).take(take)]
                    + [pa.array(v) for v in (white.ravel(), np.tile(explained, m), np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.size("x") == d).select(F.col(vec_id).alias("vec_id"), "x").mapInArrow(run, schema)
