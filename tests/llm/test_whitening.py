"""Whitening against numpy on the whole table, clustered eigenvalues, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import whitening

VEC = "vec_id long, embedding array<float>"


def brute(rows):
    """(x per row, fit list, covariance) from the definition."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, tuple(int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in good]
    unique = np.array(sorted({v for _, v in x}), np.longdouble)
    z = unique - unique.mean(0)
    return x, unique, (z.T @ z / len(unique)).astype(np.float64)


def check(spark, rows):
    x, unique, cov = brute(rows)
    frame = whitening.grid(spark.createDataFrame(rows, VEC))
    found = whitening.whiten(frame, whitening.fit(frame)).collect()
    n, sums = len(unique), [int(s) for s in unique.sum(0)]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, int((values > len(values) * 1e-15 * values[0]).sum()))
    assert len(found) == k * len(x)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in found) == sorted((i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in x for _ in range(k))
    by_id = {i: v for i, v in x}
    for r in found:
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-9
    parts = {}
    for r in found:
        if r["vec_id"] in by_id:
            parts.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    return parts, by_id, sums, n, values, vectors


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows += [(9001, None), (9002, []), (9003, [None] * 64), (9004, [float("nan")] * 64), (9005, [float("inf")] + [0.0] * 63), (rows[0][0], rows[0][1]), (9006, rows[1][1]), (None, rows[2][1])]
    rows = [r for r in rows if r[0] != 9002]
    parts, by_id, sums, n, values, vectors = check(spark, rows)
    for component, own in parts.items():
        want = {i: float(np.dot(np.array([c * n - s for c, s in zip(by_id[i], sums, strict=True)], float) / n, vectors[:, component - 1]) / np.sqrt(values[component - 1])) for i in own}
        i0 = max(own, key=lambda i: abs(own[i]))
        sign = np.sign(want[i0] * own[i0])
        assert max(abs(own[i] - sign * want[i]) for i in own) < 1e-8


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 60, 40), np.r_[3 + 1e-9 * np.arange(5), np.full(4, 7.0), np.linspace(0.1, 1, 9)], np.r_[1 + 1e-12 * np.arange(6), 2.0 + 1e-5 * np.arange(6)], np.r_[np.zeros(6), 1.0, 2.0], np.full(7, 5.0), np.zeros(3), np.array([4.0])],
)
def test_eigenvectors_are_refined_to_double_precision(values):
    a = matrix(values)
    found, x = whitening.eigen(a)
    wide = np.longdouble
    scale = max(1.0, float(np.abs(values).max()))
    assert np.abs(x.T.astype(wide) @ x - np.eye(len(values))).max() < 4e-16
    assert np.abs(a.astype(wide) @ x - x.astype(wide) * found.astype(wide)).max() < 1e-15 * scale * 4
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-14 * scale * 4 and (np.diff(found) <= 1e-13 * scale).all()


def test_float32_alone_would_not_do():
    a = matrix(np.linspace(1, 60, 40))
    values, x = np.linalg.eigh(a.astype(np.float32))
    assert np.abs(x.T.astype(float) @ x - np.eye(40)).max() > 1e-8
    for kind in (np.float64, np.float64, np.longdouble):
        x, values, change, _ = whitening.refined(a, x, kind)
    assert change < 1e-13


def test_edge_cases(spark):
    empty = whitening.grid(spark.createDataFrame([], VEC))
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).collect() == []
    same = whitening.grid(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VEC))
    assert whitening.whiten(same, whitening.fit(same)).collect() == []  # no variance, no component
    check(spark, [(1, [0.0, 1.0, 2.0]), (2, [1.0, 0.5, -2.0]), (2, [1.0, 0.5, -2.0]), (None, [0.25, 0.25, 3.0])])  # rank 2 of 3
    mixed = whitening.grid(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [2.0, 4.0]), (4, [1.0])], VEC))
    assert {r["vec_id"] for r in whitening.whiten(mixed, whitening.fit(mixed)).collect()} == {1, 2, 3}
    huge = whitening.grid(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], VEC))
    assert {r["deviation"] for r in whitening.whiten(huge, whitening.fit(huge)).collect()} >= {None}


def test_one_vector_many_times_weighs_once_and_names_clash(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    check(spark, rows)
    plain = spark.createDataFrame(rows, VEC)
    clash = plain.select("*", *[F.lit("y").alias(n) for n in "n component line at v values whitened".split()])
    of = lambda df: sorted(map(str, whitening.whiten(whitening.grid(df), whitening.fit(whitening.grid(df))).collect()))
    assert [r.split("whitened")[0] for r in of(clash)] == [r.split("whitened")[0] for r in of(plain)]
