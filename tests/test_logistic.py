"""Batched Newton fits against single fits and Spark ML, with folds, unknown targets and missing classes."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cairn.operators import logistic, models
from cairn.operators.logistic import Problem


def newton(x, y, c):
    z = np.c_[x, np.ones(len(x))]
    beta, penalty = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), c * z.T @ (p - y) + penalty * beta)
    return beta


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5))
    a = rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 0.5, 0] + 0.3)))
    b = rng.random(300) < 1 / (1 + np.exp(-(x @ [0, 0, 3, 0, -1] - 1)))
    known = rng.random(300) < 0.8
    fold = rng.integers(0, 3, 300)
    rows = [(i, x[i].tolist(), bool(a[i]), bool(b[i]) if known[i] else None, True, int(fold[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, v array<double>, a boolean, b boolean, always boolean, fold int").repartition(5), x, a, b, known, fold


def test_all_models_equal_single_fits_in_few_passes(data, monkeypatch):
    df, x, a, b, known, fold = data
    problems = [Problem(g, c, k) for g in ("a", "b", "always") for c in (1e-4, 0.1, 1.0, 100.0) for k in (0, 1, 2, None)]
    calls, real = [], logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda *args: calls.append(len(args[2])) or real(*args))
    betas = logistic.fit_many(df, "v", problems, "fold")
    assert len(calls) <= 15 and calls[0] == 48 and calls[-1] < 32
    for p, beta in zip(problems, betas, strict=True):
        if p.gate == "always":
            assert beta is None
            continue
        rows = (fold != p.fold if p.fold is not None else np.ones(300, bool)) & (known if p.gate == "b" else True)
        assert np.abs(beta - newton(x[rows], {"a": a, "b": b}[p.gate][rows], p.c)).max() < 1e-6


def test_models_beyond_a_group_give_the_same(data, monkeypatch):
    df = data[0]
    problems = [Problem(g, c, k) for g in ("a", "b") for c in (0.1, 1.0) for k in (0, None)]
    want = logistic.fit_many(df, "v", problems, "fold")
    monkeypatch.setattr(logistic, "GROUP_BYTES", 3 * 8 * 36)
    monkeypatch.setattr(logistic, "ROWS", 17)
    assert np.allclose(want, logistic.fit_many(df, "v", problems, "fold"), atol=1e-9)


def test_equal_to_spark_ml(data):
    df = data[0]
    model = models.fit_logistic(df, "v", "a", 0.5)
    given = df.select(array_to_vector("v").alias("features"), F.col("a").cast("double").alias("label"))
    other = LogisticRegression(regParam=1 / (0.5 * 300), standardization=False, maxIter=300, tol=1e-12).fit(given)
    assert np.allclose(model.weights, other.coefficients.toArray(), atol=1e-6) and abs(model.intercept - other.intercept) < 1e-6


def test_targets_and_the_choice_of_c(data):
    df, x, a, b, known, _ = data
    found = models.fit_targets(df, "v", ["a", "b", "always"], "id", cs=[1e-6, 0.1, 10.0])
    assert set(found) == {"a", "b"}
    for g, y, rows in (("a", a, np.ones(300, bool)), ("b", b, known)):
        model, c = found[g]
        assert c in (1e-6, 0.1, 10.0)
        assert np.allclose([*model.weights, model.intercept], newton(x[rows], y[rows], c), atol=1e-6)
        alone, same = models.fit_logistic_cv(df.where(F.col(g).isNotNull()), "v", g, "id", cs=[1e-6, 0.1, 10.0])
        assert same == c and np.allclose(alone.weights, model.weights, atol=1e-9)
    with pytest.raises(ValueError, match="both classes"):
        models.fit_logistic_cv(df, "v", "always", "id", cs=[1.0])


def test_separable_classes_and_edge_cases(spark):
    rows = [(i, [float(i)], i > 5) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y boolean")
    for c in (1.0, 1e6):
        beta = logistic.fit_many(df, "v", [Problem("y", c)])[0]
        x, y = np.arange(12.0)[:, None], np.arange(12) > 5
        p = 1 / (1 + np.exp(-(x[:, 0] * beta[0] + beta[1])))
        assert abs(c * (x[:, 0] @ (p - y)) + beta[0]) < 1e-5 * c and abs((p - y).sum()) < 1e-5
    assert logistic.fit_many(df.limit(0), "v", [Problem("y", 1.0)]) == [None]
    with pytest.raises(Exception, match="a vector is null"):
        logistic.fit_many(df.union(spark.createDataFrame([(99, None, True)], df.schema)), "v", [Problem("y", 1.0)])
