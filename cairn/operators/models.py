"""Light models on frozen vectors: closed forms on a distributed Gram matrix, logistic fits by batched Newton steps, masked scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import logistic, metrics, pooling
from cairn.operators.logistic import Problem

ALPHAS = [float(x) for x in np.logspace(-1, 5, 25)]
CS = [float(x) for x in np.logspace(-4, 2, 12)]


@dataclass
class Scaler:
    """Means and population deviations of a training set; a constant column keeps a scale of 1."""

    mean: list[float]
    scale: list[float]

    def apply(self, vector: str | Column) -> Column:
        centred = F.zip_with(S.col(vector), F.array(*map(F.lit, self.mean)), lambda x, m: x.cast("double") - m)
        return F.zip_with(centred, F.array(*map(F.lit, self.scale)), lambda x, s: x / s)


def fit_scaler(df: DataFrame, vector: str) -> Scaler:
    v = array_to_vector(F.col(vector).cast("array<double>"))
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select("s.*").first()
    n = row["count"]
    std = np.sqrt(row["variance"].toArray() * (n - 1) / n) if n > 1 else np.zeros(len(row["mean"]))
    return Scaler([float(x) for x in row["mean"].toArray()], [float(x) if x > 0 else 1.0 for x in std])


@dataclass
class Linear:
    weights: list[float]
    intercept: float

    def predict(self, vector: str | Column) -> Column:
        return S.weighted(vector, self.weights) + F.lit(self.intercept)


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows; a null vector is an error."""
    if column.null_count:
        raise ValueError("a vector is null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gram(df: DataFrame, vector: str, label: str) -> tuple[np.ndarray, int]:
    """(Z'Z, n) of z = (1, x, y): tasks add up their own rows by blocks, so that what moves is one d-by-d matrix per task."""

    def run(batches):
        import pyarrow as pa

        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            z = np.concatenate([np.ones((len(x), 1)), x, batch.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1)
            total = z.T @ z if total is None else total + z.T @ z
            n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["g", "n"])

    parts = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, "g array<double>, n long")
    row = parts.select(array_to_vector("g").alias("g"), "n").agg(Summarizer.sum(F.col("g")).alias("g"), F.sum("n").alias("n")).first()
    if row["n"] is None:
        raise ValueError("no rows to fit")
    g = row["g"].toArray()
    d = round(len(g) ** 0.5)
    return g.reshape(d, d), row["n"]


def _centred(g: np.ndarray, n: int):
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    return c[:-1, :-1], c[:-1, -1], mean[:-1], mean[-1]


def fit_ridge(df: DataFrame, vector: str, label: str, alpha: float = 1.0) -> Linear:
    """Ridge with an unpenalised intercept, in closed form from the Gram matrix."""
    xx, xy, mx, my = _centred(*gram(df, vector, label))
    w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    return Linear([float(x) for x in w], float(my - mx @ w))


def fit_ridge_loo(df: DataFrame, vector: str, label: str, alphas: list[float] = ALPHAS) -> tuple[Linear, float, dict[float, float]]:
    """(model, alpha, errors): the alpha with the least mean squared leave-one-out error.

    One eigendecomposition serves all alphas; the residuals and leverages of all rows come from one more pass.
    """
    g, n = gram(df, vector, label)
    xx, xy, mx, my = _centred(g, n)
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0)
    rotated = vectors.T @ xy

    def run(batches):
        import pyarrow as pa

        sums = np.zeros(len(alphas))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (_matrix(batch.column(0)) - mx) @ vectors
            y = batch.column(1).to_numpy(zero_copy_only=False) - my
            for i, a in enumerate(alphas):
                shrunk = z / (values + a)
                leverage = 1 / n + (z * shrunk).sum(1)
                sums[i] += (((y - shrunk @ rotated) / (1 - leverage)) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array(sums)], names=["i", "s"])

    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    errors = {alphas[r["i"]]: r["s"] / n for r in rows}
    best = min(alphas, key=lambda a: (errors[a], a))
    w = vectors @ (rotated / (values + best))
    return Linear([float(x) for x in w], float(my - mx @ w)), best, errors


def _linear(beta: np.ndarray) -> Linear:
    return Linear([float(x) for x in beta[:-1]], float(beta[-1]))


def fit_logistic(df: DataFrame, features: str, gate: str, c: float = 1.0) -> Linear:
    """Logistic regression of c * total loss + half the squared weights; an error without both classes."""
    (beta,) = logistic.fit_many(df, features, [Problem(gate, c)])
    if beta is None:
        raise ValueError(f"{gate}: both classes are needed")
    return _linear(beta)


def fit_targets(df: DataFrame, features: str, gates: list[str], key: str, cs: list[float] = CS, folds: int = 5, seed: int = 42) -> dict[str, tuple[Linear, float]]:
    """(model, c) per target: the c with the best mean AUROC over folds of the shuffled key, and its fit on all rows.

    All targets, values of c and folds are fitted together, a job per Newton step, and scored in one more. A target
    without both classes gets no model; of equal means the first c is taken. Scores tie as in ``auroc``.
    """
    rows = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds))).select(features, "_fold", *gates).persist()
    problems = [Problem(g, c, k) for g in gates for c in cs for k in [*range(folds), None]]
    betas = logistic.fit_many(rows, features, problems, "_fold")
    scores = logistic.held_out_scores(rows, features, problems, betas, "_fold")
    found: dict[tuple[str, float], list[float]] = {}
    for r in metrics.auroc(scores, ["model"]).where("auroc is not null").orderBy("model").collect():  # a row per model
        found.setdefault(problems[r["model"]][:2], []).append(r["auroc"])
    rows.unpersist()
    out = {}
    whole = {p[:2]: b for p, b in zip(problems, betas, strict=True) if p.fold is None}
    for g in gates:
        mean = {c: sum(v) / len(v) if (v := found.get((g, c))) else 0.0 for c in cs}
        best = max(cs, key=lambda c: mean[c])
        if whole[g, best] is not None:
            out[g] = (_linear(whole[g, best]), best)
    return out


def fit_logistic_cv(df: DataFrame, features: str, gate: str, key: str, cs: list[float] = CS, folds: int = 5, seed: int = 42) -> tuple[Linear, float]:
    """``fit_targets`` of one target; an error without both classes."""
    found = fit_targets(df, features, [gate], key, cs, folds, seed)
    if gate not in found:
        raise ValueError(f"{gate}: both classes are needed")
    return found[gate]


def platt(fit_df: DataFrame | None, apply_df: DataFrame, score: str, gate: str, c: float = 1.0) -> DataFrame:
    """``apply_df`` with p, from a logistic fit of the gate on one score, and in_sample, true if there was nothing else to fit on."""
    source = apply_df if fit_df is None else fit_df
    one = source.where(F.col(gate).isNotNull()).withColumn("_x", F.array(F.col(score).cast("double")))
    model = fit_logistic(one, "_x", gate, c)
    z = F.col(score) * F.lit(model.weights[0]) + F.lit(model.intercept)
    return apply_df.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("in_sample", F.lit(fit_df is None))


# Fusion ------------------------------------------------------------------------------------------


@dataclass
class Fusion:
    """A linear model on concatenated vectors, by modality; the label mean stands in where nothing is present."""

    parts: dict[str, list[float]]
    intercept: float

    def part(self, modality: str, vector: str | Column) -> Column:
        return S.weighted(vector, self.parts[modality])


def fit_fusion(df: DataFrame, vectors: dict[str, str], label: str, alpha: float = 1.0) -> Fusion:
    joined = df.withColumn("_z", F.concat(*[F.col(v).cast("array<double>") for v in vectors.values()]))
    dims = df.select(*[F.max(F.size(v)).alias(m) for m, v in vectors.items()]).first()
    model = fit_ridge(joined, "_z", label, alpha)
    at, parts = 0, {}
    for m in vectors:
        parts[m] = model.weights[at : at + dims[m]]
        at += dims[m]
    return Fusion(parts, model.intercept)


def score_subsets(df: DataFrame, model: Fusion, vectors: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep, subset, pred) for every set of modalities: absent ones count as zero vectors, so a set's score is the sum of its parts."""
    names = list(vectors)
    subsets = [c for k in range(1, len(names) + 1) for c in combinations(names, k)]
    rows = df.select(*keep, *[F.coalesce(model.part(m, v), F.lit(0.0)).alias(f"_{i}") for i, (m, v) in enumerate(vectors.items())])
    total = lambda c: sum((F.col(f"_{names.index(m)}") for m in c), F.lit(model.intercept))
    pairs = F.explode(F.array(*[F.struct(F.lit("+".join(c)).alias("subset"), total(c).alias("pred")) for c in subsets]))
    return rows.select(*keep, pairs.alias("_p")).select(*keep, "_p.*")


def score_conditions(df: DataFrame, model: Fusion, vectors: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep, condition, pred): full, and each modality dropped."""
    names = list(vectors)
    condition = {"+".join(names): "full"} | {"+".join(x for x in names if x != m): f"{m}_dropped" for m in names}
    scored = score_subsets(df, model, vectors, keep).where(F.col("subset").isin(*condition))
    mapping = F.create_map(*[F.lit(x) for kv in condition.items() for x in kv])
    return scored.withColumn("condition", mapping[F.col("subset")]).drop("subset")


def compare_probes(train: DataFrame, test: DataFrame, vectors: dict[str, str], label: str, alpha: float = 1.0) -> DataFrame:
    """(probe, n, mae, baseline_mae): ridge on each vector and on their concatenation, on the same rows."""
    rows = {m: v for m, v in vectors.items()}
    join = lambda df: df.withColumn("_all", F.concat(*[F.col(v).cast("array<double>") for v in vectors.values()]))
    train, test = join(train), join(test)
    out = None
    for name, v in (rows | {"concat": "_all"}).items():
        model = fit_ridge(train, v, label, alpha)
        one = metrics.mae(test.withColumn("pred", model.predict(v)), [], label).withColumn("probe", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def pooled_and_single(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, alphas: list[float] = ALPHAS) -> DataFrame:
    """(key, y, single, pooled): the studies of ``test`` with their label and what two ridge probes say, one fitted on single vectors and one on the mean vector of each study.

    Each alpha is chosen by leave-one-out errors of its own training rows. A study's prediction from single vectors is
    the mean over its vectors, so that both are scored on the same studies. Null vectors are left out; a study without any is in neither.
    """
    there = lambda df: df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"))
    train, test = there(train), there(test)
    single, _, _ = fit_ridge_loo(train, "_x", "_y", alphas)
    goals = lambda df: df.groupBy(F.col(key).alias("_k")).agg(F.avg("_y").alias("_y"))
    pooled = lambda df: pooling.mean_pool(df, [key], "_x", "_m").join(goals(df), F.col(key) == F.col("_k")).drop("_k")
    mean, _, _ = fit_ridge_loo(pooled(train), "_m", "_y", alphas)
    by_vector = test.withColumn("_p", single.predict("_x")).groupBy(F.col(key).alias("_k")).agg(F.avg("_p").alias("single"))
    return pooled(test).join(by_vector, F.col(key) == F.col("_k")).select(key, F.col("_y").alias("y"), "single", mean.predict("_m").alias("pooled"))


def ablation(a: DataFrame, b: DataFrame, on: str = "probe", metric: str = "mae") -> DataFrame:
    """The same probes on two representations of the same rows: their metrics, the difference, and which is better."""
    left, right = a.select(on, F.col(metric).alias("first")), b.select(on, F.col(metric).alias("second"))
    return left.join(right, on).withColumn("difference", F.col("second") - F.col("first")).withColumn("better", F.when(F.col("difference") < 0, "second").when(F.col("difference") > 0, "first").otherwise("equal"))


def encode_missing(wanted: DataFrame, cached: DataFrame, key: str, encoder: Callable, schema: str) -> DataFrame:
    """Rows not cached yet, encoded batch by batch by ``encoder(pandas frame) -> pandas frame``."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield encoder(batch)

    return wanted.join(cached.select(key), key, "left_anti").mapInPandas(run, schema)


def to_vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def from_vector(column: str) -> Column:
    return vector_to_array(F.col(column))
