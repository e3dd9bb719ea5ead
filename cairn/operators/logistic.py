"""Logistic fits of many models at once: each pass over the rows gives the gradients and Hessians of all of them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied together.
ROWS = 4096
#: Bytes of Hessians that a task adds up at once; more models than fit go through further jobs.
GROUP_BYTES = 256 << 20


class Problem(NamedTuple):
    """A fit of c * total loss + half the squared weights: its target column, c, and the fold it leaves out (None: no fold)."""

    gate: str
    c: float
    fold: int | None = None


def _blocks(batch, gates: list[str]):
    """(z, fold, targets) of a batch, ``ROWS`` rows at a time: vectors with a final one, folds, and a target per gate, NaN where null."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        x = part.column(0)
        if x.null_count:
            raise ValueError("a vector is null")
        z = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
        y = {g: part.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i, g in enumerate(gates)}
        yield np.concatenate([z, np.ones((len(z), 1))], axis=1), part.column(1).to_numpy(zero_copy_only=False), y


def _frame(df: DataFrame, features: str, gates: list[str], fold: str | None) -> DataFrame:
    own = [F.col(g).cast("double").alias(f"g{i}") for i, g in enumerate(gates)]
    return df.select(F.col(features).cast("array<double>").alias("x"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), *own)


def _sums(rows: DataFrame, gates: list[str], problems: list[Problem], betas: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Per problem, in one job: rows, positives, loss, gradient and Hessian at its point, one after another in an array."""

    def run(batches):
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for z, fold, targets in _blocks(batch, gates):
                for gate, y in targets.items():
                    mine = [i for i, p in enumerate(problems) if p.gate == gate]
                    known = ~np.isnan(y)
                    if not mine or not known.any():
                        continue
                    own, t = z[known], y[known, None]
                    left_out = np.array([-2 if problems[i].fold is None else problems[i].fold for i in mine])
                    inside = (fold[known, None] != left_out).astype(float)
                    eta = own @ np.stack([betas[i] for i in mine], axis=1)
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    loss = ((np.logaddexp(0, eta) - t * eta) * inside).sum(0)
                    gradient = own.T @ ((p - t) * inside)
                    weight = p * (1 - p) * inside
                    n, pos = inside.sum(0), (t * inside).sum(0)
                    for k, i in enumerate(mine):
                        one = np.concatenate([[n[k], pos[k], loss[k]], gradient[:, k], ((own * weight[:, k : k + 1]).T @ own).ravel()])
                        totals[i] = totals[i] + one if i in totals else one
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], names=["i", "s"])

    parts = rows.mapInArrow(run, "i int, s array<double>").select("i", array_to_vector("s").alias("s"))
    return {r["i"]: r["s"].toArray() for r in parts.groupBy("i").agg(Summarizer.sum(F.col("s")).alias("s")).collect()}  # a row per model


def fit_many(df: DataFrame, features: str, problems: list[Problem], fold: str | None = None, *, tol: float = 1e-10, max_iter: int = 100) -> list[np.ndarray | None]:
    """Weights with the intercept last, per problem, by Newton's method; None where the rows of a problem are not of both classes.

    All problems share each pass: one job per iteration, in which a task adds up a gradient and a Hessian per model
    (in further jobs only beyond ``GROUP_BYTES`` of Hessians). A step that raises the loss is halved; models that have
    converged leave the later passes. Rows with a null target are in no model of that target; a null vector is an error.
    """
    gates = list(dict.fromkeys(p.gate for p in problems))
    rows = _frame(df, features, gates, fold)
    size = df.select(F.max(F.size(features))).first()[0]
    if size is None:
        return [None] * len(problems)
    d = size + 1
    group = max(1, GROUP_BYTES // (8 * d * d))
    beta = [np.zeros(d) for _ in problems]
    best = [np.inf] * len(problems)
    step: list[np.ndarray] = [np.zeros(d) for _ in problems]
    live, alone = list(range(len(problems))), set()
    penalty = np.r_[np.ones(d - 1), 0.0]
    for _ in range(max_iter):
        if not live:
            break
        told = {}
        for at in range(0, len(live), group):
            part = live[at : at + group]
            sums = _sums(rows, gates, [problems[i] for i in part], [beta[i] + step[i] for i in part])
            told |= {i: sums.get(k) for k, i in enumerate(part)}
        still = []
        for i in live:
            c, s = problems[i].c, told[i]
            if s is None or s[1] in (0, s[0]):
                alone.add(i)
                continue
            point = beta[i] + step[i]
            value = c * s[2] + 0.5 * (penalty * point * point).sum()
            if value > best[i] + 1e-12 * abs(best[i]):
                step[i] = step[i] / 2
                if np.abs(step[i]).max() > 1e-14:
                    still.append(i)
                continue
            beta[i], best[i] = point, value
            gradient = c * s[3 : 3 + d] + penalty * point
            hessian = c * s[3 + d :].reshape(d, d) + np.diag(penalty + 1e-12)
            step[i] = -np.linalg.solve(hessian, gradient)
            if np.abs(step[i]).max() <= tol * (1 + np.abs(point).max()):
                beta[i] = point + step[i]
            else:
                still.append(i)
        live = still
    else:
        if live:
            raise RuntimeError(f"no convergence in {max_iter} passes of {[problems[i] for i in live]}")
    return [None if i in alone else b for i, b in enumerate(beta)]


def held_out_scores(df: DataFrame, features: str, problems: list[Problem], betas: list[np.ndarray | None], fold: str) -> DataFrame:
    """(model, gate, score): each row's score by every model that left its fold out, ``model`` being the problem's number."""
    gates = list(dict.fromkeys(p.gate for p in problems))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for z, folds, targets in _blocks(batch, gates):
                for gate, y in targets.items():
                    for k in np.unique(folds):
                        mine = [i for i, p in enumerate(problems) if p.gate == gate and p.fold == k and betas[i] is not None]
                        rows = (folds == k) & ~np.isnan(y)
                        if mine and rows.any():
                            scores = (z[rows] @ np.stack([betas[i] for i in mine], axis=1)).T
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(mine, np.int32), rows.sum())), pa.array(np.tile(y[rows] > 0, len(mine))), pa.array(scores.ravel())], names=["model", "gate", "score"])

    return _frame(df, features, gates, fold).mapInArrow(run, "model int, gate boolean, score double")
