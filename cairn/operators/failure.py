"""Failure analysis over long predictions: (example_id, condition, y, pred, gate), one row per example and condition."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrong(pred: str, gate: str, threshold: float) -> Column:
    return (F.col(pred) <= threshold) != F.col(gate)


def taxonomy(preds: DataFrame, threshold: float = 40.0, tolerance: float = 5.0) -> DataFrame:
    """(condition, n, n_correct, n_imprecise, n_critical): critical if the gate is wrong, else correct within the tolerance."""
    wrong = _wrong("pred", "gate", threshold)
    close = F.abs(F.col("pred") - F.col("y")) <= tolerance
    return preds.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~wrong & close).alias("n_correct"), F.count_if(~wrong & ~close).alias("n_imprecise"), F.count_if(wrong).alias("n_critical")
    )


def score_subsets(df: DataFrame, modalities: list[str], predict_fn: Callable[[frozenset[str]], Column], keep: list[str]) -> DataFrame:
    """(keep, subset, pred): every row scored with each non-empty set of modalities present, in one pass.

    ``predict_fn`` gets the set and gives a column, built in or a pandas UDF; sets are written in order, joined by '+'.
    """
    sets = [c for n in range(1, len(modalities) + 1) for c in itertools.combinations(modalities, n)]
    told = F.explode(F.array(*[F.struct(F.lit("+".join(c)).alias("subset"), predict_fn(frozenset(c)).cast("double").alias("pred")) for c in sets]))
    return df.select(*keep, told.alias("_t")).select(*keep, "_t.*")


def by_subset(preds: DataFrame, subset: str = "subset") -> DataFrame:
    """(subset, mae): the error with each set of modalities present; sets are written in order, joined by '+'."""
    return preds.groupBy(subset).agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))


def complementarity(preds: DataFrame, modalities: list[str], subset: str = "subset") -> DataFrame:
    """(a, b, mae) for each pair of modalities, the solo errors on the diagonal."""
    if len(modalities) < 2:
        raise ValueError("at least two modalities")
    errors = by_subset(preds, subset)
    names = []
    for i, a in enumerate(modalities):
        for j, b in enumerate(modalities):
            lo, hi = sorted((i, j))
            names.append((a, b, a if a == b else f"{modalities[lo]}+{modalities[hi]}"))
    grid = preds.sparkSession.createDataFrame(names, f"a string, b string, {subset} string")
    return grid.join(errors, subset).select("a", "b", "mae")


def modality_values(preds: DataFrame, modalities: list[str], subset: str = "subset") -> DataFrame:
    """(modality, solo_mae, marginal_value, fusion_gain): leave-one-out error minus the full one, and the best solo minus full."""
    full = "+".join(modalities)
    mae = {s: F.avg(F.when(F.col(subset) == s, F.abs(F.col("pred") - F.col("y")))) for s in {full, *modalities, *("+".join(x for x in modalities if x != m) for m in modalities)}}
    rest = {m: "+".join(x for x in modalities if x != m) for m in modalities}
    one = preds.agg(mae[full].alias("_full"), *[mae[m].alias(f"_solo{i}") for i, m in enumerate(modalities)], *[mae[rest[m]].alias(f"_rest{i}") for i, m in enumerate(modalities)])
    best = F.least(*[F.col(f"_solo{i}") for i in range(len(modalities))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"_solo{i}").alias("solo_mae"), (F.col(f"_rest{i}") - F.col("_full")).alias("marginal_value"), (best - F.col("_full")).alias("fusion_gain")) for i, m in enumerate(modalities)]))
    return one.select(rows.alias("r")).select("r.*")


def winners(preds: DataFrame, drops: dict[str, str], groups: list[str] = ()) -> DataFrame:
    """(groups, modality, n): whose loss hurts each example most; the first of equals. ``drops`` maps a modality to the condition without it."""
    groups = list(groups)
    error = F.abs(F.col("pred") - F.col("y"))
    per = preds.groupBy("example_id", *groups).agg(F.max(F.when(F.col("condition") == "full", error)).alias("_full"), *[F.max(F.when(F.col("condition") == c, error)).alias(f"_{i}") for i, c in enumerate(drops.values())])
    loss = F.array(*[F.col(f"_{i}") - F.col("_full") for i in range(len(drops))])
    name = F.element_at(F.array(*map(F.lit, drops)), F.array_position(loss, F.array_max(loss)).cast("int"))
    return per.select(*groups, name.alias("modality")).groupBy(*groups, "modality").agg(F.count(F.lit(1)).alias("n"))


def dropout_profile(preds: DataFrame, threshold: float = 40.0, margin: float = 5.0) -> DataFrame:
    """(condition, n, n_induced, n_silent, n_loud, silent_rate, mean_shift, mae_increase) for each condition against the full one.

    An error is induced if the gate was right and is wrong now; it is silent if the prediction is at least
    ``margin`` from the threshold, else loud. The rate is null without induced errors.
    """
    full = preds.where(F.col("condition") == "full").select("example_id", F.col("pred").alias("_p"), _wrong("pred", "gate", threshold).alias("_w"))
    rows = preds.where(F.col("condition") != "full").join(full, "example_id")
    induced = ~F.col("_w") & _wrong("pred", "gate", threshold)
    silent = F.abs(F.col("pred") - threshold) >= margin
    return rows.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(induced).alias("n_induced"), F.count_if(induced & silent).alias("n_silent"), F.count_if(induced & ~silent).alias("n_loud"),
        F.try_divide(F.count_if(induced & silent).cast("double"), F.count_if(induced)).alias("silent_rate"), F.avg(F.col("pred") - F.col("_p")).alias("mean_shift"),
        F.avg(F.abs(F.col("pred") - F.col("y")) - F.abs(F.col("_p") - F.col("y"))).alias("mae_increase"),
    )


def missed_positive_profile(preds: DataFrame, cut: float = 0.5, silent_below: float = 0.35) -> DataFrame:
    """(condition, n_positive, n_missed, n_silent, silent_rate) of positives that the full condition finds and another misses; the rate is 0 without any."""
    full = preds.where((F.col("condition") == "full") & F.col("gate") & (F.col("p") >= cut)).select("example_id")
    rows = preds.where((F.col("condition") != "full") & F.col("gate")).join(full.withColumn("_f", F.lit(True)), "example_id", "left")
    missed = F.coalesce("_f", F.lit(False)) & (F.col("p") < cut)
    silent = missed & (F.col("p") < silent_below)
    return rows.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_positive"), F.count_if(missed).alias("n_missed"), F.count_if(silent).alias("n_silent"), (F.count_if(silent) / F.greatest(F.lit(1), F.count_if(missed))).alias("silent_rate")
    )


def recovery(runs: DataFrame, metrics: list[str], relation: Column) -> DataFrame:
    """Mean and population deviation of each metric over runs, and the share of runs where a relation holds."""
    aggs = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), *aggs, F.avg(relation.cast("double")).alias("holds"))
