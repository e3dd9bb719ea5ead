"""Metrics as aggregations: errors, tie-aware ranking metrics, calibration, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import resample, splits
from cairn.sources import shared


def mae(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred", baseline: float | None = None) -> DataFrame:
    """(by, n, mae, baseline_mae): the baseline predicts the mean of the scored group, or a given train mean."""
    if baseline is not None:
        rows, base = df, F.lit(float(baseline))
    elif not by:
        rows, base = df, F.lit(df.agg(F.avg(y).cast("double")).first()[0]).cast("double")  # one number
    else:  # means first, a row per group, then joined: no group is gathered in one task
        means = df.groupBy(*by).agg(F.avg(y).alias("_m"))
        means = means.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_m")
        rows, base = df.join(means, _same(by, [f"_by{i}" for i in range(len(by))])), F.col("_m")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(pred) - F.col(y))).alias("mae"), F.avg(F.abs(base - F.col(y))).alias("baseline_mae"))


def _same(names: list[str], others: list[str]):
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(names, others, strict=True)], F.lit(True))


def _score_counts(df: DataFrame, by: list[str], gate: str, score: str, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(gate).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by, (F.col(score).cast("double") + 0.0).alias("_s")).agg(F.sum(F.when(F.col(gate), w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(gate), 0).otherwise(w)).alias("neg"))


def score_edges(df: DataFrame, score: str, pieces: int = 64) -> list[float]:
    """Scores that cut the rows into ``pieces`` of about equal size, from a mergeable sketch: at most ``pieces`` - 1 numbers."""
    if pieces < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(score).cast("double") + 0.0, [i / pieces for i in range(1, pieces)], 10_000)).first()[0]
    return sorted(set(found or []))


def _before(counts: DataFrame, by: list[str], values: list[str], edges: list[float], desc: bool = False) -> DataFrame:
    """Adds b_<value>, the sum of each value over the scores _s of the group that come before.

    The scores between two edges are one piece: sums per group and piece come first, so that a group is laid
    out by as many tasks as it has pieces, and the sums of the pieces before are at most a row per edge.
    """
    piece = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("_s"))) if edges else F.lit(0)
    rows = counts.withColumn("_q", piece)
    order = lambda c: F.desc(c) if desc else F.asc(c)
    span = (W.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_q").agg(*[F.sum(v).alias(f"_k_{v}") for v in values])
    upto = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(order("_q")).rowsBetween(*span)
    base = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_q").alias("_p"), *[F.coalesce(F.sum(f"_k_{v}").over(upto), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = W.partitionBy(*by, "_q").orderBy(order("_s")).rowsBetween(*span)
    rows = rows.withColumns({f"_i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    rows = rows.join(base, _same([*by, "_q"], [*[f"_by{i}" for i in range(len(by))], "_p"]))
    return rows.select(*counts.columns, *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).alias(f"b_{v}") for v in values])


def auroc(df: DataFrame, by: list[str], gate: str = "gate", score: str = "score", weight: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auroc): ties count half; null if a class is missing.

    Rows are first summed per distinct score, so the running sum sees each score of a group once, in the pieces between
    ``edges`` (see ``score_edges``; found from the scores if not given).
    """
    edges = score_edges(df, score) if edges is None else edges
    rows = _before(_score_counts(df, by, gate, score, weight), by, ["neg"], edges)
    out = rows.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("b_neg") + F.col("neg") * 0.5)).alias("_u"))
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_u").cast("double"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def auroc_global(df: DataFrame, gate: str = "gate", score: str = "score", pieces: int = 256) -> DataFrame:
    """(n_pos, n_neg, auroc) of one group with any number of distinct scores."""
    return auroc(df, [], gate, score, edges=score_edges(df, score, pieces))


def average_precision(df: DataFrame, by: list[str], gate: str = "gate", score: str = "score", weight: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """The step sum of precision over recall, taken at each distinct score from above; null without positives."""
    edges = score_edges(df, score) if edges is None else edges
    rows = _before(_score_counts(df, by, gate, score, weight), by, ["pos", "neg"], edges, desc=True)
    tp, fp = F.col("b_pos") + F.col("pos"), F.col("b_neg") + F.col("neg")
    out = rows.groupBy(*by).agg(F.sum(F.col("pos").cast("double") * tp / (tp + fp)).alias("_u"), F.sum("pos").alias("_all"))
    return out.select(*by, F.try_divide("_u", F.col("_all").cast("double")).alias("average_precision"))


def brier(df: DataFrame, by: list[str], gate: str = "gate", p: str = "p", weight: str | None = None) -> DataFrame:
    error = F.col(p) - F.col(gate).cast("int")
    if weight is None:
        return df.groupBy(*by).agg(F.avg(error * error).alias("brier"))
    rows = df.where(error.isNotNull())
    return rows.groupBy(*by).agg(F.try_divide(F.sum(error * error * F.col(weight)), F.sum(weight)).alias("brier"))


def stratified_metrics(df: DataFrame, strata: list[str], by: list[str] = (), *, y: str = "y", pred: str = "pred", gate: str = "gate", min_n: int = 20) -> DataFrame:
    """(by, stratum, value, n, mae, baseline_mae, auroc, small_n) overall and for each value of each stratum, in this order; missing values are 'unknown'.

    The score is the negative prediction: a low prediction tells the gate.
    """
    by = list(by)
    pairs = F.explode(F.array(F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in strata]))
    rows = df.select(*by, F.col(y).alias("y"), F.col(pred).alias("pred"), F.col(gate).alias("gate"), (-F.col(pred)).alias("score"), pairs.alias("_x")).select(*by, "y", "pred", "gate", "score", "_x.stratum", "_x.value")
    keys = [*by, "stratum", "value"]
    out = mae(rows, keys).join(auroc(rows, keys, edges=[-e for e in reversed(score_edges(df, pred))]), keys, "left")
    return out.withColumn("small_n", F.col("n") < min_n).orderBy(*keys)


def gate_fairness(df: DataFrame, targets: dict[str, str], strata: list[str], least: int = 5) -> DataFrame:
    """(target, stratum, value, n, n_pos, prevalence, auroc) for several gates and their scores; strata with too few of a class are left out."""
    wide = F.explode(F.array(*[F.struct(F.lit(g).alias("target"), F.col(g).alias("gate"), F.col(s).cast("double").alias("score")) for g, s in targets.items()]))
    rows = df.select(*strata, wide.alias("t")).select(*strata, "t.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata]))
    rows = rows.select("target", "gate", "score", pairs.alias("x")).select("target", "gate", "score", "x.*")
    keys = ["target", "stratum", "value"]
    out = auroc(rows, keys).withColumn("n", F.col("n_pos") + F.col("n_neg")).withColumn("prevalence", F.col("n_pos") / F.col("n"))
    named = F.col("value").isNotNull() & ~F.lower("value").isin("unknown", "nan", "")
    return out.where(named & (F.col("n_pos") >= least) & (F.col("n_neg") >= least)).select(*keys, "n", "n_pos", "prevalence", "auroc")


def bin_edges(n_bins: int) -> list[float]:
    """Equal-width edges as multiples of 1/n: the third of ten is 0.30000000000000004."""
    return [i * (1.0 / n_bins) for i in range(n_bins + 1)]


def reliability_bins(df: DataFrame, by: list[str], gate: str = "gate", p: str = "p", n_bins: int = 10) -> DataFrame:
    """(by, bin, lo, hi, n, accuracy, confidence) for every bin, empty ones too; left-closed, the last closed; means to four decimals."""
    edges = bin_edges(n_bins)
    place = F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col(p) >= e)), F.lit(n_bins)) - 1
    filled = df.where(F.col(gate).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.greatest(place, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(gate).cast("double")), 4).alias("accuracy"), F.round(F.avg(p), 4).alias("confidence")
    )
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lo"), F.lit(edges[i + 1]).alias("hi")) for i in range(n_bins)])).alias("b")).select(*by, "b.*")
    return every.join(filled, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(bins: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error from (rounded) bins; null for no rows."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.groupBy(*by).agg(F.try_divide(F.coalesce(F.sum(gap), F.lit(0.0)), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def group_error(df: DataFrame, by: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """(by, n, mae), null groups left out."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(pred) - F.col(y))).alias("mae"))


# Bootstrap ---------------------------------------------------------------------------------------


def numbered(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with _n, the rows of the group, and _i, the row's number from 0 in the order of md5(seed:key), by counted buckets."""
    rows = splits.global_rank(df.withColumn("_o", splits.shuffled(key, seed)), "_o", by, key)
    return rows.select(*df.columns, F.col("total").alias("_n"), (F.col("rank") - 1).alias("_i"))


def drawn(df: DataFrame, by: list[str], key: str, b: int, seed: int) -> DataFrame:
    """``df`` with weights, how often a row is drawn in each of ``b`` resamples with replacement, n rows per replicate and group.

    Draw j of replicate r is the row of number md5(seed:r:j) mod n (see ``numbered``). The draws of a row are
    known from the numbers alone, so they are counted by number (see ``resample.drawn_weights``) and joined, a row per row.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select("_n").distinct()
    weights = resample.drawn_weights(sizes, b, seed).hint("merge")  # as many as rows; Spark would take them for few and broadcast them
    return numbered(df, by, key, seed).join(weights, ["_n", "_i"]).select(*df.columns, "weights")


def _drawn_sums(df: DataFrame, by: list[str], key: str, b: int, seed: int, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """As ``drawn``, but without the key, in ranges of replicates (from _first), and rows that are alike are one, as far as they are drawn together (see ``resample.drawn_sums``). ``then`` changes rows after they are numbered."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select("_n")
    return resample.drawn_sums(then(numbered(df, by, key, seed)).drop(key), by, sizes, b, seed)


def poisson(df: DataFrame, key: str, b: int, seed: int) -> DataFrame:
    """``df`` with weights, Poisson(1) in each of ``b`` replicates, for tables too large for exact draws. Rows of a key weigh alike, so a key is hashed once."""
    told = resample.poisson_weights(df.select(key).distinct().repartition(resample.tasks(df.sparkSession)), key, b, seed)
    return df.join(told, F.col(key).eqNullSafe(F.col("_key"))).select(*df.columns, "weights")


def _weighted(df: DataFrame, by: list[str], key: str, b: int, seed: int, mode: str, own: list[str] | None = None) -> DataFrame:
    if mode not in ("exact", "poisson"):
        raise ValueError(f"mode is {mode!r}, not one of the modes")
    df = df.select(*dict.fromkeys([*by, key, *own])) if own else df
    return _drawn_sums(df, by, key, b, seed) if mode == "exact" else poisson(df, key, b, seed)


def _replicates(weighted: DataFrame) -> DataFrame:
    """A row per row and replicate that has it, with replicate and weight in place of weights."""
    rows = weighted.select(*[c for c in weighted.columns if c != "weights"], F.posexplode("weights").alias("replicate", "weight")).where("weight > 0")
    return rows.withColumn("replicate", (F.col("replicate") + F.col("_first")).cast("int")).drop("_first") if "_first" in rows.columns else rows


def bootstrap_ci(df: DataFrame, by: list[str], *, key: str = "example_id", y: str = "y", pred: str = "pred", gate: str = "gate", b: int = 1000, seed: int = 42, alpha: float = 0.05, mode: str = "multinomial") -> DataFrame:
    """Percentile intervals of MAE and AUROC per group, with how many replicates had no AUROC.

    ``mode`` is multinomial (see ``resample``), exact (draws known from md5, a row per row and replicate drawn, in any engine) or
    poisson. Null errors, gates and predictions are left out as in ``mae`` and ``auroc``.
    """
    if mode == "multinomial":
        return _intervals(resample.bootstrap(df, by, key=key, y=y, pred=pred, gate=gate, b=b, seed=seed), by, alpha)
    rows = _replicates(_weighted(df, by, key, b, seed, mode, [y, pred, gate]))
    keys = [*by, "replicate"]
    # both metrics from one table of sums per replicate and score, found once
    w, error = F.col("weight"), F.abs(F.col(pred) - F.col(y))
    known = F.col(pred).isNotNull()
    counts = rows.groupBy(*keys, (-F.col(pred).cast("double") + 0.0).alias("_s")).agg(
        F.sum(F.when(known & F.col(gate), w).otherwise(0)).alias("pos"), F.sum(F.when(known & ~F.col(gate), w).otherwise(0)).alias("neg"), F.sum(error * w).alias("e"), F.sum(F.when(error.isNotNull(), w)).alias("w")
    )
    counts = _before(shared.cut(counts), keys, ["neg"], [-e for e in reversed(score_edges(df, pred))])
    sums = counts.groupBy(*keys).agg(F.try_divide(F.sum("e"), F.sum("w")).alias("mae"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("b_neg") + F.col("neg") * 0.5)).alias("_u"))
    return _intervals(sums.withColumn("auroc", F.try_divide(F.col("_u").cast("double"), F.col("p").cast("double") * F.col("n"))), by, alpha)


def _intervals(both: DataFrame, by: list[str], alpha: float) -> DataFrame:
    lo, hi = alpha / 2, 1 - alpha / 2
    return both.groupBy(*by).agg(
        F.percentile("mae", F.lit(lo)).alias("mae_lo"), F.percentile("mae", F.lit(hi)).alias("mae_hi"), F.percentile("auroc", F.lit(lo)).alias("auroc_lo"), F.percentile("auroc", F.lit(hi)).alias("auroc_hi"),
        F.count("auroc").alias("auroc_replicates"), F.count_if(F.col("auroc").isNull()).alias("auroc_discarded"),
    )


def bootstrap_metrics(df: DataFrame, by: list[str], given: dict[str, Callable[[DataFrame, list[str], str], DataFrame]], *, key: str = "example_id", b: int = 1000, seed: int = 42, alpha: float = 0.05, mode: str = "exact") -> DataFrame:
    """(by, lo, hi, replicates, discarded, metric) of any metrics over the same draws: ``given[name](rows, keys, weight)`` gives a row per key with a column ``name``.

    ``average_precision``, ``auroc`` and ``brier`` take a weight column; replicates in which the value is null are discarded. The weights are found once, with all
    columns of ``df``, and kept in the shared folder. In exact mode rows that are alike in all but the key, which metrics do not get, may come as one with the sum of their weights.
    """
    rows = _replicates(shared.stored(_weighted(df, by, key, b, seed, mode)))
    told = []
    for name, metric_fn in given.items():
        values = metric_fn(rows, [*by, "replicate"], "weight").groupBy(*by)
        told.append(values.agg(
            F.percentile(name, F.lit(alpha / 2)).alias("lo"), F.percentile(name, F.lit(1 - alpha / 2)).alias("hi"), F.count(name).alias("replicates"), F.count_if(F.col(name).isNull()).alias("discarded"), F.lit(name).alias("metric")
        ))
    return reduce(DataFrame.unionByName, told)


def bootstrap_metric(df: DataFrame, by: list[str], metric_fn: Callable[[DataFrame, list[str], str], DataFrame], value: str, *, key: str = "example_id", b: int = 1000, seed: int = 42, alpha: float = 0.05, mode: str = "exact") -> DataFrame:
    """(by, lo, hi, replicates, discarded) of one metric, as in ``bootstrap_metrics``."""
    return bootstrap_metrics(df, by, {value: metric_fn}, key=key, b=b, seed=seed, alpha=alpha, mode=mode).drop("metric")


def paired_delta(df: DataFrame, by: list[str], *, pred_a: str, pred_b: str, key: str = "example_id", y: str = "y", gate: str = "gate", b: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Intervals of metric(a) - metric(b) over the same draws; a replicate's AUROC counts only if both have one."""
    difference = F.abs(F.col(pred_a) - F.col(y)) - F.abs(F.col(pred_b) - F.col(y))  # null, and left out, if either is
    # each prediction's score with the gate, and the difference of errors: apart, so that many rows are alike
    of = F.explode(F.array(
        *[F.struct(F.lit(i).alias("_which"), (-F.col(p).cast("double") + 0.0).alias("_s"), F.col(gate).alias("_gate"), F.lit(None).cast("double").alias("_d")) for i, p in enumerate((pred_a, pred_b))],
        F.struct(F.lit(2).alias("_which"), F.lit(None).cast("double").alias("_s"), F.lit(None).cast("boolean").alias("_gate"), difference.cast("double").alias("_d")),
    ))
    rows = _replicates(_drawn_sums(df, by, key, b, seed, lambda rows: rows.select(*by, key, "_n", "_i", of.alias("_x")).select(*by, key, "_n", "_i", "_x.*")))
    keys = [*by, "replicate"]
    w, ranked = F.col("weight"), F.col("_s").isNotNull()
    # all metrics from one table of sums per replicate, prediction and score, found once
    counts = rows.groupBy(*keys, "_which", "_s").agg(
        F.sum(F.when(ranked & F.col("_gate"), w).otherwise(0)).alias("pos"), F.sum(F.when(ranked & ~F.col("_gate"), w).otherwise(0)).alias("neg"), F.sum(F.col("_d") * w).alias("e"), F.sum(F.when(F.col("_d").isNotNull(), w)).alias("w")
    )
    edges = sorted({-e for p in (pred_a, pred_b) for e in score_edges(df, p)})
    counts = _before(shared.cut(counts), [*keys, "_which"], ["neg"], edges)
    sums = counts.groupBy(*keys, "_which").agg(F.sum("e").alias("e"), F.sum("w").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("b_neg") + F.col("neg") * 0.5)).alias("_u"))
    sums = sums.withColumn("_a", F.try_divide(F.col("_u").cast("double"), F.col("p").cast("double") * F.col("n")))
    a, c = (F.max(F.when(F.col("_which") == i, F.col("_a"))) for i in (0, 1))
    both = sums.groupBy(*keys).agg(F.try_divide(F.sum("e"), F.sum("w")).alias("d_mae"), (a - c).alias("d_auroc"))
    lo, hi = alpha / 2, 1 - alpha / 2
    return both.groupBy(*by).agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in ("d_mae", "d_auroc") for q, n in ((lo, "lo"), (hi, "hi"))], F.count("d_auroc").alias("auroc_replicates"))


# Tables ------------------------------------------------------------------------------------------


def degradation(metrics: DataFrame, condition: str = "condition") -> DataFrame:
    """Differences of mae and auroc to the full condition, and which drop costs most."""
    full = F.col(condition) == "full"
    everything = W.partitionBy(F.lit(0))  # a row per condition
    rows = metrics.withColumn("_m", F.max(F.when(full, F.col("mae"))).over(everything)).withColumn("_a", F.max(F.when(full, F.col("auroc"))).over(everything))
    rows = rows.where(F.col(condition) != "full").select(condition, (F.col("mae") - F.col("_m")).alias("delta_mae"), (F.col("auroc") - F.col("_a")).alias("delta_auroc"))
    return rows.withColumn("largest", F.row_number().over(W.orderBy(F.desc("delta_mae"), condition)) == 1)


def unified(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One table of all results that are there, with a column for their kind; an error if there are none."""
    found = [t.withColumn("kind", F.lit(name)) for name, t in tables.items() if t is not None]
    if not found:
        raise ValueError("no result tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
