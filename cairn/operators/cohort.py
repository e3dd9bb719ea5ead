"""Cohort construction: stage flags on one row set, then funnel, label sources, summaries and sensitivity from it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import pairing
from cairn.sources import shared

# Names that give a label, in order of preference, and upper bounds of ranges, which never do. Fixed values.
CHAIN = ["lvef", "biplane_lvef", "rest_lvef", "rest_biplane_lvef", "lvef_3d"]
BOUNDS = ["lvef_upper", "rest_lvef_upper"]
WINDOW_STAGES = ["all", "linked", "any_label", "accepted", "overlap", "paired", "in_stay"]
STAY_STAGES = ["all", "linked", "any_label", "accepted", "overlap", "in_stay", "paired"]


def labelled(studies: DataFrame, measurements: DataFrame, records: DataFrame, *, lo: float = 5.0, hi: float = 95.0) -> DataFrame:
    """One row per study with its label (value, label_source) and the flags s_all, s_linked, s_any_label, s_accepted and s_overlap.

    ``studies``: study_id, subject_id, ts, measurement_id; ``measurements``: measurement_id, name, result, ts; of ``records`` the subjects count.
    """
    base = pairing.keep_first(studies.select("study_id", "subject_id", "ts", "measurement_id"), "study_id", [F.col("measurement_id"), F.col("subject_id"), F.col("ts")])
    labels = pairing.priority_pick(measurements, key="measurement_id", name="name", value=S.percent("result"), lo=lo, hi=hi, chain=CHAIN, excluded=BOUNDS, ties=["ts", "result"])
    subjects = records.select("subject_id").distinct().withColumn("_has", F.lit(True))
    rows = base.join(labels, "measurement_id", "left").join(subjects, "subject_id", "left")
    return (
        rows.withColumn("s_all", F.lit(True))
        .withColumn("s_linked", F.col("measurement_id").isNotNull())
        .withColumn("s_any_label", F.col("s_linked") & F.col("label_source").isNotNull())
        .withColumn("s_accepted", F.col("s_any_label") & F.coalesce("accepted", F.lit(False)))
        .withColumn("s_overlap", F.col("s_accepted") & F.coalesce("_has", F.lit(False)))
        .drop("_has", "accepted")
    )


def paired(rows: DataFrame, records: DataFrame, stays: DataFrame, *, pair_by: str = "window", before: int = 86400, after: int = 86400, bucketed: bool = False, widths: list[int] | None = None) -> DataFrame:
    """The studies of ``rows`` that overlap, with the record and stay they are paired with: a row per study that gets as far as its first pairing step.

    ``records``: record_id, subject_id, record_ts, path; ``stays``: stay_id, subject_id, start_ts, end_ts. By
    "window", the record nearest in time is paired first and the stay attached then; by "stay", the study must lie in a stay and the record too.
    """
    if pair_by not in ("window", "stay"):
        raise ValueError(f"pair_by is {pair_by!r}, not 'window' or 'stay'")
    # only studies that reach pairing take part in the range joins
    candidates = rows.where("s_overlap").select("study_id", "subject_id", "ts")
    window = {"on": "subject_id", "anchor_id": "study_id", "anchor_ts": "ts", "record_ts": "record_ts", "record_id": "record_id"}
    span = {"on": "subject_id", "point_id": "study_id", "ts": "ts", "start": "start_ts", "end": "end_ts", "span_id": "stay_id"}
    span["widths"] = pairing.widths_in_use(stays, "start_ts", "end_ts") if widths is None else widths
    if pair_by == "window":
        found = pairing.nearest_join(candidates, records, before=before, after=after, bucketed=bucketed, **window)
        return pairing.interval_join(found, stays, how="left", **span).drop("subject_id", "ts")
    held = pairing.interval_join(candidates, stays, **span)
    return pairing.nearest_in_span(held, records, start="start_ts", end="end_ts", how="left", widths=span["widths"], **window).drop("subject_id", "ts")


def cohort_flags(
    studies: DataFrame, measurements: DataFrame, records: DataFrame, stays: DataFrame, *, pair_by: str = "window", before: int = 86400, after: int = 86400, lo: float = 5.0, hi: float = 95.0, require_stay: bool = True, bucketed: bool = False
) -> DataFrame:
    """One row per study with its label, record and stay, and a flag s_<stage> for each stage it reaches (see ``labelled``, ``paired``).

    By "window", the stay is a filter or (``require_stay`` false) extra columns.
    """
    if pair_by not in ("window", "stay"):
        raise ValueError(f"pair_by is {pair_by!r}, not 'window' or 'stay'")
    rows = labelled(studies, measurements, records, lo=lo, hi=hi)
    rows = rows.join(paired(rows, records, stays, pair_by=pair_by, before=before, after=after, bucketed=bucketed), "study_id", "left")
    if pair_by == "window":
        rows = rows.withColumn("s_paired", F.col("record_id").isNotNull())
        return rows.withColumn("s_in_stay", F.col("s_paired") & F.col("stay_id").isNotNull()).withColumn("in_cohort", F.col("s_in_stay") if require_stay else F.col("s_paired"))
    rows = rows.withColumn("s_in_stay", F.col("stay_id").isNotNull())
    return rows.withColumn("s_paired", F.col("s_in_stay") & F.col("record_id").isNotNull()).withColumn("in_cohort", F.col("s_paired"))


def cohort(flags: DataFrame, patients: DataFrame, files: DataFrame, threshold: float = 40.0) -> DataFrame:
    """The final rows by subject and study: label, gate, gap in hours, file count (0 if none) and demographics."""
    counts = file_counts(files)
    out = flags.where("in_cohort").join(patients, "subject_id", "left").join(counts, "study_id", "left")
    return out.select(
        "subject_id", "study_id", "record_id", "ts", "record_ts", F.round(F.col("gap_seconds") / 3600.0, 4).alias("delta_hours"), F.col("value").alias("label"), "label_source",
        S.gate("value", threshold).alias("gate"), "path", F.coalesce("n_files", F.lit(0)).alias("n_files"), "stay_id", "start_ts", "end_ts", *[c for c in patients.columns if c != "subject_id"],
    ).orderBy("subject_id", "study_id")


def file_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_files"))


def _bit(i: int) -> Column:
    return F.lit(1 << i).cast("long")


def subject_masks(rows: DataFrame, flags: list[str], subject: str, weight: Column | None = None) -> DataFrame:
    """One row per subject: ``mask``, with a bit per flag that any of its rows has, and n_<flag> rows and w_<flag> of weight with it.

    What follows counts subjects by bits, so that no row is repeated per distinct count.
    """
    on = {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, _bit(i)).otherwise(0) for i, c in enumerate(on.values())])
    weight = F.lit(0) if weight is None else weight
    counts = [x for f, c in on.items() for x in (F.count_if(c).alias(f"n_{f}"), F.sum(F.when(c, weight).otherwise(0)).alias(f"w_{f}"))]
    return rows.groupBy(subject).agg(F.bit_or(mask).alias("mask"), *counts)


def _by_flag(masks: DataFrame, flags: list[str], subject: str) -> DataFrame:
    """(step, flag, n, n_subjects, weight) per flag, from ``subject_masks``; null subjects are no subject."""
    aggs = []
    for i, f in enumerate(flags):
        has = F.col(subject).isNotNull() & (F.col("mask").bitwiseAND(_bit(i)) != 0)
        aggs += [F.coalesce(F.sum(f"n_{f}"), F.lit(0)).alias(f"n{i}"), F.count_if(has).alias(f"u{i}"), F.coalesce(F.sum(f"w_{f}"), F.lit(0)).alias(f"w{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(f).alias("flag"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("n_subjects"), F.col(f"w{i}").alias("weight")) for i, f in enumerate(flags)]))
    return masks.agg(*aggs).select(rows.alias("r")).select("r.*")


def funnel(flags: DataFrame, stages: list[str], *, subject: str = "subject_id", weight: str = "n_files") -> DataFrame:
    """(step, stage, n_studies, n_subjects, n_files, excluded_studies, excluded_files): all stages in one pass over the flags, by masks of subjects."""
    names = [f"s_{s}" for s in stages]
    one = _by_flag(subject_masks(flags, names, subject, F.coalesce(weight, F.lit(0))), names, subject)
    one = one.select("step", F.substring("flag", 3, 1000).alias("stage"), F.col("n").alias("n_studies"), "n_subjects", F.col("weight").alias("n_files"))
    order = W.orderBy("step")  # a row per stage
    return one.withColumn("excluded_studies", F.coalesce(F.lag("n_studies").over(order) - F.col("n_studies"), F.lit(0))).withColumn("excluded_files", F.coalesce(F.lag("n_files").over(order) - F.col("n_files"), F.lit(0)))


def label_sources(flags: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """(label_source, n, mean_label, fallback, pct): how often each name gave the label; pct over accepted rows only."""
    rows = flags.where("s_any_label").groupBy("label_source", F.col("s_accepted").alias("accepted")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_label"))
    total = F.sum(F.when(F.col("accepted"), F.col("n"))).over(W.partitionBy(F.lit(0)))
    pct = F.when(F.col("accepted"), F.lit(100.0) * F.col("n") / total)
    return rows.withColumn("pct", pct).withColumn("fallback", F.col("label_source") != chain[0]).withColumn("rank", S.priority_rank("label_source", chain))


def cohort_summary(rows: DataFrame, label: str = "label", gate: str = "gate", subject: str = "subject_id") -> DataFrame:
    valid = F.col(label).isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(subject).alias("n_subjects"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_missing"), F.avg(label).alias("mean_label"),
        F.stddev_samp(label).alias("std_label"), F.min(label).alias("min_label"), F.max(label).alias("max_label"), F.count_if(valid & F.col(gate)).alias("n_positive"),
        F.try_divide(F.count_if(valid & F.col(gate)).cast("double"), F.count_if(valid)).alias("prevalence"),
    )


def coverage(rows: DataFrame, fields: list[str], missing: Iterable[str] = S.RACE_MISSING) -> DataFrame:
    """(field, present, missing, coverage): values that stand for no answer count as missing."""
    gone = list(missing)
    aggs = []
    for f in fields:
        text = F.upper(F.trim(F.col(f).cast("string")))
        aggs.append(F.count_if(F.col(f).isNotNull() & ~text.isin(*gone)).alias(f))
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields]))
    out = one.select("_n", pairs.alias("p")).select(F.col("p.field").alias("field"), F.col("p.present").alias("present"), (F.col("_n") - F.col("p.present")).alias("missing"), "_n")
    return out.withColumn("coverage", F.try_divide(F.col("present").cast("double"), F.col("_n"))).drop("_n")


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n), null being a value, for several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def scenarios(rows: DataFrame, records: DataFrame, stays: DataFrame, options: dict[str, dict]) -> DataFrame:
    """``rows`` (from ``labelled``) with a flag per scenario: whether the study is in the cohort if paired with these options of ``paired`` and require_stay.

    Labels and overlap are found once and kept in the shared folder, with the columns that ``rows`` has. Which record is paired tells no flag, only that there
    is one, so all scenarios share one scan for the records around a study, one look-up of its stay and one of the stays that have a record. Records and stays
    with a null id count too, unlike in ``cohort_flags``.
    """
    if wrong := {how.get("pair_by", "window") for how in options.values()} - {"window", "stay"}:
        raise ValueError(f"pair_by is {sorted(wrong)[0]!r}, not 'window' or 'stay'")
    rows = shared.stored(rows)
    overlap = F.coalesce("s_overlap", F.lit(False))
    candidates = rows.where(overlap).select("study_id", "subject_id", "ts")
    on = {"on": "subject_id", "start": "start_ts", "end": "end_ts", "widths": pairing.widths_in_use(stays, "start_ts", "end_ts")}
    gaps = pairing.nearest_gaps(candidates, records, on="subject_id", anchor_id="study_id", anchor_ts="ts", record_ts="record_ts")
    spans = stays.select("stay_id", "subject_id", "start_ts", "end_ts")
    spans = spans.join(pairing.spans_with(records, spans, ts="record_ts", **on).withColumn("_has", F.lit(True)), ["subject_id", "start_ts", "end_ts"], "left")
    held = pairing.interval_join(candidates, spans, point_id="study_id", ts="ts", span_id="stay_id", **on).select("study_id", F.lit(True).alias("_held"), "_has")
    flags = {}
    for name, how in options.items():
        near = (F.col("back") <= how.get("before", 86400)) | (F.col("ahead") <= how.get("after", 86400))
        inside = F.col("_held") & F.col("_has") if how.get("pair_by") == "stay" else near & F.col("_held") if how.get("require_stay", True) else near
        flags[name] = F.coalesce(inside, F.lit(False))
    found = rows.where(overlap).join(gaps, "study_id", "left").join(held, "study_id", "left").select(*rows.columns, *[c.alias(name) for name, c in flags.items()])
    return found.unionByName(rows.where(~overlap).withColumns({name: F.lit(False) for name in flags}))


def sensitivity(flags: DataFrame, names: list[str], subject: str = "subject_id") -> DataFrame:
    """(scenario, start_rows, final_rows, final_subjects, excluded, gain, gain_pct): the scenarios that ``flags`` has a column for, against the first, by masks of subjects."""
    one = _by_flag(subject_masks(flags.withColumn("_any", F.lit(True)), [*names, "_any"], subject), [*names, "_any"], subject)
    all_of = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row per scenario
    out = one.withColumn("start_rows", F.last("n").over(all_of)).withColumn("_first", F.first("n").over(all_of)).where(F.col("flag") != "_any")
    out = out.select(F.col("flag").alias("scenario"), "start_rows", F.col("n").alias("final_rows"), F.col("n_subjects").alias("final_subjects"), (F.col("start_rows") - F.col("n")).alias("excluded"), (F.col("n") - F.col("_first")).alias("gain"), "_first")
    return out.withColumn("gain_pct", F.try_divide(F.lit(100.0) * F.col("gain"), F.col("_first"))).drop("_first")


def manifest_summary(rows: DataFrame, a: str, b: str, label: str = "label", split: str = "split") -> DataFrame:
    x, y = F.col(a).isNotNull(), F.col(b).isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(x).alias("with_a"), F.count_if(y).alias("with_b"), F.count_if(x & y).alias("with_both"), F.count_if(F.col(label).isNull()).alias("missing_label"),
        F.count_if(F.col(split).isNull()).alias("missing_split"), F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "val").alias("n_val"), F.count_if(F.col(split) == "test").alias("n_test"),
        F.max(F.size(a)).alias("dim_a"), F.max(F.size(b)).alias("dim_b"),
    )
