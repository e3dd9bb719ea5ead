"""Validated joins, comparisons and overlap counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_m2o(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", flag: str | None = None, allow_fanout: bool = False) -> DataFrame:
    """A many-to-one join: an error if a key repeats on the right, before anything is joined. ``flag`` tells which rows matched."""
    if not allow_fanout and (bad := duplicate_keys(right, on).limit(10).collect()):
        raise ValueError(f"right side is not unique on {on}: {[tuple(r) for r in bad]}")
    if flag:
        right = right.withColumn(flag, F.lit(True))
    out = left.join(right, on, how)
    return out.withColumn(flag, F.coalesce(flag, F.lit(False))) if flag else out


def build_manifest(cohort: DataFrame, a: DataFrame, b: DataFrame, on_a: list[str], on_b: list[str]) -> DataFrame:
    """A cohort with the vectors of two modalities and has_a, has_b, has_both."""
    out = join_m2o(join_m2o(cohort, a, on_a, flag="has_a"), b, on_b, flag="has_b")
    return out.withColumn("has_both", F.col("has_a") & F.col("has_b"))


def replace_vectors(manifest: DataFrame, vectors: DataFrame, on: list[str], columns: list[str], flag: str = "has_a") -> DataFrame:
    """The manifest with some columns taken from another table; all else is unchanged."""
    if missing := [c for c in (*on, *columns) if c not in vectors.columns]:
        raise ValueError(f"missing columns {missing}")
    kept = manifest.drop(*columns, flag)
    out = join_m2o(kept, vectors.select(*on, *columns), on, flag=flag)
    return out.select(*manifest.columns, *[c for c in columns if c not in manifest.columns])


def join_three(cohort: DataFrame, a: DataFrame, b: DataFrame, on_a: str, on_b: str) -> DataFrame:
    return cohort.join(a, on_a).join(b, on_b)


def join_canonical(cohort: DataFrame, vectors: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """A left join on the digits of the last path part of both ids."""
    right = vectors.withColumn("_key", S.canonical_id(right_id)).drop(right_id)
    return cohort.withColumn("_key", S.canonical_id(left_id)).join(right, "_key", "left").drop("_key")


def enrich(files: DataFrame, records: DataFrame, studies: DataFrame, path: str = "path") -> DataFrame:
    """Files with ids and times: by their path in ``records`` (path, subject_id, study_id), else parsed from the path; then the study's time."""
    subject, study = S.path_ids_fallback(F.col(path))
    known = records.select(F.col("path").alias(path), F.col("subject_id").alias("_su"), F.col("study_id").alias("_st"), F.lit(True).alias("_known"))
    out = files.join(known, path, "left").withColumn("subject_id", F.coalesce("_su", subject)).withColumn("study_id", F.coalesce("_st", study))
    out = out.withColumn("by_record", F.coalesce("_known", F.lit(False))).drop("_su", "_st", "_known")
    return out.join(studies.select("subject_id", "study_id", "study_ts"), ["subject_id", "study_id"], "left")


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    """(n, n_by_record, n_by_path, n_without_ids, n_with_time): how the rows of ``enrich`` came to their ids."""
    known, ids = F.col("by_record"), F.col("subject_id").isNotNull() & F.col("study_id").isNotNull()
    return enriched.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_by_record"), F.count_if(~known & ids).alias("n_by_path"), F.count_if(~ids).alias("n_without_ids"), F.count("study_ts").alias("n_with_time")
    )


def missing_ids(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What is still to do: rows of ``wanted`` whose key is not cached."""
    return wanted.join(cached.select(key), key, "left_anti")


def check_aligned(predictions: DataFrame, *, example: str = "example_id", condition: str = "condition", label: str = "y") -> None:
    """Raises unless every condition scores the same examples, each once and with one label."""
    n = predictions.select(condition).distinct().count()
    per = predictions.groupBy(example).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(condition).alias("k"), F.count_distinct(label).alias("labels"))
    bad = per.where((F.col("n") != n) | (F.col("k") != n) | (F.col("labels") != 1)).limit(5).collect()
    if bad:
        raise ValueError(f"conditions are not aligned, for example at {[r[0] for r in bad]}")


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(shared, only_old, only_new, changed): one row of counts between two cohorts."""
    both = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_in_o")).join(new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in_n")), key, "full_outer")
    o, n = F.col("_in_o").isNotNull(), F.col("_in_n").isNotNull()
    return both.agg(
        F.count_if(o & n).alias("shared"), F.count_if(o & ~n).alias("only_old"), F.count_if(~o & n).alias("only_new"), F.count_if(o & n & ~F.col("_o").eqNullSafe(F.col("_n"))).alias("changed")
    )


def overlap(studies: DataFrame, records: DataFrame, subject: str, study: str, record: str) -> DataFrame:
    """(shared_subjects, studies_of_shared, candidate_pairs, same_ids) from per-subject counts, without building pairs."""
    a = studies.groupBy(subject).agg(F.count_distinct(study).alias("n_a"))
    b = records.groupBy(subject).agg(F.count_distinct(record).alias("n_b"))
    counts = a.join(b, subject).agg(F.count(F.lit(1)).alias("shared_subjects"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("studies_of_shared"), F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("candidate_pairs"))
    same = studies.select(F.col(study).alias("_id")).distinct().join(records.select(F.col(record).alias("_id")).distinct(), "_id", "left_semi").agg(F.count(F.lit(1)).alias("same_ids"))
    return counts.withColumn("_k", F.lit(1)).join(same.withColumn("_k", F.lit(1)), "_k").drop("_k")


def vector_coverage(rows: DataFrame, by: str, a: DataFrame, b: DataFrame, on_a: str, on_b: str) -> DataFrame:
    """Rows with a vector of either modality and of both, per scenario."""
    found = rows.join(a.select(on_a).distinct().withColumn("_a", F.lit(True)), on_a, "left").join(b.select(on_b).distinct().withColumn("_b", F.lit(True)), on_b, "left")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(x).alias("with_a"), F.count_if(y).alias("with_b"), F.count_if(x & y).alias("with_both"))
