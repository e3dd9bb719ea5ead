"""Filters and checks. Checks raise; filters keep rows and say how many they dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S


def drop_non_finite(df: DataFrame, label: str | None, vectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows whose label and vector elements are all finite, and one row with n_kept and n_dropped."""
    ok = F.lit(True)
    for v in vectors:
        ok = ok & F.coalesce(S.finite(v), F.lit(False))
    if label:
        ok = ok & F.coalesce(S.null_safe(F.col(label).cast("double")).isNotNull(), F.lit(False))
    counts = df.agg(F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped"))
    return df.where(ok), counts


def require_vectors(df: DataFrame, vectors: list[str]) -> DataFrame:
    return df.dropna(subset=vectors)


def eligible_strata(counts: DataFrame, least: int = 5) -> DataFrame:
    """Strata with at least ``least`` positives and negatives; unnamed and unknown ones never."""
    named = F.col("value").isNotNull() & ~F.lower("value").isin("unknown", "nan", "")
    return counts.where(named & (F.col("n_pos") >= least) & (F.col("n") - F.col("n_pos") >= least))


def check_splits(df: DataFrame, split: str = "split", expected=("train", "val", "test")) -> None:
    """Raises if a split is null, missing, empty or unexpected."""
    names = {r[0] for r in df.select(split).distinct().limit(len(expected) + 20).collect()}
    if names != set(expected):
        raise ValueError(f"splits {sorted(map(str, names))}, expected {sorted(expected)}")


def check_conditions(names, known=S.CONDITIONS) -> None:
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown conditions {bad}, known are {list(known)}")


def bad_booleans(df: DataFrame, column: str) -> DataFrame:
    """Texts of a column that are no boolean, with counts."""
    return df.where(F.col(column).isNotNull() & S.boolean(column).isNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
