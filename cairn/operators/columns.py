"""Column resolution and normalisation, on schema metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.scalars import gate

COHORT_REQUIRED = {"subject_id": ("subject_id", "subject"), "study_id": ("study_id", "study"), "record_id": ("record_id", "record"), "label": ("label", "value")}
COHORT_OPTIONAL = {"split": ("split",), "sex": ("sex", "gender"), "age": ("age",), "race": ("race",), "gate": ("gate",)}
METADATA = ("subject_id", "study_id", "record_id", "label", "gate", "split", "sex", "age", "age_band", "race", "label_source", "n_clips", "model_a", "model_b", "has_both")


def resolve(df: DataFrame, candidates: tuple[str, ...] | list[str]) -> str | None:
    """The first candidate that is a column: exactly, else by case-insensitive name, candidate by candidate."""
    low = {}
    for c in df.columns:
        low.setdefault(c.lower(), c)
    for name in candidates:
        if name in df.columns:
            return name
        if name.lower() in low:
            return low[name.lower()]
    return None


def require(df: DataFrame, candidates, explicit: str | None = None) -> str:
    """As ``resolve``; an explicit name wins, and a missing column is an error that lists what there is."""
    if explicit is not None:
        candidates = (explicit,)
    found = resolve(df, candidates)
    if found is None:
        raise ValueError(f"none of {list(candidates)} among the columns {df.columns}")
    return found


def normalize_cohort(df: DataFrame, threshold: float = 40.0, **explicit: str) -> DataFrame:
    """Standard names for a cohort: required columns must exist, optional ones are added as null, a missing gate comes from the label."""
    out = {}
    for name, candidates in COHORT_REQUIRED.items():
        out[name] = F.col(require(df, candidates, explicit.get(name)))
    for name, candidates in COHORT_OPTIONAL.items():
        found = require(df, candidates, explicit[name]) if name in explicit else resolve(df, candidates)
        out[name] = F.col(found) if found else F.lit(None).cast("boolean" if name == "gate" else "string")
    out["gate"] = F.coalesce(out["gate"].cast("boolean"), gate(out["label"], threshold))
    used = {require(df, c, explicit.get(n)) for n, c in COHORT_REQUIRED.items()} | {f for n, c in COHORT_OPTIONAL.items() if (f := explicit.get(n) or resolve(df, c))}
    rest = [F.col(c) for c in df.columns if c not in used and c not in out]
    return df.select(*[c.alias(n) for n, c in out.items()], *rest)


def feature_columns(columns: list[str], prefix: str) -> list[str]:
    """Columns with the prefix in any case, by length and then name, so that ve2 comes before ve10."""
    return sorted((c for c in columns if c.lower().startswith(prefix.lower())), key=lambda c: (len(c), c))


def metadata(df: DataFrame, names=METADATA) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def is_matrix(df: DataFrame, vector: str) -> bool:
    kind = df.schema[vector].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)


def vector_dim(df: DataFrame, vector: str) -> int | None:
    """The common length of the vectors (of the inner ones for clip-level columns); an error if they differ, None if there are none."""
    if is_matrix(df, vector):
        sizes = df.select(F.explode(vector).alias("_v")).select(F.size("_v").alias("n"))
    else:
        sizes = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n"))
    low, high = sizes.agg(F.min("n"), F.max("n")).first()
    if low != high:
        raise ValueError(f"{vector}: vectors have lengths from {low} to {high}")
    return low


def spread(df: DataFrame, vector: str, n: int, prefix: str = "ve") -> DataFrame:
    """One column per element."""
    if is_matrix(df, vector):
        raise ValueError(f"{vector} holds one vector per clip; pool it first")
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(f"{prefix}{i}") for i in range(n)])
