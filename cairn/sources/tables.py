"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import scalars as S
from cairn.operators import columns


def read_parquet(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A file or a folder of any depth; only the named columns are read."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.p*q*").parquet(path)
    return df.select(*names) if names else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz", ".gz")):
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    raise ValueError(f"{path}: neither parquet nor csv")


def write_table(df: DataFrame, path: str) -> None:
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        df.write.mode("overwrite").parquet(path)
    elif low.endswith(".csv"):
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"{path}: neither parquet nor csv")


def wide_to_vector(df: DataFrame, *, prefix: str, model: str, subject: str | None = None, study: str | None = None, path: str | None = None, out: str = "embedding") -> DataFrame:
    """(subject_id, study_id, embedding, model) from one column per element; ids from columns or parsed from a path; rows without ids go."""
    names = columns.feature_columns(df.columns, prefix)
    if not names:
        raise ValueError(f"no columns start with {prefix!r}")
    parsed = S.path_ids(path) if path else (None, None)
    ids = [F.col(c).cast("long") if c else p for c, p in zip((subject, study), parsed, strict=True)]
    if any(i is None for i in ids):
        raise ValueError("ids need columns or a path")
    rows = df.select(ids[0].alias("subject_id"), ids[1].alias("study_id"), F.array(*[F.col(n).cast("float") for n in names]).alias(out), F.lit(model).alias("model"))
    return rows.dropna(subset=["subject_id", "study_id"])


def write_shards(df: DataFrame, path: str, folder: str = "folder", order: str | None = None) -> None:
    """One folder per value, written by as many tasks as its share of the rows takes: ranges of folder and ``order``, or of a hash of the row."""
    last = F.col(order) if order else F.xxhash64(*df.columns)
    df.repartitionByRange(F.col(folder), last).write.mode("overwrite").partitionBy(folder).option("compression", "snappy").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, n_null, n_unique, n_duplicate): null is one distinct value. Columns are unpivoted to (column, value) and each pair is counted once, then per column."""

    def text(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c))))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return (F.col(c) + 0.0).cast("string")  # one zero
        return F.hex(F.col(c)) if isinstance(kind, T.BinaryType) else F.col(c).cast("string")

    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in names])).alias("p")).select("p.*")
    counted = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    n_null = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0))
    found = counted.groupBy("column").agg(F.sum("k").alias("n"), n_null.alias("n_null"), F.count(F.lit(1)).alias("n_unique"))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string").join(found, "column", "left")  # a row per column, of an empty table too
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select("column", zero("n"), zero("n_null"), zero("n_unique"), (F.coalesce("n", F.lit(0)) - F.coalesce("n_unique", F.lit(0))).alias("n_duplicate"))


def readiness(df: DataFrame, required: list[str], recommended: list[str] = (), vector: str | None = None) -> dict:
    """Rows, vector length, missing columns, and whether the table can be used."""
    missing = sorted(set(required) - set(df.columns))
    n = df.count()
    dim = columns.vector_dim(df, vector) if vector and vector in df.columns and n else None
    return {"rows": n, "dim": dim, "missing": missing, "missing_recommended": sorted(set(recommended) - set(df.columns)), "ready": not missing and n > 0}


def split_view(df: DataFrame, split: str, vectors: list[str], meta: list[str]) -> DataFrame:
    """The rows of a split that have all vectors, with their metadata as one struct."""
    rows = df.where(F.col("split") == split).dropna(subset=vectors)
    return rows.select(*vectors, F.struct(*[F.col(c) for c in meta if c in df.columns]).alias("meta"))
