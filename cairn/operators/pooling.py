"""Vector pooling and subsampling."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import scalars as S


def mean_pool(df: DataFrame, keys: list[str], vector: str, out: str = "embedding") -> DataFrame:
    """The mean vector per key in double precision, stored as floats, and n_clips, the vectors that were there.

    Null vectors are left out. Each task keeps one running mean per key; vectors are not exploded. Vectors
    of different lengths fail, as does a table without any vector.
    """
    rows = df.where(F.col(vector).isNotNull())
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low is None:
        raise ValueError("no vectors to pool")
    if low != high:
        raise ValueError(f"vectors have lengths from {low} to {high}")
    means = rows.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"), F.count(F.lit(1)).alias("n_clips"))
    return means.select(*keys, vector_to_array("m").cast("array<float>").alias(out), "n_clips")


def stride_subsample(df: DataFrame, keys: list[str], vector: str, order: list[str], k: int) -> DataFrame:
    """Per key at most ``k`` vectors, evenly spread in the order given; adds n_clips, the number of rows.

    Of the vectors that are there, numbered from 0, number i stays if the rows are at most k or
    ``(i * k) mod rows < k``; rows count null vectors too. Only ids are ranked; the vectors join afterwards.
    """
    ids = df.select(*keys, *order, F.col(vector).isNotNull().alias("_ok"))
    by = W.partitionBy(*keys)
    running = F.sum(F.col("_ok").cast("int")).over(by.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = ids.withColumn("n_clips", F.count(F.lit(1)).over(by)).withColumn("_i", running - 1).where("_ok")
    kept = ranked.where((F.col("n_clips") <= k) | ((F.col("_i") * k) % F.col("n_clips") < k)).select(*keys, *order, "n_clips")
    return df.join(kept, [*keys, *order])


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """(n_vectors, n_elements, mean, std, all_finite) over all elements; std over the population."""
    v = F.col(vector)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    one = df.where(v.isNotNull()).agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(F.size(v)).alias("n_elements"), F.sum(total).alias("s"), F.sum(squares).alias("q"), F.coalesce(F.bool_and(S.finite(v)), F.lit(True)).alias("all_finite"))
    mean = F.col("s") / F.col("n_elements")
    return one.select("n_vectors", "n_elements", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n_elements") - mean * mean)).alias("std"), "all_finite")


#: Length of tokens from which matrix products on Arrow batches are faster than array expressions.
LONG_TOKENS = 512


def attentive_pool(df: DataFrame, tokens: str, query: list[float], out: str = "pooled", long_tokens: int = LONG_TOKENS) -> DataFrame:
    """Tokens pooled by softmax attention to a given query; null tokens get no weight, a row without tokens gets null.

    Adds weights, one per token that is there, and ``out``. Queries of ``long_tokens`` elements or more go through one
    matrix product per Arrow batch, shorter ones through expressions; the results are the same. A token of another length is an error.
    """
    there = F.filter(F.col(tokens), lambda t: t.isNotNull())
    if len(query) < long_tokens:
        rows = df.withColumn("_t", there).withColumn("weights", S.attention("_t", query))
        return rows.withColumn(out, F.when(F.size("_t") > 0, S.pooled("_t", "weights", len(query)))).drop("_t")
    q = np.array(query, float)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(column.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            sizes[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
            lists = column.flatten()
            if len(lists) and set(np.unique(np.diff(lists.offsets.to_numpy()))) != {len(q)}:
                raise ValueError(f"tokens are not all of {len(q)} elements")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            scores = x @ q / np.sqrt(len(q))
            some = np.flatnonzero(sizes)
            start = (np.cumsum(sizes) - sizes)[some]
            top = np.zeros(batch.num_rows)
            if len(some):
                top[some] = np.maximum.reduceat(scores, start)
            e = np.exp(scores - top[row])
            weights = e / np.bincount(row, weights=e, minlength=batch.num_rows)[row]
            pooled = [None] * batch.num_rows
            if len(some):
                for i, v in zip(some.tolist(), np.add.reduceat(weights[:, None] * x, start), strict=True):
                    pooled[i] = v
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            given = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*given, pa.ListArray.from_arrays(offsets, pa.array(weights)), pa.array(pooled, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "weights", out])

    schema = T.StructType([*df.schema.fields, T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select("*", there.cast("array<array<double>>").alias("_t")).mapInArrow(run, schema)


def attention_spread(df: DataFrame, weights: str) -> DataFrame:
    """How far attention is from even: per row max minus min and population std of the weights, then their mean and maximum."""
    w = F.col(weights)
    std = S.let(S.mean_of(w), lambda mean: F.sqrt(S.mean_of(F.transform(w, lambda x: (x - mean) * (x - mean)))))
    # null where there is none: a filter would find the weights twice
    some = lambda c: F.when(F.size(w) > 0, c)
    rows = df.select(some(F.array_max(w) - F.array_min(w)).alias("r"), some(std).alias("d"))
    return rows.agg(F.avg("r").alias("mean_range"), F.max("r").alias("max_range"), F.avg("d").alias("mean_std"), F.max("d").alias("max_std"))
