"""Subject-level splits, leakage checks, prevalence and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.sources import shared


def shuffled(key: str, seed: int) -> Column:
    """A text that puts keys in a random order, the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def global_rank(df: DataFrame, order: str, by: str | list[str] | None = None, ties: str | None = None) -> DataFrame:
    """Adds rank, from 1, and total, the number of rows, in the order of a hex digest, for all rows or per value of ``by``.

    Counts per bucket of the digest's first digits are summed up first, so no task sees all rows of a value.
    """
    own = [by] if isinstance(by, str) else list(by or [])
    rows = df.withColumn("_b", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(*own, "_b").agg(F.count(F.lit(1)).alias("_k"))
    part = W.partitionBy(*own) if own else W.partitionBy(F.lit(0))
    before = F.sum("_k").over(part.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(own)], F.col("_b").alias("_bucket"), F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_k").over(part).alias("total"))
    inside = F.row_number().over(W.partitionBy(*own, "_b").orderBy(order, *([ties] if ties else [])))
    same = F.col("_b") == F.col("_bucket")
    for i, c in enumerate(own):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    ranked = rows.withColumn("_r", inside).join(base, same).withColumn("rank", F.col("_base") + F.col("_r"))
    return ranked.select(*df.columns, "rank", "total")


def ordered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds rank, from 0 in each value of ``group``, and total, the value's rows, by a range partition of all rows.

    The sorted rows are kept in the shared folder; a row's rank follows from its place in its partition and the counts of the partitions and groups before.
    """
    rows = shared.cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order))
    rows = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    base = counts.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row per partition
    rows = rows.join(base, "_p").withColumn("_at", F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    starts = rows.groupBy(F.col(group).alias("_own")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("total"))
    return rows.join(starts, F.col(group).eqNullSafe(F.col("_own"))).withColumn("rank", F.col("_at") - F.col("_first")).select(*df.columns, "rank", "total")


def subject_split(df: DataFrame, subject: str = "subject_id", fractions=(0.7, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """Adds split: subjects in shuffled order, the first round(n * train) train, the next round(n * val) val, the rest test."""
    if len(fractions) != 3 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("three fractions that sum to 1")
    subjects = df.select(subject).distinct().withColumn("_o", shuffled(subject, seed))
    n = subjects.count()
    train, val = round(n * fractions[0]), round(n * fractions[1])
    ranked = global_rank(subjects, "_o")
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return df.join(ranked.select(subject, split.alias("split")), subject)


def stratified_mask(df: DataFrame, gate: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds is_train: of each class, in shuffled order, the first round(fraction * n)."""
    ranked = global_rank(df.withColumn("_o", shuffled(key, seed)), "_o", gate, key)
    # round half to even, as the cut on the driver would be
    return ranked.withColumn("is_train", F.col("rank") <= F.bround(F.col("total") * F.lit(fraction))).select(*df.columns, "is_train")


def leaking_subjects(df: DataFrame, subject: str = "subject_id", split: str = "split") -> DataFrame:
    return df.groupBy(subject).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def check_leakage(df: DataFrame, subject: str = "subject_id", split: str = "split") -> None:
    bad = leaking_subjects(df, subject, split).orderBy(subject).limit(10).collect()
    if bad:
        raise ValueError(f"subjects in more than one split: {[r[0] for r in bad]}")


def split_prevalence(df: DataFrame, split: str = "split", gate: str = "gate", subject: str = "subject_id", min_per_class: int = 30) -> DataFrame:
    """(split, n, n_subjects, n_positive, n_negative, prevalence, both_classes, enough) per split and overall.

    Counts per subject and split come first; a subject counts once overall by the first of its splits. Null subjects are no subject.
    """
    per = df.groupBy(F.col(subject).alias("_u"), F.col(split).alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(gate)).alias("pos"), F.count_if(~F.col(gate)).alias("neg"))
    own = per.groupBy("_u").agg(F.collect_list(F.struct("_s", "n", "pos", "neg")).alias("_l")).select("_u", F.posexplode("_l").alias("_i", "_x"))  # a subject has few splits
    known = F.col("_u").isNotNull()
    by_split = own.groupBy(F.col("_x._s").alias("_s")).agg(*[F.sum(f"_x.{c}").alias(c) for c in ("n", "pos", "neg")], F.count_if(known).alias("u"), F.count_if(known & (F.col("_i") == 0)).alias("once"))
    both = F.array(F.struct(F.lit(False).alias("all"), F.col("_s").alias("s"), F.col("u").alias("u")), F.struct(F.lit(True).alias("all"), F.lit("overall").alias("s"), F.col("once").alias("u")))
    out = by_split.select("n", "pos", "neg", F.explode(both).alias("_k")).groupBy("_k.all", "_k.s").agg(F.sum("n").alias("n"), F.sum("_k.u").alias("n_subjects"), F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"))
    share = F.try_divide(F.col("n_positive").cast("double"), F.col("n_positive") + F.col("n_negative"))
    return out.select(
        F.col("s").alias("split"), "n", "n_subjects", "n_positive", "n_negative", share.alias("prevalence"),
        ((F.col("n_positive") > 0) & (F.col("n_negative") > 0)).alias("both_classes"), (F.least("n_positive", "n_negative") >= min_per_class).alias("enough"),
    )


def fingerprint(df: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """(by, n, sum_hash): an order-free fingerprint of the distinct ids, for any number of them."""
    ids = df.select(*([by] if by else []), key).distinct()
    group = ids.groupBy(by) if by else ids.groupBy()
    return group.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def sha256_of_ids(df: DataFrame, key: str, by: str, width: int = 100_000, fan: int = 1024) -> DataFrame:
    """(by, n, sha256) of the distinct ids of each split, of any type; null ids don't count.

    Ids in their order (texts by code point), a line each, have one digest as far as ``width`` of them; more are cut into
    pieces of ``width`` ids, whose digests, a line each, are digested ``fan`` at a time, and so on up to one. Ranks come from a range
    partition, so the digest is the same however the rows lie, and no value holds more than a piece.
    """
    ids = ordered(df.select(F.col(by).alias("_by"), F.col(key).alias("_id")).where("_id is not null").distinct(), "_by", ["_id"])
    digest = lambda c, order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), "\n").cast("binary"), 256)
    level = ids.select("_by", "total", "rank", F.col("_id").cast("string").alias("d"), F.floor(F.col("rank") / width).alias("piece"))
    most = level.agg(F.max("piece")).first()[0] or 0
    level = level.groupBy("_by", "total", "piece").agg(digest("d", "rank").alias("d"))
    while most > 0:
        level = level.withColumn("rank", F.col("piece")).withColumn("piece", F.floor(F.col("piece") / fan))
        # a split that has come to its one digest keeps it
        level = level.groupBy("_by", "total", "piece").agg(F.when(F.count(F.lit(1)) == 1, F.max("d")).otherwise(digest("d", "rank")).alias("d"))
        most //= fan
    return level.select(F.col("_by").alias(by), F.col("total").alias("n"), F.col("d").alias("sha256"))


def split_manifest(df: DataFrame, subject: str = "subject_id", split: str = "split") -> DataFrame:
    """Rows, subjects and fingerprint per split, with how many of its subjects are in another split."""
    leak = leaking_subjects(df, subject, split).select(subject, F.lit(1).alias("_l"))
    counts = df.join(leak, subject, "left").groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(subject).alias("n_subjects"), F.count_distinct(F.when(F.col("_l") == 1, F.col(subject))).alias("n_overlap"))
    return counts.join(fingerprint(df, subject, split).drop("n"), split)
