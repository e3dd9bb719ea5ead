"""Prediction dumps: JSON files with an object of parallel arrays per condition, read in byte ranges by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import splits
from cairn.sources import shared

#: The arrays of a condition, by name, and the types of their elements.
FIELDS = {"y": "double", "pred": "double", "gate": "boolean"}
#: Examples of a file that ``write_dumps`` writes.
FILE_ROWS = 100_000


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, token): what stands between the commas of each file, and its number in the file.

    Spark reads a file in byte ranges, cut at commas. Tokens are numbered by range first, and counts per range give where each range begins.
    """
    raw = spark.read.option("lineSep", ",").option("pathGlobFilter", "*").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("n"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("token"))
    ranges = raw.groupBy("file", "range").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("k"))
    before = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    ranges = ranges.select("file", "range", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    return raw.join(F.broadcast(ranges), ["file", "range"]).select("file", (F.col("base") + F.col("n") - F.col("first")).alias("at"), "token")


def _arrays(tokens: DataFrame) -> DataFrame:
    """(file, condition, field, lo, hi): the token numbers of the first and last element of each array; hi < lo if it is empty.

    An array begins where a token has ``[``, after its name, and the names of the objects that begin with it. Few tokens do.
    """
    marks = tokens.where(F.col("token").rlike(r"[\[\]]"))
    names = F.regexp_extract_all(F.substring_index("token", "[", 1), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1)
    opens, closes = F.contains("token", F.lit("[")), F.contains("token", F.lit("]"))
    order = W.partitionBy("file").orderBy("at")
    marks = marks.withColumn("opens", opens).withColumn("closes", closes).withColumn("names", F.when(F.col("opens"), names))
    marks = marks.withColumn("condition", F.last(F.get("names", F.size("names") - 2), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    marks = marks.withColumn("next", F.lead(F.struct("at", "opens", "closes")).over(order))
    hi = F.when(F.col("closes"), F.when(F.col("token").rlike(r"\[\s*\]"), F.col("at") - 1).otherwise(F.col("at"))).when(F.col("next.closes") & ~F.col("next.opens"), F.col("next.at"))
    field = F.last(F.get("names", F.size("names") - 1), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))  # an array without a name is inside another
    return marks.withColumn("field", field).where("opens").select("file", "condition", "field", F.col("at").alias("lo"), hi.alias("hi"), F.col("token").rlike(r"\[\s*\[").alias("nested"))


def read_dumps(spark: SparkSession, path: str, conditions: list[str], fields: dict[str, str] | None = None) -> DataFrame:
    """(file, condition, position, and each field) from a JSON file, or a folder of them, with an object of parallel arrays per condition.

    The arrays hold numbers, booleans and nulls; the objects of the conditions may lie in another, and what else the file holds is passed over. A file without one
    of the conditions or fields, with an array inside an array, or with arrays of unequal lengths is an error. Positions count from 0. A file is read by as many tasks as it has
    byte ranges, and no value ever holds a whole array.
    """
    fields = fields or FIELDS
    tokens = _tokens(spark, path)
    marks = shared.cut(_arrays(tokens))  # few rows per file, found once for the checks and the cells
    arrays = marks.where(F.col("condition").isin(conditions) & F.col("field").isin(*fields))
    told = arrays.groupBy("file").agg(F.count_distinct("condition", "field").alias("n"), (F.count_if(F.col("hi").isNull() | F.col("nested")) + F.count(F.lit(1)) - F.count_distinct("condition", "field")).alias("open"))
    lengths = arrays.groupBy("file", "condition").agg(F.array_sort(F.collect_list(F.struct("field", (F.col("hi") - F.col("lo") + 1).alias("n")))).alias("l"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).where("length > 0").select(F.col("_metadata.file_path").alias("file")).join(told, "file", "left")
    if bad := files.where(F.coalesce("open", F.lit(0)) > 0).select("file").first():
        raise ValueError(f"{bad['file']}: arrays inside arrays")
    if bad := files.where(F.coalesce("n", F.lit(0)) < len(conditions) * len(fields)).select("file").first():
        raise ValueError(f"{bad['file']}: no predictions for some of {conditions} and {list(fields)}")
    if bad := lengths.where(F.size(F.array_distinct(F.transform("l", lambda x: x["n"]))) > 1).first():
        raise ValueError(f"{bad['file']}: arrays of {bad['condition']} have lengths {[tuple(x) for x in bad['l']]}")
    # the arrays of a file's condition by one number, so that few bytes go with each cell
    slots = arrays.select("file", "condition").distinct().withColumn("slot", F.row_number().over(W.orderBy("file", "condition")))
    own = arrays.join(slots, ["file", "condition"]).select(F.col("file").alias("f"), "slot", "field", "lo", "hi")
    value = F.trim(F.regexp_replace("token", r'^[^\[]*\[|\].*$|"', ""))
    cells = tokens.join(F.broadcast(own), (F.col("file") == F.col("f")) & F.col("at").between(F.col("lo"), F.col("hi"))).select("slot", (F.col("at") - F.col("lo")).alias("position"), "field", F.when(value != "null", value).alias("v"))
    # values of their own types fit a hash table, as texts do not
    rows = cells.groupBy("slot", "position").agg(*[F.max(F.when(F.col("field") == f, F.col("v")).cast(kind)).alias(f) for f, kind in fields.items()])
    return rows.join(F.broadcast(slots), "slot").select("file", "condition", "position", *fields)


def write_dumps(df: DataFrame, path: str, *, condition: str = "condition", key: str = "example_id", fields: list[str] = ("y", "pred", "gate"), conditions: list[str], rows: int = FILE_ROWS) -> None:
    """Writes ``df`` as dumps of about ``rows`` examples each, one file per bucket of the shuffled key, in the order of the key.

    Every file has all ``conditions``; the key is one of the arrays.
    """
    n = df.select(key).distinct().count()
    buckets = max(1, -(-n // rows))
    names = [key, *fields]
    bucket = F.pmod(F.conv(F.substring(splits.shuffled(key, 0), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    lists = df.groupBy(bucket.alias("bucket"), F.col(condition).alias("condition")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("l"))
    empty = F.struct(*[F.array().cast(f"array<{df.schema[f].dataType.simpleString()}>").alias(f) for f in names])
    one = lambda c: F.coalesce(F.max(F.when(F.col("condition") == c, F.struct(*[F.col("l")[f].alias(f) for f in names]))), empty).alias(c)
    body = lists.groupBy("bucket").agg(*[one(c) for c in conditions])
    body.select("bucket", F.to_json(F.struct(*conditions), {"ignoreNullFields": "false"}).alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)
