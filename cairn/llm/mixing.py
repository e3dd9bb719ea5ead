"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import WORD, cut, hash_order

#: The fractional part of the golden ratio: its multiples fill the unit interval evenly.
GOLDEN = 0.6180339887498949
#: Slots of the schedule to aim at for small inputs, and tokens of a block at most.
MIN_SLOTS, MAX_BLOCK = 65536, 4096
#: Documents of a source that are put in order together.
BUCKET = 4096
#: Slices of the unit interval on which slots and sources are joined.
SLICES = 4096
#: Sources up to which their table is sent to the tasks.
MOST_SOURCES = 100_000


def sized(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): size is the number of words; a null text has none."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3) -> DataFrame:
    """(source, n, source_size, weight, total, target) per source.

    Sources in code point order, null last, take ``weights`` in turn and share the total size; a target
    stops at ``max_passes`` times its source's size, and the excess goes to the others by weight. Taken in
    the order of size per weight, a source stops exactly if its share of what is left would exceed its
    limit, so one running sum over the table of sources settles all of them. That table, a row of numbers per
    source, goes through one task: it is meant for up to some millions of sources, not for one per document.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight.cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_passes)
    everything = W.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("weight"), "rn").rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", (F.col("total") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("free", F.sum(F.when(F.col("stops"), F.lit(0)).otherwise(F.col("weight"))).over(everything))
    )
    share = F.col("left").cast("double") * F.col("weight") / F.col("free")
    return per.select("source", "n", "source_size", "weight", "total", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"), "rn")


def block_tokens(total: int) -> int:
    return max(1, min(MAX_BLOCK, total // MIN_SLOTS))


def schedule(goals: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, source_rn): the source of each slot, from golden-ratio points mapped through the cumulative targets."""
    upto = W.partitionBy(F.lit(0)).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    spans = goals.where("target > 0").select("rn", F.sum("target").over(upto).alias("upto"))
    spans = spans.select("rn", (F.col("upto") / F.max("upto").over(W.partitionBy(F.lit(0)))).alias("hi"))
    # the start of a span is the end of the one before, to the last bit
    spans = spans.select("rn", F.coalesce(F.lag("hi").over(W.partitionBy(F.lit(0)).orderBy("rn")), F.lit(0.0)).alias("lo"), "hi")
    slice_of = lambda x: F.least(F.floor(x * SLICES), F.lit(SLICES - 1)).cast("int")
    spans = spans.select("rn", "lo", "hi", F.explode(F.sequence(slice_of(F.col("lo")), slice_of(F.col("hi")))).alias("slice"))
    spark = goals.sparkSession
    point = F.col("id") * F.lit(GOLDEN)
    slots = spark.range(1, total // block + 1).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x"))
    slots = slots.withColumn("slice", slice_of(F.col("x")))
    return slots.join(spans, "slice").where("x >= lo and x < hi").select("slot", "rn", "x")


def ranked(slots: DataFrame, chunk: int = 4096) -> DataFrame:
    """Adds rank, the slot's number among its source's slots from 0: the block of the source's shuffled stream that it reads.

    Counts per source and run of ``chunk`` slots are summed up first, so that no source is ranked in one task.
    """
    slots = slots.withColumn("run", F.floor(F.col("slot") / chunk))
    counts = slots.groupBy("rn", "run").agg(F.count(F.lit(1)).alias("k"))
    base = counts.select("rn", "run", F.coalesce(F.sum("k").over(W.partitionBy("rn").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("rn", "run").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(base, ["rn", "run"]).select("slot", "rn", (F.col("base") + F.col("inside")).alias("rank"))


def streams(sizes: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, rn, start): the place of each document in its source's shuffled token stream.

    The shuffle is the order of a hash of the id. Sums per source and bucket of that order come first, so
    a source with a third of all documents is laid out by as many tasks as it has buckets.
    """
    hot = hash_order(F.col("doc_id"), seed)
    keyed = sizes.withColumn("h", hot).join(goals.select(F.col("source").alias("s"), "rn", "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = F.ceil(F.col("n") / BUCKET)
    keyed = keyed.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 60)) * buckets))
    sums = keyed.groupBy("rn", "bucket").agg(F.sum("size").alias("k"))
    base = sums.select("rn", "bucket", F.coalesce(F.sum("k").over(W.partitionBy("rn").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = W.partitionBy("rn", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum("size").over(order)).join(base, ["rn", "bucket"])
    return placed.select("doc_id", "source", "size", "rn", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))


def pieces(placed: DataFrame, block: int, max_passes: int) -> DataFrame:
    """(rn, start, rank, words): what each document gives to each block of its source's stream, which is repeated ``max_passes`` times.

    Blocks of ``block`` tokens each are numbered from 0 and run on from the end of one pass to the start of the next.
    """
    rows = placed.where("size > 0").select("rn", "start", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass"))
    rows = rows.select("rn", "start", "size", (F.col("start") + F.col("pass") * F.col("source_size")).alias("at"))
    div = lambda x: F.expr(f"({x}) div {block}")
    rows = rows.withColumn("rank", F.explode(F.sequence(div("at"), div("at + size - 1"))))
    words = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block) - F.greatest(F.col("at"), F.col("rank") * block)
    return rows.select("rn", "start", "rank", words.alias("words"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_passes: int = 3, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes.

    A schedule gives each slot a source; the k-th slot of a source is joined with the k-th block of equal
    token count of the source's shuffled stream, which starts again at its end, up to ``max_passes`` times; a document
    gives the words that it shares with the blocks so joined. One row per input row, in any table: an empty or null text
    has size 0 and nothing taken; null sources are one source; repeated rows and ids count once each; a table without words takes nothing.
    Reruns give the same mix. Other columns are not read.
    """
    sizes = cut(sized(docs, doc_id=doc_id, text=text, source=source))
    goals = cut(targets(sizes, weights=weights, max_passes=max_passes))
    total = goals.agg(F.max("total").alias("total")).first()["total"] or 0
    block = block_tokens(total)
    placed = cut(streams(sizes, goals, seed).join(F.broadcast(goals.select("rn", "source_size", "target")) if goals.count() <= MOST_SOURCES else goals.select("rn", "source_size", "target"), "rn"))
    slots = ranked(schedule(goals, total, block)).select("rn", "rank")
    read = pieces(placed, block, max_passes).join(slots, ["rn", "rank"]).groupBy("rn", "start").agg(F.sum("words").alias("taken"))
    # a document with words is known by its place in its source
    some = placed.where("size > 0").join(read, ["rn", "start"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(placed.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
