"""Nearest-record pairing, interval joins and priority picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S


def _best(columns: list[str], order: list[Column]) -> Column:
    """The struct of ``columns`` of the row that is least by ``order``; ``min_by`` combines before the shuffle and needs no sort."""
    return F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the least by ``order`` (nulls first)."""
    rest = [c for c in df.columns if c != key]
    nulls_first = [x for o in order for x in (o.isNotNull(), o)]
    return df.groupBy(key).agg(_best(rest, nulls_first).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def priority_pick(measurements: DataFrame, *, key: str, name: str, value: Column, lo: float, hi: float, chain: list[str], excluded: list[str], ties: list[str]) -> DataFrame:
    """(key, value, name, accepted): one in-range reading per key, chain names first and in their order.

    ``excluded`` names are ranked behind the chain and never accepted, so a key that has only those is
    seen, and counted, as not accepted.
    """
    names = list(dict.fromkeys([*chain, *sorted(excluded)]))
    rows = measurements.where(F.col(name).isin(*names)).select(key, S.priority_rank(name, names).alias("_place"), value.alias("_v"), *ties)
    # a reading is parsed once: a test of the range above the parsing would be pushed below it, and parse again
    valid = F.col("_v").between(lo, hi)
    rows = rows.withColumn("_p", F.when(valid, F.col("_place")))
    # the place has an aggregate of its own, so that who takes no value sums up small numbers by hash
    best = F.min_by("_v", F.when(valid, F.struct("_place", *ties)))
    picked = rows.groupBy(key).agg(F.min("_p").alias("_p"), best.alias("value")).where("_p is not null")
    return picked.select(key, "value", F.array(*map(F.lit, names))[F.col("_p")].alias("label_source"), (F.col("_p") < len(set(chain))).alias("accepted"))


def _second(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def _around(seconds: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(_anchor, _sec, _prev, _next): each of ``marks`` (_on, _sec, _anchor; none null) with the _rec of the last of ``seconds`` (_on, _sec, _rec; each second once) up to it and of the first after it.

    Both are laid in one order of time by subject and bucket of ``width`` seconds; what a bucket lacks is carried over from the nearest bucket that has one.
    """
    events = seconds.select("_on", "_sec", F.lit(0).alias("_kind"), "_rec").unionByName(marks.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_sec") / width))
    # running aggregates both ways, each from its own end: at equal seconds a record counts as before
    at = W.partitionBy("_on", "_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = lambda order: F.last("_rec", ignorenulls=True).over(at.orderBy(*order))
    scanned = events.withColumn("_prev", last(["_sec", "_kind"])).withColumn("_next", last([F.desc("_sec"), F.desc("_kind")])).where("_kind = 1")
    # of each bucket its first and last record go to the buckets after and before it
    ends = seconds.select("_on", F.floor(F.col("_sec") / width).alias("_bucket"), "_sec", "_rec").groupBy("_on", "_bucket").agg(F.min_by("_rec", "_sec").alias("_head"), F.max_by("_rec", "_sec").alias("_tail"))
    ends = ends.unionByName(marks.select("_on", F.floor(F.col("_sec") / width).alias("_bucket")).distinct(), allowMissingColumns=True)
    other = W.partitionBy("_on").rangeBetween(W.unboundedPreceding, -1)
    carried = ends.select("_on", "_bucket", "_head", F.last("_tail", ignorenulls=True).over(other.orderBy("_bucket")).alias("_before"), F.last("_head", ignorenulls=True).over(other.orderBy(-F.col("_bucket"))).alias("_after")).where("_head is null")
    return scanned.join(carried, ["_on", "_bucket"]).select("_anchor", "_sec", F.coalesce("_prev", "_before").alias("_prev"), F.coalesce("_next", "_after").alias("_next"))


def nearest_join(
    anchors: DataFrame, records: DataFrame, *, on: str, anchor_id: str, anchor_ts: str, record_ts: str, record_id: str, before: int, after: int, how: str = "inner", bucketed: bool = False, bucket_seconds: int = 30 * 86400
) -> DataFrame:
    """``anchors`` with the record nearest in time, at most ``before`` seconds earlier and ``after`` later, both inclusive.

    Adds the record's columns (but ``on``) and gap_seconds. Nearest by the absolute gap in whole seconds, then by record
    time, then record id. No pairs are made: of each second the first record is kept, anchors and records are laid in one
    order of time by subject and bucket of ``bucket_seconds``, and each anchor takes the last record up to it and the first after it, from its own
    bucket or, carried over, from the nearest bucket that has one. ``bucketed`` makes buckets as wide as the window, for long
    histories; the pairs are the same.
    """
    own = [c for c in records.columns if c != on]
    width = max(1, before + after) if bucketed else bucket_seconds
    seconds = records.where(F.col(on).isNotNull()).select(F.col(on).alias("_on"), _second(record_ts).alias("_sec"), *own).where("_sec is not null")
    seconds = seconds.groupBy("_on", "_sec").agg(_best(own, [F.col(record_ts), F.col(record_id)]).alias("_rec"))
    marks = anchors.select(F.col(on).alias("_on"), _second(anchor_ts).alias("_sec"), F.struct(*anchors.columns).alias("_anchor"))
    placed = F.col("_on").isNotNull() & F.col("_sec").isNotNull()
    hits = _around(seconds.withColumn("_rec", F.struct("_sec", "_rec")), marks.where(placed), width)
    back, ahead = F.col("_sec") - F.col("_prev._sec"), F.col("_next._sec") - F.col("_sec")
    near = F.when((back <= before) & ~F.coalesce((ahead <= after) & (ahead < back), F.lit(False)), F.col("_prev")).when(ahead <= after, F.col("_next"))
    found = hits.select("_anchor", near.alias("_r"), (near["_sec"] - F.col("_sec")).alias("gap_seconds"))
    if how == "inner":
        found = found.where("_r is not null")
    else:
        found = found.unionByName(marks.where(~placed).select("_anchor"), allowMissingColumns=True)
    return found.select(*[F.col(f"_anchor.{c}").alias(c) for c in anchors.columns], *[F.col(f"_r._rec.{c}").alias(c) for c in own], "gap_seconds")


def nearest_gaps(anchors: DataFrame, records: DataFrame, *, on: str, anchor_id: str, anchor_ts: str, record_ts: str, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """(anchor_id, back, ahead): whole seconds back to the last record up to each anchor and ahead to the first after it, null if there is none.

    A record lies in a window exactly if one of the two does, so windows of any width are told from one scan, which carries no columns of the records. Anchors without subject or time are left out.
    """
    seconds = records.select(F.col(on).alias("_on"), _second(record_ts).alias("_sec")).where("_on is not null and _sec is not null").distinct().withColumn("_rec", F.col("_sec"))
    marks = anchors.select(F.col(on).alias("_on"), _second(anchor_ts).alias("_sec"), F.col(anchor_id).alias("_anchor")).where("_on is not null and _sec is not null")
    hits = _around(seconds, marks, bucket_seconds)
    return hits.select(F.col("_anchor").alias(anchor_id), (F.col("_sec") - F.col("_prev")).alias("back"), (F.col("_next") - F.col("_sec")).alias("ahead"))


#: Widths of the buckets that spans are filed under grow by this factor, up to over a thousand years.
GROWTH, WIDTHS = 4, 18


def _width(start: str, end: str) -> Column:
    """The number of the narrowest width that is as long as the span."""
    length = _second(end) - _second(start) + 1
    return reduce(lambda a, b: a + b, [F.when(length > GROWTH**k, 1).otherwise(0) for k in range(WIDTHS)])


def widths_in_use(spans: DataFrame, start: str, end: str) -> list[int]:
    """The numbers of the widths that ``spans`` are filed under, at most ``WIDTHS``: one small job."""
    return sorted(r[0] for r in spans.where(F.col(start) <= F.col(end)).select(_width(start, end).alias("w")).distinct().collect())


def spans_with(points: DataFrame, spans: DataFrame, *, on: str, ts: str, start: str, end: str, widths: list[int] | None = None) -> DataFrame:
    """(on, start, end) of the spans that hold any of ``points``, each once."""
    bounds = [on, *dict.fromkeys((start, end))]
    near = probed(points.select(on, ts), spans.select(*bounds).distinct(), on=on, ts=ts, start=start, end=end, widths=widths)
    return near.where(F.col(ts).between(F.col(start), F.col(end))).select(*bounds).distinct()


def probed(points: DataFrame, spans: DataFrame, *, on: str, ts: str, start: str, end: str, widths: list[int] | None = None) -> DataFrame:
    """Points next to the spans of their subject that may hold them: those filed under one bucket with the point.

    A span is filed under the narrowest width that is as long as it, so it lies in two buckets at most; a point looks up one
    bucket of each width in use (``widths``, found from the spans if not given). So what is compared is of about the spans' own length, however long a subject's
    history is, and a subject is dealt over its buckets.
    """
    used = widths_in_use(spans, start, end) if widths is None else widths
    width = F.array(*[F.lit(GROWTH**k) for k in range(WIDTHS)])[F.col("_w")]
    held = spans.where(F.col(start) <= F.col(end)).withColumn("_w", _width(start, end))
    held = held.withColumn("_b", F.explode(F.sequence(F.floor(_second(start) / width), F.floor(_second(end) / width))))
    looked = points.withColumn("_w", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>"))).withColumn("_b", F.floor(_second(ts) / width))
    return looked.join(held, [on, "_w", "_b"]).drop("_w", "_b")


def interval_join(points: DataFrame, spans: DataFrame, *, on: str, point_id: str, ts: str, start: str, end: str, span_id: str, how: str = "inner", widths: list[int] | None = None) -> DataFrame:
    """``points`` with the earliest (start, id) span of the subject that holds them, bounds included; a null end never matches (``widths`` as in ``probed``)."""
    own = [c for c in spans.columns if c != on]
    inside = probed(points.select(on, point_id, ts), spans, on=on, ts=ts, start=start, end=end, widths=widths).where(F.col(ts).between(F.col(start), F.col(end)))
    picked = inside.groupBy(point_id).agg(_best(own, [F.col(start), F.col(span_id)]).alias("_s"))
    return points.join(picked, point_id, how).select(*points.columns, *[F.col(f"_s.{c}").alias(c) for c in own])


def nearest_in_span(anchors: DataFrame, records: DataFrame, *, on: str, anchor_id: str, anchor_ts: str, start: str, end: str, record_ts: str, record_id: str, how: str = "inner", widths: list[int] | None = None) -> DataFrame:
    """``anchors``, that carry a span, with the nearest record inside the span; ties as in ``nearest_join`` (``widths`` as in ``probed``)."""
    own = [c for c in records.columns if c != on]
    spans = anchors.select(on, anchor_id, anchor_ts, *[F.col(c) for c in dict.fromkeys((start, end)) if c != anchor_ts])
    near = probed(records, spans, on=on, ts=record_ts, start=start, end=end, widths=widths).where(F.col(record_ts).between(F.col(start), F.col(end)))
    near = near.withColumn("gap_seconds", S.gap_seconds(anchor_ts, record_ts))
    picked = near.groupBy(anchor_id).agg(_best([*own, "gap_seconds"], [F.abs("gap_seconds"), F.col(record_ts), F.col(record_id)]).alias("_r"))
    return anchors.join(picked, anchor_id, how).select(*anchors.columns, *[F.col(f"_r.{c}").alias(c) for c in [*own, "gap_seconds"]])


def nearest_to_start(spans: DataFrame, records: DataFrame, *, on: str, span_id: str, start: str, end: str, record_ts: str, record_id: str) -> DataFrame:
    """One record per span: the one inside it nearest to its start; equal gaps and times by record id."""
    return nearest_in_span(spans, records, on=on, anchor_id=span_id, anchor_ts=start, start=start, end=end, record_ts=record_ts, record_id=record_id)
