"""As-of pairing and interval look-ups against brute force, and the rows that they make."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import pairing

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else BASE + dt.timedelta(seconds=seconds)


def sec(t):
    return (t.replace(microsecond=0) - BASE).total_seconds()


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(11)
    when = lambda: at(rng.choice([rng.randrange(0, 4000), round(rng.uniform(0, 4000), 3), rng.randrange(0, 10**6)]))
    subject = lambda: rng.choice([1, 1, 1, 2, 3, None])
    anchors = [(i, subject(), when()) for i in range(300)] + [(900, 1, None), (901, 77, at(5)), (7, 1, at(50))]
    records = [(i, subject(), when(), f"p{i}") for i in range(400)] + [(i, 1, at(100.25), "tie") for i in (1003, 1001, 1002)] + [(1004, 1, None, "none")]
    return anchors, records, spark.createDataFrame(anchors, "aid long, subject long, t timestamp_ntz"), spark.createDataFrame(records, "rid long, subject long, rt timestamp_ntz, path string")


@pytest.mark.parametrize("how", [{}, {"bucketed": True}, {"bucket_seconds": 7}, {"bucket_seconds": 10**9}])
@pytest.mark.parametrize("window", [(0, 0), (30, 5), (100000, 86400), (0, 600)])
def test_nearest_equals_all_pairs(history, window, how):
    anchors, records, a, r = history
    before, after = window
    want = []
    for aid, s, t in anchors:
        near = [(abs(sec(rt) - sec(t)), rt, rid, path, sec(rt) - sec(t)) for rid, rs, rt, path in records if s is not None and s == rs and t and rt and -before <= sec(rt) - sec(t) <= after]
        want.append((aid, *(min(near)[2:] if near else (None, None, None))))
    args = {"on": "subject", "anchor_id": "aid", "anchor_ts": "t", "record_ts": "rt", "record_id": "rid", "before": before, "after": after}
    got = pairing.nearest_join(a, r, how="left", **args, **how)
    assert got.columns == ["aid", "subject", "t", "rid", "rt", "path", "gap_seconds"]
    found = lambda rows: sorted(((x["aid"], x["rid"], x["path"], x["gap_seconds"]) for x in rows), key=str)
    key = lambda rows: [(a, b, c, None if d is None else int(d)) for a, b, c, d in rows]
    assert found(got.collect()) == sorted(key(want), key=str)
    assert found(pairing.nearest_join(a, r, **args, **how).collect()) == sorted(key(x for x in want if x[1] is not None), key=str)


def test_a_subject_with_many_of_each_makes_no_pairs(spark):
    n = 300_000
    a = spark.range(n).select(F.col("id").alias("aid"), F.lit(1).alias("subject"), F.timestamp_seconds(F.col("id") * 7).alias("t"))
    r = spark.range(n).select(F.col("id").alias("rid"), F.lit(1).alias("subject"), F.timestamp_seconds(F.col("id") * 7 + 3).alias("rt"))
    got = pairing.nearest_join(a, r, on="subject", anchor_id="aid", anchor_ts="t", record_ts="rt", record_id="rid", before=10**9, after=10**9, bucket_seconds=3600)
    assert got.agg(F.count("*"), F.count_if(F.expr("rid = aid")), F.sum("gap_seconds")).first()[:] == (n, n, 3 * n)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def spans(spark, history):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        start = round(rng.uniform(0, 5000), rng.choice([0, 3]))
        rows.append((i, rng.choice([1, 1, 2, None]), at(start), at(start + rng.choice([0, 0.5, 30, 700, 50000, -5]))))
    rows += [(500, 1, at(10), None), (501, 1, None, at(10)), (502, 2, at(0), at(10**6)), (503, 2, at(0), at(10**6))]
    return rows, spark.createDataFrame(rows, "sid long, subject long, s timestamp_ntz, e timestamp_ntz")


def holds(s, e, t):
    return s is not None and e is not None and t is not None and s <= t <= e


def test_interval_equals_all_pairs(history, spans):
    anchors, _, a, _ = history
    rows, b = spans
    want = {}
    for aid, subject, t in anchors:
        for sid, own, s, e in rows:
            if subject is not None and subject == own and holds(s, e, t):
                want[aid] = min(want.get(aid, (s, sid)), (s, sid))
    args = {"on": "subject", "point_id": "aid", "ts": "t", "start": "s", "end": "e", "span_id": "sid"}
    got = {x["aid"]: (x["s"], x["sid"]) for x in pairing.interval_join(a, b, **args).collect()}
    assert got == want
    assert pairing.interval_join(a, b, how="left", **args).count() == len(anchors)
    assert pairing.interval_join(a, b.limit(0), **args).count() == 0 and pairing.interval_join(a, b.limit(0), how="left", **args).count() == len(anchors)


def test_nearest_in_span_equals_all_pairs(history, spans):
    _, records, _, r = history
    rows, b = spans
    want = {}
    for sid, own, s, e in rows:
        for rid, subject, rt, _ in records:
            if own is not None and own == subject and holds(s, e, rt):
                key = (abs(sec(rt) - sec(s)), rt, rid)
                want[sid] = min(want.get(sid, key), key)
    got = pairing.nearest_to_start(b, r, on="subject", span_id="sid", start="s", end="e", record_ts="rt", record_id="rid")
    assert {x["sid"]: x["rid"] for x in got.collect()} == {k: v[2] for k, v in want.items()}


def test_a_subject_with_many_stays_is_looked_up_in_linear_rows(spark):
    n = 20_000
    points = spark.range(n).select(F.col("id").alias("aid"), F.lit(1).alias("subject"), F.timestamp_seconds(F.col("id") * 100 + 5).alias("t"))
    stays = spark.range(n).select(F.col("id").alias("sid"), F.lit(1).alias("subject"), F.timestamp_seconds(F.col("id") * 100).alias("s"), F.timestamp_seconds(F.col("id") * 100 + F.pmod("id", F.lit(90))).alias("e"))
    args = {"on": "subject", "ts": "t", "start": "s", "end": "e"}
    assert pairing.probed(points, stays, **args).count() < 6 * n
    got = pairing.interval_join(points, stays, point_id="aid", span_id="sid", **args)
    assert got.where("sid <> aid").count() == 0 and got.count() == sum(i % 90 >= 5 for i in range(n))
