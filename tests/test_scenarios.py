"""Scenarios from one scan: against the flags of each cohort by itself, and what the plans hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import cohort, pairing

BASE = dt.datetime(2024, 1, 1)
OPTIONS = {
    "narrow": {"before": 3600, "after": 300},
    "day": {},
    "no_stay": {"require_stay": False, "before": 0, "after": 7200},
    "long": {"before": 40 * 86400, "after": 5, "bucketed": True},
    "stay": {"pair_by": "stay"},
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    at = lambda: rng.choice([None, *[BASE + dt.timedelta(seconds=rng.choice([rng.randrange(0, 90000), round(rng.uniform(0, 90000), 3), rng.randrange(0, 10**7)])) for _ in range(12)]])
    subject = lambda: rng.choice([*range(5), None])
    studies = [(i, subject(), at(), i if i % 9 else None) for i in range(400)]
    readings = [(i, rng.choice([*cohort.CHAIN, *cohort.BOUNDS, "other"]), rng.choice(["50%", "41", "x", "200%"]), BASE) for i in range(400) for _ in range(3)]
    records = [(i, subject(), at(), f"p{i}") for i in range(150)]
    stays = []
    for i in range(120):
        start = at()
        stays.append((i, subject(), start, start and start + dt.timedelta(seconds=rng.choice([-5, 0, 0.5, 50, 4000, 10**6]))))
    return (
        spark.createDataFrame(studies, "study_id long, subject_id long, ts timestamp_ntz, measurement_id long"),
        spark.createDataFrame(readings, "measurement_id long, name string, result string, ts timestamp_ntz"),
        spark.createDataFrame(records, "record_id long, subject_id long, record_ts timestamp_ntz, path string"),
        spark.createDataFrame(stays, "stay_id long, subject_id long, start_ts timestamp_ntz, end_ts timestamp_ntz"),
    )


def test_each_scenario_is_the_cohort_of_its_options(tables):
    studies, measurements, records, stays = tables
    rows = cohort.labelled(studies, measurements, records)
    got = {r["study_id"]: r for r in cohort.scenarios(rows, records, stays, OPTIONS).collect()}
    assert len(got) == 400
    for name, how in OPTIONS.items():
        want = {r["study_id"]: r["in_cohort"] for r in cohort.cohort_flags(studies, measurements, records, stays, **how).collect()}
        assert {k: r[name] for k, r in got.items()} == want and 5 < sum(want.values()) < 395, name
    with pytest.raises(ValueError):
        cohort.scenarios(rows, records, stays, {"a": {"pair_by": "day"}})


def test_scenarios_share_a_scan(tables):
    studies, measurements, records, stays = tables
    rows = cohort.labelled(studies, measurements, records).select("study_id", "subject_id", "ts", "s_overlap")
    plans = [cohort.scenarios(rows, records, stays, o)._jdf.queryExecution().optimizedPlan().toString() for o in ({"a": {}, "b": {"pair_by": "stay"}}, {"a": {}, "b": {"pair_by": "stay"}, "c": {"before": 5}, "d": {"require_stay": False}, "e": {"pair_by": "stay"}})]
    assert plans[0].count("Window [") == plans[1].count("Window [") > 0 and plans[0].count("Join") == plans[1].count("Join")


def test_stages_take_no_values_and_parse_a_reading_once(tables):
    labels = pairing.priority_pick(tables[1], key="measurement_id", name="name", value=S.percent("result"), lo=5, hi=95, chain=cohort.CHAIN, excluded=cohort.BOUNDS, ties=["ts", "result"])
    assert labels.select("measurement_id", "value")._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    flags = labels.select("measurement_id", "label_source", "accepted")
    assert "SortAggregate" not in flags._jdf.queryExecution().executedPlan().toString()
    # the least place of the readings in range, whatever comes first in time
    rows = {r["measurement_id"]: r for r in labels.collect()}
    names = [*cohort.CHAIN, *sorted(cohort.BOUNDS)]
    valid = tables[1].where(F.col("result").isin("50%", "41") & F.col("name").isin(*names)).groupBy("measurement_id").agg(F.collect_set("name").alias("names"), F.collect_set(F.struct("name", "result")).alias("all")).collect()
    assert len(rows) == len(valid)
    for r in valid:
        name = min(r["names"], key=names.index)
        value = min(x["result"] for x in r["all"] if x["name"] == name)
        assert rows[r["measurement_id"]][1:] == (float(value.rstrip("%")), name, name in cohort.CHAIN)
