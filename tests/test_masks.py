"""Counts of subjects by masks: against plain counts, and without a row per distinct count in the plan."""

import random

from cairn.operators import cohort, splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_funnel_counts_subjects_by_masks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([*range(20), None]), *(rng.choice([True, False, None]) for _ in range(3)), rng.choice([1, 5, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "subject_id long, s_all boolean, s_b boolean, s_c boolean, n_files long")
    out = cohort.funnel(df, ["all", "b", "c"])
    got = {r["stage"]: (r["step"], r["n_studies"], r["n_subjects"], r["n_files"]) for r in out.collect()}
    want = {}
    for i, name in enumerate(["all", "b", "c"]):
        on = [r for r in rows if r[1 + i]]
        want[name] = (i, len(on), len({r[0] for r in on} - {None}), sum(r[4] or 0 for r in on))
    assert got == want and "Expand" not in plan(out)
    assert [tuple(r)[:5] for r in cohort.funnel(df.limit(0), ["all", "b"]).collect()] == [(0, "all", 0, 0, 0), (1, "b", 0, 0, 0)]


def test_prevalence_counts_a_subject_once_overall(spark):
    rng = random.Random(3)
    rows = [(rng.choice([*range(15), None]), rng.choice(["train", "test", None]), rng.choice([True, False, None])) for _ in range(200)]
    out = splits.split_prevalence(spark.createDataFrame(rows, "subject_id long, split string, gate boolean"), min_per_class=20)
    got = {r["split"]: r for r in out.collect()}
    for name in ("train", "test", None, "overall"):
        own = [r for r in rows if name == "overall" or r[1] == name]
        pos, neg = sum(r[2] is True for r in own), sum(r[2] is False for r in own)
        r = got[name]
        assert (r["n"], r["n_subjects"], r["n_positive"], r["n_negative"]) == (len(own), len({x[0] for x in own} - {None}), pos, neg)
        assert abs(r["prevalence"] - pos / (pos + neg)) < 1e-12 and r["enough"] == (min(pos, neg) >= 20)
    assert len(got) == 4 and "Expand" not in plan(out)


def test_sensitivity_has_no_expand(spark):
    flags = spark.range(300).selectExpr("id % 50 as subject_id", "id < 100 as a", "id < 20 as b")
    out = cohort.sensitivity(flags, ["a", "b"])
    assert [(r["scenario"], r["start_rows"], r["final_rows"], r["final_subjects"], r["gain"]) for r in out.collect()] == [("a", 300, 100, 50, 0), ("b", 300, 20, 20, -80)]
    assert "Expand" not in plan(out)
