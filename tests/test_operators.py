"""Expected values of the cohort, vector, metric and failure operators on tiny frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import cohort, columns, failure, filters, joins, metrics, models, pairing, pooling, splits, text
from cairn.sources import cache, tables


def one(spark, expr, kind="string", value=None):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("v")).first()["v"]


# Scalars -----------------------------------------------------------------------------------------


def test_age_bands(spark):
    rows = spark.createDataFrame([(25.0,), (45.0,), (91.0,), (None,), (17.9,), (40.0,), (89.5,)], "a double").select(S.age_band("a")).collect()
    assert [r[0] for r in rows] == ["18-39", "40-54", "90+", None, None, "40-54", "75-89"]


@pytest.mark.parametrize(("text_", "value"), [("55%", 55.0), (" 55 % ", 55.0), ("55d", None), ("nan", None), ("inf", None), ("n/a", None), ("1e2", 100.0), (None, None), ("", None)])
def test_percent(spark, text_, value):
    assert one(spark, S.percent("x"), value=text_) == value


def test_ids_from_paths(spark):
    path = "files/p0000/p00000001/s00000100/00000100"
    a, b = S.path_ids(F.col("x"))
    assert one(spark, F.struct(a, b), value=path)[:] == (1, 100) and one(spark, F.struct(a, b), value="none")[:] == (None, None)
    c, d = S.path_ids_fallback(F.col("x"))
    assert one(spark, F.struct(c, d), value="files/p10/p10002221/s94106955/94106955_0001.dcm")[:] == (10002221, 94106955)
    assert one(spark, S.path_key(F.col("x")), value="a/b/p1/s2/f.dcm") == "p1/s2/f.mp4"
    for v in ("a/b/s42282815", "s42282815", "42282815"):
        assert one(spark, S.canonical_id("x"), value=v) == "42282815"


def test_vectors_are_parsed(spark):
    for t in ("[1, 2.5, -3]", "1,2.5,-3", "1 2.5 -3", "(1  2.5\n-3)"):
        assert one(spark, S.parse_vector("x"), value=t) == [1.0, 2.5, -3.0]
    assert one(spark, S.parse_vector("x"), value="7") == [7.0]
    assert all(one(spark, S.parse_vector("x"), value=t) is None for t in (None, "", "[]", "a b"))
    assert math.isnan(one(spark, S.parse_vector("x"), value="[nan]")[0])


def test_booleans_and_races(spark):
    rows = spark.createDataFrame([("True",), (" yes",), ("0",), ("N",), ("maybe",), (None,)], "x string")
    assert [r[0] for r in rows.select(S.boolean("x")).collect()] == [True, True, False, False, None, None]
    assert [tuple(r) for r in filters.bad_booleans(rows, "x").collect()] == [("maybe", 1)]
    assert one(spark, S.race_group("x"), value="white - russian") == "WHITE" and one(spark, S.race_group("x")) in ("OTHER/UNKNOWN",)


def test_attention_pooling_of_equal_tokens_is_the_token(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]] * 5), (2, [[1.0, 0.0], None, [0.0, 1.0]]), (3, [])], "id int, t array<array<double>>")
    out = {r["id"]: r for r in pooling.attentive_pool(df, "t", [3.0, -1.0]).collect()}
    assert out[1]["pooled"] == pytest.approx([1.0, 2.0]) and out[3]["pooled"] is None
    w = np.exp(np.array([3.0, -1.0]) / 2**0.5)
    assert out[2]["pooled"] == pytest.approx((w / w.sum()).tolist())


def test_masks(spark):
    df = spark.createDataFrame([([1.0, 2.0], True), ([1.0, 2.0], False), (None, True)], "v array<float>, k boolean")
    assert [r[0] for r in df.select(S.masked("v", F.col("k"), 2)).collect()] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


# Columns and filters -----------------------------------------------------------------------------


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 35.0, "F"), (1, 4, 5, 55.0, "M")], "Subject int, study_id int, RECORD_ID int, label double, Sex string")
    assert columns.resolve(df, ("subject_id", "subject")) == "Subject" and columns.resolve(df, ("x",)) is None
    with pytest.raises(ValueError, match="study_id"):
        columns.require(df, ("nope",))
    out = columns.normalize_cohort(df)
    assert [(r["subject_id"], r["gate"], r["sex"], r["split"]) for r in out.orderBy("study_id").collect()] == [(1, True, "F", None), (1, False, "M", None)]
    assert columns.feature_columns(["ve10", "VE2", "x", "ve1"], "ve") == ["VE2", "ve1", "ve10"] or columns.feature_columns(["ve10", "VE2", "x", "ve1"], "ve")[-1] == "ve10"


def test_vector_dims(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>")
    assert columns.vector_dim(df, "v") == 2 and columns.spread(df, "v", 2).columns == ["id", "ve0", "ve1"]
    with pytest.raises(ValueError, match="lengths"):
        columns.vector_dim(df.union(spark.createDataFrame([(3, [1.0])], df.schema)), "v")
    clips = spark.createDataFrame([(1, [[1.0], [2.0]])], "id int, v array<array<double>>")
    assert columns.is_matrix(clips, "v") and columns.vector_dim(clips, "v") == 1
    with pytest.raises(ValueError, match="pool"):
        columns.spread(clips, "v", 1)


def test_non_finite_rows_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, [1.0, nan]), (2, 1.0, [inf, 1.0]), (3, 1.0, [-inf, 1.0]), (4, 1.0, [1.0, 1.0]), (5, nan, [1.0, 1.0]), (6, 1.0, None), (7, None, [1.0, 1.0])]
    kept, counts = filters.drop_non_finite(spark.createDataFrame(rows, "id int, y double, v array<double>"), "y", ["v"])
    assert [r["id"] for r in kept.collect()] == [4] and tuple(counts.first()) == (1, 6)


def test_split_checks(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "subject_id int, split string")
    filters.check_splits(df)
    with pytest.raises(ValueError, match="more than one split"):
        splits.check_leakage(df)
    with pytest.raises(ValueError, match="splits"):
        filters.check_splits(df.where("split <> 'val'"))
    with pytest.raises(ValueError, match="unknown conditions"):
        filters.check_conditions(["full", "x"])


# Pairing -----------------------------------------------------------------------------------------


def _pair_frames(spark):
    a = spark.createDataFrame([(1, 7, "2024-01-02 00:00:00"), (2, 7, "2024-03-01 00:00:00"), (3, 8, "2024-01-02 00:00:00")], "study_id int, subject_id int, t string").selectExpr("study_id", "subject_id", "cast(t as timestamp_ntz) ts")
    r = spark.createDataFrame([(10, 7, "2024-01-01 23:00:00"), (11, 7, "2024-01-02 01:00:00"), (12, 7, "2024-01-02 01:00:00.5"), (13, 8, "2024-01-04 00:00:01")], "record_id int, subject_id int, t string").selectExpr("record_id", "subject_id", "cast(t as timestamp_ntz) record_ts")
    return a, r


@pytest.mark.parametrize("bucketed", [False, True])
def test_nearest_join_ties_and_bounds(spark, bucketed):
    a, r = _pair_frames(spark)
    args = {"on": "subject_id", "anchor_id": "study_id", "anchor_ts": "ts", "record_ts": "record_ts", "record_id": "record_id", "bucketed": bucketed}
    got = {x["study_id"]: (x["record_id"], x["gap_seconds"]) for x in pairing.nearest_join(a, r, before=3600, after=3600, **args).collect()}
    assert got == {1: (10, -3600)}  # equal gaps: the earlier record
    got = {x["study_id"]: x["record_id"] for x in pairing.nearest_join(a, r, before=0, after=172800, how="left", **args).collect()}
    assert got == {1: 11, 2: None, 3: None}
    assert {x["study_id"] for x in pairing.nearest_join(a, r, before=0, after=172801, **args).collect()} == {1, 3}


def test_interval_join_takes_the_earliest(spark):
    a, _ = _pair_frames(spark)
    s = spark.createDataFrame([(5, 7, "2024-01-01", "2024-01-02"), (4, 7, "2024-01-01", "2024-01-05"), (6, 7, "2024-02-01", None)], "stay_id int, subject_id int, s string, e string").selectExpr("stay_id", "subject_id", "cast(s as timestamp_ntz) start_ts", "cast(e as timestamp_ntz) end_ts")
    got = pairing.interval_join(a, s, on="subject_id", point_id="study_id", ts="ts", start="start_ts", end="end_ts", span_id="stay_id").collect()
    assert [(x["study_id"], x["stay_id"]) for x in got] == [(1, 4)]


def test_priority_pick_prefers_the_chain_and_marks_bounds(spark):
    rows = [(1, "lvef_upper", "60%", "2024-01-01"), (1, "lvef_3d", "50%", "2024-01-01"), (2, "lvef_upper", "60%", "2024-01-01"), (3, "lvef", "200%", "2024-01-01"), (3, "biplane_lvef", "41", "2024-01-01"), (4, "lvef", "x", "2024-01-01")]
    m = spark.createDataFrame(rows, "measurement_id int, name string, result string, t string").selectExpr("measurement_id", "name", "result", "cast(t as timestamp_ntz) ts")
    got = pairing.priority_pick(m, key="measurement_id", name="name", value=S.percent("result"), lo=5, hi=95, chain=cohort.CHAIN, excluded=cohort.BOUNDS, ties=["ts", "result"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 50.0, "lvef_3d", True), (2, 60.0, "lvef_upper", False), (3, 41.0, "biplane_lvef", True)]


def test_keep_first_takes_nulls_first(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 3), (2, 1)], "study_id int, m int")
    assert sorted((r["study_id"], r["m"]) for r in pairing.keep_first(df, "study_id", [F.col("m")]).collect()) == [(1, None), (2, 1)]


def test_sensitivity_gain(spark):
    flags = spark.range(300).selectExpr("id as subject_id", "id < 200 as a", "id < 260 as b")
    rows = {r["scenario"]: r for r in cohort.sensitivity(flags, ["a", "b"]).collect()}
    assert (rows["b"]["gain"], rows["b"]["gain_pct"]) == (60, 30.0) and rows["a"]["gain"] == 0


def test_coverage_and_summary(spark):
    df = spark.createDataFrame([("F", 50, "UNKNOWN", 35.0), ("M", 60, "WHITE", 55.0)], "sex string, age int, race string, label double").withColumn("subject_id", F.lit(1)).withColumn("gate", F.col("label") <= 40)
    assert {r["field"]: r["present"] for r in cohort.coverage(df, ["sex", "race"]).collect()} == {"sex": 2, "race": 1}
    s = cohort.cohort_summary(df).first()
    assert (s["n_positive"], s["n_missing"], s["prevalence"]) == (1, 0, 0.5)
    assert cohort.cohort_summary(df.limit(0)).first()["prevalence"] is None
    with pytest.raises(ValueError, match="pair_by"):
        cohort.cohort_flags(df, df, df, df, pair_by="x")


# Joins and pooling -------------------------------------------------------------------------------


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, 10, [1.0, 3.0]), (1, 10, [3.0, 5.0]), (2, 20, [10.0, 20.0]), (2, 20, None)], "subject_id int, study_id int, v array<float>")
    got = {r["study_id"]: (r["embedding"], r["n_clips"]) for r in pooling.mean_pool(df, ["subject_id", "study_id"], "v").collect()}
    assert got == {10: ([2.0, 4.0], 2), 20: ([10.0, 20.0], 1)}
    with pytest.raises(ValueError, match="lengths"):
        pooling.mean_pool(df.union(spark.createDataFrame([(3, 3, [1.0])], df.schema)), ["study_id"], "v").collect()
    with pytest.raises(ValueError, match="no vectors"):
        pooling.mean_pool(df.where("v is null"), ["study_id"], "v")


def test_stride_subsample(spark):
    five = [(1, i, [float(i)]) for i in range(5)] + [(2, 0, [0.0])] + [(3, i, None if i % 2 == 0 else [float(i)]) for i in range(10)]
    df = spark.createDataFrame(five, "key int, i int, v array<float>")
    got = pooling.stride_subsample(df, ["key"], "v", ["i"], 3).collect()
    assert sorted(r["i"] for r in got if r["key"] == 1) == [0, 2, 4] and [r["n_clips"] for r in got if r["key"] == 2] == [1]
    assert sorted(r["i"] for r in pooling.stride_subsample(df, ["key"], "v", ["i"], 5).collect() if r["key"] == 3) == [1, 5, 9]


def test_many_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, y double")
    out = joins.join_m2o(left, right, ["k"], flag="has")
    assert out.count() == 3 and all(r["has"] for r in out.collect())
    with pytest.raises(ValueError, match="not unique"):
        joins.join_m2o(right, left, ["k"])
    assert joins.join_m2o(right, left, ["k"], allow_fanout=True).count() == 3
    with pytest.raises(ValueError, match="missing columns"):
        joins.replace_vectors(left, right, ["k"], ["z"])


def test_alignment(spark):
    good = [(1, "full", 1.0), (1, "a_dropped", 1.0), (2, "full", 2.0), (2, "a_dropped", 2.0)]
    make = lambda rows: spark.createDataFrame(rows, "example_id int, condition string, y double")
    joins.check_aligned(make(good))
    for bad in (good[:-1], [*good[:-1], (2, "a_dropped", 3.0)], [*good, good[0]]):
        with pytest.raises(ValueError, match="not aligned"):
            joins.check_aligned(make(bad))


# Metrics -----------------------------------------------------------------------------------------


def brute_auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, n in zip(s, y) if not n]
    return sum(pairs) / len(pairs) if pairs else None


def test_auroc_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(g, bool(rng.integers(2)), float(rng.integers(-4, 5)) * (0.0 if g == "z" else 1.0)) for g in "xyz" for _ in range(80)] + [("w", True, 1.0), ("w", True, None), ("w", None, 0.0)]
    df = spark.createDataFrame(rows, "k string, gate boolean, score double")
    got = {r["k"]: r["auroc"] for r in metrics.auroc(df, ["k"]).collect()}
    for k in "xyz":
        assert got[k] == pytest.approx(brute_auc([r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k]))
    assert got["z"] == 0.5 and got["w"] is None
    known = [r for r in rows if r[0] != "w"]
    assert metrics.auroc_global(df.where("k <> 'w'"), pieces=5).first()["auroc"] == pytest.approx(brute_auc([r[1] for r in known], [r[2] for r in known]))


def test_binary_metrics(spark):
    df = spark.createDataFrame([(False, 0.1), (False, 0.2), (True, 0.8), (True, 0.9)], "gate boolean, score double").withColumn("p", F.col("score"))
    assert metrics.auroc(df, []).first()["auroc"] == 1 and metrics.average_precision(df, []).first()[0] == 1
    only = df.withColumn("gate", F.lit(True))
    assert metrics.auroc(only, []).first()["auroc"] is None
    assert metrics.brier(df, []).first()["brier"] == pytest.approx((0.01 + 0.04 + 0.04 + 0.01) / 4)


def test_calibration(spark):
    exact = spark.createDataFrame([(True, 1.0), (False, 0.0), (True, 1.0)], "gate boolean, p double")
    bins = metrics.reliability_bins(exact, [])
    assert bins.count() == 10 and sum(r["n"] for r in bins.collect()) == 3 and metrics.ece(bins, []).first()["ece"] == 0
    wrong = spark.createDataFrame([(True, 0.05)] * 4, "gate boolean, p double")
    assert metrics.ece(metrics.reliability_bins(wrong, []), []).first()["ece"] > 0.8
    edge = spark.createDataFrame([(True, 0.3), (True, 0.30000000000000004), (True, 1.0)], "gate boolean, p double")
    assert {r["bin"]: r["n"] for r in metrics.reliability_bins(edge, []).collect() if r["n"]} == {2: 1, 3: 1, 9: 1}


def test_bootstrap_counts_undefined_replicates(spark):
    df = spark.range(40).selectExpr("id as example_id", "cast(id as double) as y", "cast(id + 1 as double) as pred", "false as gate")
    r = metrics.bootstrap_ci(df, [], b=50).first()
    assert (r["auroc_replicates"], r["auroc_discarded"], r["auroc_lo"]) == (0, 50, None) and r["mae_lo"] == r["mae_hi"] == 1.0
    p = metrics.bootstrap_ci(df, [], b=50, mode="poisson").first()
    assert p["mae_lo"] == p["mae_hi"] == 1.0


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(y), float(y + rng.normal(0, 5)), bool(y <= 40)) for i, y in enumerate(rng.uniform(0, 80, 300))]
    df = spark.createDataFrame(rows, "example_id int, y double, pred double, gate boolean")
    point = metrics.mae(df, []).first()["mae"]
    for mode in ("exact", "poisson"):
        r = metrics.bootstrap_ci(df, [], b=60, mode=mode).first()
        assert r["mae_lo"] < point < r["mae_hi"] and r["auroc_lo"] <= r["auroc_hi"]
    d = metrics.paired_delta(df.withColumn("other", F.col("pred") + 10), [], pred_a="pred", pred_b="other", b=40).first()
    assert d["d_mae_hi"] < 0


def test_strata_and_eligibility(spark):
    df = spark.createDataFrame([(i, float(i % 50), float(i % 50 + 3), i % 50 <= 20, "F" if i % 2 else None) for i in range(60)], "example_id int, y double, pred double, gate boolean, sex string")
    rows = {(r["stratum"], r["value"]): r for r in metrics.stratified_metrics(df, ["sex"]).collect()}
    assert set(rows) == {("overall", "all"), ("sex", "F"), ("sex", "unknown")} and rows["overall", "all"]["mae"] == 3
    few = spark.createDataFrame([("a", 10, 5), ("b", 10, 4), ("unknown", 20, 10), (None, 20, 10)], "value string, n int, n_pos int")
    assert [r["value"] for r in filters.eligible_strata(few).collect()] == ["a"]
    with pytest.raises(ValueError, match="no result"):
        metrics.unified({"a": None})


# Failure analysis --------------------------------------------------------------------------------


def test_taxonomy_cases(spark):
    rows = [(1, "full", 35.0, 36.0, True), (2, "full", 55.0, 54.0, False), (3, "full", 50.0, 20.0, False), (4, "full", 60.0, 50.0, False)]
    r = failure.taxonomy(spark.createDataFrame(rows, "example_id int, condition string, y double, pred double, gate boolean")).first()
    assert (r["n_correct"], r["n_imprecise"], r["n_critical"]) == (2, 1, 1)


def test_dropout_profile_and_winners(spark):
    rows = [(1, 35.0, True, 36.0, 55.0, 36.0), (2, 35.0, True, 36.0, 42.0, 36.0), (3, 60.0, False, 60.0, 60.0, 30.0)]
    long = [(i, c, y, p, g) for i, y, g, *ps in rows for c, p in zip(("full", "a_dropped", "b_dropped"), ps)]
    df = spark.createDataFrame(long, "example_id int, condition string, y double, pred double, gate boolean")
    out = {r["condition"]: r for r in failure.dropout_profile(df).collect()}
    assert (out["a_dropped"]["n_induced"], out["a_dropped"]["n_silent"], out["a_dropped"]["n_loud"]) == (2, 1, 1)
    assert (out["b_dropped"]["n_induced"], out["b_dropped"]["silent_rate"]) == (1, 1.0)
    assert {r["modality"]: r["n"] for r in failure.winners(df, {"a": "a_dropped", "b": "b_dropped"}).collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="two modalities"):
        failure.complementarity(df.withColumn("subset", F.lit("a")), ["a"])


def test_three_modalities(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(450, 6))
    y = 45 + 8 * x[:, 0] + 3 * x[:, 2] + x[:, 4]
    df = spark.createDataFrame([(i, float(y[i]), *[x[i, k : k + 2].tolist() for k in (0, 2, 4)]) for i in range(450)], "example_id int, y double, a array<double>, b array<double>, c array<double>")
    vectors = {m: m for m in "abc"}
    scored = models.score_subsets(df, models.fit_fusion(df, vectors, "y"), vectors, ["example_id", "y"])
    assert failure.complementarity(scored, list("abc")).count() == 9
    value = {r["modality"]: r["marginal_value"] for r in failure.modality_values(scored, list("abc")).collect()}
    assert max(value, key=value.get) == "a"


# Models ------------------------------------------------------------------------------------------


def _data(spark, n=200, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 5, 0.2, 1] + 2
    y = 3 + x @ [1.0, -0.5, 2.0, 0.0] + rng.normal(size=n)
    rows = [(i, x[i].tolist(), float(y[i]), bool(y[i] > 4)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, v array<double>, y double, gate boolean"), x, y


def test_scaler_and_ridge_equal_closed_forms(spark):
    df, x, y = _data(spark)
    scaler = models.fit_scaler(df.withColumn("v", F.concat("v", F.array(F.lit(7.0)))), "v")
    assert scaler.mean[:4] == pytest.approx(x.mean(0)) and scaler.scale == pytest.approx([*x.std(0), 1.0])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(4), xc.T @ yc)
    model = models.fit_ridge(df, "v", "y", 2.5)
    assert model.weights == pytest.approx(w) and model.intercept == pytest.approx(y.mean() - x.mean(0) @ w)
    got = [r[0] for r in df.orderBy("id").select(model.predict("v")).collect()]
    assert got == pytest.approx(x @ w + model.intercept)


def test_leave_one_out_equals_refitting(spark):
    df, x, y = _data(spark, n=25)
    _, best, errors = models.fit_ridge_loo(df, "v", "y", [0.1, 1.0, 30.0])
    for a in errors:
        gone = []
        for i in range(len(x)):
            k = np.arange(len(x)) != i
            m, c = x[k].mean(0), y[k].mean()
            w = np.linalg.solve((x[k] - m).T @ (x[k] - m) + a * np.eye(4), (x[k] - m).T @ (y[k] - c))
            gone.append((y[i] - c - (x[i] - m) @ w) ** 2)
        assert errors[a] == pytest.approx(np.mean(gone), rel=0.02)
    assert best == min(errors, key=errors.get)


def test_logistic_and_platt(spark):
    df, x, y = _data(spark)
    model = models.fit_logistic(df, "v", "gate", 1.0)
    w, b, t = np.zeros(4), 0.0, (y > 4).astype(float)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        z = np.c_[x, np.ones(len(x))]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 1, 1e-12]), z.T @ (p - t) + np.r_[w, 0])
        w, b = w - step[:4], b - step[4]
    assert model.weights == pytest.approx(w, abs=1e-3) and model.intercept == pytest.approx(b, abs=5e-3)
    out = models.platt(None, df.withColumn("s", F.col("y")), "s", "gate")
    assert out.where("in_sample").count() == 200
    _, c = models.fit_logistic_cv(df, "v", "gate", "id", cs=[1e-6, 1.0], folds=3)
    assert c in (1e-6, 1.0)
    assert set(models.fit_targets(df.withColumn("all_true", F.lit(True)), "v", ["gate", "all_true"], "id", cs=[1.0])) == {"gate"}


def test_masked_conditions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0]), (2, None, [1.0])], "id int, a array<double>, b array<double>")
    model = models.Fusion({"a": [1.0, 1.0], "b": [10.0]}, 0.5)
    got = {(r["id"], r["condition"]): r["pred"] for r in models.score_conditions(df, model, {"a": "a", "b": "b"}, ["id"]).collect()}
    assert got == {(1, "full"): 33.5, (1, "a_dropped"): 30.5, (1, "b_dropped"): 3.5, (2, "full"): 10.5, (2, "a_dropped"): 10.5, (2, "b_dropped"): 0.5}


# Splits ------------------------------------------------------------------------------------------


def test_subject_split(spark):
    df = spark.range(1000).selectExpr("id % 100 as subject_id", "id")
    out = splits.subject_split(df, fractions=(0.7, 0.1, 0.2))
    assert out.count() == 1000 and splits.leaking_subjects(out).count() == 0
    counts = {r["split"]: r["n"] for r in out.select("subject_id", "split").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"train": 70, "val": 10, "test": 20}
    again = splits.subject_split(df.repartition(7))
    assert out.select("subject_id", "split").distinct().exceptAll(again.select("subject_id", "split").distinct()).count() == 0
    with pytest.raises(ValueError, match="sum to 1"):
        splits.subject_split(df, fractions=(0.5, 0.1, 0.1))


# Text --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("note", "grades"),
    [
        ("Echo showed severe aortic stenosis.", (3, None, None)), ("No evidence of mitral regurgitation.", (None, 0, None)), ("Family history of aortic stenosis.", (None, None, None)),
        ("Mild to moderate mitral valve regurgitation. Trace tricuspid regurgitation", (None, 2, 0)), ("moderate to severe tricuspid insufficiency", (None, None, 3)), ("aortic valve area 0.7 cm2", (3, None, None)),
        ("mean gradient > 45 mmHg across the aortic valve", (3, None, None)), ("aortic sclerosis", (1, None, None)), ("nothing\nrelevant", (None, None, None)), (None, (None, None, None)),
    ],
)
def test_findings(spark, note, grades):
    r = text.extract_findings(spark.createDataFrame([(note,)], "text string")).first()
    assert (r["as_grade"], r["mr_grade"], r["tr_grade"]) == grades


def test_ejection_fraction(spark):
    for note, value in (("LVEF is approximately 35 %", 35.0), ("echo: ejection fraction > 55%", 60.0), ("lvef >= 55%. lvef 40%", 60.0), ("no number, echo", None)):
        assert text.extract_findings(spark.createDataFrame([(note,)], "text string")).first()["ef_percent"] == value


# Sources -----------------------------------------------------------------------------------------


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for ext in ("parquet", "csv"):
        tables.write_table(df, f"{tmp_path}/t.{ext}")
        assert sorted(tuple(r) for r in tables.read_table(spark, f"{tmp_path}/t.{ext}").collect()) == [(1, "a"), (2, None)]
    assert tables.read_parquet(spark, f"{tmp_path}/t.parquet", ["k"]).columns == ["k"]
    with pytest.raises(ValueError, match="neither"):
        tables.read_table(spark, "x.json")
    tables.write_shards(df.withColumn("folder", F.lit("p10")), f"{tmp_path}/s")
    assert tables.read_parquet(spark, f"{tmp_path}/s").count() == 2


def test_wide_to_vector(spark):
    df = spark.createDataFrame([("files/p0000/p00000001/s00000100/00000100", 0.5, 1.5), ("bad", 1.0, 1.0)], "filename string, ve0001 double, ve0002 double")
    r = tables.wide_to_vector(df, prefix="ve", model="m", path="filename").collect()
    assert [(x["subject_id"], x["study_id"], x["embedding"], x["model"]) for x in r] == [(1, 100, [0.5, 1.5], "m")]
    with pytest.raises(ValueError, match="start with"):
        tables.wide_to_vector(df, prefix="zz", model="m", path="filename")


def test_profile_and_readiness(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, [2.0]), (2, None, [3.0])], "k int, v string, e array<double>")
    assert {r["column"]: (r["n_null"], r["n_unique"], r["n_duplicate"]) for r in tables.profile(df, ["k", "v"]).collect()} == {"k": (0, 2, 1), "v": (2, 2, 1)}
    assert tables.readiness(df, ["k", "z"], ["w"], "e") == {"rows": 3, "dim": 1, "missing": ["z"], "missing_recommended": ["w"], "ready": False}
    assert tables.split_view(df.withColumn("split", F.lit("train")), "train", ["e"], ["k", "none"]).count() == 3


def test_vector_cache(spark, tmp_path):
    c = cache.VectorCache(spark, str(tmp_path / "cache"), "a", "v1")
    rows = lambda *ids: spark.createDataFrame([(i, [float(len(i)), float(x)]) for x, i in enumerate(ids, 1)], "id string, embedding array<double>")
    assert c.read().count() == 0 and not c.has("b")
    c.append(rows("b", "aa"))
    assert [r["id"] for r in c.keys().collect()] == ["aa", "b"] and c.has("b")
    with pytest.raises(ValueError, match="cached already"):
        c.append(rows("b"))
    with pytest.raises(ValueError, match="cached already"):
        c.append(rows("c", "c"))
    c.append(rows("x", "b"), overwrite=True)
    assert {r["id"]: r["embedding"] for r in c.read().collect()} == {"aa": [2.0, 2.0], "b": [1.0, 2.0], "x": [1.0, 1.0]}
    assert [r["id"] for r in c.missing(rows("b", "q").select("id")).collect()] == ["q"]
    assert cache.VectorCache(spark, str(tmp_path / "cache"), "other", "v1").read().count() == 0
    assert c.stats().first()["n"] == 3


def test_metrics_by_pieces_equal_one_window(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if g == 3 else int(g), float(s), bool(y), int(w)) for i, (g, s, y, w) in enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 60, 900) / 4, rng.random(900) < 0.3, rng.integers(1, 4, 900), strict=True))]
    df = spark.createDataFrame(rows, "example_id int, g int, score double, gate boolean, w int").cache()
    for of in (metrics.auroc, metrics.average_precision):
        told = [{r["g"]: r[-1] for r in of(df, ["g"], weight="w", edges=e).collect()} for e in ([], metrics.score_edges(df, "score", 16), [-1.0, 7.0, 7.25, 99.0])]
        assert told[0] == pytest.approx(told[1]) and told[0] == pytest.approx(told[2]) and None in told[0]
    mean = metrics.bootstrap_metric(df.withColumn("p", F.col("score") / 16), ["g"], lambda rows, keys, w: metrics.brier(rows, keys, weight=w), "brier", b=30).collect()
    assert len(mean) == 4 and all(r["lo"] <= r["hi"] and r["replicates"] == 30 for r in mean)
    with pytest.raises(ValueError):
        metrics.bootstrap_ci(df, [], mode="other")


def test_digest_of_split_ids(spark):
    import hashlib

    df = spark.createDataFrame([(s, i) for s in "ab" for i in range(25)] + [("a", 3), ("a", None)], "split string, id int")
    one = {r["split"]: (r["n"], r["sha256"]) for r in splits.sha256_of_ids(df, "id", "split").collect()}
    assert one["a"] == (25, hashlib.sha256("\n".join(map(str, range(25))).encode()).hexdigest()) == one["b"]
    two = {r["split"]: r["n"] for r in splits.sha256_of_ids(df, "id", "split", width=4).collect()}
    assert two == {"a": 25, "b": 25}


def test_strict_booleans(spark):
    df = spark.createDataFrame([("yes",), (None,), ("0",)], "t string")
    assert [r[0] for r in df.select(S.strict_boolean("t")).collect()] == [True, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(S.strict_boolean("t")).collect()


def test_shards_are_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task's
    try:
        _write_shards(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _write_shards(spark, tmp_path):
    tables.write_shards(spark.range(1000).selectExpr("id", "if(id < 900, 'a', 'b') AS folder"), str(tmp_path / "s"))
    assert len({f.name for f in (tmp_path / "s").rglob("*.parquet")}) > 1
    assert tables.read_parquet(spark, str(tmp_path / "s"), ["id"]).count() == 1000
