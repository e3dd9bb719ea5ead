"""Multinomial resampling: its law, its sums against brute force from the same weights, and nulls."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import pytest

from cairn.operators import metrics, resample


def test_draws_of_all_runs_sum_to_n_and_follow_the_law():
    n, size, b = 1000, 90, 4000
    counts = np.stack([resample.run_draws(n, r, size, [42, 7], b) for r in range(12)])
    assert (counts.sum(0) == n).all() and counts.shape == (12, b)
    share = np.r_[np.full(11, 90), 10] / n
    expected = n * share
    z = (counts.mean(1) - expected) / np.sqrt(n * share * (1 - share) / b)
    assert np.abs(z).max() < 4.5
    # multinomial covariance between two runs: -n p q
    cov = np.cov(counts[0], counts[5])[0, 1]
    assert abs(cov + n * share[0] * share[5]) < 4 * n * share[0] / np.sqrt(b) * 3
    chi = ((counts - expected[:, None]) ** 2 / expected[:, None]).sum(0)  # mean 11, variance about 22
    assert abs(chi.mean() - 11) < 4 * np.sqrt(22 / b) + 0.2 and abs(chi.var() - 22) < 4


def test_weights_inside_a_run_follow_the_law():
    draws = np.full(3000, 50)
    w = resample.row_weights(draws, 20, [1, 2, 3])
    assert (w.sum(1) == 50).all()
    chi = ((w - 2.5) ** 2 / 2.5).sum(1)
    assert abs(chi.mean() - 19) < 0.6 and abs(chi.var() - 38) < 8
    assert (resample.row_weights(np.array([0, 3]), 4, [5]).sum(1) == [0, 3]).all()


def brute(rows, weights):
    """(mae, auroc) of weighted (y, pred, gate) rows."""
    known = [(abs(p - y), w) for (y, p, _), w in zip(rows, weights, strict=True) if p is not None and y is not None]
    total = sum(w for _, w in known)
    mae = sum(e * w for e, w in known) / total if total else None
    pos = [(-p, w) for (_, p, g), w in zip(rows, weights, strict=True) if g is True and p is not None]
    neg = [(-p, w) for (_, p, g), w in zip(rows, weights, strict=True) if g is False and p is not None]
    below = sum(w * v * ((s > t) + (s == t) / 2) for s, w in pos for t, v in neg)
    pairs = sum(w for _, w in pos) * sum(v for _, v in neg)
    return mae, below / pairs if pairs else None


@pytest.mark.parametrize("spread", [6, 1000])
def test_replicates_equal_brute_force_from_their_weights(spark, monkeypatch, spread):
    monkeypatch.setattr(resample, "RUN", 16)
    monkeypatch.setattr(resample, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 3 else None, None if i % 17 == 0 else float(rng.integers(0, spread)), None if i % 11 == 0 else float(rng.integers(0, spread)), [True, False, None][rng.integers(0, 3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "example_id long, g string, y double, pred double, gate boolean")
    got = {(r["g"], r["replicate"]): (r["mae"], r["auroc"]) for r in resample.bootstrap(df, ["g"], b=20).collect()}
    assert len(got) == 40
    hashes = dict(df.selectExpr("example_id", "xxhash64(example_id)").collect())

    for g in ("a", None):
        own = sorted([r for r in rows if r[1] == g], key=lambda r: (float("-inf") if r[3] is None else -r[3], hashes[r[0]], r[0]))
        base = [42, zlib.crc32(json.dumps({} if g is None else {"g": g}, separators=(",", ":")).encode())]
        runs = -(-len(own) // 16)
        weights = []
        for run in range(runs):
            k = len(own[run * 16 : run * 16 + 16])
            draws = resample.run_draws(len(own), run, 16, base, 20)
            weights.append(np.concatenate([resample.row_weights(draws[at : at + 7], k, [*base, run, at, 1]) for at in range(0, 20, 7)]))
        weights = np.concatenate(weights, axis=1)
        assert (weights.sum(1) == len(own)).all()
        for rep in range(20):
            mae, auroc = brute([r[2:] for r in own], weights[rep])
            assert got[g, rep][0] == pytest.approx(mae) and got[g, rep][1] == pytest.approx(auroc)


def test_null_errors_stay_out_of_the_interval(spark):
    rows = [(i, None if i % 2 else 5.0 + i, float(i), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "example_id long, pred double, y double, gate boolean")
    assert metrics.mae(df, []).first()["mae"] == 5.0
    for mode in ("multinomial", "exact", "poisson"):
        r = metrics.bootstrap_ci(df, [], b=30, mode=mode).first()
        assert (r["mae_lo"], r["mae_hi"]) == (5.0, 5.0), mode
    both = df.selectExpr("*", "y + 2 as other")
    r = metrics.paired_delta(both, [], pred_a="pred", pred_b="other", b=30).first()
    assert (r["d_mae_lo"], r["d_mae_hi"]) == (3.0, 3.0)


def test_intervals_agree_with_the_exact_draws(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(y), float(y + rng.normal() * 5), bool(y < 40)) for i, y in enumerate(rng.uniform(0, 80, 400))]
    df = spark.createDataFrame(rows, "example_id long, y double, pred double, gate boolean")
    a, b = (metrics.bootstrap_ci(df, [], b=400, mode=m).first() for m in ("multinomial", "exact"))
    for c in ("mae_lo", "mae_hi"):
        assert abs(a[c] - b[c]) < 0.12
    for c in ("auroc_lo", "auroc_hi"):
        assert abs(a[c] - b[c]) < 0.004
    assert a["auroc_replicates"] == 400 and metrics.bootstrap_ci(df.limit(0), ["gate"], b=5).collect() == []


def word(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


@pytest.mark.parametrize("picks", [40, 1 << 21])
def test_exact_draws_are_counted_by_number_once_per_size(spark, monkeypatch, picks):
    monkeypatch.setattr(resample, "PICKS", picks)
    rows = [(g, i, float(i)) for g, n in (("a", 57), (None, 57), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    sizes = spark.createDataFrame([(57,), (3,)], "_n long")
    assert resample.drawn_weights(sizes, 4, 9).count() == 60  # groups of one size share their draws
    got = {(r["g"], r["k"]): list(r["weights"]) for r in metrics.drawn(df, ["g"], "k", 4, 9).collect()}
    for g, n in (("a", 57), (None, 57), ("c", 3)):
        own = sorted(range(n), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
        for r in range(4):
            times = Counter(own[word(f"9:{r}:{j}") % n] for j in range(n))
            assert [got[g, i][r] for i in range(n)] == [times[i] for i in range(n)]


def test_paired_delta_finds_its_draws_once(spark):
    df = spark.range(200).selectExpr("id AS example_id", "cast(id % 80 AS double) AS y", "id % 80 < 40 AS gate", "cast(id % 70 AS double) AS a", "cast(id % 60 AS double) AS c")
    out = metrics.paired_delta(df, [], pred_a="a", pred_b="c", b=5)
    # what follows the sums per replicate and score does not see a draw again
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString() and out.first()["auroc_replicates"] == 5


def test_poisson_weights_hash_a_key_once(spark):
    df = spark.createDataFrame([(k, c) for k in [*range(30), None] for c in "ab"], "example_id long, c string").selectExpr("*", "1D AS y", "2D AS pred", "true AS gate")
    got = metrics.poisson(df, "example_id", 6, 42)
    assert got.count() == 62
    term, steps = 0.36787944117144233, [0.0]
    for k in range(1, 12):
        steps.append(steps[-1] + term)
        term /= k
    for r in got.collect():
        u = [word(f"42:{i}" + ("" if r["example_id"] is None else f":{r['example_id']}")) / 2**48 for i in range(6)]
        assert list(r["weights"]) == [sum(x >= t for t in steps[1:]) for x in u]
    # a test of the weight above the hashes would hash once per step
    assert "md5" not in metrics._replicates(got)._jdf.queryExecution().optimizedPlan().toString()


def test_several_metrics_share_their_draws(spark):
    df = spark.range(120).selectExpr("id AS example_id", "id % 3 = 0 AS gate", "cast(id % 50 AS double) / 50 AS p", "cast(id % 50 AS double) AS score")
    given = {"brier": lambda rows, keys, w: metrics.brier(rows, keys, weight=w), "average_precision": lambda rows, keys, w: metrics.average_precision(rows, keys, weight=w)}
    both = {r["metric"]: (r["lo"], r["hi"]) for r in metrics.bootstrap_metrics(df, [], given, b=8).collect()}
    for name, f in given.items():
        r = metrics.bootstrap_metric(df, [], f, name, b=8).first()
        assert both[name] == pytest.approx((r["lo"], r["hi"]))
    assert "md5" not in metrics.bootstrap_metrics(df, [], given, b=8)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_are_alike_are_drawn_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(resample, "RUN", 16)
    df = spark.range(6000).selectExpr("id AS example_id", "CASE WHEN id % 7 > 0 THEN 'a' END AS g", "cast(id * id % 11 AS double) AS y", "CASE WHEN id % 13 > 0 THEN cast(id % 5 AS double) END AS pred", "id % 3 = 0 AS gate")
    sums, _ = resample.resampled_sums(df, ["g"], key="example_id", y="y", pred="pred", gate="gate", b=300, seed=1)
    assert sums.select("_g", "run").distinct().count() < 6000 // 16 // 2  # runs of cells, not of rows
    told = [{(r["g"], r["replicate"]): (r["mae"], r["auroc"]) for r in resample.bootstrap(df, ["g"], b=300).collect()} for _ in range(2)]
    assert told[0] == told[1] and len(told[0]) == 600
    monkeypatch.setattr(resample, "ALIKE", float("inf"))
    plain = {(r["g"], r["replicate"]): (r["mae"], r["auroc"]) for r in resample.bootstrap(df, ["g"], b=300).collect()}
    for g in ("a", None):
        for m in (0, 1):
            new, old = (np.array([v[m] for k, v in t.items() if k[0] == g]) for t in (told[0], plain))
            assert abs(new.mean() - old.mean()) < 5 * old.std() / np.sqrt(150) and 0.8 < new.std() / old.std() < 1.25


def test_hashed_numbers_equal_md5():
    for first in (b"42:7:", b"-1:999:", b"7:0:", b"123456:10:", b"9" * 47 + b":", b"9" * 48 + b":", b"9" * 60 + b":"):
        for lo, hi in ((0, 12_345), (98_765, 111_111), (8_999_990, 9_000_600), (9_999_000, 10_001_000), (5, 6)):
            got = np.concatenate(list(resample.hashed_numbers(first, lo, hi)))
            assert len(got) == hi - lo
            for j in {lo, hi - 1, (lo + hi) // 2, min(hi - 1, max(lo, 9_999)), min(hi - 1, max(lo, 10_000)), *np.random.default_rng(lo).integers(lo, hi, 40).tolist()}:
                assert got[j - lo] == word(first.decode() + str(j))


@pytest.mark.parametrize("limits", [{}, {"WIDTH": 8, "PICKS": 40}, {"WIDTH": 8, "PICKS": 20, "DENSE": 10}, {"WIDTH": 1, "PICKS": 7, "DENSE": 1}])
def test_rows_that_are_alike_have_the_sum_of_their_weights(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(resample, name, value)
    rows = [(g, i, None if i % 5 == 0 else float(i % 3)) for g, n in (("a", 57), (None, 57), ("c", 3), *((f"x{k}", 9) for k in range(12))) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    want, got = Counter(), Counter()
    for r in metrics.drawn(df, ["g"], "k", 6, 9).collect():
        want.update({(r["g"], r["v"], i): w for i, w in enumerate(r["weights"])})
    told = metrics._drawn_sums(df, ["g"], "k", 6, 9).collect()
    for r in told:
        got.update({(r["g"], r["v"], r["_first"] + i): w for i, w in enumerate(r["weights"])})
    assert +want == +got and sum(want.values()) == 6 * len(rows)
    if not limits:
        assert len(told) == 4 * 15 - 1  # "c" has three rows


def test_weights_are_never_sent_to_the_driver(spark):
    df = spark.range(3000).selectExpr("id AS example_id", "id % 3 AS g", "cast(id % 70 AS double) AS y")
    for by in ([], ["g"]):
        plan = metrics.drawn(df, by, "example_id", 20, 7)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [_n" in plan and "BroadcastHashJoin [_n" not in plan
        # here draws are in no join; the one broadcast is that of the sizes
        plan = metrics._drawn_sums(df, by, "example_id", 20, 7)._jdf.queryExecution().sparkPlan().toString()
        above, _, below = plan.partition("MapInArrow summed")
        assert below and "Join" not in above and "Join" not in below.partition("MapInArrow picked")[2]


def test_paired_delta_equals_brute_force_from_its_weights(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 3 else None, None if i % 17 == 0 else float(rng.integers(0, 20)), *(None if rng.random() < 0.1 else float(rng.integers(0, 9)) for _ in "ab"), [True, False, None][rng.integers(0, 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "example_id long, g string, y double, a double, c double, gate boolean")
    drawn = metrics.drawn(df, ["g"], "example_id", 8, 3).collect()
    for got in metrics.paired_delta(df, ["g"], pred_a="a", pred_b="c", b=8, seed=3).collect():
        own, deltas = [r for r in drawn if r["g"] == got["g"]], []
        for rep in range(8):
            weights = [r["weights"][rep] for r in own]
            known = [(abs(r["a"] - r["y"]) - abs(r["c"] - r["y"]), w) for r, w in zip(own, weights, strict=True) if None not in (r["a"], r["c"], r["y"])]
            areas = [brute([(r["y"], r[p], r["gate"]) for r in own], weights)[1] for p in "ac"]
            deltas.append((sum(d * w for d, w in known) / sum(w for _, w in known), areas[0] - areas[1]))
        for i, m in enumerate(("d_mae", "d_auroc")):
            assert (got[f"{m}_lo"], got[f"{m}_hi"]) == pytest.approx(tuple(np.percentile([d[i] for d in deltas], (2.5, 97.5))))
        assert got["auroc_replicates"] == 8


def test_bootstrap_metrics_takes_a_thousand_replicates(spark):
    from cairn.plans import queries

    rows = queries.QUERIES["bootstrap_metrics"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 6 and all(r["replicates"] + r["discarded"] == 1000 for r in rows)
    assert "range(1000)" in queries.ORACLES["bootstrap_metrics"] and "range(20)" in queries.ORACLES["bootstrap_ci"]
