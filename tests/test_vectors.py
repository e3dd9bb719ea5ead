"""Parsing of vectors and matrices, booleans of numbers, digests of id lists, attention on long tokens, pooled probes."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import models, pooling, splits


def test_matrices_and_vectors(spark):
    texts = ["[[1,2],[3,4]]", "((1 2), (3, nan))", "[1, 2]", "7", "[[1,2],[3]]", "[[1],[x]]", "", None, "[]", "[[]]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.parse_matrix("t").alias("m")).collect()
    got = {r["t"]: r["m"] for r in rows}
    assert got["[[1,2],[3,4]]"] == [[1.0, 2.0], [3.0, 4.0]] and got["[1, 2]"] == [[1.0, 2.0]] and got["7"] == [[7.0]]
    assert got["((1 2), (3, nan))"][0] == [1.0, 2.0] and math.isnan(got["((1 2), (3, nan))"][1][1])
    assert all(got[t] is None for t in ("[[1,2],[3]]", "[[1],[x]]", "", None, "[]", "[[]]"))
    with pytest.raises(Exception, match="a matrix, not a vector"):
        spark.createDataFrame([("[[1,2],[3,4]]",)], "t string").select(S.parse_vector("t")).collect()
    assert spark.createDataFrame([("[1,2]",)], "t string").select(S.parse_vector("t").alias("v")).first()["v"] == [1.0, 2.0]


def test_numbers_are_true_if_nonzero(spark):
    df = spark.createDataFrame([(2, 0.5, 2.0, "2", True), (0, 0.0, -1.0, "0", False), (None, float("nan"), None, None, None)], "i int, f double, d double, s string, b boolean").withColumn("d", F.col("d").cast("decimal(9,2)"))
    assert [tuple(r) for r in df.select(*[S.boolean(c).alias(c) for c in df.columns]).collect()] == [(True, True, True, None, True), (False, False, True, False, False), (None, None, None, None, None)]
    assert [r[0] for r in df.select(S.strict_boolean("i")).collect()] == [True, False, False]


def test_digest_tree(spark):
    ids = [f"p{i:05d}" for i in range(2000)]
    rows = [("a", i) for i in ids] + [("b", i) for i in ids[:30]] + [("b", None), ("a", ids[0]), (None, "x")]
    df = spark.createDataFrame(rows, "split string, id string")
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    for parts in (1, 7):
        got = {r["split"]: (r["n"], r["sha256"]) for r in splits.sha256_of_ids(df.repartition(parts), "id", "split").collect()}
        assert got == {"a": (2000, sha(ids)), "b": (30, sha(ids[:30])), None: (1, sha(["x"]))}
        small = {r["split"]: r["sha256"] for r in splits.sha256_of_ids(df.repartition(parts), "id", "split", width=40, fan=8).collect()}
        level = [sha(ids[i : i + 40]) for i in range(0, 2000, 40)]
        while len(level) > 1:
            level = [sha(level[i : i + 8]) if len(level[i : i + 8]) > 1 else level[i] for i in range(0, len(level), 8)]
        assert small == {"a": level[0], "b": sha(ids[:30]), None: sha(["x"])}
    numbers = spark.createDataFrame([("a", i) for i in (10, 9, 100)], "split string, id long")
    assert splits.sha256_of_ids(numbers, "id", "split").first()["sha256"] == sha(["9", "10", "100"])


def test_long_tokens_pool_alike(spark):
    rng = np.random.default_rng(5)
    d = 24
    rows = [(i, None if i == 3 else [None if rng.random() < 0.2 else rng.standard_normal(d).tolist() for _ in range(rng.integers(0, 6))]) for i in range(40)] + [(99, [None, None])]
    df = spark.createDataFrame(rows, "id long, t array<array<double>>").repartition(3)
    q = rng.standard_normal(d).tolist()
    plain, fast = ({r["id"]: r for r in pooling.attentive_pool(df, "t", q, long_tokens=n).collect()} for n in (512, 1))
    assert plain.keys() == fast.keys() and pooling.attentive_pool(df, "t", q, long_tokens=1).columns == ["id", "t", "weights", "pooled"]
    for i in plain:
        for c in ("weights", "pooled"):
            a, b = plain[i][c], fast[i][c]
            assert (a or None) is None and (b or None) is None or np.allclose(a, b, atol=1e-12)
    with pytest.raises(Exception, match="not all of"):
        pooling.attentive_pool(df, "t", q[:-1], long_tokens=1).collect()
    assert pooling.attentive_pool(df.limit(0), "t", q, long_tokens=1).count() == 0


def test_pooled_and_single_probes(spark):
    rng = np.random.default_rng(6)
    w = rng.standard_normal(4)
    rows = []
    for k in range(60):
        centre = rng.standard_normal(4)
        y = float(centre @ w + 3)
        rows += [(k, None if rng.random() < 0.1 else (centre + rng.standard_normal(4) * 0.5).tolist(), y) for _ in range(rng.integers(1, 7))]
    df = spark.createDataFrame(rows, "key long, v array<double>, y double")
    out = models.pooled_and_single(df.where("key < 40"), df.where("key >= 40"), "key", "v", "y", alphas=[0.1, 1.0, 10.0])
    got = {r["key"]: r for r in out.collect()}

    def ridge(x, y, alphas):
        m, c = x.mean(0), y.mean()
        best = None
        for a in alphas:
            h = (x - m) @ np.linalg.solve((x - m).T @ (x - m) + a * np.eye(x.shape[1]), (x - m).T) + 1 / len(x)
            r = (y - c) - (h - 1 / len(x)) @ (y - c)
            loo = ((r / (1 - np.diag(h))) ** 2).mean()
            if best is None or loo < best[0]:
                best = (loo, np.linalg.solve((x - m).T @ (x - m) + a * np.eye(x.shape[1]), (x - m).T @ (y - c)))
        return lambda z: (z - m) @ best[1] + c

    clips = {}
    for k, v, y in rows:
        if v is not None:
            clips.setdefault(k, ([], y))[0].append(v)
    train = [k for k in clips if k < 40]
    one = ridge(np.array([v for k in train for v in clips[k][0]]), np.array([clips[k][1] for k in train for _ in clips[k][0]]), [0.1, 1.0, 10.0])
    mean = ridge(np.array([np.float32(np.mean(clips[k][0], 0)).astype(float) for k in train]), np.array([clips[k][1] for k in train]), [0.1, 1.0, 10.0])
    assert got.keys() == {k for k in clips if k >= 40}
    for k, r in got.items():
        assert r["y"] == pytest.approx(clips[k][1])
        assert r["single"] == pytest.approx(one(np.array(clips[k][0])).mean(), abs=1e-5) and r["pooled"] == pytest.approx(float(mean(np.mean(clips[k][0], 0))), abs=1e-5)


def test_the_sql_of_id_digests_is_the_tree_of_digests(spark, tmp_path):
    import duckdb

    from cairn.plans import queries

    path = str(tmp_path / "orders.parquet")
    spark.range(230_000).selectExpr("CASE WHEN id % 23 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus", "nullif(id, 7) AS o_custkey").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    told = {r[0]: r[1:] for r in con.sql(queries.ORACLES["id_fingerprint"]).fetchall()}
    assert told["O"][0] == 219_999 and {r["split"]: (r["n"], r["sha256"]) for r in queries.id_fingerprint(spark, str(tmp_path)).collect()} == told


def test_attention_of_many_tokens_grows_with_their_number(spark):
    import time

    df = spark.range(60).selectExpr("id", "transform(sequence(1, 192), i -> array(cast(i * id % 7 AS double), 1D)) AS t")
    out = pooling.attention_spread(pooling.attentive_pool(df, "t", [0.5, 0.25]), "weights")
    began = time.perf_counter()
    r = out.first()
    assert time.perf_counter() - began < 20  # minutes, if a lambda finds its constants anew for each element
    t = np.array([[[i * k % 7, 1.0] for i in range(1, 193)] for k in range(60)])
    e = np.exp(t @ [0.5, 0.25] / 2**0.5)
    w = e / e.sum(1, keepdims=True)
    assert r["max_range"] == pytest.approx(np.ptp(w, axis=1).max()) and r["mean_std"] == pytest.approx(w.std(1).mean())
