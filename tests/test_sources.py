"""Prediction dumps in byte ranges, the bucketed cache, and profiles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.sources import cache, dumps, tables


def test_a_dump_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    n = 3000
    block = lambda: {"pred": [rng.choice([None, rng.randint(-9, 9), rng.random()]) for _ in range(n)], "y": [rng.random() for _ in range(n)], "gate": [rng.choice([True, False]) for _ in range(n)], "other": [1, 2]}
    body = {"note": "a, [b] {c}", "count": 3, "predictions": {"full": block(), "a_dropped": block(), "unread": {"y": [1]}}, "tail": [1]}
    body.pop("note")  # texts with brackets are no dump
    for name, indent in (("flat", None), ("wide", 2)):
        path = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=indent))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        try:
            out = dumps.read_dumps(spark, path, ["full", "a_dropped"])
            assert dumps._tokens(spark, path).select("file").rdd.getNumPartitions() >= 4
            got = {(r["condition"], r["position"]): (r["y"], r["pred"], r["gate"]) for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = {(c, i): (b["y"][i], None if b["pred"][i] is None else float(b["pred"][i]), b["gate"][i]) for c, b in body["predictions"].items() if c != "unread" for i in range(n)}
        assert got == want


def test_faulty_dumps(spark, tmp_path):
    def read(text, conditions=("full",)):
        (tmp_path / "p.json").write_text(text)
        return sorted(map(tuple, dumps.read_dumps(spark, str(tmp_path / "p.json"), list(conditions)).select("condition", "position", "y", "pred", "gate").collect()))

    assert read('{"full": {"y": [35], "pred": [36], "gate": [true]}}') == [("full", 0, 35.0, 36.0, True)]
    assert read('{"full": {"y": [ ], "pred": [], "gate": [\n]}}') == []
    assert read('{"full": {"y": [1, 2], "pred": ["NaN", null], "gate": [true, false]}}')[1] == ("full", 1, 2.0, None, False)
    with pytest.raises(ValueError, match="no predictions"):
        read('{"full": {"y": [1], "pred": [1], "gate": [true]}}', ["full", "b_dropped"])
    with pytest.raises(ValueError, match="no predictions"):
        read('{"full": {"y": [1], "gate": [true]}}')
    with pytest.raises(ValueError, match="have lengths"):
        read('{"full": {"y": [1, 2], "pred": [1], "gate": [true, false]}}')
    with pytest.raises(ValueError, match="inside"):
        read('{"full": {"y": [[1, 2], [3]], "pred": [1], "gate": [true]}}')


def test_dumps_written_in_files(spark, tmp_path):
    rows = [(i, c, float(i), i / 3, i % 2 == 0) for i in range(500) for c in ("a", "b") if c == "a" or i % 3]
    df = spark.createDataFrame(rows, "example_id long, condition string, y double, pred double, gate boolean")
    dumps.write_dumps(df, str(tmp_path / "d"), conditions=["a", "b"], rows=60)
    files = list((tmp_path / "d").rglob("part-*"))
    assert len([f for f in files if not f.name.endswith(".crc")]) >= 8
    out = dumps.read_dumps(spark, str(tmp_path / "d"), ["a", "b"], {"example_id": "long"} | dumps.FIELDS)
    assert sorted((r["example_id"], r["condition"], r["y"], r["pred"], r["gate"]) for r in out.collect()) == sorted(rows)


def rows_of(spark, ids, shift=0.0):
    return spark.createDataFrame([(i, [float(len(i)), shift]) for i in ids], "id string, embedding array<double>")


def test_a_look_up_reads_its_bucket_alone(spark, tmp_path):
    c = cache.VectorCache(spark, str(tmp_path / "c"), "a", "v1", buckets=16)
    ids = [f"id{i}" for i in range(200)]
    c.append(rows_of(spark, ids))
    one = spark.createDataFrame([("id7",), ("none",)], "id string")
    assert c.has("id7") and not c.has("none")
    assert [r["id"] for r in c.missing(one).collect()] == ["none"] and [r["id"] for r in c.lookup(one).collect()] == ["id7"]
    read = c._rows(c._buckets_of(one))
    whole = len(c._rows().inputFiles())
    metrics = {m: 0 for m in ("files", "parts")}
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.partition("PartitionFilters")[2][:300]
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) <= 2 < whole and metrics
    assert cache.VectorCache(spark, str(tmp_path / "c"), "a", "v1", buckets=99).buckets == 16  # fixed by the first


def test_writes_that_failed_or_clash(spark, tmp_path):
    c = cache.VectorCache(spark, str(tmp_path / "c"), "a", "v1")
    c.append(rows_of(spark, ["x"]))
    # a write that took a number and wrote rows, but was never done
    lost = c._take_number()
    other = cache.VectorCache(spark, str(tmp_path / "c"), "a", "v2")
    assert other._take_number() == lost + 1  # two writers never share a number
    rows_of(spark, ["y"]).selectExpr("id", "cast(embedding as array<float>) embedding", "'v' encoder_version", "2 dim", "current_timestamp() written_at", f"{lost}L written", "'a' modality", "0 bucket", f"{lost}L seq").write.mode("append").partitionBy("modality", "bucket", "seq").parquet(f"{c.path}/rows")
    assert [r["id"] for r in c.keys().collect()] == ["x"] and not c.has("y")
    other.append(rows_of(spark, ["x", "z"], 5.0), overwrite=True)
    assert {r["id"]: (r["embedding"], r["encoder_version"]) for r in c.read().collect()} == {"x": ([1.0, 5.0], "v2"), "z": ([1.0, 5.0], "v2")}


def test_compaction_keeps_what_counts(spark, tmp_path):
    c = cache.VectorCache(spark, str(tmp_path / "c"), "a", "v1")
    b = cache.VectorCache(spark, str(tmp_path / "c"), "b", "v1")
    b.append(rows_of(spark, ["own"]))
    for k in range(3):
        c.append(rows_of(spark, ["p", f"q{k}"], float(k)), overwrite=True)
    under_way = c._take_number()  # a write that began before the compaction and ends after it
    before = sorted(map(tuple, c.read().collect()), key=str)
    c.compact()
    assert sorted(map(tuple, c.read().collect()), key=str) == before and c._rows().count() == 4
    c._write(rows_of(spark, ["p", "late"], 9.0).selectExpr("id", "cast(embedding as array<float>) embedding", "'v1' encoder_version", "2 dim", "current_timestamp() written_at", f"{under_way}L written"), under_way, [])
    assert {r["id"]: r["embedding"][1] for r in c.read().collect()} == {"p": 9.0, "late": 9.0, "q0": 0.0, "q1": 1.0, "q2": 2.0}
    size = c.stats().first()["disk_bytes"]
    c.clean()
    assert c.stats().first()["disk_bytes"] < size and c.read().count() == 5 and b.has("own")


def test_names_and_values_that_are_no_entries(spark, tmp_path):
    for name in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError, match="path"):
            cache.VectorCache(spark, str(tmp_path / "c"), name, "v")
    c = cache.VectorCache(spark, str(tmp_path / "c"), "a", "v")
    for bad in ([(None, [1.0])], [("x", None)], [("x", [])]):
        with pytest.raises(ValueError, match="no id or no vector"):
            c.append(spark.createDataFrame(bad, "id string, embedding array<double>"))
    c.append(rows_of(spark, ["b/../c", "b", "B"]))
    assert [r["id"] for r in c.keys().collect()] == ["B", "b", "b/../c"] and c.has("b/../c")
    s = c.stats().first()
    assert (s["n"], s["bytes"], s["dim"]) == (3, 24, 2) and s["disk_bytes"] > 0


def test_profile_without_expand(spark):
    df = spark.createDataFrame([(1, "a", [1.0], 0.0), (2, None, [1.0], -0.0), (2, None, None, float("nan"))], "k int, v string, e array<double>, f double")
    out = tables.profile(df, ["k", "v", "e", "f"])
    assert {r["column"]: tuple(r)[1:] for r in out.collect()} == {"k": (3, 0, 2, 1), "v": (3, 2, 2, 1), "e": (3, 1, 2, 1), "f": (3, 0, 2, 1)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[1:] for r in tables.profile(df.limit(0), ["k", "v"]).collect()} == {(0, 0, 0, 0)}


def test_reading_dumps_scans_the_files_twice_at_the_end(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({c: {"y": [1.5, None], "pred": [2, 3], "gate": [True, None]} for c in ("a", "b")}))
    out = dumps.read_dumps(spark, str(tmp_path), ["a", "b"])
    assert sorted((r["condition"], r["position"], r["y"], r["pred"], r["gate"]) for r in out.collect()) == [(c, i, *v) for c in "ab" for i, v in enumerate([(1.5, 2.0, True), (None, 3.0, None)])]
    # once for the counts of the ranges, once for the cells; where the arrays lie is known by then
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
