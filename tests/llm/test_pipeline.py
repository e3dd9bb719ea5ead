"""The corpus pipeline, stage by stage, against brute force on the stage's own input."""

import sys

import pytest

import corpus_pipeline
from cairn.llm import toxicity
from cairn.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output frame) of each stage, written and read again."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing"]
    for _, before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_toxic_documents_go_and_others_stay(spark, stages):
    _, before, after = stages[0]
    lexicon = toxicity.learn(before, table(spark, SF, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(before, lexicon).where("predicted = 1").collect()}
    kept = {r["doc_id"]: r for r in after.collect()}
    assert set(kept) == {r["doc_id"] for r in before.collect()} - toxic
    assert all(kept[r["doc_id"]] == r for r in before.collect() if r["doc_id"] in kept)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    ids = sorted(sets)
    close = {}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a]) <= 2 * len(sets[b]) <= 4 * len(sets[a]) and (s := similar(sets[a], sets[b])) >= 0.6:
                close.setdefault(a, []).append((b, s))
                close.setdefault(b, []).append((a, s))
    # what went has a similar document; of surely similar ones not both stay
    assert all(d in close for d in ids if d not in kept)
    assert not [(a, b) for a in kept for b, s in close.get(a, []) if s >= 0.9 and b in kept]


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    kept = {r["doc_id"] for r in after.collect()}
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [plain(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for r in before.collect():
        text = plain(r["text"] or "")
        if any(i in text for i in items):
            assert r["doc_id"] not in kept
        elif not any(" ".join(w[k : k + 7]) in text for i in items for w in [i.split()] for k in range(len(w) - 6)):
            assert r["doc_id"] in kept


def test_mix_of_what_is_left(stages):
    _, before, after = stages[3]
    rows = after.collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == size and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(size.values()))
    assert all(t <= 3 * n + 1e-6 and abs(taken - t) <= max(20, 0.01 * t) for taken, t, n in by.values())


def test_run_equals_the_stages(spark, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, stages[-1][2].collect()))
    assert "corpus_pipeline" in sys.modules and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "b", 0), (2, "", "en", None, 0), (None, " ", None, "a", 1), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "one", "en", "a", 3), (5, "w " * 60_000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (len(rows), 0):
        now = docs.limit(n)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            now.write.parquet(f"{tmp_path}/{n}-{i}")
            now = spark.read.parquet(f"{tmp_path}/{n}-{i}")
            if name == "simhash_near_dedup":
                assert sorted((r["doc_id"] for r in now.collect()), key=str) == ([1, 4, 5] if n else [])


def test_columns_of_clashing_names_change_nothing(spark):
    from pyspark.sql import functions as F

    from cairn.llm import decontam, lm, mixing, search, simhash

    names = "_head _bad _id _n _key _s _u h head item_id row size rn start rank taken target score predicted hits node key root a b fp wide salt n k word words kind chunk bucket blob held ids term df shard q part group slots pos form window token tokens label toxic".split()
    plain = table(spark, SF, "documents").where("doc_id % 3 = 0").select("doc_id", "text", "source", "lang", "n_chars")
    clash = plain.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
    labels, items = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    lexicon = toxicity.Lexicon({"the": 1.0}, (), (-1.0, 1.0, 0.5))
    ids = ["doc_id", "text"]
    for of in (
        mixing.mix,
        lambda docs: toxicity.score(docs, lexicon),
        lambda docs: toxicity.kept(docs, lexicon).select(ids),
        lambda docs: toxicity.score(plain, toxicity.learn(docs, labels.withColumn("text", F.lit("y")).withColumn("n", F.lit(1)))),
        lm.score,
        simhash.simhash_groups,
        lambda docs: simhash.one_of_each(docs, simhash.near_copies(docs)).select(ids),
        lambda docs: decontam.clean(docs, items.withColumn("doc_id", F.lit(1)).withColumn("h", F.lit(1))).select(ids),
        lambda docs: search.search(docs, docs.where("doc_id % 20 = 0"), k=3),
    ):
        assert sorted(map(str, of(clash).collect())) == sorted(map(str, of(plain).collect()))
