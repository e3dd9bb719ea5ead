"""Ranked lexical search against brute force, its bounds, and its edge cases."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import ranked
from cairn.llm.common import table

SF = "/root/testdata/sf0.001"
DOC, ITEM = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, q in asked.items():
        scored = []
        for d, t in own:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in q if x in t)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out |= {(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def got(spark, docs, items, **how):
    rows = ranked.rank(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **how).collect()
    found = {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_terms_as_the_pattern_has_them():
    text = "Don't stop-ME äÖ_x 12\x7f3 ÀB€c\x00D \t naïve"
    assert [t.decode() for t in ranked.terms_of(text)] == terms(text)


def test_equal_to_brute_force_whatever_the_buckets(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "THE"]
    pick = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(400)] + [(1000 + i, "w1 w2 w3 same") for i in range(30)]
    docs += [(None, "w1 w2 w3 same"), (None, None), (2000, ""), (2001, ".,;"), docs[3], docs[3], (2002, "w5 " * 20000)]
    items = [(i, pick(rng.randint(1, 12))) for i in range(25)] + [(100, "same W3"), (101, None), (102, ""), (103, "unheard"), (None, "w7 w8"), (0, "naïve über"), (104, "the the THE")]
    want = brute(docs, items)
    for bucket, first in ((8, 16), (100000, 1)):
        monkeypatch.setattr(ranked, "BUCKET", bucket)
        monkeypatch.setattr(ranked, "FIRST", first)
        assert got(spark, docs, items) == want
    assert got(spark, docs, items, block_terms=20) == want
    assert got(spark, docs, items, k=3) == {r for r in want if r[1] <= 3}


def test_a_term_in_all_documents(spark):
    docs = [(i, "aa bb") for i in range(3000)]
    # (2N+2)/(2N+1) is above 1 by so little that the weight is 0: no document scores above 0
    assert got(spark, docs, [(1, "aa")]) == brute(docs[:3000], [(1, "aa")]) == set()
    few = docs[:100]
    assert got(spark, few, [(1, "aa")]) == brute(few, [(1, "aa")]) and len(got(spark, few, [(1, "aa")])) == 10


def test_survivors_lose_no_row():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ids = [np.sort(rng.choice(40, rng.integers(1, 15), replace=False)) for _ in range(200)]
        impacts = [rng.integers(1, 10**6, len(i)) for i in ids]
        weights = rng.integers(0, 9000, 40)
        norms = np.array([math.sqrt((p**2 * weights[i]).sum()) for i, p in zip(ids, impacts, strict=True)])
        order = np.argsort(-norms)
        own, focus, rest, length = ranked.focus_of(np.sort(rng.choice(40, 8, replace=False)), weights[np.sort(rng.choice(40, 8, replace=False))])
        w = weights[own]
        full = float(w.sum()) ** 0.5
        rest = float(w[focus:].sum()) ** 0.5
        bucket = ranked.Bucket(norms[order], np.concatenate([ids[i] for i in order]).astype(np.int32), np.array([len(ids[i]) for i in order]), np.concatenate([impacts[i] for i in order]))
        true = np.array([sum(int(weights[t]) * int(p) for t, p in zip(ids[i], impacts[i], strict=True) if t in own) for i in order])
        assert (bucket.scores(own, w, np.arange(200)) == true).all()
        for least in (0.0, float(np.median(true)), float(true.max())):
            kept = bucket.survivors(own, w, focus, rest, full, least)
            assert set(np.flatnonzero(true >= max(least, 1))) <= set(kept.tolist())


def test_empty_tables_ids_of_text_and_clashing_columns(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [], []) == set()
    docs = spark.createDataFrame([(f"d{i}", f"alpha beta{i}") for i in range(5)], "doc_id string, text string")
    items = spark.createDataFrame([("q", "alpha beta3")], "item_id string, text string")
    rows = ranked.rank(docs, items).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["d3", "d0", "d1", "d2", "d4"]
    plain, asked = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "benchmark")
    names = "n ids tf term norm impact item_id score rank least query id".split()
    clash = plain.select("*", *[F.lit("x").alias(n) for n in names])
    clash_items = asked.select("*", *[F.lit("x").alias(n) for n in ("term", "score", "rank", "doc_id", "n")])
    assert set(map(tuple, ranked.rank(clash, clash_items).collect())) == set(map(tuple, ranked.rank(plain, asked).collect()))
