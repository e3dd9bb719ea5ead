"""Search, WARC, main text and language-model scores against brute force, round trips and held-out data."""

import bisect
import hashlib
import html as stdlib_html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import html, lm, search, warc

SF = "/root/testdata/sf0.001"


# Search ------------------------------------------------------------------------------------------


def brute_search(docs, queries, k):
    """docs and queries: lists of (id, text)."""
    bags = [(d, Counter(search.terms_of(t))) for d, t in docs]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / max(1, len(bags))
    df = Counter(t for _, b in bags for t in b)
    words = {}
    for q, t in queries:
        words.setdefault(q, set()).update(search.terms_of(t))
    out = {}
    for q, ts in words.items():
        rows = []
        for d, b in bags:
            norm = search.K1 * (1 - search.B + search.B * sum(b.values()) / max(mean, 1e-9))
            s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (search.K1 + 1) / (b[t] + norm) for t in ts if t in b)
            if s > 0:
                rows.append((-float(f"{s:.12g}"), d is None, d))
        out[q] = [(d, -s) for s, _, d in sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]
    return {q: v for q, v in out.items() if v}


def found(spark, docs, queries, k):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = {}
    for r in sorted(search.search(make(docs), make(queries), k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)
        assert {d for d, s in got[q] if s > want[q][-1][1] + 1e-8} == {d for d, s in want[q] if s > want[q][-1][1] + 1e-8}


def test_search_equals_brute_force_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 90)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(search, "SHARDS_AT_ONCE", 1)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    queries = [d for d in docs if d[0] % 20 == 0]
    same(found(spark, docs, queries, 7), brute_search(docs, queries, 7))


def test_search_edge_cases(spark):
    docs = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, ""), (3, None), (4, "A, (b)!"), (5, "z " * 30_000), (6, ".. !!"), (7, "é É")]
    queries = [(1, "a b"), (1, "c"), (2, ""), (3, None), (8, "nowhere"), (None, "a"), (5, "z"), (7, "É"), (9, "C b, a"), (11, "b a c c")]
    same(found(spark, docs, queries, 3), brute_search(docs, [q for q in queries if q[0] is not None], 3))
    assert found(spark, [], [], 3) == {} and found(spark, docs, [], 3) == {} and found(spark, [], queries, 3) == {}


def test_terms_in_all_documents_keep_their_results():
    texts = [np.array([0, 1] + [2] * (i % 7), np.int32) for i in range(3000)]
    index = search.Index(np.arange(3, dtype=np.int64), texts, 5.0)
    for weight in (1.0, 5e-7, 5e-10, 1e-14):  # log1p(0.5 / df) for up to 10^13 documents
        query = (np.array([0, 1]), np.array([weight, weight / 3]))
        full = index.exact(index.rare_sums([query])[0], index.common_weights(*query), np.arange(3000))
        assert (full > 0).all()
        for threshold in (0.0, np.sort(full)[-10]):
            (_, docs, scores), *rest = index.candidates([query], np.array([threshold]), 10)
            assert not rest and set(np.flatnonzero(full >= np.sort(full)[-10]).tolist()) <= set(docs.tolist()) and (scores == full[docs]).all()


def test_a_term_of_a_million_documents_on_spark(spark):
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("aa bb").alias("text"))
    rows = search.search(docs, spark.createDataFrame([(7, "aa")], "doc_id long, text string"), k=10).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in rows) == [(i + 1, i) for i in range(10)] and len({r["score"] for r in rows}) == 1 and rows[0]["score"] > 0


def test_pruned_index_equals_full_sums():
    rng = np.random.default_rng(1)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(0, 400)) - 1, 4999).astype(np.int32) for _ in range(3000)]
    index = search.Index(np.arange(5000, dtype=np.int64), texts, 200.0)
    assert index.dense.shape[1] > 10
    queries = [(t, np.log(1 + 3000 / (index.df[t] + 0.5))) for t in (np.unique(texts[i]) for i in range(60)) if len(t)]
    full = [index.exact(index.rare_sums([q])[0], index.common_weights(*q), np.arange(3000)) for q in queries]
    plain = np.zeros((60, 3000))
    for i, (terms, weights) in enumerate(queries):
        for x, w in zip(terms.tolist(), weights.tolist(), strict=True):
            span = slice(index.start[x], index.start[x + 1])
            plain[i, index.docs[span]] += index.impact[span] * w
    assert np.allclose(full, plain[: len(full)], atol=1e-8)
    for level in (0, 10, 1):
        thresholds = np.array([0.0 if not level else np.sort(f)[-level] for f in full])
        got = {i: docs for i, docs, _ in index.candidates(queries, thresholds, 10)}
        for i, f in enumerate(full):
            best = np.sort(f)[-10:]
            want = set(np.flatnonzero((f >= best[0]) & (f >= thresholds[i]) & (f > 0)).tolist())
            assert want <= set(got.get(i, np.empty(0, int)).tolist())


# WARC --------------------------------------------------------------------------------------------


def brute_warc(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        head = first.get(b) if len(b) >= 100 else None
        again = head is not None and head != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


ODD = [
    (1, "http://a/", "x" * 99), (2, "http://b/", "x" * 99), (5, None, "y" * 100), (3, "http://c/\r\nX: y", "y" * 100), (4, "http://é/", "é" * 50), (9, "u", "é" * 50), (6, "u", None), (7, "u", ""),
    (8, "u", "WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9), (None, "u", "y" * 100), (10, "u", "z" * 300_000 + "\r\n\r\n"), (3, "u", "w" * 200), (11, "u", "w" * 200), (3, "http://c/\r\nX: y", "y" * 100),
    (21, "u", "A" * 120), (22, "u", "B" * 120), (23, "u", "A" * 120), (23, "u", "B" * 120), (23, "v", "B" * 120), (None, "u", "A" * 120), (None, "u", "C" * 120), (None, "u", "D" * 120), (22, "u", "C" * 120),
]


def test_warc_round_trip(spark, tmp_path):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = ODD + [(p + 1000, u, h) for p, u, h in pages] + [(p + 9000, u, h) for p, u, h in pages[:20]]
    path = str(tmp_path / "w")
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path)
    got = sorted((tuple(r) for r in warc.inventory(spark, path).collect()), key=str)
    assert got == brute_warc(rows)
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).where("warc_type = 'response'").collect()}
    assert texts["urn:x-page:10"] == "z" * 300_000 + "\r\n\r\n" and texts["urn:x-page:6"] == ""
    uris = {r["record_id"]: r["target_uri"] for r in warc.read(spark, path).select("record_id", "target_uri").collect()}
    assert uris["urn:x-page:5"] is None and "\n" not in uris["urn:x-page:3"]


def test_warc_of_an_empty_table(spark, tmp_path):
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.inventory(spark, str(tmp_path / "e")).count() == 0


def test_warc_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    rows = [(i, f"http://{'a' if i % 2 else 'b'}/{i}", "t" * (100 + i % 3)) for i in range(30)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "p"))
    whole = warc.read(spark, str(tmp_path / "p"))
    some = whole.where("warc_type = 'revisit' and target_uri like 'http://a/%'")
    assert {r["record_id"] for r in some.collect()} == {f"urn:x-page:{i}" for i in range(3, 30) if i % 2}
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    reader = warc.WarcReader({"path": str(tmp_path / "p")}, whole.schema)
    assert list(reader.pushFilters([EqualTo(("warc_type",), "response"), StringStartsWith(("target_uri",), "http://b"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    files = reader.partitions()
    decoded = []
    with open(files[0].path, "rb") as f:
        list(warc.records(f, files[0].size, lambda h: decoded.append(h["warc-type"]) or False))
    assert len(decoded) + sum(1 for p in files[1:]) >= 1


def test_plain_and_foreign_records_are_read(tmp_path):
    import gzip
    import io

    plain = warc.response("urn:a", "http://a", b"hello", "d") + warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>"), ("Content-Type", "text/plain")], b"info\r\n\r\nWARC/1.0\r\n")
    zipped = gzip.compress(warc.response("urn:b", None, b"q" * 100_000, "d")) + warc.member(warc.response("urn:c", None, b"c", "d"))
    for data in (plain + zipped, zipped + plain):
        got = {f["warc-record-id"]: warc.payload_of(f, b) for f, b in warc.records(io.BytesIO(data), len(data), lambda f: True)}
        assert got == {"<urn:a>": b"hello", "<urn:i>": b"info\r\n\r\nWARC/1.0\r\n", "<urn:b>": b"q" * 100_000, "<urn:c>": b"c"}
        only = [f["warc-record-id"] for f, _ in warc.records(io.BytesIO(data), len(data), lambda f: f["warc-type"] == "warcinfo")]
        assert only == ["<urn:i>"]


# Main text ---------------------------------------------------------------------------------------


def test_viterbi_equals_enumeration():
    rng = random.Random(3)
    for _ in range(60):
        e = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 8))]
        moves = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y: sum(x for x, l in zip(e, y) if l) + sum(moves[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731, E741
        assert html.viterbi(e, moves) == list(max(itertools.product((0, 1), repeat=len(e)), key=value))


def test_blocks():
    page = '<title>t</title><nav><a href=x>m &amp; n</a></nav><article class="postBody"><p>a&nbsp;\n b<b>c</b><p>d<br>e</p><script>if (a<b) "</p>"</script><!-- x --></article><ul><li>1<li>2</ul>tail &am'
    got = [(b.text, [t for t, _ in b.path], b.linked > 0) for b in html.blocks_of(page)]
    assert got == [("m & n", ["nav", "a"], True), ("a bc", ["article", "p", "b"], False), ("d", ["article", "p"], False), ("e", ["article", "p"], False), ("1", ["ul", "li"], False), ("2", ["ul", "li"], False), ("tail &am", [], False)] or [t for t, *_ in got] == ["m & n", "a bc", "d", "e", "1", "2", "tail &am"]
    assert html.blocks_of("") == [] and [b.text for b in html.blocks_of("a < b <3 <")] == ["a < b <3 <"]


def test_blocks_in_linear_time():
    import time

    odd = ['<a "x', "<!", "<div>", "<b>", "</i>", '<a ">" ', "<!--", "<script>", "<p x='", "</", "&", "<td>"]
    began = time.perf_counter()
    for piece in odd:
        html.blocks_of(piece * (1_000_000 // len(piece)))
        html.blocks_of(piece * (300_000 // len(piece)) + '<p>tail</p>">')
    html.blocks_of("<b>" * 100_000 + "</i>" * 100_000)
    assert time.perf_counter() - began < 90
    assert [b.text for b in html.blocks_of('<p class="a>b">one</p> a </ b <p>two <3 <!-- x')] == ["one", "a </ b", "two <3"]


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(stdlib_html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_main_text_of_the_table_and_of_new_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.learn(pages, sample=120)
    got = {r["page_id"]: r for r in html.extract(pages, model).collect()}
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(got[p]["text"] == article_of(h) and got[p]["n_chars"] == len(got[p]["text"]) for p, h in rows.items())
    wrong = total = 0
    for i, page in enumerate(list(rows.values())[-60:]):
        rng = random.Random(i)
        strangers = [rng.choice(list(rows.values())).split("<p>")[-1].split("<")[0] or "x" for _ in range(8)]
        for names, labels in html.labelled_variants(page, strangers, 10_000 + i):
            told = html.viterbi([model.emission(x) for x in names], model.moves)
            wrong += sum(a != b for a, b in zip(told, labels, strict=True))
            total += len(labels)
    assert wrong <= 0.02 * total


def test_gradient_of_the_field_by_finite_differences():
    rng = np.random.default_rng(4)
    sizes = [4, 1, 6, 3]
    x = (rng.random((sum(sizes), 7)) < 0.4).astype(float)
    y = rng.integers(0, 2, sum(sizes))
    spot, row = np.full((4, 6), -1), 0
    for p, n in enumerate(sizes):
        spot[p, :n] = range(row, row + n)
        row += n
    w, moves = rng.standard_normal(7), rng.standard_normal((2, 2))
    loss, by_w, by_moves = html.objective(x, y, spot, w, moves, 0.3)
    # the likelihood itself by enumeration of all labellings
    total = 0.15 * (w @ w + (moves**2).sum())
    for p, n in enumerate(sizes):
        e = x[spot[p, :n]] @ w
        value = lambda labels: sum(v for v, l in zip(e, labels) if l) + sum(moves[a, b] for a, b in itertools.pairwise(labels))  # noqa: B023, B905, E731, E741
        every = [value(c) for c in itertools.product((0, 1), repeat=n)]
        total += np.logaddexp.reduce(every) - value(y[spot[p, :n]].tolist())
    assert loss == pytest.approx(total)
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (html.objective(x, y, spot, w + step, moves, 0.3)[0] - html.objective(x, y, spot, w - step, moves, 0.3)[0]) / 2e-6
        assert by_w[i] == pytest.approx(slope, abs=1e-5)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-6
        slope = (html.objective(x, y, spot, w, moves + step, 0.3)[0] - html.objective(x, y, spot, w, moves - step, 0.3)[0]) / 2e-6
        assert by_moves[a, b] == pytest.approx(slope, abs=1e-5)


def test_layouts_whose_names_no_training_page_had(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.learn(pages)
    assert "main" not in model.weights
    rows = [r["html"] for r in pages.orderBy("page_id").collect()]
    others = {"MAIN": "prose longread copy", "SIDE": "margin companion", "AD": "buynow dealbox", "NOTICE": "heads-up privacy-bar", "COMMENT": "talkback readers", "FOOT": "base imprint", "HEAD": "crown strip", "MENU": "links-row jump", "FORM": "fields ask-us"}
    for kind, names in others.items():
        monkeypatch.setattr(html, f"{kind}_NAMES", names.split())
    rng = random.Random(1)
    pool = [b.text for h in rows[:60] for b in html.blocks_of(h)]
    right = told_ = true_ = 0
    for i, page in enumerate(rows[-80:]):
        for names, labels in html.labelled_variants(page, [rng.choice(pool) for _ in range(12)], 777 + i):
            told = html.viterbi([model.emission(x) for x in names], model.moves)
            right += sum(a == b == 1 for a, b in zip(told, labels, strict=True))
            told_ += sum(told)
            true_ += sum(labels)
    assert right > 0.9 * told_ and right > 0.98 * true_


def test_pages_without_article_tags(spark):
    model = html.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    prose = "<p>This is a long article text, with words and commas. It goes on and on.</p><p>Another paragraph, quite long enough to be one of prose.</p>"
    want = " ".join(re.findall("<p>(.*?)</p>", prose))
    menu, foot = '<div class="menu"><a href="#">Home</a></div>', "<footer>&copy; 2020 Firm</footer>"
    comments = '<div class="comments"><p>I think that is a silly article, really. Thanks for it.</p></div>'
    for page in (f'{menu}<div class="post">{prose}</div>{comments}{foot}', f"{menu}<div>{prose}</div>{foot}", f"<nav><a href='#'>Home</a></nav><section>{prose}</section><form><label>Name</label><button>Send</button></form>"):
        assert html.main_text(f"<html><body>{page}</body></html>", model, {}) == want
    odd = f'<article>{prose}<p class="discussion">The discussion of the results, at some length, is here. It goes on.</p></article>'
    assert html.main_text(odd, model, {}).endswith("It goes on.")


def test_main_text_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (1, "u", "<article><p>" + "word " * 100_000 + "</p></article>"), (3, "u", "just text"), (3, "u", "just text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    model = html.learn(pages)
    got = html.extract(pages, model).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] == 2} == {""}
    assert html.extract(pages.limit(0), html.Crf()).count() == 0


# Language model ----------------------------------------------------------------------------------


def test_lm_base_and_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "Novel éÉ\x0bnovel"), (None, "a b"), (10_004, "the of"), (10_004, "the of"), (10_005, "word " * 50_000)], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("score", F.lit("x"))
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    count = Counter(w for r in rows if fold(r["doc_id"]) != 1 for w in tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((r["doc_id"], fold(r["doc_id"]) == 1, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r in rows for t in [tokens(r["text"])]),
        key=str,
    )
    got = lm.score(docs).collect()
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=str) == want
    held = [r for r in got if r["held_out"] and r["n_known"] > 20]
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_scores(rows, model, apart=20):
    """log10 probabilities text by text and token by token, with the model's weights and counts of our own."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    context = lambda w: (zlib.crc32(b"p" + (w if len(w) <= 5 else b"~" + w[:1] + w[-3:])) % 2047 + 1, zlib.crc32(b"s" + w) % 2047 + 1 if len(w) <= 3 else 0)
    class_of = lambda w: zlib.crc32(w if len(w) <= 4 else b"~" + w[-3:]) & 1023

    def walk(t):
        short = previous = earlier = 0
        for w in tokens(t):
            yield w, class_of(w), (short, previous, earlier)
            earlier = previous
            previous, own = context(w)
            short = own or short

    words, nodes = Counter(), [Counter() for _ in range(4)]
    for r in rows:
        if fold(r["doc_id"]) != 1:
            for w, cls, ctx in walk(r["text"]):
                words[w] += 1
                for depth in range(10):
                    node, bit = (1 << depth) + (cls >> (10 - depth)), cls >> (9 - depth) & 1
                    for k, c in enumerate((0, *ctx)):
                        nodes[k][c, node, bit] += 1
    in_class, kinds = Counter(), Counter()
    for w, n in words.items():
        in_class[class_of(w)] += n
        kinds[class_of(w)] += 1
    out = []
    for r in rows:
        total, seen, guesses = 0.0, Counter(), 0.0
        for place, (w, cls, ctx) in enumerate(walk(r["text"])):
            p = (words[w] + 0.5) / (in_class[cls] + 0.5 * (kinds[cls] + 1))
            for depth in range(10):
                node, bit = (1 << depth) + (cls >> (10 - depth)), cls >> (9 - depth) & 1
                z0, z1 = nodes[0][0, node, 0], nodes[0][0, node, 1]
                share = (z1 + 0.4) / (z0 + z1 + 0.8)
                x, evidence = [math.log(share / (1 - share))], []
                for k, c in enumerate(ctx, 1):
                    a, b = nodes[k][c, node, 0], nodes[k][c, node, 1]
                    x.append(math.log(b + 1.5 * share) - math.log(a + 1.5 * (1 - share)))
                    evidence.append(min(int(math.log2(a + b + 1) / 1.5), 7))
                gate = evidence[1] * 4 + (evidence[0] >> 1)
                z = sum(float(u) * v for u, v in zip(model.tables.weights[gate], x, strict=True))
                rungs = [k / 2 for k in range(-16, 17)]
                below = min(bisect.bisect_right(rungs, max(-8, min(8, z))) - 1, 31)
                part = (max(-8, min(8, z)) - rungs[below]) / 0.5
                rates = model.tables.rates[depth * 32 + gate]
                one = (1 / (1 + math.exp(-z)) + (1 - part) * rates[below] + part * rates[below + 1]) / 2
                p *= one if bit else 1 - one
            own = seen[w] / max(place, 1)
            share = (0.05 * 20 + guesses) / (20 + place) if place else 0.0
            total += math.log10((1 - share) * p + share * own)
            guesses += 0.05 * own / (0.05 * own + 0.95 * p)
            seen[w] += 1
        out.append((r["doc_id"], round(total, 3)))
    return out


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 3_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").limit(90)
    docs = docs.unionByName(spark.createDataFrame([(None, "a b"), (10_002, None), (10_003, "é É the the the")], "doc_id long, text string")).repartition(3).cache()
    rows = docs.collect()
    model, _ = lm.learned(docs, apart=4)
    assert not np.allclose(model.tables.weights, [0.2, 0.3, 0.4, 0.1])  # something was learned
    assert not np.allclose(model.tables.rates, 1 / (1 + np.exp(-lm.RUNGS)))
    got = {(r["doc_id"], round(r["score"], 3)) for r in lm.score(docs, apart=4).collect()}
    for (doc, want), (_, told) in zip(sorted(brute_scores(rows, model), key=str), sorted(got, key=str), strict=True):
        assert told == pytest.approx(want, rel=1e-4, abs=2e-3), doc


def test_lm_of_an_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    tables = lm.tables_of(*rng.integers(0, 3, (3, 2048, lm.CLASSES)))
    tables.rates = rng.uniform(0.01, 0.99, tables.rates.shape)
    every = np.arange(lm.CLASSES)
    for ctx in ((0, 0, 0), (5, 900, 3), (2047, 1, 2047)):
        p = np.exp(lm.class_log_prob(tables, every, *[np.full_like(every, c) for c in ctx]))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    assert lm.occurrences(np.array([1, 1, 2, 1, 1]), np.array([0, 0, 0, 1, 1])).tolist() == [0, 1, 0, 0, 1]


def test_second_stage_counts_bits_and_contexts_stay_in_their_text():
    rng = np.random.default_rng(1)
    tables = lm.tables_of(*rng.integers(0, 3, (3, 2048, lm.CLASSES)))
    cls, *ctx = rng.integers(0, lm.CLASSES, (4, 3000))
    seen, came, was_set = lm.train_weights(tables, cls, *ctx)
    assert came.sum() == pytest.approx(30_000) and seen.sum() == 30_000
    bits = np.array([(cls >> (9 - d) & 1).sum() for d in range(10)])
    np.testing.assert_allclose(was_set.reshape(10, -1).sum(1), bits)
    words = [b"abcdef", b"x", b"uvwxyz", b"abcdef", b"yy", b"uvwxyz"]
    props = np.array([lm.properties(w) for w in words])
    before = props >> (lm.BITS + lm.CONTEXT_BITS)
    _, _, previous, earlier = lm.contexts(np.arange(6), np.array([True, False, False, True, False, False]), props)
    assert previous.tolist() == [0, before[0], before[1], 0, before[3], before[4]] and earlier.tolist() == [0, 0, before[0], 0, 0, before[3]]


def test_token_probabilities_sum_to_one():
    """Known words, and one place per class for the unknown."""
    model = np.array([0.5, 0.3, 0.2])
    ids = np.array([0, 1, 0])
    total = 0.0
    for w in range(3):
        text = np.r_[ids, w]
        starts = np.array([True, False, False, False])
        seen = lm.occurrences(text, np.zeros(4, int))
        total += 10 ** lm.text_scores(text, starts, model[text], seen, np.arange(4))[-1]
    assert total == pytest.approx(1)


def test_search_keeps_all_cores_at_work(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 10)
    docs = spark.range(0, 120, 1, 1).selectExpr("id AS doc_id", "concat('aa b', id % 7, ' c', id % 11) AS text")  # one partition
    dealt = []
    own = type(docs).repartitionById
    monkeypatch.setattr(type(docs), "repartitionById", lambda self, n, by: dealt.append(own(self, n, by)) or dealt[-1])
    rows = search.search(docs, docs.where("doc_id % 20 = 0"), k=3).collect()
    parts = dealt[0].select(F.spark_partition_id().alias("p"), "group", "shard").where("shard is not null").distinct().collect()
    assert len(rows) == 18 and len({r["p"] for r in parts}) == len({r["group"] for r in parts}) == 4 and len(parts) == 12
    assert {sum(r["p"] == p for r in parts) for p in range(4)} == {3}
