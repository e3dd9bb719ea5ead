"""Line dedup against brute force, in both modes, and its edge cases."""

import random

from pyspark.sql import functions as F

from cairn.llm import lines

DOC = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=1, min_docs=10, keep_first=False, pieces=None):
    """Per row (n_lines, kept text); a document is an id with a text."""
    order = sorted({(d is None, d or 0, t or "", d) for d, t in rows}, key=lambda x: x[:3])
    holders, first = {}, {}
    for none, _, text, doc in order:
        for pos, line in enumerate(text.split("\n")):
            key = key_of(line)
            if len(key) >= max(1, min_chars):
                holders.setdefault(key, set()).add((doc, text))
                first.setdefault(key, (doc, text, pos))
    often = {k for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for pos, x in enumerate(own) if key_of(x) not in often or (keep_first and first[key_of(x)] == (doc, text, pos))]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, rows, **how):
    frame = lines.line_bitmaps(spark.createDataFrame(rows, DOC), **how)
    frame = frame.select("doc_id", "n_lines", "n_dropped", lines.kept_text(F.col("text"), F.col("runs")).alias("kept"), "runs")
    found = frame.collect()
    for r in found:
        assert sum(r["runs"]) == r["n_lines"] and sum(r["runs"][1::2]) == r["n_dropped"] and 0 not in r["runs"][1:-1]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found), key=str)


def documents():
    rng = random.Random(3)
    pool = ["Cookie Notice", "cookie notice\t", " All rights reserved ", "Ünder ÄÖ", "ünder ÄÖ", "x", "", "  ", "footer\r", "seldom"]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {j}"]) for j in range(rng.randint(0, 9)))) for i in range(60)]
    return [*rows, (None, "Cookie Notice\nx"), (None, None), (61, ""), (62, None), (5, "Cookie Notice\nother text"), rows[7], rows[7], (63, "x\n" * 5000 + "end"), (64, "\n"), (65, "long " * 40000)]


def test_lines_equal_brute_force(spark):
    rows = documents()
    for how in ({"min_docs": 10}, {"min_docs": 3, "min_chars": 5}, {"min_docs": 2, "pieces": 1}, {"min_docs": 1}):
        assert got(spark, rows, **how) == brute(rows, **how)


def test_keeping_the_first_occurrence(spark):
    # texts tie-break by hash where ids repeat, so ids are unique here
    rows = list({r[0]: r for r in documents() if r[0] is not None}.values())
    assert got(spark, rows, min_docs=2, keep_first=True) == brute(rows, min_docs=2, keep_first=True)


def test_one_line_in_all_documents_and_nine_are_too_few(spark):
    rows = [(i, f"common\nalone {i}" + ("\nnine" if i < 9 else "")) for i in range(400)]
    assert got(spark, rows) == brute(rows)
    assert all("common" not in r[3] for r in got(spark, rows)) and sum("nine" in r[3] for r in got(spark, rows)) == 9


def test_no_documents_and_columns_of_clashing_names(spark):
    assert lines.line_bitmaps(spark.createDataFrame([], DOC)).collect() == []
    rows = [(i, "same\nown %d" % i) for i in range(12)]
    names = "h0 h1 piece d0 d1 pos new key line head n n_docs dropped runs _id _d0 n_lines".split()
    plain = spark.createDataFrame(rows, DOC)
    clash = plain.select("*", *[F.lit(f"x{n}").alias(n) for n in names])
    assert sorted(map(str, lines.line_bitmaps(clash).collect())) == sorted(map(str, lines.line_bitmaps(plain).collect()))


def test_ids_of_text(spark):
    rows = [(f"d{i}", "same\nown") for i in range(12)]
    found = lines.line_bitmaps(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["n_dropped"] for r in found} == {2} and len(found) == 12


def test_no_python_in_the_plan(spark, capsys):
    frame = lines.line_bitmaps(spark.createDataFrame([(1, "a\nb")], DOC))
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
