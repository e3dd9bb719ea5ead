"""Mixing, SimHash, decontamination and toxicity against brute force and planted cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import components, decontam, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {500: 500}


def test_components_of_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cap", [1, 3, 1000])
def test_simhash_links_equal_brute_force(spark, cap):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius=2, cap=cap)
    rows = components.components(links).collect()
    got = {p: p for p in signed} | {r["node"]: r["root"] for r in rows}
    assert got == brute_components(sorted(signed), lambda a, b: ((a ^ b) & simhash.MASK).bit_count() <= 2)


def test_simhash_groups_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], None) for r in docs.collect()}
    prints = {d: brute_fingerprint(t) for d, (t, _) in rows.items()}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.simhash_groups(docs).select("doc_id", simhash.unsigned_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert {r["doc_id"]: r["f"] for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


EDGES = [
    (1, None, "en", "b", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3),
    (None, "one", "en", "a", 3), (5, "one two three four " * 5000, "en", "a", 9), (6, "one two three four " * 5000, "en", "b", 9), (7, "Zwei\x0bdrei vier FÜNF", "de", "b", 9),
]


def test_simhash_edge_cases(spark):
    rows = simhash.simhash_groups(spark.createDataFrame(EDGES, DOC).withColumn("component_id", F.lit("x")).withColumn("fp", F.lit("y"))).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert {c for d in (1, 2, 3) for _, c in by[d]} == {1} and {f for d in (1, 2, 3) for f, _ in by[d]} == {0}
    assert {c for d in (4, None) for _, c in by[d]} == {4} and {c for d in (5, 6) for _, c in by[d]} == {5}
    assert simhash.simhash_groups(spark.createDataFrame([], DOC)).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(4000)]
    texts = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(300)]
        texts.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for _ in range(3):  # three words of 300: a similarity of about 0.9
                copy[rng.randrange(300)] = rng.choice(words)
            texts.append((g * 10 + k, " ".join(copy)))
        half = base[:150] + [rng.choice(words) for _ in range(150)]
        texts.append((g * 10 + 5, " ".join(half)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[g * 10 + 5] == g * 10 + 5 for g in range(30))
    assert sum(got[g * 10 + k] == g * 10 for g in range(30) for k in (1, 2, 3)) >= 88


def test_crowded_blocks_of_near_copies(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(4000)]
    base = [rng.choice(words) for _ in range(400)]
    texts = []
    for k in range(200):
        copy = list(base)
        copy[rng.randrange(400)] = "x%d" % k
        texts.append((k, " ".join(copy)))
    got = {r["component_id"] for r in simhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0}


def flipped(rng, bits, share):
    """``bits`` with exactly that share of them changed."""
    out = bits.copy()
    out[rng.choice(len(bits), round(share * len(bits)), replace=False)] ^= 1
    return out


def wide_rows(spark, prints):
    rows = [(i, int.from_bytes(w[:8], "big", signed=True), bytearray(w)) for i, w in enumerate(np.packbits(p).tobytes() for p in prints)]
    return spark.createDataFrame(rows, "node long, fp long, wide binary")


@pytest.mark.parametrize(("cap", "cell"), [(1, 16), (3, 1024), (8, 5), (1000, 1024)])
def test_wide_links_of_crowded_blocks_equal_brute_force(spark, monkeypatch, cap, cell):
    if cap == 8:  # keys dealt from the start
        monkeypatch.setattr(simhash._hot_keys, "__defaults__", (1, 16, 200_000))
    rng = np.random.default_rng(3)
    blank = rng.integers(0, 2, 1920, np.uint8)
    prints = []
    for _ in range(6):  # groups that all share some blocks, with chains of copies of copies
        base = blank.copy()
        base[480:] = rng.integers(0, 2, 1440, np.uint8)
        group = [base]
        for _ in range(50):
            copy = flipped(rng, group[rng.integers(len(group))], rng.uniform(0.02, 0.16))
            copy[:240] = blank[:240]
            group.append(copy)
        prints += group
    blocks = [p.reshape(-1, 24) for p in prints]
    near = lambda a, b: (prints[a] != prints[b]).sum() <= int(0.165 * 1920) and (prints[a][:64] != prints[b][:64]).sum() <= 26 and (blocks[a] == blocks[b]).all(axis=1).any()
    links = simhash.wide_links(wide_rows(spark, prints), words=30, cap=cap, cell=cell, positions=np.arange(1920).reshape(-1, 24))
    got = {i: i for i in range(len(prints))} | {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == brute_components(range(len(prints)), near)


def test_a_group_of_thousands_on_the_edge(spark):
    """4,000 copies of one row at distances around the limit from each other: chains connect some and leave others."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 1920, np.uint8)
    prints = [flipped(rng, base, share) for share in rng.uniform(0.06, 0.17, 4000)]
    bits = np.array(prints, np.int32) * 2 - 1
    differ = (1920 - bits.astype(np.float32) @ bits.T.astype(np.float32)) / 2
    first = (64 - bits[:, :64].astype(np.float32) @ bits[:, :64].T.astype(np.float32)) / 2
    close = (differ <= int(0.165 * 1920)) & (first <= 26)
    root = np.arange(4000)
    while True:
        least = np.where(close, root[None, :], 4000).min(axis=1)
        if (least == root).all():
            break
        root = least
    links = simhash.wide_links(wide_rows(spark, prints), words=30)
    got = {i: i for i in range(4000)} | {r["node"]: r["root"] for r in components.components(links).collect()}
    assert len(set(root.tolist())) > 50 and max(np.bincount(root)) > 1000
    lost = sum(got[i] != r for i, r in enumerate(root.tolist()))
    joined = {}
    for i, r in enumerate(root.tolist()):
        joined.setdefault(got[i], set()).add(r)
    assert all(len(x) == 1 for x in joined.values()) and lost <= 20  # links of one near row alone share a block with probability 0.995


def test_isolated_pairs_of_fingerprints_are_found(spark):
    rng = np.random.default_rng(8)
    found = {}
    for share in (0.1515, 0.145, 0.13):  # similarity 0.80, 0.81 and 0.84
        prints = [p for _ in range(500) for a in [rng.integers(0, 2, 1920, np.uint8)] for p in (a, flipped(rng, a, share))]
        links = {tuple(sorted(r)) for r in simhash.wide_links(wide_rows(spark, prints), words=30).collect()}
        found[share] = len(links & {(i, i + 1) for i in range(0, 1000, 2)}) / 500
    assert min(found.values()) >= 0.985 and found[0.13] >= 0.995, found


@pytest.mark.parametrize("rows", [0, 1, 50_000, 250_000, 15_000_000])
def test_blocks_for_any_size(rows):
    lines = simhash.blocks_for(rows, 30)
    width = lines.shape[1]
    assert rows <= 2**width and 1 - (1 - 0.8485**width) ** len(lines) >= 0.995
    assert all(len(set(x)) == width for x in lines.tolist())


def test_one_of_each_keeps_one_row_per_group(spark):
    docs = spark.createDataFrame(EDGES, DOC)
    kept = simhash.one_of_each(docs, simhash.near_copies(docs)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 4, 5, 7]


def test_null_and_repeated_ids_with_different_texts(spark):
    rng = random.Random(6)
    text = lambda: " ".join("w%d" % rng.randrange(4000) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (0, d), (3, e), (3, e), (None, e), (4, a + " " + ITEM), (None, ITEM), (5, ITEM + " x"), (5, "clean " + text())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.one_of_each(docs, simhash.near_copies(docs))
    want = [(None, a), (None, b), (1, c), (0, d), (3, e), (4, rows[10][1]), (None, ITEM), (5, rows[13][1])]
    got = sorted(map(tuple, kept.collect()), key=str)
    assert [x for x in got if ITEM not in x[1]] == sorted((x for x in want if ITEM not in x[1]), key=str)
    clean = decontam.clean(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((x for x in rows if ITEM not in x[1]), key=str)


def brute_mix(rows, weights=(5, 2, 1), passes=3):
    sizes = {}
    for i, (d, t, s) in enumerate(rows):
        sizes.setdefault(s, []).append((i, len((t or "").encode().split())))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    total = sum(n for v in sizes.values() for _, n in v)
    size = {s: sum(n for _, n in sizes[s]) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while True:
        share = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > passes * size[s]]
        if not over:
            return size, target | {s: left * weight[s] / share for s in free}
        for s in over:
            target[s] = passes * size[s]
            free.discard(s)
        left = total - sum(target.values())


def test_mix_targets_and_takes(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(600)]
    size, target = brute_mix(rows)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = got.collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str) and len(out) == 600
    taken = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(10, 0.005 * t)


def test_mix_edge_cases(spark):
    got = mixing.mix(spark.createDataFrame(EDGES, DOC).withColumn("size", F.lit("x")).withColumn("target", F.lit("x"))).collect()
    assert len(got) == len(EDGES) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, "", "en", "a", 0)], DOC)).collect()] == [(1, "a", 0, 0, 0.0, 0)]


def test_schedule_ranks_and_discrepancy(spark):
    goals = spark.createDataFrame([(1, 50.0), (2, 20.0), (3, 30.0)], "rn int, target double")
    rows = mixing.ranked(mixing.schedule(goals, 10000, 1), chunk=100).collect()
    assert len(rows) == 10000
    for rn, share in ((1, 0.5), (2, 0.2), (3, 0.3)):
        own = sorted((r["slot"], r["rank"]) for r in rows if r["rn"] == rn)
        assert [k for _, k in own] == list(range(len(own))) and abs(len(own) - share * 10000) <= 10
        for n in (100, 1000, 5000):  # any prefix of the schedule holds the source's share
            assert abs(sum(s <= n for s, _ in own) - share * n) <= 8


ITEM = "If the train from Oslo leaves at 9 am and covers 120 km at a steady speed while Anna waits for 45 minutes how long does the whole trip take her in the end"


def test_decontamination_finds_reparameterised_items(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("n%s" % rng.choice("abcdefgh") * 3 + rng.choice("qwertz") for _ in range(n))
    other = ITEM.replace("Oslo", "Bergen").replace("120", "340").replace("Anna", "Marta").replace("45", "20").replace("9 ", "7 ")
    mixed = ITEM + " and " + noise(3)
    docs = [(1, f"{noise(50)} {ITEM} {noise(50)}"), (2, f"{noise(50)}. {other} {noise(20)}"), (3, noise(300)), (4, None), (5, ""), (6, mixed), (6, mixed), (7, " ".join(ITEM.split()[:6]) + " " + noise(40)), (None, ITEM)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, ITEM), (11, None), (12, "too short")], "item_id long, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert set(by) == {1, 2, 6, None} and all(r["item_id"] == 10 for r in got) and len(got) == 4
    assert by[1]["changed_slots"] == 0 and by[2]["changed_slots"] >= 4 and by[1]["coverage"] == 1.0


def test_decontamination_of_names_at_sentence_starts_units_and_short_items(spark):
    items = [
        (1, "Tom buys 5 apples. Tom gives 3 to Ann. Ann eats 2 of them. How many apples are left?"),
        (2, "a runner covers 5 miles in one go and then rests for 9 feet of shade before going on"),
        (3, "Zebra quiz 7"),
        (4, "Tom sings. The old man from Rome likes it when Tom sings his song about the sea"),
        (5, "zorp"),
    ]
    docs = [
        (1, "so Bob buys 7 apples. Bob gives 4 to Eve. Eve eats 1 of them. How many apples are left? yes"),
        (2, "Bob buys 7 apples. Max gives 4 to Eve. Pia eats 1 of them. How many apples are left?"),  # Tom is two persons, and so is Ann
        (3, "a runner covers 7 kilometers in one go and then rests for 4 inches of shade before going on"),
        (4, "the Zebra quiz 7 was hard"),
        (5, "the Zebra quiz 8 was hard"),
        (6, "Tom sings. The old man from Bonn likes it when Ben sings his song about the sea"),
        (7, "Ich Du Er Sie. Es Wir Ihr Sie Du. Er Ich Wir Es Sie Ihr Du. Ich Er Sie Es Wir Ihr?"),
        (8, "a zorp b"),
        (9, "zorpa"),
    ]
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (6, 4), (8, 5)}


def brute_contaminated(docs, items, window=8, run=13, coverage=0.5):
    """All windows of all documents against all windows of all items, compared word by word in the three forms."""
    reader = decontam.Reader()

    def words(text):
        _, ids, *_, kind = reader.read([text or ""])
        return [(reader.words.form[i].lower(), int(k)) for i, k in zip(ids.tolist(), kind.tolist(), strict=True)]

    def masked(w, form):
        slots = {decontam.NUM: "<num>", decontam.UNIT: "<unit>"} | ({decontam.NAME: "<name>"} if form else {}) | ({decontam.START: "<name>"} if form == 2 else {})
        return [slots.get(k, x) for x, k in w], [x for x, k in w if k in slots]

    found = set()
    for item, item_text in items:
        iw = words(item_text)
        size = min(window, len(iw))
        if size < decontam.SHORT:
            continue
        for doc, doc_text in docs:
            dw = words(doc_text)
            shifts = {}
            for p in range(len(dw) - size + 1):
                for q in range(len(iw) - size + 1):
                    a, b = dw[p : p + size], iw[q : q + size]
                    for form in (0, 1, 2):
                        if form == 2 and any(sum(k == decontam.WORD_ for _, k in w) < min(decontam.LITERAL, size // 2) for w in (a, b)):
                            continue
                        (x, sx), (y, sy) = masked(a, form), masked(b, form)
                        if x == y:
                            for started in (False, True) if form < 2 else (True,):
                                shifts.setdefault((p - q, started), []).append((q, tuple(sy), tuple(sx)))
            for started in (False, True):
                at_all, longest = set(), 0
                for (_, s), hits in shifts.items():
                    if s is not started:
                        continue
                    filled = {f for _, i, d in hits for f in zip(i, d, strict=True)}
                    agrees = len({i for i, _ in filled}) == len(filled) == len({d for _, d in filled})
                    at = {q for q, i, d in hits if agrees or i == d}
                    at_all |= at
                    best = 0
                    for q in sorted(at):
                        best = best + 1 if q - 1 in at else 1
                        longest = max(longest, best + size - 1)
                if at_all and (longest >= min(run, len(iw)) or len(at_all) / (len(iw) - size + 1) >= coverage):
                    found.add((doc, item))
    return found


def test_templates_equal_brute_force(spark):
    rng = random.Random(9)
    names, nouns = ["Ann", "Tom", "Eva", "Max"], ["pens", "cups", "maps", "nuts"]

    def item():
        a, b, n = rng.choice(names), rng.choice(names), rng.choice(nouns)
        return f"{a} has {rng.randint(2, 9)} {rng.choice(('red', 'blue'))} {n}. {b} walks {rng.randint(2, 99)} {rng.choice(('km', 'miles', 'meters'))} to the shop and buys {rng.randint(2, 9)} more {n} for {a}."

    items = [(i, item()) for i in range(6)] + [(6, "What is 4 plus 5 ?"), (7, "the cat sat on the mat")]
    filler = lambda: " ".join(rng.choice(("the", "shop", "and", "cat", "sat", "on", "mat", "Ann", "5", "km")) for _ in range(rng.randint(0, 25)))
    docs = [(i, f"{filler()} {rng.choice((item(), rng.choice(items)[1], '', 'What is 7 plus 2 ?'))} {filler()}") for i in range(40)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").withColumn("h", F.lit("x")).withColumn("pos", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and len(want) > 20


def test_decontamination_checks_slots(spark):
    item = "add 3 apples to 3 pears and 5 plums then take 3 away and give 5 to them all"
    wrong = "add 4 apples to 9 pears and 5 plums then take 2 away and give 1 to them all"
    right = "add 4 apples to 4 pears and 9 plums then take 4 away and give 9 to them all"
    docs = spark.createDataFrame([(1, wrong), (2, right)], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [2]


def test_decontamination_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: [w for w in (decontam._TRIM.sub("", x).lower() for x in t.split()) if w]
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        text = " " + " ".join(words(r["text"])) + " "
        for i, w in items.items():
            n = min(13, len(w))
            if any(" " + " ".join(w[k : k + n]) + " " in text for k in range(len(w) - n + 1)):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 1
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_folding_and_exceptions():
    assert toxicity.folded("ІDI0T mоr0n ｓtupid s­cum") == "idiot moron stupid scum"
    lexicon = toxicity.Lexicon({"scum": 3.0, "scu": 1.0}, ("scumble paint",))
    found = lexicon.automaton()
    assert toxicity.weigh(found, "5CUM")[:2] == (3.0, 1)
    assert toxicity.weigh(found, "a scumble paint job")[:2] == (0.0, 0)
    assert toxicity.weigh(found, "unscum") [:2] == (0.0, 0)
    assert toxicity.weigh(found, None) == (0.0, 0, 0)


def brute_weigh(lexicon, text):
    """Every stem at every word start of the folded text, outside every exception phrase."""
    low = toxicity.folded(text)
    begins = [i for i in range(len(low)) if not i or not low[i - 1].isalpha()]
    spared = [(i, i + len(p)) for p in lexicon.exceptions for i in begins if low.startswith(p, i) and not low[i + len(p) : i + len(p) + 1].isalpha()]
    best = {}
    for stem, weight in lexicon.stems.items():
        for i in begins:
            if low.startswith(stem, i) and not any(a <= i and i + len(stem) <= b for a, b in spared):
                best[i] = max(best.get(i, 0.0), weight)
    return sum(best.values()), len(best), len(low)


def test_toxicity_weights_equal_brute_force(spark):
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc": 2.5, "ca": 0.5, "b": 0.25}, ("abc a", "a b c a", "abc", "ca b", "b b b b b b b"))
    texts = [None, "", " ", "abc", "ABC 4bc аbс"] + ["".join(rng.choice("abc  b4.а") for _ in range(rng.randrange(400))) for _ in range(200)]
    automaton = lexicon.automaton()
    want = {}
    for i, t in enumerate(texts):
        got, brute = toxicity.weigh(automaton, t), brute_weigh(lexicon, t)
        assert got == pytest.approx(brute), t
        want[i] = lexicon.score_of(brute[0], brute[2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("weight", F.lit(1))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()} == pytest.approx(want)


def test_repeated_labelled_ids_are_learned_once(spark):
    rows = [(i % 40, f"{'badword' if i % 40 < 20 else 'fine'} number {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] * 3, "doc_id long, toxic int")
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert any("badword".startswith(s) for s in lexicon.stems)


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    # labels of texts without any insult are noise that nothing can learn
    assert sum(got[d]["predicted"] > truth[d] for d in held) == 0
    assert sum(got[d]["predicted"] != truth[d] for d in held) <= 0.06 * len(held)
    left = toxicity.kept(docs, lexicon)
    assert left.columns == docs.columns and left.count() == sum(not r["predicted"] for r in got.values())


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, DOC).withColumn("score", F.lit("x"))
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, empty)
    assert lexicon.stems == {}
    rows = toxicity.score(docs, lexicon).collect()
    assert len(rows) == len(EDGES) and not any(r["predicted"] for r in rows)
    assert toxicity.kept(docs.limit(0), lexicon).count() == 0
