"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, fold, in_batches

# Characters that look like a Latin letter, by alphabet, and digits that stand for letters. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Full-width Latin letters follow ASCII at a fixed distance; zero-width marks and the soft hyphen vanish.
FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
FOLD |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
FOLD |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_PLAIN_FOLD = {ord(k): v for k, v in DIGITS.items()}


def folded(text: str) -> str:
    """Lower case, look-alikes and digit substitutions as plain letters; nothing for null."""
    low = (text or "").lower()
    return low.translate(_PLAIN_FOLD if low.isascii() else FOLD)


def folded_words(text: str) -> set[str]:
    return {w for w in "".join(c if c.isalpha() else " " for c in folded(text)).split()}


@dataclass
class Lexicon:
    """Stems with weights, exception phrases, and the scale of the score."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    scale: tuple[float, float, float] = (-4.0, 1.0, 0.5)

    def automaton(self):
        found = ahocorasick.Automaton()
        for word in {*self.stems, *self.exceptions}:
            found.add_word(word, (len(word), self.stems.get(word), word in self.exceptions))
        found.make_automaton()
        return found

    def score_of(self, weight: float, length: int) -> float:
        bias, by_sum, by_rate = self.scale
        rate = 1000.0 * weight / max(length, 1000)
        z = bias + by_sum * math.log1p(weight) + by_rate * math.log1p(rate)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def weigh(automaton, text: str) -> tuple[float, int, int]:
    """(weight, hits, folded length): the weights of stems at word starts, outside exception phrases."""
    low = folded(text)
    if not len(automaton):
        return 0.0, 0, len(low)
    hits, spared = [], []
    for end, (size, weight, exception) in automaton.iter(low):
        start = end - size + 1
        if start and low[start - 1].isalpha():
            continue
        if exception and (end + 1 == len(low) or not low[end + 1].isalpha()):
            spared.append((start, end))
        if weight is not None:
            hits.append((start, end, weight))
    best: dict[int, float] = {}
    at, reach = 0, -1  # of the exceptions that begin so far, how far one reaches
    spared.sort()
    for start, end, weight in sorted(hits):
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if end <= reach:
            continue
        best[start] = max(best.get(start, 0.0), weight)
    return math.fsum(best.values()), len(best), len(low)


def labelled(labels: DataFrame, *, per_class: int, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, toxic): at most ``per_class`` training ids of each class, in the order of a hash of the id.

    Rows of the held-out fold, with a null id or a null label are not used; an id labelled twice is toxic if
    either says so.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda c: rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick(1).unionByName(pick(0))


def learn(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, shortest: int = 4, longest: int = 10, support: int = 3, evidence: float = 6.0, most: int = 4096, rounds: int = 8) -> Lexicon:
    """A lexicon from the training fold of ``labels``.

    The classifier is fitted on a bounded sample: at most ``per_class`` documents of either label, so the
    sample's ids are broadcast; an id that repeats with several texts gives one of them. Candidates are folded words and their prefixes; each task counts those of
    its own documents, Spark adds them up, and those that occur in ``support`` toxic documents and lean
    to them with a log-likelihood ratio over ``evidence`` plus twice the logarithm of the number of
    candidates (so that chance passes few of however many) stay, at most ``most``. Of candidates that
    extend each other the one with most evidence is taken, the longest of equals. The strongest are taken first;
    the next round counts only toxic documents that nothing taken explains, so words that copies of one
    document share with an insult are not learned along with it.
    """
    sample = F.broadcast(labelled(labels, per_class=per_class))  # at most 2 * per_class ids
    texts = cut(in_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Lexicon()
    stems: dict[str, float] = {}
    for _ in range(rounds):
        found = _stems(texts, stems, shortest, longest, support, evidence, most, totals)
        if not found:
            break
        stems |= found
    return _scaled(texts, Lexicon(stems, _exceptions(texts, stems)))


def _stems(texts: DataFrame, known: dict[str, float], shortest: int, longest: int, support: int, evidence: float, most: int, totals: dict[int, int], strong: float = 0.1) -> dict[str, float]:
    """The strongest new stems and their weights, from clean documents and toxic ones without a known stem."""
    lexicon = Lexicon(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, automaton = Counter(), Counter(), lexicon.automaton()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if label and known and weigh(automaton, text)[1]:
                    continue
                seen = {""}
                for w in folded_words(text):
                    seen.update(w[:k] for k in range(shortest, min(longest, len(w) - 1) + 1))
                    seen.add(w + " ")
                (toxic if label else clean).update(seen)
        keys = sorted(toxic.keys() | clean.keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["stem", "t", "c"])

    counts = texts.mapInArrow(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = cut(counts.where((F.col("t") >= support) | (F.col("stem") == "")))
    whole = counts.where("stem = ''").first()
    if whole is None or not whole["t"]:
        return {}
    big_t, big_c = whole["t"], whole["c"]
    evidence += 2 * math.log(max(1, counts.count()))

    def part(x, of, share):
        return F.when(x > 0, x * F.log(x / (F.lit(float(of)) * share))).otherwise(0.0)

    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    share = (t + c) / float(big_t + big_c)
    rest = F.greatest(1 - share, F.lit(1e-12))
    ratio = 2 * (part(t, big_t, share) + part(c, big_c, share) + part(big_t - t, big_t, rest) + part(big_c - c, big_c, rest))
    leaning = counts.where("stem <> ''").withColumn("g", ratio).where((F.col("g") >= evidence) & (t / big_t > 4 * c / big_c))
    rows = leaning.orderBy(F.desc("g"), F.desc(F.length("stem")), "stem").limit(most).collect()  # at most ``most`` rows: the model
    stems: dict[str, float] = {}
    for r in rows:
        stem = r["stem"].rstrip()
        if r["g"] < strong * rows[0]["g"] or len(stem) < 3 or any(stem.startswith(s) or s.startswith(stem) for s in (*stems, *known)):
            continue
        stems[stem] = math.log((r["t"] + 0.5) / (totals[1] + 1)) - math.log((r["c"] + 0.5) / (totals[0] + 1))
    return stems


def _exceptions(texts: DataFrame, stems: dict[str, float], most: int = 1000) -> tuple[str, ...]:
    """Words and word pairs around a stem that clean documents use and toxic ones do not."""
    if not stems:
        return ()
    automaton = Lexicon(stems).automaton()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, seen = folded(text), set()
                for end, (size, *_) in automaton.iter(low):
                    start = end - size + 1
                    if start and low[start - 1].isalpha():
                        continue
                    stop = end + 1
                    while stop < len(low) and low[stop].isalpha():
                        stop += 1
                    then = stop + 1
                    while then < len(low) and low[then].isalpha():
                        then += 1
                    seen.add(low[start:stop])
                    seen.add(low[start:then])
                out += [(s, int(bool(label))) for s in seen]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([y for _, y in out], pa.int64())], names=["phrase", "y"])

    rows = texts.mapInArrow(around, "phrase string, y long").groupBy("phrase").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = rows.where("n - t >= 3 and t * 10 <= n").orderBy(F.desc("n"), "phrase").limit(most).collect()  # at most ``most`` rows
    return tuple(sorted(r["phrase"] for r in rows))


def _scaled(texts: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The scale of the score: a logistic fit on the sample's weights, by penalised Newton steps."""
    if not lexicon.stems:
        return lexicon

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [weigh(automaton, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), batch.column(1).cast(pa.int64())], names=["w", "length", "y"])

    rows = texts.mapInArrow(features, "w double, length long, y long").toPandas()  # at most 2 * per_class rows
    rows = rows.sort_values(["w", "length", "y"])
    w, length, y = rows["w"].to_numpy(float), rows["length"].to_numpy(float), rows["y"].to_numpy(float)
    x = np.stack([np.ones_like(w), np.log1p(w), np.log1p(1000 * w / np.maximum(length, 1000))], axis=1)
    beta = np.array([-2.0, 1.0, 0.5])
    ridge = np.diag([0.05, 0.05, 0.05])
    each = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (each * (p - y)) + ridge @ beta
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    # more weight never lowers a score
    return Lexicon(lexicon.stems, lexicon.exceptions, (float(beta[0]), float(max(beta[1], 0.0)), float(max(beta[2], 0.0))))


def score(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, hits, predicted) for every whole text; one row per input row.

    A null or empty text is scored like a text without hits. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            weights = [weigh(automaton, t) for t in batch.column(1).to_pylist()]
            scores = np.array([lexicon.score_of(w, n) for w, _, n in weights], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array([h for _, h, _ in weights], pa.int32()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "hits", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, hits int, predicted int")


def kept(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they are."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                w, _, n = weigh(automaton, t)
                keep.append(lexicon.score_of(w, n) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(docs).mapInArrow(run, schema)
