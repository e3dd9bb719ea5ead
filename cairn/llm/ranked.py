"""Ranked lexical search over norm buckets: Cauchy-Schwarz prunes buckets, coordinate bounds filter inside, survivors are scored in integers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import cut, in_batches, stored

#: Pairs of item and term that are sent to the tasks together (an item is never split).
BLOCK_TERMS = 1_000_000
#: Vectors of a norm bucket; vectors of the largest norms that give the first thresholds.
BUCKET, FIRST = 2048, 4096
#: Share of a query's squared norm that its focus coordinates hold.
FOCUS = 0.85
#: Every byte that is no letter, digit or part of a character beyond ASCII becomes a space, A-Z become a-z.
FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none."""
    return (text or "").encode().translate(FOLD).split()


def item_terms(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item, as bytes."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = sorted(set(terms_of(text)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(own), pa.int32())), pa.array(own, pa.binary())], names=["item_id", "term"])

    rows = in_batches(items).select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def counted(docs: DataFrame, vocabulary: list[bytes], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids, tf) of each document with a term: how many terms it has with repeats, and the numbers in ``vocabulary`` of those it lists, rising, with their occurrences."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(sent.value)}.get
        for batch in batches:
            where, sizes, ids, tf = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if words := terms_of(text):
                    own = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    own, times = np.unique(own[own >= 0], return_counts=True)
                    where.append(i)
                    sizes.append((len(words), len(own)))
                    ids.append(own)
                    tf.append(times)
            if where:
                n, lengths = zip(*sizes, strict=True)
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "ids", "tf"])

    rows = in_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, ids array<int>, tf array<int>")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and how many each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def impact_vectors(counts: DataFrame, roots: np.ndarray, n_docs: int, total: int) -> DataFrame:
    """(doc_id, norm, ids, impact) of each document with a term of the vocabulary; norm is its impacts' length, each times the root of the term's weight."""
    kind = counts.schema["doc_id"].dataType.simpleString()
    sent = counts.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = flat(batch.column(2))
            tf, _ = flat(batch.column(3))
            n = batch.column(1).to_numpy()
            m = 10 + (90 * n * n_docs) // total
            tf = tf.astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, lengths))
            row = np.repeat(np.arange(len(n)), lengths)
            norm = np.sqrt(np.bincount(row, weights=(impact * sent.value[ids]) ** 2, minlength=len(n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), batch.column(2), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(impact))], names=["doc_id", "norm", "ids", "impact"])

    return counts.where(F.size("ids") > 0).mapInArrow(run, f"doc_id {kind}, norm double, ids array<int>, impact array<long>")


def focus_of(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int, float, float]:
    """A query's terms, heaviest first, how many of them are its focus, the length of the rest, and of all. A coordinate is the root of the term's weight."""
    order = np.argsort(-weights, kind="stable")
    upto = np.cumsum(weights[order])
    focus = int(np.searchsorted(upto, FOCUS * upto[-1])) + 1
    return terms[order], focus, math.sqrt(max(0.0, float(upto[-1] - upto[min(focus, len(upto)) - 1]))), math.sqrt(float(upto[-1]))


class Bucket:
    """Vectors of similar norm, longest first, with a posting list per term."""

    def __init__(self, norms: np.ndarray, ids: np.ndarray, lengths: np.ndarray, impacts: np.ndarray) -> None:
        self.norms = norms
        order = np.argsort(ids, kind="stable")
        self.terms, self.impacts = ids[order], impacts[order]
        self.rows = np.repeat(np.arange(len(norms)), lengths)[order]

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the terms' postings, and each one's place in ``terms``."""
        lo, hi = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, "right")
        sizes = hi - lo
        return np.arange(int(sizes.sum())) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes), np.repeat(np.arange(len(terms)), sizes)

    def survivors(self, terms: np.ndarray, weights: np.ndarray, focus: int, rest: float, length: float, least: float) -> np.ndarray:
        """Rows whose score may be ``least`` or more.

        A row's score is at most its length times the query's, so only the first rows come into question; of
        these, the focus coordinates are added up and what is left of either vector bounds the other coordinates.
        """
        least *= 1 - 1e-9  # room for rounding
        head = int(np.searchsorted(-self.norms, -least / length, "right")) if least > 0 else len(self.norms)
        at, which = self.postings(terms[:focus])
        at, which = (at, which) if head == len(self.norms) else (at[(few := self.rows[at] < head)], which[few])
        rows, impacts, w = self.rows[at], self.impacts[at].astype(np.float64), weights[which].astype(np.float64)
        near = np.bincount(rows, weights=impacts * w, minlength=head)
        left = self.norms[:head] ** 2 * (1 + 1e-9) - np.bincount(rows, weights=impacts * impacts * w, minlength=head)
        return np.flatnonzero(near + rest * np.sqrt(np.maximum(left, 0.0)) >= least)

    def scores(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows, in 64-bit integers."""
        place = np.full(len(self.norms), -1)
        place[rows] = np.arange(len(rows))
        at, which = self.postings(terms)
        to = place[self.rows[at]]
        some = to >= 0
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, to[some], weights[which[some]] * self.impacts[at[some]])
        return out


def best_of(batches: Iterator[pa.RecordBatch], asked: list[np.ndarray], weights: np.ndarray, first: np.ndarray, k: int) -> Iterator[list[tuple]]:
    """For each query its ``k`` best (-score, no id, id) among vectors that come longest first; equal scores by id, null last.

    ``first`` holds scores that the k-th best is known to reach. The vectors go through in buckets; a query is done at the
    first bucket whose longest vector times its own length stays below its k-th best.
    """
    queries = []
    for terms in asked:
        own, focus, rest, length = focus_of(terms, weights[terms])
        queries.append((own, weights[own], focus, rest, length))
    found: list[list[tuple]] = [[] for _ in asked]
    least, live = first.astype(np.float64), [i for i, q in enumerate(queries) if q[4] > 0]
    lengths_of = np.array([q[4] for q in queries])
    for batch in batches:
        for start in range(0, batch.num_rows, BUCKET):
            part = batch.slice(start, BUCKET)
            norms = part.column(1).to_numpy()
            live = [i for i in live if lengths_of[i] * norms[0] >= least[i] * (1 - 1e-9)]
            if not live:
                continue
            ids, lengths = flat(part.column(2))
            bucket = Bucket(norms, ids, lengths, flat(part.column(3))[0])
            for i in live:
                terms, w, focus, rest, length = queries[i]
                rows = bucket.survivors(terms, w, focus, rest, length, least[i])
                if not len(rows):
                    continue
                scores = bucket.scores(terms, w, rows)
                good = scores >= max(1.0, least[i])
                if good.sum() > k:  # the bucket's own k-th best, with all that equal it
                    good &= scores >= np.partition(scores[good], -k)[-k]
                if good.any():
                    docs = part.column(0).take(pa.array(rows[good])).to_pylist()
                    found[i] = sorted([*found[i], *((-s, d is None, 0 if d is None else d) for s, d in zip(scores[good].tolist(), docs, strict=True))])[:k]
                    if len(found[i]) == k:
                        least[i] = max(least[i], -found[i][-1][0])
    yield from found


def _block(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """The ``k`` best documents of each item of one block; ``asked`` has its pairs of item and term."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    vocabulary, items = [], {}
    number: dict[bytes, int] = {}
    for r in asked.collect():  # a block's pairs, bounded by BLOCK_TERMS
        term = bytes(r["term"])
        if term not in number:
            number[term] = len(vocabulary)
            vocabulary.append(term)
        items.setdefault(r["item_id"], []).append(number[term])
    counts = stored(counted(docs, vocabulary, doc_id=doc_id, text=text), "ranked")
    whole = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")).first()
    n_docs, total = whole["n"], whole["total"] or 0
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row per term of the block
        weights[r["id"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    asked_ids = list(items)
    sent = spark.sparkContext.broadcast(([np.array(items[i], np.int32) for i in asked_ids], weights))
    vectors = impact_vectors(counts, np.sqrt(weights), n_docs, total)
    vectors = stored(vectors.repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id"), "ranked-vectors")

    def thresholds(batches):
        asked, weights = sent.value
        found = list(best_of(batches, asked, weights, np.zeros(len(asked)), k))
        yield pa.RecordBatch.from_arrays([pa.array([-f[-1][0] if len(f) == k else 0 for f in found], pa.int64()), pa.array(range(len(found)), pa.int32())], names=["least", "query"])

    first = np.zeros(len(asked_ids))
    top = vectors.orderBy(F.desc("norm"), "doc_id").limit(FIRST)
    for r in top.coalesce(1).sortWithinPartitions(F.desc("norm"), "doc_id").mapInArrow(thresholds, "least long, query int").collect():  # a row per item of the block
        first[r["query"]] = max(first[r["query"]], r["least"])
    known = spark.sparkContext.broadcast(first)
    id_type = asked.select("item_id").limit(0).toArrow().schema.field(0).type

    def search(batches):
        asked, weights = sent.value
        seen = []

        def passed():
            for batch in batches:
                seen[:] = [batch.schema.field(0).type]
                yield batch

        rows = [(asked_ids[i], None if none else d, -s) for i, f in enumerate(best_of(passed(), asked, weights, known.value, k)) for s, none, d in f]
        if rows:
            q, d, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, id_type), pa.array(d, seen[0]), pa.array(s, pa.int64())], names=["item_id", "doc_id", "score"])

    return vectors.sortWithinPartitions(F.desc("norm"), "doc_id").mapInArrow(search, f"item_id {item_kind}, doc_id {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, *, k: int = 10, block_terms: int = BLOCK_TERMS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` documents of the highest score above 0, equal scores by rising doc_id, null last.

    A document's vector has an impact for each term that an item asks for, an item's vector the term's weight; the score is
    their product. The weight is split evenly, as its root, between the two when lengths are
    taken, which changes no product and keeps common terms from making vectors long. Vectors are range-partitioned and sorted by length; a task goes through its norm buckets
    with the k-th best so far, which starts from what the longest vectors of all give. Bounds are computed in doubles with room for rounding, scores in integers, so the
    result is exact. The items' terms are sent to the tasks in blocks of ``block_terms`` pairs or so, a pass over ``docs`` each.

    Null and empty texts have no term: such items get no rows, such documents are in none and don't count.
    Rows that repeat an item's id are one item with the terms of all, a null id among them; rows that repeat a document have a rank each. Empty tables give no rows.
    Other columns are not read.
    """
    pairs = cut(item_terms(items, item_id=item_id, text=text))
    n = pairs.count()
    blocks = max(1, -(-n // block_terms))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        found = _block(docs, pairs.where(number == b), k, doc_id, text)
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
