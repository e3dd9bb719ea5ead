"""Language-model scores by logistic mixing of hashed-context bit predictors.

A token is coded as its class, ten bits that a hash of its ending gives, and its share of the class's
training tokens. The class's bits are predicted one after another in four contexts: none, the last short
word, and hashes of the previous word and of the one before it. Each context holds how often either bit followed in the training
texts; their log odds are mixed with weights that a gate on the contexts' evidence selects, learned online
on documents that the counts for learning leave out. A second stage refines the mix: per bit and gate it
holds how often the bit was set where the mix said so, adapted to the same documents, and the mean of both counts. While a text is read, a share of the probability moves to the words it has
used already; the share follows the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fold, id_text, in_batches, stored

BITS = 10
CLASSES = 1 << BITS
#: Contexts of each kind, as a power of two: the size of the tables that the tasks are sent.
CONTEXT_BITS = 11
SLICE = 1 << 17
#: Tokens that are encoded and scored together.
CHUNK = 1_000_000
END = b"\n"  # no word: words have no white space
NO_WORD = 0
#: Kinds of contexts with a table of their own.
KINDS = 3
GATES = 32
#: Log odds at which the second stage keeps a rate; between two of them it is interpolated.
RUNGS = np.linspace(-8, 8, 33)
#: Bits that the mix itself stands for at each rung.
RUNG_PRIOR = 30.0


def properties(word: bytes, context_bits: int = CONTEXT_BITS) -> int:
    """Class, context as a short word (0 for none), and context as the previous word, packed in one integer."""
    some = (1 << context_bits) - 1
    key = word if len(word) <= 4 else b"~" + word[-3:]
    cls = zlib.crc32(key) & (CLASSES - 1)
    short = zlib.crc32(b"s" + word) % some + 1 if len(word) <= 3 else 0
    before = zlib.crc32(b"p" + (word if len(word) <= 5 else b"~" + word[:1] + word[-3:])) % some + 1
    return cls | short << BITS | before << (BITS + context_bits)


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def contexts(ids: np.ndarray, starts: np.ndarray, props: np.ndarray, context_bits: int = CONTEXT_BITS):
    """(class, last short word, previous word, word before that) of each token; ``starts`` marks the first token of each text."""
    packed = props[ids]
    cls = packed & (CLASSES - 1)
    short, before = (packed >> BITS) & ((1 << context_bits) - 1), packed >> (BITS + context_bits)
    n = len(ids)
    previous = np.zeros(n, np.int64)
    previous[1:] = before[:-1]
    previous[starts] = NO_WORD
    earlier = np.zeros(n, np.int64)
    earlier[1:] = previous[:-1]
    earlier[starts] = NO_WORD
    at = np.arange(n)
    last = np.where(short > 0, at, -1)
    last = np.maximum.accumulate(last)
    shifted = np.full(n, -1)
    shifted[1:] = last[:-1]
    first = np.maximum.accumulate(np.where(starts, at, 0))
    ctx = np.where(shifted >= first, short[np.maximum(shifted, 0)], NO_WORD)
    return cls, ctx, previous, earlier


@dataclass
class Tables:
    """Log odds of the next class bit and evidence (log2 of the count) per context and node, for no context and each kind of context; mixing weights per gate; rates of the second stage per bit and gate."""

    plain: np.ndarray
    odds: tuple[np.ndarray, ...]
    evidence: tuple[np.ndarray, ...]
    weights: np.ndarray
    rates: np.ndarray


def nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often either bit followed at each node of the class tree (a heap, root 1), from counts per context and class."""
    zero, one = np.zeros_like(counts), np.zeros_like(counts)
    level = counts
    for depth in range(BITS - 1, -1, -1):
        lo, hi = level[:, 0::2], level[:, 1::2]
        width = 1 << depth
        zero[:, width : 2 * width], one[:, width : 2 * width] = lo, hi
        level = lo + hi
    return zero, one


def tables_of(short: np.ndarray, previous: np.ndarray, earlier: np.ndarray) -> Tables:
    zero, one = nodes(previous.sum(0, keepdims=True).astype(np.float64))
    share = (one + 0.4) / (zero + one + 0.8)
    plain = np.log(share / (1 - share))[0].astype(np.float32)
    odds, evidence = [], []
    for counts in (short, previous, earlier):
        z, o = nodes(counts.astype(np.float32))
        odds.append((np.log(o + 1.5 * share) - np.log(z + 1.5 * (1 - share))).astype(np.float32).ravel())
        evidence.append(np.minimum(np.log2(z + o + 1) / 1.5, 7).astype(np.uint8).ravel())
    weights = np.tile(np.array([0.2, 0.3, 0.4, 0.1], np.float32), (GATES, 1))
    return Tables(plain, tuple(odds), tuple(evidence), weights, np.tile(1 / (1 + np.exp(-RUNGS)), (BITS * GATES, 1)))


def bit_inputs(tables: Tables, cls, ctx, depth: int):
    """The predictors' log odds for one bit of each token, the gate, and whether the bit is set."""
    node = (1 << depth) + (cls >> (BITS - depth))
    at = [c * CLASSES + node for c in ctx]
    gate = tables.evidence[1][at[1]].astype(np.int64) * 4 + (tables.evidence[0][at[0]] >> 1)
    bit = (cls >> (BITS - 1 - depth)) & 1 == 1
    return [tables.plain[node], *[odds[a] for odds, a in zip(tables.odds, at, strict=True)]], gate, bit


def rung_of(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rung below each log odds, and how far it is to the next one (0 to 1)."""
    place = (np.clip(z, RUNGS[0], RUNGS[-1]) - RUNGS[0]) / (RUNGS[1] - RUNGS[0])
    low = np.minimum(place.astype(np.int64), len(RUNGS) - 2)
    return low, place - low


def class_log_prob(tables: Tables, cls, *ctx, span: int = 1 << 15) -> np.ndarray:
    """Natural log of the probability of each token's class, ``span`` tokens at a time, so that the inputs of few bits are held at once."""
    parts = [slice(at, at + span) for at in range(0, len(cls), span)]
    return np.concatenate([np.zeros(0), *[_log_prob(tables, cls[part], [c[part] for c in ctx]) for part in parts]])


def _log_prob(tables: Tables, cls, ctx) -> np.ndarray:
    total = np.zeros(len(cls), np.float64)
    w = tables.weights
    for depth in range(BITS):
        x, gate, bit = bit_inputs(tables, cls, ctx, depth)
        z = sum(w[gate, k] * x[k] for k in range(len(x))).astype(np.float64)
        low, share = rung_of(z)
        rates = tables.rates[depth * GATES : (depth + 1) * GATES]
        refined = (1 - share) * rates[gate, low] + share * rates[gate, low + 1]
        p = (1 / (1 + np.exp(-np.clip(z, -30, 30))) + refined) / 2
        total += np.log(np.where(bit, p, 1 - p))
    return total


def train_weights(tables: Tables, cls, *ctx, step: int = 512, rate: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Online gradient steps over the tokens in order, ``step`` tokens at a time, on each gate's weights.

    How many bits each gate saw, and for the second stage how many bits came to each rung and how many of them were set.
    """
    w, seen = tables.weights, np.zeros(GATES)
    came, was_set = np.zeros(tables.rates.size), np.zeros(tables.rates.size)
    for at in range(0, len(cls), step):
        part = slice(at, at + step)
        pull = rate / (1 + at / 200_000) ** 0.5
        for depth in range(BITS):
            x, gate, bit = bit_inputs(tables, cls[part], [c[part] for c in ctx], depth)
            x = np.stack(x, axis=1)
            z = (w[gate] * x).sum(1)
            error = bit - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            change, n = np.zeros_like(w), np.bincount(gate, minlength=GATES)
            for k in range(x.shape[1]):
                change[:, k] = np.bincount(gate, weights=error * x[:, k], minlength=GATES)
            w += pull * change / np.sqrt(n + 1)[:, None]
            seen += n
            low, share = rung_of(z)
            for i, weight in ((low, 1 - share), (low + 1, share)):
                i = (depth * GATES + gate) * len(RUNGS) + i
                np.add.at(came, i, weight)
                np.add.at(was_set, i, weight * bit)
    return seen, came, was_set


def text_scores(ids, starts, model_p, seen_before, place, *, prior: float = 0.05, weight: float = 20.0) -> np.ndarray:
    """log10 of each token's probability with a share for words used before in the same text.

    The share starts at ``prior`` and is refined by how well the two sources told the tokens so far.
    """
    own = seen_before / np.maximum(place, 1)
    guess = prior * own / (prior * own + (1 - prior) * model_p)
    run = np.cumsum(guess)
    first = np.flatnonzero(starts)
    offset = np.repeat(np.r_[0.0, run][first], np.diff(np.r_[first, len(ids)]))
    before = np.r_[0.0, run[:-1]] - offset
    share = np.where(place > 0, (prior * weight + before) / (weight + place), 0.0)
    return np.log10((1 - share) * model_p + share * own)


def occurrences(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each token has occurred before in its text."""
    order = np.lexsort((ids, text))
    key_a, key_b = text[order], ids[order]
    new = np.r_[True, (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])]
    at = np.arange(len(ids))
    count = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(ids), np.int64)
    out[order] = count
    return out


@dataclass
class Model:
    """Context tables with mixing weights, training tokens and distinct words per class, and the size of the tables."""

    tables: Tables
    class_n: np.ndarray
    class_v: np.ndarray
    context_bits: int = CONTEXT_BITS

    def text(self, ids: np.ndarray, size: np.ndarray, props: np.ndarray, c: np.ndarray):
        """(known tokens, base score, score) of texts, given as word numbers one after another and their sizes; c is each word's training count."""
        ids = ids.astype(np.int64)
        at = np.cumsum(size) - size
        starts = np.zeros(len(ids), bool)
        starts[at] = True
        text = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(ids)) - np.repeat(at, size)
        cls = props & (CLASSES - 1)
        inside = (c + 0.5) / (self.class_n[cls] + 0.5 * (self.class_v[cls] + 1))
        model_p = np.exp(class_log_prob(self.tables, *contexts(ids, starts, props, self.context_bits))) * inside[ids]
        told = text_scores(ids, starts, model_p, occurrences(ids, text), place)
        base = np.log10((c + 0.5) / (self.class_n.sum() + 0.5 * (self.class_v.sum() + 1)))
        return np.add.reduceat((c > 0)[ids].astype(np.int64), at), np.add.reduceat(base[ids], at), np.add.reduceat(told, at)


# Spark -------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as compressed bytes."""
    head = np.array([len(arrays), *(v for a in arrays for v in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 + 24 * n
    for kind, size, length in np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist():
        out.append(np.frombuffer(raw, f"<{chr(kind)}{size}", length, at))
        at += out[-1].nbytes
    return out


TEXT, WORDS, LESSON, TABLE = range(4)
_ROWS = "kind int, chunk long, bucket int, doc_ids array<{kind}>, held array<boolean>, n_bytes array<long>, blob binary"


def _encoded(docs: DataFrame, kind: str, buckets: int, context_bits: int) -> DataFrame:
    """Rows of four sorts: a chunk's texts as word numbers; its words of a bucket with their training counts; its texts to learn weights on; and a task's context counts.

    Words are told apart by a 64-bit hash, which also gives the bucket. A chunk's words are numbered by bucket and hash,
    so that the answers of all buckets, one after another, are in the order of the numbers.
    """
    size = KINDS << (BITS + context_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        counts = [None, None]
        vocabulary, texts, tokens, chunk, id_type = Vocabulary(), [], 0, 0, None

        def rows(kind, n, **columns):
            types = {"kind": pa.int32(), "chunk": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(id_type), "held": pa.list_(pa.bool_()), "n_bytes": pa.list_(pa.int64()), "blob": pa.binary()}
            columns |= {"kind": [kind] * n, "chunk": [base + chunk] * n}
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

        def flush():
            nonlocal vocabulary, texts, tokens, chunk
            words = list(vocabulary)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            bucket = (hashes >> np.uint64(32)).astype(np.int64) % buckets
            order = np.lexsort((hashes, bucket))
            number = np.empty(len(words), np.int32)
            number[order] = np.arange(len(words), dtype=np.int32)
            hashes, bucket = hashes[order], bucket[order]
            props = np.array([properties(words[i], context_bits) for i in order.tolist()], np.int64)
            sizes = np.array([len(t[2]) for t in texts], np.int64)
            ids = number[np.concatenate([t[2] for t in texts])]
            held, apart = (np.repeat([t[i] for t in texts], sizes) for i in (1, 3))
            starts = np.zeros(len(ids), bool)
            starts[np.cumsum(sizes) - sizes] = True
            cls, *kinds = contexts(ids, starts, props, context_bits)
            for side in (0, 1):
                mine = ~held & (apart == side)
                if mine.any():
                    if counts[side] is None:
                        counts[side] = np.zeros(size, np.uint32)
                    for k, ctx in enumerate(kinds):
                        own = counts[side][k * (size // KINDS) : (k + 1) * (size // KINDS)]
                        own += np.bincount(ctx[mine] * CLASSES + cls[mine], minlength=len(own)).astype(np.uint32)
            n = np.bincount(ids[~held], minlength=len(words)).astype(np.uint32)
            yield rows(TEXT, 1, doc_ids=[[t[0] for t in texts]], held=[[t[1] for t in texts]], n_bytes=[[t[4] for t in texts]], blob=[packed(sizes, ids, props)])
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            there = np.flatnonzero(np.diff(edges))
            spans = [slice(edges[i], edges[i + 1]) for i in there.tolist()]
            yield rows(WORDS, len(spans), bucket=there, blob=[packed(hashes[x], n[x], (props[x] & (CLASSES - 1)).astype(np.uint16)) for x in spans])
            lessons = ~held & apart
            if lessons.any():
                used, mine = np.unique(ids[lessons], return_inverse=True)
                yield rows(LESSON, 1, blob=[packed(np.array([int(lessons[i : i + s].sum()) for i, s in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True) if lessons[i]], np.int64), mine.astype(np.int32), props[used])])
            vocabulary, texts, tokens, chunk = Vocabulary(), [], 0, chunk + 1

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text, held, apart in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode()
                words = raw.lower().split()
                words.append(END)
                texts.append((doc, held, np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), apart, len(raw)))
                tokens += len(words)
                if tokens >= CHUNK:
                    yield from flush()
        if texts:
            yield from flush()
        for side, own in enumerate(counts):
            if own is not None:
                slices = [(i, own[i * SLICE : (i + 1) * SLICE]) for i in range(-(-size // SLICE))]
                slices = [(i, x) for i, x in slices if x.any()]
                yield rows(TABLE, len(slices), bucket=[2 * i + side for i, _ in slices], blob=[packed(x) for _, x in slices])

    return in_batches(docs).mapInArrow(run, _ROWS.format(kind=kind))


def _added(slices: DataFrame) -> DataFrame:
    """Sums of count slices, first within salted parts, then all; a task holds the slices it was dealt once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = unpacked(blob)[0].astype(np.uint64)
                sums[i] = sums[i] + part if i in sums else part
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(total)], pa.binary())], names=["slice", "blob"])

    salted = slices.select(F.col("bucket").alias("slice"), "blob", F.pmod(F.shiftright("chunk", 32), F.lit(16)).alias("salt"))
    salted = salted.repartition("slice", "salt").select("slice", "blob")
    return salted.mapInArrow(run, "slice int, blob binary").repartition("slice").mapInArrow(run, "slice int, blob binary")


def _answered(words: DataFrame) -> DataFrame:
    """(chunk, bucket, blob, cls, n, v): for the words of each chunk and bucket their counts over all chunks; and per class the tokens and distinct words of a bucket.

    A chunk sends each of its words once, so a bucket holds a word at most once a chunk, however frequent it is.
    """

    def run(rows: pa.Table) -> pa.Table:
        asked = [unpacked(b) for b in rows.column("blob").to_pylist()]
        unique, first, place = np.unique(np.concatenate([a[0] for a in asked]), return_index=True, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([a[1] for a in asked]).astype(np.float64), minlength=len(unique)).astype(np.int64)
        cls = np.concatenate([a[2] for a in asked])[first][total > 0].astype(np.int64)
        n = np.bincount(cls, weights=total[total > 0], minlength=CLASSES).astype(np.int64)
        v = np.bincount(cls, minlength=CLASSES)
        some = np.flatnonzero(v)
        blobs = [packed(total[part]) for part in np.split(place, np.cumsum([len(a[0]) for a in asked])[:-1])]
        k = len(some)
        pad = lambda values, front: pa.concat_arrays([pa.nulls(front, values.type), values])
        return pa.table({
            "chunk": pa.chunked_array([*rows.column("chunk").chunks, pa.nulls(k, pa.int64())]), "bucket": pa.chunked_array([*rows.column("bucket").chunks, pa.nulls(k, pa.int32())]), "blob": pa.array([*blobs, *[None] * k], pa.binary()),
            "cls": pad(pa.array(some, pa.int32()), len(blobs)), "n": pad(pa.array(n[some], pa.int64()), len(blobs)), "v": pad(pa.array(v[some], pa.int64()), len(blobs)),
        })

    return words.select("chunk", "bucket", "blob").groupBy("bucket").applyInArrow(run, "chunk long, bucket int, blob binary, cls int, n long, v long")


def _taught(lessons: DataFrame, tables: Tables, context_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The mixing weights, learned online on each chunk's lessons and averaged over the chunks by the number of bits that each gate saw, and the rates of the second stage from the sums over all chunks."""
    sent = lessons.sparkSession.sparkContext.broadcast(arrays_of(tables))  # arrays alone, which need no copy of this package to be read
    width = KINDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = Tables(*sent.value)
                own.weights = own.weights.copy()
                sizes, ids, props = unpacked(blob)
                starts = np.zeros(len(ids), bool)
                starts[np.cumsum(sizes) - sizes] = True
                seen, came, was_set = train_weights(own, *contexts(ids, starts, props, context_bits))
                seen = np.repeat(seen, width)
                total, n = total + np.r_[own.weights.astype(np.float64).ravel() * seen, was_set], n + np.r_[seen, came]
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(n[at])], names=["i", "w", "n"])

    told = np.r_[tables.weights.astype(np.float64).ravel(), tables.rates.ravel()]
    prior = np.r_[np.zeros(tables.weights.size), np.full(tables.rates.size, RUNG_PRIOR)]
    for r in lessons.select("blob").mapInArrow(run, "i long, w double, n double").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():  # a row per weight and rate
        told[r["i"]] = round((r["w"] + prior[r["i"]] * told[r["i"]]) / (r["n"] + prior[r["i"]]), 6)
    weights, rates = told[: tables.weights.size], np.clip(told[tables.weights.size :], 1e-5, 1 - 1e-5)
    return weights.reshape(tables.weights.shape).astype(np.float32), rates.reshape(tables.rates.shape)


def arrays_of(t: Tables) -> tuple:
    return t.plain, t.odds, t.evidence, t.weights, t.rates


def learned(docs: DataFrame, *, modulus: int = 5, held_out: int = 1, apart: int = 20, context_bits: int = CONTEXT_BITS) -> tuple[Model, DataFrame]:
    """The model of all texts outside the held-out fold, and all texts as word numbers with their words' training counts (see ``score``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    side = F.pmod(F.crc32(F.concat(id_text(F.col("doc_id")), F.lit(":mix")).cast("binary")), F.lit(apart)) == 0
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"), side.alias("apart"))
    buckets = 2 * max(4, docs.select(F.spark_partition_id().alias("p")).distinct().count())
    encoded = stored(_encoded(rows, kind, buckets, context_bits), "lm")
    answered = stored(_answered(encoded.where(F.col("kind") == WORDS)), "lm-words")
    per_class = answered.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # at most CLASSES rows
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[per_class["cls"]], class_v[per_class["cls"]] = per_class["n"], per_class["v"]
    size = KINDS << (BITS + context_bits)
    sums = np.zeros((2, size))
    for r in _added(encoded.where(F.col("kind") == TABLE)).collect():  # at most 2 * size counts
        part = unpacked(r["blob"])[0]
        sums[r["slice"] & 1, (r["slice"] >> 1) * SLICE :][: len(part)] = part
    shape = (KINDS, 1 << context_bits, CLASSES)
    lesson = tables_of(*sums[0].reshape(shape))  # without the documents that the weights are learned on
    tables = tables_of(*sums.sum(axis=0).reshape(shape))
    tables.weights, tables.rates = _taught(encoded.where(F.col("kind") == LESSON), lesson, context_bits)
    texts = encoded.where(F.col("kind") == TEXT).select("chunk", F.lit(-1).alias("bucket"), "doc_ids", "held", "n_bytes", "blob")
    return Model(tables, class_n, class_v, context_bits), texts.unionByName(answered.where("chunk is not null").select("chunk", "bucket", "blob"), allowMissingColumns=True)


def score(docs: DataFrame, *, modulus: int = 5, held_out: int = 1, apart: int = 20, context_bits: int = CONTEXT_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    Word and context counts come from all texts outside the held-out fold. The mixing weights and the second stage are learned in tasks on one in ``apart`` of these
    documents, all of them whole, from context counts of the others. Context tables have 2 ** ``context_bits`` contexts of each kind,
    so they are sent to the tasks whatever the corpus; word counts are as many as the words and are added up and handed back by shuffles, in
    which a chunk of texts sends each of its words once. A null or empty text has the end token alone; repeated rows are scored
    each; null ids are in the fold of the empty text; an empty table gives no rows; with no training text all counts are zero. Words are told apart by 64-bit
    hashes. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    model, chunks = learned(docs, modulus=modulus, held_out=held_out, apart=apart, context_bits=context_bits)
    total_n = int(model.class_n.sum())
    sent = docs.sparkSession.sparkContext.broadcast((arrays_of(model.tables), model.class_n, model.class_v, model.context_bits))

    def run(rows: pa.Table) -> pa.Table:
        tables, *rest = sent.value
        model = Model(Tables(*tables), *rest)
        parts = sorted(zip(rows.column("bucket").to_pylist(), range(rows.num_rows), strict=True))
        blobs, text = rows.column("blob").to_pylist(), parts[0][1]
        size, ids, props = unpacked(blobs[text])
        known, base, told = model.text(ids, size, props, np.concatenate([unpacked(blobs[i])[0] for _, i in parts[1:]]))
        of = lambda k: pa.concat_arrays(rows.column(k).slice(text, 1).chunks).flatten()
        return pa.table({"doc_id": of("doc_ids"), "held_out": of("held"), "n_tokens": pa.array(size), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(told), "n_bytes": of("n_bytes")})

    out = chunks.groupBy("chunk").applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") * float(np.log2(10))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total_n).cast("long").alias("train_tokens"), "base_score", "score", (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
