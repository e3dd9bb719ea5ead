"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, free, in_batches
from cairn.llm.components import components

#: Multiplier of the streams that widen one 64-bit hash to several (the golden ratio in 64 bits).
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def shingle_hashes(text: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of each n-word shingle; of the whole sequence if there are fewer words; none for no words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shifted = [words[i:] for i in range(n)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*shifted))), np.uint64, len(words) - n + 1)


def majority_bits(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint, big-endian: a bit is 1 if set in over half of the hashes. No hashes: zero."""
    if not len(hashes):
        return bytes(8 * words)
    counts = np.zeros(64 * words, np.int64)
    streams = (np.arange(1, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(GOLDEN)
    for start in range(0, len(hashes), 255):  # 255: the counts of a step fit a byte
        part = hashes[start : start + 255]
        if words > 1:
            wide = part[:, None] * streams[None, :]
            wide ^= wide >> np.uint64(29)
            wide *= np.uint64(0xBF58476D1CE4E5B9)
            wide ^= wide >> np.uint64(32)
            part = np.concatenate([part[:, None], wide], axis=1)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc_id, fp, wide): the first 64 bits as a long, and all ``64 * words`` bits as binary if words > 1.

    One row per input row. A-Z are lower-cased; a null text counts as empty and has fingerprint zero.
    """
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            out = [majority_bits(shingle_hashes(t.as_py() or b"", shingle, seed), words) for t in texts]
            first = np.array([int.from_bytes(x[:8], "big") for x in out], np.uint64).view(np.int64)
            wide = pa.array(out if words > 1 else [None] * len(out), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), wide], names=["doc_id", "fp", "wide"])

    schema = StructType([StructField("doc_id", kind), StructField("fp", LongType()), StructField("wide", BinaryType())])
    return in_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def block_keys(fp, bits: int, blocks: int, agree: int):
    """One (combo, key) for each choice of ``agree`` out of ``blocks`` slices of a 64-bit fingerprint.

    Fingerprints that differ in at most ``blocks - agree`` bits leave ``agree`` slices untouched, so they
    share one of the keys.
    """
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    slices = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in itertools.pairwise(edges)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        key, width = F.lit(0).cast("long"), 0
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(slices[i])
            width += edges[i + 1] - edges[i]
        assert width < 64
        keys.append(F.struct(F.lit(number).alias("combo"), key.alias("key")))
    return F.explode(F.array(*keys))


def close_links(prints: DataFrame, *, radius: int = 2, blocks: int = 4, cap: int = 32) -> DataFrame:
    """Links (a, b) that connect all distinct 64-bit fingerprints within ``radius`` differing bits (0 to 2).

    ``prints`` has a column fp. Fingerprints are joined on pigeonhole block keys and verified by Hamming
    distance. A block with over ``cap`` distinct fingerprints is not joined with itself: its members go
    the other exact way, in rows that grow with the members alone. Each is listed under every value at
    most one bit away; two fingerprints are within two bits exactly if they meet under some value, and
    those that meet are chained to the least of them.
    """
    if not 0 <= radius <= 2 or blocks <= radius:
        raise ValueError("radius must be 0 to 2, and blocks larger than it")
    prints = prints.select("fp").where("fp is not null").distinct()
    keyed = prints.select("fp", block_keys(F.col("fp"), 64, blocks, blocks - radius).alias("k")).select("fp", "k.combo", "k.key")
    sizes = keyed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["combo", "key"]))
    small = shared.where(F.col("n") <= cap)
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (
        small.select("combo", "key", F.col("fp").alias("a"))
        .join(small.select("combo", "key", F.col("fp").alias("b")), ["combo", "key"])
        .where((F.col("a") > F.col("b")) & (differ <= radius))
        .select("a", "b")
        .distinct()
    )
    crowded = shared.where(F.col("n") > cap).select("fp").distinct()
    if radius == 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        near = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    else:  # within one bit: equal, or met under the value with one bit cleared and marked
        clear = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1)).alias("rest")) for i in range(64)]
        near = crowded.select("fp", F.explode(F.array(*clear)).alias("centre")) if radius else crowded.select("fp", F.col("fp").alias("centre"))
    least = near.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("centre", "b")
    chained = near.join(least, "centre").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(chained)


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2, blocks: int = 4, cap: int = 32) -> DataFrame:
    """(doc_id, fp, component_id): groups of documents linked by fingerprints at ``radius`` or fewer differing bits.

    component_id is the least doc_id of the group. One row per input row: repeated rows, equal texts and
    texts without words (fingerprint zero) share a fingerprint and so a group; a null doc_id is kept,
    and a group of null ids alone has a null component_id. An empty table gives no rows. Other columns
    of ``docs`` are not read. Copies of a text are one node of the link graph, however many they are.
    """
    prints = cut(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, seed=seed).select("doc_id", "fp"))
    return _grouped(prints, close_links(prints, radius=radius, blocks=blocks, cap=cap), "fp")


def _grouped(prints: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """Adds component_id, the least doc_id of the nodes that ``links`` connect."""
    roots = components(links).withColumnRenamed("node", node)
    least = cut(prints.groupBy(node).agg(F.min("doc_id").alias("m")).join(roots, node, "left"))
    heads = _headed(least.where("root is not null").withColumnRenamed(node, "node"), "m", F.min).select(F.col("node").alias(node), F.col("h").alias("component_id"))
    return prints.join(least.where("root is null").select(node, F.col("m").alias("component_id")).union(heads), node)


def _headed(rooted: DataFrame, value: str, of, salts: int = 16) -> DataFrame:
    """(node, h): ``of`` the values of all nodes of a root, for each of its nodes; a root's nodes are dealt over ``salts`` tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    least = rooted.groupBy("root").agg(of(value).alias("h")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return rooted.withColumn("salt", salt).join(least, ["root", "salt"]).select("node", "h")


def unsigned_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near-duplicates by similarity -------------------------------------------------------------------


#: Share of differing bits at a Jaccard similarity of 0.8: the angle of cosine 2 * 0.8 / 1.8, over pi.
AT_LEAST = 0.1515
#: Share of isolated pairs at ``AT_LEAST`` that meet in a block.
RECALL = 0.995


def blocks_for(rows: int, words: int, seed: int = 17) -> np.ndarray:
    """Bit positions of the blocks, one block a line, so that pairs at ``AT_LEAST`` meet with probability ``RECALL``.

    Blocks have so many bits that unrelated rows seldom share one, and there are as many as this width needs. The first are the
    fingerprint in order; when its bits are used up, they are shuffled and cut again.
    """
    width = min(max(16, int(rows).bit_length() + 1), 40)
    number = int(np.ceil(np.log(1 - RECALL) / np.log1p(-((1 - AT_LEAST) ** width))))
    rng, bits, lines = np.random.default_rng(seed), np.arange(64 * words), []
    while len(lines) < number:
        lines += list(bits[: len(bits) // width * width].reshape(-1, width))
        bits = rng.permutation(64 * words)
    return np.array(lines[:number])


def wide_links(prints: DataFrame, *, words: int, positions: np.ndarray | None = None, max_share: float = 0.165, first_bits: int = 26, cap: int = 8, cell: int = 1024) -> DataFrame:
    """Links (a, b) that connect the rows of ``prints`` (node, fp, wide) whose wide fingerprints share a block and differ in at most ``max_share`` of the bits.

    The blocks are the bits at the lines of ``positions``, else ``blocks_for`` the number of rows; rows that share a block are candidates, are
    screened by the first 64 bits (at most ``first_bits`` differ: 5 deviations above what ``max_share`` gives) and verified over all bits.
    The rows of a block of over ``cap`` are seated in cells of ``cell`` rows, and a cell's task finds its components. The components of
    all links so far then tell what is left: in a block of several cells whose rows lie in several components, the rows outside the largest one meet
    all rows of the block, in cells of two times ``cell``. So rows that share a block end in one component if they are close,
    whatever the block's size; no task holds more than a cell, and a cell gives no more links than it has rows.
    """
    if positions is None:
        positions = blocks_for(prints.count(), words)
    rows = prints.select("node", "fp", "wide")
    keyed = rows.mapInArrow(_keys(positions, _hot_keys(rows, positions)), _KEYED).repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = cut(keyed.mapInArrow(_by_key(first_bits, cap, cell), "a long, b long, key long"))
    links = _verified(prints, found.where("key is null").select("a", "b"), words, max_share)
    crowded = found.where("key is not null").select(F.col("a").alias("node"), "key", F.col("b").alias("i"))
    wide = prints.select("node", "wide")
    seated = crowded.withColumn("j", F.lit(0).cast("long")).join(wide, "node").withColumn("root", F.col("node"))
    links = cut(links.union(_met(seated, words, max_share, first_bits)))
    roots = cut(components(links))
    large = crowded.groupBy("key").agg(F.max("i").alias("m")).where("m > 0").select("key")
    rooted = cut(crowded.join(large, "key").select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root")))
    by_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parted = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    parted = cut(parted.select("key", "main", F.ceil(F.col("n") / cell).alias("across"), F.ceil((F.col("n") - F.col("most")) / cell).alias("down")))
    left = rooted.join(parted, "key")
    seat = lambda seats: F.pmod(F.xxhash64("node"), seats)
    every = left.select("node", "key", "root", seat(F.col("across")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("j"))
    others = left.where("root <> main").select("node", "key", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("i"), seat(F.col("down")).alias("j"))
    crossed = _met(every.union(others).distinct().join(wide, "node"), words, max_share, first_bits)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(crossed)


_KEYED = "node long, fp long, key long, salt int"


def _hot_keys(rows: DataFrame, positions: np.ndarray, one_in: int = 64, often: int = 16, most: int = 200_000) -> np.ndarray:
    """Block keys of some thousand rows or more, as a hashed share of the rows tells; at most ``most``.

    They only tell which keys are dealt over many tasks from the start; what is compared is the same with or without them.
    """
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).mapInArrow(_keys(positions, np.empty(0, np.int64)), _KEYED)
    counted = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often).orderBy(F.desc("n"), "key").limit(most)
    return np.sort(np.array([r["key"] for r in counted.select("key").collect()], np.int64))  # at most ``most`` keys


def _keys(positions: np.ndarray, hot: np.ndarray):
    """A row for each block of each row: the block's number above its bits, which are those at a row of ``positions``; salt deals the rows of hot keys."""
    n, width = positions.shape
    gap = -width % 8  # packbits fills the last byte with zeros

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                wide = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                packed = np.packbits(np.unpackbits(wide, axis=1)[:, positions.reshape(-1)].reshape(-1, n, width), axis=2).astype(np.int64)
                value = np.zeros(packed.shape[:2], np.int64)
                for i in range(packed.shape[2]):
                    value = (value << 8) | packed[:, :, i]
                key = ((value >> gap) + (np.arange(n, dtype=np.int64) << width)[None, :]).reshape(-1)
                node, fp = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
                salt = np.zeros(len(key), np.int32)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    salt[often] = 1 + ((node[often].astype(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(58)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (node, fp, key, salt))], names=["node", "fp", "key", "salt"])

    return run


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def _by_key(first_bits: int, cap: int, cell: int):
    """From rows sorted by key and salt: (a, b, null), the pairs of blocks of at most ``cap`` rows, and (node, cell, key), the rows of the others.

    Keeps at most ``cap`` rows besides the batch it is at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]  # key, salt, node, fp of the last block so far, if it is small
        open_, told = None, 0  # the last block, if it is not, and how many of its rows were told

        def batch_of(a, b, key):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())], names=["a", "b", "key"])

        def seats(salt, place):
            return (salt.astype(np.int64) << 32) + place // cell

        def given(columns, closed: bool):
            nonlocal held, open_, told
            key, salt, node, fp = columns
            if not len(key):
                return
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            sizes = np.diff(np.r_[starts, len(key)])
            large = (sizes > cap) | (salt[starts] > 0)
            if not closed and not large[-1]:
                held = [c[starts[-1] :] for c in columns]
                key, salt, node, fp = (c[: starts[-1]] for c in columns)
                starts, sizes, large = starts[:-1], sizes[:-1], large[:-1]
            elif not closed:
                open_, told = (key[-1], salt[-1]), int(sizes[-1])
            many = np.repeat(large, sizes)
            for lag in range(1, min(cap, len(key))):
                i = np.flatnonzero((key[lag:] == key[:-lag]) & ~many[lag:])
                i = i[_far(fp[i], fp[i + lag]) <= first_bits]
                if len(i):
                    yield batch_of(np.maximum(node[i], node[i + lag]), np.minimum(node[i], node[i + lag]), None)
            if many.any():
                place = np.arange(len(key)) - np.repeat(starts, sizes)
                yield batch_of(node[many], seats(salt[many], place[many]), key[many])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 0, 1)]
            if open_ is not None:
                same = (columns[0] == open_[0]) & (columns[1] == open_[1])
                n = int(same.sum())
                if n:
                    yield batch_of(columns[2][:n], seats(columns[1][:n], told + np.arange(n)), columns[0][:n])
                    told += n
                columns = [c[n:] for c in columns]
                if not len(columns[0]):
                    continue
                open_ = None
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            held = [c[:0] for c in columns]
            yield from given(columns, False)
        yield from given(held, True)

    return run


def _met(seated: DataFrame, words: int, max_share: float, first_bits: int) -> DataFrame:
    """Links (a, b) between the close rows of each cell (key, i, j) of rows (node, wide, root): as many as connect what is close or has one root."""
    limit = int(max_share * 64 * words)

    def run(rows: pa.Table) -> pa.Table:
        wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), ">u8").reshape(rows.num_rows, -1).astype(np.uint64)
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        one, two = cell_links(wide, root, limit, first_bits)
        return pa.table({"a": np.maximum(node[one], node[two]), "b": np.minimum(node[one], node[two])})

    return seated.select("key", "i", "j", "node", "wide", "root").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def cell_links(wide: np.ndarray, root: np.ndarray, limit: int, first_bits: int, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """A forest (one, two) of close rows that connects all rows that close rows and equal roots connect: a breadth-first search over the rows not yet met."""
    fp, left = wide[:, 0], np.arange(len(wide))
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left) > 1:
        own = root[left] == root[left[0]]
        ahead, left = left[own], left[~own]
        while len(ahead) and len(left):
            now, ahead = ahead[:step], ahead[step:]
            i, j = np.nonzero(np.bitwise_count(fp[now, None] ^ fp[None, left]) <= first_bits)
            near = np.bitwise_count(wide[now[i]] ^ wide[left[j]]).sum(axis=1, dtype=np.int64) <= limit
            hit, first = np.unique(j[near], return_index=True)
            if len(hit):
                one.append(now[i[near][first]])
                two.append(left[hit])
                new = np.isin(root[left], root[left[hit]])
                ahead, left = np.r_[ahead, left[new]], left[~new]
    return np.concatenate(one), np.concatenate(two)


def _verified(prints: DataFrame, pairs: DataFrame, words: int, max_share: float) -> DataFrame:
    limit = int(max_share * 64 * words)
    pairs = pairs.distinct()
    one = prints.select(F.col("node").alias("a"), F.col("wide").alias("wide_a"))
    two = prints.select(F.col("node").alias("b"), F.col("wide").alias("wide_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            near = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= limit
            yield batch.select([0, 1]).filter(pa.array(near))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "wide_a", "wide_b")
    return joined.mapInArrow(verify, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, seed: int = 42, words: int = 30, max_share: float = 0.165) -> DataFrame:
    """(doc_id, text_key, node, component_id, head): groups of documents whose shingles are similar, by wide SimHash fingerprints.

    With 1,920 bits, the share of differing bits is the angle between the shingle counts within about one
    hundredth: 0.152 for texts whose shingle sets have a Jaccard similarity of 0.8. Rows, nulls and
    empty texts are treated as in ``simhash_groups``; texts without words form one group. text_key is a hash
    of the text; head is true for the rows that stand for their group: those of its least id and, if texts
    differ under it, of the least text_key (of a null id only where the group has no other).
    """
    keyed = docs.select(F.struct(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key")).alias("row"), F.col(text).cast("string").alias("text"))
    prints = fingerprints(keyed, doc_id="row", shingle=shingle, seed=seed, words=words)
    node = F.xxhash64("wide")
    prints = cut(prints.select("doc_id.*", "fp", "wide"))
    nodes = cut(prints.select(node.alias("node"), "fp", "wide").groupBy("node").agg(F.min("fp").alias("fp"), F.min("wide").alias("wide")))
    roots = components(wide_links(nodes, words=words, max_share=max_share)).withColumnRenamed("node", "_n")
    first = prints.groupBy(node.alias("node")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m"))
    first = cut(first.join(roots, first["node"] == roots["_n"], "left").select("node", "m", "root"))
    heads = first.where("root is null").select("node", F.col("m").alias("h")).union(_headed(first.where("root is not null"), "m", F.min))
    rows = prints.select("doc_id", "text_key", node.alias("node")).join(heads, "node")
    head = F.col("doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("text_key") == F.col("h.text_key"))
    return rows.select("doc_id", "text_key", "node", F.col("h.doc_id").alias("component_id"), head.alias("head"))


def text_key(text):
    """A hash of the text, another for null than for the empty text."""
    return F.xxhash64(text.cast("string"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``near_copies``: that of its least id.

    Rows are told apart by id and text, so ids that are null or repeat with other texts stand for each of
    their groups; a row with a null id stays where no other row of its group has an id. Of rows that
    repeat both, one stays.
    """
    heads = groups.where("head").groupBy(F.col("doc_id").alias("_head"), F.col("text_key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))

    def those(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_head"]) & (text_key(docs["text"]) == chosen["_key"]), "left_semi")

    if not heads.where("_n > 1").limit(1).count():
        return those(heads)
    name = free(docs, "text_key")
    twice = those(heads.where("_n > 1")).withColumn(name, text_key(F.col("text"))).dropDuplicates(["doc_id", name]).drop(name)
    return those(heads.where("_n = 1")).unionByName(twice)
