"""Bootstrap intervals by multinomial dealing: a replicate's draws go to runs of rows, then to the rows of a run, and only sums leave a run. And draws known from md5, counted by runs too."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import splits

#: Rows of a run, and replicates whose weights are in memory together (a matrix of the two).
RUN, AT_ONCE = 4096, 250
#: Rows that are alike this many times over are drawn by their number: a binomial costs as much as so many single draws.
ALIKE = 16
#: Draws that a task hashes, or counts, at a time.
PICKS = 1 << 21
#: Rows of a run whose exact draws are counted together, and rows up to which a replicate's draws are counted in one array, a byte a row.
WIDTH, DENSE = 1 << 18, 1 << 26


def run_draws(n: int, run: int, size: int, seed: list[int], b: int) -> np.ndarray:
    """How many of the ``n`` draws of each of ``b`` replicates fall to run number ``run`` of runs of ``size`` rows (the last may be shorter).

    Draws are split in two, by a binomial of the halves' rows, down the tree of runs. A node's
    generator is seeded by its place, so every task that passes it splits alike, and the counts of all runs sum to n.
    """
    runs = -(-n // size)
    draws = np.full(b, n, np.int64)
    lo, hi = 0, runs
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = (mid - lo) * size, min(hi * size, n) - lo * size
        given = np.random.default_rng([*seed, lo, hi]).binomial(draws, left / whole)
        draws, lo, hi = (given, lo, mid) if run < mid else (draws - given, mid, hi)
    return draws


def row_weights(draws: np.ndarray, rows: int, seed: list[int]) -> np.ndarray:
    """How often each of ``rows`` rows is drawn in each replicate: each of its draws goes to any row alike."""
    picks = np.random.default_rng(seed).integers(0, rows, int(draws.sum()))
    picks += np.repeat(np.arange(len(draws)), draws) * rows
    return np.bincount(picks, minlength=len(draws) * rows).reshape(len(draws), rows)


def run_sums(weights: np.ndarray, error: np.ndarray, gate: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, list[tuple[float, np.ndarray, np.ndarray]]]:
    """Per replicate: sum of errors, their rows, positives, negatives and the rank sum inside the run; and for its first and last score the positives and negatives with it.

    Rows are in the order of the score. Null errors (NaN) count in no mean, null gates and scores (NaN) in no rank.
    """
    known = ~np.isnan(error)
    ranked = ~np.isnan(gate) & ~np.isnan(score)
    pos, neg = (weights * (ranked & (gate == v)) for v in (1, 0))
    out = [weights @ np.where(known, error, 0.0), weights @ known, pos.sum(1), neg.sum(1)]
    edges = []
    if ranked.any():
        start = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])  # NaN differs from NaN, and weighs nothing
        p, n = np.add.reduceat(pos, start, axis=1), np.add.reduceat(neg, start, axis=1)
        out.append((p * (np.cumsum(n, axis=1) - n / 2)).sum(1))
        own = np.flatnonzero(~np.isnan(score[start]))
        edges = [(score[start[i]], p[:, i], n[:, i]) for i in dict.fromkeys((own[0], own[-1]))]
    else:
        out.append(np.zeros(len(weights)))
    return np.stack(out, axis=1), edges


def resampled_sums(df: DataFrame, by: list[str], *, key: str, y: str, pred: str, gate: str, b: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(by, run, replicate, e, w, pos, neg, u) and (by, run, replicate, score, pos, neg): the sums of each run of rows in the order of the score, and those of its outermost scores.

    The score is the negative prediction. Runs are of ``RUN`` rows; n x b weights are made and used inside the runs' tasks. Rows that
    are mostly alike are drawn by their number (see ``_cell_sums``).
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_none"))
    rows = df.select(group.alias("_g"), F.col(key).alias("_k"), (F.col(pred) - F.col(y)).cast("double").alias("_e"), F.col(gate).cast("double").alias("_t"), (-F.col(pred).cast("double") + 0.0).alias("_s"))
    cells = _cells(rows)
    if cells is not None:
        return _cell_sums(cells, b, seed)
    # equal scores are in the order of a hash, so that a score of very many rows is dealt over tasks
    ranked = splits.ordered(rows.withColumn("_h", F.xxhash64("_k")), "_g", ["_s", "_h", "_k"])
    ranked = ranked.select("_g", F.to_json("_g").alias("_name"), F.floor(F.col("rank") / RUN).cast("long").alias("_run"), "rank", F.col("total").alias("_n"), F.abs("_e").alias("_e"), "_t", "_s")

    def told(batch):
        order = np.argsort(batch.column("rank").to_numpy(), kind="stable")  # the order of the score
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)[order]
        name, n, run = batch.column("_name")[0].as_py(), batch.column("_n")[0].as_py(), batch.column("_run")[0].as_py()
        base = [seed & 0xFFFFFFFF, zlib.crc32((name or "").encode())]
        draws = run_draws(n, run, RUN, base, b)
        weights = lambda at: row_weights(draws[at : at + AT_ONCE], len(order), [*base, run, at, 1])
        return _told_sums(batch, run, b, weights, column("_e"), column("_t"), column("_s"))

    found = ranked.groupBy("_g", "_run").applyInArrow(told, _sums_schema(ranked))
    return found.where("not edge"), found.where("edge")


def _sums_schema(ranked: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("_g", ranked.schema["_g"].dataType), *T.StructType.fromDDL("run long, replicate int, edge boolean, e double, w double, pos double, neg double, u double, score double").fields])


def _told_sums(batch, run: int, b: int, weights, error: np.ndarray, target: np.ndarray, score: np.ndarray):
    """The sums of a run, and of its outermost scores, as an Arrow table; ``weights(at)`` are those of the replicates from ``at``, ``AT_ONCE`` of them."""
    import pyarrow as pa

    cells, outer = [], []
    for at in range(0, b, AT_ONCE):
        sums, edges = run_sums(weights(at), error, target, score)
        numbers = np.arange(at, at + len(sums))
        cells.append(np.column_stack([numbers, sums, np.zeros(len(sums))]))
        outer += [np.column_stack([numbers, np.zeros((len(sums), 2)), p, q, np.zeros(len(sums)), np.full(len(sums), s)]) for s, p, q in edges]
    all_cells = np.concatenate([*cells, *outer])
    is_edge = np.r_[np.zeros(sum(map(len, cells)), bool), np.ones(len(all_cells) - sum(map(len, cells)), bool)]
    m = len(all_cells)
    return pa.table(
        {"_g": pa.array([batch.column("_g")[0].as_py()] * m, batch.schema.field("_g").type), "run": pa.array(np.full(m, run)), "replicate": pa.array(all_cells[:, 0].astype(np.int32)), "edge": pa.array(is_edge)}
        | {c: pa.array(all_cells[:, 1 + i]) for i, c in enumerate(("e", "w", "pos", "neg", "u", "score"))}
    )


def _cells(rows: DataFrame) -> DataFrame | None:
    """(_g, _e, _t, _s, _c): the rows with equal error, gate and score and their number, if these are ``ALIKE`` times fewer than the rows by a sketch; else None."""
    own = ["_g", F.abs("_e").alias("_e"), "_t", "_s"]
    n, distinct = rows.select(*own).agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("_g", "_e", "_t", "_s"), 0.02)).first()
    return rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_c")) if distinct * ALIKE <= n else None


def _cell_sums(cells: DataFrame, b: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """What ``resampled_sums`` gives, for rows that are alike in many others: draws go to runs of cells, then to the cells of a run, by multinomials of their rows.

    That is the law of drawing single rows, as only sums of cells count. The number of runs is that of distinct cells, over ``RUN``, however many rows there are.
    """
    ranked = splits.ordered(cells, "_g", ["_s", "_e", "_t"]).select("_g", F.to_json("_g").alias("_name"), F.floor(F.col("rank") / RUN).cast("long").alias("_run"), "rank", "_e", "_t", "_s", "_c")

    def dealt(batch):
        import pyarrow as pa

        order = np.argsort(batch.column("_run").to_numpy())
        rows, runs, name = batch.column("_c").to_numpy()[order], batch.column("_run").to_numpy()[order], batch.column("_name")[0].as_py()
        draws = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32((name or "").encode()), 2]).multinomial(rows.sum(), rows / rows.sum(), b).T
        return pa.table({"_g": pa.array([batch.column("_g")[0].as_py()] * len(runs), batch.schema.field("_g").type), "_run": pa.array(runs), "draws": _lists(draws.ravel(), np.arange(1, len(runs) + 1) * b, np.int64)})

    def told(batch, dealt):
        order = np.argsort(batch.column("rank").to_numpy(), kind="stable")
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)[order]
        name, run, share = batch.column("_name")[0].as_py(), batch.column("_run")[0].as_py(), column("_c")
        draws = dealt.column("draws").combine_chunks().flatten().to_numpy()
        seeds = [seed & 0xFFFFFFFF, zlib.crc32((name or "").encode()), run]
        weights = lambda at: np.random.default_rng([*seeds, at, 3]).multinomial(draws[at : at + AT_ONCE], share / share.sum())
        return _told_sums(batch, run, b, weights, column("_e"), column("_t"), column("_s"))

    # a row per run: one for thousands of cells
    sizes = ranked.groupBy("_g", "_name", "_run").agg(F.sum("_c").alias("_c"))
    draws = sizes.groupBy("_g").applyInArrow(dealt, T.StructType([ranked.schema["_g"], *T.StructType.fromDDL("_run long, draws array<bigint>").fields]))
    found = ranked.groupBy("_g", "_run").cogroup(draws.groupBy("_g", "_run")).applyInArrow(told, _sums_schema(ranked))
    return found.where("not edge"), found.where("edge")


def bootstrap(df: DataFrame, by: list[str], *, key: str = "example_id", y: str = "y", pred: str = "pred", gate: str = "gate", b: int = 1000, seed: int = 42) -> DataFrame:
    """(by, replicate, mae, auroc) of resamples with replacement, n draws of the n rows of each group.

    A replicate's AUROC is put together from the runs: pairs inside a run are ranked there, a positive is above all
    negatives of the runs before, and scores that reach over the end of a run are set right by their sums. Rows with a null error count as drawn but in
    no mean, those with a null gate or prediction in no rank, as in ``mae`` and ``auroc``. A metric with no row, or one class, is null. Reruns agree; keys should be unique.
    """
    sums, edges = resampled_sums(df, by, key=key, y=y, pred=pred, gate=gate, b=b, seed=seed)
    before = W.partitionBy("_g", "replicate").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("u", F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    # of a score in several runs, a positive and a negative of different runs count one half, whichever run comes first
    earlier = W.partitionBy("_g", "replicate", "score").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    tied = edges.withColumn("one", F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))).groupBy("_g", "replicate", "score")
    tied = tied.agg(((F.sum("pos") * F.sum("neg") - F.sum(F.col("pos") * F.col("neg"))) / 2 - F.sum("one")).alias("u"))
    parts = sums.select("_g", "replicate", "e", "w", "pos", "neg", "u").unionByName(tied.select("_g", "replicate", "u"), allowMissingColumns=True)
    total = parts.groupBy("_g", "replicate").agg(*[F.sum(c).alias(c) for c in ("e", "w", "pos", "neg", "u")])
    return total.select(*[F.col(f"_g.{c}").alias(c) for c in by], "replicate", F.try_divide("e", "w").alias("mae"), F.try_divide("u", F.col("pos") * F.col("neg")).alias("auroc"))


# Draws and weights from md5, the same in every engine ----------------------------------------------


def tasks(spark) -> int:
    """A fixed number of tasks, for steps into which few bytes come and from which much goes out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hashed(texts, first: bytes = b"") -> np.ndarray:
    """The first 48 bits of the md5 of each text, with ``first`` before it."""
    found = b"".join([hashlib.md5(first + t).digest() for t in texts])
    return (np.frombuffer(found, ">u8")[::2] >> np.uint64(16)).astype(np.int64)


def _md5(words: list, m: int) -> np.ndarray:
    """The first 48 bits of the md5 of ``m`` messages of one block, given as its sixteen words: numbers, or arrays where the messages differ."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    turns = [[np.array(x, np.uint32) for x in t] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
    back = [[np.array(32 - x, np.uint32) for x in t] for t in turns]
    a, b, c, d = (np.full(m, x, np.uint32) for x in start)
    f, spare = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(64):
        part = i // 16
        if part == 0:  # (b & c) | (~b & d), and so on, as RFC 1321 has them
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, f), b, f), d, f)
        elif part == 1:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, f), d, f), c, f)
        elif part == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, f), d, f)
        else:
            np.bitwise_xor(np.bitwise_or(np.invert(d, f), b, f), c, f)
        word, add = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[part] % 16], int(abs(math.sin(i + 1)) * 2**32)
        if isinstance(word, int):
            add += word
        else:
            np.add(f, word, f)
        np.add(np.add(f, a, a), np.array(add & 0xFFFFFFFF, np.uint32), a)
        np.left_shift(a, turns[part][i % 4], spare)
        np.bitwise_or(np.right_shift(a, back[part][i % 4], a), spare, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    high, low = (a + np.uint32(start[0])).byteswap(), (b + np.uint32(start[1])).byteswap()
    return high.astype(np.int64) << 16 | low.astype(np.int64) >> 16


def _last_digits(k: int) -> np.ndarray:
    """The ``k`` digits of each number from 0, zeros in front, and the bit that ends a message, as little-endian bytes."""
    numbers = np.arange(10**k)
    out = np.full(len(numbers), 0x80 << 8 * k, np.uint64)
    for place in range(k):
        out |= (numbers // 10 ** (k - 1 - place) % 10 + 48).astype(np.uint64) << np.uint64(8 * place)
    return out


def hashed_numbers(first: bytes, lo: int, hi: int):
    """The first 48 bits of the md5 of ``first`` with each number from ``lo`` up to ``hi`` behind it, in their order, in arrays of at most 10,000."""
    tails = [_last_digits(k) for k in range(5)]
    while lo < hi:
        digits, start = len(str(lo)), lo % 10_000
        k, end = min(digits, 4), min(hi, lo - start + 10_000, 10**digits)
        head = first + str(lo)[:-k].encode()
        at, size = len(head) // 4, end - lo
        if size < 500 or len(head) + k > 55:  # few, or more than a block
            yield hashed([b"%d" % j for j in range(lo, end)], first)
        else:  # all but the last four digits are the same
            words = np.frombuffer(head.ljust(64, b"\0"), "<u4").tolist()
            tail = tails[k][start : start + size] << np.uint64(8 * (len(head) % 4))
            words[at], words[at + 1], words[14] = (tail & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(words[at]), (tail >> np.uint64(32)).astype(np.uint32), 8 * (len(head) + k)
            yield _md5(words, size)
        lo = end


def _lists(values: np.ndarray, ends: np.ndarray, kind=np.int32):
    """An Arrow list per end: the values up to it from the one before."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.astype(kind)))


def draws(sizes: DataFrame, b: int, seed: int, width: int) -> DataFrame:
    """(_n, _pieces, _run, _first, counts): how often each of ``width`` rows, by their numbers, is drawn in the replicates from _first, for every _n of ``sizes`` (_n, _pieces).

    Draw j of replicate r is row md5(seed:r:j) mod _n. A task counts all draws of a replicate in an array of bytes (a row is drawn 256 times
    in no resample), or of several, as far as ``PICKS``; of more than ``DENSE`` rows, a block of ``PICKS`` draws is sorted and sent as places. Both are compressed, to about 2.5 bits a draw.
    """
    n = F.col("_n")
    once = F.when(n > DENSE, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(b), F.floor(F.lit(PICKS) / n)))).cast("int")
    blocks = F.when(n > DENSE, F.ceil(n / PICKS)).otherwise(1).cast("long")
    todo = sizes.select("_n", "_pieces", F.explode(F.sequence(F.lit(0), F.lit(b - 1), once)).alias("_first"), blocks.alias("_b"))
    todo = todo.select("_n", "_pieces", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_block"))

    def picked(batches):
        import pyarrow as pa
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for n, pieces, first, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = lambda r, lo, hi: (h - h // n * n for h in hashed_numbers(b"%d:%d:" % (seed, r), lo, hi))  # noqa: B023, E731
                if n <= DENSE:
                    counts = np.zeros((min(b - first, max(1, PICKS // n)), n), np.uint8)
                    for r, own in enumerate(counts):
                        for at in rows(first + r, 0, n):
                            np.add.at(own, at, np.uint8(1))
                    runs = np.arange(-(-n // width))
                    found = [counts[:, run * width : (run + 1) * width] for run in runs]
                else:
                    at = np.sort(np.concatenate(list(rows(first, block * PICKS, min(n, (block + 1) * PICKS)))))
                    runs, start = np.unique(at // width, return_index=True)
                    found = [(own - run * width).astype(np.uint32) for run, own in zip(runs, np.split(at, start[1:]), strict=True)]
                same = lambda x: pa.array(np.full(len(runs), x))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(n), same(pieces), pa.array(runs), same(first), pa.array([zip_.compress(x.tobytes()) for x in found], pa.binary())], names=["_n", "_pieces", "_run", "_first", "counts"])

    return todo.repartition(tasks(sizes.sparkSession)).mapInArrow(picked, "_n long, _pieces long, _run long, _first long, counts binary")


def _opened(raw: bytes, n: int, rows: int) -> np.ndarray:
    """The counts of ``draws``: a row per replicate."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(raw, np.uint8).reshape(-1, rows) if n <= DENSE else np.bincount(np.frombuffer(raw, np.uint32), minlength=rows)[None]


def drawn_weights(sizes: DataFrame, b: int, seed: int) -> DataFrame:
    """(_n, _i, weights): how often each of _n rows, by its number from 0, is drawn in each of ``b`` replicates (see ``draws``), for every _n of ``sizes`` (each once). Groups of one size share their draws."""
    width = max(1, PICKS // b)

    def counted(table):
        import pyarrow as pa

        n, run = table.column("_n")[0].as_py(), table.column("_run")[0].as_py()
        rows = min(width, n - run * width)
        found = np.zeros((b, rows), np.int32)
        for first, raw in zip(table.column("_first").to_pylist(), table.column("counts").to_pylist(), strict=True):
            counts = _opened(raw, n, rows)
            found[first : first + len(counts)] += counts.astype(np.int32)
        return pa.table({"_n": pa.array(np.full(rows, n)), "_i": pa.array(np.arange(rows) + run * width), "weights": _lists(found.T.ravel(), np.arange(1, rows + 1) * b)})

    found = draws(sizes.select("_n", F.lit(1).cast("long").alias("_pieces")), b, seed, width)
    return found.groupBy("_n", "_run").applyInArrow(counted, "_n long, _i long, weights array<int>")


def drawn_sums(numbered: DataFrame, by: list[str], sizes: DataFrame, b: int, seed: int) -> DataFrame:
    """The rows of ``numbered`` (by, any columns, _n, _i) with _first and weights: how often they are drawn in the replicates from _first. Rows of a run of numbers that are alike are one, with the sum of their weights.

    ``sizes`` are the sizes of groups (_n), a row per group. Rows don't meet their draws in a join: a task has the distinct rows of a run with their places, and the counts of the
    replicates pass it one after the other. Groups of one size share their draws; many of them are dealt to several tasks.
    """
    names, spark = [c for c in numbered.columns if c not in ("_n", "_i")], numbered.sparkSession
    own = F.least("_n", F.lit(WIDTH)) * F.count(F.lit(1))
    # a row per distinct size: at most the root of twice the rows
    sizes = sizes.where("_n > 0").groupBy("_n").agg(F.ceil(own / (4 * WIDTH)).cast("long").alias("_pieces"))
    piece = F.pmod(F.xxhash64(*by), F.col("_pieces")) if by else F.lit(0).cast("long")
    rows = numbered.join(F.broadcast(sizes), "_n").select("_n", F.floor(F.col("_i") / WIDTH).cast("long").alias("_run"), piece.alias("_piece"), F.struct(*names).alias("_row"), F.pmod("_i", F.lit(WIDTH)).cast("int").alias("_at"))
    cells = rows.groupBy("_n", "_run", "_piece", "_row").agg(F.collect_list("_at").alias("_at"), F.lit(-1).cast("long").alias("_first"), F.lit(None).cast("binary").alias("counts"))
    dealt = draws(sizes, b, seed, WIDTH).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).drop("_pieces")
    keys = ["_n", "_run", "_piece"]
    both = cells.unionByName(dealt, allowMissingColumns=True).repartition(tasks(spark), *keys).sortWithinPartitions(*keys, "_first").select(*keys, "_first", "counts", "_row", "_at")

    def summed(batches):
        import pyarrow as pa

        now, rows, ends, places, starts, held, first = None, [], [], [], None, None, 0

        def out():
            if starts is not None and len(held):
                m = len(starts)
                yield pa.RecordBatch.from_arrays([whole, pa.array(np.full(m, first)), _lists(np.stack(held, axis=1).ravel(), np.arange(1, m + 1) * len(held))], names=["_row", "_first", "weights"])

        for batch in batches:
            is_cell = batch.column("counts").is_null().to_numpy(zero_copy_only=False)
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (is_cell[1:] != is_cell[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
                if tuple(key[:, lo]) != now:
                    yield from out()
                    now, rows, places, ends, starts, held, first = tuple(key[:, lo]), [], [], [], None, [], 0
                part = batch.slice(lo, hi - lo)
                if is_cell[lo]:
                    rows.append(part.column("_row"))
                    at = part.column("_at")
                    places.append(at.flatten().to_numpy())
                    ends.append(at.value_lengths().to_numpy())
                    continue
                if not rows:
                    continue
                if starts is None:  # the run's rows are all there
                    whole, at, starts = pa.concat_arrays(rows), np.concatenate(places), np.r_[0, np.cumsum(np.concatenate(ends))[:-1]]
                n, run = int(now[0]), int(now[1])
                for number, raw in zip(part.column("_first").to_pylist(), part.column("counts").to_pylist(), strict=True):
                    for r, counts in enumerate(_opened(raw, n, min(WIDTH, n - run * WIDTH)), number):
                        sums = np.add.reduceat(counts[at], starts, dtype=np.int32)
                        if held and r == first + len(held) - 1:  # a further block of draws of the replicate
                            held[-1] += sums
                            continue
                        if len(held) * len(starts) >= PICKS or (held and r != first + len(held)):
                            yield from out()
                            held = []
                        first = first if held else r
                        held.append(sums)
        yield from out()

    schema = T.StructType([T.StructField("_row", both.schema["_row"].dataType), *T.StructType.fromDDL("_first long, weights array<int>").fields])
    return both.mapInArrow(summed, schema).select("_row.*", "_first", "weights")


def poisson_weights(keys: DataFrame, key: str, b: int, seed: int) -> DataFrame:
    """(key, weights): Poisson(1) weights of each row of ``keys`` in ``b`` replicates, from md5(seed:replicate:key)."""
    term, total, steps = 0.36787944117144233, 0.0, []
    for k in range(1, 12):
        total += term
        steps.append(total)
        term /= k

    def weighed(batches):
        import pyarrow as pa

        for batch in batches:
            names = [b"" if t is None else b":" + t.encode() for t in batch.column("_text").to_pylist()]  # a null key adds nothing
            u = np.stack([hashed(names, b"%d:%d" % (seed, r)) for r in range(b)], axis=1) / float(1 << 48)
            weights = np.searchsorted(np.array(steps), u.ravel(), side="right")
            yield pa.RecordBatch.from_arrays([batch.column("_key"), _lists(weights, np.arange(1, len(names) + 1) * b)], names=["_key", "weights"])

    rows = keys.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("_text"))
    return rows.mapInArrow(weighed, T.StructType([rows.schema["_key"], T.StructField("weights", T.ArrayType(T.IntegerType()))]))
