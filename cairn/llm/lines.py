"""Line deduplication by a sorted stream of line hashes, answered as run-length bitmaps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import stored

#: ASCII white space, stripped at both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pieces that the documents of one line are dealt to.
PIECES = 64


def lines_of(text):
    """The lines of a text, as an array; a null text has one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line):
    """What lines are compared by: white space at both ends is stripped and A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, d0, d1, text): a document is known by its id and 128 bits of its text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("d0"), F.xxhash64(F.lit(1), body).alias("d1"), body.alias("text"))


def hashed_lines(docs: DataFrame, *, min_chars: int = 1, pieces: int = PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(h0, h1, piece, doc_id, d0, d1, pos): the key's 128-bit hash of each line that has ``min_chars`` code points or more, in the order of all these columns.

    Hashes are range-partitioned with the piece of the document, so that a line which a third of all
    documents hold is dealt to ``pieces`` places of the order, and sorted by document and position inside.
    """
    rows = _identified(docs, doc_id, text)
    rows = rows.select("doc_id", "d0", "d1", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "d0", "d1", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= max(1, min_chars))
    rows = rows.select(F.xxhash64("key").alias("h0"), F.xxhash64(F.lit(1), "key").alias("h1"), F.pmod(F.xxhash64("d0", "doc_id"), F.lit(pieces)).cast("int").alias("piece"), "doc_id", "d0", "d1", "pos")
    return rows.repartitionByRange("h0", "h1", "piece").sortWithinPartitions("h0", "h1", "piece", "doc_id", "d0", "d1", "pos")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """``lines`` with ``new``: whether it is its document's first line of the key, streamed from the order.

    A row is one if the row before it in the piece is of another document.
    """
    order = W.partitionBy("h0", "h1", "piece").orderBy("doc_id", "d0", "d1", "pos")
    same = F.lag("d0").over(order).eqNullSafe(F.col("d0")) & F.lag("d1").over(order).eqNullSafe(F.col("d1")) & F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))
    return lines.withColumn("new", (F.row_number().over(order) == 1) | ~same)


def repeated_keys(lines: DataFrame, *, min_docs: int) -> DataFrame:
    """(h0, h1, n_docs, head): the keys in ``min_docs`` documents or more, how many, and the first occurrence (doc_id, d0, d1, pos) of all.

    Documents are counted piece by piece in the sorted stream, and a row per key and piece is summed up.
    """
    piece = lines.where("new").groupBy("h0", "h1", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d0", "d1", "pos")).alias("head"))
    return piece.groupBy("h0", "h1").agg(F.sum("n").alias("n_docs"), F.min("head").alias("head")).where(F.col("n_docs") >= min_docs)


def run_lengths(dropped, n_lines):
    """A keep bitmap as run lengths: kept, dropped, kept, and so on, from the sorted array of dropped positions.

    The first run may be 0; the lengths sum to ``n_lines``.
    """
    edge = lambda side: F.filter(dropped, lambda x, i: (i + side < 0) | (i + side >= F.size(dropped)) | (F.get(dropped, i + side) != x + side))
    edges = F.flatten(F.zip_with(edge(-1), F.transform(edge(1), lambda x: x + 1), lambda a, b: F.array(a, b)))
    return F.zip_with(F.concat(edges, F.array(n_lines)), F.concat(F.array(F.lit(0)), edges), lambda a, b: a - b)


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False, pieces: int = PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d0, d1, dropped): for each document that loses a line, its id, 128 bits of its text, and the sorted positions that go.

    Lines are split at ``\\n`` and compared by ``line_key``. A key of ``min_chars`` code points or more in ``min_docs``
    documents or more loses all its lines in every document; with ``keep_first`` the first of all (by doc_id, null last,
    then text and position) stays. Keys, as texts, are told apart by 128-bit hashes. Blank lines
    have no key and stay. Rows with the same id and text are one document; rows that share an id alone are several.
    """
    lines = stored(first_occurrences(hashed_lines(docs, min_chars=min_chars, pieces=pieces, doc_id=doc_id, text=text)), "lines")
    keys = repeated_keys(lines, min_docs=min_docs).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    gone = lines.join(keys, ["h0", "h1", "piece"])
    if keep_first:
        head = [F.col(f"head.{c}").eqNullSafe(lines[c]) for c in ("doc_id", "d0", "d1", "pos")]
        gone = gone.where(~(head[0] & head[1] & head[2] & head[3]))
    return gone.groupBy("doc_id", "d0", "d1").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_bitmaps(docs: DataFrame, *, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False, pieces: int = PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, runs, text): one row per row of ``docs``; ``runs`` is its keep bitmap as run lengths (see ``run_lengths``, ``keep_bitmaps``).

    ``text`` is the given text, null as empty, for ``kept_text``. A null or empty text is one empty line, which stays; very long
    texts are split whole; repeated rows get a row each; an empty table gives none; other columns, of any name, are not read.
    """
    gone = keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs, keep_first=keep_first, pieces=pieces, doc_id=doc_id, text=text)
    rows = _identified(docs, doc_id, text)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("d0").alias("_d0"), F.col("d1").alias("_d1"), "dropped")
    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (F.col("d0") == F.col("_d0")) & (F.col("d1") == F.col("_d1")), "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    both = both.select("doc_id", "text", n_lines.cast("int").alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return both.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), run_lengths(F.col("dropped"), F.col("n_lines")).alias("runs"), "text")


def kept_text(text, runs):
    """The lines that the run lengths keep, joined by ``\\n``."""
    keeps = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    # what is dropped becomes null, which array_join leaves out
    return F.when(F.size(runs) == 1, text).otherwise(F.array_join(F.zip_with(lines_of(text), keeps, lambda line, keep: F.when(keep, line)), "\n"))
