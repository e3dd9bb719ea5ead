"""Chat formatting: token-level assembly with reserved ids, escaped control strings and loss masks."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import in_batches

#: Where the vocabulary lies; a parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
START, END = "<|im_start|>", "<|im_end|>"
#: Ids that no text encodes to: the vocabulary has ids up to 50255.
START_ID, END_ID = 50257, 50258
#: How the vocabulary splits a text before merging. A fixed value of the published byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes between, one more where there are some already. ``unescape`` undoes it."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Like ``escape``, and without line ends, as the first of these ends the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def vocabulary_of(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read on the driver; tasks are sent its bytes, so executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes | None = None):
    import tiktoken

    lines = (vocabulary_of() if vocabulary is None else vocabulary).splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={START: START_ID, END: END_ID})


def turn_tokens(convs: DataFrame, *, vocabulary: str = VOCABULARY, train_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, ids, n_ids, text_from, text_to): each turn as tokens, its segments encoded one by one.

    A turn is START, role and line end, text, END, line end; ``text_from`` and ``text_to`` bound the tokens
    to train on, and are equal where there are none. Reserved ids are spliced in between segments, so no
    text can produce them.
    """
    sent = convs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value)
        line_end = bpe.encode_ordinary("\n")
        for batch in batches:
            out = {k: [] for k in ("ids", "n", "a", "b")}
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                head = [START_ID, *bpe.encode_ordinary(escape_role(role or "") + "\n")]
                body = bpe.encode_ordinary(escape(text or ""))
                ids = [*head, *body, END_ID, *line_end]
                out["ids"].append(ids)
                out["n"].append(len(ids))
                out["a"].append(len(head))
                out["b"].append(len(head) + (len(body) if role == train_role else 0))
            columns = [batch.column(0), batch.column(1), pa.array(out["ids"], pa.list_(pa.int32())), *(pa.array(out[k], pa.int64()) for k in ("n", "a", "b"))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "ids", "n_ids", "text_from", "text_to"])

    kinds = {k: convs.schema[k].dataType.simpleString() for k in ("conv_id", "turn")}
    rows = in_batches(convs).select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, n_ids long, text_from long, text_to long")


def formatted(convs: DataFrame, *, vocabulary: str = VOCABULARY, train_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, place, ids, start, loss_from, loss_to): conversations as tokens, one row per turn.

    ``start`` is the turn's first position in the conversation's token sequence and [loss_from, loss_to)
    the positions under the loss mask, from prefix sums over the turns' lengths; the ids of a conversation,
    in the order of ``place``, are its sequence, and no conversation is ever held as one value. Turns are
    ordered by turn (null first), then by their tokens, so repeated turns have an order too. Null roles
    and texts are empty; a null conv_id is a conversation; an empty table gives no rows. Other columns
    are not read.
    """
    turns = turn_tokens(convs, vocabulary=vocabulary, train_role=train_role)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "ids")
    upto = F.sum("n_ids").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    start = upto - F.col("n_ids")
    return turns.select(
        "conv_id", "turn", F.row_number().over(order).alias("place"), "ids", start.alias("start"), (start + F.col("text_from")).alias("loss_from"), (start + F.col("text_to")).alias("loss_to")
    )


def read_back(tokens: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids, n_loss_ids): digests read back from the tokens.

    Rows come in the order of conversation and place, and a task keeps only the running digests of the
    conversation it is in, so the longest conversation needs no more memory than the shortest. Its turns do come to one
    task one after another, as a running SHA-256 can't be split; they are sorted on disk if need be.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value)
        state = None

        def closed(s):
            return (s["conv"], s["turns"], s["sha"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["ids"], s["masked"])

        def batch_of(rows, kind):
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "n_loss_ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        kind = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, ids, start, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        out.append(closed(state))
                    state = {"conv": conv, "turns": 0, "sha": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "ids": 0, "masked": 0}
                if ids[0] != START_ID or state["ids"] != start:
                    raise ValueError(f"conversation {conv!r}: a turn does not begin where the one before ends")
                end = ids.index(END_ID)
                role, text = bpe.decode(ids[1:end]).split("\n", 1)
                turn = f"{unescape_role(role)}\n{unescape(text)}\n"
                learned = unescape(bpe.decode(ids[lo - start : hi - start])) if hi > lo else ""
                state["turns"] += 1
                state["sha"].update(turn.encode())
                state["chars"] += len(learned)
                state["loss"].update(learned.encode())
                state["formatted"] += len(bpe.decode(ids))
                state["ids"] += len(ids)
                state["masked"] += hi - lo
            if out:
                yield batch_of(out, kind)
        if state is not None:
            yield batch_of([closed(state)], kind)

    kind = tokens.schema["conv_id"].dataType.simpleString()
    rows = tokens.select("conv_id", "ids", "start", "loss_from", "loss_to", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, n_loss_ids long")
