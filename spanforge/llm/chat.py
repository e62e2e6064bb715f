"""Operator 5, chat formatting: token ids and loss masks of whole conversations.

The turns of a conversation are rendered in one text, encoded once by operator 3's
encoder; the lengths of the tokens give their byte offsets.  The spans of the
assistant's turns (content and end marker) are sorted, and each token is found
among them by binary search: it is trained on if its own span meets one of theirs.

Template, for each turn: ``<|role|>`` newline, text, ``<|end|>`` newline.  The
markers are ordinary text to the tokenizer.  The tokenizer is a file
(``vocabulary``, a .tiktoken list).

A conversation of more than ``part_turns`` turns is cut into parts of that many,
each a row (``part`` 0, 1, ..), so no conversation is gathered in one task.  The
tokens are those of the whole: a turn ends in a newline after a marker and the next
begins with a marker, where the pattern cuts anyway.

Cases: ``conv_id`` is an integer of up to 64 bits.  Turns are ordered by (turn, role, text), nulls first; repeated turns stay.
A null role is ``unknown``, a null text is empty.  Rows with a null ``conv_id``
belong to no conversation and are left out.  A conversation without an assistant
has a mask of zeros.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm import bpe
from spanforge.llm.common import cut, lists

VOCABULARY = bpe.VOCABULARY
#: turns in a row of the result
PART_TURNS = 4096
ROLE = "assistant"
END = "<|end|>"


def render(turns: list[tuple[str | None, str | None]], role: str = ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of the turns of ``role``, in order, in bytes."""
    parts, spans, at = [], [], 0
    for who, text in turns:
        head = f"<|{'unknown' if who is None else who}|>\n"
        body = f"{text or ''}{END}"
        first = at + len(head.encode("utf-8", "surrogatepass"))
        last = first + len(body.encode("utf-8", "surrogatepass"))
        if who == role:
            spans.append((first, last))
        parts += [head, body, "\n"]
        at = last + 1
    return "".join(parts), spans


def mask(begins: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token (begin, end) that meets one of the sorted, disjoint ``spans`` (rows of begin, end)."""
    at = np.searchsorted(spans[:, 1], begins, "right")  # the first span that ends after the token begins
    hit = at < len(spans)
    out = np.zeros(len(begins), np.int8)
    out[hit] = spans[at[hit], 0] < ends[hit]
    return out


def _turns(conversations: DataFrame, part_turns: int) -> DataFrame:
    """``conv_id``, ``part``, ``turns`` in order: (turn, role, text)."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t")
    )
    # turns / part_turns conversations at most have more turns than a row
    long_ = cut(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > part_turns).select("conv_id"))
    if long_.isEmpty():
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.lit(0).alias("part"), "turns")
    short = rows.join(long_, "conv_id", "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.lit(0).alias("part"), "turns")
    # numbers in order of turns by a range sort; equal turns are told apart by a number, so that they can be spread too
    own = rows.join(long_, "conv_id", "left_semi").withColumn("k", F.monotonically_increasing_id())
    ordered = cut(own.repartitionByRange("conv_id", "t", "k").sortWithinPartitions("conv_id", "t", "k").select("conv_id", "t", F.monotonically_increasing_id().alias("at")))
    sizes = ordered.groupBy("conv_id", F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = cut(sizes.select("conv_id", "p", "first", before.alias("before")))  # a row for each partition and conversation in it
    rank = ordered.withColumn("p", F.shiftright("at", 33)).join(place, ["conv_id", "p"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before"))
    part = F.floor(F.col("rank") / part_turns).cast("int")
    cut_up = rank.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("turns"))
    return short.unionByName(cut_up.select("conv_id", "part", F.col("turns.t").alias("turns")))


def chat_format(conversations: DataFrame, vocabulary: str = VOCABULARY, role: str = ROLE, part_turns: int = PART_TURNS) -> DataFrame:
    """Each conversation: ``conv_id``, ``part``, ``n_turns``, ``n_tokens``, ``n_trained``, ``ids``, ``loss_mask``."""

    def run(batches):
        enc = bpe.encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                made = [render([(x["role"], x["text"]) for x in conv], role) for conv in rows.column(2).to_pylist()]
                ids, count = enc.encode([text for text, _ in made])
                size = enc.vocabulary.token_len[ids]
                ends = np.cumsum(size)
                # all conversations one after the other: one search for the batch
                last = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
                spans = np.array([(a + begin, b + begin) for (_, own), begin in zip(made, last.tolist()) for a, b in own], np.int64).reshape(-1, 2)
                trained = mask(ends - size, ends, spans)
                doc = np.repeat(np.arange(len(made)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array(np.asarray(rows.column(2).value_lengths()), pa.int32()),
                        pa.array(count, pa.int32()),
                        pa.array(np.bincount(doc, trained, len(made)).astype(np.int32)),
                        lists(ids, count, pa.int32()),
                        lists(trained, count, pa.int8()),
                    ],
                    ["conv_id", "part", "n_turns", "n_tokens", "n_trained", "ids", "loss_mask"],
                )

    return _turns(conversations, part_turns).mapInArrow(run, "conv_id long, part int, n_turns int, n_tokens int, n_trained int, ids array<int>, loss_mask array<tinyint>")
