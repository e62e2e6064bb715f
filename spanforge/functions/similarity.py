"""Trigram word similarity of names, for "did you mean"."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spanforge.storage import settle

THRESHOLD = 0.6


def trigrams(text: str) -> list[str]:
    """Trigrams of the words of a text, in order: each word is padded with two blanks before and one after."""
    out = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {w} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def word_similarity(query: str, text: str) -> float:
    """The best similarity of the query's trigrams to those of a run of the text's."""
    want = set(trigrams(query))
    have = trigrams(text)
    if not want or not have:
        return 0.0
    at = [i for i, t in enumerate(have) if t in want]
    best = 0.0
    for k, lo in enumerate(at):
        seen: set[str] = set()
        last = lo
        for hi in at[k:]:
            seen |= set(have[last : hi + 1])
            last = hi + 1
            common = len(seen & want)
            best = max(best, common / (len(want) + len(seen) - common))
    return best


def suggest(symbols: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Names (``name``, ``score``) like ``query``, the best first, then short ones, then in order."""

    @pandas_udf("double")
    def score(name: pd.Series, leaf: pd.Series) -> pd.Series:
        return pd.Series([max(word_similarity(query, a), word_similarity(query, b)) for a, b in zip(name, leaf)], dtype="float64")

    if not trigrams(query):
        return symbols.select("name", F.lit(0.0).alias("score")).limit(0)
    # a blurred name is as similar or more, and few of those are different: each is scored once
    blur = _Blur(query)
    names = symbols.select("name", "leaf_name")
    kept, n = settle(names.mapInArrow(blur.distinct, "in_name string, in_leaf string").distinct().where(score("in_name", "in_leaf") >= THRESHOLD))
    if not n:
        return symbols.select("name", F.lit(0.0).alias("score")).limit(0)
    near = names.mapInArrow(blur.rows, "name string, leaf_name string, in_name string, in_leaf string")
    close = near.join(kept, ["in_name", "in_leaf"], "left_semi").select("name", "leaf_name").distinct()
    found = close.withColumn("score", score("name", "leaf_name")).where(F.col("score") >= THRESHOLD)
    return found.groupBy("name").agg(F.max("score").alias("score")).orderBy(F.desc("score"), F.length("name"), "name").limit(limit)


class _Blur:
    """Names with one character for all letters and digits (of ASCII) that a query lacks, in lower case.

    They keep the trigrams that they share with it, and of the others some may become one; so they are as similar or more.
    """

    def __init__(self, query: str):
        absent = [c for c in b"0123456789abcdefghijklmnopqrstuvwxyz" if c not in query.lower().encode()]
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        for c in absent:
            table[table == c] = absent[0]
        self.table = table

    def of(self, column: pa.Array) -> pa.Array:
        """Byte by byte, without a loop over rows: no byte of a longer character is changed."""
        column = column.cast(pa.large_string()).fill_null("")
        _, at, text = column.buffers()
        if text is None:
            return column
        return pa.Array.from_buffers(pa.large_string(), len(column), [None, at, pa.py_buffer(self.table[np.frombuffer(text, dtype=np.uint8)].tobytes())], offset=column.offset)

    def distinct(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.table({"in_name": self.of(b["name"]), "in_leaf": self.of(b["leaf_name"])}).group_by(["in_name", "in_leaf"]).aggregate([])
            yield from found.cast(pa.schema([("in_name", pa.string()), ("in_leaf", pa.string())])).to_batches()

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blurred = [self.of(b[c]).cast(pa.string()) for c in ("name", "leaf_name")]
            yield pa.RecordBatch.from_arrays([b["name"], b["leaf_name"], *blurred], ["name", "leaf_name", "in_name", "in_leaf"])
