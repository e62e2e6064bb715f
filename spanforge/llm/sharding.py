"""Operator 7, sharding: best-fit-decreasing bin packing of indivisible groups.

A group is the set of documents with equal text (its copies must not be split
between shards); its size is the bytes of them all (rounded up to ``grain``, a
byte by default).  Groups in falling order of size enter the shard with the least room that still
holds them, or a new one.

Best fit treats groups of one size alike, and shards of one room: so the packing
is worked out on the driver over the numbers of groups by size (``capacity /
grain`` sizes at most, whatever the input), with a balanced tree (a treap) of
runs of shards by room.  It yields runs "the next n groups go, m to a shard, to
shards b, b + 1, ..".  The groups are numbered in order of size by a range sort and
find their run by binary search.

The rows of a group get its shard by ``common.join_one``, so a text of millions of
copies isn't gathered.

Cases: ``doc_id`` is an integer of up to 64 bits.  A null text has 0 bytes, and all null texts are one group, apart from the
empty texts' group; either takes one grain.  A group larger than a shard has an
``oversize`` shard of its own.  Null ids are kept; repeated rows count as often
as they occur.  Ties go by the group's digest.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cut, join_one

CAPACITY = 16 << 20
GRAIN = 1


class _Node:
    __slots__ = ("key", "runs", "order", "left", "right")

    def __init__(self, key: int, order: float):
        self.key, self.runs, self.order = key, [], order
        self.left = self.right = None


class RoomTree:
    """A treap of runs of shards (first, number) by room; all operations take logarithmic time."""

    def __init__(self) -> None:
        self.root, self._random = None, random.Random(1)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            a, b = self._split(node.right, key)
            node.right = a
            return node, b
        a, b = self._split(node.left, key)
        node.left = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.order > b.order:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def least(self, room: int):
        """The node of the least key of at least ``room``."""
        node, best = self.root, None
        while node is not None:
            if node.key >= room:
                best, node = node, node.left
            else:
                node = node.right
        return best

    def add(self, room: int, first: int, number: int) -> None:
        node = self.least(room)
        if node is None or node.key != room:
            node = _Node(room, self._random.random())
            a, b = self._split(self.root, room)
            self.root = self._merge(self._merge(a, node), b)
        node.runs.append((first, number))

    def take(self, node) -> tuple[int, int]:
        """Remove and give the run added last under ``node``."""
        run = node.runs.pop()
        if not node.runs:
            a, b = self._split(self.root, node.key)
            _, b = self._split(b, node.key + 1)
            self.root = self._merge(a, b)
        return run


def plan(sizes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (first group, first shard, groups to a shard, groups) for (size, number) in falling order; the number of shards."""
    tree, runs, shards, group = RoomTree(), [], 0, 0
    for size, number in sizes:
        left = number
        while left:
            node = tree.least(size) if size <= capacity else None
            if node is None:
                room = max(capacity, size)
                each = room // size
                full, rest = divmod(left, each)
                if full:
                    runs.append((group, shards, each, full * each))
                    if room - each * size:
                        tree.add(room - each * size, shards, full)
                    shards, group = shards + full, group + full * each
                if rest:
                    runs.append((group, shards, rest, rest))
                    tree.add(room - rest * size, shards, 1)
                    shards, group = shards + 1, group + rest
                break
            room = node.key
            first, have = tree.take(node)
            each = room // size
            full = min(have, left // each)
            if full:
                runs.append((group, first, each, full * each))
                if room - each * size:
                    tree.add(room - each * size, first, full)
                group, left = group + full * each, left - full * each
            if full < have:
                first, have = first + full, have - full
                if left:  # fewer than `each` are left: they share one shard
                    runs.append((group, first, left, left))
                    if room - left * size:
                        tree.add(room - left * size, first, 1)
                    group, left, first, have = group + left, 0, first + 1, have - 1
                if have:
                    tree.add(room, first, have)
    return runs, shards


def shard(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Every document: ``doc_id``, ``group_key``, ``group_bytes``, ``shard``, ``oversize``."""
    spark = docs.sparkSession
    digest = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("group_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")))
    groups = cut(rows.groupBy("group_key").agg(F.sum("n").alias("group_bytes"), F.count("*").alias("copies")))
    unit = F.greatest(F.ceil(F.col("group_bytes") / grain), F.lit(1)).cast("long")
    room = capacity // grain
    sizes = groups.select(F.least(unit, F.lit(room + 1)).alias("u")).groupBy("u").count().orderBy(F.desc("u")).toArrow().to_pandas()  # room + 1 rows at most
    large = int(sizes.loc[sizes["u"] > room, "count"].sum())  # each has a shard of its own
    runs, _ = plan([(int(u), int(c)) for u, c in zip(sizes["u"], sizes["count"]) if u <= room], room)
    table = np.array(runs, np.int64).reshape(-1, 4)
    where = spark.sparkContext.broadcast(table)  # about as many runs as sizes

    # numbers in order of size: rank inside a partition of a range sort, and how many come before the partition
    ordered = cut(groups.withColumn("u", unit).repartitionByRange(F.desc("u"), "group_key").sortWithinPartitions(F.desc("u"), "group_key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = ordered.groupBy(part.alias("p")).count().orderBy("p").toArrow().to_pandas()  # a row for each partition
    start = dict(zip(before["p"].tolist(), (before["count"].cumsum() - before["count"]).tolist()))
    begin = spark.sparkContext.broadcast(start)

    def assign(batches):
        runs_, starts = where.value, begin.value
        for pdf in batches:
            at = pdf["at"].to_numpy()
            number = np.array([starts[p] for p in (at >> 33).tolist()], np.int64) + (at & ((1 << 33) - 1)) if len(at) else at
            rest = number - large
            if len(runs_):
                i = np.clip(np.searchsorted(runs_[:, 0], rest, "right") - 1, 0, None)
                normal = runs_[i, 1] + (rest - runs_[i, 0]) // runs_[i, 2]
            else:
                normal = rest
            big = rest < 0
            yield pd.DataFrame({"group_key": pdf["group_key"], "group_bytes": pdf["group_bytes"], "copies": pdf["copies"], "shard": np.where(big, number, large + normal), "oversize": big})

    placed = cut(ordered.select("at", "group_key", "group_bytes", "copies").mapInPandas(assign, "group_key binary, group_bytes long, copies long, shard long, oversize boolean"))
    return join_one(rows, placed, "group_key", "copies", rows.count()).select("doc_id", F.lower(F.hex("group_key")).alias("group_key"), "group_bytes", "shard", "oversize")
