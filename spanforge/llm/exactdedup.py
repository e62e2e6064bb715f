"""Operator 9, exact dedup: incoming texts against immutable snapshots.

A snapshot is a table of distinct digests, stored by bucket; each bucket has a
static binary-fuse filter (8-bit fingerprints, about 9 bits a key, 1 in 256 false
positives), built once and never changed.  Incoming digests go to their bucket
and are screened by the filter of every snapshot before; only positives join the
exact digests of their bucket, and then the texts themselves are compared byte
for byte.  Texts that occur more than once in the incoming batch are grouped
apart from the snapshots.  After that the batch becomes a snapshot.

``dedup`` ingests the whole table as ``batches`` batches by equal ranges of
``doc_id``, oldest first; each row is screened against all snapshots before it.
Digests are counted before they are bucketed, and the bytes of equal texts are
compared by partial aggregation, so a text that a third of all rows have is never
gathered: its rows get their answer by a broadcast (``common.join_one``).  Texts
whose digests collide are told apart by a join on the bytes.

Up to ``filter_keys`` suspected digests, a filter of them goes to every task and
only suspected texts move; beyond, all texts are joined with the suspects' keys.
The result is the same.

Cases: ``doc_id`` is an integer of up to 64 bits.  Null texts and null ids are
never duplicates.  Empty texts are equal to each other.  Rows that repeat a
``doc_id`` with the same text are one document; with other texts, each is judged.
The document of the smallest id stays.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bytescan import mix
from spanforge.llm.common import cut, join_one
from spanforge.storage import fresh_path

BATCHES = 3
#: digests in a bucket
BUCKET_ROWS = 100_000
#: keys of suspects up to which their filter is sent to every task (9 bits each)
FILTER_KEYS = 20_000_000
#: bytes of SHA-256 that a digest has
DIGEST = 16


class BinaryFuse8:
    """A static 3-wise binary-fuse filter over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, table: np.ndarray):
        self.seed, self.segment, self.table = seed, segment, table

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        start = (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)  # one of `segments` windows of three segments
        m = np.uint64(segment - 1)
        a = (h & m).astype(np.int64)
        b = ((h >> np.uint64(18)) & m).astype(np.int64)
        c = (mix(h) & m).astype(np.int64)
        return np.stack([start * segment + a, (start + 1) * segment + b, (start + 2) * segment + c])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B1) >> np.uint64(24)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse8":
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        size = 0 if n < 2 else int(round(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))))
        segments = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            h = mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            place = cls._places(h, segment, segments)
            width = (segments + 2) * segment
            # peel in rounds: every place that only one key has gives that key away
            count = np.bincount(place.ravel(), minlength=width)
            acc = np.zeros(width, np.int64)
            for row in place:
                np.bitwise_xor.at(acc, row, np.arange(n))
            live, rounds = n, []
            ready = np.flatnonzero(count == 1)
            while len(ready):
                key, at = np.unique(acc[ready], return_index=True)
                slot = ready[at]
                rounds.append((key, slot))
                live -= len(key)
                touched = place[:, key]
                np.subtract.at(count, touched.ravel(), 1)
                for row in touched:
                    np.bitwise_xor.at(acc, row, key)
                near = np.unique(touched)
                ready = near[count[near] == 1]
            if not live:
                table = np.zeros(width, np.uint8)
                prints = cls._print(h)
                for key, slot in reversed(rounds):
                    p = place[:, key]
                    table[slot] = 0
                    table[slot] = prints[key] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]]
                return cls(seed, segment, table)
        raise RuntimeError("no seed peels this filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.astype(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        p = self._places(h, self.segment, len(self.table) // self.segment - 2)
        return self._print(h) == self.table[p[0]] ^ self.table[p[1]] ^ self.table[p[2]]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "BinaryFuse8":
        seed, segment = np.frombuffer(raw, np.int64, 2).tolist()
        return cls(seed, segment, np.frombuffer(raw, np.uint8, offset=16))


def _digest(text: str, size: int) -> F.Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, size)


def digests(docs: DataFrame, size: int = DIGEST) -> DataFrame:
    """``doc_id``, ``digest`` (``size`` bytes of SHA-256), ``key`` (64 bits of it)."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text", size).alias("digest"))
    return rows.withColumn("key", F.xxhash64("digest"))


def batch_of(first: int, last: int, batches: int) -> F.Column:
    """Which of ``batches`` equal ranges of ids a ``doc_id`` is in, in exact integers."""
    step = -(-(last - first + 1) // batches)
    return F.expr(f"CAST((CAST(doc_id AS DECIMAL(20, 0)) - ({first}BD)) DIV {step}BD AS INT)")


def build_filters(rows: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``filter`` of a snapshot's digests; a bucket without digests has none."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("key")).astype(np.int64).view(np.uint64)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "filter": pa.array([BinaryFuse8.build(keys).to_bytes()], pa.binary())})

    return rows.select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """The digests (``bucket``, ``digest``) whose key some snapshot's filter of their bucket has."""

    def probe(own: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.asarray(own.column("key")).astype(np.int64).view(np.uint64)
        hit = np.zeros(len(keys), bool)
        for raw in known.column("filter"):
            if len(keys):
                hit |= BinaryFuse8.from_bytes(raw.as_py()).contains(keys)
        return own.select(["bucket", "digest"]).filter(pa.array(hit))

    return rows.select("bucket", "digest", "key").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "bucket int, digest binary")


def dedup(docs: DataFrame, batches: int = BATCHES, bucket_rows: int = BUCKET_ROWS, filter_keys: int = FILTER_KEYS, digest_bytes: int = DIGEST) -> DataFrame:
    """Each document whose text an earlier one has: ``doc_id``, ``duplicate_of`` (the smallest id with that text)."""
    spark: SparkSession = docs.sparkSession
    first, last, n = docs.select(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count("doc_id")).first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, duplicate_of long")
    at = fresh_path(spark, "snapshots")
    buckets = max(1, -(-n // (batches * bucket_rows)))
    counted = digests(docs, digest_bytes).groupBy(batch_of(first, last, batches).alias("batch"), "digest", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    # by bucket: a bucket's digests lie together in the files of each batch
    bucketed = counted.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    stored = "digest binary, key long, least long, most long, n long, bucket int, batch int"
    bucketed.repartition("bucket").sortWithinPartitions("batch", "bucket").write.partitionBy("batch").parquet(f"{at}/digests")
    table = spark.read.schema(stored).parquet(f"{at}/digests")
    suspects, filters = None, None
    for b in range(batches):
        own = table.where(F.col("batch") == b)
        found = own.where("n > 1").select("digest")  # the new batch's own duplicates
        if filters is not None:
            # positives join the exact digests of their bucket; false positives of the filters end here
            known = table.where(F.col("batch") < b).select("bucket", "digest")
            found = found.unionByName(screen(own, filters).join(known, ["bucket", "digest"], "left_semi").select("digest"))
        suspects = found if suspects is None else suspects.unionByName(found)
        if b < batches - 1:
            build_filters(own, buckets).write.parquet(f"{at}/filters-{b}")
            # by the path of each: scans of one root folder count as equal, whatever has been added to it
            filters = spark.read.schema("bucket int, filter binary").parquet(*[f"{at}/filters-{x}" for x in range(b + 1)])
    suspects = cut(suspects.distinct())
    texts = _texts(docs, suspects, filter_keys, bucket_rows, digest_bytes)
    # the byte check: a text that the last filter let through by mistake is alone
    kinds = cut(texts.groupBy("digest", "text").agg(F.min("doc_id").alias("duplicate_of"), F.max("doc_id").alias("most"), F.count("*").alias("n")))
    whole = kinds.groupBy("digest").agg(F.count("*").alias("kinds"), F.min("duplicate_of").alias("duplicate_of"), F.max("most").alias("most"), F.sum("n").alias("n"))
    # texts of one digest are equal: their ids need no second look at the bytes
    one = cut(whole.where("kinds = 1 AND most > duplicate_of").select("digest", "duplicate_of", "n"))
    rows = digests(docs, digest_bytes).select("doc_id", "digest")
    same = join_one(rows, one, "digest", "n", n)
    out = same.where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")
    several = cut(whole.where("kinds > 1").select("digest"))
    if not several.isEmpty():
        bytes_ = kinds.join(several, "digest", "left_semi").where("most > duplicate_of").select("text", "duplicate_of")
        out = out.unionByName(texts.join(several, "digest", "left_semi").join(bytes_, "text").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of"))
    return out.distinct()


def _texts(docs: DataFrame, suspects: DataFrame, limit: int, bucket_rows: int, digest_bytes: int) -> DataFrame:
    """``doc_id``, ``digest`` and ``text`` (bytes) of the documents with one of the digests, and of a few others."""
    spark = docs.sparkSession
    own = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = own.withColumn("digest", _digest("text", digest_bytes))
    n = suspects.count()
    if n > limit:
        return rows.join(suspects, "digest", "left_semi")
    buckets = max(1, -(-n // bucket_rows))
    keys = suspects.select(F.xxhash64("digest").alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    filters = spark.sparkContext.broadcast({r["bucket"]: bytes(r["filter"]) for r in build_filters(keys, buckets).collect()})  # `limit` keys at most

    @F.pandas_udf("boolean")
    def suspect(key: pd.Series) -> pd.Series:
        values = key.to_numpy(np.int64)
        out, bucket = np.zeros(len(values), bool), values % buckets  # as pmod: not negative
        for b, raw in filters.value.items():
            at = np.flatnonzero(bucket == b)
            if len(at):
                out[at] = BinaryFuse8.from_bytes(raw).contains(values[at].view(np.uint64))
        return pd.Series(out)

    return rows.where(suspect(F.xxhash64("digest"))).select("doc_id", "digest", "text")


ORACLE = """
SELECT doc_id, first AS duplicate_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> first
"""
