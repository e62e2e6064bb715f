"""Operator 4, quality rules: hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Words and punctuation runs (lower case) and their bigrams are hashed into a fixed
number of buckets.  One multinomial is counted over the trusted documents, one
over *all* documents, both smoothed by the same ``SMOOTHING`` counts of the raw
corpus a bucket (more where the target is so small that they are under one count
of it), so a bucket that the target has in proportion has ratio 0 at any size.
Two rules, both with fixed thresholds: a document's score is the mean over its
n-grams of ``log p_target - log p_raw`` and must reach ``threshold``; and none of
its words may have a ratio under ``floor``, that is, be frequent in the corpus and
yet missing from all that is trusted (abuse in otherwise ordinary text).

The trusted target is every document with quality 1 and toxic 0 in ``labels``;
of more than ``target_limit`` of those, the ones with the smallest hashes of
their ids are taken.  The raw counts have no such bound.

Cases: ``doc_id`` is an integer of up to 64 bits.  A null or empty text, or one
of white space alone, has no n-grams: score null, not kept.  A repeated row
counts and scores as often as it occurs.  A null ``doc_id`` is scored like any
other and never trusted.  With no trusted document each score is 0 and every
non-empty document is kept.  An empty table gives an empty result.  Other columns
are ignored, or passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytescan import Tokens, ngram_hash
from spanforge.llm.common import keep_rows, make_room, map_texts, pieces, release, smallest_hashes

BUCKET_BITS = 20
#: mean nats per n-gram under which a document is rejected
THRESHOLD = -0.35
#: nats of a word under which a document is rejected
FLOOR = -4.0
TARGET_LIMIT = 2_000_000
SMOOTHING = 4.0
#: 2**RANGE_BITS neighbouring buckets are shuffled as one row
RANGE_BITS = 10
#: bytes of text that a task looks at together
SLICE = 1 << 19


def features(texts: list, bits: int = BUCKET_BITS) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the bucket of each, and bucket and text of every bigram."""
    tokens = Tokens(texts)
    pair, doc = ngram_hash(tokens.hash, 2, tokens.doc)
    shift = np.uint64(64 - bits)
    return tokens, (tokens.hash >> shift).astype(np.int64), (pair >> shift).astype(np.int64), doc


def scores(texts: list, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio of each text's n-grams, and the least of its words; NaN where it has none."""
    tokens, word, pair, doc = features(texts, len(ratio).bit_length() - 1)
    n = tokens.n_docs
    own = ratio[word].astype(float)
    total = np.bincount(tokens.doc, own, n) + np.bincount(doc, ratio[pair], n)
    count = tokens.count + np.bincount(doc, minlength=n)
    some = np.flatnonzero(tokens.count)
    least = np.full(n, np.nan)
    if len(some):
        least[some] = np.minimum.reduceat(own, tokens.first[some])
    return np.where(count > 0, total / np.maximum(count, 1), np.nan), least


def kept(score: np.ndarray, least: np.ndarray, threshold: float, floor: float) -> np.ndarray:
    return (np.round(score, 6) >= threshold) & (np.round(least, 6) >= floor)


def _target_ids(labels: DataFrame, limit: int) -> np.ndarray:
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("i")).distinct()
    ids = smallest_hashes(good, limit, "i").toArrow().to_pandas()["i"].to_numpy(np.int64)
    return np.sort(ids)


def _pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest of them needs."""
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A row for each range of buckets: its number, raw and target counts."""
    raw, target = ([_pack(x[k]) for x in sums.values()] for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(raw, pa.binary()), pa.array(target, pa.binary())], ["at", "raw", "target"])


def _add(batches: Iterable[pa.RecordBatch], width: int) -> dict[int, np.ndarray]:
    """Raw and target counts of each range of ``width`` buckets, added up over the rows of ``_batch``."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, *packed in zip(*(column.to_pylist() for column in batch.columns)):
            own = sums.setdefault(at, np.zeros((2, width), np.int64))
            for k, data in enumerate(packed):
                own[k] += np.frombuffer(data, f"u{len(data) // width}").astype(np.int64)
    return sums


def counts(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, target_limit: int = TARGET_LIMIT) -> DataFrame:
    """N-grams by bucket over all documents and over the trusted ones: a row for each range of buckets, as ``_batch`` packs it.

    A task of the first stage sends each range once, so the shuffle has 2**(bits - RANGE_BITS) rows of a task at most.
    """
    width = 1 << min(bits, RANGE_BITS)
    trusted = docs.sparkSession.sparkContext.broadcast(_target_ids(labels, target_limit))  # target_limit ids at most

    def count(batches):
        make_room()
        found = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for rows, texts in pieces(batch, "text", SLICE):
                ids = rows.column(0)
                known = trusted.value
                own = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                good = (known[at] == own) & np.array(ids.is_valid()) if len(known) else np.zeros(len(own), bool)
                tokens, word, pair, doc = features(texts, bits)
                for bucket, who in ((word, tokens.doc), (pair, doc)):
                    np.add.at(found[0], bucket, 1)
                    np.add.at(found[1], bucket[good[who]], 1)
        release()
        ranges = found.reshape(2, -1, width)
        yield _batch({int(at): ranges[:, at] for at in np.flatnonzero(ranges[0].any(axis=1))})

    def add(batches):
        make_room()
        yield _batch(_add(batches, width))

    kind = "at int, raw binary, target binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, kind)
    return rows.repartition("at").mapInArrow(add, kind)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, target_limit: int = TARGET_LIMIT) -> np.ndarray:
    """The log ratio of each bucket, counted over all documents; 0 everywhere without a target."""
    found = counts(docs, labels, bits, target_limit).toArrow()  # 2**bits counts of each kind at most
    raw, target = np.zeros((2, 1 << bits), np.int64)
    width = 1 << min(bits, RANGE_BITS)
    for at, own in _add(found.to_batches(), width).items():
        raw[at * width : (at + 1) * width], target[at * width : (at + 1) * width] = own
    if not target.any():
        return np.zeros(1 << bits, np.float32)
    share = int(target.sum()) / int(raw.sum())
    some = max(SMOOTHING, 1 / share)
    return np.log((target / share + some) / (raw + some)).astype(np.float32)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR, **how) -> DataFrame:
    """Every document: ``doc_id``, ``score`` and ``least`` (rounded to 6 digits), ``keep``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))  # 2**bits ratios

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        s, least = scores(texts, model.value)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.round(s, 6), from_pandas=True), pa.array(np.round(least, 6), from_pandas=True), pa.array(kept(s, least, threshold, floor))], ["doc_id", "score", "least", "keep"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, "doc_id long, score double, least double, keep boolean", budget=SLICE)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR, **how) -> DataFrame:
    """The documents that ``score`` keeps, all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    return keep_rows(docs, lambda texts: kept(*scores(texts, model.value), threshold, floor), budget=SLICE)
