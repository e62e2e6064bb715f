"""Operator 1, SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint: 128 bits, each the weighted majority of the hashes of the text's
words (lower case, each occurrence counts).  A word of five bytes or more weighs
two, each pair of neighbouring words one; so short words, figures and the order
of words count through their pairs (words of a text without pairs weigh two,
whatever their length).  Two documents are near copies if their fingerprints
differ in at most ``k`` bits; groups are the connected components of that
relation.

Search (exact for the Hamming threshold): the 128 bits are permuted so that
correlated bits share a partition of 16 bits; each fingerprint is a query that
gives its partitions unequal thresholds summing to ``k - 8 + 1``, by dynamic
programming over the exact number of fingerprints around its value in each
partition.  Some partition of a near copy then lies within its threshold.  The
values of a partition are cut by their top bits into shards; a fingerprint is
stored in one shard of each partition and probes those its threshold reaches.
A shard that holds more than ``SHARD_ROWS`` fingerprints, or is probed by more,
is cut into blocks of that size of either kind and every pair of blocks is a
group, so what a task holds is bounded whatever the input and its skew.  Equal
fingerprints are one fingerprint in all of this.  A group hands on only a
spanning forest of the near copies it finds, so thousands of copies stay linear.
No number of candidates or partners is capped.

Cases: ``doc_id`` is an integer of up to 64 bits.  Null texts are never grouped,
nor are rows with a null ``doc_id``.  Texts without words are grouped if they are
equal, byte for byte (all empty ones).  Rows that repeat a ``doc_id`` with
another text are documents of their own, told apart by their fingerprints; those
that repeat the text too are one document.  Within a group the smallest
``doc_id`` stays (of several texts with that id, the one of the smallest
fingerprint).  An empty table gives an empty result.  Other columns are ignored,
or passed through by ``stage``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytescan import Tokens, mix, ngram_hash
from spanforge.llm.common import cut, fresh, join_one, map_texts, release, smallest_hashes

K = 22
BITS, PARTS, WIDTH = 128, 8, 16
#: bytes from which a word votes by itself
LONG_WORD = 5
#: fingerprints stored in a group, and fingerprints that probe it
SHARD_ROWS = 1 << 16
#: fingerprints from which bit correlations are estimated; no result depends on it
CORRELATION_ROWS = 20_000
_PAIRS_AT_ONCE = 1 << 21


def fingerprints(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words per text, and which texts are not null."""
    tokens = Tokens(texts, punct=False)
    n = tokens.n_docs
    doc = tokens.doc
    pair, pair_doc = ngram_hash(tokens.hash, 2, doc)
    use = (tokens.end - tokens.start >= LONG_WORD) | (tokens.count[doc] == 1)
    kinds = [(tokens.hash[use], doc[use], 2), (pair, pair_doc, 1)]
    total = sum(weight * np.bincount(who, minlength=n) for _, who, weight in kinds)
    out = np.zeros((n, 2), np.uint64)
    for w in range(2):
        ones = np.zeros((n, 64), np.int64)
        for h, who, weight in kinds:
            ones += weight * _ones(mix(h + np.uint64(0x1234567 * (w + 1))), who, n)
        out[:, w] = np.ascontiguousarray(np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")).view(np.uint64)[:, 0]
    for i in np.flatnonzero(total == 0):  # no words: the text itself
        raw = texts[i].encode("utf-8", "surrogatepass") if texts[i] else b""
        a = mix(np.array([hash_bytes(raw)], np.uint64))
        out[i] = a[0], mix(a + np.uint64(99))[0]
    return out, np.array([t is not None for t in texts], bool)


def _ones(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many of the hashes of each text have each bit; ``doc`` is in order."""
    ones = np.zeros((n, 64), np.int64)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    some = np.flatnonzero(count)
    lo = 0
    while lo < len(some):  # about 2**14 hashes at a time: reduceat makes a copy of 256 bytes a hash
        hi = max(lo + 1, int(np.searchsorted(first[some], first[some[lo]] + (1 << 14))))
        a, b = first[some[lo]], first[some[hi - 1] + 1]
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[some[lo:hi]] = np.add.reduceat(bits, first[some[lo:hi]] - a, axis=0, dtype=np.int32)
        lo = hi
    return ones


def hash_bytes(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``f0``, ``f1`` of every document with an id and a text."""

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        f, ok = fingerprints(texts)
        out = pa.RecordBatch.from_arrays([rows.column(0), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))], ["doc_id", "f0", "f1"])
        return out.filter(pa.array(ok))

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, fn, "doc_id long, f0 long, f1 long")


def bit_order(f: np.ndarray) -> np.ndarray:
    """A permutation of the bits: greedily, each partition takes the bits most correlated with those it has."""
    bits = np.unpackbits(f.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").astype(np.float32)
    if len(bits) < 2:
        return np.arange(BITS)
    bits -= bits.mean(0)
    sd = np.sqrt((bits * bits).sum(0)) + 1e-9
    corr = np.abs(bits.T @ bits) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, order = np.ones(BITS, bool), []
    for _ in range(PARTS):
        left = np.flatnonzero(free)
        group = [int(left[np.argmax(corr[np.ix_(left, left)].sum(1))])]
        free[group[0]] = False
        while len(group) < WIDTH:
            left = np.flatnonzero(free)
            best = int(left[np.argmax(corr[np.ix_(left, group)].sum(1))])
            group.append(best)
            free[best] = False
        order += group
    return np.array(order)


def permute(f: np.ndarray, order: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits[:, order]), axis=1, bitorder="little").view(np.uint16).reshape(-1, PARTS)


def ball_counts(hist: np.ndarray, reach: int) -> np.ndarray:
    """For each 16-bit value and radius r = -1, 0, .., reach: the number of fingerprints within r of it."""
    shell = [hist.astype(np.float64)] + [np.zeros(len(hist)) for _ in range(reach)]
    every = np.arange(len(hist))
    for b in range(WIDTH):
        flip = every ^ (1 << b)
        for r in range(reach, 0, -1):
            shell[r] = shell[r] + shell[r - 1][flip]
    return np.concatenate([np.zeros((1, len(hist))), np.cumsum(shell, axis=0)])


def allocate(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Thresholds (-1 .. reach) of each query's partitions, of sum ``k - PARTS + 1``, of the fewest candidates in all.

    ``values``: (n, PARTS); ``counts``: (PARTS, reach + 2, 65536) of ball_counts.
    """
    n, radii = len(values), counts.shape[1]
    total = k - PARTS + 1 + PARTS  # of the shifted thresholds 0 .. radii - 1
    best = np.full((n, total + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((PARTS, n, total + 1), np.int8)
    for i in range(PARTS):
        cost = counts[i][:, values[:, i]].T  # n x radii
        new = np.full((n, total + 1), np.inf)
        for r in range(min(radii, total + 1)):
            c = best[:, : total + 1 - r] + cost[:, r : r + 1]
            better = c < new[:, r:]
            new[:, r:][better] = c[better]
            choice[i][:, r:][better] = r
        best = new
    at, out = np.full(n, total), np.zeros((n, PARTS), np.int8)
    for i in range(PARTS - 1, -1, -1):
        out[:, i] = choice[i][np.arange(n), at]
        at = at - out[:, i]
    return out - 1


def masks(radius: int, width: int = WIDTH) -> np.ndarray:
    """All masks of up to ``radius`` of ``width`` bits, by number of bits."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


class Forest:
    """Union-find over 0 .. n - 1, by arrays of pairs; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            while True:
                a2, b2 = p[a], p[b]
                if (a2 == a).all() and (b2 == b).all():
                    break
                a, b = a2, b2
            open_ = a != b
            a, b = a[open_], b[open_]
            if len(a):
                np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p[p] != p).any():
            p[:] = p[p]
        return p


def near_in_shard(ids: np.ndarray, f: np.ndarray, value: np.ndarray, stored: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """Probe and verify: root of each row in the forest of the pairs found.

    Row i is stored under ``value[i]`` if ``stored[i]``, and probes within ``radius[i]`` (-1: not).  Only pairs with the
    query's id below the other's are sought: the smaller id's thresholds find each pair.
    """
    forest = Forest(len(ids))
    own = np.flatnonzero(stored)
    own = own[np.argsort(value[own], kind="stable")]
    keys = value[own]
    begin = np.searchsorted(keys, np.arange(65537))
    for r_min, group in ((r, masks(r)[len(masks(r - 1)) if r else 0 :]) for r in range(int(radius.max(initial=-1)) + 1)):
        asking = np.flatnonzero(radius >= r_min)
        for mask in group:
            to = value[asking] ^ mask
            n = begin[to + 1] - begin[to]
            hit = n > 0
            q, lo, n = asking[hit], begin[to[hit]], n[hit]
            ends = np.cumsum(n)
            at = 0
            while at < len(q):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS_AT_ONCE, "right")))
                m = n[at:stop]
                x = np.repeat(q[at:stop], m)
                y = own[np.repeat(lo[at:stop] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                good = ids[x] < ids[y]
                x, y = x[good], y[good]
                d = np.bitwise_count(f[x, 0] ^ f[y, 0])
                d += np.bitwise_count(f[x, 1] ^ f[y, 1])
                good = d <= k
                forest.join(x[good], y[good])
                at = stop
    return forest.roots()


_RECORD = [("id", "<i8"), ("f0", "<u8"), ("f1", "<u8"), ("v", "<u2"), ("stored", "u1"), ("r", "i1")]


def _edges(found: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a`` > ``b`` that connect the near copies among distinct fingerprints (``id``, ``f0``, ``f1``)."""
    spark = found.sparkSession
    n = found.count()
    rows = smallest_hashes(found, CORRELATION_ROWS, "id").toArrow().to_pandas()
    order = bit_order(np.ascontiguousarray(rows[["f0", "f1"]].to_numpy(np.int64)).view(np.uint64)) if n else np.arange(BITS)
    shard_bits = min(12, max(1, (max(n, 1) // shard_rows).bit_length()))
    k = min(k, BITS)
    # the thresholds sum to k - PARTS + 1: some spare above their mean, so that they can be unequal
    reach = max(0, min(WIDTH, k - PARTS + 4, max(5, -(-(k - PARTS + 1) // PARTS) + 2)))

    def values_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        f = np.stack([np.asarray(batch.column(1)), np.asarray(batch.column(2))], axis=1).astype(np.int64).view(np.uint64)
        return f, permute(f, order).astype(np.int64)

    def tally(batches):
        hist = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for batch in batches:
            _, v = values_of(batch)
            for i in range(PARTS):
                hist[i] += np.bincount(v[:, i], minlength=1 << WIDTH)
        release()
        at = np.flatnonzero(hist.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist.ravel()[at])], ["at", "n"])

    seen = found.select("id", "f0", "f1").mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # 8 x 65536 rows at most
    hist = np.zeros(PARTS << WIDTH)
    hist[seen["at"]] = seen["n"]
    hist = hist.reshape(PARTS, -1)
    shards = 1 << shard_bits
    near = np.bitwise_count(np.arange(shards)[:, None] ^ np.arange(shards)[None])  # distance of shard numbers
    # blocks of each shard: of the fingerprints it stores, and of those that may probe it (the shards within reach)
    stored = hist.reshape(PARTS, shards, -1).sum(axis=2)
    asking = np.stack([(near <= reach) @ s for s in stored])
    kept_blocks = np.maximum(1, -(-stored // shard_rows)).astype(np.int64)
    ask_blocks = np.maximum(1, -(-asking // (shard_rows << shard_bits.bit_length()))).astype(np.int64)
    counts = spark.sparkContext.broadcast((np.stack([ball_counts(h, reach) for h in hist]).astype(np.float32), kept_blocks, ask_blocks))

    def route(batches):
        balls, kept_in, ask_in = counts.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(lo, 1 << 14)
                f, v = values_of(batch)
                ids = np.asarray(batch.column(0)).astype(np.int64)
                salt = (mix(ids.view(np.uint64) + np.uint64(77)) >> np.uint64(33)).astype(np.int64)
                tau = allocate(v, balls, k).astype(np.int64)
                record = np.zeros(len(ids), _RECORD)
                record["id"], record["f0"], record["f1"] = ids, f[:, 0], f[:, 1]
                groups: dict[int, list[np.ndarray]] = {}
                for i in range(PARTS):
                    home = v[:, i] >> (WIDTH - shard_bits)
                    record["v"], record["r"] = v[:, i], tau[:, i]
                    for s in range(shards):
                        own, reaches = home == s, near[home, s] <= tau[:, i]
                        if not (own | reaches).any():
                            continue
                        for x in range(kept_in[i, s]):
                            for y in range(ask_in[i, s]):
                                here, ask = own & (salt % kept_in[i, s] == x), reaches & (salt % ask_in[i, s] == y)
                                go = here | ask
                                if go.any():
                                    part = record[go]
                                    part["stored"] = here[go]
                                    part["r"] = np.where(ask[go], part["r"], -1)
                                    groups.setdefault(((i * shards + s) * int(kept_in.max()) + x) * int(ask_in.max()) + y, []).append(part)
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array([np.concatenate(g).tobytes() for g in groups.values()], pa.binary())], ["shard", "rows"])
        release()

    def probe(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_buffer(), np.dtype(_RECORD)) for x in table.column("rows")])
        r = r[np.argsort(r["id"])]
        f = np.ascontiguousarray(np.stack([r["f0"], r["f1"]], axis=1))
        root = near_in_shard(r["id"].astype(np.int64), f, r["v"].astype(np.int64), r["stored"] > 0, r["r"].astype(np.int64), k)
        some = np.flatnonzero(root != np.arange(len(root)))
        release()
        return pa.table({"a": pa.array(r["id"][some]), "b": pa.array(r["id"][root[some]])})

    routed = found.select("id", "f0", "f1").mapInArrow(route, "shard long, rows binary")
    return routed.groupBy("shard").applyInArrow(probe, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: every node but the smallest of each component with the smallest (alternating large and small stars)."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: neighbours above a node are hung on the node's smallest neighbour
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, are hung on the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").unionByName(low.select(F.col("a").alias("x"), "m"))
        new = cut(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new
        edges = new


def _roots(docs: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Distinct documents (``doc_id``, ``f0``, ``f1``, ``f``); the fingerprints (``f``, ``n`` documents, first ``doc_id`` of the group, whether it is the first fingerprint); the number of documents."""
    table = cut(fingerprint_table(docs).distinct().withColumn("f", F.struct("f0", "f1")))
    # a number for each fingerprint, in order of its smallest document
    first = table.groupBy("f").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    found = cut(first.repartitionByRange("first", "f").sortWithinPartitions("first", "f").select(F.monotonically_increasing_id().alias("id"), "f", "f.f0", "f.f1", "first", "n"))
    up = components(_edges(found, k, shard_rows))
    roots = up.join(found.select(F.col("id").alias("b"), F.col("first").alias("duplicate_of")), "b").select(F.col("a").alias("id"), "duplicate_of")
    named = found.join(roots, "id", "left").select("f", "n", F.coalesce("duplicate_of", "first").alias("duplicate_of"), F.col("duplicate_of").isNull().alias("is_first"), "first")
    return table, named, table.count()


def near_duplicates(docs: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each document that is not the first of its group: ``doc_id``, ``duplicate_of`` (the smallest id of the group).

    A document whose id is that of its group's first, with another text, has ``duplicate_of`` equal to its own id.
    """
    table, named, total = _roots(docs, k, shard_rows)
    both = join_one(table.select("doc_id", "f"), cut(named.select("f", "n", "duplicate_of", "is_first")), "f", "n", total)
    return both.where("doc_id <> duplicate_of OR NOT is_first").select("doc_id", "duplicate_of")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the texts of ``gone`` (``doc_id``, number of ``texts`` and of those ``lost``, their fingerprints ``f``)."""
    key, lost, f0, f1 = fresh(docs.columns, "gone", "lost", "f0", "f1")
    same = docs["doc_id"].cast("long") == F.col(key)
    kept = docs.join(gone.where("lost = texts").select(F.col("doc_id").alias(key)), same, "left_anti")
    part = gone.where("lost < texts").select(F.col("doc_id").alias(key), F.col("f").alias(lost))
    if part.isEmpty():
        return kept
    # an id that keeps one of its texts and loses another: by the fingerprints of its rows
    theirs = kept.join(part, same)

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        f, ok = fingerprints(texts)
        words = [pa.array(f[:, w].view(np.int64), mask=~ok) for w in (0, 1)]
        return pa.RecordBatch.from_arrays([*rows.columns, *words], [*rows.schema.names, f0, f1])

    schema = theirs.select("*", F.lit(None).cast("long").alias(f0), F.lit(None).cast("long").alias(f1)).schema
    judged = map_texts(theirs, fn, schema)
    stays = F.col(f0).isNull() | ~F.exists(lost, lambda x: (x["f0"] == F.col(f0)) & (x["f1"] == F.col(f1)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.join(part, same, "left_anti").unionByName(judged.where(stays).select(*columns))


def stage(docs: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One document of each group, all columns unchanged; rows with a null id or text stay.

    Decided by id and fingerprint: of rows that share an id, those with another text are judged by their own.
    """
    table, named, total = _roots(docs, k, shard_rows)
    both = join_one(table.select("doc_id", "f"), cut(named.select("f", "n", "duplicate_of", "is_first")), "f", "n", total)
    gone = both.groupBy("doc_id").agg(
        F.count("*").alias("texts"),
        F.count_if((F.col("doc_id") != F.col("duplicate_of")) | ~F.col("is_first")).alias("lost"),
        F.collect_set(F.when((F.col("doc_id") != F.col("duplicate_of")) | ~F.col("is_first"), F.col("f"))).alias("f"),
    ).where("lost > 0")
    return _without(docs, cut(gone))
