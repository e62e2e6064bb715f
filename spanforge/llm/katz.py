"""Operator 10, LM scoring: a Katz backoff model of the corpus, applied to each of its documents.

The model has every word and every n-gram of up to ``order`` words of *all*
documents (words and punctuation runs, lower case, behind start marks), told
apart by 64-bit hashes; none is pooled or pruned.  Counts r of up to ``K`` are
discounted by Good-Turing, and what a context loses goes to the words unseen after
it, with a backoff weight that normalises it exactly:

    P(w | u v) = scale(u v) d(r) r / c(u v)      if r = c(u v, w) > 0
               = bow(u v) P(w | v)               otherwise,  P(w) = c(w) / N

Where Good-Turing has no valid discount (counts too sparse), (r - 1/2) / r is used.
A context that kept all its mass gives up 1 / (c + 1) of it; one that every word of
the corpus follows has nobody to give to and is scaled up to 1.

``fit`` writes the model as tables partitioned by order (probabilities of n-grams,
backoff weights of contexts) and ``Model.score`` evaluates it per token by
recursion, for any texts.  A word that the corpus doesn't have is counted as
unknown and left out of the log probability.

``score`` does the same for the corpus itself (or ``others``) without a row for each
n-gram.  N-grams are dealt out by the shortest suffix of their context that is not
hot (too frequent for a bucket), so a bucket has all counts of the longer contexts,
at all orders.  A first shuffle counts.  N-grams of hot contexts, and single words,
are in several buckets: owners add them up by word and send the totals back.  That
gives the discounts of each order and the weights of hot contexts.  A second shuffle
sends the n-grams with the documents they occur in; a bucket makes its model of all
orders with backoff weights, evaluates it by recursion and returns sums by document.
A document of the corpus has no unseen n-gram, so its recursion ends at the highest
order; those of ``others`` go on.  What is broadcast is bounded by tokens / ``bucket_tokens``.

Cases: ``doc_id`` is an integer of up to 64 bits.  A null text or one without words
has 0 tokens, log probability 0 and null perplexity.  Repeated rows count and score
as often as they occur; null ids are scored.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytescan import Tokens, mix
from spanforge.llm.common import cut, join_one, pieces, release
from spanforge.storage import drop_path, fresh_path, written

K = 5
START = 1
ORDER = 3
#: tokens in a bucket of ``score``, about
BUCKET_TOKENS = 3_000_000
#: characters tokenised, and tokens counted, at a time in a task
SLICE, BULK = 4 << 20, 3_000_000
#: tokens of ``BULK`` from which a context may be hot
OFTEN = 8
#: parts of a bucket, worked on one after the other
PARTS = 2
_CODEC = "zstd"


def squeeze(a: np.ndarray) -> bytes:
    """An array of integers or floats as compressed byte planes."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b"")


def stretch(raw: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec=_CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def in_bulk(rows: Iterable[tuple[np.ndarray, ...]], bulk: int = BULK) -> Iterator[list[np.ndarray]]:
    """Columns joined to about ``bulk`` rows each: what is counted together is sent once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= bulk:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0)) if len(keys) else keys


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """Factors for counts 0 .. k + 1 from the numbers of bigrams that occur 0, 1, .. times (Katz's Good-Turing)."""
    d = np.ones(k + 2)
    d[0] = 0
    n = n.astype(float)
    a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        x = (star / r - a) / (1 - a) if a < 1 else -1.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def before(tokens: Tokens, order: int) -> list[np.ndarray]:
    """The words of each token's n-gram: the token, then the ``order - 1`` before it; start marks before the first."""
    at = np.arange(len(tokens.hash)) - np.repeat(tokens.first, tokens.count)
    out = [tokens.hash]
    for j in range(1, order):
        word = np.full(len(at), START, np.uint64)
        word[j:] = np.where(at[j:] >= j, tokens.hash[:-j], np.uint64(START))
        out.append(word)
    return out


def suffixes(words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the contexts of 0, 1, .. words of each n-gram; that of no words is 0."""
    out = [np.zeros(len(words[0]), np.uint64)]
    for j, word in enumerate(words[1:], 1):
        out.append(mix(mix(out[-1] + np.uint64(j)) + word))
    return out


def contexts(tokens: Tokens, order: int) -> np.ndarray:
    """Hash of the ``order - 1`` words before each token."""
    return suffixes(before(tokens, order))[-1]


def gram_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(ctx ^ mix(word + np.uint64(5)))


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for a in sorted_keys:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _among(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would stand, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with a place of each, and the number of each key among them."""
    by = np.argsort(keys)
    sorted_ = keys[by]
    first = _runs(sorted_)
    own = np.empty(len(keys), np.int32)
    own[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(keys))))
    return sorted_[first], by[first], own


class Hot:
    """Contexts too frequent for one bucket (and the empty one, number 0): ``ctx`` (sorted), number of words, number of the context one word shorter."""

    def __init__(self, ctx: np.ndarray, level: np.ndarray, parent: np.ndarray):
        by = np.argsort(ctx)
        self.ctx, self.level = ctx[by], level[by]
        self.parent = np.searchsorted(self.ctx, parent[by])

    def number(self, ctx: np.ndarray) -> np.ndarray:
        """Its number, or -1."""
        at, ok = _among(self.ctx, ctx)
        return np.where(ok, at, -1).astype(np.int32)

    def place(self, ctx: list[np.ndarray], gram: np.ndarray) -> np.ndarray:
        """What each n-gram is dealt out by: its shortest context that is not hot, or itself."""
        key = gram
        for c in ctx[:0:-1]:
            key = np.where(self.number(c) < 0, c, key)
        return key


def find_hot(docs: DataFrame, order: int, bucket_tokens: int) -> tuple[Hot, int]:
    """The contexts that an eighth of a bucket's tokens have: at most 8 x tokens / ``bucket_tokens`` of each order; and the number of tokens.

    They only decide where n-grams are counted.  A context counts where ``OFTEN`` of ``BULK`` tokens have it, so what is missed
    of one is less than three tokens in a million.
    """

    def by_context(batches):
        def of():
            for batch in batches:
                for _, texts in pieces(batch, "text", SLICE):
                    yield tuple(suffixes(before(Tokens(texts), order)))[1:]

        for some in in_bulk(of()):
            out = [(np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([len(some[0])]), 0)]
            for m in range(1, order):
                cell = (some[m - 1] >> np.uint64(42)).astype(np.int64)
                at = np.flatnonzero((np.bincount(cell) >= OFTEN)[cell])  # the others can't be so frequent
                ctx, first, n = np.unique(some[m - 1][at], return_index=True, return_counts=True)
                first, n, ctx = at[first[n >= OFTEN]], n[n >= OFTEN], ctx[n >= OFTEN]
                out.append((ctx, some[m - 2][first] if m > 1 else np.zeros(len(first), np.uint64), n, m))
            for ctx, parent, n, m in out:
                yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(parent.view(np.int64)), pa.array(n), pa.array(np.full(len(n), m))], ["ctx", "parent", "n", "level"])
        release()

    least = max(bucket_tokens // 8, OFTEN)
    n = docs.select("text").mapInArrow(by_context, "ctx long, parent long, n long, level long").groupBy("ctx", "parent", "level").agg(F.sum("n").alias("n"))
    found = n.where((F.col("n") >= least) | (F.col("level") == 0)).toArrow().to_pandas()
    total = int(found["n"][found["level"] == 0].sum())
    found = found[found["level"] > 0]
    ctx, level, parent = (found[c].to_numpy(np.int64) for c in ("ctx", "level", "parent"))
    none = np.zeros(1, np.uint64)
    return Hot(np.append(none, ctx.view(np.uint64)), np.append(0, level), np.append(none, parent.view(np.uint64))), total


class Grams:
    """The n-grams of a bucket at one order, sorted by ``gram``: with their counts ``r`` in this bucket, and the row of each in the order below (``down``)."""

    def __init__(self, gram: np.ndarray, ctx: np.ndarray, word: np.ndarray, r: np.ndarray, hot: np.ndarray):
        self.gram, self.ctx, self.word, self.r, self.hot, self.down = gram, ctx, word, r, hot, None


def all_orders(words: list[np.ndarray], times: np.ndarray, hot: Hot) -> tuple[list[Grams], np.ndarray]:
    """What a bucket was sent, counted at all orders (the lowest first), and the n-gram of the highest order of each row."""
    gram, first, own = distinct(gram_key(suffixes(words)[-1], words[0]))
    words = [w[first] for w in words]
    ctx, word, r = suffixes(words), words[0], np.bincount(own, times, len(gram)).astype(np.int64)
    levels = [Grams(gram, ctx[-1], word, r, hot.number(ctx[-1]))]
    for m in range(len(words) - 2, -1, -1):
        gram, first, down = distinct(gram_key(ctx[m], word))
        levels[0].down = down
        ctx, word, r = [c[first] for c in ctx[: m + 1]], word[first], np.bincount(down, r, len(gram)).astype(np.int64)
        levels.insert(0, Grams(gram, ctx[m], word, r, hot.number(ctx[m])))
    return levels, own


def shared_rows(levels: list[Grams], owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of hot contexts, which other buckets have too: order and row of each, by owner and word; and the owners' borders."""
    level = np.concatenate([np.full((g.hot >= 0).sum(), m) for m, g in enumerate(levels)])
    row = np.concatenate([np.flatnonzero(g.hot >= 0) for g in levels])
    word = np.concatenate([g.word[g.hot >= 0] for g in levels])
    owner = (word % np.uint64(owners)).astype(np.int64)
    by = np.lexsort((word, owner))
    return level[by], row[by], word[by], np.searchsorted(owner[by], np.arange(owners + 1))


class Rates:
    """What scoring needs of the whole corpus: discounts of each order; of each hot context its count, scale and backoff weight."""

    def __init__(self, hot: Hot, low: np.ndarray, k: int, c: np.ndarray, follow: np.ndarray, least: np.ndarray, mass: np.ndarray, below: np.ndarray):
        """``mass``, ``below``: the counts of its n-grams, and of those without their first word, by their kind."""
        self.k, self.vocabulary, self.c = k, follow[0], c
        self.d = np.array([np.minimum(np.arange(k + 2), 1.0), *(discounts(x[: k + 2], k) for x in low[1:])])
        self.scale, self.bow = np.ones(len(c)), np.ones(len(c))
        for i in np.argsort(hot.level, kind="stable")[1:]:
            m, up = hot.level[i], hot.parent[i]
            q = self.scale[up] * (self.d[m - 1] @ below[i]) / max(c[up], 1)
            self.scale[i], self.bow[i] = (x[0] for x in self.shares(*(np.array([x]) for x in (c[i], follow[i], least[i], self.d[m] @ mass[i], q))))

    def shares(self, c: np.ndarray, follow: np.ndarray, least: np.ndarray, mass: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scale and backoff weight of contexts of discounted mass ``mass`` whose words have ``q`` at the order below."""
        none = follow == self.vocabulary
        with np.errstate(divide="ignore", invalid="ignore"):
            # a context of frequent n-grams alone loses nothing: its mass is exactly its count
            scale = np.where(none, c / mass, np.where(least > self.k, c / (c + 1), 1.0))
            return scale, np.where(none, 0.0, (1 - scale * mass / c) / (1 - q))


class Backoff:
    """The model of a bucket: for each order the probability of each n-gram seen, and the backoff weight of each context."""

    def __init__(self, levels: list[Grams], hot: Hot, rates: Rates):
        """``levels``: n-grams with their counts in the whole corpus; of those that are only asked for, 0."""
        self.grams, self.p, self.ctx, self.bow = [], [], [], []
        p = np.zeros(0)
        for m, g in enumerate(levels):
            r = g.r
            mass = rates.d[m][np.minimum(r, rates.k + 1)] * r
            own = (g.hot < 0) & (r > 0)
            ctx, _, at = distinct(g.ctx[own])
            c, scale = rates.c[g.hot].astype(float), rates.scale[g.hot]
            if len(ctx):
                least = np.full(len(ctx), np.iinfo(np.int64).max)
                np.minimum.at(least, at, r[own])
                whole = np.bincount(at, r[own])
                some, bow = rates.shares(whole, np.bincount(at), least, np.bincount(at, mass[own]), np.bincount(at, p[g.down[own]]))
                c[own], scale[own] = whole[at], some[at]
            else:
                bow = np.zeros(0)
            p = np.where(r > 0, scale * mass / np.maximum(c, 1), 0.0)
            self.grams.append(g.gram[r > 0])
            self.p.append(p[r > 0])
            ctx, bow = np.append(ctx, hot.ctx[hot.level == m]), np.append(bow, rates.bow[hot.level == m])
            by = np.argsort(ctx)
            self.ctx.append(ctx[by])
            self.bow.append(bow[by])

    def logp(self, levels: list[Grams]) -> np.ndarray:
        """Log probability of the n-grams of the highest order, by recursion; of unknown words, nan."""

        def below(m: int, rows: np.ndarray) -> np.ndarray:
            g = levels[m]
            at, seen = _among(self.grams[m], g.gram[rows])
            out = np.full(len(rows), np.nan)
            out[seen] = np.log(self.p[m][at[seen]])
            if m and not seen.all():
                left = rows[~seen]
                at, known = _among(self.ctx[m], g.ctx[left])
                weight = np.ones(len(left))  # of a context that never occurs
                weight[known] = self.bow[m][at[known]]
                with np.errstate(divide="ignore"):
                    out[~seen] = np.log(weight) + below(m - 1, g.down[left])
            return out

        return below(len(levels) - 1, np.arange(len(levels[-1].gram)))


def packed(words: list[np.ndarray], counts: np.ndarray, doc: np.ndarray | None, hot: Hot, buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each bucket its n-grams, once: their words (by number), how many of them count; and with ``doc``, where they occur."""
    ctx = suffixes(words)
    gram = gram_key(ctx[-1], words[0])
    where = ((hot.place(ctx, gram) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    # by bucket and about by context: equal n-grams stand together but for collisions, which only cost a row
    bits = buckets.bit_length()
    half = (64 - bits) // 2
    key = where.astype(np.uint64) << np.uint64(64 - bits) | ctx[1] >> np.uint64(64 - half) << np.uint64(64 - bits - half) | gram >> np.uint64(bits + half)
    del ctx, gram
    by = np.argsort(key)
    first = _runs(*(w[by] for w in words), where[by])
    del key
    kinds, _, number = distinct(np.append(words[0], np.uint64(START)))
    start, numbers = number[-1], [number[:-1]]
    for j in range(1, len(words)):
        w = np.full(len(by), start, np.int32)
        w[j:] = np.where(words[j][j:] == START, start, numbers[0][:-j])
        numbers.append(w)
    head = [w[by[first]] for w in numbers]
    end = np.append(first, len(by))
    times = np.diff(end)
    weight = np.add.reduceat(counts[by], first, dtype=np.int64) if len(first) else times
    border = np.searchsorted(where[by[first]], np.arange(buckets + 1))
    if doc is not None:
        doc = doc[by]
    mark, rank = np.zeros(len(kinds), bool), np.zeros(len(kinds), np.int32)
    for b in range(buckets):
        lo, hi = border[b], border[b + 1]
        if lo < hi:
            own = np.concatenate([w[lo:hi] for w in head])
            if 10 * len(own) > len(kinds):
                mark[own] = True
                used = np.flatnonzero(mark)
                mark[used] = False
                rank[used] = np.arange(len(used), dtype=np.int32)
                own = rank[own]
            else:
                used, own = np.unique(own, return_inverse=True)
            small = np.uint16 if len(used) < 1 << 16 else np.uint32
            blobs = [squeeze(gaps(kinds[used])), bytes([small().itemsize]), squeeze(weight[lo:hi].astype(np.uint32)), *(squeeze(x) for x in own.astype(small).reshape(len(words), -1))]
            yield b, blobs if doc is None else [*blobs, squeeze(times[lo:hi].astype(np.uint32)), squeeze(doc[end[lo] : end[hi]])]


def score(docs: DataFrame, order: int = ORDER, k: int = K, bucket_tokens: int = BUCKET_TOKENS, others: DataFrame | None = None) -> DataFrame:
    """Every document, or every row of ``others``: ``doc_id``, ``n_tokens``, ``logprob`` and ``perplexity`` (6 significant digits)."""
    if order < 2:
        raise ValueError("a context has a word at least")
    spark = docs.sparkSession
    counted = F.lit(1).alias("counted")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", counted)
    found, total = find_hot(docs, order, max(bucket_tokens // (order - 1), 1))
    hot = spark.sparkContext.broadcast(found)
    buckets = max(8, -(-total * (order - 1) // bucket_tokens))  # as it has the n-grams of each order above the first
    owners = max(8, buckets // 8)
    if others is not None:  # they are sent too, but don't count
        docs = docs.unionByName(others.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("counted")))
    scored = 1 if others is None else 0
    names = ["bucket", "batch", "blobs"]
    row = "bucket int, batch long, blobs array<binary>"

    def rows_of(bucket: list, batch: list, blobs: list) -> list[pa.Array]:
        return [pa.array(bucket, pa.int32()), pa.array(batch, pa.int64()), pa.array(blobs, pa.list_(pa.binary()))]

    def ask_counts(batches):
        def of():
            for batch in batches:
                for rows, texts in pieces(batch, "text", SLICE):
                    tokens = Tokens(texts)
                    yield *before(tokens, order), np.array(rows.column(2), np.uint8)[tokens.doc]

        for *words, counts in in_bulk(of(), BULK // 2):
            at, blobs = [], []
            for b, x in packed(words, counts, None, hot.value, buckets):
                at.append(b)
                blobs.append(x)
            yield pa.RecordBatch.from_arrays(rows_of(at, [None] * len(at), blobs), names)
        release()

    def ask_scores(batches):
        part, docs_before, heads = TaskContext.get().partitionId(), 0, []

        def of():
            nonlocal docs_before
            for batch in batches:
                for rows, texts in pieces(batch, "text", SLICE):
                    tokens = Tokens(texts)
                    ids, counts = rows.column(0), np.array(rows.column(2), np.uint8)
                    heads.append((np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64), np.where(np.array(ids.is_valid()), tokens.count, -1 - tokens.count).astype(np.int64), counts))
                    doc = (tokens.doc + docs_before).astype(np.uint32)
                    docs_before += len(texts)
                    yield *before(tokens, order), counts[tokens.doc], doc

        for number, (*words, counts, doc) in enumerate(in_bulk(of(), BULK // 2)):
            here = part << 32 | number
            # the rows themselves, for the last step: ids, numbers of tokens, and which of them count
            at, blobs = [-1 - (here % 1024)], [[squeeze(np.concatenate(c)) for c in zip(*heads)]]
            docs_before = 0
            heads.clear()
            for b, x in packed(words, counts, doc, hot.value, buckets):
                at.append(b)
                blobs.append(x)
            yield pa.RecordBatch.from_arrays(rows_of(at, [here] * len(at), blobs), names)
        release()

    def sent(blobs: list) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """The rows of each part of a bucket: their places, words and weights."""
        parts = [([], [], []) for _ in range(PARTS)]
        lo = 0
        for x in blobs:
            kind = np.cumsum(stretch(x[0], np.uint64), dtype=np.uint64)
            words = [kind[stretch(x[3 + j], np.uint16 if x[1][0] == 2 else np.uint32)] for j in range(order)]
            weight = stretch(x[2], np.uint32)
            ctx = suffixes(words)
            part = (hot.value.place(ctx, gram_key(ctx[-1], words[0])) & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS) >> np.uint64(32)
            for i, (rows, held, weights) in enumerate(parts):
                at = np.flatnonzero(part == i)
                rows.append((at + lo).astype(np.uint32))
                held.append([w[at] for w in words])
                weights.append(weight[at])
            lo += len(weight)
        for i in range(PARTS):
            rows, held, weights = parts[i]
            parts[i] = None
            part = [np.concatenate(rows), [np.concatenate(w) for w in zip(*held)], np.concatenate(weights)]
            del rows, held, weights
            release()
            yield part.pop(0), part.pop(0), part.pop(0)

    width = k + 2  # counts 0 .. k, and k + 1 for all above

    def low_of(levels: np.ndarray, r: np.ndarray) -> list:
        """Numbers of n-grams by order and count."""
        return np.bincount(levels * (k + 3) + np.minimum(r, k + 2), minlength=order * (k + 3)).tolist()

    def count(asked: pa.Table) -> pa.Table:
        b = asked.column("bucket")[0].as_py()
        out, to, of, low = [], [], [], np.zeros(order * (k + 3), np.int64)
        for part, (_, words, weight) in enumerate(sent(asked.column("blobs").to_pylist())):
            levels, _ = all_orders(words, weight, hot.value)
            level, at, word, border = shared_rows(levels, owners)
            number, r = np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
            for m, g in enumerate(levels):
                on = level == m
                number[on], r[on] = g.hot[at[on]], g.r[at[on]]
                low += low_of(np.full((g.hot < 0).sum(), m), g.r[g.hot < 0])
            out += [[squeeze(number[lo:hi]), squeeze(gaps(word[lo:hi])), squeeze(r[lo:hi])] for lo, hi in zip(border[:-1], border[1:])]
            to += range(owners)
            of += [b * PARTS + part] * owners
            del words, weight, levels, g, level, at, word, number, r, on
        release()
        return pa.table([*rows_of([*to, None], [*of, None], [*out, None]), pa.array([None] * len(out) + [low.tolist()], pa.list_(pa.int64()))], [*names, "low"])

    def add_up(table: pa.Table) -> pa.Table:
        """The owner of some words: counts of their n-grams after hot contexts, for the buckets that have them; and of each of these contexts a part of its sums."""
        own = table.column("bucket")[0].as_py()
        blobs = [x.as_py() for x in table.column("blobs")]
        number = np.concatenate([stretch(x[0], np.uint32) for x in blobs]).astype(np.int64)
        word = np.concatenate([np.cumsum(stretch(x[1], np.uint64), dtype=np.uint64) for x in blobs])
        r = np.concatenate([stretch(x[2], np.int64) for x in blobs])
        gram, first, which = distinct(gram_key(hot.value.ctx[number], word))
        whole = np.bincount(which, r, len(gram)).astype(np.int64)
        size = np.cumsum([int.from_bytes(x[0][:8], "little") // 4 for x in blobs])
        answers = [[squeeze(x)] for x in np.split(whole[which], size[:-1])]
        # what these n-grams have at the order below is here too: it ends in the same word
        number, word = number[first], word[first]
        up = hot.value.parent[number]
        lower = np.where(hot.value.level[number] > 0, whole[np.minimum(np.searchsorted(gram, gram_key(hot.value.ctx[up], word)), len(gram) - 1)], 0)
        low = low_of(hot.value.level[number], whole)
        number, whole, lower = (x[whole > 0] for x in (number, whole, lower))
        at, number = np.unique(number, return_inverse=True)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, number, whole)
        mass, below = (np.bincount(number * width + np.minimum(x, k + 1), x, len(at) * width).reshape(-1, width).astype(np.int64) for x in (whole, lower))
        sums = np.column_stack((np.bincount(number, minlength=len(at)), mass, below))
        n, more = len(answers), len(at) + 1
        asked = table.column("batch").to_pylist()
        columns = rows_of([x // PARTS for x in asked] + [None] * more, [own * PARTS + x % PARTS for x in asked] + [None, *at.tolist()], [*answers, *[None] * more])
        return pa.table([*columns, pa.array([None] * n + [low] + [None] * len(at), pa.list_(pa.int64())), pa.array([None] * (n + 1) + least.tolist(), pa.int64()), pa.array([None] * (n + 1) + sums.tolist(), pa.list_(pa.int64()))], [*names, "low", "least", "sums"])

    # first the counts: of the n-grams by order, and of those of hot contexts
    path = fresh_path(spark, "counts")
    docs.mapInArrow(ask_counts, row).groupBy("bucket").applyInArrow(count, f"{row}, low array<long>").write.parquet(path)
    parts = spark.read.schema(f"{row}, low array<long>").parquet(path)
    sums = written(parts.where("bucket IS NOT NULL").select(*names).groupBy("bucket").applyInArrow(add_up, f"{row}, low array<long>, least long, sums array<long>"), "sums")
    low = np.zeros((order, k + 3), np.int64)
    for table in (parts, sums):
        each = [F.coalesce(F.sum(F.col("low")[i]), F.lit(0)) for i in range(order * (k + 3))]
        low += np.array(table.where("low IS NOT NULL").agg(*each).first(), np.int64).reshape(order, -1)
    drop_path(spark, path)
    n = len(hot.value.ctx)
    least, follow, split = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros((n, 2, width), np.int64)
    for x in sums.where("least IS NOT NULL").groupBy("batch").agg(F.min("least"), *(F.sum(F.col("sums")[i]) for i in range(1 + 2 * width))).collect():  # a row for each hot context
        least[x[0]], follow[x[0]], split[x[0]] = x[1], x[2], np.array(x[3:]).reshape(2, width)
    rates = spark.sparkContext.broadcast(Rates(hot.value, low, k, split[:, 0].sum(axis=1), follow, least, split[:, 0], split[:, 1]))

    def answer(asked: pa.Table) -> pa.Table:
        """A bucket makes the model of its contexts and evaluates it for the rows it was sent."""
        b = asked.column("bucket")[0].as_py()
        if b < 0:
            return asked
        pairs = list(zip(asked.column("batch").to_pylist(), asked.column("blobs").to_pylist()))
        del asked
        by_owner = sorted(x for x in pairs if len(x[1]) == 1)  # counts from the owners
        pairs = [x for x in pairs if len(x[1]) > 1]
        blobs = [x for _, x in pairs]
        logp = np.empty(sum(int.from_bytes(x[2][:8], "little") // 4 for x in blobs))
        for part, (rows, words, weight) in enumerate(sent(blobs)):
            levels, own = all_orders(words, weight, hot.value)
            level, at, _, _ = shared_rows(levels, owners)
            found = np.concatenate([stretch(x[0], np.int64) for i, x in by_owner if i % PARTS == part])
            if len(found) != len(at):
                raise RuntimeError("the documents changed between the counts and the scores")
            for m in range(order):
                levels[m].r[at[level == m]] = found[level == m]
            logp[rows] = Backoff(levels, hot.value, rates.value).logp(levels)[own]
            del rows, words, weight, levels, own, level, at, found
        out, lo = [], 0
        for x in blobs:
            times, doc = stretch(x[3 + order], np.uint32), stretch(x[4 + order], np.uint32)
            mine = np.repeat(logp[lo : lo + len(times)], times)
            lo += len(times)
            unknown = np.isnan(mine)
            some = np.unique(doc)
            out.append([squeeze(some), squeeze(np.bincount(doc, np.where(unknown, 0.0, mine))[some]), squeeze(np.bincount(doc, unknown)[some].astype(np.uint32))])
        release()
        return pa.table(rows_of([b] * len(out), [x for x, _ in pairs], out), names)

    answers = docs.mapInArrow(ask_scores, row).unionByName(sums.where("blobs IS NOT NULL").select(*names)).groupBy("bucket").applyInArrow(answer, row)

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["bucket", "blobs"]).to_pylist(), key=lambda x: x["bucket"])
        ids, n, counts = (stretch(raw, kind) for raw, kind in zip(rows[0]["blobs"], (np.int64, np.int64, np.uint8)))
        value, unknown = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for x in rows[1:]:
            some, sums_, left_out = (stretch(raw, kind) for raw, kind in zip(x["blobs"], (np.uint32, np.float64, np.uint32)))
            value[some] += sums_
            unknown[some] += left_out
        null = n < 0
        n = np.where(null, -1 - n, n)
        with np.errstate(over="ignore"):
            perplexity = np.exp(-value / np.maximum(n - unknown, 1))
        sig = lambda a: np.array([float(f"{v:.6g}") for v in a.tolist()], float)
        out = pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "n_tokens": pa.array(n), "logprob": pa.array(sig(value)), "perplexity": pa.array(sig(perplexity), mask=n == unknown)})
        return out.filter(pa.array(counts == scored))

    return answers.groupBy("batch").applyInArrow(gather, "doc_id long, n_tokens long, logprob double, perplexity double")


class Model:
    """A Katz model in the shared folder: for each order, probabilities of its n-grams and backoff weights of its contexts."""

    def __init__(self, grams: list[DataFrame], backoff: list[DataFrame]):
        self.grams, self.backoff, self.order = grams, backoff, len(grams)

    def score(self, texts: DataFrame) -> DataFrame:
        """Every row of ``texts``: ``doc_id``, ``n_tokens``, ``n_unknown``, ``logprob`` and ``perplexity`` (6 significant digits)."""
        order = self.order
        docs = cut(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()))
        keys = [f"c{m}" for m in range(1, order)]

        def run(batches):
            for batch in batches:
                for rows, some in pieces(batch, "text", SLICE):
                    tokens = Tokens(some)
                    row = np.array(rows.column(0))[tokens.doc]
                    ctx = [contexts(tokens, m + 1) for m in range(1, order)]
                    by = np.lexsort((tokens.hash, ctx[-1], row))
                    first = _runs(row[by], ctx[-1][by], tokens.hash[by])
                    at = by[first]
                    n = np.diff(np.append(first, len(by)))
                    yield pa.RecordBatch.from_arrays([pa.array(row[at]), *(pa.array(c[at].view(np.int64)) for c in ctx), pa.array(tokens.hash[at].view(np.int64)), pa.array(n)], ["row", *keys, "word", "n"])

        asked = cut(docs.select("row", "text").mapInArrow(run, f"row long, {', '.join(f'{c} long' for c in keys)}, word long, n long"))
        grams = asked.groupBy(*keys, "word").agg(F.count("*").alias("rows"))
        for m in range(order - 1, -1, -1):
            on = ["word"] if m == 0 else [f"c{m}", "word"]
            p = self.grams[m].select(*([F.col("ctx").alias(f"c{m}")] if m else []), "word", F.col("p").alias(f"p{m}"))
            grams = grams.join(p, on, "left")
            if m:
                grams = grams.join(self.backoff[m].select(F.col("ctx").alias(f"c{m}"), F.col("bow").alias(f"b{m}")), f"c{m}", "left")
        # from the lowest order up: the n-gram's own probability, or the weight of its context times that of the order below
        logp = reduce(lambda below, m: F.when(F.col(f"p{m}").isNotNull(), F.ln(f"p{m}")).otherwise(F.ln(F.coalesce(f"b{m}", F.lit(1.0))) + below), range(1, order), F.ln("p0"))
        known = cut(grams.select(F.struct(f"c{order - 1}", "word").alias("gram"), "rows", logp.alias("logp")))
        each = join_one(asked.select("row", "n", F.struct(f"c{order - 1}", "word").alias("gram")), known, "gram", "rows", asked.count())
        total = each.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("logp").isNull(), F.col("n")).otherwise(0)).alias("unknown"), F.sum(F.col("n") * F.coalesce("logp", F.lit(0.0))).alias("value"))
        none = F.lit(0).cast("long")
        sig = lambda c: F.format_string("%.5e", c).cast("double")
        out = docs.select("row", "doc_id").join(total, "row", "left").select("doc_id", F.coalesce("n", none).alias("n_tokens"), F.coalesce("unknown", none).alias("n_unknown"), F.coalesce("value", F.lit(0.0)).alias("value"))
        left = F.col("n_tokens") - F.col("n_unknown")
        return out.select("doc_id", "n_tokens", "n_unknown", sig("value").alias("logprob"), F.when(left > 0, sig(F.exp(-F.col("value") / left))).alias("perplexity"))


def fit(docs: DataFrame, order: int = ORDER, k: int = K) -> Model:
    """Count, discount and normalise all orders up to ``order`` into tables of the shared folder."""
    if order < 2:
        raise ValueError("a context has a word at least")
    spark = docs.sparkSession

    def count(batches):
        for batch in batches:
            for _, texts in pieces(batch, "text", SLICE):
                tokens = Tokens(texts)
                below = np.zeros(len(tokens.hash), np.uint64)
                for m in range(order):
                    ctx = contexts(tokens, m + 1) if m else below
                    by = np.lexsort((tokens.hash, ctx))
                    first = _runs(ctx[by], tokens.hash[by])
                    at, n = by[first], np.diff(np.append(first, len(by)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, np.int32)), *(pa.array(x[at].view(np.int64)) for x in (ctx, below, tokens.hash)), pa.array(n)], ["order", "ctx", "below", "word", "n"])
                    below = ctx

    path = fresh_path(spark, "model")
    counted = docs.select("text").mapInArrow(count, "order int, ctx long, below long, word long, n long").groupBy("order", "ctx", "below", "word").agg(F.sum("n").alias("n"))
    counted.write.partitionBy("order").parquet(f"{path}/counts")
    counts = spark.read.schema("ctx long, below long, word long, n long, order int").parquet(f"{path}/counts")
    low = np.zeros((order, k + 3))
    for r in counts.groupBy("order", F.least("n", F.lit(k + 2)).alias("n")).count().collect():  # k + 2 rows an order
        low[r["order"], r["n"]] = r["count"]
    words, total = counts.where(F.col("order") == 0).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    counts.where(F.col("order") == 0).select("ctx", "word", (F.col("n") / total).alias("p")).write.parquet(f"{path}/grams/order=0")
    grams = [spark.read.schema("ctx long, word long, p double").parquet(f"{path}/grams/order=0")]
    backoff: list[DataFrame | None] = [None]
    for m in range(1, order):
        d = discounts(low[m][: k + 2], k)
        factor = reduce(lambda rest, r: F.when(F.col("n") == r, float(d[r])).otherwise(rest), range(1, k + 1), F.lit(1.0))
        own = counts.where(F.col("order") == m)
        lower = grams[m - 1].select(F.col("ctx").alias("below"), "word", F.col("p").alias("q"))
        # the n-gram without its first word was seen too, so its probability is in the table below
        seen = own.join(lower, ["below", "word"]).groupBy("ctx").agg(F.sum("n").alias("c"), F.min("n").alias("least"), F.count("*").alias("follow"), F.sum(factor * F.col("n")).alias("mass"), F.sum("q").alias("q"))
        none = F.col("follow") == words
        # a context of frequent n-grams alone loses nothing: its mass is exactly its count
        scale = F.when(none, F.col("c") / F.col("mass")).when(F.col("least") > k, F.col("c") / (F.col("c") + 1)).otherwise(1.0)
        whole = seen.select("ctx", "c", "follow", scale.alias("scale"), F.when(none, 0.0).otherwise((1 - scale * F.col("mass") / F.col("c")) / (1 - F.col("q"))).alias("bow"))
        whole.write.parquet(f"{path}/contexts/order={m}")
        backoff.append(spark.read.schema("ctx long, c long, follow long, scale double, bow double").parquet(f"{path}/contexts/order={m}"))
        rows = join_one(own.select("ctx", "word", "n"), backoff[m], "ctx", "follow", int(low[m].sum()))
        rows.select("ctx", "word", (F.col("scale") * factor * F.col("n") / F.col("c")).alias("p")).write.parquet(f"{path}/grams/order={m}")
        grams.append(spark.read.schema("ctx long, word long, p double").parquet(f"{path}/grams/order={m}"))
    return Model(grams, backoff)
