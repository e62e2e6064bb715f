"""Operator 8, language ID: a linear-chain conditional random field over the words of a text.

Each word has affix, character n-gram, whole-word and lexicon features, hashed
into one weight table; transitions between the languages of neighbouring words
are learned with them.  Forward-backward gives each word its posterior, so a
text that switches languages is cut into spans.

The model is trained on a bounded sample: ``train_docs`` documents of each
``lang`` (those of the smallest hashes of id and text; all of them, if a language
has no more), whole, spliced into code-switched sequences.  It is then applied to
every word of every document, whole.  Languages are tags: the field has a state
for each, so their number is taken to be small.

Cases: ``doc_id`` is an integer of up to 64 bits; nulls and repeated ids are
trained on and labelled like others.  A text without words (null, empty, symbols alone) has language null,
confidence 0, no spans, and is rejected.  Null ``lang`` rows are not trained on;
without any labelled row each text has language null and is rejected.  Ties
between languages go to the first by name.  Repeated rows get a row each.  An
empty table gives an empty result.  Other columns are ignored, or passed through
by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bytescan import Tokens, mix
from spanforge.llm.common import keep_rows, map_texts, smallest_hashes

#: documents of each language that the field is trained on
TRAIN_DOCS = 200
#: words in a training step
STEP_WORDS = 1 << 17
BITS = 16
#: mean posterior of the document's language under which it is rejected
CONFIDENCE = 0.5
_A = np.uint64(0x9E3779B97F4A7C15)


def word_features(tokens: Tokens, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words ``at``: flat feature ids and the first one of each word."""
    s, e = tokens.start[at], tokens.end[at]
    data = tokens.folded
    n = (e - s).astype(np.int64)
    ids, owner = [], []

    def add(h: np.ndarray, who: np.ndarray, tag: int) -> None:
        ids.append((mix(h * _A + np.uint64(tag)) >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(who)

    every = np.arange(len(at))
    add(tokens.hash[at], every, 1)
    pre, suf = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(1, 5):
        has = n >= k
        w = every[has]
        pre[has] = pre[has] * np.uint64(257) + data[s[has] + k - 1] + np.uint64(1)
        suf[has] = suf[has] * np.uint64(257) + data[e[has] - k] + np.uint64(1)
        add(pre[has], w, 10 + k)
        add(suf[has], w, 20 + k)
    # n-grams inside the word
    flat_owner = np.repeat(every, n)
    inside = np.arange(len(flat_owner)) - np.repeat(np.cumsum(n) - n, n)
    pos = s[flat_owner] + inside
    for k in (2, 3):
        has = inside + k <= n[flat_owner]
        h = np.zeros(int(has.sum()), np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + data[pos[has] + j] + np.uint64(1)
        add(h, flat_owner[has], 30 + k)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], every)


class Model:
    """Weights of the field: ``langs`` sorted, ``weights`` by feature and language, ``trans``, ``first``, and the lexicons."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, first: np.ndarray, lex_hash: np.ndarray, lex_lang: np.ndarray, lex_weight: np.ndarray):
        self.langs, self.weights, self.trans, self.first = langs, weights, trans, first
        self.lex_hash, self.lex_lang, self.lex_weight = lex_hash, lex_lang, lex_weight

    def lexicon(self, h: np.ndarray) -> np.ndarray:
        """Which language's lexicon has each word; -1 for none."""
        if not len(self.lex_hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.lex_hash, h), len(self.lex_hash) - 1)
        return np.where(self.lex_hash[at] == h, self.lex_lang[at], -1)

    def emissions(self, tokens: Tokens) -> np.ndarray:
        """Log potentials of each word; features are made once for each distinct word of the batch."""
        if not len(tokens.hash):
            return np.zeros((0, len(self.langs)))
        h, at, back = np.unique(tokens.hash, return_index=True, return_inverse=True)
        out = np.empty((len(at), len(self.langs)))
        for lo in range(0, len(at), 1 << 14):
            part = at[lo : lo + (1 << 14)]
            ids, first = word_features(tokens, part)
            out[lo : lo + len(part)] = np.add.reduceat(self.weights[ids], first, axis=0)
        lex = self.lexicon(h)
        some = lex >= 0
        out[some] += self.lex_weight[lex[some]]
        return out[back]


def posteriors(emit: np.ndarray, first: np.ndarray, count: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over many sequences at once; sequence i is ``emit[first[i] : first[i] + count[i]]``.

    ``pairs``, if given, is added the expected number of each transition.
    """
    potential = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    t = np.exp(trans - trans.max())
    order = np.argsort(-count, kind="stable")
    begin, size = first[order], count[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left") if longest else np.zeros(0, int)
    alpha = np.empty_like(potential)
    for k in range(longest):
        at = begin[: live[k]] + k
        a = potential[at] * (np.exp(start - start.max()) if k == 0 else prev[: live[k]] @ t)
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = prev = a
    beta = np.ones((len(size), emit.shape[1]))
    for k in range(longest - 2, -1, -1):
        m = live[k + 1]
        at = begin[:m] + k + 1
        ahead = potential[at] * beta[:m]
        if pairs is not None:
            both = alpha[at - 1][:, :, None] * t * ahead[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:m] = b
        alpha[at - 1] *= b
    alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-300)
    return alpha


def train(sample: list[tuple[str, str]], rounds: int = 40, seed: int = 7, bits: int = BITS) -> Model | None:
    """Fit the field by gradient ascent (Adam) on code-switched sequences spliced from texts of one language each."""
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    tokens = Tokens([t for t, _ in sample], punct=False)
    k = len(langs)
    doc_lang = np.array([langs.index(lang) for _, lang in sample])
    label = np.repeat(doc_lang, tokens.count)
    if not len(label):
        return None
    # lexicons: words seen at least 4 times, nearly always in one language
    h, back = np.unique(tokens.hash, return_inverse=True)
    seen = np.zeros((len(h), k))
    np.add.at(seen, (back, label), 1)
    sure = (seen.sum(1) >= 4) & (seen.max(1) >= 0.95 * seen.sum(1))
    lex_hash, lex_lang = h[sure], seen[sure].argmax(1)
    # sequences: each text is cut into runs of 4 to 24 words, and those are put in random order
    border = np.zeros(len(label) + 1, bool)
    border[tokens.first] = border[-1] = True
    border[np.cumsum(rng.integers(4, 25, len(label) // 4 + 1)).clip(max=len(label))] = True
    at = np.flatnonzero(border)
    run = rng.permutation(len(at) - 1)
    size = np.diff(at)[run]
    words = np.repeat(at[:-1][run] - (np.cumsum(size) - size), size) + np.arange(len(label))
    label = label[words]
    length = 96
    begins = np.arange(0, len(words), length)
    ids, begin = word_features(tokens, np.unique(tokens.hash, return_index=True)[1], bits)
    own = np.diff(np.append(begin, len(ids)))
    w, trans, start, lex_weight = np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k), np.zeros((k, k))
    lex_of = np.full(len(h), -1)
    lex_of[sure] = lex_lang
    word = back[words]
    params, moments = [w, trans, start, lex_weight], [(np.zeros_like(p), np.zeros_like(p)) for p in (w, trans, start, lex_weight)]
    # steps over whole sequences, about STEP_WORDS words each, in turn: each word is in one step at least
    each = max(1, STEP_WORDS // length)
    parts = [begins[lo : lo + each] for lo in range(0, len(begins), each)]
    rounds = max(rounds, len(parts))
    for step in range(1, rounds + 1):
        first = parts[(step - 1) % len(parts)]
        lo, hi = int(first[0]), min(int(first[-1]) + length, len(words))
        first = first - lo
        here, gold = word[lo:hi], label[lo:hi]
        count = np.minimum(length, hi - lo - first)
        kinds, spot = np.unique(here, return_inverse=True)
        flat = np.repeat(begin[kinds] - (np.cumsum(own[kinds]) - own[kinds]), own[kinds]) + np.arange(int(own[kinds].sum()))
        feature, owner = ids[flat], np.repeat(np.arange(len(kinds)), own[kinds])
        lex = lex_of[kinds]
        e = np.add.reduceat(w[feature], np.cumsum(own[kinds]) - own[kinds], axis=0)
        e[lex >= 0] += lex_weight[lex[lex >= 0]]
        pair = np.zeros((k, k))
        post = posteriors(e[spot], first, count, trans, start, pair)
        target = np.zeros((hi - lo, k))
        target[np.arange(hi - lo), gold] = 1
        error = target - post
        diff = np.stack([np.bincount(spot, error[:, y], len(kinds)) for y in range(k)], axis=1)
        gw = np.stack([np.bincount(feature, diff[owner, y], 1 << bits) for y in range(k)], axis=1)
        glex = np.zeros_like(lex_weight)
        np.add.at(glex, lex[lex >= 0], diff[lex >= 0])
        inner = np.ones(hi - lo, bool)
        inner[first] = False
        gt = target[:-1].T @ (target[1:] * inner[1:, None]) - pair
        gs = (target[first] - post[first]).sum(0)
        for p, g, (m, v) in zip(params, (gw, gt, gs, glex), moments):
            g = g / (hi - lo) - 1e-6 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(langs, w, trans, start, lex_hash, lex_lang, lex_weight)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    known = docs.where("lang IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("i"), F.col("lang").cast("string").alias("l"), "text")
    rows = smallest_hashes(known, train_docs, "i", "text", by="l").collect()  # train_docs rows of each language
    return train(sorted((r.text, r.l) for r in rows))


def classify(texts: list, model: Model) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Words, posterior of each word, mean posterior of each text (0 where it has no words)."""
    tokens = Tokens(texts, punct=False)
    post = posteriors(model.emissions(tokens), tokens.first, tokens.count, model.trans, model.first)
    acc = np.concatenate((np.zeros((1, len(model.langs))), np.cumsum(post, axis=0)))
    share = (acc[tokens.last] - acc[tokens.first]) / np.maximum(tokens.count, 1)[:, None]
    return tokens, post, share


OUT = "doc_id long, lang_id string, confidence double, n_words int, n_switches int, keep boolean, spans array<struct<first:int,last:int,lang:string>>"


def identify(docs: DataFrame, confidence: float = CONFIDENCE, **how) -> DataFrame:
    """Every document: its language, mean posterior (4 digits), and the spans of words (first, last exclusive) by language."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **how))

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        m = model.value
        n = len(texts)
        langs = pa.array(m.langs if m else [], pa.string())
        if m is None:
            lang, conf, words, switches, spans = pa.nulls(n, pa.string()), np.zeros(n), Tokens(texts, punct=False).count, np.zeros(n, int), None
        else:
            tokens, post, share = classify(texts, m)
            words = tokens.count
            best = share.argmax(1)
            conf = np.round(share[np.arange(n), best], 4)
            lang = langs.take(pa.array(np.where(words > 0, best, -1), mask=words == 0))
            label = post.argmax(1)
            new = np.ones(len(label), bool)
            new[1:] = label[1:] != label[:-1]
            new[tokens.first[words > 0]] = True
            at = np.flatnonzero(new)
            stop = np.append(at[1:], len(label))
            doc = np.searchsorted(tokens.last, at, "right")
            spans = (at - tokens.first[doc], stop - tokens.first[doc], langs.take(pa.array(label[at])))
            per = np.bincount(doc, minlength=n)
            switches = np.maximum(per - 1, 0)
        kind = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])
        if spans is None:
            column = pa.array([[]] * n, pa.list_(kind))
        else:
            off = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(spans[0], pa.int32()), pa.array(spans[1], pa.int32()), spans[2]], fields=list(kind))
            column = pa.ListArray.from_arrays(pa.array(off), flat)
        keep = (conf >= confidence) & (words > 0) if m else np.zeros(n, bool)
        return pa.RecordBatch.from_arrays(
            [rows.column(0), lang, pa.array(conf), pa.array(words, pa.int32()), pa.array(switches, pa.int32()), pa.array(keep), column],
            ["doc_id", "lang_id", "confidence", "n_words", "n_switches", "keep", "spans"],
        )

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, OUT)


def keep(docs: DataFrame, confidence: float = CONFIDENCE, **how) -> DataFrame:
    """The documents that ``identify`` keeps, all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **how))

    def mask(texts: list) -> np.ndarray:
        if model.value is None:
            return np.zeros(len(texts), bool)
        tokens, _, share = classify(texts, model.value)
        return (np.round(share.max(1), 4) >= confidence) & (tokens.count > 0)

    return keep_rows(docs, mask)
