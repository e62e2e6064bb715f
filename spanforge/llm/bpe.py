"""Operator 3, byte-level BPE encoding and decoding with a public vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern.  In each pre-token a
segment tree over its byte positions holds the rank of the pair that begins
there; its root is the leftmost pair of minimum rank.  A merge takes it and
updates three leaves, each with a logarithmic path: its own, its live left
neighbour's, and the one that vanished.  Pre-tokens of one width are merged in
lock step by numpy, long ones one by one; each distinct pre-token is encoded once
per task.

The vocabulary file (``vocabulary``, a .tiktoken list of base64 tokens and ranks)
is read where the tasks run; no tokenizer is trained.

Cases: a null text has null ids, an empty one none.  Special tokens' names in a
text are ordinary text.  Repeated rows get a row each.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import lists, map_texts, remember

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: distinct pre-tokens that a task remembers; the table is begun anew beyond (results don't depend on it)
REMEMBER = 500_000
#: name of that table among what a worker remembers: it stays for further tasks of an encoder, and goes when other work begins
WORDS = "pre-tokens"
_NONE = np.int64(1) << 62
_LOCKSTEP = 16
#: leaf for "no pair" in a tree of int32 (ranks are below 2^20, widths up to 64)
_NO_LEAF = np.int32((1 << 31) - 1)
#: tree cells merged in lock step at a time, so that they stay in the cache
_CELLS = 1 << 17


class Vocabulary:
    """Ranks of a byte-level vocabulary, and of each pair of tokens whose concatenation is a token."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 20 | b] = rank
        self.pairs = found
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_ranks = np.array([found[k] for k in self.pair_keys.tolist()], np.int64)
        length = np.array([len(t) for t in self.tokens], np.int64)
        self.token_len, self.token_at = length, np.concatenate(([0], np.cumsum(length)))
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where it isn't a token (or one side, -1, is missing)."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NONE)

    def encode_long(self, word: bytes) -> list[int]:
        """One pre-token by its own segment tree."""
        n = len(word)
        tok = self.single[np.frombuffer(word, np.uint8)].tolist()
        if n == 1:
            return tok
        width = 1 << (n - 1).bit_length()
        none, pairs = int(_NONE), self.pairs
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(tok[i] << 20 | tok[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        def pair(i: int) -> int:
            j = after[i]
            r = pairs.get(tok[i] << 20 | tok[j]) if j < n else None
            return none if r is None else r * width + i

        while tree[1] < none:
            rank, p = divmod(tree[1], width)
            q = after[p]
            tok[p] = rank
            after[p] = after[q]
            if after[q] < n:
                before[after[q]] = p
            put(q, none)
            put(p, pair(p))
            if before[p] >= 0:
                put(before[p], pair(before[p]))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = after[i]
        return out

    def encode_lockstep(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens of up to ``width`` (a power of two) bytes: tokens (-1 where none), by row, and their numbers."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width)[None] < size[:, None]
        tok = np.full((n, width + 2), -1, np.int64)  # column width: beyond the end; width + 1: before the start
        tok[:, :width][inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        column = np.arange(width)
        after = np.where(column[None] + 1 < size[:, None], column[None] + 1, width)
        after = np.concatenate([after, np.full((n, 2), width)], axis=1)
        before = np.broadcast_to(np.concatenate(([width + 1], column[:-1], [width + 1, width + 1])), (n, width + 2)).copy()
        tree = np.full((n, 2 * width), _NO_LEAF, np.int32)
        rank = self.rank(tok[:, : width - 1], tok[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank * width + column[:-1], _NO_LEAF)
        half = width
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        rows = np.flatnonzero(tree[:, 1] < _NO_LEAF)
        while len(rows):
            top = tree[rows, 1]
            p = top % width
            q = after[rows, p]
            z = after[rows, q]
            tok[rows, p] = top // width
            tok[rows, q] = -1
            after[rows, p] = z
            before[rows, z] = p
            tok[rows, width] = tok[rows, width + 1] = -1
            left = before[rows, p]
            mine = self.rank(tok[rows, p], tok[rows, z])
            other = self.rank(tok[rows, left], tok[rows, p])
            tree[rows, width + q] = _NO_LEAF
            tree[rows, width + p] = np.where(mine < _NONE, mine * width + p, _NO_LEAF)
            has = left < width
            tree[rows[has], width + left[has]] = np.where(other[has] < _NONE, other[has] * width + left[has], _NO_LEAF)
            for leaf, who in ((q, rows), (p, rows), (left[has], rows[has])):
                node = (width + leaf) >> 1
                while len(node) and node[0]:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NO_LEAF]
        live = tok[:, :width] >= 0
        return tok[:, :width][live], live.sum(axis=1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct pre-tokens, flat, and the number of each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        count, done = np.zeros(len(words), np.int64), []
        alone = np.ones(len(words), bool)
        width = 2
        while width <= 64:
            some = np.flatnonzero((size <= width) & (size > width // 2 if width > 2 else size > 0))
            if len(some) >= _LOCKSTEP:
                step = _CELLS // width
                for lo in range(0, len(some), step):
                    part = some[lo : lo + step]
                    flat, count[part] = self.encode_lockstep([words[i] for i in part.tolist()], width)
                    done.append((part, flat))
                alone[some] = False
            width *= 2
        for i in np.flatnonzero(alone).tolist():
            ids = self.encode_long(words[i])
            count[i] = len(ids)
            done.append((np.array([i]), np.array(ids, np.int64)))
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for part, flat in done:
            n = count[part]
            out[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return out, count

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_len[ids]
        at = np.repeat(self.token_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.token_bytes[at].tobytes()


class Seen(dict):
    """Numbers of words in the order in which they are first asked for; ``fresh`` has those that aren't encoded yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = at = len(self)
        return at


class Encoder:
    """A vocabulary with the pre-tokens that it has encoded so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = Seen()
        self.flat, self.count, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the words that were met for the first time."""
        flat, count = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in self.known.fresh])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        self.known.fresh = []

    def look_up(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of all texts are in the table, in order, and their number in each text."""
        remember(WORDS, self.forget)
        if len(self.known) > REMEMBER:
            self.forget()
        find = self.vocabulary.pattern.findall
        words, per = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = find(t)
                per[i] = len(w)
                words += w
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.fresh:
            self.learn()
        return at, per

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number in each."""
        at, per = self.look_up(texts)
        n = self.count[at]
        ids = self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return ids, self.per_text(n, per)

    def count_tokens(self, texts: list) -> np.ndarray:
        """The number of ids of each text."""
        at, per = self.look_up(texts)
        return self.per_text(self.count[at], per)

    @staticmethod
    def per_text(n: np.ndarray, per: np.ndarray) -> np.ndarray:
        ends = np.concatenate(([0], np.cumsum(n)))
        last = np.cumsum(per)
        return ends[last] - ends[last - per]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(Vocabulary(path, pattern))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Every document: ``doc_id``, ``ids``, ``n_tokens``."""
    return encode_and_decode(docs, vocabulary, pattern).drop("exact")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id`` and ``text`` of encoded documents (null ids: null text)."""

    def run(batches):
        vocab = encoder(vocabulary, pattern).vocabulary
        for batch in batches:
            texts = [None if ids is None else vocab.decode(np.asarray(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Every document: ``doc_id``, ``ids``, ``n_tokens``, and ``exact``: decoding gives the text's own bytes (null for null)."""

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        enc = encoder(vocabulary, pattern)
        ids, count = enc.encode(texts)
        back, size = enc.vocabulary.decode(ids), enc.vocabulary.token_len[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        last = np.cumsum(count)
        lo, hi = ends[last - count], ends[last]
        exact = [None if t is None else back[a:b] == t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, lo.tolist(), hi.tolist())]
        null = np.array([t is None for t in texts], bool)
        column = lists(ids, count, pa.int32())
        if null.any():
            column = pa.ListArray.from_arrays(column.offsets, column.values, mask=pa.array(null))
        return pa.RecordBatch.from_arrays([rows.column(0), column, pa.array(count, pa.int32(), mask=null), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_tokens", "exact"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, "doc_id long, ids array<int>, n_tokens int, exact boolean", budget=4 << 20, keeps=WORDS)
