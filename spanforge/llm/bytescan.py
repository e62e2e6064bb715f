"""Vectorised scanning of UTF-8 text: a batch of texts is one byte array.

A batch is laid out as ``text 0, separator, text 1, separator, ...`` so that a
whole Arrow batch is tokenised and hashed by a constant number of numpy passes,
whatever the number and the lengths of its texts.  A null text counts as an
empty one.  Hashes are 64-bit prefix-polynomial hashes: they depend on the
bytes alone, so they agree between tasks, batches and runs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

SPACE, WORD, PUNCT = 0, 1, 2
#: byte classes: ASCII letters, digits, "_" and every byte of a non-ASCII character are word bytes
CLASSES = np.full(256, PUNCT, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32, 0]] = SPACE
CLASSES[48:58] = WORD
CLASSES[65:91] = WORD
CLASSES[97:123] = WORD
CLASSES[95] = WORD
CLASSES[128:] = WORD
#: ASCII upper case to lower case; other bytes stay
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        p, q = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        p[0] = q[0] = 1
        _powers = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return _powers


def layout(texts: Iterable[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with one 0 byte after each text, and the start and end of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    size = np.fromiter((len(r) for r in raw), np.int64, len(raw))
    end = np.cumsum(size + 1) - 1
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8) if raw else np.zeros(0, np.uint8)
    return data, end - size, end


class Tokens:
    """Tokens of a batch: ``start``, ``end`` (byte offsets in ``data``), ``doc`` (index of the text), ``hash``."""

    def __init__(self, texts: Iterable[str | bytes | None], lower: bool = True, punct: bool = True):
        self.data, self.text_start, self.text_end = layout(texts)
        data = LOWER[self.data] if lower else self.data
        kind = CLASSES[self.data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1 if len(kind) else np.zeros(0, np.int64)
        start = np.concatenate(([0], edge)).astype(np.int64) if len(kind) else edge
        end = np.concatenate((edge, [len(kind)])).astype(np.int64) if len(kind) else edge
        k = kind[start] if len(start) else np.zeros(0, np.uint8)
        keep = (k != SPACE) if punct else (k == WORD)
        self.start, self.end = start[keep], end[keep]
        self.folded = data
        self.n_docs = len(self.text_end)
        # the 0 byte between texts is white space, so no token spans two texts
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)
        self.count = self.last - self.first
        self.hash = self._hash()

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)

    def _hash(self) -> np.ndarray:
        n = len(self.data)
        out = np.zeros(len(self.start), np.uint64)
        step = 1 << 18  # tables stay in the cache, whatever the length of the batch
        lo = 0
        while lo < len(self.start):
            base = self.start[lo]
            hi = int(np.searchsorted(self.end, base + step, "right"))
            hi = max(hi, lo + 1)
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            width = int(e[-1])
            p, q = _power_tables(width + 1)
            acc = np.empty(width + 1, np.uint64)
            acc[0] = 0
            np.cumsum((self.folded[base : base + width].astype(np.uint64) + np.uint64(1)) * p[:width], out=acc[1:])
            out[lo:hi] = mix((acc[e] - acc[s]) * q[s] + (e - s).astype(np.uint64))
            lo = hi
        assert n == len(self.data)
        return out


def ngram_hash(h: np.ndarray, n: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n tokens inside one text, and the text of each."""
    if n == 1:
        return h, doc
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    acc = np.zeros(m, np.uint64)
    for i in range(n):
        acc = mix(acc * _P + h[i : i + m] + np.uint64(i + 1))
    same = doc[:m] == doc[n - 1 :]
    return acc[same], doc[:m][same]
