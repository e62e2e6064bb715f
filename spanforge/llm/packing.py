"""Operator 6, best-fit packing of documents into training windows, with swap-based local search.

The size of a document is its number of tokens, by operator 3's encoder.  One
longer than the window is cut into full windows and a rest; each piece goes into
one bin.  Best-fit decreasing fills the bins of a block of documents, then local
search among its underfull bins moves a piece, exchanges one piece for one or two
for one, wherever that increases the sum of squared fills, until nothing does;
bins that become empty go.

Blocks are cut by the hash of id and size, about ``block_pieces`` pieces each, so
bins are filled in parallel.  Rows that agree in both (repeated ones, null ids)
are counted first and dealt out in lots of ``LOT`` rows, so they don't share a
block: one fits in memory, whatever the input.

Cases: ``doc_id`` is an integer of up to 64 bits.  Null and empty texts have size
0 and no piece, so they have no row.  Repeated rows are packed as often as they
occur.  Ties go by size, then
``doc_id`` (null first), then piece.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import bpe
from spanforge.llm.common import cut, make_room, map_texts, release

WINDOW = 2048
BLOCK_PIECES = 40_000
#: equal rows that stay together
LOT = 64


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Best-fit decreasing: members of each bin, for sizes in falling order."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(window + 1)]  # bins by remaining room
    open_: list[int] = []  # rooms that some bin has, in order
    for i, s in enumerate(sizes):
        k = bisect_left(open_, s)
        if k < len(open_):
            r = open_[k]
            b = room[r].pop()
            if not room[r]:
                open_.pop(k)
        else:
            r, b = window, len(bins)
            bins.append([])
        bins[b].append(i)
        left = r - s
        if left:
            if not room[left]:
                insort(open_, left)
            room[left].append(b)
    return bins


def local_search(bins: list[list[int]], sizes: list[int], window: int, rounds: int | None = None) -> list[list[int]]:
    """Moves and exchanges between underfull bins that increase the sum of squared fills; drops bins that become empty.

    With ``rounds`` None it ends when no move, one-for-one or two-for-one exchange is left that would.  What a source
    gives is looked for among all receivers by its difference: a piece of size t goes back for pieces of size g where
    the receiver has room for g - t and ends fuller than the source was.  For each t only the fullest receiver with that
    room matters, so it is found by a bisect, whatever the number of bins.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    under = {b for b in range(len(bins)) if 0 < fill[b] < window}
    rooms: list[tuple[int, int]] = []  # (room, bin) of underfull bins
    having: dict[int, list[tuple[int, int]]] = {}  # the same, of the underfull bins with a piece of a size
    kinds: list[int] = []  # sizes of pieces that some underfull bin has

    def put(b: int) -> None:
        if not 0 < fill[b] < window:
            return
        under.add(b)
        insort(rooms, (window - fill[b], b))
        for t in {sizes[i] for i in bins[b]}:
            if t not in having:
                having[t] = []
                insort(kinds, t)
            insort(having[t], (window - fill[b], b))

    def take(b: int) -> None:
        if b not in under:
            return
        under.discard(b)
        rooms.pop(bisect_left(rooms, (window - fill[b], b)))
        for t in {sizes[i] for i in bins[b]}:
            at = having[t]
            at.pop(bisect_left(at, (window - fill[b], b)))
            if not at:
                del having[t]
                kinds.pop(bisect_left(kinds, t))

    def fullest(at: list[tuple[int, int]], d: int, src: int) -> int | None:
        """The fullest bin but ``src`` with room for ``d``, if it would be fuller than ``src`` is."""
        k = bisect_left(at, (d, -1))
        if k < len(at) and at[k][1] == src:
            k += 1
        return at[k][1] if k < len(at) and fill[at[k][1]] + d > fill[src] else None

    def change(src: int, give: tuple[int, ...], to: int, back: int | None) -> None:
        take(src)
        take(to)
        for x in give:
            bins[src].remove(x)
            bins[to].append(x)
        if back is not None:
            i = next(i for i in bins[to] if sizes[i] == back and i not in give)
            bins[to].remove(i)
            bins[src].append(i)
        fill[src] = sum(sizes[i] for i in bins[src])
        fill[to] = sum(sizes[i] for i in bins[to])
        put(src)
        put(to)

    def improve(src: int) -> bool:
        own: dict[int, list[int]] = {}
        for i in sorted(bins[src]):
            own.setdefault(sizes[i], []).append(i)
        falling = sorted(own, reverse=True)
        for s in falling:
            to = fullest(rooms, s, src)
            if to is not None:
                change(src, (own[s][0],), to, None)
                return True
        gives = {s: (own[s][0],) for s in falling}
        for k, s in enumerate(falling):
            for t in falling[k:]:
                if s != t or len(own[s]) > 1:
                    gives.setdefault(s + t, (own[s][0], own[t][-1]))
        most = rooms[-1][0]
        for g in sorted(gives, reverse=True):
            for t in kinds[bisect_left(kinds, g - most) : bisect_left(kinds, g)]:
                to = fullest(having[t], g - t, src)
                if to is not None:
                    change(src, gives[g], to, t)
                    return True
        return False

    for b in sorted(under):
        under.discard(b)
        put(b)
    done = 0
    while rounds is None or done < rounds:
        done += 1
        better = False
        for src in sorted(under, key=lambda b: (fill[b], b)):
            while src in under and improve(src):
                better = True
        if not better:
            break
    return [b for b in bins if b]


def pack(sizes: list[int], window: int, rounds: int | None = None) -> list[list[int]]:
    """Bins of indexes into ``sizes`` (falling, none above the window)."""
    full = [[i] for i, s in enumerate(sizes) if s == window]
    rest = sizes[len(full) :]
    bins = local_search(best_fit(rest, window), rest, window, rounds)
    return full + [sorted(len(full) + i for i in b) for b in bins]


OUT = "doc_id long, piece int, first_token long, n_tokens int, bin_id long, bin_offset int"


def token_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """``doc_id`` and the number of tokens ``n`` of each row."""

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        n = bpe.encoder(vocabulary).count_tokens(texts)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, "doc_id long, n long", budget=1 << 20, keeps=bpe.WORDS)


def best_fit_packing(docs: DataFrame, window: int = WINDOW, block_pieces: int = BLOCK_PIECES, rounds: int | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Each piece: ``doc_id``, ``piece``, ``first_token`` in its document, ``n_tokens``, ``bin_id``, ``bin_offset``."""
    sized = cut(token_counts(docs, vocabulary).where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("copies")))
    total = sized.agg(F.sum(F.ceil(F.col("n") / window) * F.col("copies"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_pieces))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        make_room()
        block = int(pdf["block"].iloc[0])
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].sort_values(["doc_id", "n"], na_position="first", kind="stable")
        n = pdf["n"].to_numpy(np.int64)
        count = -(-n // window)
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(window, n[row] - piece * window)
        order = np.argsort(-size, kind="stable")
        row, piece, size = row[order], piece[order], size[order]
        bins = pack(size.tolist(), window, rounds)
        member = np.fromiter((i for b in bins for i in b), np.int64, len(row))
        length = np.fromiter(map(len, bins), np.int64, len(bins))
        number = np.repeat(np.arange(len(bins)), length)
        size_in = size[member]
        before = np.cumsum(size_in) - size_in
        first = np.cumsum(length) - length
        offset = before - np.repeat(before[first], length)
        release()
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].iloc[row[member]].to_numpy(),
                "piece": piece[member].astype(np.int32),
                "first_token": piece[member] * window,
                "n_tokens": size_in.astype(np.int32),
                "bin_id": block * (1 << 32) + number,
                "bin_offset": offset.astype(np.int32),
            }
        ).astype({"doc_id": "Int64"})

    lot = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LOT).cast("int"))).alias("lot")
    lots = sized.select("doc_id", "n", "copies", lot).select("doc_id", "n", "lot", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT).alias("copies"))
    return lots.withColumn("block", F.pmod(F.xxhash64("doc_id", "n", "lot"), F.lit(blocks))).groupBy("block").applyInPandas(fill, OUT)
