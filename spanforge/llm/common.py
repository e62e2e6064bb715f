"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.storage import written


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, once, and read it from there: its lineage ends, and lost executors cost nothing."""
    return written(df)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of ``columns`` has (case aside)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(batch: pa.RecordBatch, column: str, budget: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts, cut by size so that memory doesn't follow the number of rows in a batch.

    A slice has about ``budget`` bytes of text; a longer text is a slice of its own.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + budget, "right")))
        yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist()
        lo = hi


_remembered: dict[str, set[Callable[[], None]]] = {}


def remember(what: str, forget: Callable[[], None]) -> None:
    """Say that this worker keeps something from task to task, and how to drop it."""
    _remembered.setdefault(what, set()).add(forget)


def make_room(keeps: str | None = None) -> None:
    """As a task begins: drop what this worker remembers for other work; it shares the executor's memory with this task."""
    others = [what for what in _remembered if what != keeps]
    for what in others:
        for forget in _remembered.pop(what):
            forget()
    if others:
        release()


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str, column: str = "text", budget: int = 2 << 20, keeps: str | None = None) -> DataFrame:
    """Apply ``fn(rows, texts)`` to slices of the input; rows stay where they are (no shuffle).

    ``keeps``: what ``fn`` remembers from task to task, if anything; a task drops what others remember.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(keeps)
        for batch in batches:
            for rows, texts in pieces(batch, column, budget):
                out = fn(rows, texts)
                if out is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, mask: Callable[[list], np.ndarray], column: str = "text", budget: int = 2 << 20) -> DataFrame:
    """The rows of ``df`` whose text ``mask`` keeps, all columns as they were (no shuffle)."""

    def fn(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        return rows.filter(pa.array(mask(texts), pa.bool_()))

    return map_texts(df, fn, df.schema, column, budget)


def smallest_hashes(df: DataFrame, n: int, *columns: str, by: str | None = None) -> DataFrame:
    """The n rows of the smallest hashes of ``columns`` (all, if there are no more); n of each value of ``by``, if given.

    Rows are counted by the top 12 bits of the hash first and cut at the cell that n of them need, so that about n rows are sorted.
    Equal rows have one hash: of those, as many stay as are needed.
    """
    at, group, rank, last = fresh(df.columns, "at", "group", "rank", "last")
    hashed = df.withColumn(at, F.xxhash64(*columns)).withColumn(group, F.col(by) if by else F.lit(0))
    cell = F.shiftright(at, 52)
    seen = hashed.groupBy(group, cell.alias(at)).count()
    upto = Window.partitionBy(group).orderBy(at)
    before = F.coalesce(F.sum("count").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = seen.withColumn(rank, before).where(F.col(rank) < n).groupBy(group).agg(F.max(at).alias(last))  # a row for each value of `by`
    if by is None:
        end = border.first()
        own = hashed.where(cell <= (end[last] if end else 0))
    else:
        own = hashed.join(F.broadcast(border.withColumnRenamed(group, rank)), F.col(group).eqNullSafe(F.col(rank)), "inner").where(cell <= F.col(last)).drop(rank, last)
    first = Window.partitionBy(group).orderBy(at, *columns)
    return own.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop(rank, at, group)


def join_one(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with a ``right`` that has one row for each ``key`` and the number of its rows on the left (``size``).

    Keys of more than a thousandth of the rows, a thousand or two at most, are known to every task: their rows are dealt
    out over as many parts as they hold thousandths, so a key that a third of all rows have isn't gathered in one task.
    """
    least = max(total // 1000, 1)
    parts, part = fresh([*left.columns, *right.columns], "parts", "part")
    many = right.withColumn(parts, F.greatest(F.ceil(F.col(size) / least), F.lit(1)).cast("int"))
    hot = many.where(F.col(parts) > 1).select(key, parts)
    if hot.isEmpty():
        return left.join(right, key)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    spread = many.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return dealt.join(spread, [key, part]).drop(part)


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
