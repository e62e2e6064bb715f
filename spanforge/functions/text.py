"""Literal search and line arithmetic over file contents, in bytes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A regular expression for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _word(c: Column) -> Column:
    return c.rlike("^[0-9A-Za-z_]$")


def pieces(text: Column, needle: str, cased: bool) -> Column:
    """The text between the occurrences of ``needle``."""
    return F.split(text if cased else F.lower(text), quoted(needle if cased else needle.lower()))


def occurrences(parts: Column, needle: str, cased: bool, whole_word: bool = False, limit: int | None = None) -> Column:
    """Array of (start, end) in bytes of the occurrences of ``needle``, from the left, none overlapping another.

    ``parts`` is a column of ``pieces``, not an expression: it is used again for each occurrence.  ``limit`` bounds the
    occurrences looked at in one text, before whole words are told.
    """
    pin = needle if cased else needle.lower()
    size = len(pin.encode())
    hits = F.size(parts) - 1
    if limit is not None:
        hits = F.least(hits, F.lit(limit))
    # ends of the pieces before each occurrence, in bytes
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.octet_length(p) + size).alias("at"), F.concat(acc["out"], F.array((acc["at"] + F.octet_length(p)).cast("int"))).alias("out")
    )
    starts = F.aggregate(F.slice(parts, 1, F.greatest(hits, F.lit(0))), first, step, lambda acc: acc["out"])
    found = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).cast("int").alias("end")))
    if not whole_word:
        return found

    def bounded(_x: Column, i: Column) -> Column:
        left, right = F.get(parts, i), F.get(parts, i + 1)
        # beside an empty piece stands the neighbouring occurrence, if there is one
        before = F.when(left != "", F.right(left, F.lit(1))).otherwise(F.when(i > 0, F.lit(pin[-1])).otherwise(F.lit("")))
        after = F.when(right != "", F.left(right, F.lit(1))).otherwise(F.when(i + 2 < F.size(parts), F.lit(pin[0])).otherwise(F.lit("")))
        return ~_word(before) & ~_word(after)

    return F.filter(found, bounded)


def may_contain(text: Column, needle: str, cased: bool) -> Column:
    return F.contains(text, F.lit(needle)) if cased else F.contains(F.lower(text), F.lit(needle.lower()))


def _lines(content: Column) -> Column:
    # one character for each byte
    return F.split(F.decode(content, "ISO-8859-1"), "\n")


def line_count(content: Column) -> Column:
    return F.size(_lines(content))


def line_range(content: Column, line: int) -> Column:
    """(start, end) in bytes of a line, counted from 1, without its line end; null beyond the last."""
    lines = _lines(content)
    start = F.aggregate(F.slice(lines, 1, line - 1), F.lit(0), lambda a, x: a + F.length(x) + 1) if line > 1 else F.lit(0)
    return F.when(F.size(lines) >= line, F.struct(start.cast("int").alias("start"), (start + F.length(F.get(lines, F.lit(line - 1)))).cast("int").alias("end")))


def line_of(content: Column, offset: Column) -> Column:
    """The line, counted from 1, of a byte offset."""
    return F.size(F.split(F.decode(F.substring(content, F.lit(1), offset), "ISO-8859-1"), "\n"))


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    return F.substring(content, start + 1, end - start)
