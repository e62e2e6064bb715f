"""Symbol names: path labels, leaf, and the predicates over them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.schema import SYMBOL_TYPES

UNKNOWN = "unknown"
_DROPPED = re.compile(r"[*\[\]{},@\- ()]")
_NOT_LEAF = re.compile(r"[^A-Za-z0-9_]")


def dot_separates(symbol_type: int) -> bool:
    return SYMBOL_TYPES[symbol_type][3]


def tokens(name: str, dots: bool = True) -> list[str]:
    """Path labels of a name as typed in a query."""
    name = name if dots else name.replace(".", "_")
    found = (_NOT_LEAF.sub("", t) for t in re.split(r"[./:]", _DROPPED.sub("", name)))
    return [t for t in found if t]


def path_of(name: str, symbol_type: int) -> list[str]:
    return tokens(name, dot_separates(symbol_type)) or [UNKNOWN]


def leaf_token(name: str, dots: bool = True) -> str:
    return (tokens(name, dots) or [UNKNOWN])[-1]


def leaf_fragment(text: str, dots: bool = True) -> str:
    return _NOT_LEAF.sub("", text if dots else text.replace(".", "_"))


def smart_case(pattern: str) -> bool:
    """Whether a pattern is matched with case: it has an upper-case letter."""
    return any(c.isupper() for c in pattern)


def path_column(name: Column, symbol_type: Column) -> Column:
    """Path labels of the names in a table."""
    flat = F.when(symbol_type.isin(*[i for i, t in SYMBOL_TYPES.items() if not t[3]]), F.replace(name, F.lit("."), F.lit("_"))).otherwise(name)
    # what no label may have goes first, from the whole name: the separators are all else that is left
    kept = F.regexp_replace(flat, "[^A-Za-z0-9_./:]", "")
    labels = F.filter(F.split(kept, "[./:]"), lambda t: t != "")
    return F.when(F.translate(kept, "./:", "") != "", labels).otherwise(F.array(F.lit(UNKNOWN)))


def leaf_column(path: Column) -> Column:
    return F.element_at(path, -1)


def has_tokens(path: Column, wanted: list[str]) -> Column:
    """Whether the labels occur in the path, in order but not necessarily next to each other."""
    step = F.array(*[F.lit(t) for t in wanted])
    count = F.aggregate(path, F.lit(0), lambda i, t: F.when((i < len(wanted)) & (t == F.get(step, i)), i + 1).otherwise(i))
    # one label must be there at all: a test that reaches the scan's statistics
    return reduce(lambda a, b: a & b, [F.array_contains(path, t) for t in dict.fromkeys(wanted)]) & (count == len(wanted))


def has_tokens_anchored(path: Column, wanted: list[str]) -> Column:
    """The same with the last label at the end of the path."""
    end = F.element_at(path, -1) == wanted[-1]
    if len(wanted) == 1:
        return end
    return end & has_tokens(F.slice(path, 1, F.size(path) - 1), wanted[:-1])


def below_package(path: Column, package: list[str]) -> Column:
    """Strictly below a path."""
    return (F.slice(path, 1, len(package)) == F.array(*[F.lit(t) for t in package])) & (F.size(path) > len(package))


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def _collapse(pieces: list[str]) -> str:
    """Join LIKE pieces, "%" for a wildcard, runs of wildcards as one."""
    out: list[str] = []
    for p in pieces:
        if p == "%" and out and out[-1] == "%":
            continue
        if p:
            out.append(p)
    return "".join(out)


class Glob:
    """A pattern with ``*`` for any run of characters."""

    def __init__(self, raw: str):
        self.raw = raw
        self.parts = [p for p in re.split(r"([*./:])", raw) if p]
        self.hard = any(p in "/:" for p in self.parts)
        self.dotted = "." in self.parts
        literal = [p for p in self.parts if p not in ("*", ".", "/", ":")]
        if not (any(literal) if self.hard else any(leaf_fragment(p) for p in literal)):
            raise ValueError(f'pattern g"{raw}" has no character that a name could match')

    def leaf_like(self, dots: bool, anchored: bool) -> tuple[str, bool]:
        """LIKE pattern for the leaf, and whether case counts."""
        pieces, cased = ([] if anchored else ["%"]), False
        for p in self.parts:
            if p == "*":
                pieces.append("%")
            elif p not in "/:":
                text = leaf_fragment(p, dots)
                cased |= smart_case(text)
                pieces.append(like_escape(text))
        return _collapse(pieces + ([] if anchored else ["%"])), cased

    def full_like(self) -> tuple[str, bool]:
        return _collapse(["%" if p == "*" else like_escape(p) for p in re.split(r"(\*)", self.raw)]), smart_case(self.raw)

    def predicate(self, dots: bool, anchored: bool) -> Column:
        if self.hard or (self.dotted and dots):
            return self.full_predicate()
        pattern, cased = self.leaf_like(dots, anchored)
        return F.col("leaf_name").like(pattern) if cased else F.col("leaf_name").ilike(pattern)

    def full_predicate(self) -> Column:
        pattern, cased = self.full_like()
        return F.col("name").like(pattern) if cased else F.col("name").ilike(pattern)
