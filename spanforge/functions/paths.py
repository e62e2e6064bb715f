"""File paths: one normal form, for paths of a request and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: str) -> str:
    """Slashes alone between the parts, none at the end or twice; ``.`` and ``..`` resolved; "/" for nothing."""
    flat = path.replace("\\", "/")
    parts: list[str] = []
    for p in flat.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return ("/" if flat.startswith("/") else "") + "/".join(parts) or "/"


def normal_column(path: Column) -> Column:
    """``normal`` of the paths in a table."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    joined = F.concat(F.when(F.startswith(flat, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(joined == "", "/").otherwise(joined)


def parent(path: Column) -> Column:
    """The directory that holds a path; "/" for those at the top."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)
