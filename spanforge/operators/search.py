"""Content: literal search, lines, slices and files by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators.graph import Graph


def contents(graph: Graph) -> DataFrame:
    """``object_id``, ``project_id``, ``path`` and ``content`` of each file; inline content goes before the shared store's."""
    t = graph.tables
    store = t["content_store"].select("content_hash", F.col("content").alias("shared"))
    inline = t["object_contents"].select("object_id", F.col("content").alias("own"))
    files = t["objects"].select(F.col("id").alias("object_id"), "project_id", F.col("filesystem_path").alias("path"), "content_hash")
    return files.join(inline, "object_id", "left").join(store, "content_hash", "left").select("object_id", "project_id", "path", F.coalesce("own", "shared").alias("content"))


def search(graph: Graph, needle: str, cased: bool, whole_word: bool = False, limit: int | None = 500, project: Column | None = None) -> DataFrame:
    """Occurrences of a text: ``project_id``, ``object_id``, ``start``, ``end``, ``n`` (order in its project).

    Each stored text is searched once, whatever the number of files that share it.  ``limit`` is for each project; one
    more row is given, by which to tell that there are more.
    """
    t = graph.tables
    store = t["content_store"].where(F.col("content_text").isNotNull() & text.may_contain(F.col("content_text"), needle, cased))
    parts = store.select("content_hash", text.pieces(F.col("content_text"), needle, cased).alias("parts"))
    hits = parts.select("content_hash", F.explode(text.occurrences(F.col("parts"), needle, cased, whole_word, None if limit is None else limit + 1)).alias("hit"))
    files = t["objects"].select(F.col("id").alias("object_id"), "project_id", "content_hash")
    if project is not None:
        wanted = t["projects"].where(project).select(F.col("id").alias("project_id"))
        files = files.join(wanted, "project_id", "left_semi")
    rows = files.join(hits, "content_hash").select("project_id", "object_id", F.col("hit.start").alias("start"), F.col("hit.end").alias("end"))
    if limit is None:
        return rows
    order = Window.partitionBy("project_id").orderBy("object_id", "start")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)


def path_matches(path: Column, wanted: str) -> Column:
    return (path == wanted) | path.endswith("/" + wanted.lstrip("/"))


def lines(graph: Graph, path: str, line: int, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that match a path, and the byte range of a line in those that have it."""
    files = contents(graph).where(path_matches(F.col("path"), path))
    if project is not None:
        wanted = graph.tables["projects"].where(F.col("project_name") == project).select(F.col("id").alias("project_id"))
        files = files.join(wanted, "project_id", "left_semi")
    ranges = files.select("project_id", "object_id", text.line_range(F.col("content"), line).alias("r")).where("r IS NOT NULL")
    return files.select("project_id", "object_id", "path"), ranges.select("project_id", "object_id", "r.start", "r.end")


def resolve(graph: Graph, path: str, project_id: int | None = None, limit: int = 50) -> DataFrame:
    """Files by suffix of their path: an exact one first, then the shortest, then by name."""
    files = graph.tables["objects"].where(path_matches(F.col("filesystem_path"), path) & (F.col("filetype") != "directory"))
    if project_id is not None:
        files = files.where(F.col("project_id") == project_id)
    exact = F.col("filesystem_path") == path
    return files.select(F.col("id").alias("object_id"), "project_id", F.col("filesystem_path").alias("path"), exact.alias("exact")).orderBy(F.desc("exact"), F.length("path"), "path", "object_id").limit(limit)
