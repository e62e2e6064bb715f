"""Projects and their directory trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import paths
from spanforge.operators.graph import Graph
from spanforge.schema import DIRECTORY, FILE
from spanforge.storage import settle


def _entries(graph: Graph, project_id: int | None) -> DataFrame:
    """Directory and file symbols: ``project_id``, ``symbol_id``, ``path``, ``kind``, ``parent``."""
    s = graph.tables["symbols"].where(F.col("symbol_type").isin(DIRECTORY, FILE) & (F.col("name") != "/") & (F.col("layer") > 0))
    if project_id is not None:
        s = s.where(F.col("project_id") == project_id)
    return s.select("project_id", F.col("id").alias("symbol_id"), F.col("name").alias("path"), F.col("symbol_type").alias("kind"), paths.parent(F.col("name")).alias("parent"))


def children(graph: Graph, project_id: int, directories: list[str]) -> DataFrame:
    """Entries right below each of ``directories``: directories first; ``has_children`` for directories, ``object_id`` for files."""
    every = _entries(graph, project_id)
    own = every.where(F.col("parent").isin([paths.normal("/" + p) for p in directories]))
    full = every.select(F.col("parent").alias("path"), F.lit(True).alias("full")).distinct()
    dirs = own.where(F.col("kind") == DIRECTORY).join(full, "path", "left").select("parent", "path", F.lit("dir").alias("node_type"), F.coalesce("full", F.lit(False)).alias("has_children"), F.lit(None).cast("long").alias("object_id"), F.lit(None).cast("string").alias("filetype"))
    places = graph.tables["symbol_instances"].where("layer > 0").select(F.col("symbol").alias("symbol_id"), "object_id")
    objects = graph.tables["objects"].select(F.col("id").alias("object_id"), "filetype")
    files = own.where(F.col("kind") == FILE).join(places, "symbol_id").join(objects, "object_id").select("parent", "path", F.lit("file").alias("node_type"), F.lit(False).alias("has_children"), "object_id", "filetype").distinct()
    return dirs.distinct().unionByName(files).orderBy("parent", "node_type", "path")


def has_children(graph: Graph, project_id: int | None = None) -> DataFrame:
    """Each directory with whether something lies in it."""
    every = _entries(graph, project_id)
    full = every.select("project_id", F.col("parent").alias("path"), F.lit(True).alias("full")).distinct()
    return every.where(F.col("kind") == DIRECTORY).join(full, ["project_id", "path"], "left").select("project_id", "path", F.coalesce("full", F.lit(False)).alias("has_children"))


def compactable(graph: Graph, project_id: int | None = None) -> DataFrame:
    """Directories that hold one directory and nothing else: ``project_id``, ``parent``, ``child``."""
    every = _entries(graph, project_id)
    is_dir = F.col("kind") == DIRECTORY
    return every.groupBy("project_id", "parent").agg(F.count("*").alias("n"), F.count_if(is_dir).alias("dirs"), F.min(F.when(is_dir, F.col("path"))).alias("child")).where("n = 1 AND dirs = 1").select("project_id", "parent", "child")


def compact_paths(graph: Graph, project_id: int, directories: DataFrame) -> DataFrame:
    """For each directory (``path``) the end of the chain of only children below it, if there is one (``compact_path``)."""
    step = compactable(graph, project_id).select(F.col("parent").alias("at"), "child")
    walk = directories.select("path", F.col("path").alias("at"))
    while True:  # as many rounds as the longest chain has directories
        walk = walk.join(step, "at", "left").select("path", F.coalesce("child", "at").alias("at"), F.col("child").isNotNull().alias("moved"))
        walk, _ = settle(walk)
        if walk.where("moved").isEmpty():
            return walk.select("path", F.when(F.col("at") != F.col("path"), F.col("at")).alias("compact_path"))
        walk = walk.drop("moved")


def projects(graph: Graph) -> DataFrame:
    """Projects with the numbers of their files and symbols, and the chunks that have been uploaded (in order)."""
    t = graph.tables
    files = t["objects"].where((F.col("filetype") != "directory") & (F.col("layer") > 0)).groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("file_count"))
    symbols = t["symbols"].where("layer > 0").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("symbol_count"))
    sent = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("seq"))))
    chunks = t["chunks"].groupBy(F.col("project_id").alias("id")).agg(sent("symbols").alias("committed_symbol_chunks"), sent("objects").alias("committed_object_chunks"))
    none, empty = F.lit(0).cast("long"), F.array().cast("array<int>")
    known = t["projects"].where("id > 0").select("id", "project_name", "root_path", "upload_status", "symbol_chunks_total", "object_chunks_total")
    return known.join(files, "id", "left").join(symbols, "id", "left").join(chunks, "id", "left").select(
        *known.columns,
        F.coalesce("file_count", none).alias("file_count"),
        F.coalesce("symbol_count", none).alias("symbol_count"),
        F.coalesce("committed_symbol_chunks", empty).alias("committed_symbol_chunks"),
        F.coalesce("committed_object_chunks", empty).alias("committed_object_chunks"),
    )
