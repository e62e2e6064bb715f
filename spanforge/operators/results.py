"""From the selections of statements to nodes, edges and the rows that are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.graph import HAS_EDGE, NODE, NODE_SCHEMA, REF_EDGE, Graph


def merge_nodes(graph: Graph, found: list[tuple[DataFrame, int, int, str]]) -> DataFrame:
    """Each selected node once, with the statements that selected it."""
    tagged = [df.select(*NODE, F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")).alias("statement")) for df, a, b, t in found]
    if not tagged:
        return graph.spark.createDataFrame([], NODE_SCHEMA + ", statements array<struct<start:int,end:int,text:string>>")
    out = tagged[0]
    for t in tagged[1:]:
        out = out.union(t)
    return out.groupBy(*NODE).agg(F.sort_array(F.collect_set("statement")).alias("statements"))


def describe(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Nodes with their names, files and projects."""
    t = graph.tables
    return (
        nodes.join(t["symbols"].select(F.col("id").alias("symbol_id"), "name"), "symbol_id")
        .join(t["objects"].select(F.col("id").alias("object_id"), F.col("filesystem_path").alias("path"), F.col("project_id").alias("object_project")), "object_id")
        .join(t["projects"].select(F.col("id").alias("project_id"), "project_name"), "project_id")
        .select(*NODE, "name", "path", "object_project", "project_name", "statements")
    )


def ref_edges(graph: Graph, nodes: DataFrame, explicit: DataFrame | None, forced: DataFrame | None, near: "list[int] | None" = None) -> DataFrame:
    """Edges whose ends are both among ``nodes``: forced ones, those of the selections, and all others between nodes.

    One edge for each source, target symbol and place; forced ones first, then those of the selections, then by target.
    """
    ids = nodes.select("instance_id")

    def inside(edges: DataFrame) -> DataFrame:
        for end in ("from_instance", "to_instance"):
            edges = edges.join(ids.withColumnRenamed("instance_id", end), end, "left_semi")
        return edges.select(*REF_EDGE)

    parts = [graph.edges_between(nodes, near).withColumn("rank", F.lit(2))]
    if explicit is not None:
        parts.append(inside(explicit).withColumn("rank", F.lit(1)))
    if forced is not None:
        parts.append(inside(forced).withColumn("rank", F.lit(0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = ["from_instance", "from_symbol", "to_symbol", "object_id", "start", "end"]
    best = out.groupBy(*key).agg(F.min(F.struct("rank", "to_instance", "ref_id")).alias("best"))
    return best.select("from_instance", "from_symbol", F.col("best.to_instance").alias("to_instance"), "to_symbol", F.col("best.ref_id").alias("ref_id"), "object_id", "start", "end")


def has_edges(graph: Graph, nodes: DataFrame) -> DataFrame:
    """For each node the smallest of the nodes that contain it."""
    from spanforge.operators.graph import containment_join

    n = nodes.select("instance_id", "symbol_id", "object_id", "start", "end", "level").distinct()
    pairs = containment_join(n, n, (F.col("o.level") >= F.col("i.level")) & (F.col("o.instance_id") != F.col("i.instance_id")), graph.by_cells)
    span = (F.col("o.end").cast("long") - F.col("o.start")).alias("parent_span")
    flat = pairs.select(F.col("o.instance_id").alias("parent_instance"), F.col("o.symbol_id").alias("parent_symbol"), F.col("i.instance_id").alias("child_instance"), F.col("i.symbol_id").alias("child_symbol"), span)
    best = flat.groupBy("child_instance", "child_symbol").agg(F.min(F.struct("parent_span", "parent_instance", "parent_symbol")).alias("b"))
    return best.select("b.parent_instance", "b.parent_symbol", "child_instance", "child_symbol", "b.parent_span").select(*HAS_EDGE)


def cap(nodes: DataFrame, limit: int) -> DataFrame:
    """The first symbols (``symbol_id``) by path, start and id."""
    first = nodes.groupBy("symbol_id").agg(F.min(F.struct("path", "start")).alias("at"))
    return first.orderBy("at.path", "at.start", "symbol_id").limit(limit).select("symbol_id")


def merge_warnings(found: list) -> list:
    """In order of place; of overlapping ones the first, but one about a name that matched nothing before a note."""
    out: list = []
    for w in sorted(found, key=lambda w: (w.start, w.kind != "no_match")):
        if out and w.start < out[-1].end and w.start >= out[-1].start:
            if w.kind == "no_match" and out[-1].kind != "no_match":
                out[-1] = w
            continue
        out.append(w)
    return out
