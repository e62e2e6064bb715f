"""An index: graph tables, the layers over them, and what can be asked of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import paths as paths_
from spanforge.functions import similarity, text
from spanforge.operators import results, search, tree
from spanforge.operators.graph import Graph
from spanforge.operators.layers import Chain, Layers
from spanforge.plans.engine import Result, Run
from spanforge.plans.limits import time_limit
from spanforge.schema import TABLES
from spanforge.storage import Lazy


class Index:
    """``tables``: a DataFrame for each of ``schema.TABLES`` (missing ones are empty), and ``nodes`` where it is stored."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], by_cells: "bool | list[int] | DataFrame | Callable" = False, cache_results: int = 64, layers_path: str | None = None):
        self.spark, self._by_cells = spark, by_cells
        empty = lambda schema: spark.createDataFrame([], schema)
        self.tables = Lazy({name: partial(tables.__getitem__, name) if name in tables else partial(empty, schema) for name, schema in TABLES.items()})
        if "nodes" in tables:
            self.tables.make["nodes"] = partial(tables.__getitem__, "nodes")
        self.layers = Layers(spark, layers_path)
        self._roots: dict[int, int] | None = None
        self._graphs: dict[tuple, Graph] = {}
        self._results: dict[str, Result] = {}
        self._cache_results = cache_results

    @property
    def by_cells(self) -> "bool | list[int] | DataFrame":
        """In which objects joins are by cells; worked out at its first use, if it was given as a function."""
        if callable(self._by_cells):
            self._by_cells = self._by_cells()
        return self._by_cells

    @classmethod
    def load(cls, spark: SparkSession, path: str, keep_layers: bool = False, **how) -> "Index":
        """Tables stored as Parquet under ``path`` (see sources.store); ``keep_layers``: overlay layers are stored there too."""
        from spanforge.sources.store import large_objects, read_tables

        known = {"by_cells": large_objects(spark, path), "layers_path": f"{path}/layers" if keep_layers else None}
        return cls(spark, read_tables(spark, path), **known | how)

    def changed(self) -> None:
        """Forget what was derived from the tables; to call after they have changed."""
        self._roots = None
        self._graphs.clear()
        self._results.clear()
        self.layers.clear()

    def roots(self) -> dict[int, int]:
        """Root layer by project."""
        if self._roots is None:
            self._roots = {r.id: r.root_layer_id for r in self.tables["projects"].where("id > 0").select("id", "root_layer_id").collect()}
        return self._roots

    def chain(self) -> Chain:
        return Chain(self.roots())

    def graph(self, chain: Chain | None = None) -> Graph:
        chain = chain or self.chain()
        key = tuple(chain.visible())
        if key not in self._graphs:
            if len(self._graphs) > 8:  # plans alone, but layers may have gone
                self._graphs.clear()
            self._graphs[key] = Graph(self.spark, self.tables, list(key), self.layers.overlay(chain.layers()), lambda: self.by_cells)
        return self._graphs[key]

    # queries:

    def query(self, query: str, timeout: float | None = None) -> Result:
        """Nodes and edges of a query; the results of the last queries are kept until the tables change."""
        found = self._results.pop(query, None)
        if found is None:
            with time_limit(self.spark, timeout):
                found = Run(self, query, timeout).execute()
            if found.activations:  # layers may be purged
                return found
        self._results[query] = found
        while len(self._results) > self._cache_results:
            self._results.pop(next(iter(self._results)))
        return found

    def ask(self, query: str, form: str = "json", projection: str = "names", limit: int = 100, timeout: float | None = 5.0) -> str:
        """A query's first ``limit`` symbols as JSON or Markdown."""
        with time_limit(self.spark, timeout):
            return self._shown(query, form, projection, limit)

    def _shown(self, query: str, form: str, projection: str, limit: int) -> str:
        from spanforge import render

        graph = to_graph(self.query(query), limit)
        if form == "json":
            return render.to_json(graph)
        if form != "markdown":
            raise ValueError(f"there is no format {form!r}")
        wanted = [int(o["object_id"]) for o in graph["objects"]]  # of `limit` symbols
        rows = search.contents(self.graph()).where(F.col("object_id").isin(wanted) & F.col("content").isNotNull()).select("object_id", "content").collect()
        return render.to_markdown(query, graph, {str(r.object_id): bytes(r.content) for r in rows}, projection)

    def suggest(self, name: str, limit: int = 5, graph: Graph | None = None) -> list[str]:
        """Names like one that doesn't exist."""
        return [r.name for r in similarity.suggest((graph or self.graph()).tables["symbols"], name, limit).collect()]

    def exists(self, name: str) -> bool:
        from spanforge.plans.verbs import name_predicate

        return not self.graph().select(name_predicate(name)).limit(1).isEmpty()

    # files:

    def source(self, object_id: int, start: int | None = None, end: int | None = None) -> bytes:
        """Bytes of a file, or of a range in it."""
        row = search.contents(self.graph()).where(F.col("object_id") == object_id).select("content", F.octet_length("content").alias("n")).first()
        if row is None or row.content is None:
            raise KeyError(f"object {object_id} has no content")
        lo, hi = start or 0, row.n if end is None else end
        if not 0 <= lo <= hi <= row.n:
            raise ValueError(f"[{lo}, {hi}) is not inside the {row.n} bytes of object {object_id}")
        return bytes(row.content[lo:hi])

    def read(self, path: str, start_line: int = 1, end_line: int | None = None, project_id: int | None = None) -> dict:
        """Lines of the file that matches a path best, and the other files that match."""
        found = search.resolve(self.graph(), path, project_id).collect()  # 50 rows at most
        if not found:
            raise KeyError(f"no file matches {path!r}")
        lines = self.source(found[0].object_id).decode("utf-8", "replace").split("\n")
        last = len(lines) if end_line is None else min(end_line, len(lines))
        if not 1 <= start_line <= last:
            raise ValueError(f"lines {start_line} to {last} aren't in the {len(lines)} of {found[0].path}")
        return {"path": found[0].path, "lines": lines[start_line - 1 : last], "other_matches": [r.path for r in found[1:]]}

    def resolve(self, path: str, project_id: int | None = None, limit: int = 50) -> DataFrame:
        return search.resolve(self.graph(), path, project_id, limit)

    def line_of(self, object_id: int, offset: int) -> int:
        row = search.contents(self.graph()).where(F.col("object_id") == object_id).select(text.line_of(F.col("content"), F.lit(offset)).alias("line")).first()
        if row is None:
            raise KeyError(f"object {object_id} has no content")
        return row.line

    # projects:

    def projects(self) -> DataFrame:
        return tree.projects(self.graph())

    def project(self, project_id: int) -> dict:
        row = self.projects().where(F.col("id") == project_id).first()
        if row is None:
            raise KeyError(f"there is no project {project_id}")
        return row.asDict()

    def tree(self, project_id: int, paths: list[str], compact: bool = False) -> dict[str, list[dict]]:
        """Entries below each of some directories of a project whose upload is complete."""
        status = self.tables["projects"].where(F.col("id") == project_id).select("upload_status").first()
        if status is None:
            raise KeyError(f"there is no project {project_id}")
        if status[0] != "complete":
            raise ValueError(f"project {project_id} is not complete")
        graph = self.graph()
        wanted = [paths_.normal("/" + p) for p in paths]
        named = [p for p in wanted if p != "/"]
        if named:
            from spanforge.schema import DIRECTORY

            s = graph.tables["symbols"].where((F.col("project_id") == project_id) & (F.col("symbol_type") == DIRECTORY) & F.col("name").isin(named))
            known = {r.name for r in s.select("name").distinct().collect()}
            for p in named:
                if p not in known:
                    raise ValueError(f"{p} is not a directory")
        rows = tree.children(graph, project_id, wanted)
        if compact:
            ends = tree.compact_paths(graph, project_id, rows.where("node_type = 'dir'").select("path"))
            rows = rows.join(ends, "path", "left")
        out: dict[str, list[dict]] = {p: [] for p in wanted}
        for r in sorted(rows.collect(), key=lambda r: (r.node_type != "dir", r.path)):
            out[r.parent].append({**r.asDict(), "name": r.path.rsplit("/", 1)[-1]})
        return out

    # layers:

    def purge_layers(self, ttl: float = 3600.0) -> set[int]:
        """Drop overlay layers unused for ``ttl`` seconds, and those that depend on them."""
        return self.layers.purge(ttl, time.time())


def to_graph(result: Result, limit: int = 100) -> dict:
    """What a front end shows: the first ``limit`` symbols with their occurrences, the edges between them, warnings."""
    total = result.nodes.select("symbol_id").distinct().count()
    kept = results.cap(result.nodes, limit)
    nodes = result.nodes.join(kept, "symbol_id", "left_semi").orderBy("symbol_id", "instance_id").collect()  # of `limit` symbols
    ids = kept.select(F.col("symbol_id").alias("from_symbol"))
    refs = result.ref_edges.join(ids, "from_symbol", "left_semi").join(ids.withColumnRenamed("from_symbol", "to_symbol"), "to_symbol", "left_semi")
    has = result.has_edges.join(ids.withColumnRenamed("from_symbol", "parent_symbol"), "parent_symbol", "left_semi").join(ids.withColumnRenamed("from_symbol", "child_symbol"), "child_symbol", "left_semi")
    symbols: dict[int, dict] = {}
    objects: dict[int, dict] = {}
    for r in nodes:
        s = symbols.setdefault(r.symbol_id, {"id": str(r.symbol_id), "label": r.name, "symbol_instances": [], "query_statements": []})
        s["symbol_instances"].append({"id": str(r.instance_id), "symbol": str(r.symbol_id), "object_id": str(r.object_id), "project_id": str(r.object_project), "symbol_type": r.symbol_type, "instance_type": r.instance_type, "start_offset": r.start, "end_offset": r.end})
        for x in r.statements:
            if x.asDict() not in s["query_statements"]:
                s["query_statements"].append(x.asDict())
        objects.setdefault(r.object_id, {"object_id": str(r.object_id), "path": r.path, "project_id": str(r.object_project)})
    projects = {i: o["project_id"] for i, o in objects.items()}
    return {
        "nodes": list(symbols.values()),
        "edges": [{"from": str(e.from_symbol), "to": str(e.to_symbol), "from_file": str(e.object_id), "from_project": projects.get(e.object_id), "from_offset_range": [e.start, e.end]} for e in refs.orderBy("from_symbol", "to_symbol", "object_id", "start", "end").collect()],
        "has_edges": [{"parent": str(e.parent_symbol), "child": str(e.child_symbol), "parent_instance": str(e.parent_instance), "child_instance": str(e.child_instance)} for e in has.orderBy("parent_instance", "child_instance").collect()],
        "objects": list(objects.values()),
        "warnings": [vars(w) for w in result.warnings],
        "total_symbols": total,
        "truncated": total > len(symbols),
    }
