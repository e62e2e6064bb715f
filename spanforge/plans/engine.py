"""Running a query: a fixed point of semi-joins over its statements.

The driver schedules statements; every set is a DataFrame.  Each selector of a
statement gets an initial selection from its predicates; then statements with a
selection, the smallest first, tell their neighbours, which are constrained by
it or derive a selection of their own from it, until nothing changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import names
from spanforge.operators import search as content
from spanforge.operators.graph import NODE, NODE_SCHEMA, Graph
from spanforge.operators.layers import Activation, Chain, Layer, Layers, digest, number
from spanforge.plans import verbs as V
from spanforge.plans.parser import QueryError
from spanforge.plans.statements import CHILD, PARENT, USER, Statement, read, walk
from spanforge.schema import CONTENT, HAS, REFS
from spanforge.storage import Lazy, local, settle, settle_rows


#: objects and symbols of a small set up to which they are known to the plans that start from it
FEW = 200


@dataclass
class Nodes:
    """A set of nodes without lineage, its size, and its objects and symbols if they are few."""

    df: DataFrame
    count: int
    objects: list[int] | None = None
    symbols: list[int] | None = None
    #: the least and the greatest symbol, where there are many
    span: tuple[int, int] | None = None

    @staticmethod
    def of(df: DataFrame) -> "Nodes":
        kept, n, rows = settle_rows(df.select(*NODE))
        if rows is None:
            return Nodes(kept, n, span=tuple(kept.agg(F.min("symbol_id"), F.max("symbol_id")).first()))
        few = lambda c: None if rows is None or len(found := rows.column(c).unique()) > FEW else sorted(found.to_pylist())
        span = tuple(min_max.values()) if n and (min_max := pc.min_max(rows.column("symbol_id")).as_py()) else None
        return Nodes(kept, n, few("object_id"), few("symbol_id"), span)

    @staticmethod
    def together(some: "list[Nodes]") -> "Nodes":
        df = some[0].df
        for n in some[1:]:
            df = df.union(n.df)
        both = lambda parts: None if any(p is None for p in parts) or len(found := {x for p in parts for x in p}) > FEW else sorted(found)
        spans = [n.span for n in some if n.count]
        span = (min(a for a, _ in spans), max(b for _, b in spans)) if spans and all(spans) else None
        return Nodes(df, sum(n.count for n in some), both([n.objects for n in some]), both([n.symbols for n in some]), span)


@dataclass
class Limits:
    """Which neighbours the references of a selection may have: ids, or nodes of predicates."""

    ids: list[DataFrame] = field(default_factory=list)
    predicates: list[V.Predicate] = field(default_factory=list)

    def instances(self, graph: Graph) -> DataFrame:
        parts = [df.select("instance_id") for df in self.ids]
        parts += [graph.select(p.node, project=p.project).select("instance_id") for p in self.predicates]
        if not parts:
            return graph.spark.createDataFrame([], "instance_id long")
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()


SKIP = object()  # no references are wanted; None: all are


@dataclass
class Part:
    """Where a selection's edges come from: the nodes as first selected, and limits on their neighbours."""

    graph: Graph
    origin: Nodes
    above: "Limits | None | object"
    below: "Limits | None | object"
    forced: "tuple[Nodes, Nodes] | None" = None

    def parents(self) -> DataFrame | None:
        """References to the nodes."""
        if self.forced is not None:
            return forced_edges(*self.forced)
        if self.above is SKIP or not self.origin.count:
            return None
        edges = self.graph.ref_parents(self.origin.df, self.origin.symbols, self.origin.span)
        if self.above is None:
            return edges
        return edges.join(self.above.instances(self.graph).withColumnRenamed("instance_id", "from_instance"), "from_instance", "left_semi")

    def children(self) -> DataFrame | None:
        """References from the nodes."""
        if self.below is SKIP or not self.origin.count:
            return None
        edges = self.graph.ref_children(self.origin.df, near=self.origin.objects)
        if self.below is None:
            return edges
        return edges.join(self.below.instances(self.graph).withColumnRenamed("instance_id", "to_instance"), "to_instance", "left_semi")


def forced_edges(parents: Nodes, children: Nodes) -> DataFrame:
    """An edge from each parent to each child, at the parent's own range; no stored reference (id 0)."""
    p = parents.df.select(F.col("instance_id").alias("from_instance"), F.col("symbol_id").alias("from_symbol"), "object_id", "start", "end")
    c = children.df.select(F.col("instance_id").alias("to_instance"), F.col("symbol_id").alias("to_symbol"))
    return p.crossJoin(c).select("from_instance", "from_symbol", "to_instance", "to_symbol", F.lit(0).cast("long").alias("ref_id"), "object_id", "start", "end")


@dataclass
class Selection:
    nodes: Nodes
    parts: list[Part]

    def with_nodes(self, nodes: Nodes) -> "Selection":
        return Selection(nodes, self.parts)


@dataclass
class Warning_:
    kind: str  # no_match or note
    message: str
    start: int
    end: int
    token: str | None = None
    name_exists: bool = False
    suggestions: list[str] = field(default_factory=list)


@dataclass
class Result:
    """Nodes and edges of a query.

    ``nodes``: NODE columns, ``name``, ``path``, ``project_name``, ``statements``; ``ref_edges``, ``has_edges``.
    ``selected``: the nodes without their names and paths.
    """

    selected: DataFrame
    shown: Lazy
    warnings: list[Warning_]
    activations: list[Activation]

    @property
    def nodes(self) -> DataFrame:
        return self.shown["nodes"]

    @property
    def ref_edges(self) -> DataFrame:
        return self.shown["ref_edges"]

    @property
    def has_edges(self) -> DataFrame:
        return self.shown["has_edges"]


class Run:
    """One execution of one query."""

    def __init__(self, index: "IndexLike", text: str, timeout: float | None = None):
        import time

        self.index, self.text, self.spark = index, text, index.spark
        self.statements = read(text)
        self.chain: Chain = index.chain()
        self.graph: Graph = index.graph(self.chain)
        self.state: dict[V.Verb, Selection | None] = {}
        self.kept: dict[V.Verb, Selection] = {}  # what forced selectors hold back
        self.activations: list[Activation] = []
        self.settled: list[tuple] = []  # constraints that are known to change nothing
        self.deadline = time.monotonic() + timeout if timeout else None

    # state:

    def computed(self, s: Statement) -> bool:
        return all(v in self.state for v in s.selectors)

    def selection(self, s: Statement) -> Selection | None:
        """The selections of its selectors together; one without a selection resets those before it."""
        found: list[Selection] = []
        for v in s.selectors:
            if v not in self.state:
                continue
            if self.state[v] is None:
                found = []
            else:
                found.append(self.state[v])
        if not found:
            return None
        if len(found) == 1:
            return found[0]
        return self.union(found)

    def union(self, found: list[Selection]) -> Selection:
        some = [x.nodes for x in found if x.nodes.count] or [found[0].nodes]
        return Selection(Nodes.together(some), [p for x in found for p in x.parts])

    def resolved(self, s: Statement) -> bool:
        return not s.selectors or any(self.state.get(v) is not None for v in s.selectors)

    def size(self, s: Statement) -> float:
        x = self.selection(s)
        return float("inf") if x is None else x.nodes.count

    # scopes:

    def above(self, s: Statement) -> "Limits | None | object":
        if s.parent is None:
            return None
        if self.computed(s.parent):
            x = self.selection(s.parent)
            return None if x is None else Limits([x.nodes.df] if x.nodes.count else [])
        found = s.parent.scope_predicates()
        return Limits(predicates=found) if found else None

    def below(self, s: Statement) -> "Limits | None | object":
        if not s.children:
            return SKIP
        limits, known, open_, clear = Limits(), 0, False, False
        for c in s.children:
            if self.computed(c):
                x = self.selection(c)
                if x is None:
                    clear = True
                else:
                    limits.ids.append(x.nodes.df)
                    known += x.nodes.count
            else:
                open_ = True
                limits.predicates += c.scope_predicates()
        if not known and not limits.predicates:
            return None if open_ or clear else SKIP
        return limits

    # initial selections:

    def select(self, s: Statement, predicate: V.Predicate, ids: DataFrame | None, above, below, graph: Graph | None = None, among: DataFrame | None = None) -> Selection:
        graph = graph or self.graph
        nodes = Nodes.of(graph.select(predicate.node, ids, predicate.project, among))
        return Selection(nodes, [Part(graph, nodes, above, below)])

    def seed(self) -> None:
        waiting: list[tuple[Statement, object, object, Chain]] = []

        def drain() -> None:
            made = [self.initial(s, above, below, chain) for s, above, below, chain in waiting]
            for found in made:
                self.state.update(found)
            waiting.clear()

        for s in self.statements:
            if s.waits:
                drain()
            # a statement sees the layers of those before it that it waits for
            waiting.append((s, self.above(s), self.below(s), self.chain))
        drain()

    def initial(self, s: Statement, above, below, chain: Chain) -> dict[V.Verb, Selection | None]:
        out: dict[V.Verb, Selection | None] = {}
        filters = s.filters
        made: list[Layer] | None = None
        for v in s.selectors:
            if isinstance(v, V.Select) and not any(x.named for x in s.verbs):
                s.warnings.append(Warning_("note", "select needs a filter on the name", v.start, v.end))
        graph = self.index.graph(chain)
        if s.layered:
            made, graph = self.materialise(s, filters, chain, graph)
        for v in s.selectors:
            found: Selection | None = None
            if v.layered:
                rows = [x.rows["symbol_instances"].select(F.col("id").alias("instance_id")) for x in made if "symbol_instances" in x.rows]
                if not self.chain.roots:
                    s.warnings.append(Warning_("note", "no project is visible", v.start, v.end))
                if rows:
                    ids = rows[0]
                    for r in rows[1:]:
                        ids = ids.union(r)
                    found = self.select(s, V.Predicate(), ids, above, below, graph)
            elif isinstance(v, V.NameSelector):
                found = self.select(s, V.Predicate.both([filters, V.Predicate(v.own_predicate())]), None, above, below, graph)
                if isinstance(v, V.Forced):
                    self.kept[v], found = found, None
            elif isinstance(v, V.Select) or (isinstance(v, V.TypeSelector) and not v.filter_only):
                found = self.select(s, filters, None, above, below, graph)
            elif isinstance(v, V.Scope):
                found = Selection(Nodes(local(self.spark, [], NODE_SCHEMA), 0), [])
            if found is not None and not found.nodes.count:
                s.warnings.append(Warning_("no_match", "the statement matched no symbols", v.start, v.end, v.token))
            out[v] = found
        return out

    # overlay layers:

    def materialise(self, s: Statement, filters: V.Predicate, chain: Chain, graph: Graph) -> tuple[list[Layer], Graph]:
        """The layers of a statement, one or two for each root, and the graph with them; they join the request's chain."""
        layers: Layers = self.index.layers
        labels = self._labelled(s)
        key, more = [], []
        for v in (x for x in s.selectors if x.layered):
            if isinstance(v, V.Search):
                key.append(("search", v.text, v.cased, v.whole_word, v.limit, str(filters.project)))
            elif isinstance(v, V.Loc):
                key.append(("loc", v.path, v.line, v.project))
            else:
                if not v.rows:
                    raise QueryError("a layer holds one ephemeral verb at least", v.start, v.end)
                base, extra = self._split(v, labels, chain)
                key.append(("layer", [self._mark(r, labels) for r in base]))
                more += [self._mark(r, labels) for r in extra]
        made: list[Layer] = []
        rows: dict[int, dict] | None = None
        later: dict[int, dict] | None = None
        cut: set[int] = set()
        for project, root in sorted(chain.roots.items()):
            chained = chain.added[root]
            h = digest("base", key, root)
            base = layers.find(h)
            created = base is None
            if base is None:
                if rows is None:
                    rows, later, cut = self._rows(s, filters, labels, chain, graph)
                base = layers.make(h, root, root, None, project in cut, rows.get(project, {}), set())
            made.append(base)
            self.activations.append(Activation(root, base.id, created, base.truncated, "base"))
            if chained:
                h = digest("supplement", base.id, chained[-1], more)
                extra = layers.find(h)
                created = extra is None
                if extra is None:
                    if later is None:
                        rows, later, cut = self._rows(s, filters, labels, chain, graph)
                    extra = layers.make(h, root, chained[-1], base.id, False, later.get(project, {}), set(chain.layers()))
                made.append(extra)
                self.activations.append(Activation(root, extra.id, created, extra.truncated, "supplement"))
        chain, self.chain = chain.copy(), self.chain.copy()
        chain.push(made)
        self.chain.push(made)
        self.graph = self.index.graph(self.chain)
        if any(x.truncated for x in made):
            v = next((x for x in s.selectors if isinstance(x, V.Search)), s.selectors[0])
            s.warnings.append(Warning_("note", f"search: more than {v.limit} matches in a project; the rest is left out", v.start, v.end))
        return made, self.index.graph(chain)

    def _labelled(self, s: Statement) -> dict[str, DataFrame]:
        """Symbols of the labels that the layers of a statement refer to: ``symbol_id``."""
        out: dict[str, DataFrame] = {}
        for provider, label in s.waits:
            if label is not None:
                x = self.selection(provider)
                ids = (x.nodes.df if x else local(self.spark, [], NODE_SCHEMA)).select("symbol_id").distinct()
                out[label] = ids if label not in out else out[label].union(ids).distinct()
        return {k: settle(df)[0] for k, df in out.items()}

    @staticmethod
    def _mark(row: V.EphemeralRow, labels: dict[str, DataFrame]) -> list:
        if row.label is None:
            return [row.kind, sorted(row.values.items(), key=str)]
        # what a label resolved to, whatever its size
        n = labels[row.label].agg(F.count("*"), F.sum(F.xxhash64("symbol_id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("symbol_id"))).first()
        return [row.kind, sorted(row.values.items(), key=str), [str(x) for x in n]]

    def _split(self, v: V.Layer, labels: dict[str, DataFrame], chain: Chain) -> tuple[list, list]:
        """Rows over stored symbols, and rows that refer to overlay ones."""
        base, extra = [], []
        for r in v.rows:
            if r.label is not None:
                own = not labels[r.label].where("symbol_id < 0").isEmpty()
            else:
                own = any(isinstance(x, int) and x < 0 for k, x in r.values.items() if k not in ("start", "end", "scope"))
            (extra if own else base).append(r)
        if extra and not chain.layers():
            raise QueryError("rows refer to overlay ids, but no layer comes before them", v.start, v.end)
        return base, extra

    def _rows(self, s: Statement, filters: V.Predicate, labels: dict[str, DataFrame], chain: Chain, graph: Graph) -> tuple[dict[int, dict], dict[int, dict], set[int]]:
        """Rows by project and table: of base layers, of supplements; and projects with more matches than the limit."""
        base: dict[int, dict[str, list[DataFrame]]] = {p: {} for p in chain.roots}
        extra: dict[int, dict[str, list[DataFrame]]] = {p: {} for p in chain.roots}
        cut: set[int] = set()
        for v in (x for x in s.selectors if x.layered):
            if isinstance(v, V.Layer):
                self._validate(v, chain, graph)
                first, second = self._split(v, labels, chain)
                self._literal(first, labels, base, graph)
                self._literal(second, labels, extra, graph)
                continue
            if isinstance(v, V.Search):
                found = content.search(graph, v.text, v.cased, v.whole_word, v.limit, filters.project)
                found, _ = settle(found)
                cut |= {r.project_id for r in found.where(F.col("n") > v.limit).select("project_id").distinct().collect()}
                found = found.where(F.col("n") <= v.limit)
                name = "search:" + "".join("?" if c == ":" or ord(c) < 32 else c for c in v.text)
            else:
                files, found = content.lines(graph, v.path, v.line, v.project)
                if files.isEmpty():
                    raise QueryError(f"loc: no file matches {v.path!r}", v.start, v.end)
                found, n = settle(found)
                if not n:
                    raise QueryError(f"loc: no file that matches {v.path!r} has a line {v.line}", v.start, v.end)
                name = f"loc:{v.path}:{v.line}"
            here = {r.project_id: r.files for r in found.groupBy("project_id").agg(F.countDistinct("object_id").alias("files")).collect()}  # projects at most
            for p in sorted(set(here) & set(chain.roots)):
                own = found.where(F.col("project_id") == p)
                # one symbol for all that a search finds, one for each file of a line
                n = here[p] if isinstance(v, V.Loc) else 1
                first = self.index.layers.fresh("symbols", n)
                self._symbols(base[p], first, n, name, p)
                if n > 1:
                    files = own.select("object_id").distinct()
                    own = own.join(number(files, first).withColumnRenamed("id", "symbol"), "object_id")
                else:
                    own = own.withColumn("symbol", F.lit(first).cast("long"))
                base[p].setdefault("symbol_instances", []).append(own.select("symbol", "object_id", "start", "end", F.lit(1).alias("instance_type")))
        fold = lambda x: {p: {t: _union(dfs) for t, dfs in tables.items()} for p, tables in x.items()}
        return fold(base), fold(extra), cut

    def _symbols(self, out: dict, first: int, n: int, name: str, project: int) -> None:
        """n content symbols of one name: ids from ``first`` down."""
        path = names.path_of(name, CONTENT)
        rows = self.spark.range(n).select(
            (F.lit(first) - F.col("id")).alias("id"), F.lit(name).alias("name"), F.array(*map(F.lit, path)).alias("symbol_path"), F.lit(project).alias("project_id"), F.lit(CONTENT).alias("symbol_type"), F.lit(None).cast("int").alias("symbol_scope"), F.lit(path[-1]).alias("leaf_name")
        )
        out.setdefault("symbols", []).append(rows)

    def _symbol(self, out: dict, id_: int, name: str, project: int, kind: int, scope: int | None) -> None:
        path = names.path_of(name, kind)
        row = (id_, name, path, project, kind, scope or None, path[-1])
        schema = "id long, name string, symbol_path array<string>, project_id int, symbol_type int, symbol_scope int, leaf_name string"
        out.setdefault("symbols", []).append(local(self.spark, [row], schema))

    def _validate(self, v: V.Layer, chain: Chain, graph: Graph) -> None:
        """Objects and projects that rows name must be there."""
        objects = {x for r in v.rows for k, x in r.values.items() if k in ("object_id", "from_object")}
        known = {r.id: r.project_id for r in graph.tables["objects"].where(F.col("id").isin(sorted(objects))).select("id", "project_id").collect()} if objects else {}
        for x in sorted(objects):
            if known.get(x) not in chain.roots:
                raise QueryError(f"a layer row names object {x}, which is not visible", v.start, v.end)
        for r in v.rows:
            if r.kind == "ephemeral_symbol" and r.values["project_id"] not in chain.roots:
                raise QueryError(f"a layer row names project {r.values['project_id']}, which is not visible", v.start, v.end)

    def _literal(self, rows: list[V.EphemeralRow], labels: dict[str, DataFrame], out: dict[int, dict], graph: Graph) -> None:
        objects = graph.tables["objects"]
        for r in rows:
            x = r.values
            if r.kind == "ephemeral_symbol":
                self._symbol(out[x["project_id"]], self.index.layers.fresh("symbols"), x["name"], x["project_id"], x["symbol_type"], x["scope"])
                continue
            target, obj = ("symbol_id", "object_id") if r.kind == "ephemeral_instance" else ("to_symbol", "from_object")
            ids = labels[r.label] if r.label is not None else local(self.spark, [(x[target],)], "symbol_id long")
            project = objects.where(F.col("id") == x[obj]).select("project_id").first()
            if project is None or project[0] not in out:
                continue
            lit = lambda k: F.lit(x[k]).cast("long" if k == obj else "int").alias(k)  # noqa: B023, E731
            if r.kind == "ephemeral_instance":
                df = ids.select(F.col("symbol_id").alias("symbol"), lit("object_id"), lit("start"), lit("end"), lit("instance_type"))
                out[project[0]].setdefault("symbol_instances", []).append(df)
            else:
                df = ids.select(F.col("symbol_id").alias("to_symbol"), lit("from_object"), lit("start"), lit("end"))
                out[project[0]].setdefault("symbol_refs", []).append(df)

    # propagation:

    def propagate(self) -> None:
        import time

        queue = [s for s in self.statements if self.selection(s) is not None]
        while queue:
            if self.deadline and time.monotonic() > self.deadline:
                raise QueryError("the query took longer than its time limit", 0, len(self.text))
            sizes = [self.size(s) for s in queue]
            at = sizes.index(min(sizes))
            s, queue[at] = queue[at], queue[-1]
            queue.pop()
            for v in s.selectors:
                if isinstance(v, V.Use) and v.forced and self.state.get(v) is None and v in self.kept:
                    self.state[v] = self.kept[v]
            if self.selection(s) is None:
                continue
            for other, role in s.dependents:
                if self.notify(s, other, role) and other not in queue:
                    queue.append(other)

    def notify(self, s: Statement, other: Statement, role: str) -> bool:
        if role == PARENT:
            return self.tell_parent(s, other)
        x = self.selection(s)
        if x is None:
            return False
        relation = other.relation if role == CHILD else s.relation
        changed = False
        filters = None
        for v in other.selectors:
            if role == USER and v.uses not in s.labels:
                continue
            has_own = self.state.get(v) is not None
            if isinstance(v, V.Use):
                if not v.forced or role != CHILD:
                    if has_own:
                        changed |= self.constrain(v, other, x, role, relation, None)
                        continue
                    if role == CHILD:
                        raise QueryError(f"{v.uses!r} can't be resolved: it depends on itself", v.start, v.end)
            else:
                if has_own and s.weak:
                    continue
                if has_own:
                    changed |= self.constrain(v, other, x, role, relation, self.text[s.start : s.shown_end])
                    continue
            if role == CHILD:
                if isinstance(v, (V.Forced, V.Use)):
                    self.state[v] = self.force(v, x)
                else:
                    filters = filters or other.filters
                    found = self.graph.derive_children(x.nodes.df, bool(relation & REFS), bool(relation & HAS), not other.unnest, x.nodes.objects)
                    self.state[v] = self.select(other, filters, None, self.above(other), self.below(other), among=found)
            elif isinstance(v, V.Use) and v.forced:
                self.kept.setdefault(v, x)
                self.state[v] = None
            else:
                self.state[v] = x
            changed = True
        return changed

    def force(self, v: V.Verb, parents: Selection) -> Selection:
        """The selection held back, with an edge to each of its nodes from each of the parents."""
        own = self.kept.get(v)
        if own is None:
            return Selection(Nodes(local(self.spark, [], NODE_SCHEMA), 0), [])
        parts = [Part(p.graph, p.origin, SKIP, p.below) for p in own.parts]
        parts.append(Part(self.graph, Nodes(local(self.spark, [], NODE_SCHEMA), 0), SKIP, SKIP, (parents.nodes, own.nodes)))
        return Selection(own.nodes, parts)

    def tell_parent(self, s: Statement, parent: Statement) -> bool:
        """A parent hears from all of its children at once, when the last of them is resolved."""
        if not all(self.resolved(c) for c in parent.children):
            return False
        found = []
        for c in parent.children:
            echo = c.weak and c.is_unit and all(x.weak for x in walk(c.children))
            x = None if echo or not c.selectors else self.selection(c)
            if x is not None:
                found.append(x)
        if not found:
            return False
        merged = found[0] if len(found) == 1 else self.union(found)
        changed, derived, filters = False, None, None
        for v in parent.selectors:
            if self.state.get(v) is not None:
                changed |= self.constrain(v, parent, merged, PARENT, s.relation, "its scope")
                continue
            if derived is None:
                filters = parent.filters
                derived = self.graph.derive_parents(merged.nodes.df, bool(s.relation & REFS), bool(s.relation & HAS), not parent.unnest, merged.nodes.objects, merged.nodes.symbols, merged.nodes.span)
            self.state[v] = self.select(parent, filters, None, self.above(parent), Limits([merged.nodes.df] if merged.nodes.count else []), among=derived)
            changed = True
        return changed

    def constrain(self, v: V.Verb, owner: Statement, other: Selection, role: str, relation: int, context: str | None) -> bool:
        """Keep the nodes that are related to ``other``; whether any went."""
        own = self.state[v]
        key = (v, own.nodes, other.nodes, role)
        if not own.nodes.count or any(all(a is b for a, b in zip(k, key)) for k in self.settled):
            return False
        nodes = own.nodes.df
        if role == USER:
            left = nodes.join(other.nodes.df.select("instance_id"), "instance_id", "left_semi")
        else:
            symbols, instances = (self._by_child if role == PARENT else self._by_parent)(own, other, relation)
            left = nodes
            if symbols is not None and instances is not None:
                left = left.join(symbols.distinct().withColumn("by_symbol", F.lit(True)), "symbol_id", "left")
                left = left.join(instances.distinct().withColumn("by_instance", F.lit(True)), "instance_id", "left")
                left = left.where(F.col("by_symbol").isNotNull() | F.col("by_instance").isNotNull())
            elif symbols is not None:
                left = left.join(symbols, "symbol_id", "left_semi")
            else:
                left = left.where(F.lit(False)) if instances is None else left.join(instances, "instance_id", "left_semi")
        kept = Nodes.of(left)
        if kept.count == own.nodes.count:
            self.settled.append(key)
            return False
        self.state[v] = own.with_nodes(kept)
        self.settled.append((v, kept, other.nodes, role))
        if not kept.count and context is not None:
            owner.warnings.append(Warning_("note", f"nothing is left of the statement after what {context} asks for", v.start, v.end))
        return True

    def _by_child(self, own: Selection, child: Selection, relation: int) -> tuple[DataFrame | None, DataFrame | None]:
        """Symbols that refer to, and instances that contain, what is now in ``child``; of ``own`` alone."""
        symbols, instances = [], []
        now = child.nodes.df
        for p in child.parts:
            if relation & REFS and p.forced is not None:
                symbols.append(p.parents().join(now.select(F.col("symbol_id").alias("to_symbol")), "to_symbol", "left_semi").select(F.col("from_symbol").alias("symbol_id")))
            elif relation & REFS and p.above is not SKIP and p.origin.count:
                # a part that is alone selected all that is left
                to = now.select("symbol_id") if len(child.parts) == 1 else now.select("symbol_id").join(p.origin.df.select("symbol_id"), "symbol_id", "left_semi")
                sites, n = settle(p.graph.sites_to(to, child.nodes.symbols, child.nodes.span))
                if n:
                    symbols.append(p.graph.symbols_referring(to, own.nodes.df, None if p.above is None else p.above.instances(p.graph), sites))
            if relation & HAS and p.origin.count:
                here = now if len(child.parts) == 1 else now.join(p.origin.df.select("instance_id"), "instance_id", "left_semi")
                instances.append(p.graph.around(own.nodes.df, here).select(F.col("up").alias("instance_id")))
        return _union(symbols) if symbols else None, _union(instances) if instances else None

    def _by_parent(self, own: Selection, parent: Selection, relation: int) -> tuple[DataFrame | None, DataFrame | None]:
        """Symbols that are referred to by, and instances that lie in, what is now in ``parent``; of ``own`` alone."""
        symbols, instances = [], []
        now = parent.nodes.df
        for p in parent.parts:
            if relation & REFS and p.below is not SKIP and p.origin.count:
                sites, n = settle(p.graph.sites_to(own.nodes.df, own.nodes.symbols, own.nodes.span))
                if n:
                    from_ = p.origin.df.join(now.select("symbol_id"), "symbol_id", "left_semi")
                    symbols.append(p.graph.symbols_referred(from_, own.nodes.df, None if p.below is None else p.below.instances(p.graph), sites))
            if relation & HAS and p.origin.count:
                here = now if len(parent.parts) == 1 else now.join(p.origin.df.select("instance_id"), "instance_id", "left_semi")
                instances.append(p.graph.around(here, own.nodes.df).select(F.col("down").alias("instance_id")))
        return _union(symbols) if symbols else None, _union(instances) if instances else None

    # results:

    def execute(self) -> Result:
        from spanforge.operators import results

        self.seed()
        self.propagate()
        found = [(s, x) for s, x in ((s, self.selection(s)) for s in self.statements) if x is not None]
        nodes = results.merge_nodes(self.graph, [(x.nodes.df, s.start, s.shown_end, self.text[s.start : s.shown_end]) for s, x in found if x.nodes.count])
        near = Nodes.together([x.nodes for _, x in found]).objects if found else None
        explicit, forced = [], []
        for _, x in found:
            for p in x.parts:
                if p.forced is not None:
                    forced.append(p.parents())
                    continue
                explicit += [e for e in (p.children(), p.parents()) if e is not None]
        graph = self.graph
        plain = Lazy({"nodes": lambda: settle(nodes.select("instance_id", "symbol_id", "object_id", "start", "end", "level"))[0]})
        return Result(
            nodes,
            Lazy(
                {
                    "nodes": lambda: results.describe(graph, nodes),
                    "ref_edges": lambda: results.ref_edges(graph, plain["nodes"], _union(explicit) if explicit else None, _union(forced) if forced else None, near),
                    "has_edges": lambda: results.has_edges(graph, plain["nodes"]),
                }
            ),
            self.enrich(results.merge_warnings([w for s in self.statements for w in s.warnings])),
            self.activations,
        )

    def enrich(self, warnings: list[Warning_]) -> list[Warning_]:
        """For names that matched nothing: whether the name exists at all, or else which are like it."""
        for w in warnings:
            if w.kind == "no_match" and w.token:
                p = V.name_predicate(w.token)
                if p is not None and not self.graph.select(p).limit(1).isEmpty():
                    w.name_exists = True
                else:
                    w.suggestions = self.index.suggest(w.token, graph=self.graph)
        return warnings


class IndexLike:
    """What a run needs of an index."""

    spark: SparkSession
    layers: Layers

    def chain(self) -> Chain: ...

    def graph(self, chain: Chain) -> Graph: ...

    def suggest(self, name: str, limit: int = 5, graph: Graph | None = None) -> list[str]: ...


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
