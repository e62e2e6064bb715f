"""Graph tables bound to the layers of a request, and the joins between occurrences.

A *node* is an occurrence (instance) of a symbol: a byte range [start, end) of an
object.  Every join carries the object as an equality, so it is partitioned by
it; the byte ranges are a residual condition.  Where single objects are large
(``by_cells``), joins are by cells too: a range belongs to the smallest cell of a
fixed grid that holds it whole, and what contains a range belongs to a cell around
that range's start.  Few ranges share a cell, so the work follows the result and
not the square of an object, and one object's rows are spread over tasks.

Ids from a request are DataFrames, joined by ``left_semi``; nothing is collected
here and no side is broadcast by hint: adaptive execution does that for sides it
has measured.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.schema import CONTENT, LAYERED, SYMBOL_TYPES, TABLES
from spanforge.storage import Lazy

NODE = ["instance_id", "symbol_id", "object_id", "start", "end", "instance_type", "symbol_type", "level", "project_id", "layer"]
NODE_SCHEMA = "instance_id long, symbol_id long, object_id long, start int, end int, instance_type int, symbol_type int, level int, project_id int, layer long"
REF_EDGE = ["from_instance", "from_symbol", "to_instance", "to_symbol", "ref_id", "object_id", "start", "end"]
HAS_EDGE = ["parent_instance", "parent_symbol", "child_instance", "child_symbol", "parent_span"]


def level_of(symbol_type: Column) -> Column:
    out = F.lit(SYMBOL_TYPES[CONTENT][2])
    for i, (_, _, level, _) in SYMBOL_TYPES.items():
        out = F.when(symbol_type == i, level).otherwise(out)
    return out.cast("int")


def contains(outer: str, inner: str) -> Column:
    """Whether range ``outer`` (alias) contains ``inner``; an empty range is inside everything."""
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (i("start") >= i("end")) | ((o("start") <= i("start")) & (o("end") >= i("end")) & (o("start") < o("end")))


def differs(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") != F.col(f"{b}.start")) | (F.col(f"{a}.end") != F.col(f"{b}.end"))


#: cells of 2**8 .. 2**28 bytes, and the whole object
CELL_BITS = (8, 12, 16, 20, 24, 28, 32)


def _cell(start: Column, bits: int) -> Column:
    at = F.shiftright(start, bits).cast("long") if bits < 32 else F.lit(0).cast("long")
    return F.lit(bits << 33) + at


def own_cell(start: Column, end: Column) -> Column:
    """The smallest cell that holds a range."""
    last = F.greatest(end - 1, start)
    out = _cell(start, CELL_BITS[-1])
    for bits in CELL_BITS[-2::-1]:
        out = F.when(F.shiftright(start, bits) == F.shiftright(last, bits), _cell(start, bits)).otherwise(out)
    return out


def cells_around(start: Column, end: Column, sizes: "tuple[int, ...]" = CELL_BITS) -> Column:
    """The cells (of some ``sizes``) that hold a range: what contains the range has one of them as its own."""
    last = F.greatest(end - 1, start)
    every = [F.when(F.shiftright(start, bits) == F.shiftright(last, bits), _cell(start, bits)) if bits < 32 else _cell(start, bits) for bits in CELL_BITS if bits in sizes]
    return F.array_compact(F.array(*every)) if every else F.array().cast("array<long>")


@dataclass(frozen=True)
class Cells:
    """Joins by cells in some objects, where what may contain a range has cells of these sizes alone."""

    objects: "bool | list[int] | DataFrame"
    sizes: tuple[int, ...]


def containment_join(outer: DataFrame, inner: DataFrame, condition: Column | None = None, by_cells: "bool | list[int] | DataFrame" = False, how: str = "inner", key: "list[str] | None" = None) -> DataFrame:
    """Pairs of ``outer`` (alias o) and ``inner`` (alias i) of one object where outer contains inner.

    ``by_cells``: whether joins are by cells; or the objects (ids, or a table of ``object_id``) in which alone they are.
    ``how`` may be "left_anti": the rows of ``inner`` that nothing contains (alias i); ``key``: columns that tell its rows
    apart, with the columns of its range (all columns, if None).
    """
    sizes = CELL_BITS
    if isinstance(by_cells, Cells):
        by_cells, sizes = by_cells.objects, by_cells.sizes
    if isinstance(by_cells, bool):
        return _by_cells(outer, inner, condition, how, key, sizes) if by_cells else _by_object(outer, inner, condition, how)
    if isinstance(by_cells, list):
        if not by_cells:
            return _by_object(outer, inner, condition, how)
        large = F.col("object_id").isin(by_cells)
        (few, many), (of_few, of_many) = (((df.where(~large), df.where(large))) for df in (outer, inner))
    else:
        (few, many), (of_few, of_many) = ((df.join(by_cells, "object_id", "left_anti"), df.join(by_cells, "object_id", "left_semi")) for df in (outer, inner))
    small, wide = _by_object(few, of_few, condition, how), _by_cells(many, of_many, condition, how, key, sizes)
    if how != "inner":
        return small.select("i.*").union(wide.select("i.*")).alias("i")
    sides = [F.col(f"{side}.{c}") for side, df in (("o", outer), ("i", inner)) for c in df.columns]  # a union keeps the aliases of its first part
    return small.select(*sides).union(wide.select(*sides))


def _rule(condition: Column | None) -> Column:
    same = F.col("o.object_id") == F.col("i.object_id")
    return same & contains("o", "i") if condition is None else same & contains("o", "i") & condition


def _by_object(outer: DataFrame, inner: DataFrame, condition: Column | None, how: str) -> DataFrame:
    o, i = outer.alias("o"), inner.alias("i")
    return o.join(i, _rule(condition)) if how == "inner" else i.join(o, _rule(condition), how)


def _by_cells(outer: DataFrame, inner: DataFrame, condition: Column | None, how: str, key: "list[str] | None", sizes: "tuple[int, ...]") -> DataFrame:
    wide = outer.where("start < end").withColumn("cell", own_cell(F.col("start"), F.col("end"))).alias("o")
    full, empty = inner.where("start < end"), inner.where("start >= end")
    spread = full.withColumn("cell", F.explode(cells_around(F.col("start"), F.col("end"), sizes))).alias("i")
    hit = _rule(condition) & (F.col("o.cell") == F.col("i.cell"))
    # an empty range is inside everything of its object
    if how == "inner":
        none = F.lit(None).cast("long")
        return wide.join(spread, hit).union(outer.withColumn("cell", none).alias("o").join(empty.withColumn("cell", none).alias("i"), _rule(condition)))
    # what is contained is told by its own columns: a number for each row would have to be the same whenever rows are read
    # again, and their order after a shuffle isn't
    own = list(dict.fromkeys(["object_id", "start", "end", *(key or inner.columns)]))
    inside = spread.join(wide, hit, "left_semi").select(*own).distinct()
    left = full.alias("i").join(inside.alias("x"), _equal("i", "x", own), "left_anti")
    return left.union(empty.alias("i").join(outer.alias("o"), _rule(condition), "left_anti")).alias("i")


def _equal(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def normal_ranges(df: DataFrame) -> DataFrame:
    """All empty ranges are one and the same."""
    void = F.col("start") >= F.col("end")
    return df.withColumns({c: F.when(void, 0).otherwise(F.col(c)) for c in ("start", "end")})


def join_nodes(instances: DataFrame, symbols: DataFrame) -> DataFrame:
    """Instances with what is asked of their symbols."""
    return instances.alias("n").join(symbols.alias("s"), F.col("n.symbol") == F.col("s.id")).select(
        F.col("n.id").alias("instance_id"),
        F.col("s.id").alias("symbol_id"),
        "n.object_id",
        "n.start",
        "n.end",
        "n.instance_type",
        "s.symbol_type",
        level_of(F.col("s.symbol_type")).alias("level"),
        "s.project_id",
        "n.layer",
        "s.name",
        "s.symbol_path",
        "s.leaf_name",
    )


class Graph:
    """The tables of one request: base rows and overlay rows, restricted to the visible layers."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], visible: list[int], overlay: dict[str, list[DataFrame]] | None = None, by_cells: "bool | list[int] | DataFrame | Callable" = False):
        self.spark, self.visible, self._by_cells = spark, list(visible), by_cells
        self.stored, self.overlay = tables, overlay or {}
        self.tables = Lazy({name: partial(self._bound, name) for name in TABLES})

    @cached_property
    def by_cells(self) -> "bool | list[int] | DataFrame | Cells":
        """In which objects joins are by cells, with the sizes of cell that their nodes have: a range is repeated for no other."""
        objects = self._by_cells() if callable(self._by_cells) else self._by_cells
        if objects is False or objects == []:
            return False
        nodes = self.places
        if isinstance(objects, list):
            nodes = nodes.where(F.col("object_id").isin(objects))
        elif isinstance(objects, DataFrame):
            nodes = nodes.join(objects, "object_id", "left_semi")
        bits = F.shiftright(own_cell(F.col("start"), F.col("end")), 33)
        return Cells(objects, tuple(sorted(r.bits for r in nodes.where("start < end").select(bits.cast("int").alias("bits")).distinct().collect())))

    def _bound(self, name: str) -> DataFrame:
        df = self.stored[name]
        for extra in self.overlay.get(name, []):
            df = df.unionByName(extra)
        if name in LAYERED:
            df = df.where(F.col("layer").isin(self.visible) if self.visible else F.lit(False))
        return normal_ranges(df) if name in ("symbol_instances", "symbol_refs") else df

    @cached_property
    def nodes(self) -> DataFrame:
        """Every node with the columns that predicates use.

        Stored ones were joined with their symbols at ingest, so only those of overlay layers are joined here.
        """
        if "nodes" not in self.stored:
            return join_nodes(self.tables["symbol_instances"], self.tables["symbols"])
        out = self.stored["nodes"].where(F.col("layer").isin(self.visible) if self.visible else F.lit(False))
        for extra in self.overlay.get("symbol_instances", []):
            out = out.unionByName(join_nodes(normal_ranges(extra), self.tables["symbols"]))
        return out

    @cached_property
    def places(self) -> DataFrame:
        """The columns of ``nodes`` that joins by range use: no names are read for them."""
        return self.nodes.select("instance_id", "symbol_id", "object_id", "start", "end", "level")

    def within(self, objects: "list[int] | None") -> "Graph":
        """The same graph with the occurrences and references of some objects alone: a filter that reaches the scan.

        Rows are stored in order of their objects, so few row groups are read.  None: no limit.
        """
        if objects is None:
            return self
        out = copy.copy(self)
        inside = F.col("object_id").isin(objects) if objects else F.lit(False)
        out.__dict__ |= {"nodes": self.nodes.where(inside), "places": self.places.where(inside), "refs": self.refs.where(inside)}
        return out

    def select(self, predicate: Column | None = None, ids: DataFrame | None = None, project: Column | None = None, among: DataFrame | None = None) -> DataFrame:
        """Nodes that satisfy a predicate and are among ``ids``, or of rows of ``nodes`` that were found; their object and project must exist."""
        df = self.nodes if among is None else among
        if ids is not None:
            df = df.join(ids.select("instance_id"), "instance_id", "left_semi")
        if predicate is not None:
            df = df.where(predicate)
        projects = self.tables["projects"].select(F.col("id").alias("project_id"), "project_name")
        df = df.join(projects, "project_id")
        if project is not None:
            df = df.where(project)
        df = df.select(*NODE) if among is None else df.select(*NODE).distinct()
        return df.join(self.tables["objects"].select(F.col("id").alias("object_id")), "object_id", "left_semi").select(*NODE)

    # references:

    @cached_property
    def refs(self) -> DataFrame:
        return self.tables["symbol_refs"].select(F.col("id").alias("ref_id"), "to_symbol", F.col("from_object").alias("object_id"), "start", "end")

    def _named(self, side: str = "") -> list[Column]:
        """The columns of nodes under names of their own: what a join finds is whole, and need not be looked up again."""
        return [F.col(f"{side}{c}").alias(f"n_{c}") for c in self.nodes.columns]

    def _found(self, joined: DataFrame) -> DataFrame:
        return joined.select(*[F.col(f"n_{c}").alias(c) for c in self.nodes.columns])

    def ref_children(self, parents: DataFrame, direct: bool = False, outer: bool = False, near: "list[int] | None" = None) -> DataFrame:
        return self._ref_children(parents, direct, outer, near).select(*REF_EDGE)

    def _ref_children(self, parents: DataFrame, direct: bool, outer: bool, near: "list[int] | None") -> DataFrame:
        """References made inside ``parents`` (which lie in the objects ``near``, if given) with the occurrences of their targets.

        ``direct``: not where a container of no higher level lies between.  ``outer``: not for a parent inside another one.
        """
        p = parents.select("instance_id", "symbol_id", "object_id", "start", "end", "level")
        if outer:
            p = containment_join(p, p, (F.col("i.instance_id") != F.col("o.instance_id")) & differs("i", "o"), self.by_cells, "left_anti", ["instance_id"]).select("i.*")
        own = self.within(near)
        sites = containment_join(p, own.refs, by_cells=self.by_cells).select(
            F.col("o.instance_id").alias("from_instance"),
            F.col("o.symbol_id").alias("from_symbol"),
            F.col("o.start").alias("p_start"),
            F.col("o.end").alias("p_end"),
            F.col("o.level").alias("p_level"),
            *[F.col(f"i.{c}") for c in self.refs.columns],
        )
        if direct:
            sites = own._without_container(sites)
        to = self.nodes.select(F.col("instance_id").alias("to_instance"), F.col("symbol_id").alias("to_symbol"), *self._named())
        return sites.join(to, "to_symbol")

    def _without_container(self, sites: DataFrame) -> DataFrame:
        """Sites (with their parent's ``p_``) that no other node of the parent's level or below holds inside the parent."""
        between = (
            ((F.col("o.start") != F.col("i.p_start")) | (F.col("o.end") != F.col("i.p_end")))
            & (F.col("o.instance_id") != F.col("i.from_instance"))
            & (F.col("o.level") <= F.col("i.p_level"))
            # an empty node is in every parent, and holds empty sites alone
            & (((F.col("i.p_start") <= F.col("o.start")) & (F.col("i.p_end") >= F.col("o.end")) & (F.col("o.start") < F.col("o.end"))) | ((F.col("o.start") >= F.col("o.end")) & (F.col("i.start") >= F.col("i.end"))))
        )
        return containment_join(self.places, sites, between, self.by_cells, "left_anti", ["from_instance", "ref_id"]).select("i.*")

    def refs_to(self, symbols: "list[int] | None" = None, span: "tuple[int, int] | None" = None) -> DataFrame:
        """References to some symbols: to these alone, or to none outside a span of ids; a filter that reaches the scan."""
        if symbols is not None:
            return self.refs.where(F.col("to_symbol").isin(symbols) if symbols else F.lit(False))
        return self.refs if span is None else self.refs.where(F.col("to_symbol").between(*span))

    def ref_parents(self, children: DataFrame, symbols: "list[int] | None" = None, span: "tuple[int, int] | None" = None) -> DataFrame:
        return self._ref_parents(children, symbols, span).select(*REF_EDGE)

    def _ref_parents(self, children: DataFrame, symbols: "list[int] | None", span: "tuple[int, int] | None") -> DataFrame:
        """References to the symbols of ``children`` (these ``symbols`` or this ``span`` of them alone, if given), with every occurrence that contains their sites."""
        to = children.select(F.col("instance_id").alias("to_instance"), F.col("symbol_id").alias("to_symbol"))
        sites = self.refs_to(symbols, span).join(to, "to_symbol")
        return containment_join(self.nodes, sites, by_cells=self.by_cells).select(
            F.col("o.instance_id").alias("from_instance"), F.col("o.symbol_id").alias("from_symbol"), "i.to_instance", "i.to_symbol", "i.ref_id", "i.object_id", "i.start", "i.end", *self._named("o.")
        )

    def edges_between(self, nodes: DataFrame, near: "list[int] | None" = None) -> DataFrame:
        """One edge for each node and reference in it to another of ``nodes``: to the smallest occurrence of the target."""
        n = nodes.select("instance_id", "symbol_id", "object_id", "start", "end").distinct()
        to = n.select(F.col("instance_id").alias("to_instance"), F.col("symbol_id").alias("to_symbol"))
        sites = self.within(near).refs.join(to, "to_symbol")
        return (
            containment_join(n, sites, F.col("o.instance_id") != F.col("i.to_instance"), self.by_cells)
            .groupBy(F.col("o.instance_id").alias("from_instance"), F.col("o.symbol_id").alias("from_symbol"), "i.to_symbol", "i.ref_id", "i.object_id", "i.start", "i.end")
            .agg(F.min("i.to_instance").alias("to_instance"))
            .select(*REF_EDGE)
        )

    # containment:

    def has_children(self, parents: DataFrame, direct: bool = False) -> DataFrame:
        return self._edges(self._has_children(parents, direct))

    def _has_children(self, parents: DataFrame, direct: bool) -> DataFrame:
        """Occurrences inside ``parents`` of no higher level; ``direct``: with nothing between."""
        p = parents.select("instance_id", "symbol_id", "object_id", "start", "end", "level")
        pairs = self._pairs(containment_join(p, self.nodes, (F.col("o.level") >= F.col("i.level")) & (F.col("o.instance_id") != F.col("i.instance_id")), self.by_cells), "i.")
        return self._without_middle(pairs, levels=True) if direct else pairs

    def has_parents(self, children: DataFrame, innermost: bool = False) -> DataFrame:
        return self._edges(self._has_parents(children, innermost))

    def _has_parents(self, children: DataFrame, innermost: bool) -> DataFrame:
        """Occurrences of no lower level around ``children``; ``innermost``: with nothing between."""
        c = children.select("instance_id", "symbol_id", "object_id", "start", "end", "level")
        pairs = self._pairs(containment_join(self.nodes, c, (F.col("o.level") >= F.col("i.level")) & (F.col("o.instance_id") != F.col("i.instance_id")), self.by_cells), "o.")
        return self._without_middle(pairs, levels=False) if innermost else pairs

    def _pairs(self, joined: DataFrame, found: str) -> DataFrame:
        cols = ("instance_id", "symbol_id", "start", "end", "level")
        return joined.select(F.col("o.object_id"), *[F.col(f"o.{c}").alias(f"p_{c}") for c in cols], *[F.col(f"i.{c}").alias(f"c_{c}") for c in cols], *self._named(found))

    def _without_middle(self, pairs: DataFrame, levels: bool) -> DataFrame:
        """Pairs with nothing between them; ``levels``: nothing of the parent's level or below."""
        m, x = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"i.{c}"))
        between = (
            ((m("start") != x("p_start")) | (m("end") != x("p_end")))
            & ((m("start") != x("start")) | (m("end") != x("end")))
            & (m("instance_id") != x("p_instance_id"))
            & (m("instance_id") != x("c_instance_id"))
            & (x("p_start") <= m("start"))
            & (x("p_end") >= m("end"))
        )
        if levels:
            between = between & (x("p_level") >= m("level"))
        # an empty middle would have to hold an empty child, and differ from it: all empty ranges are equal, so none does
        inner = pairs.withColumnsRenamed({"c_start": "start", "c_end": "end"})
        return containment_join(self.places.where("start < end"), inner, between, self.by_cells, "left_anti", ["p_instance_id", "c_instance_id"]).select("i.*").withColumnsRenamed({"start": "c_start", "end": "c_end"})

    @staticmethod
    def _edges(pairs: DataFrame) -> DataFrame:
        return pairs.select(
            F.col("p_instance_id").alias("parent_instance"),
            F.col("p_symbol_id").alias("parent_symbol"),
            F.col("c_instance_id").alias("child_instance"),
            F.col("c_symbol_id").alias("child_symbol"),
            (F.col("p_end").cast("long") - F.col("p_start")).alias("parent_span"),
        )

    # what is related to a set, among the nodes of another:

    def sites_to(self, to: DataFrame, symbols: "list[int] | None" = None, span: "tuple[int, int] | None" = None) -> DataFrame:
        """References to the symbols of ``to`` (these ``symbols``, or inside this ``span``, if given)."""
        return self.refs_to(symbols, span).join(to.select(F.col("symbol_id").alias("to_symbol")), "to_symbol", "left_semi")

    def symbols_referring(self, to: DataFrame, among: DataFrame, sources: DataFrame | None, sites: DataFrame | None = None) -> DataFrame:
        """``symbol_id`` of those of ``among`` with an occurrence (one of ``sources``, if given) around a reference to a symbol of ``to`` (``sites``, if known)."""
        places = self.places.join(among.select("symbol_id"), "symbol_id", "left_semi")
        if sources is not None:
            places = places.join(sources, "instance_id", "left_semi")
        sites = self.sites_to(to) if sites is None else sites
        return containment_join(places, sites, by_cells=self.by_cells).select("o.symbol_id").distinct()

    def symbols_referred(self, parents: DataFrame, among: DataFrame, targets: DataFrame | None, sites: DataFrame | None = None) -> DataFrame:
        """``symbol_id`` of those of ``among``, with an occurrence (one of ``targets``, if given), that ``parents`` refer to (at ``sites``, if those to ``among`` are known)."""
        sites = self.sites_to(among) if sites is None else sites
        if targets is not None:
            places = self.places.select("symbol_id", "instance_id").join(among.select("symbol_id"), "symbol_id", "left_semi")
            wanted = places.join(targets, "instance_id", "left_semi").select(F.col("symbol_id").alias("to_symbol"))
            sites = sites.join(wanted, "to_symbol", "left_semi")
        p = parents.select("instance_id", "symbol_id", "object_id", "start", "end", "level")
        return containment_join(p, sites, by_cells=self.by_cells).select(F.col("i.to_symbol").alias("symbol_id")).distinct()

    def _sees(self, nodes: DataFrame) -> DataFrame:
        return nodes.where(F.col("layer").isin(self.visible) if self.visible else F.lit(False)).select("instance_id", "symbol_id", "object_id", "start", "end", "level")

    def around(self, outer: DataFrame, inner: DataFrame) -> DataFrame:
        """``up`` and ``down``: instances of ``outer`` and those of ``inner`` that they contain, of no higher level."""
        pairs = containment_join(self._sees(outer), self._sees(inner), (F.col("o.level") >= F.col("i.level")) & (F.col("o.instance_id") != F.col("i.instance_id")), self.by_cells)
        return pairs.select(F.col("o.instance_id").alias("up"), F.col("i.instance_id").alias("down"))

    # derivation:

    def derive_children(self, parents: DataFrame, refs: bool, has: bool, direct: bool = True, near: "list[int] | None" = None) -> DataFrame:
        """The nodes that ``parents`` (in the objects ``near``, if given) refer to or contain; some more than once."""
        parts = []
        if has:
            parts.append(self._found(self.within(near)._has_children(parents, direct)))
        if refs:
            parts.append(self._found(self._ref_children(parents, direct, direct, near)))
        return self._union(parts)

    def derive_parents(self, children: DataFrame, refs: bool, has: bool, innermost: bool = True, near: "list[int] | None" = None, symbols: "list[int] | None" = None, span: "tuple[int, int] | None" = None) -> DataFrame:
        """The nodes that refer to or contain ``children`` (in the objects ``near``, of these ``symbols`` or this ``span`` of them, if given); some more than once."""
        parts = []
        if refs:
            parts.append(self._found(self._ref_parents(children, symbols, span)))
        if has:
            parts.append(self._found(self.within(near)._has_parents(children, innermost)))
        return self._union(parts)

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, parts) if parts else self.nodes.where(F.lit(False))
