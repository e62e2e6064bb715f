"""Overlay layers: rows of a request's own, cached by what they are made of.

Root layers have ids above 0, overlay layers below.  A layer belongs to one root;
the layers of a root form a chain in the order in which statements made them.  A
layer is found again by a hash of its inputs, so a repeated statement makes no
rows anew.  The registry lives with the driver, the rows are DataFrames; with a
``path``, layers are also written there and found again by later sessions.  A
layer's manifest is written last: one that was broken off is not there.  One
session at a time writes to a path.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.storage import drop_path, local, settle


@dataclass
class Layer:
    id: int
    root: int
    parent: int
    base: int | None
    truncated: bool
    rows: dict[str, DataFrame]
    needs: set[int] = field(default_factory=set)  # layers of symbols that its rows refer to
    used: float = field(default_factory=time.time)


@dataclass
class Activation:
    root: int
    layer: int
    created: bool
    truncated: bool
    role: str


def digest(*parts: object) -> str:
    h = hashlib.sha256()
    for p in parts:
        raw = p if isinstance(p, bytes) else repr(p).encode()
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


class Chain:
    """The layers a request sees: roots (project: layer) and what statements added to each."""

    def __init__(self, roots: dict[int, int], added: dict[int, list[int]] | None = None):
        self.roots, self.added = roots, {r: list((added or {}).get(r, [])) for r in roots.values()}

    def visible(self) -> list[int]:
        return [*self.roots.values(), *(x for chain in self.added.values() for x in chain)]

    def layers(self) -> list[int]:
        return [x for chain in self.added.values() for x in chain]

    def copy(self) -> "Chain":
        return Chain(self.roots, self.added)

    def push(self, found: "list[Layer]") -> None:
        for layer in found:
            if layer.id not in self.added[layer.root]:
                self.added[layer.root].append(layer.id)


MANIFEST = "id long, hash string, root long, parent long, base long, truncated boolean, needs array<long>, used double, tables array<string>, next map<string, long>"


class Layers:
    """The registry of all overlay layers of an index."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None) -> None:
        self.by_hash: dict[str, Layer] = {}
        self.by_id: dict[int, Layer] = {}
        self._next = {"layer": 0, "symbols": 0, "symbol_instances": 0, "symbol_refs": 0}
        self.spark, self.path = spark, path
        if path is not None:
            self._load()

    def _load(self) -> None:
        """The layers that earlier sessions wrote."""
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/*/manifest").collect()  # a row for each layer
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return
        for r in found:
            rows = {t: self.spark.read.parquet(f"{self.path}/{-r.id}/{t}") for t in r.tables}
            self.by_hash[r.hash] = self.by_id[r.id] = Layer(r.id, r.root, r.parent, r.base, r.truncated, rows, set(r.needs), r.used)
            self._next = {k: min(n, r.next[k]) for k, n in self._next.items()}

    def _store(self, key: str, layer: Layer) -> None:
        at = f"{self.path}/{-layer.id}"
        for table, df in list(layer.rows.items()):
            df.write.mode("overwrite").parquet(f"{at}/{table}")
            layer.rows[table] = self.spark.read.schema(df.schema).parquet(f"{at}/{table}")
        row = (layer.id, key, layer.root, layer.parent, layer.base, layer.truncated, sorted(layer.needs), layer.used, list(layer.rows), dict(self._next))
        local(self.spark, [row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")

    def _forget(self, ids: "set[int] | None" = None) -> None:
        if self.path is not None:
            for at in [self.path] if ids is None else [f"{self.path}/{-i}" for i in ids]:
                drop_path(self.spark, at)

    def fresh(self, kind: str, n: int = 1) -> int:
        """The first of n new ids; ids go down from -1."""
        first = self._next[kind] - 1
        self._next[kind] -= n
        return first

    def find(self, key: str) -> Layer | None:
        layer = self.by_hash.get(key)
        if layer:
            layer.used = time.time()
        return layer

    def make(self, key: str, root: int, parent: int, base: int | None, truncated: bool, rows: dict[str, DataFrame], needs: set[int]) -> Layer:
        """Register a layer; ``rows`` have no layer yet, and get ids where they have none."""
        layer = Layer(self.fresh("layer"), root, parent, base, truncated, {}, needs)
        for table, df in rows.items():
            kept, n = settle(df)
            if n:
                spread = kept.withColumn("layer", F.lit(layer.id).cast("long"))
                layer.rows[table] = spread if "id" in kept.columns else number(spread, self.fresh(table, n))
        if self.path is not None:
            self._store(key, layer)
        self.by_hash[key] = self.by_id[layer.id] = layer
        return layer

    def overlay(self, ids: list[int]) -> dict[str, list[DataFrame]]:
        out: dict[str, list[DataFrame]] = {}
        for i in ids:
            for table, df in self.by_id[i].rows.items():
                out.setdefault(table, []).append(df)
        return out

    # removal:

    def doomed(self, seeds: set[int]) -> set[int]:
        """The layers that can't stay without ``seeds``: chained or based on them, or holding rows that refer to theirs."""
        out = set(seeds) & set(self.by_id)
        while True:
            more = {x.id for x in self.by_id.values() if x.id not in out and (x.parent in out or x.base in out or x.needs & out)}
            if not more:
                return out
            out |= more

    def delete(self, seeds: set[int]) -> set[int]:
        gone = self.doomed(seeds)
        for i in gone:
            self.by_id.pop(i)
        self.by_hash = {k: x for k, x in self.by_hash.items() if x.id not in gone}
        self._forget(gone)
        return gone

    def purge(self, ttl: float, now: float | None = None) -> set[int]:
        """Delete the layers unused for ``ttl`` seconds, and those that depend on them."""
        edge = (now or time.time()) - ttl
        return self.delete({x.id for x in self.by_id.values() if x.used < edge})

    def clear(self) -> None:
        self.by_hash.clear()
        self.by_id.clear()
        self._forget()


def number(df: DataFrame, first: int) -> DataFrame:
    """Ids first, first - 1, .. in the order of all columns: ranks inside the parts of a range sort, and how many rows come before a part."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    ordered = settle(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("at", F.monotonically_increasing_id()))[0]
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each part
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r["count"]
    starts = local(df.sparkSession, before, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("part", part).join(starts, "part").withColumn("id", (F.lit(first) - rank).cast("long"))
    return settle(numbered.select("id", *df.columns))[0]


def doomed_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id`` of all that depends on ``seeds`` (id) by ``edges`` (id, needs), by rounds to the fixed point."""
    found, n = settle(seeds.select("id").distinct())
    front = found
    while True:
        new, k = settle(edges.join(front.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct().join(found, "id", "left_anti"))
        if not k:
            return found
        found, front = settle(found.union(new))[0], new
