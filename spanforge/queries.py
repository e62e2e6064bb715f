"""A query for each operator over the driver's tables, and the same in SQL.

The tables are read as a code graph (``sources.tpch``), ingested once for a
session into the shared folder and queried from there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import names, paths, similarity, text
from spanforge.index import Index
from spanforge.operators import results, search, tree
from spanforge.operators.graph import Graph, level_of
from spanforge.operators.layers import doomed_closure
from spanforge.plans import verbs as V
from spanforge.schema import DATA, DIRECTORY, FILE, FUNCTION, TABLES, TYPE
from spanforge.sources import ingest, tpch
from spanforge.sources.store import delete_stored, few_objects, write_tables
from spanforge.storage import Lazy, fresh_path, written

_stored: dict[tuple[str, str], Lazy] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over the tables of a folder; what a request needs of them is stored at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = tpch.tables(spark, sf_dir, written)
    made = _stored[key]
    return Index(spark, made, lambda: few_objects(made["large"]))


def query(name: str, sql: str | None = None, views: bool = True):
    def register(f: Callable[[Index, SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(index(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            ORACLES[name] = (tpch.SQL if views else "") + sql
        return f

    return register


def contains(p: str, c: str) -> str:
    return f"""({p}.object_id = {c}.object_id AND ({c}."start" >= {c}."end" OR ({p}."start" <= {c}."start" AND {p}."end" >= {c}."end" AND {p}."start" < {p}."end")))"""


def differ(a: str, b: str) -> str:
    return f"""({a}."start" <> {b}."start" OR {a}."end" <> {b}."end")"""


def ids(df: DataFrame) -> DataFrame:
    return df.select("instance_id")


# names and types:


def asked(name: str, text_: str, sql: str | None) -> None:
    """The nodes of a query in the language."""

    @query(name, sql)
    def _(i: Index, spark: SparkSession, sf_dir: str) -> DataFrame:
        return ids(i.query(text_).selected)


def selection(name: str, text_: str, where: str) -> None:
    """A query that selects nodes by what they are."""

    @query(name, f", wanted AS (SELECT instance_id, symbol_id FROM nodes WHERE {where}) SELECT * FROM wanted")
    def run(i: Index, spark: SparkSession, sf_dir: str) -> DataFrame:
        return i.query(text_).selected.select("instance_id", "symbol_id")


_IN_ASIA = "project_id IN (SELECT id FROM g_projects WHERE project_name = 'ASIA')"
_TOKENS = lambda a, b: f"list_contains(path, '{a}') AND list_contains(path[list_position(path, '{a}') + 1:], '{b}')"
selection("name_leaf", '"order_5"', "leaf = 'order_5'")
selection("name_compound", '"Brand#7.ECONOMY"', _TOKENS("Brand7", "ECONOMY"))
selection("name_compound_anchored", 'dir("AFRICA/NATION_5")', f"symbol_type = {DIRECTORY} AND leaf = 'NATION_5' AND list_contains(path[:-2], 'AFRICA')")
selection("name_exact", 'select filter("exact_name", "/AFRICA/NATION_5")', "name = '/AFRICA/NATION_5'")
selection("name_exact_glob", 'select filter("exact_name", g"brand#7.economy*")', "name ILIKE 'brand#7.economy%'")
selection("filter_compound", 'select filter("compound_name", "Brand#7.ECONOMY")', _TOKENS("Brand7", "ECONOMY"))
selection("name_glob_leaf", 'g"order_12*"', r"leaf ILIKE 'order\_12%' ESCAPE '\'")
selection("name_glob_leaf_ci", 'dir(g"nation_1*")', rf"symbol_type = {DIRECTORY} AND leaf ILIKE 'nation\_1%' ESCAPE '\'")
selection("name_glob_full", 'g"brand#7.economy*"', "name ILIKE 'brand#7.economy%'")
selection("name_glob_contains", 'func(g"der_77", match="contains")', rf"symbol_type = {FUNCTION} AND leaf ILIKE '%der\_77%' ESCAPE '\'")
selection("type_func", "select func", f"symbol_type = {FUNCTION}")
selection("type_multi", 'select filter("type", "dir,file")', f"symbol_type IN ({DIRECTORY}, {FILE})")
selection("filter_project", 'project("ASIA") select dir', f"symbol_type = {DIRECTORY} AND {_IN_ASIA}")
selection("ignore_name", 'ignore("NATION_7") select dir', f"symbol_type = {DIRECTORY} AND NOT list_contains(path, 'NATION_7')")
selection("ignore_package", 'ignore(g"*_5", package="Brand#7") select type', rf"symbol_type = {TYPE} AND NOT (leaf ILIKE '%\_5' ESCAPE '\' AND path[1] = 'Brand7' AND len(path) > 1)")
selection("namespace_filter", 'mod("Brand#3", filter="true") select', "list_contains(path, 'Brand3')")
selection("scope_is_empty", '"order_5"; scope', "leaf = 'order_5'")
selection("comments", '// a note\n"order_5" /* another\nnote */ "order_6"', "leaf IN ('order_5', 'order_6')")


@query("normalise_names", "SELECT id, array_to_string(path, '.') AS path, path[-1] AS leaf FROM g_symbols")
def _(i, spark, sf_dir):
    return i.tables["symbols"].select("id", F.array_join(names.path_column(F.col("name"), F.col("symbol_type")), ".").alias("path"), F.col("leaf_name").alias("leaf"))


@query("exists_probe", "SELECT count(*) > 0 AS found FROM nodes WHERE leaf = 'order_5'")
def _(i, spark, sf_dir):
    return i.graph().select(V.name_predicate("order_5")).limit(1).agg((F.count("*") > 0).alias("found"))


# joins:

_FILES = (f"symbol_type = {FILE}", lambda: F.col("symbol_type") == FILE)
_CODE = (f"symbol_type IN ({FUNCTION}, {DATA})", lambda: F.col("symbol_type").isin(FUNCTION, DATA))
_WHOLE = (f"symbol_type IN ({FUNCTION}, {DATA}, {TYPE})", lambda: F.col("symbol_type").isin(FUNCTION, DATA, TYPE))

_REF_CHILDREN = f'FROM (SELECT * FROM nodes WHERE {{p}}) p JOIN g_refs r ON {contains("p", "r")} JOIN nodes c ON c.symbol_id = r.to_symbol'
_HAS_CHILDREN = f'FROM (SELECT * FROM nodes WHERE {{p}}) p JOIN nodes c ON {contains("p", "c")} AND p.level >= c.level AND p.instance_id <> c.instance_id'
_HAS_PARENTS = f'FROM (SELECT * FROM nodes WHERE {{c}}) c JOIN nodes p ON {contains("p", "c")} AND p.level >= c.level AND p.instance_id <> c.instance_id'
_REFS = "SELECT p.instance_id AS from_instance, c.instance_id AS to_instance, r.id AS ref_id "
_HAS = "SELECT p.instance_id AS parent_instance, c.instance_id AS child_instance "
_NOT_DIRECT_HAS = f'NOT EXISTS (SELECT 1 FROM nodes m WHERE {contains("p", "m")} AND {contains("m", "c")} AND {differ("m", "p")} AND {differ("m", "c")} AND m.instance_id <> p.instance_id AND m.instance_id <> c.instance_id AND p.level >= m.level)'
_NOT_INNERMOST = _NOT_DIRECT_HAS.replace(" AND p.level >= m.level", "")
_NOT_DIRECT_REF = f'NOT EXISTS (SELECT 1 FROM nodes m WHERE {contains("p", "m")} AND {contains("m", "r")} AND {differ("m", "p")} AND m.instance_id <> p.instance_id AND m.level <= p.level)'


def _refs(df: DataFrame) -> DataFrame:
    return df.select("from_instance", "to_instance", "ref_id")


def _has(df: DataFrame) -> DataFrame:
    return df.select("parent_instance", "child_instance")


def join(name: str, kind: tuple[str, Callable], sql: str, run: Callable[[Graph, DataFrame], DataFrame]) -> None:
    @query(name, sql.replace("{p}", kind[0]).replace("{c}", kind[0]))
    def _(i: Index, spark: SparkSession, sf_dir: str) -> DataFrame:
        g = i.graph()
        return run(g, g.select(kind[1]()))


join("refs_children", _WHOLE, _REFS + _REF_CHILDREN, lambda g, n: _refs(g.ref_children(n)))
join("refs_parents", _WHOLE, _REFS + f'FROM (SELECT * FROM nodes WHERE {{c}}) c JOIN g_refs r ON c.symbol_id = r.to_symbol JOIN nodes p ON {contains("p", "r")}', lambda g, n: _refs(g.ref_parents(n)))
join("has_children", _FILES, _HAS + _HAS_CHILDREN, lambda g, n: _has(g.has_children(n)))
join("has_parents", _WHOLE, _HAS + _HAS_PARENTS, lambda g, n: _has(g.has_parents(n)))
join("direct_has", _FILES, _HAS + _HAS_CHILDREN + f" WHERE {_NOT_DIRECT_HAS}", lambda g, n: _has(g.has_children(n, direct=True)))
join("direct_refs", _CODE, _REFS + _REF_CHILDREN + f" WHERE {_NOT_DIRECT_REF}", lambda g, n: _refs(g.ref_children(n, direct=True)))
join("innermost_parent", _WHOLE, _HAS + _HAS_PARENTS + f" WHERE {_NOT_INNERMOST}", lambda g, n: _has(g.has_parents(n, innermost=True)))
_OUTER = f'NOT EXISTS (SELECT 1 FROM nodes q WHERE (q.{_CODE[0]}) AND q.instance_id <> p.instance_id AND {contains("q", "p")} AND {differ("q", "p")})'
join("outer_parent", _CODE, _REFS + _REF_CHILDREN + f" WHERE {_OUTER}", lambda g, n: _refs(g.ref_children(n, outer=True)))
join("binned_containment", _FILES, _HAS + _HAS_CHILDREN, lambda g, n: _has(Graph(g.spark, g.stored, g.visible, by_cells=True).has_children(n)))


@query(
    "edges_between",
    f', chosen AS (SELECT * FROM nodes WHERE {_WHOLE[0]}) SELECT p.instance_id AS from_instance, min(c.instance_id) AS to_instance, r.id AS ref_id FROM chosen p JOIN g_refs r ON {contains("p", "r")} JOIN chosen c ON c.symbol_id = r.to_symbol AND c.instance_id <> p.instance_id GROUP BY 1, 3',
)
def _(i, spark, sf_dir):
    g = i.graph()
    return _refs(g.edges_between(g.select(_WHOLE[1]())))


@query(
    "tightest_parent",
    f", chosen AS (SELECT * FROM nodes WHERE symbol_type IN ({FILE}, {FUNCTION}, {DATA})), pairs AS (SELECT p.instance_id AS parent_instance, c.instance_id AS child_instance, row_number() OVER (PARTITION BY c.instance_id ORDER BY p.\"end\" - p.\"start\", p.instance_id) AS k FROM chosen p JOIN chosen c ON {contains('p', 'c')} AND p.level >= c.level AND p.instance_id <> c.instance_id) SELECT parent_instance, child_instance FROM pairs WHERE k = 1",
)
def _(i, spark, sf_dir):
    g = i.graph()
    return _has(results.has_edges(g, g.select(F.col("symbol_type").isin(FILE, FUNCTION, DATA))))


# queries in the language:

_F5 = "f AS (SELECT * FROM nodes WHERE leaf = 'order_5')"
_IN = "SELECT c.* FROM {p} p JOIN nodes c ON " + f"{contains('p', 'c')} AND p.level >= c.level AND p.instance_id <> c.instance_id AND {_NOT_DIRECT_HAS}"
_TO = "SELECT c.* FROM {p} p JOIN g_refs r ON " + f"{contains('p', 'r')} AND {_NOT_DIRECT_REF} AND NOT EXISTS (SELECT 1 FROM {{p}} q WHERE q.instance_id <> p.instance_id AND {contains('q', 'p')} AND {differ('q', 'p')}) JOIN nodes c ON c.symbol_id = r.to_symbol"


def below(p: str) -> str:
    """Nodes that are derived below the nodes of ``p``."""
    return f"({_IN.format(p=p)} UNION {_TO.format(p=p)})"


def above(c: str) -> str:
    """Nodes that are derived above the nodes of ``c``."""
    around = f"SELECT p.* FROM {c} c JOIN nodes p ON {contains('p', 'c')} AND p.level >= c.level AND p.instance_id <> c.instance_id AND {_NOT_INNERMOST}"
    by_ref = f"SELECT p.* FROM {c} c JOIN g_refs r ON c.symbol_id = r.to_symbol JOIN nodes p ON {contains('p', 'r')}"
    return f"({around} UNION {by_ref})"


_ALL = lambda *sets: " UNION ".join(f"SELECT instance_id FROM {s}" for s in sets)

asked("callees_1hop", '"order_5" {}', f", {_F5}, c AS {below('f')} {_ALL('f', 'c')}")
_F2 = "f AS (SELECT * FROM nodes WHERE leaf IN ('order_5', 'line_1'))"
asked("default_refs_has", '"order_5" "line_1" {}', f", {_F2}, c AS {below('f')} {_ALL('f', 'c')}")
asked("unit_verb", '"order_5" "line_1" { _ }', f", {_F2}, c AS {below('f')} {_ALL('f', 'c')}")
asked("derive_has", '"order_5" "line_1" derive(type="has") {}', f", {_F2}, c AS ({_IN.format(p='f')}) {_ALL('f', 'c')}")
asked("derive_refs", '"order_5" "line_1" derive(type="refs") {}', f", {_F2}, c AS ({_TO.format(p='f')}) {_ALL('f', 'c')}")
asked("label_use", '@x "line_3"\n#x {}', f", f AS (SELECT * FROM nodes WHERE leaf = 'line_3'), c AS {below('f')} {_ALL('f', 'c')}")
asked("unnest_has", "select file has { unnest any }", f", f AS (SELECT * FROM nodes WHERE {_FILES[0]}), c AS (SELECT c.* {_HAS_CHILDREN.replace('{p}', _FILES[0])}) {_ALL('f', 'c')}")
asked("unnest_refs", "select file refs { unnest any }", f", f AS (SELECT * FROM nodes WHERE {_FILES[0]}), c AS (SELECT c.* {_REF_CHILDREN.replace('{p}', _FILES[0])}) {_ALL('f', 'c')}")
_P0 = "t AS (SELECT * FROM nodes WHERE symbol_type = 5 AND name LIKE '%\\_0' ESCAPE '\\')"
asked("callers_1hop", '{ type(g"*_0") }', f", {_P0}, u AS {above('t')} {_ALL('t', 'u')}")
_L2 = "t AS (SELECT * FROM nodes WHERE leaf = 'line_2')"
asked("callers_2hop", '{{ "line_2" }}', f", {_L2}, u AS {above('t')}, w AS {above('u')} {_ALL('t', 'u', 'w')}")
asked("mixed_refs_has", '"order_5" {{ type }}', f", {_F5}, c AS {below('f')}, d AS (SELECT * FROM {below('c')} WHERE symbol_type = {TYPE}) {_ALL('f', 'c', 'd')}")
_D5 = "f AS (SELECT * FROM nodes WHERE name = '/AFRICA/NATION_5')"
_ONLY = lambda p, kind: f"(SELECT * FROM ({_IN.format(p=p)}) WHERE symbol_type = {kind})"
asked("has_chain_3", 'dir("/AFRICA/NATION_5") has { file has { func } }', f", {_D5}, c AS {_ONLY('f', FILE)}, d AS {_ONLY('c', FUNCTION)} {_ALL('f', 'c', 'd')}")
_INSIDE = "SELECT DISTINCT p.instance_id AS up, c.instance_id AS down FROM (SELECT * FROM nodes WHERE {p}) p JOIN (SELECT * FROM nodes WHERE {c}) c ON " + f"{contains('p', 'c')} AND p.level >= c.level AND p.instance_id <> c.instance_id"
_BOTH = "SELECT up AS instance_id FROM pairs UNION SELECT down FROM pairs"
asked("constrain_by_child", '"order_5" { "line_2" }', f", pairs AS ({_INSIDE.format(p="leaf = 'order_5'", c="leaf = 'line_2'")}) {_BOTH}")
_FUNC_LINE = _INSIDE.format(p=f"symbol_type = {FUNCTION} AND leaf LIKE 'order%'", c="leaf = 'line_5'")
asked("constrain_by_parent", 'func(g"order*") { "line_5" }', f", pairs AS ({_FUNC_LINE}) {_BOTH}")
asked("label_intersect", '@x func(g"order*") { "line_5" }\n#x { "line_1" }', f", pairs AS ({_FUNC_LINE}), more AS ({_INSIDE.format(p='instance_id IN (SELECT up FROM pairs)', c="leaf = 'line_1'")}) {_BOTH} UNION SELECT down FROM more")
asked("sibling_union", '"order_5" { "line_1"; "line_2" }', f", pairs AS ({_INSIDE.format(p="leaf = 'order_5'", c="leaf IN ('line_1', 'line_2')")}) {_BOTH}")
asked("multi_selector_union", '"order_5" "order_6"', "SELECT instance_id FROM nodes WHERE leaf IN ('order_5', 'order_6')")
asked("any_strips_type", 'preamble func\nany type(g"*_7")\ng"*_8"', "SELECT instance_id FROM nodes WHERE symbol_type = 5 AND leaf ILIKE '%\\_7%' ESCAPE '\\' UNION SELECT instance_id FROM nodes WHERE symbol_type = 1 AND leaf ILIKE '%\\_8' ESCAPE '\\'")
asked("preamble_filter", 'preamble project("ASIA")\n"line_1"', "SELECT instance_id FROM nodes WHERE leaf = 'line_1' AND project_id IN (SELECT id FROM g_projects WHERE project_name = 'ASIA')")
asked(
    "overlay_ref",
    '@t type(g"*_0")\nlayer { ephemeral_ref(to_symbol="@t", from_object="1", start="1500", end="1510") }\nfile(g"customer#000000000*") refs { type(g"*_0") }',
    ", t AS (SELECT instance_id FROM nodes WHERE symbol_type = 5 AND leaf LIKE '%\\_0' ESCAPE '\\') SELECT instance_id FROM t UNION SELECT instance_id FROM nodes WHERE symbol_type = 2 AND object_id = 1",
)


@query("forced_edges", "SELECT p.instance_id AS from_instance, c.instance_id AS to_instance, CAST(0 AS BIGINT) AS ref_id FROM (SELECT * FROM nodes WHERE leaf = 'order_5') p CROSS JOIN (SELECT * FROM nodes WHERE leaf = 'order_6') c")
def _(i, spark, sf_dir):
    return _refs(i.query('"order_5" { !"order_6" }').ref_edges)


@query(
    "result_edges_dedup",
    f", {_F5}, c AS {below('f')}, d AS (SELECT * FROM {below('c')} WHERE symbol_type = {TYPE}), chosen AS (SELECT * FROM f UNION SELECT * FROM c UNION SELECT * FROM d) SELECT p.instance_id AS from_instance, min(x.instance_id) AS to_instance, min(r.id) AS ref_id FROM chosen p JOIN g_refs r ON {contains('p', 'r')} JOIN chosen x ON x.symbol_id = r.to_symbol GROUP BY p.instance_id, r.to_symbol, r.object_id, r.\"start\", r.\"end\"",
)
def _(i, spark, sf_dir):
    return _refs(i.query('"order_5" {{ type }}').ref_edges)


@query("symbol_cap_topk", ", chosen AS (SELECT n.symbol_id, min((o.path, n.\"start\")) AS place FROM nodes n JOIN g_objects o ON o.id = n.object_id WHERE n.symbol_type = 1 GROUP BY 1) SELECT symbol_id FROM chosen ORDER BY place, symbol_id LIMIT 10")
def _(i, spark, sf_dir):
    return results.cap(i.query("select func").nodes, 10)


_SPAN = lambda a, b, t: f"""{{"start":{a},"end":{b},"text":"\\"order_5\\"{t}"}}"""


@query("node_provenance", f", {_F5}, c AS {below('f')} SELECT instance_id, 2 AS n_statements, '[{_SPAN(0, 12, ' {}')},{_SPAN(14, 23, '')}]' AS statements FROM f UNION ALL SELECT instance_id, 1, '[{{\"start\":10,\"end\":12,\"text\":\"{{}}\"}}]' FROM c")
def _(i, spark, sf_dir):
    return i.query('"order_5" {}; "order_5"').nodes.select("instance_id", F.size("statements").alias("n_statements"), F.to_json("statements").alias("statements"))


@query("json_sink", f", {_F5}, c AS {below('f')} SELECT DISTINCT CAST(symbol_id AS VARCHAR) AS id, name AS label FROM (SELECT * FROM f UNION SELECT * FROM c)")
def _(i, spark, sf_dir):
    shown = json.loads(i.ask('"order_5" {}', timeout=None))
    return spark.createDataFrame([(n["id"], n["label"]) for n in shown["nodes"]], "id string, label string")


@query("markdown_sink", f", {_F5} SELECT DISTINCT name FROM f")
def _(i, spark, sf_dir):
    page = i.ask('"order_5"', form="markdown", timeout=None)
    return spark.createDataFrame([(x,) for x in sorted(set(re.findall(r"`(customer#[^`]*)`", page, re.I)))], "name string")


@query("no_match", "SELECT 'no_match' AS kind, (SELECT count(*) > 0 FROM g_symbols WHERE path[-1] = 'order_none') AS name_exists")
def _(i, spark, sf_dir):
    return spark.createDataFrame([(w.kind, w.name_exists) for w in i.query('"order_none"').warnings], "kind string, name_exists boolean")


@query("no_match_in_filter", "SELECT 'no_match' AS kind, (SELECT count(*) > 0 FROM g_symbols WHERE path[-1] = 'order_5') AS name_exists")
def _(i, spark, sf_dir):
    return spark.createDataFrame([(w.kind, w.name_exists) for w in i.query('preamble project("NOWHERE")\n"order_5"').warnings], "kind string, name_exists boolean")


@query("overlay_instance", "SELECT CAST(1 AS BIGINT) AS object_id, 4200 AS \"start\", 4210 AS \"end\", count(*) AS n FROM g_symbols WHERE symbol_type = 5 AND name LIKE '%\\_0' ESCAPE '\\'")
def _(i, spark, sf_dir):
    r = i.query('@t type(g"*_0")\nlayer { ephemeral_instance(symbol_id="@t", object_id="1", start="4200", end="4210", instance_type="1") }')
    return r.nodes.where("layer < 0").groupBy("object_id", "start", "end").agg(F.count("*").alias("n"))


_HOST = tpch.DOCUMENT_OBJECTS + 6


@query("overlay_symbol", "SELECT CAST(1 AS BIGINT) AS object_id, 4300 AS \"start\", 4310 AS \"end\", 'pkg.fresh_one' AS name")
def _(i, spark, sf_dir):
    # the second layer stands on the first: its row names an overlay symbol
    r = i.query('layer { ephemeral_symbol(name="pkg.fresh_one", project_id="1", symbol_type="1") }; layer { ephemeral_instance(symbol_id="-1", object_id="1", start="4300", end="4310", instance_type="1") }; "fresh_one"')
    return r.nodes.where("layer < 0").select("object_id", "start", "end", "name").distinct()


def _layer_rows(rows: str) -> str:
    return f"layer {{ {rows} }}"


@query("overlay_composite", "SELECT CAST(1 AS BIGINT) AS object_id, n * 10 AS \"start\", n * 10 + 5 AS \"end\" FROM (VALUES (441), (442)) AS v(n)")
def _(i, spark, sf_dir):
    one = i.query('"order_5"').nodes.first().symbol_id
    row = f'ephemeral_instance(symbol_id="{one}", object_id="1", start="{{0}}", end="{{1}}", instance_type="1")'
    r = i.query(f"{_layer_rows(row.format(4410, 4415))} {_layer_rows(row.format(4420, 4425))}")
    return r.nodes.where("layer < 0").select("object_id", "start", "end")


@query("suggest_names")
def _(i, spark, sf_dir):
    return similarity.suggest(i.tables["symbols"], "NATION5")


# content:


def _search_sql(needle: str, cased: bool, whole: bool, tail: str = "SELECT object_id, \"start\", \"end\" FROM hits") -> str:
    hay, pin = ("text", needle) if cased else ("lower(text)", needle.lower())
    word = "regexp_matches({}, '^[0-9A-Za-z_]$')"
    rule = f" AND NOT {word.format('before')} AND NOT {word.format('after')}" if whole else ""
    return f"""
SELECT * FROM (WITH store AS (SELECT DISTINCT sha256(text) AS content_hash, text FROM documents),
pieces AS (SELECT content_hash, unnest(string_split({hay}, '{pin}')) AS piece, generate_subscripts(string_split({hay}, '{pin}'), 1) AS k FROM store),
found AS (SELECT content_hash, k, piece, sum(strlen(piece)) OVER w + (k - 1) * {len(pin.encode())} AS pos, lead(piece) OVER (PARTITION BY content_hash ORDER BY k) AS following, count(*) OVER (PARTITION BY content_hash) AS n
  FROM pieces WINDOW w AS (PARTITION BY content_hash ORDER BY k ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT content_hash, pos, k, n, CASE WHEN piece <> '' THEN right(piece, 1) WHEN k > 1 THEN '{pin[-1]}' ELSE '' END AS before,
  CASE WHEN following <> '' THEN left(following, 1) WHEN k + 1 < n THEN '{pin[0]}' ELSE '' END AS after FROM found WHERE k < n),
hits AS (SELECT doc_id % 5 + 1 AS project_id, CAST(doc_id + {tpch.DOCUMENT_OBJECTS} AS BIGINT) AS object_id, CAST(pos AS INTEGER) AS "start", CAST(pos + {len(pin.encode())} AS INTEGER) AS "end" FROM marked JOIN documents ON sha256(text) = content_hash WHERE TRUE{rule})
{tail})
"""


def looked_for(name: str, needle: str, cased: bool, whole: bool) -> None:
    @query(name, _search_sql(needle, cased, whole), views=False)
    def _(i: Index, spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(i.graph(), needle, cased, whole, limit=None).select("object_id", "start", "end")


@query("overlay_search_then_has", _search_sql("the", False, False, f"SELECT object_id, \"start\", \"end\" FROM hits WHERE object_id = {_HOST}"), views=False)
def _(i, spark, sf_dir):
    host = f'@t type(g"*_0")\nlayer {{ ephemeral_instance(symbol_id="@t", object_id="{_HOST}", start="0", end="1000000", instance_type="1") }}'
    r = i.query(f'{host}\nhas {{ search("the", limit="1000000000") }}')
    return r.has_edges.join(r.nodes.select(F.col("instance_id").alias("child_instance"), "object_id", "start", "end"), "child_instance").select("object_id", "start", "end")


looked_for("search_substr_ci", "the", False, False)
looked_for("search_substr_cs", "The", True, False)
looked_for("search_whole_word_ci", "the", False, True)
looked_for("search_whole_word_cs", "The", True, True)


@query("search_limit_per_project", _search_sql("the", False, False, "SELECT * FROM (SELECT object_id, \"start\", \"end\", row_number() OVER (PARTITION BY project_id ORDER BY object_id, \"start\") AS n FROM hits) WHERE n <= 7"), views=False)
def _(i, spark, sf_dir):
    return search.search(i.graph(), "the", False, limit=7).where("n <= 7").select("object_id", "start", "end", F.col("n").cast("long").alias("n"))


@query("search_dedup_content", "SELECT sha256(text) AS content_hash, count(*) AS files FROM documents WHERE contains(lower(text), 'licensed') GROUP BY 1", views=False)
def _(i, spark, sf_dir):
    t = i.graph().tables
    store = t["content_store"].where(text.may_contain(F.col("content_text"), "licensed", False)).select("content_hash")
    return t["objects"].join(store, "content_hash", "left_semi").groupBy("content_hash").agg(F.count("*").alias("files"))


@query("loc_line", f"SELECT CAST(doc_id + {tpch.DOCUMENT_OBJECTS} AS BIGINT) AS object_id, CAST(strlen(string_split(text, chr(10))[1]) + 1 AS INTEGER) AS \"start\", CAST(strlen(string_split(text, chr(10))[1]) + 1 + strlen(string_split(text, chr(10))[2]) AS INTEGER) AS \"end\" FROM documents WHERE len(string_split(text, chr(10))) >= 2", views=False)
def _(i, spark, sf_dir):
    files = search.contents(i.graph()).where("content IS NOT NULL")
    return files.select("object_id", text.line_range(F.col("content"), 2).alias("r")).where("r IS NOT NULL").select("object_id", "r.start", "r.end")


_LOC = "SELECT CAST(doc_id + {0} AS BIGINT) AS object_id, CAST(strlen(string_split(text, chr(10))[1]) + 1 AS INTEGER) AS \"start\", CAST(strlen(string_split(text, chr(10))[1]) + 1 + strlen(string_split(text, chr(10))[2]) AS INTEGER) AS \"end\" FROM documents WHERE len(string_split(text, chr(10))) >= 2 AND doc_id = 6"


@query("loc_verb", _LOC.format(tpch.DOCUMENT_OBJECTS), views=False)
def _(i, spark, sf_dir):
    return i.query('loc("6.txt", "2")').nodes.select("object_id", "start", "end")


@query("search_verb", _search_sql("the", True, True), views=False)
def _(i, spark, sf_dir):
    return i.query('search("the", case="sensitive", whole_word="true", limit="1000000000")').nodes.select("object_id", "start", "end")


@query("search_smart_case", _search_sql("The", True, False), views=False)
def _(i, spark, sf_dir):
    return i.query('search("The", limit="1000000000")').nodes.select("object_id", "start", "end")


@query("search_verb_limit", _search_sql("the", False, False, "SELECT project_id, CAST(least(count(*), 500) AS BIGINT) AS n FROM hits GROUP BY 1"), views=False)
def _(i, spark, sf_dir):
    return i.query('search("the")').nodes.groupBy(F.col("project_id").cast("long").alias("project_id")).agg(F.count("*").alias("n"))


@query("read_lines", "SELECT string_split(text, chr(10))[1] AS line FROM documents WHERE doc_id = 6", views=False)
def _(i, spark, sf_dir):
    return spark.createDataFrame([(x,) for x in i.read("6.txt", 1, 1)["lines"]], "line string")


@query("slice_source", f"SELECT CAST(doc_id + {tpch.DOCUMENT_OBJECTS} AS BIGINT) AS object_id, hex(array_slice(encode(text), 11, 50)) AS bytes FROM documents", views=False)
def _(i, spark, sf_dir):
    files = search.contents(i.graph()).where("content IS NOT NULL")
    return files.select("object_id", F.hex(text.byte_slice(F.col("content"), F.lit(10), F.lit(50))).alias("bytes"))


@query(
    "line_of_offset",
    f"SELECT object_id, CAST(count(*) FILTER (WHERE pos <= 300) AS INTEGER) AS line FROM (SELECT CAST(doc_id + {tpch.DOCUMENT_OBJECTS} AS BIGINT) AS object_id, sum(strlen(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - strlen(piece) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) GROUP BY 1",
    views=False,
)
def _(i, spark, sf_dir):
    files = search.contents(i.graph()).where("content IS NOT NULL")
    return files.select("object_id", text.line_of(F.col("content"), F.lit(300)).alias("line"))


@query("path_suffix_resolve", "SELECT id AS object_id, path FROM g_objects WHERE filetype <> 'directory' AND (path = '5.txt' OR path LIKE '%/5.txt') ORDER BY length(path), path LIMIT 50")
def _(i, spark, sf_dir):
    return search.resolve(i.graph(), "5.txt").select("object_id", "path")


# trees and projects:

_ENTRIES = f", entries AS (SELECT project_id, id AS symbol_id, name AS path, symbol_type AS kind, CASE WHEN regexp_replace(name, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(name, '/[^/]*$', '') END AS parent FROM g_symbols WHERE symbol_type IN ({DIRECTORY}, {FILE}) AND name <> '/')"


@query(
    "tree_children",
    _ENTRIES + f" SELECT parent, path, CASE kind WHEN {DIRECTORY} THEN 'dir' ELSE 'file' END AS node_type, kind = {DIRECTORY} AND EXISTS (SELECT 1 FROM entries x WHERE x.project_id = 1 AND x.parent = entries.path) AS has_children FROM entries WHERE project_id = 1 AND parent IN ('/AFRICA', '/AFRICA/NATION_5')",
)
def _(i, spark, sf_dir):
    return tree.children(i.graph(), 1, ["/AFRICA", "/AFRICA/NATION_5"]).select("parent", "path", "node_type", "has_children")


@query("tree_has_children", _ENTRIES + f" SELECT project_id, path, EXISTS (SELECT 1 FROM entries x WHERE x.project_id = entries.project_id AND x.parent = entries.path) AS has_children FROM entries WHERE kind = {DIRECTORY}")
def _(i, spark, sf_dir):
    return tree.has_children(i.graph())


@query("tree_compact", _ENTRIES + f" SELECT project_id, parent, min(path) AS child FROM entries GROUP BY 1, 2 HAVING count(*) = 1 AND count(*) FILTER (WHERE kind = {DIRECTORY}) = 1")
def _(i, spark, sf_dir):
    return tree.compactable(i.graph())


@query("project_list", "SELECT id, project_name, root_path FROM g_projects")
def _(i, spark, sf_dir):
    return tree.projects(i.graph()).select("id", "project_name", "root_path")


@query("project_details", "SELECT p.id, (SELECT count(*) FROM g_objects o WHERE o.project_id = p.id AND o.filetype <> 'directory') AS file_count, (SELECT count(*) FROM g_symbols s WHERE s.project_id = p.id) AS symbol_count FROM g_projects p")
def _(i, spark, sf_dir):
    return tree.projects(i.graph()).select("id", "file_count", "symbol_count")


# layers and uploads:


@query(
    "layer_doomed_closure",
    "WITH RECURSIVE edges AS (SELECT o_orderkey AS id, o_orderkey // 2 AS needs FROM orders WHERE o_orderkey > 1), doomed(id) AS (SELECT CAST(3 AS BIGINT) UNION SELECT e.id FROM edges e JOIN doomed d ON e.needs = d.id) SELECT id FROM doomed",
    views=False,
)
def _(i, spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey > 1")
    return doomed_closure(orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 2).alias("needs")), spark.range(3, 4).toDF("id"))


@query("content_hash_missing", "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE source = 'src3' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source <> 'src3')", views=False)
def _(i, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.sha2("text", 256).alias("content_hash"))
    return ingest.missing_hashes(docs.where("source = 'src3'"), docs.where("source <> 'src3'"))


def _sent(df: DataFrame, project: int, kind: str, batch: int, item: str, **fields: F.Column) -> DataFrame:
    """Chunks of a thousand rows by ``local_id``."""
    rows = df.select(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("x"))
    grouped = rows.groupBy(F.floor(F.col("x.local_id") / 1000).cast("int").alias("seq")).agg(F.sort_array(F.collect_list("x")).alias(item))
    return grouped.withColumns({"project_id": F.lit(project), "kind": F.lit(kind), "batch": F.lit(batch).cast("long")})


def _symbols_of(spark: SparkSession, sf_dir: str, prefix: str, project: int = 1, batch: int = 0) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    return _sent(orders, project, "symbols", batch, "symbols", local_id=F.col("k"), name=F.concat(F.lit(prefix), F.col("k").cast("string")), scope=F.lit(2), type=F.lit(FUNCTION))


_PLACE_ROWS = ingest.OBJECT.elementType["symbol_instances"].dataType, ingest.OBJECT.elementType["refs"].dataType


def _objects_of(spark: SparkSession, sf_dir: str, project: int) -> DataFrame:
    """A file for each order, with its symbol and a reference to it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    none = F.lit(None).cast("binary")
    at = F.array(F.struct(F.col("k").alias("symbol_local_id"), F.lit(1).alias("instance_type"), F.lit(0).alias("start_offset"), F.lit(9).alias("end_offset"))).cast(_PLACE_ROWS[0])
    to = F.array(F.struct(F.col("k").alias("to_symbol_local_id"), F.lit(2).alias("from_offset_start"), F.lit(5).alias("from_offset_end"))).cast(_PLACE_ROWS[1])
    fields = {"local_id": F.col("k"), "module_path": F.lit("m"), "filesystem_path": F.concat(F.lit("/x//./"), F.col("k").cast("string")), "filetype": F.lit("file"), "content": none, "content_hash": F.lit("h"), "symbol_instances": at, "refs": to}
    rows = orders.select(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("x"))
    return rows.groupBy(F.floor(F.col("x.local_id") / 1000).cast("int").alias("seq")).agg(F.collect_list("x").alias("objects")).withColumns({"project_id": F.lit(project), "kind": F.lit("objects"), "batch": F.lit(0).cast("long")})


def _chunks(*parts: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        full = p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ingest.CHUNK])
        out = full if out is None else out.unionByName(full)
    return out


@query("upload_resend_first_wins", "SELECT CAST(1 * 4294967296 + o_orderkey AS BIGINT) AS id, 'first.' || o_orderkey AS name FROM orders", views=False)
def _(i, spark, sf_dir):
    return ingest.symbols(_chunks(_symbols_of(spark, sf_dir, "later.", batch=1), _symbols_of(spark, sf_dir, "first."))).select("id", "name")


@query("upload_ids_distinct", "SELECT p AS project_id, count(*) AS objects, count(*) AS ids FROM orders CROSS JOIN (VALUES (1), (2), (5000)) AS v(p) GROUP BY 1", views=False)
def _(i, spark, sf_dir):
    sent = ingest.objects(_chunks(*[_objects_of(spark, sf_dir, p) for p in (1, 2, 5000)])).select("id", "project_id")
    once = sent.groupBy("id").agg(F.min("project_id").alias("project_id"))  # an id of two projects would count for one
    return sent.groupBy("project_id").agg(F.count("*").alias("objects")).join(once.groupBy("project_id").agg(F.count("*").alias("ids")), "project_id")


@query("delete_project_roundtrip", "SELECT CAST(2 AS INTEGER) AS project_id, CAST(2 * 4294967296 + o_orderkey AS BIGINT) AS symbol_id, '/x/' || o_orderkey AS path FROM orders", views=False)
def _(i, spark, sf_dir):
    at = fresh_path(spark, "roundtrip")
    sent = _chunks(*[f(p) for p in (1, 2) for f in (lambda p: _symbols_of(spark, sf_dir, "f.", p), lambda p: _objects_of(spark, sf_dir, p))])
    projects = spark.createDataFrame([(p, f"p{p}", "/", None, None) for p in (1, 2)], "id int, project_name string, root_path string, symbol_chunks_total int, object_chunks_total int")
    write_tables(ingest.ingest(sent, projects), at)
    delete_stored(spark, at, 1)
    return Index.load(spark, at).query("select func").nodes.select("project_id", "symbol_id", "path")


@query("normalise_paths", "SELECT '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey", views=False)
def _(i, spark, sf_dir):
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    raw = F.concat(F.lit("//"), "r_name", F.lit("/./gone/..\\"), "n_name", F.lit("/"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(paths.normal_column(raw).alias("path"))


@query(
    "direct_has_in_one_large_object",
    "SELECT 0 AS parent, o_orderkey + 1000000000000 AS child FROM orders UNION ALL SELECT l_orderkey + 1000000000000, l_orderkey * 32 + k FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem)",
    views=False,
)
def _(i, spark, sf_dir):
    """All orders and lines as occurrences in one file: joins by cells, spread over tasks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("k"), F.row_number().over(line).alias("n"))
    node = lambda df, id_, lo, hi, kind: df.select(id_.alias("id"), lo.cast("int").alias("start"), hi.cast("int").alias("end"), F.lit(kind).alias("kind"))
    base = F.col("k") * 32  # as many as the numbers of lines have: offsets are 31 bits, for 67 million orders
    rows = node(spark.range(1), F.col("id"), F.lit(0), F.lit((1 << 31) - 1), FILE)
    rows = rows.union(node(orders, F.col("k") + 1_000_000_000_000, base, base + 32, FUNCTION)).union(node(lines, F.col("k") * 32 + F.col("n"), base + F.col("n"), base + F.col("n") + 1, DATA))
    rows = written(rows, "large").withColumns({"object_id": F.lit(1).cast("long"), "instance_type": F.lit(1), "layer": F.lit(1000001).cast("long")})
    label = {"name": F.lit("x"), "symbol_path": F.array(F.lit("x")), "project_id": F.lit(1), "symbol_type": F.col("kind"), "leaf_name": F.lit("x")}
    symbols = rows.select("id", *[c.alias(n) for n, c in label.items() if n != "leaf_name"], F.lit(None).cast("int").alias("symbol_scope"), F.lit("x").alias("leaf_name"), "layer")
    instances = rows.select("id", F.col("id").alias("symbol"), "object_id", "start", "end", "instance_type", "layer")
    nodes = rows.select(F.col("id").alias("instance_id"), F.col("id").alias("symbol_id"), "object_id", "start", "end", "instance_type", label["symbol_type"].alias("symbol_type"), level_of(F.col("kind")).alias("level"), label["project_id"].alias("project_id"), "layer", *[label[n].alias(n) for n in ("name", "symbol_path", "leaf_name")])
    known = {"projects": spark.createDataFrame([(1, "p", "/", "complete", None, None, 1000001)], i.tables["projects"].schema), "objects": spark.createDataFrame([(1, 1, "/x", "/x", "file", "", 1000001)], TABLES["objects"])}
    g = Index(spark, known | {"symbols": symbols, "symbol_instances": instances, "nodes": nodes}, by_cells=True).graph()
    return g.has_children(g.nodes, direct=True).select(F.col("parent_instance").alias("parent"), F.col("child_instance").alias("child"))
