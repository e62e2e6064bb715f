"""Parser, names, content functions, files, trees, rendering, uploads and streams."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge import render
from spanforge.functions import names, similarity, text
from spanforge.index import to_graph
from spanforge.operators import search, tree
from spanforge.operators.layers import doomed_closure
from spanforge.plans.parser import QueryError, parse
from spanforge.schema import DIRECTORY, FILE, FUNCTION, TABLES
from spanforge.sources import ingest
from spanforge.sources.store import read_tables, write_tables
from spanforge.storage import local, settle
from spanforge.streaming import upload
from tests import fixtures

# parser:


@pytest.mark.parametrize(
    "query,count",
    [
        ("", 0),
        ('"a"', 1),
        ('"a" "b"', 1),
        ('"a"\n"b"', 2),
        ('"a";"b";;', 2),
        ("{}", 1),
        ("{{}}", 1),
        ('// note\n"a" /* in\nside */ {}', 1),
        ('func("a"\n,\nfilter="true"\n)', 1),
        ('@x "a"; #x {}', 2),
        ('!"a"', 1),
        ('"two\nlines"', 1),
        ('"a"\n{}', 2),
    ],
)
def test_statement_counts(query, count):
    assert len(parse(query).statements) == count


@pytest.mark.parametrize("query", ['"a', "{", "}", "func(", 'func(a="b", "c")', 'func("a" "b")', "/* open", '"a" )', 'func(a = "b")'])
def test_syntax_errors(query):
    with pytest.raises(QueryError):
        parse(query)


# names:

NAMES = [
    ("(*k8s.io/kube/pkg/kubelet.Kubelet).Run", FUNCTION, ["k8s", "io", "kube", "pkg", "kubelet", "Kubelet", "Run"]),
    ("/src/main.go", FILE, ["src", "main_go"]),
    ("/", DIRECTORY, ["unknown"]),
    ("a::b.c-d", FUNCTION, ["a", "b", "cd"]),
    ("é*", FUNCTION, ["unknown"]),
    ("foo:<anon150>", FUNCTION, ["foo", "anon150"]),
]


def test_names_as_columns_and_in_python(spark):
    df = spark.createDataFrame([(n, t) for n, t, _ in NAMES], "name string, kind int")
    got = [r.p for r in df.select(names.path_column(F.col("name"), F.col("kind")).alias("p")).collect()]
    assert got == [p for _, _, p in NAMES] == [names.path_of(n, t) for n, t, _ in NAMES]


def test_ordered_tokens_against_brute_force(spark):
    rng = random.Random(1)
    paths = [[rng.choice("abc") for _ in range(rng.randint(1, 6))] for _ in range(150)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path array<string>")

    def sub(want, path):
        it = iter(path)
        return all(w in it for w in want)

    for want in (["a"], ["a", "b"], ["b", "b"], ["c", "a", "b"]):
        got = {r.i for r in df.where(names.has_tokens(F.col("path"), want)).collect()}
        assert got == {i for i, p in enumerate(paths) if sub(want, p)}
        got = {r.i for r in df.where(names.has_tokens_anchored(F.col("path"), want)).collect()}
        assert got == {i for i, p in enumerate(paths) if p[-1] == want[-1] and sub(want[:-1], p[:-1])}


def test_globs():
    assert names.Glob("is*").leaf_like(True, True) == ("is%", False)
    assert names.Glob("a**_b").leaf_like(True, True) == ("a%\\_b", False)
    assert names.Glob("Foo").leaf_like(True, False) == ("%Foo%", True)
    assert names.Glob("*.c").leaf_like(False, True) == ("%\\_c", False)
    assert names.Glob("a/b*").full_like() == ("a/b%", False)
    for bad in ("*", "-*", "", "***"):
        with pytest.raises(ValueError):
            names.Glob(bad)


def test_predicates_without_an_opinion(spark):
    from spanforge.plans.verbs import Predicate, either, negate

    df = spark.range(6).toDF("x")
    low, high = F.col("x") < 2, F.col("x") > 3
    got = lambda c: {r.x for r in df.where(c).collect()}
    assert got(either([low, high])) == {0, 1, 4, 5} and got(either([])) == set() and either([low, None]) is None
    assert negate(None) is None and got(negate(either([low, high]))) == {2, 3}
    assert got(Predicate.both([Predicate(low), None, Predicate()]).node) == {0, 1} and Predicate.both([None]).empty


def test_word_similarity():
    assert similarity.word_similarity("word", "two words") == pytest.approx(0.8)
    assert similarity.word_similarity("foo", "foo") == 1.0
    assert similarity.word_similarity("abc", "xyz") == 0.0


# content:


def occurrences(hay, needle, cased, whole):
    """Byte ranges by a scan."""
    h, n = (hay, needle) if cased else (hay.lower(), needle.lower())
    out, i = [], 0
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    while (i := h.find(n, i)) >= 0:
        before, after = h[i - 1 : i], h[i + len(n) : i + len(n) + 1]
        if not whole or not (before and word(before)) and not (after and word(after)):
            start = len(h[:i].encode())
            out.append((start, start + len(n.encode())))
        i += len(n)
    return out


def test_occurrences_against_a_scan(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["foo", "Foo", "é", " ", "_", "o", ".", "\\E", "fo"]) for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["", "foofoofoo", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for needle in ("foo", "oo.", "\\E "):
        for cased in (True, False):
            for whole in (True, False):
                got = {r.i: [tuple(x) for x in r.o] if r.o is not None else None for r in df.select("i", text.pieces(F.col("t"), needle, cased).alias("p")).select("i", text.occurrences(F.col("p"), needle, cased, whole).alias("o")).collect()}
                for i, t in enumerate(texts):
                    assert (got[i] or []) == ([] if t is None else occurrences(t, needle, cased, whole)), (t, needle)


def test_lines(spark):
    raws = [b"hello\nworld\n", b"", b"\n\n", b"no end", b"\xff\xfe\nx"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, c binary")
    for line in (1, 2, 3):
        got = {r.i: r.r for r in df.select("i", text.line_range(F.col("c"), line).alias("r")).collect()}
        for i, raw in enumerate(raws):
            parts = raw.split(b"\n")
            start = sum(len(p) + 1 for p in parts[: line - 1])
            assert (tuple(got[i]) if got[i] else None) == ((start, start + len(parts[line - 1])) if len(parts) >= line else None)
    at = {r.i: r.n for r in df.select("i", text.line_of(F.col("c"), F.lit(6)).alias("n")).collect()}
    assert at == {i: raw[:6].count(b"\n") + 1 for i, raw in enumerate(raws)}


def test_files(spark):
    index = fixtures.search(spark)
    assert index.source(1) == b"hello foo world\n" and index.source(1, 6, 9) == b"foo"
    with pytest.raises(ValueError):
        index.source(1, 5, 500)
    with pytest.raises(KeyError):
        index.source(99)
    assert index.read("basic.c", 1, 1)["lines"] == ["hello foo world"]
    assert {r.path for r in index.resolve("shared.h").collect()} == {"/p1/shared.h", "/p2/shared.h"}
    assert index.line_of(1, 15) == 1
    assert index.exists("fn_basic") and not index.exists("fn_basics") and "fn_basic" in index.suggest("fn_basics")


# trees and projects:


def test_tree(spark):
    index = fixtures.tree(spark)
    got = index.tree(1, ["/", "/src"])
    assert [(e["path"], e["node_type"], e["has_children"]) for e in got["/"]] == [("/docs", "dir", True), ("/src", "dir", True)]
    assert [(e["name"], e["node_type"]) for e in got["/src"]] == [("config", "dir"), ("util", "dir"), ("main.go", "file")]
    assert index.tree(1, ["/src/util/"])["/src/util"][0]["object_id"] in (2, 3)
    with pytest.raises(ValueError):
        index.tree(1, ["/nowhere"])
    with pytest.raises(KeyError):
        index.tree(9, ["/"])
    assert index.project(1)["file_count"] == 5 and index.project(1)["symbol_count"] == 10


def test_compact_chain(spark):
    b = fixtures.Build("p")
    for i, path in enumerate(("/a", "/a/b", "/a/b/c", "/d"), 1):
        b.object(i, path, filetype="directory").node(i, path, 0, 0, i, DIRECTORY, i, 4)
    b.object(10, "/a/b/c/x.go").node(10, "/a/b/c/x.go", 0, 9, 10, FILE)
    got = {e["path"]: e["compact_path"] for e in b.index(spark).tree(1, ["/"], compact=True)["/"]}
    assert got == {"/a": "/a/b/c", "/d": None}
    assert {(r.parent, r.child) for r in tree.compactable(b.index(spark).graph()).collect()} == {("/a", "/a/b"), ("/a/b", "/a/b/c")}


# joins against brute force:


def test_joins_of_random_forests(spark):
    rng = random.Random(5)
    level = {1: 2, 2: 3, 3: 4, 4: 5, 8: 1}
    for scale in (1, 97, 20_000_011):
        b = fixtures.Build("p").object(1, "/x").object(2, "/y")
        nodes, refs = [], []
        for i in range(1, 41):
            lo = rng.randint(0, 40) * scale
            hi = lo + rng.choice([0, 0, 5, 10, 20, 40]) * scale
            obj, kind = rng.randint(1, 2), rng.choice(list(level))
            b.node(i, f"n{i}", lo, hi, obj, kind)
            nodes.append((i, obj, *((0, 0) if lo >= hi else (lo, hi)), level[kind]))
        for k in range(25):
            lo = rng.randint(0, 70) * scale
            hi = lo + rng.choice([0, 2, 6]) * scale
            obj, to = rng.randint(1, 2), rng.randint(1, 40)
            b.ref(lo, hi, to, obj)
            refs.append((k + 1, obj, *((0, 0) if lo >= hi else (lo, hi)), to))
        index = b.index(spark)

        def inside(p, c):  # (id, object, start, end, ..)
            return p[1] == c[1] and (c[2] >= c[3] or (p[2] <= c[2] and p[3] >= c[3] and p[2] < p[3]))

        def differ(x, y):
            return x[2:4] != y[2:4]

        some = [n for n in nodes if n[0] % 2]
        pairs = [(p, c) for p in some for c in nodes if inside(p, c) and p[4] >= c[4] and p[0] != c[0]]
        between = lambda p, c, lv: any(inside(p, m) and inside(m, c) and differ(m, p) and differ(m, c) and m[0] not in (p[0], c[0]) and (not lv or p[4] >= m[4]) for m in nodes)
        for by_cells in (False, True):
            base = index.graph()
            g = type(base)(spark, base.tables, base.visible, by_cells=by_cells)
            chosen = g.select(F.col("instance_id") % 2 == 1)
            pick = lambda df: sorted((r.parent_instance, r.child_instance) for r in df.collect())
            assert pick(g.has_children(chosen)) == sorted((p[0], c[0]) for p, c in pairs)
            assert pick(g.has_children(chosen, direct=True)) == sorted((p[0], c[0]) for p, c in pairs if not between(p, c, True))
            up = [(p, c) for c in some for p in nodes if inside(p, c) and p[4] >= c[4] and p[0] != c[0]]
            assert pick(g.has_parents(chosen)) == sorted((p[0], c[0]) for p, c in up)
            assert pick(g.has_parents(chosen, innermost=True)) == sorted((p[0], c[0]) for p, c in up if not between(p, c, False))
            sites = [(p, r) for p in some for r in refs if inside(p, r)]
            blocked = lambda p, r: any(inside(p, m) and inside(m, r) and differ(m, p) and m[0] != p[0] and m[4] <= p[4] for m in nodes)
            outer = lambda p: not any(q[0] != p[0] and inside(q, p) and differ(q, p) for q in some)
            pick = lambda df: sorted((r.from_instance, r.ref_id) for r in df.collect())
            assert pick(g.ref_children(chosen)) == sorted((p[0], r[0]) for p, r in sites)
            assert pick(g.ref_children(chosen, direct=True)) == sorted((p[0], r[0]) for p, r in sites if not blocked(p, r))
            assert pick(g.ref_children(chosen, outer=True)) == sorted((p[0], r[0]) for p, r in sites if outer(p))
            odd = {n[0] for n in some}
            assert pick(g.ref_parents(chosen)) == sorted((p[0], r[0]) for p in nodes for r in refs if r[4] in odd and inside(p, r))
            assert pick(g.edges_between(chosen)) == sorted((p[0], r[0]) for p in some for r in refs if r[4] in odd and inside(p, r) and r[4] != p[0])
            around = g.around(g.select(), chosen)
            assert sorted((r.up, r.down) for r in around.collect()) == sorted((p[0], c[0]) for p, c in up)
            assert {r.symbol_id for r in g.symbols_referring(chosen, g.select(), None).collect()} == {p[0] for p in nodes for r in refs if r[4] in odd and inside(p, r)}
            assert {r.symbol_id for r in g.symbols_referred(chosen, g.select(), None).collect()} == {r[4] for p, r in sites}


def test_queries_of_random_forests(spark):
    """Derivation through the language against sets worked out in Python, on graphs of its own."""
    rng = random.Random(11)
    verbs = {1: ("func", 2), 5: ("type", 2), 6: ("data", 2), 2: ("file", 3), 8: ("field", 1)}
    b = fixtures.Build("p").object(1, "/x").object(2, "/y")
    nodes, refs = {}, []
    for i in range(1, 36):
        lo = rng.randint(0, 40)
        hi, obj, kind = lo + rng.choice([0, 4, 9, 20, 40]), rng.randint(1, 2), rng.choice(list(verbs))
        b.node(i, f"n{i}", lo, hi, obj, kind)
        nodes[i] = (obj, *((0, 0) if lo >= hi else (lo, hi)), verbs[kind][1], kind)
    for k in range(40):
        lo, obj, to = rng.randint(0, 70), rng.randint(1, 2), rng.randint(1, 35)
        hi = lo + rng.choice([1, 2, 6])
        b.ref(lo, hi, to, obj)
        refs.append((obj, lo, hi, to))
    index = b.index(spark)
    inside = lambda p, c: p[0] == c[0] and (c[1] >= c[2] or (p[1] <= c[1] and p[2] >= c[2] and p[1] < p[2]))
    differ = lambda x, y: x[1:3] != y[1:3]
    strict = lambda p, m, c: inside(nodes[p], nodes[m]) and inside(nodes[m], nodes[c]) and differ(nodes[m], nodes[p]) and differ(nodes[m], nodes[c]) and m not in (p, c)
    holds = lambda p, c: p != c and inside(nodes[p], nodes[c]) and nodes[p][3] >= nodes[c][3]

    def below(some, refs_too=True, has_too=True, unnest=False):
        out = set()
        if has_too:
            out |= {c for p in some for c in nodes if holds(p, c) and (unnest or not any(strict(p, m, c) and nodes[p][3] >= nodes[m][3] for m in nodes))}
        if refs_too:
            for p in some:
                if not unnest and any(q != p and inside(nodes[q], nodes[p]) and differ(nodes[q], nodes[p]) for q in some):
                    continue
                for r in refs:
                    between = any(m != p and inside(nodes[p], nodes[m]) and inside(nodes[m], r) and differ(nodes[m], nodes[p]) and nodes[m][3] <= nodes[p][3] for m in nodes)
                    if inside(nodes[p], r) and (unnest or not between):
                        out.add(r[3])
        return out

    def above(some):
        around = {p for c in some for p in nodes if holds(p, c) and not any(strict(p, m, c) for m in nodes)}
        return around | {p for p in nodes for r in refs if r[3] in some and inside(nodes[p], r)}

    for kind, (verb, _) in verbs.items():
        own = {i for i, n in nodes.items() if n[4] == kind}
        want = {
            f"select {verb} {{ any }}": own | below(own),
            f"select {verb} has {{ any }}": own | below(own, refs_too=False),
            f"select {verb} refs {{ any }}": own | below(own, has_too=False),
            f"select {verb} {{ any unnest }}": own | below(own, unnest=True),
            f"select {verb} {{ any {{}} }}": own | below(own) | below(below(own)),
            f"{{ select {verb} }}": own | above(own),
        }
        for query, expected in list(want.items())[kind % 2 :: 2] if kind in (5, 6, 2) else want.items():
            assert {r.instance_id for r in index.query(query).nodes.collect()} == expected, query


# results:


def test_shown_results(spark):
    index = fixtures.verb(spark)
    shown = json.loads(index.ask('"foo" {}', timeout=60))
    assert {n["label"] for n in shown["nodes"]} == {"foo", "foo.bar", "config.Debug"} and not shown["truncated"]
    assert all(e["from_project"] == "1" for e in shown["edges"])
    few = to_graph(index.query('"foo" {}'), 1)
    assert few["truncated"] and few["total_symbols"] == 3 and len(few["nodes"]) == 1 and not few["edges"]
    page = index.ask('"foo" {}', form="markdown", timeout=60)
    assert "`foo` /main.c:3" in page and "→ `foo.bar`" in page
    page = index.ask('loc("main.c", "2", project="alpha_proj")', form="markdown", projection="body", timeout=60)
    assert "/main.c:2" in page
    with pytest.raises(render.TooLarge):
        render.checked("x" * (render.MAX_BYTES + 1))
    assert "_nothing_" in index.ask('"nothing_here"', form="markdown", timeout=60)


def test_time_limit(spark):
    with pytest.raises(QueryError):
        fixtures.a(spark).query('"a" {}', timeout=1e-9)
    import time

    from spanforge.plans.limits import time_limit

    began = time.monotonic()
    with pytest.raises(QueryError), time_limit(spark, 1.0):
        spark.range(0, 1 << 40, 1, 4).selectExpr("sum(id % 7)").collect()  # hours of work
    assert time.monotonic() - began < 20
    with time_limit(spark, 60):
        assert spark.range(5).count() == 5


def test_closure(spark):
    edges = local(spark, [(2, 1), (3, 2), (4, 3), (1, 4), (9, 8)], "id long, needs long")
    assert {r.id for r in doomed_closure(edges, local(spark, [(1,)], "id long")).collect()} == {1, 2, 3, 4}


def test_large_sets_are_checkpointed(spark):
    df, n = settle(spark.range(50).toDF("x"), limit=10)
    assert n == 50 and df.count() == 50


# uploads:


def chunks(spark):
    raw = b"int f() { return g(); }\n"
    h = hashlib.sha256(raw).hexdigest()
    symbols = [(0, "pkg.f", 2, FUNCTION), (1, "pkg.g", 0, FUNCTION), (2, "bad", 1, 77), (1 << 33, "far", 1, FUNCTION)]
    obj = (7, "pkg", "//src///f.c/", "file", None, h, [(0, 1, 0, 23), (1, 1, 5, 5)], [(1, 17, 20)])
    rows = [(3, "symbols", 0, symbols, None, None, 0), (3, "objects", 0, None, [obj], None, 0), (3, "contents", 0, None, None, [(h, bytearray(raw)), ("0" * 64, bytearray(b"wrong"))], 0)]
    return spark.createDataFrame(rows + rows[:2], ingest.CHUNK), h


def test_upload_and_store(spark, tmp_path):
    got, h = chunks(spark)
    projects = spark.createDataFrame([(3, "up", "/up", 1, 1), (4, "late", "/late", 2, 0)], "id int, project_name string, root_path string, symbol_chunks_total int, object_chunks_total int")
    tables = ingest.ingest(got, projects)
    write_tables(tables, str(tmp_path))
    stored = read_tables(spark, str(tmp_path))
    assert {r.id: r.upload_status for r in stored["projects"].collect()} == {3: "complete", 4: "uploading"}
    assert {(r.id, r.leaf_name, r.symbol_scope) for r in stored["symbols"].collect()} == {(3 << 32, "f", 2), ((3 << 32) + 1, "g", None)}
    assert [r.filesystem_path for r in stored["objects"].collect()] == ["/src/f.c"]
    assert {(r.start, r.end) for r in stored["symbol_instances"].collect()} == {(0, 23), (0, 0)}
    assert [r.content_hash for r in stored["content_store"].collect()] == [h]
    assert [(r.symbols, r.objects, r.contents) for r in ingest.rejected(got).collect()] == [(2, 0, 1)]
    from spanforge.index import Index

    index = Index.load(spark, str(tmp_path))
    assert {n["label"] for n in to_graph(index.query('"f" {}'))["nodes"]} == {"pkg.f", "pkg.g"}
    assert [r.content_hash for r in ingest.missing_hashes(spark.createDataFrame([(h,), ("new",)], "content_hash string"), stored["content_store"]).collect()] == ["new"]
    left = ingest.delete_project(stored, 3)
    assert all(left[t].count() == 0 for t in ("symbols", "symbol_refs", "symbol_instances", "objects", "nodes", "chunks")) and left["projects"].count() == 1
    write_tables(left, str(tmp_path / "left"))
    assert not to_graph(Index.load(spark, str(tmp_path / "left")).query('"f"'))["nodes"]
    assert set(read_tables(spark, str(tmp_path / "none"))) == set(TABLES)


def test_a_chunk_sent_again_changes_nothing(spark):
    sym = lambda *names: [(i, n, 0, FUNCTION) for i, n in enumerate(names)]
    obj = lambda path, *at: [(0, "m", path, "file", None, "h", [(i, 1, lo, lo + 5) for i, lo in enumerate(at)], [])]
    first = [(1, "symbols", 0, sym("a", "b"), None, None, 0), (1, "objects", 0, None, obj("/x", 0, 9), None, 0)]
    again = [(1, "symbols", 0, sym("c", "d", "e"), None, None, 1), (1, "objects", 0, None, obj("/y", 50, 60), None, 1)]
    for rows in (first + again, again[::-1] + first):
        got = spark.createDataFrame(rows, ingest.CHUNK).repartition(3)
        assert {r.name for r in ingest.symbols(got).collect()} == {"a", "b"}
        assert [r.filesystem_path for r in ingest.objects(got).collect()] == ["/x"]
        assert {r.start for r in ingest.symbol_instances(got).collect()} == {0, 9}


def test_object_ids_of_projects_differ(spark):
    obj = lambda n: [(n, "m", f"/f{n}", "file", None, "h", [], [])]
    rows = [(p, "objects", k, None, obj(n), None, 0) for p in (1, 2, 5000, 2**31 - 1) for k, n in enumerate((0, 1, 1 << 20, (1 << 32) - 1, 1 << 32, -1))]
    got = spark.createDataFrame(rows, ingest.CHUNK)
    ids = [r.id for r in ingest.objects(got).collect()]
    assert len(ids) == len(set(ids)) == 16 and min(ids) > 0
    assert {(r.project_id, r.objects) for r in ingest.rejected(got).collect()} == {(p, 2) for p in (1, 2, 5000, 2**31 - 1)}


def test_objects_of_one_path_are_one(spark):
    rows = [
        (1, "symbols", 0, [(0, "f", 0, FUNCTION), (1, "g", 0, FUNCTION)], None, None, 0),
        (1, "objects", 0, None, [(3, "m", "/d/./x//y/../f.c", "file", None, "h1", [(0, 0, 0, 5)], [(1, 2, 3)]), (4, "m", "relative", "file", None, "h", [(0, 1, 0, 1)], [])], None, 0),
        (1, "objects", 1, None, [(9, "m2", "/d/x/f.c", "source", None, "h2", [(1, 1, 7, 9), (7, 1, 7, 9), (0, 99, 1, 2)], [(5, 0, 1), (0, 8, 9)])], None, 0),
    ]
    got = spark.createDataFrame(rows, ingest.CHUNK)
    objects = ingest.objects(got).collect()
    assert [(r.id, r.filesystem_path, r.filetype, r.content_hash) for r in objects] == [((1 << 32) + 3, "/d/x/f.c", "source", "h2")]
    assert {(r.object_id, r.start, r.instance_type) for r in ingest.symbol_instances(got).collect()} == {((1 << 32) + 3, 0, 1), ((1 << 32) + 3, 7, 1)}
    assert {(r.from_object, r.start) for r in ingest.symbol_refs(got).collect()} == {((1 << 32) + 3, 2), ((1 << 32) + 3, 8)}
    assert [r.objects for r in ingest.rejected(got).collect()] == [1]


def test_paths_as_columns_and_in_python(spark):
    from spanforge.functions import paths

    given = {"//src///f.c/": "/src/f.c", "/": "/", "": "/", "a/./b": "a/b", "/a/../..": "/", "\\x\\y": "/x/y", "/a/b/..": "/a", "..": "/", "/.": "/"}
    df = spark.createDataFrame([(g,) for g in given], "p string")
    assert [r.n for r in df.select(paths.normal_column(F.col("p")).alias("n")).collect()] == list(given.values()) == [paths.normal(g) for g in given]


def test_stored_projects_come_and_go(spark, tmp_path):
    from spanforge.index import Index
    from spanforge.sources import store

    at = str(tmp_path)
    got, _ = chunks(spark)
    projects = lambda *rows: spark.createDataFrame(rows, "id int, project_name string, root_path string, symbol_chunks_total int, object_chunks_total int")
    write_tables(ingest.ingest(got, projects((3, "up", "/up", 1, 1))), at)
    other = got.where("kind <> 'contents'").withColumn("project_id", F.lit(4))
    write_tables(ingest.ingest(other, projects((4, "late", "/late", 2, 1))), at, mode="append")
    with pytest.raises(store.Conflict):
        store.begin(spark, at, "up")
    assert store.begin(spark, at, "late") == 4 and store.begin(spark, at, "new") is None
    with pytest.raises(ValueError):
        store.finalize(spark, at, 4)
    assert store.finalize(spark, at, 3) and not store.finalize(spark, at, 77)
    shown = Index.load(spark, at).project(4)
    assert (shown["symbol_count"], shown["file_count"], shown["symbol_chunks_total"], shown["committed_symbol_chunks"], shown["committed_object_chunks"]) == (2, 1, 2, [0], [0])
    store.set_status(spark, at, 4, "failed")
    assert store.begin(spark, at, "late") is None
    left = read_tables(spark, at)
    assert [r.id for r in left["projects"].collect()] == [3] and {r.project_id for r in left["symbols"].collect()} == {3} and left["nodes"].count() == 2
    assert len(list(tmp_path.glob("nodes/layer=*"))) == 1
    assert store.delete_stored(spark, at, 3) and not store.delete_stored(spark, at, 3)
    assert all(df.count() == 0 for name, df in read_tables(spark, at).items() if name not in ("content_store", "object_contents"))


def test_layers_outlive_the_session(spark, tmp_path):
    from spanforge.index import Index

    at = str(tmp_path)
    write_tables(fixtures.verb(spark).tables, at)
    q = 'layer { ephemeral_ref(from_object="1", to_symbol="4", end="916", start="915") }; "foo" { "tar" }'
    first = Index.load(spark, at, keep_layers=True).query(q)
    again = Index.load(spark, at, keep_layers=True)
    second = again.query(q)
    assert [(x.layer, x.created) for x in second.activations] == [(x.layer, False) for x in first.activations]
    rows = lambda r: sorted((x.instance_id, x.layer) for x in r.nodes.collect())
    assert rows(first) == rows(second) != []
    # one that was broken off isn't there
    import shutil

    shutil.rmtree(tmp_path / "layers" / str(-first.activations[0].layer) / "manifest")
    broken = Index.load(spark, at, keep_layers=True).query(q)
    assert broken.activations[0].created and rows(broken) == rows(first)
    assert Index.load(spark, at, keep_layers=True).purge_layers(ttl=-10)
    assert not list((tmp_path / "layers").glob("*/manifest"))


def message(fields):
    """Fields (number, value) in the wire format; a list of fields is a message."""

    def varint(n):
        n %= 1 << 64
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
            continue
        raw = value.encode() if isinstance(value, str) else value if isinstance(value, bytes) else message(value)
        out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def test_index_files(spark, tmp_path):
    from spanforge.sources import protobuf

    raw = "int f() { return g(); } é\n".encode()
    h = hashlib.sha256(raw).hexdigest()
    project = message(
        [(1, "proj"), (2, "/root"), (99, "unknown"), (98, 7)]
        + [(5, [(1, i), (2, n), (3, 2), (4, FUNCTION)]) for i, n in enumerate(("pkg.f", "pkg.g"))]
        + [(4, [(1, 5), (3, "m"), (4, "/f.c"), (5, "file"), (9, h), (7, [(1, 0), (2, 1), (4, 23)]), (7, [(1, 1), (3, 17), (4, 18)]), (8, [(1, 1), (2, 17), (3, 20)])])]
    )
    (tmp_path / "project.pb").write_bytes(project)
    (tmp_path / "contents-1.pb").write_bytes(message([(1, [(1, h), (2, raw)])]))
    (tmp_path / "contents-2.pb").write_bytes(message([(1, [(1, hashlib.sha256(b"").hexdigest()), (2, b"")])]))
    got, head = protobuf.read(spark, str(tmp_path), 6)
    tables = ingest.ingest(got, head)
    assert [tuple(r)[:4] for r in tables["projects"].collect()] == [(6, "proj", "/root", "complete")]
    assert {r.name for r in tables["symbols"].collect()} == {"pkg.f", "pkg.g"}
    assert {(r.start, r.end) for r in tables["symbol_instances"].collect()} == {(0, 23), (17, 18)}
    assert {bytes(r.content) for r in tables["content_store"].collect()} == {raw, b""}
    single, head = protobuf.read(spark, str(tmp_path / "project.pb"), 7, "renamed")
    assert head.first().project_name == "renamed" and {r.kind for r in single.collect()} == {"symbols", "objects"}
    with pytest.raises(FileNotFoundError):
        protobuf.read(spark, str(tmp_path / "nowhere"), 1)
    with pytest.raises(ValueError):
        protobuf.decode(project[:-3], protobuf.PROJECT)


def test_rows_of_a_relational_store(spark):
    from spanforge.sources import store

    assert set(store.RELATIONAL) == set(TABLES)
    rows = spark.createDataFrame([(1, "a.b", "a.b", 1, 1, None, "b", 5)], "id long, name string, symbol_path string, project_id int, symbol_type int, symbol_scope int, leaf_name string, layer long")
    assert store.from_relational("symbols", rows).first().symbol_path == ["a", "b"]


def test_stream_of_chunks(spark, tmp_path):
    got, _ = chunks(spark)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    got.coalesce(1).write.parquet(source)
    upload.store_chunks(upload.chunk_stream(spark, source), target, str(tmp_path / "check")).awaitTermination()
    got.coalesce(1).write.mode("append").parquet(source)  # all of it is sent again
    upload.store_chunks(upload.chunk_stream(spark, source), target, str(tmp_path / "check")).awaitTermination()
    stored = spark.read.schema(ingest.CHUNK).parquet(target)
    assert stored.count() == 6 and ingest.first_chunks(stored).count() == 3 and ingest.symbols(stored).count() == 2
    assert {(r.kind, r.chunks) for r in upload.progress(stored).collect()} == {("symbols", 1), ("objects", 1), ("contents", 1)}


def test_whole_words_are_found_in_shared_texts_once(spark):
    g = fixtures.search(spark).graph()
    assert {(r.object_id, r.start) for r in search.search(g, "shared_token", True, True, None).collect()} == {(7, 0), (8, 0)}
