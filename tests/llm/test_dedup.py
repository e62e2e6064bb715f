"""Operators 1, 2 and 9 against brute force, and their cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import exactdedup, linededup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, keep int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n))


def corpus(seed=3):
    """Random texts with copies, edited copies, and the awkward cases."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(20, 200)), f"s{i % 12}") for i in range(120)]
    for k in range(40):
        i = rng.randrange(120)
        w = rows[i][1].split()
        for _ in range(max(1, len(w) // 30)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((1000 + k, rows[i][1] if k % 4 == 0 else " ".join(w), f"s{k % 12}"))
    rows += [(2000, None, "s1"), (2001, None, None), (2002, "", "s1"), (2003, "", "s2"), (2004, "   ", "s3"), (2005, "?!", "s1"), (2006, "?!", "s2")]
    rows += [(None, rows[0][1], "s1"), (None, None, None), rows[5], rows[5], (3000, "long " + words(rng, 20000), "s1")]
    return rows


def groups_by_force(rows, k):
    """(id, smallest id of its component, whether it is the component's first) of each distinct (id, fingerprint)."""
    own = sorted({(i, t) for i, t, _ in rows if i is not None and t is not None})
    f, _ = simhash.fingerprints([t for _, t in own])
    nodes = sorted({(i, *np.array(x).view(np.int64).tolist()) for (i, _), x in zip(own, f)})
    f = np.array([n[1:] for n in nodes], np.int64).view(np.uint64).reshape(-1, 2)
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        d = np.bitwise_count(f[a, 0] ^ f[:, 0]).astype(int) + np.bitwise_count(f[a, 1] ^ f[:, 1])
        for b in np.flatnonzero(d <= k).tolist():
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return nodes, [nodes[find(x)] for x in range(len(nodes))]


def copies_by_force(rows, k):
    nodes, first = groups_by_force(rows, k)
    # of one fingerprint, the document of the smallest id stays; of one id, its first fingerprint
    return sorted((n[0], r[0]) for n, r in zip(nodes, first) if n[0] != r[0] or n[1:] != r[1:])


@pytest.mark.parametrize("k,shard_rows", [(3, 1 << 16), (22, 1 << 16), (22, 40), (30, 1 << 16), (60, 1 << 16)])
def test_simhash_equals_brute_force(spark, k, shard_rows):
    rows = corpus() + [(7, words(random.Random(9), 50), "s1"), (1003, "one other text of this id", "s1")]
    got = sorted((r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(docs_of(spark, rows), k, shard_rows).collect())
    assert got == copies_by_force(rows, k)
    if k == 22:
        gone = dict(got)
        assert sum(1000 <= i < 1040 for i in gone) >= 36
        assert not any(i < 120 for i in gone)
        assert gone[2003] == 2002 and gone[2006] == 2005 and 2004 not in gone


def test_every_word_and_its_place_count():
    texts = ["Reouti anatha.", "Reouti anatha. 19.37.233.111", "total due by then 17", "total due by then 95", "one two six ten", "ten six two one", "a", "b"]
    f, _ = simhash.fingerprints(texts)
    assert len({tuple(x) for x in f.tolist()}) == len(texts)


def test_simhash_stage_judges_each_text_of_an_id(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, d, "s"), (4, d, "s"), (4, d, "s"), (5, b, "s"), (3, None, "s"), (None, a, "s")]
    docs = docs_of(spark, rows).withColumnsRenamed({"hash": "gone", "keep": "f0"})
    out = simhash.stage(docs)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted([(1, a), (2, b), (3, c), (3, d), (3, None), (None, a)], key=str)


def test_simhash_stage_keeps_columns_and_nulls(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    out = simhash.stage(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and {2000, 2001, 2002, 2005} <= set(ids) and 2003 not in ids
    assert simhash.stage(docs.limit(0)).count() == 0


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    hist = rng.integers(0, 3, (simhash.PARTS, 1 << simhash.WIDTH))
    counts = np.stack([simhash.ball_counts(h, 3) for h in hist])
    v = rng.integers(0, 1 << simhash.WIDTH, (5, simhash.PARTS))
    tau = simhash.allocate(v, counts, 10)
    assert (tau.sum(1) == 10 - simhash.PARTS + 1).all()
    cost = lambda t, q: sum(counts[i][t[i] + 1, v[q, i]] for i in range(simhash.PARTS))
    for q in range(5):
        for a in range(simhash.PARTS):
            for b in range(simhash.PARTS):
                t = tau[q].copy()
                t[a] += 1
                t[b] -= 1
                if a != b and t.max() <= 3 and t.min() >= -1:
                    assert cost(t, q) >= cost(tau[q], q)
    value, near = int(v[0, 0]), 0
    for x in range(1 << simhash.WIDTH):
        near += hist[0][x] * (bin(x ^ value).count("1") <= 2)
    assert counts[0][3, value] == near


def test_exact_dedup_equals_brute_force(spark):
    rows = corpus(5)
    first = {}
    for i, t, _ in rows:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    want = {(i, first[t]) for i, t, _ in rows if i is not None and t is not None and first[t] != i}
    docs = docs_of(spark, rows)
    for how in ({"bucket_rows": 20}, {"filter_keys": 0}, {"batches": 1}, {"digest_bytes": 1}):
        got = [(r.doc_id, r.duplicate_of) for r in exactdedup.dedup(docs, **how).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert exactdedup.dedup(docs.limit(0)).count() == 0


def test_exact_dedup_of_wide_ids(spark):
    low, high = -(2**63) + 5, 2**63 - 1
    rows = [(0, "a", "s"), (2**62, "a", "s"), (low, "b", "s"), (high, "b", "s"), (3, "c", "s"), (high - 1, "d", "s"), (-7, "d", "s"), (4, "a", "s")]
    for batches in (1, 2, 3, 7):
        got = {(r.doc_id, r.duplicate_of) for r in exactdedup.dedup(docs_of(spark, rows), batches=batches).collect()}
        assert got == {(2**62, 0), (4, 0), (high, low), (high - 1, -7)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = exactdedup.BinaryFuse8.from_bytes(exactdedup.BinaryFuse8.build(np.concatenate([keys, keys])).to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.01


def strip_by_force(rows, min_sites, min_chars):
    sites, keeper = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            line = line.strip(" \t\r")
            if len(line) >= min_chars:
                if s is not None:
                    sites.setdefault(line, set()).add(s)
                if i is not None:
                    keeper[line] = min(i, keeper.get(line, i))
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines = t.split("\n")
        gone = [len(sites.get(x.strip(" \t\r"), ())) >= min_sites and (i is None or keeper.get(x.strip(" \t\r")) != i) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup_equals_brute_force(spark, limit):
    rng = random.Random(2)
    shared = [words(rng, 5) for _ in range(12)]
    rows = []
    for i in range(150):
        lines = [words(rng, 8) for _ in range(rng.randint(1, 4))]
        lines += [("  " if rng.random() < 0.3 else "") + x + ("\r" if rng.random() < 0.2 else "") for k, x in enumerate(shared) if rng.random() < 0.04 * k]
        lines += [""] * rng.randint(0, 2) + ["tiny"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{rng.randrange(12)}"))
    rows += [(200, None, "s1"), (201, "", "s1"), (None, shared[-1], "s1"), (202, shared[-1], None), rows[3], rows[3], (203, "\n".join(shared), "s2"), (204, "\n".join(shared), "s2")]
    for min_sites in (5, 11):
        got = linededup.line_dedup(docs_of(spark, rows), min_sites=min_sites, min_chars=10, limit=limit).collect()
        assert sorted([(r.doc_id, r.text, r.removed) for r in got], key=str) == strip_by_force(rows, min_sites, 10)
    clash = docs_of(spark, rows).withColumns({c: F.lit(7) for c in ("hashes", "key", "gone", "removed", "new_text", "h", "g", "x", "line", "__text", "__h")})
    out = linededup.stage(clash, 5, 10, limit)
    assert out.columns == clash.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([r[:2] for r in strip_by_force(rows, 5, 10)], key=str)
    short = [(i, "ok.\n" + words(rng, 3), f"s{i}") for i in range(9)]
    assert [r.text.count("ok.") for r in linededup.line_dedup(docs_of(spark, short), limit=limit).orderBy("doc_id").collect()] == [1] + [0] * 8
    assert linededup.line_dedup(docs_of(spark, rows).limit(0), limit=limit).count() == 0
