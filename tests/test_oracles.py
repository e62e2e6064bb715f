"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from spanforge import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, smallest, duck, name):
    got = queries.QUERIES[name](spark, smallest).toPandas()
    if name not in queries.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_suggestions_equal_brute_force(spark, smallest):
    from spanforge.functions.similarity import THRESHOLD, word_similarity

    symbols = queries.index(spark, smallest).tables["symbols"].select("name", "leaf_name").collect()
    for wanted in ("NATION5", "ordr_77", "customer 12", "zzz"):
        best = {}
        for r in symbols:
            best[r.name] = max(best.get(r.name, 0), word_similarity(wanted, r.name), word_similarity(wanted, r.leaf_name))
        want = sorted(((-x, len(n), n) for n, x in best.items() if x >= THRESHOLD))[:5]
        from spanforge.functions import similarity

        got = similarity.suggest(queries.index(spark, smallest).tables["symbols"], wanted).collect()
        assert [(r.name, round(r.score, 9)) for r in got] == [(n, round(-x, 9)) for x, _, n in want]


def test_queries_can_tell(duck):
    """Answers that would not change if a part of the operator were missing prove nothing."""
    rows = lambda name: set(map(tuple, duck.execute(queries.ORACLES[name]).df().astype(str).itertuples(index=False)))
    for less, more in (("callees_1hop", "default_refs_has"), ("derive_has", "default_refs_has"), ("derive_refs", "default_refs_has"), ("direct_has", "has_children"), ("direct_refs", "refs_children"), ("innermost_parent", "has_parents")):
        assert rows(less) < rows(more), (less, more)
    assert rows("tree_compact") and rows("constrain_by_parent") < rows("label_intersect")
