"""What keeps work in proportion to the tables: joins by cells, stored parts, suggestions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge import storage
from spanforge.functions import similarity
from spanforge.operators.graph import Cells, containment_join
from spanforge.sources import tpch
from spanforge.storage import local

RANGE = "id long, object_id long, start int, end int"


def shuffled(df):
    """The same rows, in another order whenever they are read."""

    def mix(batches):
        rows = pa.Table.from_batches(batches)
        if rows.num_rows:
            yield from rows.take(pa.array(random.SystemRandom().sample(range(rows.num_rows), rows.num_rows))).to_batches()

    return df.coalesce(1).mapInArrow(mix, df.schema)


@pytest.mark.parametrize("where", [True, [1], Cells(True, (8, 32)), "table"])
def test_what_nothing_contains_whatever_the_order_of_rows(spark, where):
    """rows of an anti-join by cells were told by their position, which changes from one reading to the next."""
    where = local(spark, [(1,)], "object_id long") if where == "table" else where
    outer = local(spark, [(0, o, 100 * k, 100 * k + 10) for o in (1, 2) for k in range(20)], RANGE)
    rows = [(i, 1 + i % 2, 5 * i, 5 * i + 3) for i in range(300)]
    inner = shuffled(local(spark, rows, RANGE))
    got = sorted(r.id for r in containment_join(outer, inner, None, where, "left_anti", ["id"]).select("i.*").collect())
    assert got == [i for i, _, lo, hi in rows if not (lo // 100 < 20 and lo % 100 >= 0 and hi <= lo // 100 * 100 + 10)]
    inside = containment_join(outer, inner, None, where).select("i.id").collect()
    assert sorted([r.id for r in inside] + got) == list(range(300))


def test_a_request_stores_what_it_reads(spark, smallest):
    """F16, F17, F27: requests for contents or directories waited for every symbol to be written."""
    stored = []
    made = tpch.tables(spark, smallest, lambda df, name: stored.append(name) or df)
    assert made["content_store"].count() and made["objects"].count() and made["projects"].count()
    assert not {"placed", "lines", "parts"} & set(stored)
    assert made["symbol_refs"].columns and made["nodes"].columns and made["symbols"].columns
    assert sorted(stored) == sorted(set(stored))  # none of them is worked out twice


def test_nodes_are_occurrences_with_their_symbols(spark, smallest):
    from spanforge.operators.graph import join_nodes

    made = tpch.tables(spark, smallest)
    want = join_nodes(made["symbol_instances"], made["symbols"])
    assert made["nodes"].count() == want.count()
    got = made["nodes"].select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_large_plan_is_run_once(spark, monkeypatch):
    monkeypatch.setattr(storage, "SMALL_INPUT", -1)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    df = spark.range(50).coalesce(1).mapInArrow(counted, "id long")
    kept, n = storage.settle(df, limit=10)
    assert n == 50 and kept.count() == 50 and runs.value == 1
    kept, n = storage.settle(df, limit=100)
    assert n == 50 and sorted(r.id for r in kept.collect()) == list(range(50)) and runs.value == 2


def test_blurred_names_are_few_and_no_less_similar():
    """names that share a part with the query were all scored, one by one."""
    names = [f"Customer#{i:09}.order_{10_000 + i}.line_{i % 7}" for i in range(1000)] + ["pkg.ÉTÉ_none", ""]
    query = "order_none"
    blur = similarity._Blur(query)
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([n.split(".")[-1] for n in names])], ["name", "leaf_name"])
    assert sum(b.num_rows for b in blur.distinct(iter([batch]))) == 3
    for n, x in zip(names, blur.of(pa.array(names)).to_pylist()):
        assert similarity.word_similarity(query, x) >= similarity.word_similarity(query, n)
    assert blur.of(pa.array(names).slice(998, 3)).to_pylist() == blur.of(pa.array(names)).to_pylist()[998:1001]
