"""Operator 7: the schedule against a plain simulation, and its bounds."""

from collections import defaultdict

import pytest

from sievework.llm.mixing import cycle_schedule, mixed, schedule, source_units
from sievework.llm.queries import OP7_SQL, op7_mixing
from tests.conftest import canonical, duck
from tests.llm.tables import docs


def rows(sizes):
    return [(k, f"t{k}", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


SIZES = {"hot": 300, "a": 40, "b": 25, None: 11, "c": 1}


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "a": 5.0, "b": 0.25, "none": 3.0}])
def test_every_prefix_is_within_one_block(spark, weights):
    df = docs(spark, rows(SIZES), 4)
    cycle = 97
    units = {r["source"]: r["units"] for r in source_units(df, cycle=cycle, weights=weights).collect()}
    assert sum(units.values()) == cycle and min(units.values()) >= 1 and set(units) == set(SIZES)
    turns = cycle_schedule(source_units(df, cycle=cycle, weights=weights), cycle).collect()
    plan = sorted(((r["slot"], r["source"], r["unit"]) for r in turns), key=lambda x: x[0])
    assert [p[0] for p in plan] == list(range(cycle))
    done = defaultdict(int)
    for slot, source, unit in plan:
        assert unit == done[source]
        assert unit * cycle // units[source] <= slot < -(-(unit + 1) * cycle // units[source])
        done[source] += 1
        for s, u in units.items():
            assert abs(done[s] - (slot + 1) * u / cycle) < 1


def test_every_document_has_its_place(spark):
    df = docs(spark, rows(SIZES) + [(None, "n", "a"), (5, "again", "hot")], 4)
    got = schedule(df, cycle=50, block_docs=4).collect()
    assert len(got) == sum(SIZES.values()) + 2
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append((r["slot"], r["place"], r["block"]))
    for places in by.values():
        places.sort()
        assert [(b, p) for _, p, b in places] == [(k // 4, k % 4) for k in range(len(places))]  # blocks in order, without gaps


def test_mixed_keeps_all_rows_and_columns_in_order(spark):
    df = docs(spark, rows(SIZES), 4)
    out = mixed(df, cycle=50)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    where = {r["doc_id"]: (r["slot"], r["place"]) for r in schedule(df, cycle=50).collect()}
    order = [where[r["doc_id"]] for r in out.collect()]
    assert order == sorted(order)


def test_empty_table_and_one_source(spark):
    assert schedule(docs(spark, [])).count() == 0
    got = schedule(docs(spark, rows({"only": 30})), cycle=10, block_docs=3).collect()
    assert sorted((r["slot"], r["place"]) for r in got) == [(k // 3, k % 3) for k in range(30)]


def test_sql_and_plan(spark):
    sf = "/root/testdata/sf0.001"
    df = op7_mixing(spark, sf)
    rel = duck(sf).execute(OP7_SQL)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), [d[0] for d in rel.description])
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
