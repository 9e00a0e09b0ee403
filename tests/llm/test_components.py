"""Connected components against union-find."""

import random

import pytest

from sievework.llm.components import components


def expected(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def graph(kind):
    rng = random.Random(9)
    if kind == "chain":
        ids = list(range(64))
        rng.shuffle(ids)
        return list(zip(ids, ids[1:]))
    if kind == "star":
        return [(7, k) for k in range(300)] + [(k, 7) for k in range(50)]
    if kind == "random":
        return [(rng.randrange(-50, 150), rng.randrange(-50, 150)) for _ in range(120)]
    if kind == "odd":
        return [(1, 1), (None, 2), (3, None), (5, 4), (4, 5)]
    return []


@pytest.mark.parametrize("finish", [0, 1_000_000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "odd", "none"])
def test_against_union_find(spark, kind, finish):
    edges = graph(kind)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    rows = components(df, "a", "b", finish).collect()
    assert len(rows) == len({r["id"] for r in rows})
    assert {r["id"]: r["root"] for r in rows} == expected(edges)
