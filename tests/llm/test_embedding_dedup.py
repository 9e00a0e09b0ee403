"""Operator 5 against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.embedding_dedup import _pack, _tree, cover_tree, dual_links, near_duplicates

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("pair", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def expected(rows, cosine=0.98):
    n = len(rows)
    x = []
    for i, v, label in rows:
        a = None if v is None or i is None or label is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        x.append(None if a is None or not len(a) or not np.isfinite(a).all() or not a.any() else a / np.linalg.norm(a))
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(str((r[0], links[i], None if r[0] is None else low[find(i)])) for i, r in enumerate(rows))


def clustered(rng, n, labels=2, dim=16):
    centres = rng.normal(size=(5, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(5)] + rng.normal(size=dim) * rng.choice([0.01, 0.15, 0.25, 1.0])
        rows.append((int(k), (v * rng.uniform(0.5, 2)).tolist(), int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 20}, {"chunk_rows": 30, "cell_rows": 50}, {"chunk_rows": 7, "cell_rows": 12, "sample_rows": 90}])
def test_against_all_pairs(spark, options):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 260)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # a hot vector
    got = near_duplicates(table(spark, rows), **options).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == expected(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, nan], 0), (5, [1.0, inf], 0), (6, [1.0, None], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (12, [-1.0, 0.0], 0)]
    got = near_duplicates(table(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, 12):
        assert by[i] == [(0, i, True)], i
    assert by[None] == [(0, None, True)]
    assert by[8] == [(2, 8, True)] * 2 and by[9] == [(2, 8, False)]


def test_repeated_ids_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [-1.0, 0.0], 0)]
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_extreme_components(spark):
    wide = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])
    rows = [(-(2**63), [1e300, 1e300], "a"), (5, [1e-300, 1.01e-300], "a"), (2**63 - 1, [1e300, -1e300], "a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, wide)).collect()}
    assert got == {-(2**63): (1, -(2**63)), 5: (1, -(2**63)), 2**63 - 1: (0, 2**63 - 1)}


def test_pruning_leaves_few_pairs(spark):
    """Clusters within clusters: cells far apart never meet, at two levels."""
    rng = np.random.default_rng(8)
    top = rng.normal(size=(6, 32))
    mid = top[rng.integers(6, size=40)] + rng.normal(size=(40, 32)) * 0.1
    x = mid[rng.integers(40, size=1500)] + rng.normal(size=(1500, 32)) * 0.004
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    placed = table(spark, rows).select(F.col("vec_id").alias("rid"), "label", F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("vector"))
    placed = placed.mapInArrow(lambda it: _pack(it, "<f4"), "rid long, label int, weight long, vector binary, cell string, away double")
    leaves, pairs = _tree(placed, "int", 0.98, 100, 1500, 8, "<f4")
    sizes = {r["cell"]: r["count"] for r in leaves.groupBy("cell").count().collect()}
    met = sum(sizes[r["a"]] * sizes[r["b"]] for r in pairs.collect())
    assert len(sizes) >= 20 and met < 1500 * 1500 / 6
    got = near_duplicates(table(spark, rows), cell_rows=100, sample_rows=1500).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == expected(rows)


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0


def test_dual_traversal_is_exact():
    rng = np.random.default_rng(2)
    for spread in (0.02, 0.1, 1.0):
        x = rng.normal(size=(3, 8))[rng.integers(0, 3, 300)] + rng.normal(size=(300, 8)) * spread
        x /= np.linalg.norm(x, axis=1)[:, None]
        y, z = x[:170], x[170:]
        for other in (None, z):
            count = np.zeros((len(y), len(y if other is None else other)), int)
            for i, j, whole in dual_links(y, other, 0.98):
                if whole:
                    count[np.ix_(i, j)] += 1
                else:
                    np.add.at(count, (i, j), 1)
            if other is None:
                count = count + count.T
                want = (y @ y.T >= 0.98) & ~np.eye(len(y), dtype=bool)
            else:
                want = y @ other.T >= 0.98
            assert (count == want).all()


def test_cover_tree_nests_and_covers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    todo = [cover_tree(x)]
    while todo:
        n = todo.pop()
        assert n.centre in n.members
        assert (np.sqrt(np.maximum(0, 2 - 2 * x[n.members] @ x[n.centre])) <= n.radius + 1e-7).all()
        if n.children:
            assert sorted(np.concatenate([c.members for c in n.children])) == sorted(n.members)
            assert n.children[0].centre == n.centre
        todo += n.children
