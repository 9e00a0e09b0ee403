"""Operator 4 against all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm.minhash_dedup import _keys, drop_near_duplicates, exact_sets, near_duplicates
from tests.llm.tables import docs, odd_rows, prose

import random

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows, percent=85):
    """{(id, set size): class} for rows with an id; ids on several texts are linked through the id's own sets only."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(str((d, len(sets[i]), d if d is None or not sets[i] else low[find(i)])) for i, (d, _) in enumerate(rows))


def result(df, percent=85, **options):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in near_duplicates(df, percent=percent, **options).collect())


def test_odd_rows(spark):
    rows = odd_rows()
    assert result(docs(spark, rows)) == expected(rows)


@pytest.mark.parametrize("options", [{"chunk_rows": 4}, {"broadcast_rows": 0}, {"chunk_rows": 7, "broadcast_rows": 0, "percent": 80}, {"chunk_shingles": 600}])
def test_chains_and_large_groups(spark, options):
    """A chain of documents each close to the next only, and a group whose members differ by chance: chunk pairs must find all links."""
    rng = random.Random(5)
    words = prose(rng, 200).split()
    rows = []
    for k in range(25):
        words = words.copy()
        for _ in range(2):
            words[rng.randrange(200)] = f"w{rng.random()}"
        rows.append((50 - k, " ".join(words)))
    base = prose(rng, 150).split()
    for k in range(25):
        copy = base.copy()
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(150)] = f"v{rng.random()}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, prose(rng, 80)) for k in range(20)]
    assert result(docs(spark, rows), **options) == expected(rows, options.get("percent", 85))


def thue_morse(n, one="x", other="y"):
    """Strings that collide under every polynomial hash modulo a power of two, from some length on."""
    return "".join(other if k.bit_count() & 1 else one for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_by_construction(spark, n):
    rows = [(1, thue_morse(n)), (2, thue_morse(n, "y", "x")), (3, f"a b c d {thue_morse(n)}"), (4, f"a b c d {thue_morse(n, 'y', 'x')}"), (5, thue_morse(n).upper())]
    assert result(docs(spark, rows)) == expected(rows)


def test_combined_keys():
    """What a task sends keeps each key's smallest and largest text, and whether one, two or more have it."""
    rng = np.random.default_rng(4)
    n = 9000  # three chunks; few half-keys, so that keys repeat within and across them
    # half-keys tell their place, as real ones do
    halves = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 3, pa.int32()), pa.array(rng.integers(0, top, n * 3) * 3 + np.tile(np.arange(3), n))) for top in (300, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(n)), *halves], names=["rid", "first", "second"])
    plain, short = (pa.Table.from_batches(list(_keys(iter([batch, batch.slice(0, 0)]), c))).to_pandas().groupby("key").rid for c in (False, True))
    plain, short = (g.agg(["min", "max", "count"]) for g in (plain, short))
    assert len(plain) == len(short) and (plain[["min", "max"]] == short[["min", "max"]]).all(axis=None)
    for low, high, k, m in zip(plain["min"], plain["max"], plain["count"], short["count"]):
        assert m <= k and (low == high or min(m, 3) == min(k, 3))
    assert (plain["count"] > 3).any() and (plain["count"] == 2).any()


def test_exact_sets():
    texts = [b"a b c d e f", b"a b c d e f g", b"a b", b"b a", b"a b", b"", b"a b c d e f"]
    sets = exact_sets(texts)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            both = shingles(texts[i].decode()) & shingles(texts[j].decode())
            assert len(np.intersect1d(s, t)) == len(both) and len(s) == len(shingles(texts[i].decode()))


def test_between_80_and_85(spark):
    """The operator's default links at 0.8; a query may ask for more."""
    a = [f"a{i}" for i in range(104)]  # 100 shingles
    b = a[:93] + [f"b{i}" for i in range(11)]  # shares 89, union 111: 0.802
    c = a[:92] + [f"c{i}" for i in range(12)]  # shares 88, union 112: 0.786
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and result(docs(spark, rows)) == expected(rows)


def test_exact_threshold(spark):
    """85 of 100 links; 84 of 100 doesn't."""
    # n + 4 words have n shingles; a changed last word changes one
    a = [f"a{i}" for i in range(96)]  # 92 shingles
    b = a[:89] + [f"b{i}" for i in range(7)]  # shares 85, has 92: union 99
    c = a[:88] + [f"c{i}" for i in range(8)]  # shares 84, union 100
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert result(docs(spark, rows)) == expected(rows)


def test_dropping(spark):
    rows = [(i, t) for i, t in odd_rows() if i not in (30, 31)]
    df = docs(spark, rows)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(str(r["doc_id"]) for r in out.collect())
    classes = [eval(x) for x in expected(rows)]  # noqa: S307
    assert got == sorted(str(d) for d, _, c in classes if d == c)


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).count() == 0 and drop_near_duplicates(docs(spark, [])).count() == 0


def test_hot_copies(spark):
    rows = [(k, "the same six words in here") for k in range(400)] + [(1000, "the same six words in there")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows, 8)).collect()}
    assert set(got[k] for k in range(400)) == {0} and got[1000] == 1000
