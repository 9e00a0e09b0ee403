"""Operator 8 against a brute-force grouping."""

import hashlib
import re
from collections import defaultdict

from sievework.llm.exact_dedup import drop_duplicates, exact_duplicates
from sievework.llm.queries import OP8_SQL, op8_exact_dedup
from tests.conftest import canonical, duck
from tests.llm.tables import docs, odd_rows

SF = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((len(t or ""), i))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0))
        out += [(i, best[1], len(members), hashlib.sha256(key.encode()).hexdigest()) for _, i in members]
    return out


def test_against_brute_force(spark):
    rows = odd_rows()
    for partitions in (1, 5, 40):  # one run; one round; two rounds
        got = exact_duplicates(docs(spark, rows, partitions), fan_in=4).collect()
        assert sorted(map(str, [(r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got])) == sorted(map(str, expected(rows)))
        kept = [(r["digest"], r["id"]) for r in got if r["kept"]]
        assert len(kept) == len({d for d, _ in kept}) == len({norm(t) for _, t in rows})
        assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def test_many_batches(spark):
    """Runs of equal texts that go on over batches, at every level."""
    rows = [(k, f"text {k % 5}" + " " * (k % 3)) for k in range(200)] + odd_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = exact_duplicates(docs(spark, rows, 6), fan_in=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, [(r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got])) == sorted(map(str, expected(rows)))
    assert sum(r["kept"] for r in got) == len({norm(t) for _, t in rows})


def test_dropping_keeps_one_row_of_each_text(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    out = drop_duplicates(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    best = {e[3]: e[1] for e in expected(rows)}
    assert sorted(str((hashlib.sha256(norm(t).encode()).hexdigest(), i)) for i, t in got) == sorted(str(x) for x in best.items())


def test_empty_table(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0 and drop_duplicates(docs(spark, [])).count() == 0


def test_hot_text(spark):
    got = exact_duplicates(docs(spark, [(i, "all the same") for i in range(500)] + [(900, "other")], 20)).collect()
    assert [r["id"] for r in got if r["kept"]].count(0) == 1 and sum(r["kept"] for r in got) == 2
    assert {r["group_size"] for r in got} == {500, 1}


def test_sql(spark):
    df = op8_exact_dedup(spark, SF)
    rel = duck(SF).execute(OP8_SQL)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), [d[0] for d in rel.description])
