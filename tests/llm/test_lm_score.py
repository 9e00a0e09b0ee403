"""Operator 1 against counting in dictionaries."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sievework.llm.lm_score import gram_keys, stupid_backoff
from sievework.llm.queries import OP1_SQL, op1_lm_score
from tests.conftest import canonical, duck
from tests.llm.tables import docs, odd_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, order, alpha=0.4, leave_one_out=True):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) for _, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(w) for w in words]
    whole = sum(own, Counter())
    total = sum(map(len, words))
    out = []
    for (d, _), w, o in zip(rows, words, own):
        c = lambda g: whole[g] - (o[g] if leave_one_out else 0)  # noqa: B023, E731
        base = total - len(w) * leave_one_out
        score, full, unseen = 0.0, 0, 0
        for i in range(len(w)):
            top = min(i + 1, order)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    score += math.log(c(g) / (c(g[:-1]) if n > 1 else base) * alpha ** (top - n))
                    full += n == order
                    break
            else:
                score += math.log(0.5 / max(base, 1) * alpha ** (top - 1))
                unseen += 1
        out.append((str(d), len(w), round(score, 6), full, unseen))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"order": 1}, {"order": 4, "alpha": 0.7}, {"leave_one_out": False}, {"block_bytes": 300, "bucket_keys": 500}])
def test_against_dictionaries(spark, options):
    rows = odd_rows()
    got = sorted((str(r["doc_id"]), r["n_words"], round(r["log_score"], 6), r["n_full"], r["n_unseen"]) for r in stupid_backoff(docs(spark, rows), **options).collect())
    kept = {k: v for k, v in options.items() if k in ("order", "alpha", "leave_one_out")}
    want = expected(rows, **({"order": 3} | kept))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def test_empty_table(spark):
    assert stupid_backoff(docs(spark, [])).count() == 0
    assert [tuple(r) for r in stupid_backoff(docs(spark, [(1, ""), (2, None)])).orderBy("doc_id").collect()] == [(1, 0, 0.0, 0, 0), (2, 0, 0.0, 0, 0)]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = op1_lm_score(spark, sf)
    rel = duck(sf).execute(OP1_SQL)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), [d[0] for d in rel.description])


def test_words_whose_hashes_begin_alike(spark):
    """The keys of these two words share their bucket and leading 42 bits: neither occurs in the other's document."""
    (_, keys, _), *_ = gram_keys(pa.array(["w5224275 w6384291"]), 1, 3)[0]
    assert keys[0] >> 22 == keys[1] >> 22 and keys[0] != keys[1]
    rows = [(1, "one w5224275 two"), (2, "three w6384291")]
    got = {r["doc_id"]: r["n_unseen"] for r in stupid_backoff(docs(spark, rows)).collect()}
    assert got == {1: 3, 2: 2}


def test_an_input_that_changes_between_reads_raises(spark):
    def changing(frames):
        for frame in frames:
            yield frame.assign(text=frame.text + f" word{random.random()}")

    rows = docs(spark, [(k, f"some words {k}") for k in range(50)]).select("doc_id", "text")
    with pytest.raises(Exception, match="checkpoint the input first"):
        stupid_backoff(rows.mapInPandas(changing, rows.schema)).collect()


def test_blocks_and_frequent_words(spark):
    """Blocks of one document each, a word in all of them, and words that collide under polynomial hashes."""
    morse = "".join("xy"[k.bit_count() & 1] for k in range(1024))
    rows = [(k, f"the the {k % 7} of {k % 3} the end") for k in range(300)] + [(1000, morse), (1001, morse.translate(str.maketrans("xy", "yx")))]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_full"], r["n_unseen"]) for r in stupid_backoff(docs(spark, rows, 5), block_bytes=1, bucket_keys=50).collect())
    assert got == [w[:2] + w[3:] for w in expected(rows, 3)]
