"""The pipeline against doing each step by hand."""

import random
from collections import defaultdict

import pytest

from sievework.llm import toxicity
from sievework.llm.mixing import schedule
from tests.llm.tables import docs, prose
from tests.llm.test_exact_dedup import expected as exact_expected
from tests.llm.test_minhash_dedup import expected as near_expected
from tests.llm.test_packing import PATH, check, tokenizer  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_run(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rows = [r for r in rows if scores[r[0]] < 0.3]
    stay = {d for d, keep, _, _ in exact_expected(rows) if d == keep}
    rows = [r for r in rows if r[0] in stay]
    classes = [eval(x) for x in near_expected(rows, 80)]  # noqa: S307
    stay = {d for d, _, c in classes if d == c}
    rows = [r for r in rows if r[0] in stay]
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    padding, total = check(corpus_pipeline.run(spark, SF).collect(), ids)
    assert padding == 0 and total == sum(len(v[0]) for v in ids.values())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_sequences_follow_the_schedule(spark, tmp_path):
    """Written and read again, in files whose sizes ascend: a scan takes the last of them first."""
    rng = random.Random(3)
    rows = docs(spark, [(k, prose(rng, rng.randint(100, 400)), "hot") for k in range(600)] + [(1000 + k, prose(rng, rng.randint(20, 120)), "a") for k in range(300)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mix_sources(spark, rows, SF).write.parquet(f"{tmp_path}/mixed")
        mixed = spark.read.parquet(f"{tmp_path}/mixed")
        assert len(mixed.inputFiles()) > 1
        pieces = corpus_pipeline.pack(spark, mixed, SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = {r["doc_id"]: (r["slot"], r["place"]) for r in schedule(rows).collect()}
    parts = defaultdict(list)
    for r in pieces:
        parts[r["sequence_id"] >> 32].append(plan[r["doc_id"]])
    ordered = [parts[k] for k in sorted(parts)]
    assert len(ordered) > 1 and all(max(x) < min(y) for x, y in zip(ordered, ordered[1:]))

    def reached(key):
        """Tokens of source a among the first tenths of all tokens."""
        out, done, seen = [], 0, 0
        total = sum(r["length"] for r in pieces)
        for r in sorted(pieces, key=key):
            done, seen = done + r["length"], seen + r["length"] * (r["doc_id"] >= 1000)
            while len(out) < 10 and done >= total * (len(out) + 1) // 10:
                out.append(seen)
        return out

    want = reached(lambda r: plan[r["doc_id"]])
    got = reached(lambda r: (r["sequence_id"], r["offset"]))
    assert all(abs(w - g) <= 0.1 * want[-1] for w, g in zip(want, got))
