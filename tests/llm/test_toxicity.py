"""Operator 10: held-out accuracy, pairs of terms, leakage."""

import random
import zlib

import numpy as np
import pyarrow as pa

from sievework.llm import toxicity
from sievework.llm.queries import op10_toxicity
from tests.llm.tables import docs, odd_rows, prose

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op10_toxicity(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / max(1, (held.predicted == 1).sum()) > 0.95
    assert hit / (held.toxic == 1).sum() > 0.85


def test_pairs_of_terms_matter():
    """Label 1 only where two terms meet: additive weights can't rank that, factors can."""
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(["x", "y", "z", "u", "v"], 3) + ["insult"] * a + ["group"] * b + ["calm"] * (not a) + ["place"] * (not b)))
        labels.append(float(a == b))
    text, slot = toxicity.term_slots(pa.array(texts))
    y = np.array(labels)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    model = toxicity.train(slot, bounds, y, rounds=300)
    plain = toxicity.FactorizationMachine(model.slots, model.bias, model.linear, np.zeros((len(model.slots), 4)))
    right = lambda m: ((m.scores(len(texts), text, slot) > 0.5) == (y == 1)).mean()
    assert right(model) > 0.95 and right(plain) < 0.8


def test_fit_learns_pairs(spark):
    """The same by way of Spark, among other words; clean texts have the words of either kind as often."""
    rng = random.Random(4)
    rows, truth = [], []
    for k in range(2400):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = prose(rng, rng.randint(5, 60)).split() + ["insulting"] * a + ["grouping"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        truth.append((k, int(a == b)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(truth, "doc_id long, toxic int"), rounds=300)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), model).collect()}
    held = [(k, y) for k, y in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] > 0.5) == (y == 1) for k, y in held) / len(held) > 0.95


def test_score_by_a_double_loop(spark):
    """The model's formula, pair by pair over the slots of each text."""
    rng = random.Random(6)
    rows = [(k, prose(rng, 40) + " moron" * (k % 3 == 0)) for k in range(300)] + [(1000, None), (1001, "moron Moron MORON")]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int"))
    assert len(model.slots)
    at = {int(s): i for i, s in enumerate(model.slots)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), model).collect()}
    for k, text in rows:
        own = [at[s] for s in toxicity.term_slots(pa.array([text], pa.string()))[1].tolist() if s in at]
        z = model.bias + sum(model.linear[i] for i in own) + sum(model.factors[i] @ model.factors[j] for x, i in enumerate(own) for j in own[:x])
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9


def test_labels_of_the_held_out_quarter_are_never_read(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 30) + (" moron" if k % 5 == 0 else "")) for k in range(400)]
    df = docs(spark, rows)
    truth = [(k, int(k % 5 == 0)) for k in range(400)]
    lied = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in truth]
    one, two = (toxicity.fit(df, spark.createDataFrame(t, "doc_id long, toxic int")) for t in (truth, lied))
    assert (one.slots == two.slots).all() and one.bias == two.bias and (one.linear == two.linear).all()


def test_odd_rows(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    labels = spark.createDataFrame([(10, 0), (12, None), (23, 1), (23, 0), (24, 0), (99999, 1), (None, 1)] + [(100 + k, k % 2) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (20, 21, 22)}
    assert len(empty) == 1
    kept = toxicity.reject(df, model, threshold=0.5)
    assert kept.columns == df.columns
    want = sorted(str(r["doc_id"]) for r in got if r["score"] < 0.5)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_without_labels_or_rows(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    assert {r["score"] for r in toxicity.score(df, model).collect()} == {0.5}
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), none)).count() == 0
    assert toxicity.reject(docs(spark, []), model).count() == 0


def test_the_sample_is_bounded(spark):
    rows = [(k, "a b c moron" if k % 2 else "a b c") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, train_rows=60)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), model).collect()}
    assert min(scores[k] for k in range(1, 200, 2)) > max(scores[k] for k in range(0, 200, 2))
