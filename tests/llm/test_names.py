"""Every operator and stage over one table whose columns have every name that operators use inside, dots, and the extreme ids."""

import pytest
from pyspark.sql import types as T

from sievework.llm import embedding_dedup, exact_dedup, html_text, lm_score, minhash_dedup, mixing, packing, secrets, toxicity, url_filter
from sievework.llm.queries import tokenizer_path
from tests.llm.tables import odd_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LOW, HIGH = -(2**63), 2**63 - 1
CLASHING = [
    "x.y", "__key", "__gone", "__digest", "__points", "__id", "__d", "__p", "__file", "__row", "id", "key", "gone", "digest", "points", "of_id", "of_digest", "of_points", "file", "row", "rest", "run", "n",
    "m", "w", "s", "t", "u", "slot", "place", "part", "group", "before", "size", "z", "label", "kept", "score", "component_id", "n_shingles", "keep_id", "group_size", "rid", "root", "chunks", "d1", "d2", "block", "bucket", "nth", "Text.", "we`ird",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def rows():
    texts = [*odd_rows(3), (LOW, "the lowest id has this text"), (HIGH, "the  highest id has another one"), (HIGH - 1, "the highest  id has another one"), (LOW + 1, None)]
    return [(i, t, [None, "a", "b", "a.b"][k % 4], *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(texts)]


def table(spark, of):
    return spark.createDataFrame(of, SCHEMA).repartition(3) if of else spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, toxic int, `x.y` string"


def operators(df, labels):
    return {
        "op1": lm_score.stupid_backoff(df),
        "op2": url_filter.judge_urls(df, [("com", "/", "block")], id_col="doc_id", url_col="text"),
        "op3": html_text.extract_text(df, id_col="doc_id", html_col="text"),
        "op4": minhash_dedup.near_duplicates(df),
        "op6": secrets.scan(df),
        "op7": mixing.schedule(df),
        "op8": exact_dedup.exact_duplicates(df),
        "op10": toxicity.score(df, toxicity.fit(df, labels)),
    }


def test_operators(spark):
    plain = table(spark, rows()).select("doc_id", "text", "source")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(100, 140)], LABELS)
    want, got = operators(plain, labels), operators(table(spark, rows()), labels)
    for name in want:
        a, b = want[name].toPandas(), got[name].toPandas()
        assert sorted(map(str, a.round(6).itertuples(index=False))) == sorted(map(str, b.round(6).itertuples(index=False))), name
    pieces = packing.pack_documents(table(spark, rows()), tokenizer_path()).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in rows()}


def test_extreme_ids(spark):
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(table(spark, rows())).collect()}
    assert got[LOW] == (LOW, True) and got[HIGH] == (HIGH - 1, False) and got[HIGH - 1] == (HIGH - 1, True)
    near = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(table(spark, rows())).collect()}
    assert near[LOW] == LOW and near[HIGH] == HIGH - 1


def test_other_names_for_the_columns(spark):
    """Ids and texts under names with dots and blanks."""
    df = table(spark, rows()).select("doc_id", "text", "source").toDF("doc.id", "a text", "s`rc")
    names = {"id_col": "doc.id", "text_col": "a text"}
    plain = table(spark, rows())
    assert sorted(map(str, (r[0] for r in exact_dedup.drop_duplicates(df, **names).collect()))) == sorted(str(r["doc_id"]) for r in exact_dedup.drop_duplicates(plain).collect())
    assert sorted(map(str, (r[0] for r in minhash_dedup.drop_near_duplicates(df, **names).collect()))) == sorted(str(r["doc_id"]) for r in minhash_dedup.drop_near_duplicates(plain).collect())
    assert mixing.mixed(df, id_col="doc.id", source_col="s`rc").count() == len(rows())
    assert lm_score.stupid_backoff(df, **names).count() == secrets.scan(df, **names).count() == len(rows())
    vectors = spark.createDataFrame([(LOW, [1.0, 2.0], "a", 1), (HIGH, [1.0, 2.0], "a", 2)], "`v.id` long, `e.e` array<double>, `l.l` string, id int")
    got = embedding_dedup.near_duplicates(vectors, id_col="v.id", vector_col="e.e", label_col="l.l").collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(LOW, 1, LOW), (HIGH, 1, LOW)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    """Each stage over the written result of the one before; whole rows stay as they were."""
    spark.createDataFrame([(k, k % 2, "x") for k in range(100, 140)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    given = [] if empty else rows()
    docs = table(spark, given)
    known = {str(tuple(r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = [str(tuple(r)) for r in docs.collect()]
        assert set(left) <= known and len(left) == len(set(left)), name
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
