"""The estimator and model on Spark."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from sievework.operators import layout
from sievework.operators.contingency import count_against, count_against_vertical
from sievework.operators.encode import assemble, encode, feature_metadata, label_metadata
from sievework.plans.cli import main
from sievework.plans.selector import CorrelationFeatureSelector, CorrelationFeatureSelectorModel
from sievework.sources import dataset_name, read_any, sample_rows
from tests.test_search import WEATHER, select

NAMES = ["o", "t", "h", "w"]


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], [*names, "y"])


def vectors(spark, rows, sizes, label_size, sparse=False):
    data = [(Vectors.sparse(len(sizes), {i: float(x) for i, x in enumerate(r[:-1]) if x}) if sparse else Vectors.dense(r[:-1]), r[-1]) for r in rows]
    df = spark.createDataFrame(data, ["features", "label"])
    return df.withMetadata("features", feature_metadata([f"f{i}" for i in range(len(sizes))], [list(map(str, range(k))) for k in sizes])).withMetadata("label", label_metadata("label", list(map(str, range(label_size)))))


@pytest.mark.parametrize("options", [{}, {"countPlan": "layout"}, {"countPlan": "layout", "nPartitions": 1}, {"countPlan": "layout", "nPartitions": 3}, {"countPlan": "layout", "verticalPartitioning": False}])
def test_layouts_agree(spark, options):
    model = CorrelationFeatureSelector(**options).fit(assemble(encode(frame(spark, WEATHER, NAMES).repartition(5), NAMES, "y")))
    assert model.selected == [0, 2] and round(model.report.found.merit, 6) == 0.247287
    assert model.report.pairs_requested == 14 and model.report.rows == 14


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        y = rng.randint(0, 2)
        rows.append((rng.randint(0, 3), y if rng.random() < 0.7 else rng.randint(0, 2), rng.randint(0, 1), (y + rng.randint(0, 1)) % 3, y))
    expected = select(rows, 3)[1]
    for sparse in (False, True):
        model = CorrelationFeatureSelector(searchTermination=3).fit(vectors(spark, rows, [4, 3, 2, 3], 3, sparse))
        assert tuple(model.selected) == expected


def test_a_wide_table(spark):
    """Some 600 features in one encoding pass; every plan finds the two that tell something."""
    rng = random.Random(5)
    names = [f"f{i}" for i in range(631)]
    rows = []
    for _ in range(150):
        y = rng.randint(0, 1)
        rows.append((*[y if i in (17, 400) and rng.random() < 0.9 else rng.randint(0, 1) for i in range(631)], y))
    encoded = encode(frame(spark, rows, names), names, "y")
    ready = assemble(encoded).cache()
    found = [CorrelationFeatureSelector(searchTermination=1, locallyPredictive=False, **o).fit(ready).selected for o in ({"countPlan": "layout", "verticalPartitioning": False}, {"countPlan": "layout", "nPartitions": 8})]
    assert found[0] == found[1] and {17, 400} <= set(found[0])
    ready.unpersist()


def test_vertical_slices(spark):
    rows = spark.createDataFrame([([k % 5, k % 3, k % 2],) for k in range(1000)], "a array<int>").repartition(3)
    got = layout.vertical_slices(rows, 3, 2, block_rows=100).collect()
    whole = {}
    for r in got:
        assert len(r["vals"]) <= 100
        whole.setdefault(r["block"], {})[r["feature"]] = r["vals"]
    back = sorted(t for b in whole.values() for t in zip(b[0], b[1], b[2]))
    assert back == sorted((k % 5, k % 3, k % 2) for k in range(1000))


@pytest.mark.parametrize("rows", [None, 10**9, 1000])
def test_vertical_counts_with_and_without_a_broadcast(spark, rows):
    table = spark.createDataFrame([([k % 5, k % 3, k % 2],) for k in range(1000)], "a array<int>").repartition(3)
    blocks = layout.vertical_slices(table, 3, 0, block_rows=64)
    want = sorted(map(tuple, count_against(table, 2, [0, 1]).collect()))
    for sizes in (None, [5, 3, 2], [5, 5000, 2]):
        assert sorted(map(tuple, count_against_vertical(blocks, 2, [0, 1], rows, sizes).collect())) == want
        assert sorted(map(tuple, count_against(table, 2, [0, 1], sizes).collect())) == want


def test_plain_columns_without_metadata(spark):
    rows = [("shor".index(o), t, h, w, y) for o, t, h, w, y in [(r[0], "hmc".index(r[1]), float("hn".index(r[2])), "ft".index(r[3]), "ny".index(r[4])) for r in WEATHER]]
    df = spark.createDataFrame(rows, "`o.o` int, t long, h double, w int, label int")
    selector = CorrelationFeatureSelector(inputCols=["o.o", "t", "h", "w"], outputCol="out")
    with pytest.raises(ValueError, match="numeric codes"):
        selector.fit(df.withColumn("t", df.t.cast("string")))
    with pytest.raises(ValueError, match="at most 3"):
        CorrelationFeatureSelector(inputCols=["o.o"], maxCategories=3).fit(df)
    plain = df.withColumnRenamed("o.o", "o")
    model = CorrelationFeatureSelector(inputCols=["o", "t", "h", "w"], outputCol="out").fit(plain)
    assert selector.fit(df).selected == model.selected == [0, 2]
    assert sorted(map(list, (r[0] for r in model.transform(plain).select(vector_to_array("out")).collect()))) == sorted([float(r[0]), float(r[2])] for r in rows)


def test_single_valued_features_are_left_out(spark):
    rows = [(0, 0, 1, 1), (0, 1, 0, 0), (0, 0, 1, 1), (0, 1, 1, 0)]
    model = CorrelationFeatureSelector().fit(vectors(spark, rows, [1, 2, 2], 2))
    assert model.report.dropped == [0] and 0 not in model.selected and model.selected[0] == 1


def test_many_categories_and_declared_values(spark):
    rows = [(k, k % 2, k % 2) for k in range(300)]
    with pytest.raises(ValueError, match="at most 255"):
        CorrelationFeatureSelector().fit(vectors(spark, rows, [300, 2], 2))
    assert CorrelationFeatureSelector(maxCategories=400).fit(vectors(spark, rows, [300, 2], 2)).selected[0] == 1
    constant = [(0, 0, 1), (0, 1, 0), (0, 1, 0)]  # declared with two values, has one
    assert CorrelationFeatureSelector(locallyPredictive=False).fit(vectors(spark, constant, [2, 3], 2)).selected == [1]


@pytest.mark.parametrize("bad", [(0.5, 0, 1), (float("nan"), 0, 1), (7, 0, 1), (-1, 0, 1), (0, 0, 5)])
def test_codes_are_checked(spark, bad):
    rows = [(0.0, 1.0, 0.0), tuple(map(float, bad))]
    with pytest.raises(ValueError, match="codes outside"):
        CorrelationFeatureSelector().fit(vectors(spark, rows, [2, 2], 2))


def test_null_label_and_empty_table(spark):
    df = vectors(spark, [(0.0, 1.0, 0.0), (1.0, 0.0, None)], [2, 2], 2)
    with pytest.raises(ValueError, match="codes outside"):
        CorrelationFeatureSelector().fit(df)
    with pytest.raises(ValueError, match="no rows"):
        CorrelationFeatureSelector().fit(df.limit(0))
    with pytest.raises(ValueError, match="no feature"):
        CorrelationFeatureSelector().fit(vectors(spark, [(0.0, 1.0)], [1], 2))


def test_schema_checks(spark):
    df = vectors(spark, [(0.0, 1.0, 0.0), (1.0, 0.0, 1.0)], [2, 2], 2)
    plain = df.withMetadata("features", {})
    numeric = df.withMetadata("features", {"ml_attr": {"num_attrs": 2, "attrs": {"numeric": [{"idx": 0}, {"idx": 1}]}}})
    binary = df.withMetadata("features", {"ml_attr": {"num_attrs": 2, "attrs": {"binary": [{"idx": 0, "vals": ["a", "b"]}], "nominal": [{"idx": 1, "vals": ["a", "b"]}]}}})
    with pytest.raises(ValueError, match="metadata"):
        CorrelationFeatureSelector().fit(plain)
    with pytest.raises(ValueError, match="must be nominal"):
        CorrelationFeatureSelector().fit(numeric)
    assert CorrelationFeatureSelector().fit(binary).selected
    whole = df.select("features", df.label.cast("int").alias("label", metadata=df.schema["label"].metadata))
    assert CorrelationFeatureSelector().fit(whole).selected
    with pytest.raises(ValueError, match="vectors"):
        CorrelationFeatureSelector(featuresCol="label").fit(df)
    with pytest.raises(ValueError, match="exists already"):
        CorrelationFeatureSelector(outputCol="label").fit(df)
    with pytest.raises(ValueError):
        CorrelationFeatureSelector(searchTermination=0).fit(df)


def test_transform_keeps_selection_order_and_rejects_an_empty_one(spark):
    df = vectors(spark, [(0.0, 1.0, 2.0, 0.0)], [2, 2, 3], 2)
    model = CorrelationFeatureSelectorModel([2, 0]).setOutputCol("out")
    out = model.transform(df)
    assert out.select(vector_to_array("out")).head()[0] == [2.0, 0.0]
    assert [a["name"] for a in out.schema["out"].metadata["ml_attr"]["attrs"]["nominal"]] == ["f2", "f0"]
    with pytest.raises(ValueError, match="no feature was selected"):
        CorrelationFeatureSelectorModel([]).transform(df)


def test_persistence_and_pipeline(spark, tmp_path):
    selector = CorrelationFeatureSelector(searchTermination=3, outputCol="chosen", nPartitions=2)
    selector.write().overwrite().save(f"{tmp_path}/selector")
    again = CorrelationFeatureSelector.load(f"{tmp_path}/selector")
    assert again.getSearchTermination() == 3 and again.getNPartitions() == 2 and again.uid == selector.uid
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i") for c in NAMES] + [StringIndexer(inputCol="y", outputCol="label")]
    pipeline = Pipeline(stages=[*index, VectorAssembler(inputCols=[f"{c}_i" for c in NAMES], outputCol="features"), again])
    df = frame(spark, WEATHER, NAMES)
    fitted = pipeline.fit(df)
    model = fitted.stages[-1]
    assert model.selected == [0, 2] and model.uid == selector.uid and model.getOutputCol() == "chosen"
    assert fitted.transform(df).select(vector_to_array("chosen")).count() == 14
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = CorrelationFeatureSelectorModel.load(f"{tmp_path}/model")
    assert loaded.selected == [0, 2] and loaded.uid == model.uid and loaded.getOutputCol() == "chosen"
    assert model.copy().selected == model.selected


def test_sources_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "w.arff").write_text("% c\n@relation w\n@attribute o {s,r, o}\n@attribute 'a b' numeric\n@attribute y {n,y}\n@data\ns,1.5,n\nr,?,y\n'o',2,y\n")
    arff = read_any(spark, f"{tmp_path}/w.arff")
    assert [tuple(r) for r in arff.collect()] == [("s", 1.5, "n"), ("r", None, "y"), ("o", 2.0, "y")]
    assert arff.schema["o"].metadata["nominal_values"] == ["s", "r", "o"]
    assert dataset_name("hdfs://host:8020/x/ECB_train.v2.parquet") == "ECB_train"
    assert sample_rows(arff, 1.0).count() == 3
    with pytest.raises(ValueError):
        sample_rows(arff, 0)
    assemble(encode(frame(spark, WEATHER, NAMES), NAMES, "y")).write.parquet(f"{tmp_path}/weather.parquet")
    assert main([f"{tmp_path}/weather.parquet", "--search-termination", "3", "--save", f"{tmp_path}/m"]) == 0
    text = capsys.readouterr().out
    assert "selected: 0,2" in text and "dataset: weather" in text
    assert CorrelationFeatureSelectorModel.load(f"{tmp_path}/m").selected == [0, 2]


def test_encode_rejects_nulls_and_too_many_values(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "a string, y string")
    with pytest.raises(ValueError, match="nulls"):
        encode(df, ["a"], "y")
    with pytest.raises(ValueError, match="at most 1"):
        encode(df.fillna("z"), ["a"], "y", max_categories=1)
