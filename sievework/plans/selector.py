"""The feature selector as a Spark ML estimator and model."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import layout, measures
from sievework.operators.contingency import count_against, count_against_vertical, count_pairs
from sievework.operators.encode import MAX_CATEGORIES, informative
from sievework.plans.search import Correlations, Found, add_locally_predictive, best_first

#: With up to so many cells over all pairs, all of them are counted in one pass.
MATRIX_CELLS = 4_000_000
COMPILED_COLUMNS = 64


class _SelectorParams(HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCol):
    locallyPredictive = Param(Params._dummy(), "locallyPredictive", "add locally predictive features after the search", TypeConverters.toBoolean)
    searchTermination = Param(Params._dummy(), "searchTermination", "expansions in a row without improvement before the search ends, and the queue's capacity (>= 1)", TypeConverters.toInt)
    verticalPartitioning = Param(Params._dummy(), "verticalPartitioning", "count from a column-wise layout instead of rows", TypeConverters.toBoolean)
    nPartitions = Param(Params._dummy(), "nPartitions", "partitions of the column-wise layout; 0: one per feature, label included", TypeConverters.toInt)
    maxCategories = Param(Params._dummy(), "maxCategories", "most values that a feature or the label may have", TypeConverters.toInt)
    countPlan = Param(Params._dummy(), "countPlan", "auto, layout or matrix: how contingency tables are counted", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(locallyPredictive=True, searchTermination=5, verticalPartitioning=True, nPartitions=0, maxCategories=MAX_CATEGORIES, countPlan="auto")

    def getLocallyPredictive(self) -> bool:
        return self.getOrDefault(self.locallyPredictive)

    def getSearchTermination(self) -> int:
        return self.getOrDefault(self.searchTermination)

    def getVerticalPartitioning(self) -> bool:
        return self.getOrDefault(self.verticalPartitioning)

    def getNPartitions(self) -> int:
        return self.getOrDefault(self.nPartitions)

    def getMaxCategories(self) -> int:
        return self.getOrDefault(self.maxCategories)

    def getCountPlan(self) -> str:
        return self.getOrDefault(self.countPlan)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setOutputCol(self, value: str):
        return self._set(outputCol=value)


def _features(schema: T.StructType, name: str) -> list[dict]:
    """The attributes of a vector column in order."""
    if name not in schema.names:
        raise ValueError(f"no column {name!r}")
    if not isinstance(schema[name].dataType, VectorUDT):
        raise ValueError(f"column {name!r} must hold vectors")
    attrs = schema[name].metadata.get("ml_attr", {}).get("attrs")
    if not attrs:
        raise ValueError(f"column {name!r} carries no metadata on its features; each must be declared nominal")
    flat = sorted((a | {"kind": kind} for kind, group in attrs.items() for a in group), key=lambda a: a["idx"])
    declared = schema[name].metadata["ml_attr"].get("num_attrs", len(flat))
    if [a["idx"] for a in flat] != list(range(declared)):
        raise ValueError(f"the metadata of {name!r} doesn't cover all features")
    return flat


def _plain(schema: T.StructType, names: list[str]) -> list[dict]:
    """The attributes that plain columns declare, empty where there are none."""
    for c in names:
        if c not in schema.names or not isinstance(schema[c].dataType, T.NumericType):
            raise ValueError(f"column {c!r} must be numeric codes")
    found = [schema[c].metadata.get("ml_attr", {}) for c in names]
    return [a | {"idx": i, "name": c} if a else {} for i, (a, c) in enumerate(zip(found, names))]


def _cardinality(attr: dict, what: str, most: int) -> int:
    kind = attr.get("kind", attr.get("type"))
    if kind not in ("nominal", "binary"):
        raise ValueError(f"{what} must be nominal, it is {kind}")
    n = len(attr["vals"]) if "vals" in attr else 2 if kind == "binary" else attr.get("num_vals", 0)
    if n < 1:
        raise ValueError(f"{what} declares no values")
    if n > most:
        raise ValueError(f"{what} declares {n} values; at most {most} are allowed")
    return n


@dataclass
class FitReport:
    """What the search did."""

    rows: int
    found: Found
    selected: list[int]
    kept: list[int]
    dropped: list[int]
    added: list[int]
    pairs_requested: int
    pairs_computed: int
    rounds: int

    def trace(self, spark: SparkSession) -> DataFrame:
        name = lambda state: ",".join(str(self.kept[i]) for i in state)
        rows = [(k, name(s.expanded), s.partners, name(s.head), float(s.merit), s.improved, s.fails) for k, s in enumerate(self.found.trace, 1)]
        return spark.createDataFrame(rows, "it int, expanded string, n_new int, head string, merit double, improved boolean, fails int")


class CorrelationFeatureSelector(Estimator, _SelectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Choose the features whose subset has the highest correlation-based merit for a nominal label.

    The input has a vector column of category codes with nominal metadata, and a label column likewise. Or the features are
    plain columns of codes, named by inputCols: one without metadata, and then the label too, has as many values as its
    largest code tells.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", inputCols=None, labelCol="label", outputCol=None, locallyPredictive=True, searchTermination=5, verticalPartitioning=True, nPartitions=0, maxCategories=MAX_CATEGORIES, countPlan="auto"):
        super().__init__()
        self._setDefault(outputCol=f"{self.uid}__output")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setInputCols(self, value: list[str]):
        return self._set(inputCols=value)

    def setLocallyPredictive(self, value: bool):
        return self._set(locallyPredictive=value)

    def setSearchTermination(self, value: int):
        return self._set(searchTermination=value)

    def setVerticalPartitioning(self, value: bool):
        return self._set(verticalPartitioning=value)

    def setNPartitions(self, value: int):
        return self._set(nPartitions=value)

    def setMaxCategories(self, value: int):
        return self._set(maxCategories=value)

    def setCountPlan(self, value: str):
        return self._set(countPlan=value)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        """Checks columns and metadata; the schema with the output column."""
        self._check(schema)
        return _with_output(schema, self.getOutputCol())

    def _check(self, schema: T.StructType) -> tuple[list[int], int]:
        if self.getSearchTermination() < 1:
            raise ValueError("searchTermination must be at least 1")
        if self.getNPartitions() < 0:
            raise ValueError("nPartitions can't be negative")
        if self.getCountPlan() not in ("auto", "layout", "matrix"):
            raise ValueError("countPlan is one of auto, layout, matrix")
        plain = self.isDefined(self.inputCols)
        attrs, most = _plain(schema, self.getInputCols()) if plain else _features(schema, self.getFeaturesCol()), self.getMaxCategories()
        label = self.getLabelCol()
        if label not in schema.names:
            raise ValueError(f"no column {label!r}")
        if not isinstance(schema[label].dataType, T.NumericType):
            raise ValueError(f"column {label!r} must be numeric")
        sizes = [_cardinality(a, f"feature {a.get('name', a['idx'])!r}", most) if a else None for a in attrs]
        of_label = schema[label].metadata.get("ml_attr", {})
        return sizes, None if plain and not of_label else _cardinality(of_label, f"label {label!r}", most)

    def _counted(self, dataset: DataFrame, columns: list[str], sizes: list[int | None]) -> list[int]:
        """The sizes, those not declared from the largest code of the column, all in one pass."""
        lacking = [c for c, n in zip(columns, sizes) if n is None]
        if not lacking:
            return sizes
        largest = dataset.agg(*[F.max(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(lacking)]).first()
        found = {}
        for c, code in zip(lacking, largest):
            found[c] = 1 if code is None or code != code else int(code) + 1
            if found[c] > self.getMaxCategories():
                raise ValueError(f"column {c!r} has codes up to {code}; at most {self.getMaxCategories()} values are allowed")
        return [found[c] if n is None else n for c, n in zip(columns, sizes)]

    def _fit(self, dataset: DataFrame) -> "CorrelationFeatureSelectorModel":
        _with_output(dataset.schema, self.getOutputCol())
        sizes, label_size = self._check(dataset.schema)
        plain = self.getInputCols() if self.isDefined(self.inputCols) else None
        if plain:
            *sizes, label_size = self._counted(dataset, [*plain, self.getLabelCol()], [*sizes, label_size])
        kept = informative(sizes)
        if not kept:
            raise ValueError("no feature has more than one value")
        limits = [*[sizes[i] for i in kept], label_size]
        vector = F.array(*[F.col(f"`{c}`").cast("double") for c in plain]) if plain else vector_to_array(F.col(self.getFeaturesCol()))
        raw = dataset.select(vector.alias("v"), F.col(self.getLabelCol()).cast("double").alias("y"))
        if len(kept) == len(sizes):
            raw = raw.select(F.expr("concat(v, array(y))").alias("d"))
        elif len(kept) < COMPILED_COLUMNS:
            raw = raw.select(F.array(*[F.col("v")[i] for i in kept], F.col("y")).alias("d"))
        else:
            raw = raw.select(F.expr(f"concat(transform(array({', '.join(map(str, kept))}), i -> v[i]), array(y))").alias("d"))
        # one comparison for each column is compiled; beyond some hundred columns a loop over the array is better
        bad = lambda x, k: x.isNull() | F.isnan(x) | (x < 0) | (x >= k) | (x != F.floor(x))
        if len(limits) <= COMPILED_COLUMNS:
            wrong = functools.reduce(operator.or_, (bad(F.col("d")[k], F.lit(n)) for k, n in enumerate(limits)))
            codes = F.array(*[F.expr(f"try_cast(d[{k}] as int)") for k in range(len(limits))])
        else:
            wrong = F.exists(F.arrays_zip("d", F.array(*map(F.lit, limits)).alias("k")), lambda x: bad(x["d"], x["k"]))
            codes = F.expr("transform(d, x -> try_cast(x as int))")
        checked = raw.select(codes.alias("a"), F.coalesce(wrong, F.lit(True)).alias("wrong"))
        rows = checked.persist()
        try:
            n, bad = rows.agg(F.count(F.lit(1)), F.count_if("wrong")).first()
            if n == 0:
                raise ValueError("the dataset has no rows")
            if bad:
                raise ValueError(f"{bad} rows hold nulls or codes outside the declared values")
            label = len(kept)
            correlations = Correlations(label, values=self._value_source(rows.select("a"), limits, n))
            found = best_first(label, correlations, self.getSearchTermination())
            requested = correlations.requested
            subset = found.subset
            if self.getLocallyPredictive():
                subset = add_locally_predictive(subset, label, correlations)
        finally:
            rows.unpersist()
            for df in getattr(self, "_held", []):
                df.unpersist()
            self._held = []
        selected = [kept[i] for i in subset]
        model = self._copyValues(CorrelationFeatureSelectorModel(selected))
        model._resetUid(self.uid)
        model._set_parent(self)
        model.report = FitReport(n, found, selected, kept, [i for i in range(len(sizes)) if i not in kept], [kept[i] for i in subset[len(found.subset) :]], requested, correlations.computed, correlations.rounds)
        return model

    def _value_source(self, rows: DataFrame, limits: list[int], n: int):
        """Correlations on request. Entropies are summed up in Spark: one number for each column and each pair comes back."""
        p = len(limits) - 1
        every = [(i, j) for i in range(p + 1) for j in range(i + 1, p + 1)]
        h = {r["i"]: r["h"] for r in measures.feature_entropies(rows, p + 1).collect()}  # a row per column
        plan = self.getCountPlan()
        if plan == "auto":
            plan = "matrix" if sum(limits[i] * limits[j] for i, j in every) <= MATRIX_CELLS else "layout"
        value = lambda i, j, joint: measures.uncertainty(h[i], h[j], joint, p in (i, j))
        if plan == "matrix":
            known: dict[tuple[int, int], float] = {}

            def from_matrix(fixed: int, partners: list[int]) -> dict[int, float]:
                if not known:
                    columns = rows.select(*[F.col("a")[k].alias(f"c{k}") for k in range(p + 1)])
                    cells = count_pairs(columns, columns.columns, limits, every)
                    known.update({(i, j): value(i, j, joint) for i, j, joint in measures.joint_entropies(cells, ["i", "j"]).collect()})
                return {q: known[min(q, fixed), max(q, fixed)] for q in partners}

            return from_matrix
        if self.getVerticalPartitioning():
            held = layout.vertical_slices(rows, p + 1, self.getNPartitions()).persist()
            self._held = [held]
            counting = lambda fixed, partners: count_against_vertical(held, fixed, partners, n, limits)
        else:
            counting = lambda fixed, partners: count_against(rows, fixed, partners, limits)

        def from_layout(fixed: int, partners: list[int]) -> dict[int, float]:
            joints = measures.joint_entropies(counting(fixed, partners), ["i"]).collect()
            return {i: value(i, fixed, joint) for i, joint in joints}

        return from_layout


def _with_output(schema: T.StructType, name: str) -> T.StructType:
    if name in schema.names:
        raise ValueError(f"the output column {name!r} exists already")
    return T.StructType([*schema.fields, T.StructField(name, VectorUDT(), False)])


class CorrelationFeatureSelectorModel(Model, _SelectorParams, MLReadable, MLWritable):
    """Keeps the selected features, in the order of their selection."""

    def __init__(self, selected: list[int] | None = None):
        super().__init__()
        self.selected = [int(i) for i in selected or []]
        self.report: FitReport | None = None
        self.parent = None
        self._setDefault(outputCol=f"{self.uid}__output")

    def _set_parent(self, parent: Estimator) -> None:
        self.parent = parent

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        if self.isDefined(self.inputCols):
            _plain(schema, self.getInputCols())
        elif self.getFeaturesCol() not in schema.names or not isinstance(schema[self.getFeaturesCol()].dataType, VectorUDT):
            raise ValueError(f"column {self.getFeaturesCol()!r} must hold vectors")
        return _with_output(schema, self.getOutputCol())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.selected:
            raise ValueError("no feature was selected, so there is nothing to keep")
        self.transformSchema(dataset.schema)
        if self.isDefined(self.inputCols):
            return VectorAssembler(inputCols=[self.getInputCols()[i] for i in self.selected], outputCol=self.getOutputCol()).transform(dataset)
        return VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), indices=self.selected).transform(dataset)

    def copy(self, extra=None) -> "CorrelationFeatureSelectorModel":
        out = CorrelationFeatureSelectorModel(self.selected)
        out._resetUid(self.uid)
        out.report, out.parent = self.report, self.parent
        return self._copyValues(out, extra)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: CorrelationFeatureSelectorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        spark.createDataFrame([(self.model.selected,)], "selectedFeats array<int>").coalesce(1).write.parquet(f"{path}/data")


class _ModelReader(MLReader):
    def load(self, path: str) -> CorrelationFeatureSelectorModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = CorrelationFeatureSelectorModel(spark.read.parquet(f"{path}/data").select("selectedFeats").head()[0])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
