"""Nominal columns: dense integer codes, and the ML metadata that declares their values."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CATEGORIES = 255


@dataclass
class Encoded:
    """codes: a column of integer codes named as the original for each input column, then `label`."""

    codes: DataFrame
    features: list[str]
    values: dict[str, list]

    @property
    def cardinalities(self) -> list[int]:
        return [len(self.values[c]) for c in [*self.features, "label"]]


def categories(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list]:
    """The sorted different values of each column; one pass, partial aggregation, at most max_categories + 1 values a column reach the driver."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("s")) for i, c in enumerate(columns)])
    seen = df.select(F.explode(every).alias("x")).select("x.*").distinct().limit(len(columns) * (max_categories + 1) + 1).collect()
    if not seen:
        raise ValueError("the dataset has no rows")
    counts = Counter(r["i"] for r in seen)
    for i, n in counts.most_common():
        if n > max_categories:
            raise ValueError(f"column {columns[i]!r} has more than {max_categories} different values; at most {max_categories} are allowed")
    types = {c: df.schema[c].dataType for c in columns}
    out: dict[str, list] = {c: [] for c in columns}
    for r in seen:
        c = columns[r["i"]]
        if r["s"] is None:
            raise ValueError(f"column {c!r} holds nulls; encode them as a value of their own first")
        out[c].append(r["s"])
    for c, kind in types.items():
        if isinstance(kind, (T.IntegralType, T.FractionalType)):
            out[c].sort(key=float)
        elif isinstance(kind, T.BooleanType):
            out[c].sort(key=lambda s: s == "true")
        else:
            out[c].sort(key=lambda s: s.encode())
    return out


def with_codes(df: DataFrame, columns: list[str], values: dict[str, list], keep: list[str] | None = None) -> DataFrame:
    """The codes 0 .. k-1 of the columns, in the order of their values, as c0, c1, ...; the columns of keep before them.

    One projection however many columns there are: each is looked up in a hash table of its own (bounded) list of values.
    """
    kept = [F.col(f"`{c}`") for c in keep or []]
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)], *[c.alias(f"k{i}") for i, c in enumerate(kept)])
    lists = [values[c] for c in columns]
    schema = ", ".join([f"c{i} int" for i in range(len(columns))] + [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep or [])])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [pa.array(x, pa.string()) for x in lists]
        for batch in batches:
            codes = [pc.index_in(c, value_set=x) for c, x in zip(batch.columns, sets)]
            yield pa.RecordBatch.from_arrays([*codes, *batch.columns[len(sets) :]], names=batch.schema.names)

    return text.mapInArrow(coded, schema)


def encode(df: DataFrame, features: list[str], label: str, max_categories: int = MAX_CATEGORIES) -> Encoded:
    """Dense codes 0 .. k-1 in the order of the values, all columns in one pass."""
    columns = [*features, label]
    values = categories(df, list(dict.fromkeys(columns)), max_categories)
    codes = with_codes(df, columns, values).toDF(*features, "label")
    return Encoded(codes, list(features), {**{c: values[c] for c in features}, "label": values[label]})


def feature_metadata(names: list[str], values: list[list[str]]) -> dict:
    attrs = [{"idx": i, "name": n, "vals": [str(x) for x in v]} for i, (n, v) in enumerate(zip(names, values))]
    return {"ml_attr": {"num_attrs": len(attrs), "attrs": {"nominal": attrs}}}


def label_metadata(name: str, values: list[str]) -> dict:
    return {"ml_attr": {"type": "nominal", "name": name, "vals": [str(x) for x in values]}}


def assemble(encoded: Encoded, features_col: str = "features", label_col: str = "label") -> DataFrame:
    """(features vector, label double) with nominal metadata, ready for the selector."""
    vectors = VectorAssembler(inputCols=encoded.features, outputCol="__features").transform(encoded.codes)
    meta = feature_metadata(encoded.features, [encoded.values[c] for c in encoded.features])
    return vectors.select(
        F.col("__features").alias(features_col, metadata=meta),
        F.col("label").cast("double").alias(label_col, metadata=label_metadata(label_col, encoded.values["label"])),
    )


def informative(cardinalities: list[int]) -> list[int]:
    """Indices of the features with more than one declared value."""
    return [i for i, k in enumerate(cardinalities) if k > 1]
