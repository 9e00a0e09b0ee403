"""Reading datasets by path: Parquet, CSV, ORC, JSON and ARFF; sampling; dataset names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SUFFIX = {"csv": "csv", "json": "json", "orc": "orc", "parquet": "parquet", "arff": "arff"}


def dataset_name(path: str) -> str:
    """The last part of a path up to its first dot."""
    return path.rstrip("/").split("/")[-1].split(".")[0]


def read_any(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A dataset of any supported format, by its suffix unless named; without a suffix it is Parquet."""
    kind = format or _SUFFIX.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "parquet")
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "arff":
        return read_arff(spark, path)
    return spark.read.format(kind).load(path)


def sample_rows(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """A Bernoulli sample without replacement; everything for a fraction of 1."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    return df if fraction == 1 else df.sample(False, fraction, seed)


def _arff_header(lines: list[str]) -> list[tuple[str, list[str] | None]]:
    """(name, values of a nominal attribute or None) of each attribute."""
    found = []
    for line in lines:
        m = re.match(r"\s*@attribute\s+('(?:[^']*)'|\"(?:[^\"]*)\"|\S+)\s+(.*)$", line, re.I)
        if m:
            kind = m[2].strip()
            values = [v.strip().strip("'\"") for v in kind[1 : kind.rindex("}")].split(",")] if kind.startswith("{") else None
            found.append((m[1].strip("'\""), values))
    return found


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """A dense ARFF file: nominal attributes as strings with their declared values in the metadata, the others as doubles. `?` is null."""
    text = spark.read.text(path)
    line = F.trim("value")
    header = [r[0] for r in text.where(F.lower(line).startswith("@attribute")).collect()]
    attributes = _arff_header(header)
    data = text.where((line != "") & ~line.startswith("%") & ~line.startswith("@"))
    schema = ", ".join(f"`{name}` string" for name, _ in attributes)
    options = {"quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = data.select(F.from_csv("value", schema, options).alias("r"))
    columns = []
    for name, values in attributes:
        c = F.col(f"r.`{name}`")
        columns.append(c.cast("double").alias(name) if values is None else c.alias(name, metadata={"nominal_values": values}))
    return parsed.select(*columns)
