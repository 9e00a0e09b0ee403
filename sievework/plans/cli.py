"""Command line: fit the selector on a dataset and report, or save the model."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sievework.plans.selector import CorrelationFeatureSelector
from sievework.sources import dataset_name, read_any, sample_rows


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework", description=__doc__)
    p.add_argument("path", help="a dataset with a features vector and a label, both with nominal metadata")
    p.add_argument("--format", help="of the dataset, if its suffix doesn't tell")
    p.add_argument("--sample-size", type=float, default=1.0)
    p.add_argument("--seed", type=int)
    p.add_argument("--locally-predictive", type=_flag, default=True)
    p.add_argument("--search-termination", type=int, default=5)
    p.add_argument("--vertical-partitioning", type=_flag, default=True)
    p.add_argument("--n-partitions", type=int, default=0)
    p.add_argument("--features-col", default="features")
    p.add_argument("--label-col", default="label")
    p.add_argument("--save", help="folder for the fitted model")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    df = sample_rows(read_any(spark, a.path, a.format), a.sample_size, a.seed)
    selector = CorrelationFeatureSelector(featuresCol=a.features_col, labelCol=a.label_col, locallyPredictive=a.locally_predictive, searchTermination=a.search_termination, verticalPartitioning=a.vertical_partitioning, nPartitions=a.n_partitions)
    model = selector.fit(df)
    r = model.report
    print(f"dataset: {dataset_name(a.path)} ({r.rows} rows)")
    print(f"best merit: {r.found.merit:.10f}")
    print(f"pairs requested: {r.pairs_requested}, computed: {r.pairs_computed}, in {r.rounds} rounds")
    print("dropped for a single value:", ",".join(map(str, r.dropped)) or "none")
    print("locally predictive:", ",".join(map(str, r.added)) or "none")
    print("selected:", ",".join(map(str, sorted(r.selected))) or "none")
    if a.save:
        model.write().overwrite().save(a.save)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
