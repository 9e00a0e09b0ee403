"""The corpus pipeline: five stages over `documents`, each one of the operators of sievework.llm.

    toxicity -> exact dedup -> MinHash near dedup -> mixing to target weights -> packing

Every stage takes all rows that the one before it kept and is written as Parquet before the next begins, so a lost
executor costs no more than its tasks of the stage at hand.  All stages but the last return the columns of
`documents`; a null or empty text passes the filters (only one empty text stays, being copies of each other).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from sievework.llm.common import shared_folder, table
from sievework.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score 0.3 or more go. The model is trained on the labelled rows among docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of texts that are equal but for white space one stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each class of near duplicates, linked at a similarity of 0.8, the smallest id stays."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: all documents, laid out in the order of the schedule."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of all documents in sequences, numbered in the order of the schedule."""
    return packing.pack_documents(mixing.in_file_order(docs), tokenizer_path(), in_order=True, block_tokens=1 << 17)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokens aren't expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written and read again under the shared folder of spark.checkpoint.dir."""
    folder = f"{shared_folder(spark, 'corpus-pipeline-')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
