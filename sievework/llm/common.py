"""Session plumbing that the operators of this subpackage share."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sievework

_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Ready the session for operators with Python workers.

    Bounds the Arrow batches by bytes, unless the application set a bound of its own, and sends the package to the executors
    once per application, so that workers can import it from anywhere.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, "16m")
    if context.applicationId in _shipped:
        return
    top = Path(sievework.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp(prefix="sievework-")
    path = os.path.join(folder, "sievework_package.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names; a folder of our own is used only where none is set, on a local master."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark, "sievework-checkpoint-"))
    return df.checkpoint(eager=True)


#: Up to so many short rows are broadcast, after counting them; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows. df is cheap to count: checkpoint it first."""
    return F.broadcast(df) if df.count() <= rows else df


def named(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a new one of this machine, on a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal key as tables, across batches; the rows of a partition come sorted by the key."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rows.num_rows == 0:
            continue
        keys = rows.column(key).combine_chunks()
        encoded = pc.run_end_encode(keys)
        low = 0
        for value, high in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist()):
            if held and value != held_key:
                yield pa.concat_tables(held)
                held = []
            held_key = value
            held.append(rows.slice(low, high - low))
            low = high
    if held:
        yield pa.concat_tables(held)


def in_batches(rows: pa.Table, schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    yield from rows.cast(schema).to_batches(max_chunksize=size)


QueryMap = dict[str, Callable[[SparkSession, str], DataFrame]]
