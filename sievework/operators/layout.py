"""Row and column layouts of a code table.

Horizontal: one row per record, `a` = array of codes with the label last.  Vertical: one row per (feature, block) with the
block's column slice in record order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def horizontal(codes: DataFrame, columns: list[str]) -> DataFrame:
    return codes.select(F.array(*[F.col(f"`{c}`").cast("int") for c in columns]).alias("a"))


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """`rid` 0, 1, ... in the order of a unique numeric key.

    Ranks come in two levels, ranges of the key and ranks inside them, so no task sorts the whole table.  The ranges are
    approximate quantiles, found once, so every evaluation cuts at the same places.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.stat.approxQuantile(key, [k / parts for k in range(1, parts)], 0.5 / parts)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ranged = df.withColumn("__p", part)
    inside = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1)
    sizes = ranged.groupBy("__p").count()
    before = sizes.select(F.col("__p").alias("__q"), (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))  # a row per range
    return inside.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn("rid", F.col("__before") + F.col("__n")).drop("__p", "__q", "__n", "__before")


def assign_blocks(numbered: DataFrame, n: int, blocks: int) -> DataFrame:
    """Adds `block` = floor(rid * blocks / n)."""
    return numbered.withColumn("block", F.expr(f"cast((rid * {blocks}L) div {max(n, 1)}L as int)"))


def vertical(rows: DataFrame, columns: list[str], partitions: int = 0) -> DataFrame:
    """(feature, block, vals) from rows with `rid`, `block` and code columns; range-partitioned by feature.

    partitions = 0: one per column, label included.
    """
    long = rows.select("rid", "block", F.posexplode(F.array(*[F.col(f"`{c}`").cast("int") for c in columns])).alias("feature", "v"))
    blocks = long.groupBy("feature", "block").agg(F.array_sort(F.collect_list(F.struct("rid", "v"))).alias("s"))
    sliced = blocks.select("feature", "block", F.transform("s", lambda x: x["v"]).alias("vals"))
    return sliced.repartitionByRange(partitions or len(columns), "feature", "block").sortWithinPartitions("feature", "block")


def _slices(batches: Iterator[pa.RecordBatch], columns: int, rows: int) -> Iterator[pa.RecordBatch]:
    block, held, count = TaskContext.get().partitionId() << 32, [], 0

    def cut(codes: np.ndarray) -> pa.RecordBatch:
        flat = np.ascontiguousarray(codes.T).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(columns + 1) * len(codes), pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(range(columns), pa.int32()), pa.array([block] * columns, pa.int64()), lists], names=["feature", "block", "vals"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns))
        count += batch.num_rows
        while count >= rows:
            whole = np.concatenate(held)
            yield cut(whole[:rows])
            held, count, block = [whole[rows:]], count - rows, block + 1
    if count:
        yield cut(np.concatenate(held))


def vertical_slices(rows: DataFrame, columns: int, partitions: int = 0, block_rows: int = 1 << 16) -> DataFrame:
    """(feature, block, vals) from horizontal rows, each partition cut into blocks of block_rows where it lies; range-partitioned by feature.

    What is exchanged are whole column slices. partitions = 0: one per column, label included.
    """
    cut = rows.select("a").mapInArrow(lambda it: _slices(it, columns, block_rows), "feature int, block long, vals array<int>")
    return cut.repartitionByRange(partitions or columns, "feature", "block")
