"""Pairwise contingency counts as a sparse relation (i, j, v, w, n)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tables of up to so many cells are counted as arrays, larger ones as the different pairs of a batch.
ARRAY_CELLS = 4096


def _counted(v: np.ndarray, w: np.ndarray, size_v: int, size_w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, n) of the pairs that occur."""
    both = v.astype(np.int64) * size_w + w
    if size_v * size_w <= ARRAY_CELLS:
        table = np.bincount(both, minlength=1)
        at = np.flatnonzero(table)
        n = table[at]
    else:
        at, n = np.unique(both, return_counts=True)
    return at // size_w, at % size_w, n


def _cell_batch(found: list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    cols = [np.concatenate([np.full(len(c[2]), i) for i, c in found])] + [np.concatenate([c[k] for _, c in found]) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "v", "w", "n"])


def _against(batches: Iterator[pa.RecordBatch], fixed: int, partners: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes = np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T)
            yield _cell_batch([(i, _counted(codes[i], codes[fixed], sizes[i], sizes[fixed])) for i in partners])


def _against_blocks(batches: Iterator[pa.RecordBatch], fixed: int, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, i in enumerate(batch.column(0).to_pylist()):
            v, w = (batch.column(c)[k].values.to_numpy() for c in (1, 2))
            yield _cell_batch([(i, _counted(v, w, sizes[i], sizes[fixed]))])


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("i", "v", "w").agg(F.sum("n").alias("n"))


def count_against(rows: DataFrame, fixed: int, partners: list[int], sizes: list[int] | None = None) -> DataFrame:
    """(i, v, w, n): counts of partner i's value v beside the fixed feature's value w, from horizontal rows.

    One generate and one hash aggregate with partial sums: what is shuffled are cells, not rows.  With the sizes of all
    columns given, batches are counted as arrays, so that neither the plan nor the rows made grow with the partners.
    """
    if sizes is not None:
        return _summed(rows.select("a").mapInArrow(lambda it: _against(it, fixed, partners, sizes), "i int, v int, w int, n long"))
    picked = F.array(*[F.struct(F.lit(i).alias("i"), F.col("a")[i].alias("v")) for i in partners])
    cells = rows.select(F.explode(picked).alias("x"), F.col("a")[fixed].alias("w"))
    return cells.groupBy(F.col("x.i").alias("i"), F.col("x.v").alias("v"), "w").agg(F.count(F.lit(1)).alias("n"))


#: The fixed feature's column is broadcast up to so many rows (four bytes each); a longer one is joined by block in an exchange.
BROADCAST_ROWS = 16_000_000


def count_against_vertical(blocks: DataFrame, fixed: int, partners: list[int], rows: int | None = None, sizes: list[int] | None = None) -> DataFrame:
    """The same from vertical blocks: the fixed column's blocks meet the partners' by block and position.

    rows: of the table, where known; decides whether the fixed column is broadcast to the partners' partitions. sizes: as above.
    """
    mine = blocks.where(F.col("feature") == fixed).select(F.col("block").alias("b"), F.col("vals").alias("fixed_vals"))
    if rows is not None and rows <= BROADCAST_ROWS:
        mine = F.broadcast(mine)
    theirs = blocks.where(F.col("feature").isin(partners))
    if sizes is not None:
        met = theirs.join(mine, F.col("block") == F.col("b")).select("feature", "vals", "fixed_vals")
        return _summed(met.mapInArrow(lambda it: _against_blocks(it, fixed, sizes), "i int, v int, w int, n long"))
    met = theirs.join(mine, F.col("block") == F.col("b")).select(F.col("feature").alias("i"), F.explode(F.arrays_zip("vals", "fixed_vals")).alias("x"))
    return met.groupBy("i", F.col("x.vals").alias("v"), F.col("x.fixed_vals").alias("w")).agg(F.count(F.lit(1)).alias("n"))


_CELLS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.int32()), ("w", pa.int32()), ("n", pa.int64())])


def _matrix(batches: Iterator[pa.RecordBatch], sizes: list[int], pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    tables = {p: np.zeros(sizes[p[0]] * sizes[p[1]], np.int64) for p in pairs}
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for i, j in pairs:
            tables[i, j] += np.bincount(cols[i].astype(np.int64) * sizes[j] + cols[j], minlength=sizes[i] * sizes[j])
    out: list[list[np.ndarray]] = [[] for _ in _CELLS]
    for (i, j), t in tables.items():
        at = np.flatnonzero(t)
        for col, x in zip(out, (np.full(len(at), i), np.full(len(at), j), at // sizes[j], at % sizes[j], t[at])):
            col.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), f.type) for c, f in zip(out, _CELLS)], schema=_CELLS)


def count_pairs(codes: DataFrame, columns: list[str], sizes: list[int], pairs: list[tuple[int, int]]) -> DataFrame:
    """(i, j, v, w, n) of many pairs in one pass: vectorised partial tables per task, then a sum of cells.

    The tables of a task take 8 * sum(sizes[i] * sizes[j]) bytes, bounded by the category limit.
    """
    rows = codes.select(*[F.col(f"`{c}`").cast("int").alias(f"c{k}") for k, c in enumerate(columns)])
    partial = rows.mapInArrow(lambda it: _matrix(it, sizes, pairs), "i int, j int, v int, w int, n long")
    return partial.groupBy("i", "j", "v", "w").agg(F.sum("n").alias("n"))


def merged(*tables: DataFrame) -> DataFrame:
    """Counts over the rows of all tables together."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    keys = [c for c in whole.columns if c != "n"]
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"))
