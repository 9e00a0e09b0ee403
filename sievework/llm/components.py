"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, ship

#: A graph of at most so many edges (16 MB) is finished by one task; a larger one in distributed rounds.
FINISH_EDGES = 1_000_000


def smallest_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1, the smallest node each reaches over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)  # the old roots too, so that long chains shrink by halves
        np.minimum.at(label, before[v], low)
        label = label[label]
        if (label == before).all():
            return label


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids = np.sort(np.concatenate([u, v]))
    ids = ids[np.append(True, ids[1:] != ids[:-1])]
    low = smallest_reachable(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))
    out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], names=["id", "root"])
    for at in range(0, len(ids), 1 << 16):
        yield out.slice(at, 1 << 16)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str, right: str, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(id, root) for every id with an edge to another; root is the smallest id reachable.

    The edges are made distinct and counted.  Up to finish_edges of them are one small task; beyond, in rounds:
    every step groups by node with map-side combine and joins the minimum back.  The minima are written first, so both
    sides of the join are plain exchanges: a node with very many edges is a skewed partition that adaptive
    execution splits, with one row on the other side.  Rounds: logarithmic in the longest path; each is cut
    with a checkpoint.  Nulls and self-loops are ignored.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    now = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = checkpointed(now.select(u.alias("u"), v.alias("v")).distinct())
    before = _mark(now)
    if before[0] <= finish_edges:
        ship(edges.sparkSession)
        return now.coalesce(1).mapInArrow(_finish, "id long, root long")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the edges at a node's own minimum: (u, m) itself where u isn't the minimum
        own = low.where("m < k").select(F.col("k").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.union(own).distinct())
        best = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        small = large.join(best, F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.distinct())
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("root")))
