"""Operator 5: near-duplicate embeddings by cover-tree dual traversal, exact at the threshold.

Vectors of one label are compared by the distance of their directions; cosine >= c is distance <= sqrt(2 - 2c).

1. Equal vectors of a label become one numbered representative with a count (map-side combined, so a vector that fills a
   third of the table is one row).
2. The upper levels of a label's cover tree are built level by level over the whole label: every cell that is too large for a
   task gets centres, a level of a cover tree over a bounded sample of its vectors (`sample_rows` over all cells of a
   level), each of its vectors goes to the nearest, and the new cells' covering radii are measured over all of them.
3. Both trees are walked at once as a relation: the pairs of cells that are left become the pairs of their children, and
   those whose centres are further apart than the covering radii and the threshold are dropped.  Only vectors of leaf
   cells that are still paired at the end meet; a leaf that couldn't be split is cut into chunks by a hash.
4. Each pair of leaf chunks is one task.  It carries the cover tree on below (levels of halving radii, centres found in
   blocks by matrix products) and walks both sides at once: a pair of nodes is dropped by the same bound, taken whole
   when even the farthest members are within the threshold, and opened otherwise; leaves are compared in
   double precision.  What leaves the task is one row per linked vector (its number of links, and the first one that it
   reaches there), never a list of pairs.
5. The rows are added up per representative, and connected components are taken over the (vector, first) edges.

Every pair of rows is considered in exactly one task, so no link is lost; memory per task is two chunks.
Directions without structure can't be pruned by any covering radius: then the sample's level has as many centres as vectors,
the cell stays whole, and the number of chunk pairs of a label grows with the square of its size, in blocks.

Defined results for odd input: a vector that is null, empty, zero or holds null or non-finite components, a null label
or a null id links with nothing and is its own component (null for a null id); vectors of different lengths never
link; rows of equal id count as separate vectors, each with its own links; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, named, runs, ship, small_side
from sievework.llm.components import components, smallest_reachable

LEAF = 48
_SLACK = 1e-7
_BLOCK = 256


class Node:
    __slots__ = ("centre", "radius", "members", "children")

    def __init__(self, centre: int, members: np.ndarray, least_dot: float):
        self.centre, self.members = centre, members
        self.radius = math.sqrt(max(0.0, 2 - 2 * least_dot)) if len(members) > 1 else 0.0
        self.children: list[Node] = []


def _cover(x: np.ndarray, members: np.ndarray, centre: int, limit: float) -> list[Node]:
    """Nodes that cover the members, each within the cosine limit of its centre; centres are further apart. The first keeps the given centre."""
    out: list[Node] = []
    left = np.concatenate([[centre], members[members != centre]])
    while len(left):
        block = left[:_BLOCK]
        near = x[block] @ x[block].T >= limit
        chosen, covered = [], np.zeros(len(block), bool)
        for i in range(len(block)):
            if not covered[i]:
                chosen.append(i)
                covered |= near[i]
        dots = x[left] @ x[block[chosen]].T
        best = dots.argmax(1)
        best[chosen] = np.arange(len(chosen))
        dot = dots[np.arange(len(left)), best]
        hit = dot >= limit
        hit[chosen] = True
        by = np.flatnonzero(hit)
        by = by[np.argsort(best[by], kind="stable")]
        bounds = np.searchsorted(best[by], np.arange(len(chosen) + 1))
        least = np.minimum.reduceat(dot[by], bounds[:-1])
        own = left[by]
        out += [Node(int(block[c]), own[a:b], float(d)) for c, a, b, d in zip(chosen, bounds[:-1].tolist(), bounds[1:].tolist(), least)]
        left = left[~hit]
    return out


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree over unit rows: each level's centres cover their members within half the radius of the level above."""
    root = Node(0, np.arange(len(x)), float((x @ x[0]).min()))
    todo = [(root, 1.0)]
    while todo:
        node, reach = todo.pop()
        if len(node.members) <= leaf or node.radius <= 1e-6:
            continue
        while reach >= node.radius:
            reach /= 2
        node.children = _cover(x, node.members, node.centre, 1 - reach * reach / 2)  # cosine at that distance
        todo += [(child, reach / 2) for child in node.children]
    return root


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def dual_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Links between rows of x and y (of x among themselves if y is None), as blocks (rows of x, rows of y, whole).

    whole: every row of the first array links with every row of the second; else the arrays are pairs.
    """
    own = y is None
    y = x if own else y
    reach = math.sqrt(2 - 2 * cosine)
    left = cover_tree(x)
    right = left if own else cover_tree(y)
    found: list[tuple[np.ndarray, np.ndarray, bool]] = []
    todo = [(left, right, own)]
    while todo:
        a, b, same = todo.pop()
        if not a.children and not b.children:
            hit = x[a.members] @ y[b.members].T >= cosine
            if same:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            if len(i):
                found.append((a.members[i], b.members[j], False))
            continue
        if same:
            todo += [(c, c, True) for c in a.children]
        more_a = a.children if a.children and (same or not b.children or a.radius >= b.radius) else [a]
        more_b = b.children if b.children and (same or not a.children or b.radius >= a.radius) else [b]
        ra, rb = np.array([n.radius for n in more_a])[:, None], np.array([n.radius for n in more_b])[None, :]
        cb = y[[n.centre for n in more_b]]
        for low in range(0, len(more_a), 512):  # a bounded matrix of distances at a time
            d = _apart(x[[n.centre for n in more_a[low : low + 512]]], cb)
            open_ = d <= ra[low : low + 512] + rb + reach + _SLACK
            if same:
                open_ &= np.arange(low, low + len(d))[:, None] < np.arange(len(more_b))[None, :]
            for i, j in zip(*np.nonzero(open_)):
                one, two = more_a[low + i], more_b[j]
                if d[i, j] + one.radius + two.radius <= reach - 1e-5:
                    found.append((one.members, two.members, True))
                else:
                    todo.append((one, two, False))
    return found


_OUT = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])


def _units(packed: list[bytes], kind: str) -> np.ndarray:
    """Unit rows of packed vectors of one length."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float)
    x /= np.abs(x).max(1)[:, None]  # first, so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(packed: list[bytes]) -> list[np.ndarray]:
    """The places of the vectors of each length."""
    sizes = np.array([len(b) for b in packed])
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, "pair"):
        ids, side, weight = (rows.column(c).to_numpy() for c in ("rid", "side", "weight"))
        packed = rows.column("vector").to_pylist()
        links = np.zeros(len(ids), np.int64)
        us, vs = [], []
        crossed = bool((side == 1).any())
        for place in _by_length(packed):
            a, b = place[side[place] == 0], place[side[place] == 1]
            if not len(a) or (crossed and not len(b)):
                continue
            other = b if crossed else a
            for i, j, whole in dual_links(_units([packed[k] for k in a], kind), _units([packed[k] for k in b], kind) if crossed else None, cosine):
                i, j = a[i], other[j]
                if whole:
                    links[i] += weight[j].sum()
                    links[j] += weight[i].sum()
                    us += [i, j]
                    vs += [np.full(len(i), j[0]), np.full(len(j), i[0])]
                else:
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    us.append(i)
                    vs.append(j)
        if us:
            by = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by] = np.arange(len(ids))
            low = smallest_reachable(len(ids), rank[np.concatenate(us)], rank[np.concatenate(vs)])
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[by][low[rank[hit]]])], schema=_OUT)


def _pack(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The vectors as bytes, all in the label's root cell."""
    for batch in batches:
        packed = [np.array(v, kind).tobytes() for v in batch.column("vector").to_pylist()]
        n = len(packed)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array([""] * n, pa.string()), pa.array(np.full(n, 2.0))], names=["rid", "label", "weight", "vector", "cell", "away"])


def _assign(batches: Iterator[pa.RecordBatch], centres: dict, kind: str) -> Iterator[pa.RecordBatch]:
    """Moves the vectors of split cells to the cell of the nearest centre."""
    for batch in batches:
        cell, away = batch.column("cell").to_pylist(), batch.column("away").to_numpy().copy()
        members = defaultdict(list)
        for i, key in enumerate(zip(batch.column("label").to_pylist(), cell)):
            if key in centres:
                members[key].append(i)
        packed = batch.column("vector").to_pylist() if members else []
        for key, own in members.items():
            c = centres[key]
            for place in _by_length([packed[i] for i in own]):
                x = _units([packed[own[i]] for i in place], kind)
                dots = x @ c.T if x.shape[1] == c.shape[1] else np.full((len(x), 1), -1.0)
                best = dots.argmax(1)
                away[[own[i] for i in place]] = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(x)), best]))
                for i, child in zip(place, best.tolist()):
                    cell[own[i]] = f"{key[1]}/{child}"
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell, pa.string()), pa.array(away)], names=batch.schema.names)


def _centres(sample: list, cell_rows: int, kind: str) -> dict:
    """(label, cell) -> unit rows: a level of the cover tree over the cell's sample with enough nodes to make tasks' work of it, if it has one."""
    by, sizes = defaultdict(list), {}
    for label, cell, rows, vector in sample:
        by[label, cell].append(bytes(vector))
        sizes[label, cell] = rows
    out = {}
    for key, packed in by.items():
        if len({len(b) for b in packed}) > 1:
            continue
        x = _units(packed, kind)
        level = [cover_tree(x, leaf=1)]
        while len(level) < 2 * sizes[key] / cell_rows:
            below = [c for n in level for c in (n.children or [n])]
            if len(below) > max(2, len(x) // 4) or len(below) == len(level):
                break
            level = below
        if len(level) > 1:
            out[key] = x[[n.centre for n in level]]
    return out


def _tree(placed: DataFrame, label_type: str, cosine: float, cell_rows: int, sample_rows: int, depth: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(placed in leaf cells, pairs of leaf cells that are near enough, for the labels that were split)."""
    spark = placed.sparkSession
    reach = math.sqrt(2 - 2 * cosine)
    pairs, places = None, spark.createDataFrame([], f"c_label {label_type}, c_cell string, c_parent string, centre array<double>")
    for level in range(depth):
        cells = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > cell_rows)
        cells = checkpointed(cells.select(F.col("label").alias("z_label"), F.col("cell").alias("z_cell"), "rows"))
        sample = placed.join(small_side(cells), (F.col("label") == F.col("z_label")) & (F.col("cell") == F.col("z_cell")))
        sample = sample.orderBy(F.xxhash64("rid")).limit(sample_rows).select("label", "cell", "rows", "vector").collect()
        centres = _centres(sample, cell_rows, kind)
        if not centres:
            break
        placed = checkpointed(placed.mapInArrow(lambda it, c=centres: _assign(it, c, kind), placed.schema))
        new = [(label, f"{cell}/{i}", cell, c.tolist()) for (label, cell), cs in centres.items() for i, c in enumerate(cs)]  # at most sample_rows
        old = places.select("c_label", "c_cell", F.col("c_cell").alias("c_parent"), "centre")  # cells that stay are their own children
        places = checkpointed(old.union(spark.createDataFrame(new, places.schema)))
        radii = placed.groupBy("label", "cell").agg(F.max("away").alias("radius"))
        child = checkpointed(radii.join(small_side(places), (F.col("label") == F.col("c_label")) & (F.col("cell") == F.col("c_cell"))).select("c_label", "c_parent", "c_cell", "centre", "radius"))
        one, two = (child.toDF(*[f"{c}_{side}" for c in ("label", "parent", "cell", "centre", "radius")]) for side in "ab")
        roots = child.where("c_parent = ''").select(F.col("c_label").alias("label"), F.col("c_parent").alias("a"), F.col("c_parent").alias("b")).distinct()
        pairs = roots if pairs is None else pairs.union(roots)  # labels split for the first time
        met = pairs.join(one, (F.col("label") == F.col("label_a")) & (F.col("a") == F.col("parent_a"))).join(two, (F.col("label") == F.col("label_b")) & (F.col("b") == F.col("parent_b")))
        dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        near = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("radius_a") + F.col("radius_b") + reach + _SLACK
        pairs = checkpointed(met.where(near & ((F.col("a") != F.col("b")) | (F.col("cell_a") <= F.col("cell_b")))).select("label", F.col("cell_a").alias("a"), F.col("cell_b").alias("b")))
    if pairs is None:
        pairs = spark.createDataFrame([], f"label {label_type}, a string, b string")
    return placed, pairs


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, chunk_rows: int = 8192, cell_rows: int = 8192, sample_rows: int = 16384, depth: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ship(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(label_col).alias("label"), named(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = checkpointed(rows.withColumn("usable", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda c: c != 0), F.lit(False))))
    good = rows.where("usable").select("id", "label", "vector")
    reps = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    reps = checkpointed(reps.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "vector", "weight"))
    label_type = reps.schema["label"].dataType.simpleString()
    placed = reps.select("rid", "label", "weight", "vector").mapInArrow(lambda it: _pack(it, kind), f"rid long, label {label_type}, weight long, vector binary, cell string, away double")
    placed, pairs = _tree(checkpointed(placed), label_type, cosine, cell_rows, sample_rows, depth, kind)
    cells = checkpointed(placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")))
    whole = cells.where("cell = ''").select("label", F.col("cell").alias("a"), F.col("cell").alias("b"))  # labels that were never split
    sized = lambda side: cells.select(F.col("label").alias(f"label_{side}"), F.col("cell").alias(f"cell_{side}"), F.col("chunks").alias(f"chunks_{side}"))
    met = pairs.union(whole).join(sized("a"), (F.col("label") == F.col("label_a")) & (F.col("a") == F.col("cell_a"))).join(sized("b"), (F.col("label") == F.col("label_b")) & (F.col("b") == F.col("cell_b")))
    met = checkpointed(met.select(F.col("label").alias("p_label"), "a", "b", "chunks_a", "chunks_b"))
    # a pair of chunks: i of the first cell on side 0, j of the second on side 1; a chunk with itself on side 0 alone
    chunked = lambda chunks: F.expr(f"cast(pmod(xxhash64(rid), {chunks}) as int)")
    first = placed.join(small_side(met), (F.col("label") == F.col("p_label")) & (F.col("cell") == F.col("a"))).withColumn("i", chunked("chunks_a"))
    first = first.withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("chunks_b") - 1))).withColumn("side", F.lit(0))
    second = placed.join(small_side(met), (F.col("label") == F.col("p_label")) & (F.col("cell") == F.col("b"))).withColumn("j", chunked("chunks_b"))
    second = second.withColumn("high", F.when(F.col("a") == F.col("b"), F.col("j")).otherwise(F.col("chunks_a")) - 1).where("high >= 0")
    second = second.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("high")))).withColumn("side", F.lit(1))
    shape = [F.concat_ws("|", F.col("label").cast("string"), "a", "i", "b", "j").alias("pair"), "side", "rid", "weight", "vector"]
    tasks = first.select(*shape).union(second.select(*shape))
    linked = checkpointed(tasks.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda it: _compare(it, cosine, kind), "rid long, links long, low long"))
    counts = linked.groupBy(F.col("rid").alias("n_rid")).agg(F.sum("links").alias("links"))
    roots = components(linked, "rid", "low").toDF("c_rid", "root")
    classed = reps.join(counts, F.col("rid") == F.col("n_rid"), "left").join(roots, F.col("rid") == F.col("c_rid"), "left")
    classed = checkpointed(classed.select("rid", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root"), "label", "vector"))
    lowest = classed.groupBy(F.col("root").alias("l_root")).agg(F.min("id").alias("component_id"))
    per_rep = classed.join(lowest, F.col("root") == F.col("l_root")).select("label", "vector", "n_links", "component_id")
    per_rep = checkpointed(per_rep)  # a plain side, so that a vector with very many copies is a partition that can be split
    out = good.join(per_rep, ["label", "vector"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = rows.where("not usable").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
