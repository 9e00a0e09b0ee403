"""Operator 7: mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in an order drawn by a hash of the id, make blocks of `block_docs`.  Target weights are
whole units of a cycle of `cycle` slots.  Block k of a source with u units may not run before slot
floor(k * cycle / u) and must run before slot ceil((k + 1) * cycle / u); each slot goes to the released block with
the earliest deadline.  That keeps every source within one block of its ideal share at every slot, as long as
its documents last; slots of a source that has run out stay empty and the others keep their proportions.  No
document is dropped or repeated.

The schedule depends on the units alone and repeats every cycle, so it is worked out once for one cycle (an
`aggregate` over its slots; a row per source and unit) and every block finds its slot by arithmetic.  Ranks inside
a source come in two levels: rows are numbered inside (source, hash range) groups of about the square root of the
row count, and the group counts, summed up, give the offsets.  No task ever holds a source, so a source with a
third of the rows or nearly all of them costs nothing extra.

Defined results for odd input: a null source is a source of its own; a null id sorts first in its source; repeated
rows are each scheduled; an empty table gives no rows; weights for sources that have no rows are ignored, and
a source without a given weight gets the tempered one (row count to the power `temperature`).
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import fresh, named

_SPACE = 1 << 32


def source_units(docs: DataFrame, *, source_col: str = "source", cycle: int = 1000, temperature: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n, units, nth): whole units of the cycle by largest remainder, one at least for each source."""
    counts = docs.groupBy(named(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        weight = F.coalesce(F.element_at(table, F.col("source")).cast("double"), weight)
    every = Window.partitionBy(F.lit(0))  # a row per source
    counted = counts.withColumn("w", weight).withColumn("m", F.count(F.lit(1)).over(every))
    ideal = counted.withColumn("ideal", (F.lit(cycle) - F.col("m")) * F.col("w") / F.sum("w").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    floored = ideal.withColumn("whole", F.floor(F.round("ideal", 9)).cast("long"))
    rest = floored.withColumn("short", F.lit(cycle) - F.col("m") - F.sum("whole").over(every))
    nth = F.row_number().over(every.orderBy(F.desc(F.round(F.col("ideal") - F.col("whole"), 9)), "source"))
    return rest.withColumn("nth", nth).select("source", "n", (1 + F.col("whole") + (F.col("nth") <= F.col("short")).cast("long")).alias("units"), "nth")


def cycle_schedule(units: DataFrame, cycle: int) -> DataFrame:
    """(source, units, unit, slot): earliest-deadline-first over one cycle, unit 0 .. units - 1 of each source."""
    rows = units.agg(F.array_sort(F.collect_list(F.struct("nth", "source", "units"))).alias("s"))  # a row per source
    # a block's deadline is (done + 1) * cycle / units rounded up, its release done * cycle / units rounded down
    pick = (
        "array_min(filter(transform(s, (x, i) -> named_struct("
        f"'due', ((a.done[i] + 1) * {cycle}L + x.units - 1) div x.units, 'free', (a.done[i] * {cycle}L) div x.units, "
        "'nth', x.nth, 'i', i)), y -> y.free <= t and a.done[y.i] < s[y.i].units))"
    )
    run = rows.select(
        "s",
        F.expr(
            f"aggregate(sequence(0, {cycle - 1}), named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<int>)), "
            f"(a, t) -> transform(array({pick}), p -> named_struct('done', transform(a.done, (d, j) -> if(j = p.i, d + 1, d)), 'out', concat(a.out, array(p.i))))[0], "
            "a -> a.out)"
        ).alias("turns"),
    )
    turn = run.select("s", F.posexplode("turns").alias("slot", "i")).select("slot", F.expr("s[i].source").alias("source"), F.expr("s[i].units").alias("units"), "i")
    unit = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return turn.select("source", "units", unit.cast("long").alias("unit"), F.col("slot").cast("long").alias("slot"))


def schedule(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 8, cycle: int = 1000, temperature: float = 0.5, weights: dict[str, float] | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, units, block, slot, place (inside the block). carry: all columns of docs too, as a struct `row`."""
    n_sources, n = docs.groupBy(named(source_col).alias("s")).count().agg(F.count(F.lit(1)), F.sum("count")).first()
    cycle = max(cycle, 4 * n_sources)
    groups = max(1, math.isqrt(n or 0))
    width = -(-_SPACE // groups)
    key = F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary"))
    part = F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) as long) div {width}L")
    rows = docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), key.alias("key"), *([F.struct(*map(named, docs.columns)).alias("row")] if carry else []))
    # a key that is never null: the window's partitioning then serves the join with the counts too, and rows move once
    group = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))
    rows = rows.withColumn("group", group(F.col("source"))).withColumn("part", part)
    inside = Window.partitionBy("group", "part").orderBy("key", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1)
    sizes = docs.select(group(named(source_col)).alias("group"), key.alias("key")).select("group", part.alias("part"))
    sizes = sizes.groupBy("group", "part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("group", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.join(before, ["group", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).withColumn("block", F.expr(f"rank div {block_docs}"))
    units = source_units(docs, source_col=source_col, cycle=cycle, temperature=temperature, weights=weights)
    plan = cycle_schedule(units, cycle).select(F.col("source").alias("u_source"), "units", "unit", F.col("slot").alias("at"))
    if cycle <= 100_000:  # a row per slot of the cycle
        plan = F.broadcast(plan)
    size = F.broadcast(units.select(F.col("source").alias("z_source"), F.col("units").alias("z"))) if cycle <= 100_000 else units.select(F.col("source").alias("z_source"), F.col("units").alias("z"))
    ranked = ranked.join(size, F.col("source").eqNullSafe(F.col("z_source"))).withColumn("turn", F.col("block") % F.col("z"))
    done = ranked.join(plan, F.col("source").eqNullSafe(F.col("u_source")) & (F.col("turn") == F.col("unit")))
    slot = F.expr(f"(block div units) * {cycle}L + at")
    return done.select("doc_id", "source", "units", "block", slot.alias("slot"), (F.col("rank") % block_docs).alias("place"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, laid out in the order of the schedule: range-partitioned by slot and sorted."""
    planned = schedule(docs, carry=True, **options)
    laid = planned.repartitionByRange("slot", "place", "doc_id").sortWithinPartitions("slot", "place", "doc_id")
    return laid.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def in_file_order(docs: DataFrame) -> DataFrame:
    """The rows of docs, a scan of the files that `mixed` was written to, in its order again, partition after partition.

    A scan deals out files and parts of files by size. A frame that is no scan of files is returned as it is.
    """
    file, row = fresh(docs, "file", "row")
    try:
        scanned = docs.metadataColumn("_metadata")
        rows = docs.select("*", scanned["file_name"].alias(file), scanned["row_index"].alias(row))
    except AnalysisException:
        return docs
    place = (F.length(file), file, row)  # part numbers get longer beyond 99,999
    return rows.repartitionByRange(*place).sortWithinPartitions(*place).select(*map(named, docs.columns))
