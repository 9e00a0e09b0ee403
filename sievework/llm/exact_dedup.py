"""Operator 8: exact duplicates by a tree-merge of sorted digest runs.

Every input partition makes a run where it lies, without an exchange: its rows are sorted by digest and merged in one
streaming pass, so that one row per different text stays, the best copy with the number of copies.  In binomial rounds
the runs of `fan_in` neighbours exchange slices of their digest range; whoever takes a slice merges its sorted parts the same
way, and again only the best copy stays, its count added up, until one run, spread over all tasks by digest, is left.
The answer goes back in two joins: the last run meets the first ones, by digest, and each first run its own rows.
A text that fills a third of the table is one row per run at every level, so no task ever sees its copies together; no
level moves more than one row per run and text.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]; a text's digest is SHA-256 of
the rest, verified together with the number of characters left.  The copy with the most code points in the
original text stays, then the one with the smallest id, then the first row.

Defined results for odd input: a null text counts as empty, and empty texts are equal; a null id loses
against any other and, if it stays, is the null keep_id of its group; of repeated rows (same id, same text)
exactly one is kept; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, fresh, named, ship, small_side

BLANK = "[\\x20\\x09-\\x0D]+"


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(run, row, id, points, digest, rest): a short row per document, without its text."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(named(id_col).alias("id"), text.alias("t")).select("id", F.char_length("t").cast("long").alias("points"), F.regexp_replace("t", BLANK, "").alias("s"))
    return rows.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        "id",
        "points",
        F.unhex(F.sha2(F.col("s").cast("binary"), 256)).alias("digest"),
        F.char_length("s").cast("long").alias("rest"),
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (run, digest, rest) with the sum of n, from rows that come sorted; one row is held across batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # without what Spark says of nulls
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        digest = rows.column("digest").cast(pa.binary(32))
        digest = np.frombuffer(digest.buffers()[1], "<u8")[digest.offset * 4 : (digest.offset + len(digest)) * 4].reshape(-1, 4)
        run, rest = rows.column("run").to_numpy(), rows.column("rest").to_numpy()
        first = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (rest[1:] != rest[:-1]) | (digest[1:] != digest[:-1]).any(1)))
        n = pa.array(np.add.reduceat(rows.column("n").to_numpy(), first))
        merged = rows.take(pa.array(first))
        merged = merged.set_column(merged.schema.get_field_index("n"), "n", n)
        held = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if held is not None:
        yield held


def merged_runs(rows: DataFrame) -> DataFrame:
    """Each partition's rows as sorted runs of different texts, the best copy of each."""
    best = rows.sortWithinPartitions("run", "digest", "rest", F.desc("points"), F.asc_nulls_last("id"), "row")
    return best.mapInArrow(_merge, rows.schema)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (hex), points (code points of the text)."""
    ship(docs.sparkSession)
    base = checkpointed(digest_rows(docs, id_col, text_col))
    first_runs = max(1, base.rdd.getNumPartitions())
    own = checkpointed(merged_runs(base.withColumn("n", F.lit(1).cast("long"))))
    last, runs = own, first_runs
    for _ in range(math.ceil(math.log(first_runs, fan_in) - 1e-9)):
        runs = -(-runs // fan_in)
        # slices of the digest range, several for each task that merges
        part = F.expr(f"cast(conv(hex(substring(digest, 1, 4)), 16, 10) as bigint) * {4 * -(-first_runs // runs)}L div 4294967296L")
        up = last.withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        last = checkpointed(merged_runs(up.repartition(first_runs, "run", part)))
    winners = last.select("digest", "rest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    answer = checkpointed(own.select("run", "digest", "rest").join(winners, ["digest", "rest"]))
    return base.join(answer, ["run", "digest", "rest"]).select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("digest"), "points"
    )


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only the ids of rows that go are joined (broadcast if they are few); where an id has both rows that go and rows
    that stay, the text's digest is compared too, and of rows that are equal in both exactly one stays.
    """
    key, digest, points, gone, of_id, of_digest, of_points = fresh(docs, "key", "digest", "points", "gone", "of_id", "of_digest", "of_points")
    found = checkpointed(exact_duplicates(docs, id_col=id_col, text_col=text_col))
    per_id = found.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay"))
    left = checkpointed(per_id.where(F.col("stay") < F.col("rows")).select(F.col("id").alias(gone), "stay"))
    mixed = left.where("stay > 0").select(gone)
    same = named(id_col).eqNullSafe(F.col(gone))
    clear = docs.join(small_side(left.select(gone)), same, "left_anti")
    if mixed.isEmpty():
        return clear
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    odd = docs.join(small_side(mixed), same, "left_semi").withColumns({key: named(id_col), digest: F.sha2(F.regexp_replace(text, BLANK, "").cast("binary"), 256), points: F.char_length(text).cast("long")})
    stay = found.where("kept").select(F.col("id").alias(of_id), F.col("digest").alias(of_digest), F.col("points").alias(of_points))
    odd = odd.join(stay, F.col(key).eqNullSafe(F.col(of_id)) & (F.col(digest) == F.col(of_digest)) & (F.col(points) == F.col(of_points)), "left_semi")
    return clear.unionByName(odd.dropDuplicates([key, digest, points]).select(*map(named, docs.columns)))
