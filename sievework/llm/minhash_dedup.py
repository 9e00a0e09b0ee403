"""Operator 4: near duplicates on word shingles by MinHash with tensored banding.

A document's set is its different shingles of five lower-cased words (with fewer words, the whole sequence as one).

1. One pass over the texts gives a short row per document: set size, a 128-bit BLAKE2 digest of the word sequence, and two
   collections of `tables` half-keys, each of `rows` minhashes.  Documents of equal digest become one representative
   (map-side combined; a text that fills a third of the table is one row).
2. Tensoring: the tables' keys are all pairs (i-th half-key of the first collection, j-th of the second), so
   tables^2 tables of 2 * rows minhashes cost 2 * tables * rows minhashes.  A pair of similarity s shares a key
   with probability (1 - (1 - s^rows)^tables)^2: 0.9998 at 0.8 for eighteen half-keys of four.  The key rows hold two
   numbers each.  A task sends at most three rows of a key for each `_CHUNK` texts (most keys are single, so that Spark's own
   map-side combine would only fill memory and spill), and a bucket is aggregated to its smallest and largest member and
   whether it has more, never gathered: most have two members, which are the pair.  Such a pair is dropped at once where fewer than `least` of all
   half-keys agree (a pair of similarity 0.8 is lost so with a chance of 5 in 10,000).  Larger buckets become stars
   around their smallest member; a bucket that holds a third of the table is one row there, and only a join that adaptive
   execution can split sees its members.
3. Components of pairs and stars are the candidate groups.  Their representatives are read again in full and compared
   exactly: a task numbers the words it meets, and shingles by those numbers, so that no hash decides.  A group goes in
   chunks (at most `chunk_rows` members, about `chunk_shingles` shingles), each beside the group's first member.
   Members linked with that one, directly or by way of others, are done: near copies of one text cost a single
   comparison of their chunk.  Only the members left open meet all chunks, again a task for each two chunks.  What
   leaves a task is a forest of confirmed links, not the links.
4. Components of the confirmed links give the classes.

Defined results for odd input: a null, empty or blank text has an empty set and links with nothing; a null id links with
nothing, has a null class and is kept; repeated rows and ids on several texts are one document in the class (its id's
smallest); an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import textnum
from sievework.llm.common import BROADCAST_ROWS, checkpointed, fresh, named, runs, ship, small_side
from sievework.llm.components import components, smallest_reachable

WORDS = 5
_SLICE = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = textnum._LOWER.tobytes()


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's different shingles."""
    words, index = textnum.word_hashes(column)
    grams = textnum.gram_hashes(words, WORDS)
    out = []
    for a, b in zip(index[:-1].tolist(), index[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(grams[a : b - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(textnum.mix64(textnum.gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(sets: list[np.ndarray], tables: int, rows: int) -> np.ndarray:
    """(text, 2 * tables) half-keys: the first collection, then the second; zeros for an empty set."""
    shift, scale = _seeds(2 * tables * rows)
    out = np.zeros((len(sets), 2 * tables), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        stop, size = at, 0
        while stop < len(full) and (size == 0 or size + len(sets[full[stop]]) <= _SLICE):
            size += len(sets[full[stop]])
            stop += 1
        part = full[at:stop]
        flat = np.concatenate([sets[i] for i in part])
        bounds = np.cumsum([0] + [len(sets[i]) for i in part[:-1]])
        work = np.empty_like(flat)
        for t in range(2 * tables):
            key = np.full(len(part), t, np.uint64)
            for r in range(t * rows, (t + 1) * rows):
                np.bitwise_xor(flat, shift[r], out=work)
                np.multiply(work, scale[r], out=work)
                key = textnum.mix64(key) + np.minimum.reduceat(work, bounds)
            out[part, t] = textnum.mix64(key)
        at = stop
    return out


_SKETCH = "id long, n long, d1 long, d2 long, first array<long>, second array<long>, sig binary"


_KEYS = "key long, rid long"
_CHUNK = 4096


def _keys(batches: Iterator[pa.RecordBatch], combine: bool) -> Iterator[pa.RecordBatch]:
    """The tables' keys of rows (rid, first, second).

    Combined, a key that occurs once among `_CHUNK` texts is one row, one that occurs twice its two rows, and one that
    occurs more often three: its smallest, its largest and again its smallest text.
    """
    for whole in batches:
        for low in range(0, whole.num_rows, _CHUNK):
            batch = whole.slice(low, _CHUNK)
            n = batch.num_rows
            first, second = (batch.column(k).flatten().to_numpy().view(np.uint64).reshape(n, -1) for k in (1, 2))
            keys = textnum.mix64(first[:, :, None] * _ODD + second[:, None, :]).reshape(-1).view(np.int64)
            rids = np.repeat(batch.column(0).to_numpy(), len(keys) // n)
            if combine:
                by = np.argsort(keys)
                keys, rids = keys[by], rids[by]
                start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                size = np.diff(np.append(start, len(keys)))
                lowest, highest = np.minimum.reduceat(rids, start), np.maximum.reduceat(rids, start)
                times = np.where(lowest < highest, np.minimum(size, 3), 1)
                two = times > 1
                keys, rids = np.repeat(keys[start], times), np.repeat(lowest, times)
                rids[(np.cumsum(times) - times + 1)[two]] = highest[two]
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(rids[at : at + (1 << 16)])], names=["key", "rid"])


def word_texts(column: pa.Array) -> list[bytes]:
    """Each text's words, A-Z lower-cased, a blank between them."""
    data, offsets = textnum.text_buffer(column)
    raw = memoryview(np.ascontiguousarray(data))
    return [b" ".join(bytes(raw[a:b]).translate(_FOLD).split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each word sequence, as two columns."""
    both = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _sketch(batches: Iterator[pa.RecordBatch], tables: int, rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            sets = shingle_sets(batch.column(1))
            keys = half_keys(sets, tables, rows).view(np.int64)
            d1, d2 = _digests(word_texts(batch.column(1)))
            offsets = pa.array(np.arange(len(sets) + 1) * tables, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(k).ravel())) for k in (keys[:, :tables], keys[:, tables:])]
            sig = pa.array([row.tobytes() for row in keys.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), *lists, sig], names=["id", "n", "d1", "d2", "first", "second", "sig"])


def _member_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, rid, d1, d2, ...): the words of those whose text is the representative's, once for each partition."""
    seen: set[int] = set()
    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            texts = word_texts(batch.column("text"))
            d1, d2 = _digests(texts)
            same = (d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy())
            for i in np.flatnonzero(same).tolist():
                rid = batch.column("rid")[i].as_py()
                same[i] = rid not in seen
                seen.add(rid)
            out = pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("root"), batch.column("chunks"), pa.array(texts, pa.binary())], names=["rid", "root", "chunks", "words"])
            yield out.filter(pa.array(same))


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each word text's different shingles as sorted numbers: equal numbers are equal shingles, within one call."""
    numbers: dict[bytes, int] = {}
    lists = [[numbers.setdefault(w, len(numbers)) for w in t.split(b" ")] if t else [] for t in texts]
    bounds = np.cumsum([0, *map(len, lists)])
    words = np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in lists if x]])
    grams, length, kinds = words, 1, len(numbers)
    while length < WORDS and len(grams) > 1:  # double while that fits, then the last words one by one
        step = length if 2 * length <= WORDS else 1
        other, n_other = (grams, kinds) if step == length else (words, len(numbers))
        joined = grams[: len(grams) - step] * n_other + other[length:][: len(grams) - step]
        values, grams = np.unique(joined, return_inverse=True)
        length, kinds = length + step, len(values)
    short: dict[tuple, int] = {}
    out = []
    for a, b, own in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lists):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            out.append(np.array([kinds + len(words) + short.setdefault(tuple(own), len(short))] if own else [], np.int64))
    return out


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity is at least percent / 100; with sides, only across them."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(flat) else new
    column, owner = column[shared], owner[shared]
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    common = np.zeros((n, n), np.int32)
    for low in range(0, int(column[-1]) + 1, 1 << 15):  # columns in slices: bounded memory
        a, b = np.searchsorted(column, [low, low + (1 << 15)])
        dense = np.zeros((n, min(1 << 15, int(column[-1]) + 1 - low) + 63 & ~63), bool)
        dense[owner[a:b], column[a:b] - low] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        for i in range(n - 1):
            common[i, i + 1 :] += np.bitwise_count(bits[i] & bits[i + 1 :]).sum(1, dtype=np.int32)
    union = sizes[:, None] + sizes[None, :] - common
    hit = np.triu((100 * common.astype(np.int64) >= percent * union) & (common > 0), 1)
    if side is not None:
        hit &= side[:, None] != side[None, :]
    return np.nonzero(hit)


_LINKS = "rid long, low long, root long, open boolean"


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links in each run of equal `pair`; open: members that aren't linked with the group's root, where they are to be known."""
    for rows in runs(batches, "pair"):
        ids, side, root = rows.column("rid").to_numpy(), rows.column("side").to_numpy(), rows.column("root")[0].as_py()
        by = np.lexsort([side, ids])
        by = by[np.append(True, (np.diff(ids[by]) != 0) | (np.diff(side[by]) != 0))]  # an id's repeated rows
        ids, side = ids[by], side[by]
        words = rows.column("words").to_pylist()
        u, v = linked_pairs(exact_sets([words[i] for i in by.tolist()]), side if side.any() else None, percent)
        low = smallest_reachable(len(ids), u, v)
        leave = low != np.arange(len(ids))
        at_root = np.flatnonzero(ids == root)
        is_open = np.zeros(len(ids), bool)
        if rows.column("chunks")[0].as_py() > 1 and len(at_root):
            is_open = low != low[at_root[0]]
        some = np.flatnonzero(leave | is_open)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]]), pa.array(np.full(len(some), root)), pa.array(is_open[some])], names=["rid", "low", "root", "open"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, tables: int = 18, rows: int = 4, least: int = 4, chunk_rows: int = 128, chunk_shingles: int = 1 << 19, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. Documents link at a similarity of percent / 100."""
    ship(docs.sparkSession)
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    sketches = checkpointed(texts.mapInArrow(lambda it: _sketch(it, tables, rows), _SKETCH))
    full = sketches.where("n > 0 and id is not null")
    reps = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "first", "second", "sig")).alias("m"))
    reps = checkpointed(reps.select(F.monotonically_increasing_id().alias("rid"), "n", "d1", "d2", F.col("m.id").alias("id"), "m.first", "m.second", "m.sig"))
    halves = reps.select("rid", "first", "second")
    few = halves.mapInArrow(lambda it: _keys(it, True), _KEYS).repartition("key")
    buckets = checkpointed(few.groupBy("key").agg(F.min("rid").alias("hub"), F.max("rid").alias("other"), F.count(F.lit(1)).alias("size")).where("hub < other"))
    twos = buckets.where("size = 2").select(F.col("other").alias("rid"), "hub").distinct()
    sig = lambda c: reps.select(F.col("rid").alias(f"{c}_rid"), F.col("sig").alias(f"{c}_sig"))
    alike = F.expr(f"size(filter(sequence(1, {2 * tables}), k -> substring(a_sig, k, 1) = substring(b_sig, k, 1))) >= {least}")
    twos = twos.join(sig("a"), F.col("rid") == F.col("a_rid")).join(sig("b"), F.col("hub") == F.col("b_rid")).where(alike).select("rid", "hub")
    big = buckets.where("size > 2").select(F.col("key").alias("b_key"), "hub")
    keys = halves.mapInArrow(lambda it: _keys(it, False), _KEYS)
    stars = keys.join(small_side(big, broadcast_rows), F.col("key") == F.col("b_key")).where("rid <> hub").select("rid", "hub").distinct()
    groups = checkpointed(components(twos.union(stars), "rid", "hub"))
    known = reps.select(F.col("rid").alias("m_rid"), "n", F.col("id").alias("rep"), "d1", "d2")
    grouped = groups.select(F.col("id").alias("rid"), "root").join(known, F.col("rid") == F.col("m_rid")).drop("m_rid")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / chunk_rows), F.ceil(F.sum("n") / chunk_shingles)).cast("int")
    sizes = grouped.groupBy("root").agg(chunks.alias("chunks"))
    members = checkpointed(grouped.join(sizes, "root").select("rid", "root", "chunks", "rep", "d1", "d2"))

    def with_words(some: DataFrame) -> DataFrame:
        """(rid, root, chunks, words, chunk) of members: their texts are read again."""
        wanted = texts.join(small_side(some, broadcast_rows), F.col("id") == F.col("rep")).select("rid", "root", "chunks", "d1", "d2", "text")
        return wanted.mapInArrow(_member_texts, "rid long, root long, chunks int, words binary").withColumn("chunk", _chunk("chunks"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.concat_ws("/", *[F.col(c) for c in ("root", "chunk", "other")]).alias("pair"), "side", "rid", "root", "chunks", "words")
        return checkpointed(pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda it: _confirm(it, percent), _LINKS))

    everywhere = F.when(F.col("rid") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = with_words(members).withColumn("chunk", F.explode(everywhere))  # the root goes to every chunk
    links = confirmed(first.select("root", "chunk", F.lit(-1).alias("other"), F.lit(0).alias("side"), "rid", "chunks", "words"))
    left = links.where("open").select("rid", "root").distinct()
    again = left.groupBy(F.col("root").alias("l_root")).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("l_chunks"))
    left = checkpointed(left.join(again, F.col("root") == F.col("l_root")).select(F.col("rid").alias("l_rid"), "l_root", "l_chunks"))
    rest = checkpointed(members.join(left.select("l_root", "l_chunks").distinct(), F.col("root") == F.col("l_root")).drop("l_root"))
    if not rest.isEmpty():
        # members left open, in chunks of their own, on side 0 beside every chunk of the group on side 1
        lefts = left.select("l_rid").join(rest, F.col("l_rid") == F.col("rid")).drop("l_rid", "l_chunks")
        counts = rest.select(F.col("root").alias("c_root"), "l_chunks").distinct()
        one = with_words(lefts).join(small_side(checkpointed(counts), broadcast_rows), F.col("root") == F.col("c_root"))
        one = one.select("root", _chunk("l_chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), F.lit(0).alias("side"), "rid", "chunks", "words")
        two = with_words(rest.drop("l_chunks")).join(small_side(checkpointed(counts), broadcast_rows), F.col("root") == F.col("c_root"))
        two = two.select("root", F.explode(F.sequence(F.lit(0), F.col("l_chunks") - 1)).alias("c"), "chunk", F.lit(1).alias("side"), "rid", "chunks", "words").toDF("root", "chunk", "other", "side", "rid", "chunks", "words")
        links = links.union(confirmed(one.union(two)))
    classes = components(links, "rid", "low").withColumnRenamed("id", "c_rid")
    rooted = reps.select("rid", "n", "d1", "d2", "id").join(classes, F.col("rid") == F.col("c_rid"), "left").withColumn("root", F.coalesce("root", "rid"))
    lowest = rooted.where("c_rid is not null").groupBy("root").agg(F.min("id").alias("low")).withColumnRenamed("root", "l_root")
    classed = rooted.join(lowest, F.col("root") == F.col("l_root"), "left").select("n", "d1", "d2", F.coalesce("low", "id").alias("component"))
    classed = checkpointed(classed)
    found = full.select("id", "n", "d1", "d2").join(classed, ["n", "d1", "d2"]).select("id", "n", "component")
    blank = sketches.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    out = found.union(blank)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _chunk(chunks: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64(rid), {chunks}) as int)")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are the first of their class, with all their columns; only ids that go are joined."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(small_side(checkpointed(gone)), named(id_col).cast("long") == F.col(name), "left_anti")
