"""Operator 1: Stupid-backoff scores from n-gram count tables partitioned by hash.

The n-grams of orders 1 .. n of all documents are counted over the whole corpus and joined back to the documents that
they came from.  Both sides travel as columns, not as a row per n-gram:

1. each task cuts its documents into blocks of about `block_bytes`, explodes a block's n-grams as 64-bit hashes
   and counts them locally; the sorted distinct keys go out in slices by their leading bits (map-side combine);
2. a task per hash partition merges the slices of all blocks into its part of the count table, and joins it
   straight back: for each slice it received it returns the corpus counts of those keys, in order;
3. a block's documents (carried compressed) meet the counts of its n-grams, every position takes the counts of its
   n-gram and context, and the logarithms are summed up per document.

An n-gram occurs at most once in a slice, so however frequent it is, a partition gets one entry per block for it; the
numbers of partitions follow the words and bytes counted first, whatever the session's setting.  A key is 64 bits beside the
partition's own, which come from a second hash of the words: an n-gram meets another one's key with a chance of 2^-64
times the n-grams of its partition, the same at every size (10^-13 at 2^21).

The score of a word is c(w[i-k] .. w[i]) / c(w[i-k] .. w[i-1]) for the longest context k < n for which the numerator
isn't zero, times alpha for each order given up; for one word alone c(w) / N; for a word not seen at all half a count.
Counts leave out the document that is scored (leave_one_out), else no n-gram would ever be unseen.  Words are those
of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.

Defined results for odd input: a null, empty or blank text has no words and the score 0; a null id is carried; repeated rows
are scored each, with the other's counts; an empty table gives no rows; other columns are ignored whatever
their names.  The input must be readable twice with the same partitions (a table is; checkpoint anything else): a
block's checksum travels with its n-grams, and a block that is read differently the second time raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textnum
from sievework.llm.common import named, runs, ship

_OTHER = np.uint64(0x5851F42D4C957F2D)
_squeeze, _unsqueeze = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_squeeze_texts = zstandard.ZstdCompressor(level=7)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte position, so that equal high bytes compress away; compressed."""
    return _squeeze.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).data)


def _unplanes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def gram_keys(column: pa.Array, order: int, bucket_bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Per order 1 .. n: (buckets, keys, positions of the n-grams' first words); and each text's first word index."""
    words, index = textnum.word_hashes(column)
    other = textnum.mix64(words ^ _OTHER)
    last = np.repeat(index[1:], np.diff(index))  # end of the text of each word
    out = []
    for n in range(1, order + 1):
        grams = textnum.gram_hashes(words, n)
        at = np.flatnonzero(np.arange(len(grams)) + n <= last[: len(grams)])
        bucket = textnum.mix64(textnum.gram_hashes(other, n)[at] + np.uint64(n)) >> np.uint64(64 - bucket_bits)
        out.append((bucket.astype(np.uint16 if bucket_bits <= 16 else np.uint32), textnum.mix64(grams[at] + np.uint64(n)), at))
    return out, index


def _parts(rows: pa.Table, size: int = 2 << 20) -> Iterator[pa.ChunkedArray]:
    """The texts of a block in parts of whole texts, of some `size` bytes, so that little is held for each word."""
    upto = np.cumsum(np.diff(textnum.text_buffer(rows.column(1))[1]))
    low = 0
    while low < rows.num_rows:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + size)))
        yield rows.column(1).slice(low, high - low)
        low = high


def _dealt(grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, bounds): the n-grams of all orders by bucket, where each was before, bounds of the buckets."""
    bucket, keys = (np.concatenate([g[i] for g in grams]) for i in (0, 1))
    places = np.argsort(bucket, kind="stable")
    return keys[places], places, np.append(0, np.cumsum(np.bincount(bucket, minlength=1 << bucket_bits)))


def _block_keys(rows: pa.Table, order: int, bucket_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, sorted keys) of a block, for each bucket that it has n-grams in."""
    parts = [_dealt(gram_keys(texts, order, bucket_bits)[0], bucket_bits)[::2] for texts in _parts(rows)]
    for b in range(1 << bucket_bits):
        own = np.concatenate([keys[bounds[b] : bounds[b + 1]] for keys, bounds in parts] or [np.zeros(0, np.uint64)])
        if len(own):
            own.sort()
            yield b, own


def _starts(ranked: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)


def _check(rows: pa.Table) -> int:
    """A checksum of a block's texts."""
    data, offsets = textnum.text_buffer(rows.column(1))
    return zlib.crc32(np.ascontiguousarray(data), zlib.crc32(offsets.tobytes()))


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """(block id, rows) of about block_bytes of text each; the id depends on the partition and the order of rows."""
    base, nth, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        lengths = np.diff(textnum.text_buffer(batch.column(1))[1])
        low, upto = 0, np.cumsum(lengths)
        while low < rows.num_rows:
            high = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + block_bytes - size, "left")) + 1
            high = min(max(high, low + 1), rows.num_rows)
            held.append(rows.slice(low, high - low))
            size += int(lengths[low:high].sum())
            low = high
            if size >= block_bytes:
                yield base + nth, pa.concat_tables(held)
                nth, held, size = nth + 1, [], 0
    if held:
        yield base + nth, pa.concat_tables(held)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = size = 0
    for batch in batches:
        data, offsets = textnum.text_buffer(batch.column(0))
        words += len(textnum.word_bounds(data, offsets)[0])
        size += len(data)
    yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([size], pa.int64())], names=["words", "size"])


def _requests(batches: Iterator[pa.RecordBatch], order: int, bucket_bits: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    for block, rows in _blocks(batches, block_bytes):
        check = _check(rows)
        some, packed, counted = [], [], []
        for b, ranked in _block_keys(rows, order, bucket_bits):
            first = _starts(ranked)
            some.append(b)
            packed.append(_planes(np.diff(ranked[first], prepend=np.uint64(0)), 8))
            counted.append(_planes(np.diff(np.append(first, len(ranked))), 4))
        yield pa.RecordBatch.from_arrays([
            pa.array(some, pa.int64()),
            pa.array(np.full(len(some), block), pa.int64()),
            pa.array(np.full(len(some), check), pa.int64()),
            pa.array(packed, pa.binary()),
            pa.array(counted, pa.binary()),
        ], names=["bucket", "block", "check", "keys", "counts"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, "bucket"):
        parts = [np.cumsum(_unplanes(x, 8), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        counts = np.concatenate([_unplanes(x, 4) for x in rows.column("counts").to_pylist()])
        by = np.argsort(keys, kind="stable")
        ranked = keys[by]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        total = np.add.reduceat(counts[by], first)
        out = np.empty(len(keys), np.uint64)
        out[by] = np.repeat(total, np.diff(np.append(first, len(keys))))
        bounds = np.cumsum([0] + [len(p) for p in parts])
        answers = [_planes(out[a:b], 6) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), rows.column("bucket").combine_chunks(), rows.column("check").combine_chunks(), pa.array(answers, pa.binary())], names=["block", "part", "check", "data"])


def _carried(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    for block, rows in _blocks(batches, block_bytes):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int64()), pa.array([_check(rows)], pa.int64()), pa.array([_squeeze_texts.compress(sink.getvalue())], pa.binary())], names=["block", "part", "check", "data"])


def _own_counts(rank: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each n-gram, by its rank in the block, occurs in its own text."""
    both = text.astype(np.int64) << 36 | rank
    by = np.argsort(both)
    ranked = both[by]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(both) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(both)))
    out = np.empty(len(both), np.int64)
    out[by] = np.repeat(n, n)
    return out


def _score_part(texts: pa.ChunkedArray, table_of: dict[int, tuple[int, np.ndarray, np.ndarray]], order: int, bucket_bits: int, total: int, alpha: float, leave_one_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, log score, words with full context, words unseen) of each text. table_of: bucket -> (rank of its first key, keys, counts)."""
    grams, index = gram_keys(texts, order, bucket_bits)
    lengths = np.diff(index)
    text = np.repeat(np.arange(len(lengths)), lengths)
    keys, places, bounds = _dealt(grams, bucket_bits)
    rank, counts = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        here = slice(bounds[b], bounds[b + 1])
        first, known, corpus = table_of[b]
        at = np.searchsorted(known, keys[here])
        rank[places[here]], counts[places[here]] = first + at, corpus[at]
    grams = [at for _, _, at in grams]
    del keys, places
    words = len(text)
    table = np.zeros((order, words), np.int64)  # by the position of the n-gram's first word
    done = 0
    for n, at in enumerate(grams):
        here = slice(done, done + len(at))
        table[n, at] = counts[here] - (_own_counts(rank[here], text[at]) if leave_one_out else 0)
        done += len(at)
    place = np.arange(words) - index[:-1][text]
    base = total - lengths[text] * leave_one_out
    score = np.zeros(words)
    used = np.zeros(words, np.int64)
    todo = np.ones(words, bool)
    top = np.minimum(place + 1, order)
    for n in range(order, 0, -1):
        here = np.flatnonzero(todo & (top >= n))
        num = table[n - 1, here - n + 1]
        here, num = here[num > 0], num[num > 0]
        den = table[n - 2, here - n + 1] if n > 1 else base[here]
        score[here] = np.log(num) - np.log(den) + (top[here] - n) * np.log(alpha)
        used[here] = n
        todo[here] = False
    left = np.flatnonzero(todo)
    score[left] = np.log(0.5) - np.log(np.maximum(base[left], 1)) + (top[left] - 1) * np.log(alpha)
    n_docs = len(lengths)
    return lengths, np.bincount(text, score, n_docs).astype(float), np.bincount(text, used == order, n_docs), np.bincount(text, used == 0, n_docs)


def _sum_up(batches: Iterator[pa.RecordBatch], order: int, bucket_bits: int, total: int, alpha: float, leave_one_out: bool) -> Iterator[pa.RecordBatch]:
    for got in runs(batches, "block"):
        parts, data = got.column("part").to_pylist(), got.column("data").to_pylist()
        if parts[0] != -1 or len(set(got.column("check").to_pylist())) > 1:
            raise RuntimeError("the documents were not read the same way twice: checkpoint the input first")
        docs = pa.ipc.open_stream(_unsqueeze.decompress(data[0])).read_all()
        corpus = {p: x for p, x in zip(parts[1:], data[1:])}
        del got, data
        table_of, done = {}, 0
        for b, ranked in _block_keys(docs, order, bucket_bits):
            known = ranked[_starts(ranked)]
            counts = _unplanes(corpus.pop(b), 6)
            table_of[b] = done, known, counts.astype(np.min_scalar_type(counts.max()))  # most buckets' counts are short
            done += len(known)
        found = [_score_part(texts, table_of, order, bucket_bits, total, alpha, leave_one_out) for texts in _parts(docs)]
        lengths, score, full, unseen = (np.concatenate([f[i] for f in found]) for i in range(4))
        yield pa.RecordBatch.from_arrays([
            docs.column(0).combine_chunks(),
            pa.array(lengths.astype(np.int64)),
            pa.array(score),
            pa.array(full.astype(np.int64)),
            pa.array(unseen.astype(np.int64)),
        ], names=["doc_id", "n_words", "log_score", "n_full", "n_unseen"])


def stupid_backoff(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, leave_one_out: bool = True, block_bytes: int = 32 << 20, bucket_keys: int = 1 << 21) -> DataFrame:
    """(doc_id, n_words, log_score, n_full, n_unseen) of every row.

    n_full: words scored with their full context of order - 1 words; n_unseen: words that occur in no other document.
    """
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    total, size = (x or 0 for x in rows.select("text").mapInArrow(_measure, "words long, size long").agg(F.sum("words"), F.sum("size")).first())
    bucket_bits = min(22, max(3, (total * order // bucket_keys).bit_length()))
    requests = rows.mapInArrow(lambda it: _requests(it, order, bucket_bits, block_bytes), "bucket long, block long, check long, keys binary, counts binary")
    answers = requests.repartition(1 << bucket_bits - 2, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "block long, part long, check long, data binary")
    carried = rows.mapInArrow(lambda it: _carried(it, block_bytes), "block long, part long, check long, data binary")
    met = carried.union(answers).repartition(1 + size // (2 * block_bytes), "block").sortWithinPartitions("block", "part")
    return met.mapInArrow(lambda it: _sum_up(it, order, bucket_bits, total, alpha, leave_one_out), "doc_id long, n_words long, log_score double, n_full long, n_unseen long")
