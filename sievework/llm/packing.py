"""Operator 9: hierarchical multi-length packing of token sequences.

Every task tokenizes its share of the documents and packs it in blocks:

1. a document longer than the longest context first yields full windows of that length;
2. what is left is routed to the smallest context tier (256, 512, 1024, 2048 by default) that holds it;
3. the tiers are packed from the longest down.  A window opens with a document of its own tier; its gap
   takes the longest whole documents of the shorter tiers that fit, and only the last few tokens of the
   gap are a piece cut off the smallest document that is larger;
4. a block's windows of each tier are dealt to step groups of `step_tokens` tokens, the costliest first, each to the
   group with the least cost that has room; a window's cost is the sum of its pieces' squared lengths, as attention's is.
   Groups then have equal token counts and next to equal costs; only the last of a tier is left with room for the next block.

With `in_order` a block's windows are numbered by the places of their longest documents among the rows, not tier by tier,
so sequence ids follow the order of the rows, to a block's accuracy, as far as the partitions do.

All windows of a block come out exactly full.  What cannot fill a window waits for the next block; at the
end of the task the rest is laid out in windows of falling powers of two, so nothing is padded.

The work is one pass without a shuffle: a task's output depends on its input split only, so a lost
executor's tasks are simply run again and give the same pieces.  Memory is bounded by a block of tokens
and the longest single document.

Defined results for odd input: a null text counts as empty and yields the end id alone; a null id is
carried as null; repeated rows are packed once each; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import named, ship
from sievework.llm.tokens import TokenStream

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long, step_tokens long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class Packer:
    """Packs documents, added as rows of ids, into windows; pieces are (document, start, length, sequence, offset)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, in_order: bool = False):
        self.tiers = tuple(sorted(tiers))
        self.top = self.tiers[-1]
        self.step_tokens = step_tokens
        self.in_order = in_order
        self.sequences = 0
        self.groups = 0
        self.rooms: dict[int, list[tuple[int, int, int]]] = {}  # tier -> (cost, group, windows it has room for)
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start)

    def _dealt(self, windows: list[tuple[list[tuple[int, int, int]], int]]) -> list[int]:
        """The step group of each window."""
        out = [0] * len(windows)
        costs = [sum(length * length for length, _, _ in parts) for parts, _ in windows]
        for tier in {w for _, w in windows}:
            own = sorted((i for i, (_, w) in enumerate(windows) if w == tier), key=lambda i: -costs[i])
            size = max(1, self.step_tokens // tier)
            rooms = self.rooms.get(tier, [])
            lack = len(own) - sum(r[2] for r in rooms)
            for n in [size] * (max(0, lack) // size) + ([lack % size] if lack % size and lack > 0 else []):
                rooms.append((0, self.groups, n))  # the last one takes only what there is now
                self.groups += 1
            heapify(rooms)
            full = []
            for i in own:
                cost, group, room = heappop(rooms)
                out[i] = group
                if room > 1:
                    heappush(rooms, (cost + costs[i], group, room - 1))
                else:
                    full.append((cost + costs[i], group))
            last = max((g for _, g in full), default=None) if lack > 0 and lack % size else None
            self.rooms[tier] = rooms + [(c, g, size - lack % size) for c, g in full if g == last]
        return out

    def _emit(self, windows: list[tuple[list[tuple[int, int, int]], int]], out: list) -> None:
        for (parts, window), group in zip(windows, self._dealt(windows)):
            offset = 0
            for length, doc, start in parts:
                out.append((doc, start, length, self.sequences, offset, window, group))
                offset += length
            self.sequences += 1

    def add(self, docs: list[tuple[int, int]]) -> list:
        """docs: (document, tokens). Gives the pieces of all windows that are now full."""
        full_windows: list[tuple[list[tuple[int, int, int]], int]] = []
        pool = self.waiting
        for doc, tokens in docs:
            full = tokens - tokens % self.top
            for start in range(0, full, self.top):
                full_windows.append(([(self.top, doc, start)], self.top))
            if tokens > full:
                pool.append((tokens - full, doc, full))
        pool.sort()
        self.waiting = []
        bound = (0, *self.tiers)
        for low, window in zip(reversed(bound[:-1]), reversed(self.tiers)):
            # the tier's own documents are those longer than the next shorter context
            while pool and pool[-1][0] > low:
                parts = [pool.pop()]
                gap = window - parts[0][0]
                while gap and pool and pool[0][0] <= gap:
                    parts.append(pool.pop(bisect_right(pool, (gap, 1 << 62, 0)) - 1))
                    gap -= parts[-1][0]
                if gap and pool:
                    length, doc, start = pool.pop(bisect_left(pool, (gap + 1, -1, 0)))
                    parts.append((gap, doc, start))
                    insort(pool, (length - gap, doc, start + gap))
                    gap = 0
                if gap:
                    self.waiting += parts
                else:
                    full_windows.append((parts, window))
        if self.in_order:
            full_windows.sort(key=lambda w: w[0][0][1])
        out: list = []
        self._emit(full_windows, out)
        return out

    def finish(self) -> list:
        """The rest, in windows of falling powers of two."""
        out: list = []
        rest = sorted(self.waiting, reverse=True)
        self.waiting = []
        total = sum(x[0] for x in rest)
        while total:
            window = min(self.top, 1 << (total.bit_length() - 1))
            total -= window
            parts, need = [], window
            while need:
                length, doc, start = rest.pop(0)
                if length > need:
                    rest.insert(0, (length - need, doc, start + need))
                    length = need
                parts.append((length, doc, start))
                need -= length
            self._emit([(parts, window)], out)
        return out


def _pack_partition(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, block_tokens: int, in_order: bool) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    stream, packer = TokenStream(tokenizer), Packer(tiers, step_tokens, in_order)
    kept: dict[int, tuple] = {}  # document -> (doc_id, ids)
    fresh: list[tuple[int, int]] = []
    tokens, serial = 0, 0

    def rows(pieces: list) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in _ARROW]
        for doc, start, length, sequence, offset, window, group in pieces:
            doc_id, ids = kept[doc]
            crc = zlib.crc32(ids[start : start + length].tobytes())
            for col, x in zip(cols, (doc_id, start, length, crc, len(ids), base + sequence, offset, window, base + group, step_tokens)):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

    def pack() -> pa.RecordBatch:
        out = rows(packer.add(fresh))
        still = {doc for _, doc, _ in packer.waiting}
        for doc in [d for d in kept if d not in still]:
            del kept[doc]
        fresh.clear()
        return out

    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            for doc_id, ids in zip(part.column(0).to_pylist(), stream.encode(part.column(1), end_id)):
                kept[serial] = (doc_id, ids)
                fresh.append((serial, len(ids)))
                serial += 1
                tokens += len(ids)
            if tokens >= block_tokens:
                yield pack()
                tokens = 0
    yield pack()
    yield rows(packer.finish())


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 32768, block_tokens: int = 1 << 21, in_order: bool = False) -> DataFrame:
    """One row per piece, with the window's length and its step group; see the module's text.

    tokenizer: path of a tokenizer file of the `tokenizers` library, present on every executor.
    """
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("context tiers must be powers of two")
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack_partition(it, tokenizer, end_id, tuple(tiers), step_tokens, block_tokens, in_order), SCHEMA)
