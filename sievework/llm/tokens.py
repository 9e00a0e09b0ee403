"""Token ids of whole texts, with every distinct word chunk tokenized once per worker.

A byte-level BPE with the usual word pattern never joins characters across a single white-space character
that has a non-space on either side, so a text can be cut in front of such a character and the chunks'
ids put end to end.  Chunks repeat a lot: they are hashed in bulk, looked up in a sorted cache, and only the
new ones reach the tokenizer, many to a call.  Hashes only find: the bytes of a chunk are compared with those of the chunk that
it is taken for, within a call and with the cache, and where any differ the call's chunks are told apart by their bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sievework.llm import textnum

_BLANK = textnum._SPACE
_AFTER = np.ones(256, bool)  # may follow a cut's white space
_AFTER[:0x21] = False
_AFTER[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False  # lead bytes that white space beyond ASCII can have
_PLAIN = np.zeros(256, bool)  # may stand before a cut as it is
_PLAIN[0x21:0x7F] = True
_TWO = np.zeros(256, bool)  # lead bytes of two-byte letters
_TWO[0xC3:0xE0] = True
_JOIN = 64
_streams: dict[str, "TokenStream"] = {}


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a chunk begins: each text's start and the safe cuts inside."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        before = _PLAIN[data[:-2]]
        before[1:] |= (data[1:-2] >= 0x80) & _TWO[data[:-3]]
        cut[1:-1] = _BLANK[data[1:-1]] & _AFTER[data[2:]] & before
    inner = offsets[1:-1]
    for shift in (-1, 0):  # a text's last and first character have no neighbour on one side
        at = inner + shift
        cut[at[(at >= 0) & (at < n)]] = False
    two = inner + 1  # a lead byte that would be the text before's
    cut[two[(two < n)]] &= _PLAIN[data[two[two < n] - 1]]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class TokenStream:
    """Encodes Arrow string columns. cache_size: chunks kept between calls."""

    def __new__(cls, path: str, cache_size: int = 1 << 20):
        if path not in _streams:
            self = _streams[path] = super().__new__(cls)
            self._open(path, cache_size)
        return _streams[path]

    def _open(self, path: str, cache_size: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache_size = cache_size
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.store = [np.zeros(0, np.uint32)]
        self.stored = 0
        self.text = [np.zeros(0, np.uint8)]  # the bytes of the cached chunks
        self.texts = 0
        self.text_at = np.zeros(0, np.int64)
        self.text_n = np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenized(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each chunk's begin, their numbers) of the chunks, many to a call where they may be joined."""
        raw = memoryview(np.ascontiguousarray(data))
        clean = _BLANK[data[starts]] & _PLAIN[data[ends - 1]] | _BLANK[data[starts]] & (data[ends - 1] >= 0x80) & _TWO[data[np.maximum(ends - 2, 0)]]
        order = np.concatenate([np.flatnonzero(clean), np.flatnonzero(~clean)])
        joined = int(clean.sum())
        groups = [order[i : min(i + _JOIN, joined)] for i in range(0, joined, _JOIN)] + [order[i : i + 1] for i in range(joined, len(order))]
        texts = [b"".join(bytes(raw[a:b]) for a, b in zip(starts[g].tolist(), ends[g].tolist())).decode() for g in groups]
        found = self._ids(texts)
        sizes = np.empty(len(starts), np.int64)
        for g, ids in zip(groups, found):
            if len(g) == 1:
                sizes[g] = len(ids)
                continue
            upto = np.cumsum(self.width[ids])
            stops = np.searchsorted(upto, np.cumsum(ends[g] - starts[g]))
            if (upto[np.minimum(stops, len(upto) - 1)] != np.cumsum(ends[g] - starts[g])).any():
                raise ValueError("the tokenizer joins characters across white space")
            sizes[g] = np.diff(stops + 1, prepend=0)
        at = np.empty(len(starts), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), at, sizes

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        ids, at, sizes = self._tokenized(data, starts, ends)
        lengths = ends - starts
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, self.stored + at), np.insert(self.n, place, sizes)
        self.text_at, self.text_n = np.insert(self.text_at, place, self.texts + np.cumsum(lengths) - lengths), np.insert(self.text_n, place, lengths)
        self.store.append(ids)
        self.stored += len(ids)
        self.text.append(data[textnum.ragged_take(starts, lengths)])
        self.texts += len(self.text[-1])

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, where each chunk's begin, their numbers) by way of the cache; None where a hash stands for different chunks."""
        keys = textnum.span_hashes(data, starts, ends)
        order = np.argsort(keys)
        ranked = keys[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        own = ranked[first]
        which = np.empty(len(keys), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        model = order[first]
        lengths = ends - starts
        if not _same_bytes(data, starts, lengths, data, starts[model][which], lengths[model][which]):
            return None
        if len(self.keys) > self.cache_size or self.texts > 64 * self.cache_size:
            self._clear()
        place = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == own[inside]
        old, cached = model[known], place[known]
        self.text = [np.concatenate(self.text) if len(self.text) > 1 else self.text[0]]
        if not _same_bytes(data, starts[old], lengths[old], self.text[0], self.text_at[cached], self.text_n[cached]):
            return None
        if not known.all():
            new = model[~known]
            self._learn(data, starts[new], ends[new], own[~known])
            place = np.searchsorted(self.keys, own)
        self.store = [np.concatenate(self.store) if len(self.store) > 1 else self.store[0]]
        return self.store[0], self.at[place][which], self.n[place][which]

    def _by_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same without hashes or the cache."""
        raw, seen = memoryview(np.ascontiguousarray(data)), {}
        which = np.array([seen.setdefault(bytes(raw[a:b]), len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])
        model = np.full(len(seen), len(starts))
        np.minimum.at(model, which, np.arange(len(starts)))
        ids, at, n = self._tokenized(data, starts[model], ends[model])
        return ids, at[which], n[which]

    def encode(self, column: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """A row of ids for each text, null as empty, each followed by end_id if given."""
        data, offsets = textnum.text_buffer(column)
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        starts = chunk_starts(data, offsets)
        if len(starts) == 0:
            return [tail.copy() for _ in range(len(offsets) - 1)]
        ends = np.append(starts[1:], len(data))
        store, at, n = self._lookup(data, starts, ends) or self._by_bytes(data, starts, ends)
        ids = store[textnum.ragged_take(at, n)]
        upto = np.append(0, np.cumsum(n))
        bounds = upto[np.searchsorted(starts, offsets)]
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _same_bytes(a: np.ndarray, a_at: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_n: np.ndarray, step: int = 1 << 20) -> bool:
    """Whether each span of a equals its span of b; in slices of some `step` bytes."""
    if not np.array_equal(a_n, b_n):
        return False
    upto = np.cumsum(a_n)
    low = 0
    while low < len(a_n):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + step)))
        if not np.array_equal(a[textnum.ragged_take(a_at[low:high], a_n[low:high])], b[textnum.ragged_take(b_at[low:high], b_n[low:high])]):
            return False
        low = high
    return True
