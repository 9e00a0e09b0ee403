"""Operator 10: toxicity by a factorization machine over hashed terms.

A text's terms are its runs of letters and digits (any byte beyond ASCII counts as a letter), lower-cased, and the
beginnings of longer runs (4 to 7 bytes), all hashed to 2^20 slots, with a second slot for a term that occurs more than
once; a document is the set of its slots.  The model is

    score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)      over the slots i, j present,

so that pairs of terms (an insult beside a mention of a group) weigh more or less than the sum of their parts.
It is trained on at most `train_rows` labelled rows, taken by a hash of the id.  Slots that get weights are, among them,

* the `features` with the largest chi-squared against the label, and
* those of the `pair_features` pairs that interact most: over the chi-squared ones and the `pair_candidates` that vary most, the label's
  share where both are present is held against what the two alone would give.  A group mention that is as common in clean
  texts as in toxic ones gets its factors so, although it tells nothing by itself.

Slots are counted in Spark; what reaches the driver is at most a row per candidate slot, and for each training row the
candidates that it has, however long its text.  The model is a few hundred short rows and is sent to the workers with
the task; scoring is one pass without a shuffle over whole texts.

Training rows are those whose crc32 of the id as text, modulo 4, isn't 2; the other labels are never read.
Labels, languages, sources and ids are not inputs of a score.

Defined results for odd input: a null or empty text has no terms and gets sigmoid(w0); a null id is not held out
and is scored; labels that are null or occur on several rows count as 0 and as their maximum; without any
labelled row, or with only one kind of label, the score is the smoothed share of label 1 for every text; an
empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import textnum
from sievework.llm.common import checkpointed, named, ship

SLOT_BITS = 20
#: Lengths in bytes of the word beginnings that are terms of their own, so that a stem is known in new words.
STEMS = (4, 5, 6, 7)
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every different term of each text, sorted; a term that occurs again has a second slot for that."""
    data, offsets = textnum.text_buffer(column)
    starts, ends, index = textnum.word_bounds(data, offsets, _BREAK)
    own = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(index)) << np.uint64(SLOT_BITS)
    parts = [own | textnum.span_hashes(data, starts, ends, textnum._LOWER) >> np.uint64(64 - SLOT_BITS)]
    for n in STEMS:
        long = ends - starts > n
        heads = textnum.mix64(textnum.span_hashes(data, starts[long], starts[long] + n, textnum._LOWER) + np.uint64(n))
        parts.append(own[long] | heads >> np.uint64(64 - SLOT_BITS))
    both = np.concatenate(parts)
    both.sort()
    if len(both):
        new = np.append(True, both[1:] != both[:-1])
        again = both[np.flatnonzero(new[:-1] & ~new[1:])]
        low = np.uint64((1 << SLOT_BITS) - 1)
        both = np.concatenate([both[new], again & ~low | (again * np.uint64(0x9E3779B1) + np.uint64(0x7F4A7)) & low])
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> np.uint64(SLOT_BITS)).astype(np.int64), (both & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


@dataclass
class FactorizationMachine:
    slots: np.ndarray  # sorted slots that have weights
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, n: int, text: np.ndarray, slot: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.slots, slot)
        place[place == len(self.slots)] = 0
        hit = self.slots[place] == slot if len(self.slots) else np.zeros(len(slot), bool)
        text, place = text[hit], place[hit]
        out = self.bias + np.bincount(text, self.linear[place], n)
        for f in range(self.factors.shape[1]):
            x = self.factors[place, f]
            out += 0.5 * (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _chi(seen, with_label, n, positive):
    """Chi-squared of a slot's presence against the label; 0 where it is seen in fewer than 4 rows. Numbers or numpy arrays."""
    expected = seen * positive / n
    spread = expected * (1 - positive / n) * np.maximum(1 - seen / n, 1 / n)
    return np.where(seen >= 4, (with_label - expected) ** 2 / np.maximum(spread, 1e-9), 0)


def _best(value: np.ndarray, many: int, least: float) -> np.ndarray:
    best = np.argsort(-value, kind="stable")[:many]
    return best[value[best] > least]


def interacting(blocks: Iterator[tuple[np.ndarray, np.ndarray]], columns: int, many: int) -> np.ndarray:
    """Columns that are in one of the `many` pairs with the strongest interaction on the label, if it is far beyond chance.

    blocks: 0/1 rows and their labels.  The contrast of a pair is the label's share with both, less that with either alone,
    plus that with neither, over its standard error; all four cells must have rows enough.
    """
    both, both_label = np.zeros((columns, columns), np.float32), np.zeros((columns, columns), np.float32)
    n = positive = 0.0
    for present, label in blocks:
        both += present.T @ present
        both_label += present.T @ (present * label[:, None])
        n, positive = n + len(label), positive + float(label.sum())
    one, hits = np.diag(both).copy(), np.diag(both_label).copy()
    share = positive / n
    contrast, variance = np.zeros_like(both), np.zeros_like(both)
    enough = np.ones(both.shape, bool)

    def cell(sign: int, rows: np.ndarray, labelled: np.ndarray) -> None:
        nonlocal enough
        enough &= rows >= 12
        rows = np.maximum(rows, 1)
        np.add(contrast, sign * labelled / rows, out=contrast)
        np.add(variance, np.float32(share * (1 - share)) / rows, out=variance)

    cell(1, both, both_label)
    cell(-1, one[:, None] - both, hits[:, None] - both_label)
    cell(-1, one[None, :] - both, hits[None, :] - both_label)
    cell(1, np.float32(n) - one[:, None] - one[None, :] + both, np.float32(positive) - hits[:, None] - hits[None, :] + both_label)
    strength = np.triu(np.where(enough, contrast * contrast / variance, np.float32(0)), 1).ravel()
    far = np.flatnonzero(strength > 60)
    pairs = far[np.argsort(-strength[far], kind="stable")[:many]]
    return np.unique(np.concatenate(np.divmod(pairs, columns))) if len(pairs) else pairs


def choose_slots(slot: np.ndarray, bounds: np.ndarray, label: np.ndarray, features: int, pair_candidates: int, pair_features: int) -> np.ndarray:
    """The slots that get weights, sorted. bounds: where each text's slots begin (n + 1)."""
    n, positive = len(label), float(label.sum())
    known = np.unique(slot)
    place = np.searchsorted(known, slot).astype(np.int32)
    seen, with_label = np.zeros(len(known)), np.zeros(len(known))
    for low in range(0, n, 2048):
        here, high = place[bounds[low] : bounds[min(low + 2048, n)]], min(low + 2048, n)
        seen += np.bincount(here, minlength=len(known))
        with_label += np.bincount(here, np.repeat(label[low:high], np.diff(bounds[low : high + 1])), len(known))
    chosen = _best(_chi(seen, with_label, n, positive), features, 6.0)
    varied = _best(seen * (n - seen) * (seen >= 4.0), pair_candidates, 0.0)
    tried = np.union1d(chosen, varied)
    column = np.full(len(known), -1, np.int32)
    column[tried] = np.arange(len(tried))

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, n, 2048):
            high = min(low + 2048, n)
            at = column[place[bounds[low] : bounds[high]]]
            text = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(bounds[low : high + 1]))
            present = np.zeros((high - low, len(tried)), np.float32)
            present[text[at >= 0], at[at >= 0]] = 1
            yield present, label[low:high].astype(np.float32)

    return known[np.union1d(chosen, tried[interacting(blocks(), len(tried), pair_features)])].astype(np.int64)


def train(slot: np.ndarray, bounds: np.ndarray, label: np.ndarray, *, features: int = 512, pair_candidates: int = 1024, pair_features: int = 64, factors: int = 4, rounds: int = 160, decay: float = 2e-5, seed: int = 7) -> FactorizationMachine:
    """Adam on the mean log loss over all rows. slot: the slots of all texts, one after the other; bounds: where each text's begin (n + 1)."""
    n, positive = len(label), float(label.sum())
    share = (positive + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    slots = choose_slots(slot, bounds, label, features, pair_candidates, pair_features) if n and 0 < positive < n else np.zeros(0, np.int64)
    if len(slots) == 0:
        return FactorizationMachine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    index = np.full(1 << SLOT_BITS, -1, np.int32)
    index[slots] = np.arange(len(slots))
    place = index[slot]
    hit = np.flatnonzero(place >= 0)
    place = place[hit]
    text = np.searchsorted(bounds, hit, "right") - 1
    del hit, index
    rng = np.random.default_rng(seed)
    m = len(slots)
    theta = np.concatenate([[bias], np.zeros(m), rng.normal(0, 0.02, m * factors)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(m, factors)
        vp = v[place]
        sums = np.stack([np.bincount(text, vp[:, f], n) for f in range(factors)], 1)
        out = theta[0] + np.bincount(text, w[place], n) + 0.5 * ((sums**2).sum(1) - np.bincount(text, (vp * vp).sum(1), n))
        wrong = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label) / n
        at = wrong[text]
        grad = np.empty_like(theta)
        grad[0] = wrong.sum()
        grad[1 : m + 1] = np.bincount(place, at, m) + decay * w
        pull = (sums[text] - vp) * at[:, None]
        grad[m + 1 :] = (np.stack([np.bincount(place, pull[:, f], m) for f in range(factors)], 1) + 4 * decay * v).ravel()
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return FactorizationMachine(slots, float(theta[0]), theta[1 : m + 1].copy(), theta[m + 1 :].reshape(m, factors).copy())


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(named(id_column).cast("string")) % 4 == 2, F.lit(False))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        text, slot = term_slots(batch.column(2))
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        packed = [slot[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["nth", "label", "slots"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, with_label, n, positive = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64), 0, 0
    for batch in batches:
        label = batch.column(1).to_pylist()
        for y, packed in zip(label, batch.column(2).to_pylist()):
            slots = np.frombuffer(packed, "<u4")
            seen[slots] += 1
            with_label[slots] += y
        n, positive = n + len(label), positive + sum(label)
    some = np.flatnonzero(seen)  # and the rows themselves, as slot -1
    cols = (np.append(some, -1), np.append(seen[some], n), np.append(with_label[some], positive))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["slot", "seen", "with_label"])


def _only(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.frombuffer(x, "<u4") for x in batch.column(2).to_pylist()]
        packed = [x[np.isin(x, slots)].tobytes() for x in packed]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["nth", "label", "slots"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 12000, features: int = 512, pair_candidates: int = 1024, **options) -> FactorizationMachine:
    """Train on at most train_rows labelled rows outside the held-out quarter."""
    ship(docs.sparkSession)
    usable = labels.select(named(id_col).alias("id"), F.coalesce(named(label_col).cast("int"), F.lit(0)).alias("label"))
    usable = usable.where(F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("nth"), "label", "text")  # at most train_rows short rows
    terms = checkpointed(rows.mapInArrow(_terms, "nth long, label int, slots binary"))
    counts = checkpointed(terms.mapInArrow(_slot_counts, "slot long, seen long, with_label long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("with_label").alias("with_label")))
    whole = counts.where("slot = -1").first()
    n, positive = (whole["seen"], whole["with_label"]) if whole else (0, 0)
    if not 0 < positive < n:
        return train(np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.repeat([1.0, 0.0], [positive, n - positive]), **options)
    expected = F.col("seen") * positive / n
    chi = F.pow(F.col("with_label") - expected, 2) / F.greatest(F.lit(1e-9), expected * (1 - positive / n) * F.greatest(1 - F.col("seen") / n, F.lit(1 / n)))
    ranked = counts.where("slot >= 0 and seen >= 4")
    tried = [*ranked.orderBy(F.desc(chi), "slot").limit(features).collect(), *ranked.orderBy(F.desc(F.col("seen") * (n - F.col("seen"))), "slot").limit(pair_candidates).collect()]
    tried = np.unique([r["slot"] for r in tried]).astype(np.uint32)
    got = terms.mapInArrow(lambda it: _only(it, tried), "nth long, label int, slots binary").toArrow().sort_by([("nth", "ascending"), ("slots", "ascending")])
    label = got.column("label").to_numpy().astype(float)
    packed = got.column("slots").to_pylist()
    bounds = np.cumsum([0] + [len(x) // 4 for x in packed])
    slot = np.frombuffer(b"".join(packed), "<u4")
    return train(slot, bounds, label, features=features, pair_candidates=pair_candidates, **options)


def _score(batches: Iterator[pa.RecordBatch], model: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        scores = model.scores(batch.num_rows, *term_slots(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def _reject(batches: Iterator[pa.RecordBatch], model: FactorizationMachine, text_at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        scores = model.scores(batch.num_rows, *term_slots(batch.column(text_at)))
        yield batch.filter(pa.array(scores < threshold))


def score(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def reject(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    ship(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any kind don't reach the workers
    return plain.mapInArrow(lambda it: _reject(it, model, text_at, threshold), plain.schema).toDF(*docs.columns)
