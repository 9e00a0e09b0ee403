"""Best-first search for the subset of highest merit, and the locally predictive pass after it.

The loop runs on the driver over a handful of numbers; every request for correlations it doesn't know yet is one
distributed aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from sievework.operators.measures import merit, uncertainty_of_cells

#: Fixed values of the contract: a better state must gain more than this; merits compare at so many digits.
MIN_GAIN = 1e-5
DIGITS = 12

Cells = dict[tuple[int, int], int]
CountSource = Callable[[int, list[int]], dict[int, Cells]]
ValueSource = Callable[[int, list[int]], dict[int, float]]


class Correlations:
    """Symmetric cache of correlations, filled on request: from values that Spark has worked out, or from contingency counts."""

    def __init__(self, label: int, counts: CountSource | None = None, values: ValueSource | None = None):
        self.label, self.counts, self.values = label, counts, values
        self.su: dict[tuple[int, int], float] = {}
        self.requested = self.computed = self.rounds = 0

    def request(self, fixed: int, partners: list[int]) -> None:
        """Make the correlations of fixed with all partners known; only unknown pairs are counted."""
        if not partners:
            raise ValueError("a request names at least one partner")
        self.requested += len(partners)
        self.fetch(fixed, partners)

    def fetch(self, fixed: int, partners: list[int]) -> None:
        missing = [p for p in partners if (min(p, fixed), max(p, fixed)) not in self.su]
        if not missing:
            return
        self.rounds += 1
        self.computed += len(missing)
        if self.values:
            found = self.values(fixed, missing)
        else:
            found = {p: uncertainty_of_cells(cells, self.label in (p, fixed)) for p, cells in self.counts(fixed, missing).items()}
        for p, su in found.items():
            self.su[min(p, fixed), max(p, fixed)] = su

    def __getitem__(self, pair: tuple[int, int]) -> float:
        return self.su[min(pair), max(pair)]


@dataclass
class Step:
    """One expansion: the state taken, how many were new, the queue's head after it."""

    expanded: tuple[int, ...]
    partners: int
    head: tuple[int, ...]
    merit: float
    improved: bool
    fails: int


@dataclass
class Found:
    subset: tuple[int, ...]
    merit: float
    trace: list[Step] = field(default_factory=list)
    evaluations: int = 0


def top_states(queue: list[tuple[float, tuple[int, ...]]], new: list[tuple[float, tuple[int, ...]]], capacity: int) -> list[tuple[float, tuple[int, ...]]]:
    """The bounded queue after an insert: a stable top-k by merit, so that earlier arrivals win ties."""
    if capacity < 1:
        raise ValueError("the queue holds at least one state")
    return sorted(queue + new, key=lambda s: -round(s[0], DIGITS))[:capacity]


def best_first(n_features: int, correlations: Correlations, patience: int) -> Found:
    """patience: both the queue's capacity and the number of expansions in a row that may not improve."""
    label = correlations.label
    queue: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    found, fails = Found((), 0.0, evaluations=1), 0
    while queue:
        _, state = queue.pop(0)
        partners = [f for f in range(n_features) if f not in state]
        if partners:
            correlations.request(state[-1] if state else label, partners)
        new = [(merit(list((*state, f)), label, correlations), (*state, f)) for f in partners]
        found.evaluations += len(new)
        queue = top_states(queue, new, patience)
        if not queue:
            break
        better = round(queue[0][0], DIGITS) - round(found.merit, DIGITS) > MIN_GAIN
        if better:
            found.merit, found.subset, fails = queue[0][0], queue[0][1], 0
        else:
            fails += 1
        found.trace.append(Step(state, len(partners), queue[0][1], queue[0][0], better, fails))
        if fails >= patience:
            break
    return found


def add_locally_predictive(subset: tuple[int, ...], n_features: int, correlations: Correlations) -> tuple[int, ...]:
    """Append, from the highest correlation with the label down, each feature that no chosen one is more correlated to than the label is."""
    label = correlations.label
    rest = sorted((f for f in range(n_features) if f not in subset), key=lambda f: -round(correlations[f, label], DIGITS))
    chosen = list(subset)
    for f in rest:
        if chosen:
            correlations.fetch(f, sorted(chosen))
        if not any(round(correlations[g, f], DIGITS) > round(correlations[f, label], DIGITS) for g in chosen):
            chosen.append(f)
    return tuple(chosen)
