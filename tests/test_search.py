"""Measures and search against hand-checkable tables, a brute-force model and properties."""

import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.operators import measures
from sievework.plans.search import Correlations, add_locally_predictive, best_first, top_states

WEATHER = [tuple(x) for x in "shhfn shhtn ohhfy rmhfy rcnfy rcntn ocnty smhfn scnfy rmnfy smnty omhty ohnfy rmhtn".split()]
XOR = [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]
DUP3 = [tuple(map(int, x)) for x in "0000 0010 1101 1111 0010 1101 0000 1111".split()]


def correlations(rows):
    label = len(rows[0]) - 1

    def counts(fixed, partners):
        return {p: Counter((r[p], r[fixed]) for r in rows) for p in partners}

    return Correlations(label, counts)


def select(rows, patience, local=True):
    c = correlations(rows)
    found = best_first(len(rows[0]) - 1, c, patience)
    chosen = add_locally_predictive(found.subset, len(rows[0]) - 1, c) if local else found.subset
    return found, chosen, c


@pytest.mark.parametrize("patience, pairs", [(1, 9), (2, 10), (3, 11), (5, 14)])
def test_weather(patience, pairs):
    c = correlations(WEATHER)
    found = best_first(4, c, patience)
    assert found.subset == (0, 2) and round(found.merit, 6) == 0.247287 and c.requested == pairs
    assert add_locally_predictive(found.subset, 4, c) == (0, 2)
    assert [round(c[i, 4], 6) for i in range(4)] == [0.196013, 0.023407, 0.156508, 0.049989]
    c.fetch(2, [3])
    assert c[2, 3] == 1.0  # exactly independent


def test_weather_expansions():
    found = best_first(4, correlations(WEATHER), 5)
    assert [s.expanded for s in found.trace][:6] == [(), (0,), (0, 2), (0, 2, 1), (0, 2, 3), (0, 3)]


@pytest.mark.parametrize("patience", [1, 2, 3, 5])
def test_xor_and_duplicates(patience):
    found, chosen, _ = select(XOR, patience)
    assert (found.subset, found.merit, chosen) == ((), 0.0, (0,))
    found, chosen, _ = select(DUP3, patience)
    assert (found.subset, found.merit, chosen) == ((0,), 1.0, (0, 1))


def test_constant_label_and_single_feature():
    found, chosen, _ = select([(0, 1, 0), (1, 0, 0), (1, 1, 0)], 3)
    assert found.subset == () and chosen == (0,)
    found, chosen, _ = select([(0, 0), (1, 1)], 5)
    assert found.subset == (0,) == chosen


def plain_su(x, y):
    n = len(x)
    h = lambda c: -sum(k / n * math.log(k / n) for k in c.values())
    a, b, ab = h(Counter(x)), h(Counter(y)), h(Counter(zip(x, y)))
    return 0.0 if a + b == 0 else 2 * (a + b - ab) / (a + b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_uncertainty(rows):
    x, y = zip(*rows)
    expected = plain_su(x, y)
    for with_label, zero in ((True, 0.0), (False, 1.0)):
        got = measures.uncertainty_of_cells(Counter(rows), with_label)
        assert got == pytest.approx(zero if abs(expected) < 1e-6 else expected, abs=1e-9)
        assert got == pytest.approx(measures.uncertainty_of_cells(Counter((b, a) for a, b in rows), with_label), abs=1e-12)
        assert got == measures.uncertainty_of_cells(Counter((3 - a, b + 7) for a, b in rows), with_label)
        assert 0 <= got <= 1 + 1e-12


def test_queue_is_a_stable_top_k():
    """Against the bounded list's rule: insert behind the last that is at least as good, skip what isn't better than the last when full."""
    rng = random.Random(3)
    for _ in range(400):
        k = rng.randint(1, 5)
        kept, queue = [], []
        for arrival in range(rng.randint(1, 12)):
            new = (rng.randint(0, 4) / 4, (arrival,))
            queue = top_states(queue, [new], k)
            if len(kept) == k and kept[-1][0] >= new[0]:
                continue
            at = max((i + 1 for i, x in enumerate(kept) if x[0] >= new[0]), default=0)
            kept = (kept[:at] + [new] + kept[at:])[:k]
            assert queue == kept


def test_merit():
    su = {p: 0.1 * (p[0] + 1) for p in itertools.combinations(range(4), 2)}
    assert measures.merit([], 3, su) == 0
    assert measures.merit([2, 0], 3, su) == pytest.approx((0.1 + 0.3) / math.sqrt(2 + 0.2))
    assert measures.merit([2, 0, 1], 3, su) == measures.merit([1, 2, 0], 3, su)
    with pytest.raises(ValueError):
        measures.merit([1, 1], 3, su)


def test_guards():
    with pytest.raises(ValueError):
        top_states([], [], 0)
    with pytest.raises(ValueError):
        correlations(XOR).request(2, [])


def test_merged_counts(spark):
    from sievework.operators.contingency import merged

    one = spark.createDataFrame([(0, 1, 1, 2), (0, 1, 2, 1)], "i int, v int, w int, n long")
    two = spark.createDataFrame([(0, 1, 1, 5)], "i int, v int, w int, n long")
    assert sorted(map(tuple, merged(one, two).collect())) == [(0, 1, 1, 7), (0, 1, 2, 1)]
