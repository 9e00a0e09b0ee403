"""Entropies, information gain, symmetric uncertainty and subset merit, relationally and on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import ZERO_BETWEEN_FEATURES, ZERO_WITH_LABEL, ZERO_WITHIN, entropy_of_counts, symmetric_uncertainty, zero_rule


def feature_entropies(rows: DataFrame, n_columns: int) -> DataFrame:
    """(i, h) of every column of horizontal rows, the label included."""
    counts = rows.select(F.posexplode("a").alias("i", "v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("i").agg(entropy_of_counts("n", F.sum("n").cast("double")).alias("h"))
    return totals.where(F.col("i") < n_columns)


def joint_entropies(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, h_joint) from contingency cells."""
    return cells.groupBy(*keys).agg(entropy_of_counts("n", F.sum("n").cast("double")).alias("h_joint"))


def conditional_entropies(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, h_v, h_w, h_v_given_w, gain) from contingency cells: marginals and H(v | w) = H(v, w) - H(w)."""
    joint = joint_entropies(cells, keys)
    marginal = lambda c: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(entropy_of_counts("n", F.sum("n").cast("double")).alias(f"h_{c}"))
    out = joint.join(marginal("v"), keys).join(marginal("w"), keys)
    return out.select(*keys, "h_v", "h_w", (F.col("h_joint") - F.col("h_w")).alias("h_v_given_w"), (F.col("h_v") + F.col("h_w") - F.col("h_joint")).alias("gain"))


def correlations(cells: DataFrame, entropies: DataFrame, label: int) -> DataFrame:
    """(i, j, su) with the zero rule, from cells (i, j, v, w, n) and a row per column (i, h)."""
    joint = joint_entropies(cells, ["i", "j"])
    hi = F.broadcast(entropies.select(F.col("i").alias("ki"), F.col("h").alias("hi")))  # a row per column
    hj = F.broadcast(entropies.select(F.col("i").alias("kj"), F.col("h").alias("hj")))
    su = symmetric_uncertainty(F.col("hi"), F.col("hj"), F.col("h_joint"))
    both = joint.join(hi, F.col("i") == F.col("ki")).join(hj, F.col("j") == F.col("kj"))
    return both.select("i", "j", zero_rule(su, (F.col("i") == label) | (F.col("j") == label)).alias("su"))


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller index first."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *rest)


def unknown_pairs(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The wanted pairs that have no known correlation."""
    return canonical(wanted).distinct().join(canonical(known).select("i", "j"), ["i", "j"], "left_anti")


def entropy(counts: Iterable[int]) -> float:
    ordered = sorted(counts)
    total = float(sum(ordered))
    return math.log(total) - math.fsum(c * math.log(c) for c in ordered) / total


def uncertainty_of_cells(cells: Mapping[tuple[int, int], int], with_label: bool) -> float:
    """Symmetric uncertainty of one contingency table on the driver, with the zero rule."""
    v: dict[int, int] = {}
    w: dict[int, int] = {}
    for (a, b), n in cells.items():
        v[a] = v.get(a, 0) + n
        w[b] = w.get(b, 0) + n
    return uncertainty(entropy(v.values()), entropy(w.values()), entropy(cells.values()), with_label)


def uncertainty(h_one: float, h_two: float, h_joint: float, with_label: bool) -> float:
    """Symmetric uncertainty from entropies, with the zero rule."""
    both = h_one + h_two
    su = 0.0 if both == 0 else 2 * (both - h_joint) / both
    if abs(su) < ZERO_WITHIN:
        return ZERO_WITH_LABEL if with_label else ZERO_BETWEEN_FEATURES
    return su


def subset_pairs(subset: list[int], label: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(pairs with the label, pairs inside the subset with i < j), in sorted order."""
    s = sorted(subset)
    return [(i, label) for i in s], [(i, j) for x, i in enumerate(s) for j in s[x + 1 :]]


def merit(subset: list[int], label: int, su: Mapping[tuple[int, int], float]) -> float:
    """Sum of correlations with the label over sqrt(size + 2 * sum of correlations inside); 0 for the empty set.

    Both sums run in sorted order, so that subsets reached in different orders tie exactly.
    """
    if len(set(subset)) != len(subset):
        raise ValueError("a subset holds every feature once")
    outer, inner = subset_pairs(subset, label)
    denominator = math.sqrt(len(subset) + 2.0 * sum(su[p] for p in inner))
    return abs(sum(su[p] for p in outer) / denominator) if denominator else 0.0
