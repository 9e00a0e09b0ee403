"""Column expressions for information measures over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the contract: correlations closer to zero than this count as zero, and what a zero becomes.
ZERO_WITHIN = 1e-6
ZERO_WITH_LABEL = 0.0
ZERO_BETWEEN_FEATURES = 1.0


def entropy_of_counts(counts: Column | str, total: Column | float) -> Column:
    """Aggregate: entropy in nats of a distribution given by one row per count. Summed over the sorted counts, so the result doesn't depend on the order of rows."""
    ordered = F.array_sort(F.collect_list(F.col(counts) if isinstance(counts, str) else counts))
    weighted = F.aggregate(ordered, F.lit(0.0), lambda acc, c: acc + c * F.log(c.cast("double")))
    return F.log(total) - weighted / total


def approximately(a: Column, b: Column | float, within: float) -> Column:
    return F.abs(a - b) < within


def symmetric_uncertainty(h_one: Column, h_two: Column, h_joint: Column) -> Column:
    """2 (H1 + H2 - H12) / (H1 + H2), 0 where both entropies are 0."""
    both = h_one + h_two
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * (both - h_joint) / both)


def zero_rule(su: Column, with_label: Column) -> Column:
    """A correlation of about zero is exactly 0 with the label and 1 between features."""
    zero = F.when(with_label, F.lit(ZERO_WITH_LABEL)).otherwise(F.lit(ZERO_BETWEEN_FEATURES))
    return F.when(approximately(su, 0.0, ZERO_WITHIN), zero).otherwise(su)
