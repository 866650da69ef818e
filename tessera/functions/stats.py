"""Scalar estimators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k_value(n: int, c: int, k: int) -> float:
    """Unbiased pass@k, 1 - C(n - c, k) / C(n, k), as the product of its k
    factors (n - c - j) / (n - j): no digits are lost however large n is."""
    if c == 0:
        return 0.0
    if n - c < k:
        return 1.0
    p = 1.0
    for j in range(k):
        p *= (n - c - j) / (n - j)
    return 1.0 - p


def pass_at_k_col(n: Column, c: Column, k: Column) -> Column:
    """The same as a native expression of k terms."""
    n, c = n.cast("double"), c.cast("double")
    product = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(1.0),
                          lambda acc, j: acc * (n - c - j) / (n - j))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - product)
