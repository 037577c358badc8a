"""Binary search in constant arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(cuts: Column, n: int, value: Column, equal: bool = False) -> Column:
    """How many of ``n`` ascending cuts, a constant array, are smaller than a value, or equal to it."""
    if not n:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
    goes = lambda at: F.coalesce(F.get(cuts, at - 1) <= value if equal else F.get(cuts, at - 1) < value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(goes(at + step), at + step).otherwise(at))
