"""Rounding and fixed-point helpers.

Sums of doubles depend on the order in which tasks finish, so everything that
is added up across rows is first put on a decimal grid: a retried task then
cannot change a total.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Round to six decimals by one IEEE recipe (floor), null-safe."""
    return F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def micros(x: Column) -> Column:
    """x in millionths as a bigint: the exact carrier for distributed sums."""
    return F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, null when den is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
