"""Aggregate and arithmetic building blocks with SQL-exact semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(num: Column, den: Column, digits: int | None = 2) -> Column:
    """100 * num / den as DOUBLE, NULL when den is 0 or NULL (PRJ-19)."""
    v = F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))
    return F.round(v, digits) if digits is not None else v


def count_rows() -> Column:
    return F.count(F.lit(1))


def sum_long(c: Column) -> Column:
    return F.sum(c).cast("bigint")


def mean_double(c: Column) -> Column:
    """Mean as exact-sum / count: identical in any engine for DECIMAL input."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def money(c: Column, digits: int = 0, half_even: bool = False) -> Column:
    """Round a (DECIMAL) money amount and hand it out as DOUBLE."""
    r = F.bround(c, digits) if half_even else F.round(c, digits)
    return r.cast("double")


def when_flag(flag_col: str, value: Column) -> Column:
    """CASE WHEN flag = 1 THEN value ELSE 0 END (PRJ-11)."""
    return F.when(F.col(flag_col) == 1, value).otherwise(F.lit(0))
