"""Column-level parsing of raw loan text (no UDFs: all JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTH_ABBREVIATIONS, POLICY_PREFIX


def percent_text_to_double(c: Column) -> Column:
    """'13.5%' or '13.5' -> 13.5; anything unparseable -> NULL (never raises)."""
    return F.replace(c.cast("string"), F.lit("%"), F.lit("")).try_cast("double")


def term_to_months(c: Column) -> Column:
    """' 36 months' -> 36; unparseable -> NULL."""
    return F.trim(F.replace(c, F.lit("months"), F.lit(""))).try_cast("int")


def strip_policy_prefix(c: Column) -> Column:
    """Remove the credit-policy prefix (literal text, not a regex)."""
    return F.replace(c, F.lit(POLICY_PREFIX), F.lit(""))


def month_year_to_date(c: Column) -> Column:
    """'Dec-2018' -> 2018-12-01.  Unknown month text or bad year -> NULL."""
    known = F.substring(c, 1, 3).isin(*MONTH_ABBREVIATIONS)
    return F.when(known, F.try_to_date(c, "MMM-yyyy"))


def is_missing(c: Column) -> Column:
    """NULL or blank-after-trim text."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def flag(pred: Column) -> Column:
    """Boolean predicate -> 1/0 INT, NULL counted as 0."""
    return F.coalesce(pred, F.lit(False)).cast("int")
