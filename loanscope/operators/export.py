"""Dashboard export forms (AG-6..8) and CSV sinks (SRC-8).

The exports round half-to-even, as the reference's pandas ``.round`` does, and
drop NULL group keys as pandas' ``groupby`` does; the SQL questions (Q1, Q6,
Q10) round half-away-from-zero and keep a NULL group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_rows, sum_long
from .portfolio import unrecovered_loss


def _ratio_pct_even(num: str, den: str) -> F.Column:
    return F.bround(F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")) * 100, 2)


def default_rate_by_grade(s: DataFrame) -> DataFrame:
    """AG-6."""
    g = (s.where((F.col("is_completed") == 1) & F.col("grade").isNotNull()).groupBy("grade")
          .agg(count_rows().alias("completed_loans"),
               sum_long(F.col("is_default")).alias("defaulted_loans")))
    return g.withColumn("default_rate_pct", _ratio_pct_even("defaulted_loans", "completed_loans")).orderBy("grade")


def cohort_analysis(s: DataFrame) -> DataFrame:
    """AG-7."""
    g = (s.groupBy(F.col("issue_year").cast("bigint").alias("issue_year"))
          .agg(count_rows().alias("total_loans_in_cohort"),
               sum_long(F.col("is_completed")).alias("completed_loans"),
               sum_long(F.col("is_default")).alias("defaults")))
    return (g.withColumn("default_rate_pct_of_completed", _ratio_pct_even("defaults", "completed_loans"))
             .withColumn("pct_of_cohort_completed", _ratio_pct_even("completed_loans", "total_loans_in_cohort"))
             .where(F.col("issue_year").isNotNull())
             .orderBy("issue_year"))


def realized_margin_by_grade(s: DataFrame) -> DataFrame:
    """AG-8: sums, margin after subtraction, each rounded half-even to units."""
    g = (s.where((F.col("is_completed") == 1) & F.col("grade").isNotNull()).groupBy("grade")
          .agg(F.sum("interest_received").alias("i"), F.sum(unrecovered_loss()).alias("l")))
    return g.select(
        "grade",
        F.bround("i", 0).cast("double").alias("interest_actually_collected"),
        F.bround("l", 0).cast("double").alias("unrecovered_principal_loss"),
        F.bround(F.col("i") - F.col("l"), 0).cast("double").alias("realized_margin"),
    ).orderBy("grade")


def write_csv(summary: DataFrame, path: str, key: str) -> None:
    """SRC-8: write a *summary-grain* frame as one headed CSV, key first.

    Only for small reports (one row per grade/segment/year); loan-grain data
    is written as Parquet instead.
    """
    cols = [key] + [c for c in summary.columns if c != key]
    (summary.select(*cols).orderBy(key).coalesce(1)
            .write.mode("overwrite").option("header", True).csv(path))
