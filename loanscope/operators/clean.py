"""Build the clean ``loans`` table and the scored view (W-1, PRJ-1..9).

De-duplication keeps the first-ingested record per 11-column raw key.  It is
expressed as ``row_number() == 1`` over the key, which Spark plans with a
partial ``WindowGroupLimit`` *before* the shuffle: a key repeated millions of
times is cut to one row per map task, so a hot duplicate key cannot skew the
exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import (flag, month_year_to_date, percent_text_to_double,
                               strip_policy_prefix, term_to_months)
from ..schema import COMPLETED_STATUSES, DEDUP_KEYS, DEFAULT_STATUSES


def positive_income(raw: DataFrame, income_col: str = "annual_inc") -> DataFrame:
    """PRJ-6: drop non-positive and NULL incomes (applied before de-dup)."""
    return raw.where(F.col(income_col) > 0)


def dedup_first(raw: DataFrame, keys=None, order_col: str = "loan_id") -> DataFrame:
    """W-1: one row per key, the smallest ``order_col`` (ingest order) wins.  The
    key is ``raw_key``, the digest of the values as read, where ingest made one,
    else the key columns."""
    keys = keys or (("raw_key",) if "raw_key" in raw.columns else DEDUP_KEYS)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).asc_nulls_first())
    return (raw.withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") == 1).drop("_rn"))


def normalise(deduped: DataFrame) -> DataFrame:
    """PRJ-1..5: rename and parse raw text into typed clean columns."""
    return deduped.select(
        F.col("loan_id"),
        F.col("loan_amnt").alias("loan_amount"),
        percent_text_to_double(F.col("int_rate")).alias("interest_rate"),
        F.col("grade"),
        F.col("annual_inc").alias("annual_income"),
        F.col("purpose"),
        term_to_months(F.col("term")).alias("term_months"),
        strip_policy_prefix(F.col("loan_status")).alias("loan_status"),
        month_year_to_date(F.col("issue_d")).alias("issue_date"),
        F.col("total_pymnt").alias("total_payment_received"),
        F.col("total_rec_prncp").alias("principal_received"),
        F.col("total_rec_int").alias("interest_received"),
        F.col("recoveries").alias("post_default_recoveries"),
    )


def build_clean(raw: DataFrame) -> DataFrame:
    """SRC-5: raw -> filter -> dedup -> normalise (the ``loans`` table)."""
    return normalise(dedup_first(positive_income(raw)))


def score(loans: DataFrame) -> DataFrame:
    """PRJ-7..9: completed / default flags and issue year (``loans_scored``)."""
    status = F.col("loan_status")
    return loans.select(
        "*",
        flag(status.isin(*COMPLETED_STATUSES)).alias("is_completed"),
        flag(status.isin(*DEFAULT_STATUSES)).alias("is_default"),
        F.year("issue_date").alias("issue_year"),
    )
