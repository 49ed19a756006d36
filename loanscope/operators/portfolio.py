"""The ten portfolio questions (Q1..Q10) plus grade risk helpers (AG-1, AG-2).

All are grouped aggregates over ``loans_scored``.  Grouping keys have few
values (grade, purpose, year, term), so every query is a partial aggregate
per task followed by a tiny shuffle; sums of money stay DECIMAL (exact and
order-independent) and become DOUBLE only in the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_rows, mean_double, money, pct, sum_long, when_flag
from ..schema import OK_SAMPLE_LABEL, SMALL_SAMPLE_LABEL, SMALL_SAMPLE_N
from . import ranking


def _completed():
    return F.col("is_completed") == 1


def q01_default_rate_by_grade(s: DataFrame) -> DataFrame:
    return (s.where(_completed()).groupBy("grade")
             .agg(count_rows().alias("completed_loans"),
                  sum_long(F.col("is_default")).alias("defaulted_loans"))
             .withColumn("default_rate_pct", pct(F.col("defaulted_loans"), F.col("completed_loans")))
             .orderBy("grade"))


def q02_grade_purpose(s: DataFrame, small_n: int = SMALL_SAMPLE_N) -> DataFrame:
    return (s.groupBy("grade", "purpose")
             .agg(count_rows().alias("n_loans"),
                  F.round(F.avg("interest_rate"), 2).alias("avg_interest_rate"),
                  F.sum("is_default").alias("_d"), F.sum("is_completed").alias("_c"))
             .select("grade", "purpose", "n_loans", "avg_interest_rate",
                     pct(F.col("_d"), F.col("_c")).alias("default_rate_pct"),
                     F.when(F.col("n_loans") < small_n, F.lit(SMALL_SAMPLE_LABEL))
                      .otherwise(F.lit(OK_SAMPLE_LABEL)).alias("sample_flag"))
             .orderBy("grade", "purpose"))


def purpose_default_rates(s: DataFrame) -> DataFrame:
    return (s.where(_completed()).groupBy("purpose")
             .agg(count_rows().alias("completed_loans"),
                  sum_long(F.col("is_default")).alias("defaults"))
             .withColumn("default_rate_pct", pct(F.col("defaults"), F.col("completed_loans"))))


def q03_riskiest_purposes(s: DataFrame, top: int = 10) -> DataFrame:
    ranked = ranking.competition_rank_desc(purpose_default_rates(s), "default_rate_pct", "risk_rank")
    return ranked.orderBy("risk_rank", "purpose").limit(top)


def q04_revenue_at_risk(s: DataFrame) -> DataFrame:
    amt = F.col("loan_amount")
    at_risk = F.sum(when_flag("is_default", amt))
    return (s.where(_completed()).groupBy("grade")
             .agg(money(F.sum(amt)).alias("total_originated"),
                  money(at_risk).alias("revenue_at_risk_principal"),
                  money(F.sum(when_flag("is_default", F.col("post_default_recoveries")))).alias("recovered_after_default"),
                  pct(at_risk, F.sum(amt)).alias("pct_of_book_at_risk"))
             .orderBy("grade"))


def grade_default_rates(s: DataFrame, rounded: bool = True) -> DataFrame:
    """AG-1: default % per grade over completed loans (rounded to 2 for Q5)."""
    return (s.where(_completed()).groupBy("grade")
             .agg(pct(F.sum("is_default"), F.sum("is_completed"), 2 if rounded else None)
                  .alias("grade_default_rate")))


def good_grades_upper_median(s: DataFrame) -> DataFrame:
    """Grades whose rounded default % is <= the upper-middle grade's (Q5)."""
    gq = grade_default_rates(s, rounded=True)
    median_val = ranking.upper_median(gq, "grade_default_rate").scalar()
    return gq.where(F.col("grade_default_rate") <= median_val)


def q05_underpriced_low_risk(s: DataFrame, top: int = 20) -> DataFrame:
    """Good-grade loans in the upper half by income overall and by rate in grade,
    the highest rates first.  Both percentiles come from frequency tables of the
    loans themselves; a percentile of a half or more means a value at or above a
    threshold, so the loans are filtered by one income and a rate per grade (rows
    of group size) and only the ``top`` left look their percentiles up."""
    base = s.select("loan_id", "grade", "purpose", "loan_amount", "interest_rate", "annual_income")
    rate = ranking.percent_ranks(base, "interest_rate", "_rate_pr", keys=["grade"])
    income = ranking.percent_ranks(base, "annual_income", "_inc_pr")
    good = good_grades_upper_median(s).select("grade")
    least_income = income.where(F.col("_inc_pr") >= 0.5).agg(F.min("annual_income")).scalar()
    # The rate percentiles at or above a half of good grades, highest first: as
    # many loans as these values have are enough for the top, whatever ties.
    rates = rate.join(good, "grade", "left_semi").where(F.col("_rate_pr") >= 0.5)
    floors = rates.groupBy("grade").agg(F.min("interest_rate").alias("_floor"))
    rich = base.where(F.col("annual_income") >= least_income)
    picked = (rich.join(ranking.lookup(floors), "grade").where(F.col("interest_rate") >= F.col("_floor")).drop("_floor")
                  .join(rates, ["grade", "interest_rate"]))
    top_rows = picked.orderBy(F.col("_rate_pr").desc(), F.col("loan_id")).limit(top).join(income, "annual_income")
    top_rows = top_rows.orderBy(F.col("_rate_pr").desc(), F.col("loan_id"))
    return top_rows.select(
        "grade", "purpose",
        F.col("loan_amount").cast("double").alias("loan_amount"),
        "interest_rate",
        F.col("annual_income").cast("double").alias("annual_income"),
        F.round("_rate_pr", 3).alias("rate_percentile_in_grade"),
        F.round("_inc_pr", 3).alias("income_percentile_overall"))


def q06_cohorts(s: DataFrame) -> DataFrame:
    return (s.groupBy(F.col("issue_year").cast("bigint").alias("issue_year"))
             .agg(count_rows().alias("total_loans_in_cohort"),
                  sum_long(F.col("is_completed")).alias("completed_loans"),
                  sum_long(F.col("is_default")).alias("defaults"))
             .withColumn("default_rate_pct_of_completed", pct(F.col("defaults"), F.col("completed_loans")))
             .withColumn("pct_of_cohort_completed", pct(F.col("completed_loans"), F.col("total_loans_in_cohort")))
             .orderBy("issue_year"))


def q07_rate_dispersion(s: DataFrame) -> DataFrame:
    r = F.col("interest_rate")
    return (s.groupBy("grade")
             .agg(count_rows().alias("n_loans"),
                  F.round(F.avg(r), 2).alias("avg_rate"),
                  F.round(F.min(r), 2).alias("min_rate"),
                  F.round(F.max(r), 2).alias("max_rate"),
                  F.round(F.stddev_pop(r), 2).alias("stddev_rate"))
             .orderBy("grade"))


def q08_grade_income_quartile(s: DataFrame, k: int = 4) -> DataFrame:
    base = s.where(_completed()).select("loan_id", "grade", "annual_income", "is_default")
    binned = ranking.ntile(base, "annual_income", k, "income_quartile")
    return (binned.groupBy("grade", "income_quartile")
                  .agg(count_rows().alias("n_loans"),
                       F.round(mean_double(F.col("annual_income")), 0).alias("avg_income_in_bucket"),
                       pct(F.sum("is_default"), count_rows()).alias("default_rate_pct"))
                  .orderBy("grade", "income_quartile"))


def q09_purpose_term_lowest_risk(s: DataFrame, top: int = 15) -> DataFrame:
    return (s.groupBy("purpose", F.col("term_months").cast("bigint").alias("term_months"))
             .agg(count_rows().alias("n_loans"),
                  F.round(F.avg("interest_rate"), 2).alias("avg_rate"),
                  F.sum("is_default").alias("_d"), F.sum("is_completed").alias("_c"))
             .where(F.col("_c") > 0)
             .withColumn("default_rate_pct", pct(F.col("_d"), F.col("_c")))
             .orderBy(F.col("default_rate_pct").asc_nulls_first(), "purpose", "term_months")
             .limit(top).drop("_d", "_c"))


def unrecovered_loss() -> F.Column:
    """PRJ-18: principal not repaid on a defaulted loan (recoveries not netted)."""
    return when_flag("is_default", F.col("loan_amount") - F.col("principal_received"))


def q10_realized_margin(s: DataFrame) -> DataFrame:
    interest = F.sum("interest_received")
    loss = F.sum(unrecovered_loss())
    return (s.where(_completed()).groupBy("grade")
             .agg(money(interest).alias("interest_actually_collected"),
                  money(loss).alias("unrecovered_principal_loss"),
                  money(interest - loss).alias("realized_margin"))
             .orderBy("grade"))
