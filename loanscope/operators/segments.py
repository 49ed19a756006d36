"""Risk x value segmentation and its reports (W-9, AG-3..5, AG-9, AG-10).

Scores: risk = the grade's default share among completed loans (joined back
from a grade-grain aggregate), value = amount x term.  Tiers are exact
quantile cuts (tertiles of risk, halves of value) computed from frequency
tables, never by sorting the loans in one task.  The segment frame is built
once and persisted; every report aggregates it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import count_rows, mean_double
from ..schema import (RISK_TIER_LABELS, SCENARIO_MULTIPLIERS, SEGMENT_SEPARATOR,
                      UNSCORED_LABEL, VALUE_TIER_LABELS)
from . import ranking
from .portfolio import unrecovered_loss


def grade_risk_scores(s: DataFrame) -> DataFrame:
    """AG-1: mean default flag per grade over completed loans."""
    return (s.where(F.col("is_completed") == 1).groupBy("grade")
             .agg(F.avg("is_default").alias("risk_score")))


def build_segments(s: DataFrame, with_rate_percentile: bool = True) -> DataFrame:
    """W-9: loans + risk/value scores, proxies, tiers and the segment label."""
    risk = grade_risk_scores(s)
    value_score = (F.col("loan_amount") * F.col("term_months")).cast("double")
    scored = s.join(ranking.lookup(risk), "grade", "left").withColumn("value_score", value_score)
    # Inputs for the cut edges: a score and a loan count per grade, and the value score.
    risk_src = s.groupBy("grade").agg(count_rows().alias("n")).join(risk, "grade")
    value_src = s.select(value_score.alias("value_score"))
    scored = ranking.quantile_cut(scored, "risk_score", RISK_TIER_LABELS, "risk_tier", source=risk_src, weight="n")
    scored = ranking.quantile_cut(scored, "value_score", VALUE_TIER_LABELS, "value_tier", source=value_src)
    if with_rate_percentile:
        scored = scored.withColumn(
            "rate_sensitivity_proxy",
            F.try_divide(F.col("annual_income").cast("double"), F.col("loan_amount").cast("double")))
        scored = ranking.average_rank_pct(scored, "interest_rate", "rate_percentile_in_grade", keys=["grade"])
    return scored.withColumn("segment", F.concat_ws(
        SEGMENT_SEPARATOR,
        F.coalesce(F.col("risk_tier"), F.lit(UNSCORED_LABEL)),
        F.coalesce(F.col("value_tier"), F.lit(UNSCORED_LABEL))))


def _completed(seg: DataFrame) -> DataFrame:
    return seg.where(F.col("is_completed") == 1)


def segment_summary(seg: DataFrame) -> DataFrame:
    """AG-3..5: all-loan profile left-joined with completed-loan outcomes,
    rounded half-to-even to 2 places."""
    profile = seg.groupBy("segment").agg(
        count_rows().alias("n_loans"),
        F.sum("loan_amount").alias("total_loan_value"),
        F.avg("interest_rate").alias("avg_interest_rate"),
        mean_double(F.col("annual_income")).alias("avg_annual_income"),
        F.avg("rate_sensitivity_proxy").alias("avg_rate_sensitivity_proxy"),
        F.avg("rate_percentile_in_grade").alias("avg_rate_percentile_in_grade"))
    outcome = _completed(seg).groupBy("segment").agg(
        (F.avg("is_default") * 100).alias("default_rate_pct"),
        F.sum(F.col("interest_received") - unrecovered_loss()).alias("realized_margin"))
    joined = profile.join(outcome, "segment", "left")
    return joined.select(
        "segment", "n_loans",
        F.bround("total_loan_value", 2).cast("double").alias("total_loan_value"),
        *[F.bround(c, 2).alias(c) for c in ("avg_interest_rate", "avg_annual_income",
                                            "avg_rate_sensitivity_proxy",
                                            "avg_rate_percentile_in_grade", "default_rate_pct")],
        F.bround("realized_margin", 2).cast("double").alias("realized_margin"),
    ).orderBy("segment")


def segment_sensitivity(seg: DataFrame) -> DataFrame:
    """AG-9: completed loans per segment; margin under +-20% loss scenarios,
    rounded half-to-even to whole units (scenario factors as exact decimals)."""
    g = _completed(seg).groupBy("segment").agg(
        count_rows().alias("n_loans"),
        F.sum("interest_received").alias("i"),
        F.sum(unrecovered_loss()).alias("l"))
    cols = [F.col("segment"), F.col("n_loans"),
            F.bround("i", 0).cast("double").alias("interest_actually_collected"),
            F.bround("l", 0).cast("double").alias("unrecovered_principal_loss"),
            F.bround(F.col("i") - F.col("l"), 0).cast("double").alias("realized_margin")]
    for name, mult in SCENARIO_MULTIPLIERS.items():
        factor = F.lit(Decimal(str(mult)))
        cols.append(F.bround(F.col("i") - F.col("l") * factor, 0).cast("double").alias(name))
    return g.select(*cols).orderBy("segment")


def segment_robustness(sens: DataFrame) -> DataFrame:
    """AG-10: a segment is robust when no scenario flips the margin's sign."""
    base = F.signum("realized_margin")
    same = F.lit(True)
    for name in SCENARIO_MULTIPLIERS:
        same = same & (F.signum(name) == base)
    return sens.select("segment", "realized_margin", *SCENARIO_MULTIPLIERS.keys(),
                       same.alias("robust"))


def segment_assignments(seg: DataFrame) -> DataFrame:
    """Loan-grain view of the segment builder's output."""
    return seg.select("loan_id", "grade", "risk_score", "value_score", "rate_sensitivity_proxy",
                      "rate_percentile_in_grade", "risk_tier", "value_tier", "segment")
