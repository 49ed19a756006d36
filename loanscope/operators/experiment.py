"""Pricing experiment: target, arms, simulated revenue, comparison, power,
duration and portfolio lift (AB-1..7).

Scalars that one pass hands to the next (good grades, median income,
measured rate gap) are computed once as a ``PricingContext`` - a handful of
numbers, like a fitted model's parameters - and enter later plans as
literals; no loan-grain data reaches the driver.  Arms come from a hash of (seed, loan_id): independent
of row order and partitioning, so a retried task reassigns identically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import power_constant, t_p_value
from ..functions.measures import count_rows
from ..schema import RANDOM_SEED
from . import stats


def arm_of(loan_id: Column, seed: int = RANDOM_SEED) -> Column:
    """AB-2: 'treatment' when the first 32 bits of md5('<seed>|<id>') are odd."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), loan_id.cast("string"))), 1, 8), 16, 10)
    return F.when(h.cast("bigint") % 2 == 1, F.lit("treatment")).otherwise(F.lit("control"))


def target_population(s: DataFrame, ctx: stats.PricingContext | None = None) -> DataFrame:
    """AB-1: loans in good grades with income >= the good-grade median."""
    ctx = ctx or stats.pricing_context(s)
    med = F.lit(ctx.income_median).cast("double")
    return stats.in_good_grades(s, ctx).where(F.col("annual_income") >= med)


def simulate(s: DataFrame, ctx: stats.PricingContext | None = None, seed: int = RANDOM_SEED) -> DataFrame:
    """AB-2/3: arm per loan, treatment rate + measured gap, simple-interest
    revenue = amount x rate/100 x term/12."""
    ctx = ctx or stats.pricing_context(s)
    gap = F.lit(ctx.rate_gap).cast("double")
    target = target_population(s, ctx)
    arm = arm_of(F.col("loan_id"), seed)
    applied = F.when(F.col("arm") == "treatment", F.col("interest_rate") + F.col("_gap")).otherwise(F.col("interest_rate"))
    revenue = (F.col("loan_amount").cast("double") * (F.col("applied_rate") / 100.0)
               * (F.col("term_months") / 12.0))
    return (target.withColumn("arm", arm).withColumn("_gap", gap)
                  .withColumn("applied_rate", applied)
                  .withColumn("simulated_interest_revenue", revenue).drop("_gap"))


def assignments(sim: DataFrame) -> DataFrame:
    return sim.select("loan_id", "grade", "arm", "interest_rate", "applied_rate",
                      "simulated_interest_revenue")


def compare_arms(sim: DataFrame) -> DataFrame:
    """AB-4: one row: arm sizes and means, lift per loan, Welch t
    (treatment minus control), df and Cohen's d."""
    rev = F.col("simulated_interest_revenue")
    tr, ct = F.col("arm") == "treatment", F.col("arm") == "control"
    one = sim.agg(
        F.count_if(tr).alias("treatment_n"), F.avg(F.when(tr, rev)).alias("treatment_mean"),
        F.var_samp(F.when(tr, rev)).alias("_vt"),
        F.count_if(ct).alias("control_n"), F.avg(F.when(ct, rev)).alias("control_mean"),
        F.var_samp(F.when(ct, rev)).alias("_vc"))
    c = F.col
    t, df, d = stats.welch_columns(c("treatment_n"), c("treatment_mean"), c("_vt"),
                                   c("control_n"), c("control_mean"), c("_vc"))
    return one.select("control_n", "treatment_n", "control_mean", "treatment_mean",
                      (c("treatment_mean") - c("control_mean")).alias("lift_per_loan"),
                      t.alias("t_stat"), df.alias("welch_df"), d.alias("cohens_d"))


def compare_arms_test(sim: DataFrame) -> DataFrame:
    res = compare_arms(sim)
    return res.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("welch_df")))


def power(comparison: DataFrame, alpha: float = 0.05, power_: float = 0.80) -> DataFrame:
    """AB-5: required n per arm = 2 (z_{1-a/2} + z_power)^2 / d^2 (NULL when d = 0)."""
    k = F.lit(power_constant(alpha, power_))
    d = F.col("cohens_d")
    return comparison.select(
        "cohens_d",
        F.try_divide(k, d * d).alias("required_n_per_arm"),
        F.least("control_n", "treatment_n").alias("available_per_arm"))


def duration(s: DataFrame, comparison: DataFrame, ctx: stats.PricingContext | None = None,
             run_rate_year: int | None = None, alpha: float = 0.05,
             power_: float = 0.80) -> DataFrame:
    """AB-6: months to enrol 2 x required n at the target's share of a recent
    year's monthly volume.  ``run_rate_year`` defaults to the year before the
    latest issue year (the reference uses its last full year).  The loans are
    read once: counts per issue year give every volume."""
    ctx = ctx or stats.pricing_context(s)
    aimed = F.col("grade").isin(*ctx.good_grades) & (F.col("annual_income") >= F.lit(ctx.income_median))
    years = s.groupBy("issue_year").agg(count_rows().alias("n"), F.count_if(aimed).alias("aimed"))
    year = F.lit(run_rate_year).cast("bigint") if run_rate_year is not None else F.col("last") - 1
    one = years.agg(F.sum("n").alias("total"), F.sum("aimed").alias("target"), F.max("issue_year").cast("bigint").alias("last"),
                    F.map_from_entries(F.collect_list(F.when(F.col("issue_year").isNotNull(), F.struct(
                        F.col("issue_year").cast("bigint"), "n")))).alias("volume"))  # a row per year
    one = one.select(year.alias("year"), (F.col("target").cast("double") / F.col("total").cast("double")).alias("share"),
                     F.coalesce(F.try_element_at("volume", year), F.lit(0)).alias("in_year"),
                     comparison.select("cohens_d").scalar().alias("d"))
    req = F.try_divide(F.lit(power_constant(alpha, power_)), F.col("d") * F.col("d"))
    monthly_target = F.col("in_year").cast("double") / 12.0 * F.col("share")
    return one.select(
        F.col("share").alias("target_share"), F.col("year").alias("run_rate_year"), F.col("in_year").alias("run_rate_year_volume"),
        monthly_target.alias("monthly_target_volume"), F.try_divide(2 * req, monthly_target).alias("months_needed"))


def portfolio_lift(s: DataFrame, ctx: stats.PricingContext | None = None) -> DataFrame:
    """AB-7: lift if the measured gap were charged on the whole target:
    sum of amount x gap/100 x term/12."""
    ctx = ctx or stats.pricing_context(s)
    gap = F.lit(ctx.rate_gap).cast("double")
    target = target_population(s, ctx)
    lift = F.col("loan_amount").cast("double") * (F.col("_gap") / 100.0) * (F.col("term_months") / 12.0)
    target = target.withColumn("_gap", gap).withColumn("_lift", lift)
    return target.agg(count_rows().alias("target_loans"), F.sum("_lift").alias("total_lift"),
                      F.avg("_lift").alias("lift_per_loan"))


def power_by_segment(sim: DataFrame, alpha: float = 0.05, power_: float = 0.80) -> DataFrame:
    """AB-5 per segment: within each risk x value segment of the target,
    the simulated arm comparison's Cohen's d and the n per arm a live test
    would need.  ``sim`` is a simulation run over the segmented loans, so the
    segment label travels with each loan: one aggregate, no join."""
    rev = F.col("simulated_interest_revenue")
    tr, ct = F.col("arm") == "treatment", F.col("arm") == "control"
    cells = (sim.groupBy("segment").agg(
                    F.count_if(tr).alias("treatment_n"), F.avg(F.when(tr, rev)).alias("_mt"),
                    F.var_samp(F.when(tr, rev)).alias("_vt"),
                    F.count_if(ct).alias("control_n"), F.avg(F.when(ct, rev)).alias("_mc"),
                    F.var_samp(F.when(ct, rev)).alias("_vc")))
    c = F.col
    _, _, d = stats.welch_columns(c("treatment_n"), c("_mt"), c("_vt"), c("control_n"), c("_mc"), c("_vc"))
    k = F.lit(power_constant(alpha, power_))
    return cells.select(
        "segment", "control_n", "treatment_n",
        (c("_mt") - c("_mc")).alias("lift_per_loan"),
        d.alias("cohens_d"),
        F.try_divide(k, d * d).alias("required_n_per_arm"),
        F.least("control_n", "treatment_n").alias("available_per_arm")).orderBy("segment")
