"""Hypothesis tests (ST-1..9): sufficient statistics on Spark, closed forms
on the resulting summary rows.

Every test aggregates the loans once into counts, sums and variances per
cell / arm; statistics are column arithmetic on those few rows and p-values
come from ``functions.distributions`` applied to the summary row only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_p_value, t_p_value
from ..functions.measures import count_rows
from ..schema import CORRELATION_PAIRS
from . import ranking



def _completed(s: DataFrame) -> DataFrame:
    return s.where(F.col("is_completed") == 1)


# --- contingency / chi-square ---------------------------------------------------

def contingency(s: DataFrame, row: str = "grade", col: str = "is_default",
                values: Sequence = (0, 1)) -> DataFrame:
    """ST-1: completed loans per ``row`` x ``col`` value, one column per value
    (``n_<value>``), zero-filled; rows with a NULL group or a value outside the
    list are in no cell.  One aggregate; the pivot is over a fixed value list, so
    no extra pass to discover columns."""
    known = F.col(row).isNotNull() & F.col(col).isin(*values)
    wide = (_completed(s).where(known).groupBy(row).pivot(col, list(values)).agg(count_rows())
            .na.fill(0))
    return wide.select(row, *[F.col(str(v)).alias(f"n_{v}") for v in values]).orderBy(row)


def chi_square(s: DataFrame, row: str = "grade", col: str = "is_default",
               values: Sequence = (0, 1)) -> DataFrame:
    """ST-2/3: Pearson chi-square of independence and Cramer's V.

    Expected counts come from row totals and from column totals taken with
    windows over the contingency table (one row per category, so the window
    holds categories, not loans).  Values no loan has are no column of the table:
    they add neither to the sum nor to dof.  Yates' continuity correction applies
    when dof = 1, as in SciPy; with fewer than two rows or columns nothing can be
    tested (dof 0, chi2 0, V NULL).
    """
    table = contingency(s, row, col, values)
    cells = [F.col(f"n_{v}") for v in values]
    everything = Window.partitionBy()
    table = table.select(
        *cells,
        sum(cells[1:], cells[0]).alias("_rt"),
        *[F.sum(c).over(everything).alias(f"_ct{i}") for i, c in enumerate(cells)],
        F.count(F.lit(1)).over(everything).alias("_r"))
    n = sum([F.col(f"_ct{i}") for i in range(1, len(values))], F.col("_ct0")).cast("double")
    r, k = F.col("_r"), sum([F.when(F.col(f"_ct{i}") > 0, 1).otherwise(0) for i in range(len(values))], F.lit(0))
    dof = (r - 1) * (k - 1)
    terms = []
    for i, c in enumerate(cells):
        e = F.try_divide(F.col("_rt") * F.col(f"_ct{i}"), n)
        diff = F.abs(c - e)
        yates = F.when(dof == 1, F.least(F.lit(0.5), diff)).otherwise(F.lit(0.0))
        terms.append(F.coalesce(F.try_divide(F.pow(diff - yates, 2), e), F.lit(0.0)))
    per_row = table.select(sum(terms[1:], terms[0]).alias("_x"), n.alias("_n"),
                           dof.alias("_dof"), F.least(r, k).alias("_m"))
    res = per_row.agg(F.sum("_x").alias("chi2"), F.max("_dof").alias("dof"),
                      F.max("_n").alias("n"), F.max("_m").alias("m"))
    return res.select(
        "chi2", F.col("dof").cast("bigint").alias("dof"), F.col("n").cast("bigint").alias("n"),
        F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("m") - 1))).alias("cramers_v"))


def chi_square_test(s: DataFrame, row: str = "grade", col: str = "is_default") -> DataFrame:
    res = chi_square(s, row, col)
    return res.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof")))


# --- correlations ----------------------------------------------------------------

def correlations(s: DataFrame, pairs: Sequence[tuple[str, str]] = CORRELATION_PAIRS) -> DataFrame:
    """ST-4: Pearson r for column pairs over completed loans, one pass."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ca, cb = F.col(a).cast("double"), F.col(b).cast("double")
        both = ca.isNotNull() & cb.isNotNull()
        aggs += [F.corr(ca, cb).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    one = _completed(s).agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(f"r{i}").alias("r"),
                 F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])))


def correlations_test(s: DataFrame, pairs=CORRELATION_PAIRS) -> DataFrame:
    """ST-4 with its p-value; a perfect correlation has p = 0, as in SciPy."""
    res = correlations(s, pairs)
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    exact = (F.abs("r") >= 1) & (F.col("n") > 2)
    return res.withColumn("p_value", F.when(exact, F.lit(0.0)).otherwise(t_p_value(t, F.col("n") - 2)))


# --- good grades and the under-pricing t-test --------------------------------

def grade_default_pct(s: DataFrame) -> DataFrame:
    """AG-1 (pandas form): unrounded mean default flag x 100 per grade."""
    return (_completed(s).where(F.col("grade").isNotNull()).groupBy("grade")
            .agg((F.avg("is_default") * 100).alias("default_rate_pct")))


def good_grades(s: DataFrame) -> DataFrame:
    """AG-2: grades whose default % is <= the interpolated median of the grade
    rates.  Grade-grain table with the median and a flag."""
    rates = grade_default_pct(s)
    med = rates.agg(F.median("default_rate_pct")).scalar()
    return rates.select("grade", "default_rate_pct", med.alias("median_default_rate"),
                        (F.col("default_rate_pct") <= med).alias("is_good"))


@dataclass(frozen=True)
class PricingContext:
    """Scalars one pass hands to the next (the reference's two-pass flow):
    the good grades (bounded by the grade domain), the good-grade median
    income and the measured rate gap (low-income minus high-income mean)."""
    good_grades: tuple
    income_median: float | None
    rate_gap: float | None


def _good_subset(s: DataFrame, grades) -> DataFrame:
    """PRJ-13: loans whose grade is one of the good grades."""
    return s.where(F.col("grade").isin(*grades)) if grades else s.limit(0)


def pricing_context(s: DataFrame) -> PricingContext:
    """AG-2 + ST-5 + ST-9 in three aggregate passes; only scalars return."""
    grades = tuple(sorted(r.grade for r in good_grades(s).where("is_good").select("grade").collect()))
    subset = _good_subset(s, grades)
    med = ranking.exact_quantiles(subset, "annual_income", [0.5]).first()["q0"]
    gap = None
    if med is not None:
        inc, rate = F.col("annual_income"), F.col("interest_rate")
        gap = subset.agg(F.avg(F.when(inc < med, rate)) - F.avg(F.when(inc >= med, rate))).first()[0]
    return PricingContext(grades, med, gap)


def in_good_grades(s: DataFrame, ctx: PricingContext | None = None) -> DataFrame:
    return _good_subset(s, (ctx or pricing_context(s)).good_grades)


def welch_columns(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column):
    """ST-6/7: Welch t (1 minus 2), Welch-Satterthwaite df, Cohen's d (pooled).
    Degenerate arms (one row, zero variance, empty) give NULL, never an error."""
    div = F.try_divide
    n1, n2 = n1.cast("double"), n2.cast("double")
    a, b = div(v1, n1), div(v2, n2)
    t = div(m1 - m2, F.sqrt(a + b))
    df = div(F.pow(a + b, 2), div(F.pow(a, 2), n1 - 1) + div(F.pow(b, 2), n2 - 1))
    pooled = div((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    d = div(m1 - m2, F.sqrt(pooled))
    return t, df, d


def underpriced_welch(s: DataFrame, ctx: PricingContext | None = None) -> DataFrame:
    """ST-8: good-grade loans split at the median income; Welch t of rates
    (high-income minus low-income) and Cohen's d."""
    ctx = ctx or pricing_context(s)
    subset = in_good_grades(s, ctx)
    med = F.lit(ctx.income_median).cast("double")
    inc, rate = F.col("annual_income"), F.col("interest_rate")
    hi, lo = inc >= med, inc < med
    arms = subset.agg(
        F.count_if(hi & rate.isNotNull()).alias("n1"), F.avg(F.when(hi, rate)).alias("m1"),
        F.var_samp(F.when(hi, rate)).alias("v1"),
        F.count_if(lo & rate.isNotNull()).alias("n2"), F.avg(F.when(lo, rate)).alias("m2"),
        F.var_samp(F.when(lo, rate)).alias("v2"))
    c = F.col
    t, df, d = welch_columns(c("n1"), c("m1"), c("v1"), c("n2"), c("m2"), c("v2"))
    return arms.select(
        med.alias("income_median"),
        c("n1").alias("high_income_n"), c("n2").alias("low_income_n"),
        c("m1").alias("high_income_mean_rate"), c("m2").alias("low_income_mean_rate"),
        t.alias("t_stat"), df.alias("welch_df"), d.alias("cohens_d"))


def underpriced_welch_test(s: DataFrame, ctx: PricingContext | None = None) -> DataFrame:
    res = underpriced_welch(s, ctx)
    return res.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("welch_df")))


def rate_gap(s: DataFrame, ctx: PricingContext | None = None) -> DataFrame:
    """ST-9: mean rate of low-income minus high-income good-grade loans."""
    ctx = ctx or pricing_context(s)
    med = F.lit(ctx.income_median).cast("double")
    inc, rate = F.col("annual_income"), F.col("interest_rate")
    return in_good_grades(s, ctx).agg(
        (F.avg(F.when(inc < med, rate)) - F.avg(F.when(inc >= med, rate))).alias("rate_gap"),
        F.first(med).alias("income_median"))
