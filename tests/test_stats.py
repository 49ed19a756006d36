import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanscope.functions import distributions as D
from loanscope.operators import stats

# Completed / defaulted loans per grade from the reference's published
# default-rate-by-grade table (used as a golden).
GRADE_COUNTS = {"A": (226315, 13775), "B": (380441, 51162), "C": (370449, 83392),
                "D": (195926, 59632), "E": (92088, 35522), "F": (31721, 14354), "G": (9139, 4550)}


def loans_from_counts(spark, counts):
    """One completed loan per row: the first `defaulted` rows of each grade default."""
    parts = []
    for g, (n, d) in counts.items():
        parts.append(spark.range(n).select(F.lit(g).alias("grade"),
                                           (F.col("id") < d).cast("int").alias("is_default")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.withColumn("is_completed", F.lit(1))


def test_chi_square_golden(spark):
    s = loans_from_counts(spark, GRADE_COUNTS)
    r = stats.chi_square_test(s).first()
    assert r.dof == 6 and r.n == 1306079
    assert r.chi2 == pytest.approx(89642.097, abs=1e-3)
    assert r.cramers_v == pytest.approx(0.261982, abs=1e-6)
    assert r.p_value == 0.0


def test_default_rates_and_good_grades_golden(spark):
    s = loans_from_counts(spark, GRADE_COUNTS)
    g = {r.grade: r for r in stats.good_grades(s).collect()}
    assert round(g["A"].default_rate_pct, 2) == 6.09
    assert round(g["D"].default_rate_pct, 2) == 30.44
    assert round(g["G"].default_rate_pct, 2) == 49.79
    assert sorted(k for k, r in g.items() if r.is_good) == ["A", "B", "C", "D"]
    assert g["A"].median_default_rate == pytest.approx(g["D"].default_rate_pct)


def test_chi_square_yates_2x2(spark):
    counts = {"A": (30, 10), "B": (20, 12)}
    s = loans_from_counts(spark, counts)
    r = stats.chi_square(s).first()
    obs = np.array([[20, 10], [8, 12]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    want = (((np.abs(obs - e) - 0.5) ** 2) / e).sum()
    assert r.dof == 1 and r.chi2 == pytest.approx(want, rel=1e-12)


def test_t_and_chi2_tails():
    assert D.t_two_sided_p(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert D.t_two_sided_p(-2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert D.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert D.chi2_sf(2.0, 4) == pytest.approx(2 * math.exp(-1), rel=1e-12)
    assert D.power_constant() == pytest.approx(15.69776, abs=1e-5)


def test_welch_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(10, 2, 50), rng.normal(11, 3, 70)
    n1, n2 = len(a), len(b)
    df = spark.createDataFrame([(float(x),) for x in a], "x double").agg(
        F.count("x").alias("n1"), F.avg("x").alias("m1"), F.var_samp("x").alias("v1")).crossJoin(
        spark.createDataFrame([(float(x),) for x in b], "x double").agg(
            F.count("x").alias("n2"), F.avg("x").alias("m2"), F.var_samp("x").alias("v2")))
    c = F.col
    t, dof, d = stats.welch_columns(c("n1"), c("m1"), c("v1"), c("n2"), c("m2"), c("v2"))
    r = df.select(t.alias("t"), dof.alias("df"), d.alias("d")).first()
    va, vb = a.var(ddof=1), b.var(ddof=1)
    t_want = (a.mean() - b.mean()) / math.sqrt(va / n1 + vb / n2)
    df_want = (va / n1 + vb / n2) ** 2 / ((va / n1) ** 2 / (n1 - 1) + (vb / n2) ** 2 / (n2 - 1))
    d_want = (a.mean() - b.mean()) / math.sqrt(((n1 - 1) * va + (n2 - 1) * vb) / (n1 + n2 - 2))
    assert r.t == pytest.approx(t_want, rel=1e-10)
    assert r.df == pytest.approx(df_want, rel=1e-10)
    assert r.d == pytest.approx(d_want, rel=1e-10)


def test_single_row_arm_gives_null_not_error(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, 1, 3.0, None)],
                               "n1 long, m1 double, v1 double, n2 long, m2 double, v2 double")
    c = F.col
    t, dof, d = stats.welch_columns(c("n1"), c("m1"), c("v1"), c("n2"), c("m2"), c("v2"))
    r = df.select(t.alias("t"), dof.alias("df"), d.alias("d")).first()
    assert r.t is None and r.df is None and r.d is None


def test_correlations_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = 0.5 * x + rng.normal(size=200)
    z = (rng.random(200) < 0.3).astype(int)
    s = spark.createDataFrame([(float(a), float(b), int(c), 1) for a, b, c in zip(x, y, z)],
                              "interest_rate double, annual_income double, is_default int, is_completed int")
    got = {r.pair: r for r in stats.correlations_test(s).collect()}
    r = got["interest_rate_vs_annual_income"]
    assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-10)
    assert r.n == 200
    t = r.r * math.sqrt(198 / (1 - r.r ** 2))
    assert r.p_value == pytest.approx(D.t_two_sided_p(t, 198), rel=1e-9)


def test_t_tail_against_closed_forms_and_the_normal_limit():
    for t in (0.01, 0.5, 1.96, 7.0):
        assert D.t_two_sided_p(t, 1) == pytest.approx(2 / math.pi * math.atan2(1, t), rel=1e-11)
        w = t / math.sqrt(2 + t * t)
        assert D.t_two_sided_p(t, 2) == pytest.approx(2 / (2 + t * t) / (1 + w), rel=1e-11)
        # First order of the expansion in 1/df around the normal tail.
        for df in (1e8, 1e10, 1e12):
            density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            near = math.erfc(t / math.sqrt(2)) + density * (t ** 3 + t) / (2 * df)
            assert D.t_two_sided_p(t, df) == pytest.approx(near, rel=1e-9)


def test_chi_square_tail_odd_and_even():
    assert D.chi2_sf(3.0, 3) == pytest.approx(math.erfc(math.sqrt(1.5)) + math.sqrt(6 / math.pi) * math.exp(-1.5), rel=1e-12)
    assert D.chi2_sf(5.0, 6) == pytest.approx(math.exp(-2.5) * (1 + 2.5 + 2.5 ** 2 / 2), rel=1e-12)


# Fixed values of the published cohort, margin and sensitivity tables (some rows).
COHORTS = {2007: (599, 599, 158, 26.38, 100.0), 2008: (2393, 2393, 496, 20.73, 100.0), 2009: (5281, 5281, 723, 13.69, 100.0)}
MARGINS = {"A": (268616545, 110796607, 157819938), "B": (655996068, 442283009, 213713059), "C": (903631433, 857964678, 45666755)}
SENSITIVITY = {"High Risk / Low Value": (123264, 186692021, 188632066, -1940045, -39666459, 35786368),
               "Low Risk / High Value": (212897, 550986070, 342717123, 208268947, 139725523, 276812372),
               "Low Risk / Low Value": (393859, 373626543, 210362493, 163264050, 121191551, 205336548)}


def test_cohort_golden(spark):
    from loanscope.operators import export
    parts = [spark.range(n).select(F.lit(y).alias("issue_year"), F.lit(1).alias("is_completed"), (F.col("id") < d).cast("int").alias("is_default"))
             for y, (n, _, d, _, _) in COHORTS.items()]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {r.issue_year: (r.total_loans_in_cohort, r.completed_loans, r.defaults, r.default_rate_pct_of_completed, r.pct_of_cohort_completed)
           for r in export.cohort_analysis(df).collect()}
    assert got == COHORTS


def _sums(spark, key, rows):
    """Two loans of each group: one that paid the interest, one that lost the principal."""
    out = [(g, 1, d, i * (1 - d), float(lost * d), 0.0) for g, (i, lost) in rows.items() for d in (0, 1)]
    return spark.createDataFrame([(g, c, d, float(i), a, p) for g, c, d, i, a, p in out],
                                 f"{key} string, is_completed int, is_default int, interest_received double, loan_amount double, principal_received double")


def _decimal(df):
    return df.select(*[F.col(c).cast("decimal(18,2)").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_margin_and_sensitivity_golden(spark):
    from loanscope.operators import export, segments
    got = {r.grade: tuple(r)[1:] for r in export.realized_margin_by_grade(_decimal(_sums(spark, "grade", {g: v[:2] for g, v in MARGINS.items()}))).collect()}
    assert got == MARGINS
    sens = segments.segment_sensitivity(_decimal(_sums(spark, "segment", {g: v[1:3] for g, v in SENSITIVITY.items()})))
    for r in sens.collect():
        want = SENSITIVITY[r.segment]
        # The published sums are rounded to units, so a scenario may be off by one.
        assert [abs(a - b) <= 1 for a, b in zip(tuple(r)[2:], want[1:])] == [True] * 5
    robust = {r.segment: r.robust for r in segments.segment_robustness(sens).collect()}
    assert robust == {"High Risk / Low Value": False, "Low Risk / High Value": True, "Low Risk / Low Value": True}
