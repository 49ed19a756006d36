"""Hand-built edge frames: NULL keys, a grade without completed loans."""

from decimal import Decimal

import pytest

from loanscope.operators import export, model, portfolio, quality, segments, stats

COLS = ("loan_id long, grade string, purpose string, loan_amount decimal(18,2), interest_rate double, "
        "annual_income decimal(18,2), term_months int, is_completed int, is_default int, issue_year int, "
        "interest_received decimal(18,2), principal_received decimal(18,2), post_default_recoveries decimal(18,2)")


def _loan(i, grade, completed, default, rate=10.0, amount="1000.00", year=2017):
    return (i, grade, "car", Decimal(amount), rate, Decimal("50000.00") + i, 36, completed, default, year,
            Decimal("100.00"), Decimal("500.00") if default else Decimal(amount), Decimal("0.00"))


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    i = 0
    for grade, n_done, n_def in (("A", 40, 2), ("B", 40, 8), ("C", 40, 20)):
        for j in range(n_done):
            i += 1
            rows.append(_loan(i, grade, 1, int(j < n_def), rate=5.0 + ord(grade) - 65 + j % 3,
                              amount=str(1000 + 25 * (j % 9)) + ".00"))
    for j in range(5):  # grade with no completed loans
        i += 1
        rows.append(_loan(i, "G", 0, 0, rate=30.0))
    for j in range(3):  # NULL grade, completed
        i += 1
        rows.append(_loan(i, None, 1, 1, year=2018))
    return spark.createDataFrame(rows, COLS)


def test_zero_completed_group_gives_null_rate(scored):
    q2 = {r.grade: r for r in portfolio.q02_grade_purpose(scored).collect()}
    assert q2["G"].default_rate_pct is None and q2["G"].sample_flag == "low-confidence (n<30)"
    assert q2["A"].sample_flag == "ok"


def test_sql_form_keeps_null_group_export_drops_it(scored):
    q1 = {r.grade for r in portfolio.q01_default_rate_by_grade(scored).collect()}
    ex = {r.grade for r in export.default_rate_by_grade(scored).collect()}
    assert None in q1 and None not in ex and ex == {"A", "B", "C"}
    assert None not in {r.grade for r in export.realized_margin_by_grade(scored).collect()}


def test_unscored_segment_for_grade_without_completed_loans(scored):
    seg = segments.build_segments(scored)
    by_grade = {r.grade: r.segment for r in seg.select("grade", "segment").distinct().collect()
                if r.grade in ("G", None)}
    assert by_grade["G"].startswith("Unscored / ")
    assert by_grade[None].startswith("Unscored / ")
    tiers = {r.grade: r.risk_tier for r in seg.select("grade", "risk_tier").distinct().collect()}
    assert tiers["A"] == "Low Risk" and tiers["C"] == "High Risk"


# ---- NULL and degenerate input, against pandas where it defines the result ----

def test_contingency_drops_null_groups_like_crosstab(spark):
    import pandas as pd
    rows = [("A", 0)] * 30 + [("A", 1)] * 10 + [("B", 0)] * 25 + [("B", 1)] * 20 + [(None, 1)] * 40
    df = spark.createDataFrame([(g, d, 1) for g, d in rows], "grade string, is_default int, is_completed int")
    want = pd.crosstab(*pd.DataFrame(rows, columns=["grade", "is_default"]).T.values)
    assert [tuple(r) for r in stats.contingency(df).collect()] == [(g, *want.loc[g]) for g in want.index]
    assert stats.chi_square(df).first().dof == 1


def test_chi_square_without_one_outcome(spark):
    df = spark.createDataFrame([("A", 0, 1)] * 5 + [("B", 0, 1)] * 7, "grade string, is_default int, is_completed int")
    r = stats.chi_square(df).first()
    assert (r.chi2, r.dof, r.cramers_v) == (0.0, 0, None)


def test_perfect_correlation_has_p_zero(spark):
    df = spark.createDataFrame([(float(i), -2.0 * i, 1) for i in range(9)], "a double, b double, is_completed int")
    r = stats.correlations_test(df, [("a", "b")]).first()
    assert r.r == pytest.approx(-1.0) and r.p_value < 1e-12


def test_missing_report_has_every_column(spark):
    df = spark.createDataFrame([tuple([None] * 25)], ", ".join(f"c{i} string" for i in range(25)))
    assert quality.missing_report(df).count() == 25
    assert quality.missing_report(df, top=20).count() == 20


def test_null_category_is_an_all_zero_dummy(spark):
    import pandas as pd
    rows = [(i, g, p, float(i), 2.0 * i, 36.0 + i, i % 2, True) for i, (g, p) in
            enumerate([("A", "car"), ("B", None), (None, "home"), ("B", "home")])]
    z = spark.createDataFrame(rows, "loan_id long, grade string, purpose string, annual_income double, loan_amount double, "
                                    "term_months double, is_default int, is_train boolean")
    design, names = model.design_matrix(model.standardise(z))
    got = {(r.loan_id, r.feature) for r in model.features_long(design, names).where("feature like 'grade%' or feature like 'purpose%'").collect()}
    want = pd.get_dummies(pd.DataFrame(rows, columns=z.columns)[["grade", "purpose"]], drop_first=True)
    assert got == {(i, c) for c in want for i in want.index[want[c]]}
