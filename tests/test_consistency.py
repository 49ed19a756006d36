"""Cross-report identities (the checks SURVEY §5 derives from the published
CSVs), run on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from conftest import SF001


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    return lambda name: qs[name](spark, SF001).collect()


def test_row_totals_agree(q):
    clean = q("dq_reconcile")[0]
    seg_total = sum(r.n_loans for r in q("segment_summary"))
    cohort_total = sum(r.total_loans_in_cohort for r in q("export_cohort"))
    q6_total = sum(r.total_loans_in_cohort for r in q("q06_cohorts"))
    assert seg_total == cohort_total == q6_total == clean.clean_rows
    assert clean.raw_rows - clean.clean_rows == clean.dropped_rows > 0


def test_completed_and_default_totals_agree(q):
    by_grade = q("export_default_rate")
    completed = sum(r.completed_loans for r in by_grade)
    defaults = sum(r.defaulted_loans for r in by_grade)
    assert completed == sum(r.n_loans for r in q("segment_sensitivity"))
    assert completed == sum(r.completed_loans for r in q("q01_default_rate"))
    assert defaults == sum(r.defaults for r in q("q06_cohorts"))
    assert completed == q("chi_square")[0].n


def test_margin_identities(q):
    margin_grade = sum(r.realized_margin for r in q("export_margin"))
    sens = q("segment_sensitivity")
    margin_seg = sum(r.realized_margin for r in sens)
    assert abs(margin_grade - margin_seg) <= len(sens) + 7  # each row rounded once
    for r in sens:
        assert abs(r.realized_margin - (r.interest_actually_collected - r.unrecovered_principal_loss)) <= 1
        assert abs(r.margin_pessimistic_20pct_more_defaults
                   - (r.interest_actually_collected - 1.2 * r.unrecovered_principal_loss)) <= 1
        assert abs(r.margin_optimistic_20pct_fewer_defaults
                   - (r.interest_actually_collected - 0.8 * r.unrecovered_principal_loss)) <= 1


def test_risk_tiers_are_whole_grades(spark):
    seg = E.queries()["segment_assign"](spark, SF001)
    tiers_per_grade = seg.groupBy("grade").agg({"risk_tier": "approx_count_distinct"}).collect()
    assert all(r[1] == 1 for r in tiers_per_grade)


def test_experiment_identities(q):
    cmp = q("ab_compare")[0]
    target = q("portfolio_lift")[0]
    assert cmp.control_n + cmp.treatment_n == target.target_loans
    seg = q("ab_power_by_segment")
    assert sum(r.control_n + r.treatment_n for r in seg) == target.target_loans
    assert q("ab_power")[0].available_per_arm == min(cmp.control_n, cmp.treatment_n)
