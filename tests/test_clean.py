from decimal import Decimal

from pyspark.sql import Row

from loanscope.operators.clean import build_clean, dedup_first, score
from loanscope.schema import DEDUP_KEYS, RAW_SCHEMA


def _raw(spark, rows):
    schema = "loan_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMA.fields)
    return spark.createDataFrame(rows, schema)


def _row(loan_id, income="50000.00", status="Fully Paid", prncp="1000.00", term=" 36 months"):
    return (loan_id, str(loan_id), Decimal("1000.00"), term, "10%", Decimal("33.00"), "A",
            None if income is None else Decimal(income), "car", "Jan-2017", 1.0, "CA", status,
            Decimal("1100.00"), Decimal(prncp), Decimal("100.00"), Decimal("0.00"))


def test_dedup_keeps_first_ingested_and_filters_income(spark):
    rows = [_row(5, prncp="900.00"), _row(3, prncp="800.00"), _row(9, income="0.00"),
            _row(10, income=None), _row(11, term="36 months")]
    clean = build_clean(_raw(spark, rows)).orderBy("loan_id").collect()
    # 3 and 5 share the 11-column raw key: the smaller loan_id survives (payment
    # columns are not part of the key).  ' 36 months' vs '36 months' stay distinct.
    assert [r.loan_id for r in clean] == [3, 11]
    assert clean[0].principal_received == Decimal("800.00")
    assert clean[0].term_months == 36 and clean[1].term_months == 36


def test_dedup_null_keys_group_together(spark):
    a = list(_row(1)); b = list(_row(2))
    a[7 + 1] = None; b[7 + 1] = None  # purpose NULL in both
    out = dedup_first(_raw(spark, [tuple(a), tuple(b)]), DEDUP_KEYS).collect()
    assert [r.loan_id for r in out] == [1]


def test_score_flags(spark):
    rows = [_row(1, status="Fully Paid"), _row(2, status="Charged Off"), _row(3, status="Default"),
            _row(4, status="Current"),
            _row(5, status="Does not meet the credit policy. Status:Charged Off")]
    r = {x.loan_id: x for x in score(build_clean(_raw(spark, rows))).collect()}
    assert (r[1].is_completed, r[1].is_default) == (1, 0)
    assert (r[2].is_completed, r[2].is_default) == (1, 1)
    assert (r[3].is_completed, r[3].is_default) == (1, 1)
    assert (r[4].is_completed, r[4].is_default) == (0, 0)
    assert (r[5].is_completed, r[5].is_default) == (1, 1)
    assert r[1].issue_year == 2017
