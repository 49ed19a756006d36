import datetime as dt

from pyspark.sql import functions as F

from loanscope.functions.parse import (is_missing, month_year_to_date, percent_text_to_double,
                                       strip_policy_prefix, term_to_months)


def test_parsers_edge_values(spark):
    rows = [(" 36 months", "13.5%", "Dec-2018", "Does not meet the credit policy. Status:Fully Paid", "x"),
            ("60 months", "12.5abc", "18-Dec", "Charged Off", "  "),
            (None, "7", "Foo-2018", None, None),
            ("abc", None, "dec-2018", "Current", "")]
    df = spark.createDataFrame(rows, "term string, rate string, d string, status string, note string")
    out = df.select(term_to_months(F.col("term")).alias("t"), percent_text_to_double(F.col("rate")).alias("r"),
                    month_year_to_date(F.col("d")).alias("d"), strip_policy_prefix(F.col("status")).alias("s"),
                    is_missing(F.col("note")).alias("m")).collect()
    assert [r.t for r in out] == [36, 60, None, None]
    assert [r.r for r in out] == [13.5, None, 7.0, None]
    # Unknown month text and a bad layout are NULL; month names are case-sensitive.
    assert [r.d for r in out] == [dt.date(2018, 12, 1), None, None, None]
    assert [r.s for r in out] == ["Fully Paid", "Charged Off", None, "Current"]
    assert [r.m for r in out] == [False, True, True, True]
