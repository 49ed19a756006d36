from pyspark.sql import functions as F

from conftest import SF001
from loanscope.sources import tables


def test_registered_views_answer_sql(spark):
    """Mean rate and share of long terms of settled loans by purpose and year: the
    same from SQL over the views as from the DataFrame they stand for."""
    assert tables.register_views(spark, SF001) == ["loans_raw", "loans", "loans_scored"]
    sql = spark.sql("""
        SELECT purpose, issue_year, count_if(is_completed = 1) AS settled, avg(interest_rate) AS rate,
               avg(CAST(term_months > 36 AS INT)) AS long_share
        FROM loans_scored GROUP BY ALL""")
    api = tables.scored_loans(spark, SF001).groupBy("purpose", "issue_year").agg(
        F.sum("is_completed").alias("settled"), F.avg("interest_rate").alias("rate"),
        F.avg((F.col("term_months") > 36).cast("int")).alias("long_share"))
    key = lambda r: (r.purpose or "", r.issue_year or 0)
    got, want = sorted(sql.collect(), key=key), sorted(api.collect(), key=key)
    assert len(got) > 5 and [tuple(r) for r in got] == [tuple(r) for r in want]
    n_raw = spark.sql("SELECT COUNT(*) FROM loans_raw").first()[0]
    n_clean = spark.sql("SELECT COUNT(*) FROM loans").first()[0]
    assert n_raw > n_clean > 0
