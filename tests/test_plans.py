"""Physical-plan properties the scale design relies on."""

import io
from contextlib import redirect_stdout

from loanscope.operators import portfolio
from loanscope.operators.clean import build_clean
from loanscope.sources import tables
from conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_dedup_limits_each_key_before_the_shuffle(spark):
    plan = _plan(build_clean(tables.raw_loans(spark, SF001)))
    tree = plan.split("\n\n(")[0]
    # Partial group limit sits below the exchange, final one above it.
    assert tree.index("WindowGroupLimit") < tree.index("Exchange") < tree.rindex("WindowGroupLimit")
    assert "row_number(), 1, Partial" in plan


def test_completed_only_question_prunes_partitions_and_columns(spark):
    plan = _plan(portfolio.q01_default_rate_by_grade(tables.scored_loans(spark, SF001)))
    assert "PartitionFilters: [isnotnull(is_completed" in plan and "(is_completed" in plan
    assert "ReadSchema: struct<grade:string,is_default:int>" in plan


def test_grade_filter_reaches_the_scan(spark):
    s = tables.scored_loans(spark, SF001)
    plan = _plan(s.where(s.grade.isin("A", "B")).groupBy("grade").count())
    assert "PushedFilters: [In(grade, [A,B])" in plan


def test_stored_loans_are_sorted_by_grade(spark):
    from pyspark.sql import functions as F
    s = tables.scored_loans(spark, SF001).select("grade", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    by_file = {}
    for r in sorted(s.collect(), key=lambda r: r.i):
        by_file.setdefault(r.f, []).append(r.grade)
    assert by_file and all(g == sorted(g) for g in by_file.values())


def test_group_lookups_do_not_shuffle_loans(spark):
    """With next to no automatic broadcast, no exchange on grade but of aggregates."""
    from loanscope.operators import segments
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        s = tables.scored_loans(spark, SF001)
        for df in (segments.build_segments(s, with_rate_percentile=False), portfolio.q05_underpriced_low_risk(s)):
            tree = _plan(df).split("\n\n(")[0].split("Subqueries")[0].split("\n")
            assert not any("SortMergeJoin" in x and "LeftOuter" in x for x in tree)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changed_input_is_not_answered_from_the_old_table(spark, tmp_path):
    import shutil

    import pyarrow.parquet as pq
    for f in ("lineitem", "orders", "customer", "part", "nation"):
        shutil.copy(f"{SF001}/{f}.parquet", tmp_path)
    n = tables.clean_loans(spark, str(tmp_path)).count()
    (tmp_path / "lineitem.parquet").unlink()
    pq.write_table(pq.read_table(f"{SF001}/lineitem.parquet").slice(0, 100), tmp_path / "lineitem.parquet")
    assert 0 < tables.clean_loans(spark, str(tmp_path)).count() < n


def test_raw_loans_shuffle_lineitems_once_for_the_orders(spark):
    """The big pair meets by a sort-merge join at every size, after both sides have their
    small tables: no join stands above it."""
    from loanscope.sources import fixture
    tree = _plan(fixture.raw_loans(spark, SF001)).split("\n\n(")[0]
    assert tree.count("SortMergeJoin") == 1 and tree.index("SortMergeJoin") < tree.index("BroadcastHashJoin")


def test_builds_read_small_splits_and_leave_the_setting(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for setting, want in (("128m", str(32 << 20)), ("1m", str(1 << 20))):
            spark.conf.set(name, setting)
            with tables._build_splits(spark):
                assert spark.conf.get(name) == want
            assert spark.conf.get(name) == setting
    finally:
        spark.conf.set(name, before)


def test_average_ranks_of_few_values_do_not_move_loans(spark):
    """With next to no automatic broadcast: the loans meet the table of ranks where they are."""
    from loanscope.operators import ranking
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        s = tables.scored_loans(spark, SF001).select("loan_id", "grade", "interest_rate")
        tree = _plan(ranking.average_rank_pct(s, "interest_rate", "r", keys=["grade"])).split("\n\n(")[0].split("Subqueries")[0]
        assert not any("SortMergeJoin" in x and "LeftOuter" in x for x in tree.split("\n"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
