"""Named query plans: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, experiment, export, model, portfolio, quality, ranking, segments, stats
from ..schema import RAW_SCHEMA
from ..session import input_state
from ..sources import tables

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_scored(op) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(tables.scored_loans(spark, sf_dir))
    run.__name__ = getattr(op, "__name__", "query")
    return run


def tidy_types(df: DataFrame) -> DataFrame:
    """Hand results out in portable types: DECIMAL/FLOAT -> DOUBLE,
    small ints -> BIGINT, DATE -> ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _tidy(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy_types(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    return run


def _dq_missing(spark, sf_dir):
    return quality.missing_report(tables.raw_loans(spark, sf_dir), top=20)


def _dq_duplicates(spark, sf_dir):
    return quality.duplicate_id_groups(tables.raw_loans(spark, sf_dir))


def _dq_ranges(spark, sf_dir):
    return quality.range_checks(tables.raw_loans(spark, sf_dir))


def _dq_status(spark, sf_dir):
    return quality.status_distribution(tables.clean_loans(spark, sf_dir))


def _dq_reconcile(spark, sf_dir):
    return quality.reconcile(tables.raw_loans(spark, sf_dir), tables.clean_loans(spark, sf_dir))


def _clean_loans(spark, sf_dir):
    # Full ingest plan (filter + de-dup + parse), not the materialised copy.
    return tables.clean_loans(spark, sf_dir, materialise=False)


def _loans_scored(spark, sf_dir):
    return clean.score(tables.clean_loans(spark, sf_dir, materialise=False))


QUERIES: dict[str, QueryFn] = {
    "dq_missing": _dq_missing,
    "dq_duplicates": _dq_duplicates,
    "dq_ranges": _dq_ranges,
    "dq_status": _dq_status,
    "dq_reconcile": _dq_reconcile,
    "clean_sample": lambda sp, d: quality.sample_rows(tables.clean_loans(sp, d)),
    "clean_loans": _clean_loans,
    "loans_scored": _loans_scored,
    "q01_default_rate": _on_scored(portfolio.q01_default_rate_by_grade),
    "q02_grade_purpose": _on_scored(portfolio.q02_grade_purpose),
    "q03_riskiest_purposes": _on_scored(portfolio.q03_riskiest_purposes),
    "q04_revenue_at_risk": _on_scored(portfolio.q04_revenue_at_risk),
    "q05_underpriced": _on_scored(portfolio.q05_underpriced_low_risk),
    "q06_cohorts": _on_scored(portfolio.q06_cohorts),
    "q07_rate_dispersion": _on_scored(portfolio.q07_rate_dispersion),
    "q08_income_quartile": _on_scored(portfolio.q08_grade_income_quartile),
    "q09_purpose_term": _on_scored(portfolio.q09_purpose_term_lowest_risk),
    "q10_realized_margin": _on_scored(portfolio.q10_realized_margin),
}


def _scored(spark, sf_dir):
    return tables.scored_loans(spark, sf_dir)


def _seg(spark, sf_dir):
    return tables.segmented_loans(spark, sf_dir)


def _good_grades(spark, sf_dir):
    return stats.good_grades(_scored(spark, sf_dir))


def _kth_grade_rate(spark, sf_dir):
    gq = portfolio.grade_default_rates(_scored(spark, sf_dir), rounded=True)
    return ranking.upper_median(gq, "grade_default_rate").withColumnRenamed("grade_default_rate", "median_val")


def _pct_rank_in_grade(spark, sf_dir):
    base = _scored(spark, sf_dir).select("loan_id", "grade", "interest_rate")
    return ranking.percent_rank(base, "interest_rate", "rate_percentile_in_grade", keys=["grade"])


def _pct_rank_income(spark, sf_dir):
    base = _scored(spark, sf_dir).select("loan_id", "annual_income")
    return ranking.percent_rank(base, "annual_income", "income_percentile_overall")


def _avg_rank_pct(spark, sf_dir):
    base = _scored(spark, sf_dir).select("loan_id", "grade", "interest_rate")
    return ranking.average_rank_pct(base, "interest_rate", "rate_percentile_avg", keys=["grade"])


def _income_ntile(spark, sf_dir):
    base = _scored(spark, sf_dir).where("is_completed = 1").select("loan_id", "annual_income")
    return ranking.ntile(base, "annual_income", 4, "income_quartile")


_CTX: dict = {}
_LOCK = threading.RLock()


def _ctx(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, input_state(spark, sf_dir))
    with _LOCK:
        if key not in _CTX:
            _CTX[key] = stats.pricing_context(_scored(spark, sf_dir))
        return _CTX[key]


def _simulation(spark, sf_dir):
    return experiment.simulate(_scored(spark, sf_dir), _ctx(spark, sf_dir))


def _ab_compare(spark, sf_dir):
    return experiment.compare_arms(_simulation(spark, sf_dir))


_MODELS: dict = {}


def _fitted(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, input_state(spark, sf_dir))
    with _LOCK:
        if key not in _MODELS:
            split = model.stratified_split(model.model_frame(_scored(spark, sf_dir)))
            fitted, names, design = model.fit(split)
            _MODELS[key] = fitted, names, design, model.newton(design, names, fitted)
        return _MODELS[key]


def _model_features(spark, sf_dir):
    _, names, design, _ = _fitted(spark, sf_dir)  # the matrix the model was fit on
    return model.features_long(design, names).withColumn("value", F.round("value", 9))


def _model_coefficients(spark, sf_dir):
    m, names, _, beta = _fitted(spark, sf_dir)
    return model.coefficients(m, names, spark, beta).withColumn("coefficient", F.round("coefficient", 8))


def _model_metrics(spark, sf_dir):
    m, names, z, beta = _fitted(spark, sf_dir)
    out = model.evaluate(m, z, names, beta)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns[:-1]], "test_rows")


def _ingest_summary(raw: DataFrame) -> DataFrame:
    """Every ingested column: rows, NULLs and a checksum of its values as text; for
    ``loan_id`` repeated ids, and the checksum over whole records."""
    names = [f.name for f in RAW_SCHEMA.fields] + ["audit_note"]
    record = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in names])
    digest = lambda c: F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
    total = lambda c: F.coalesce(F.sum(digest(c)), F.lit(0))
    # Ids are counted by themselves: beside them every sum would be kept and shuffled for each
    # id.  64 ids in a row share a word of bits, so that not every id is a row of the shuffle.
    words = raw.groupBy(F.shiftright("loan_id", 6)).agg(F.bit_or(F.expr("shiftleft(1L, cast(loan_id & 63 as int))")).alias("bits"))
    ids = words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).scalar()
    one = raw.agg(F.count(F.lit(1)).alias("n"), total(record).alias("sum"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names],
                  *[total(F.col(c)).alias(f"sum_{c}") for c in names])
    row = lambda name, nulls, checksum: F.struct(F.lit(name).alias("column"), F.col("n").alias("n_rows"),
                                                 nulls.cast("bigint").alias("n_null"), checksum.cast("bigint").alias("checksum"))
    return one.select(F.inline(F.array(row("loan_id", F.col("n") - ids, F.col("sum")),
                                       *[row(c, F.col(f"null_{c}"), F.col(f"sum_{c}")) for c in names])))


_STAGED: dict = {}


def _staged_csv(spark, sf_dir, compressed: bool = False) -> str:
    """The raw records as CSV text (the input format of the ingest), staged
    once per application under the shared checkpoint folder."""
    from ..session import scratch_path
    from ..sources import csv_ingest
    key = (spark.sparkContext.applicationId, sf_dir, input_state(spark, sf_dir), compressed)
    with _LOCK:
        if key not in _STAGED:
            path = scratch_path(spark, "staged_csv", uuid.uuid4().hex)
            if compressed:
                with tables.raw_loans_once(spark, sf_dir) as raw:
                    csv_ingest.write_raw_csv(raw, path, compressed)
            else:
                csv_ingest.write_raw_csv(tables.raw_loans(spark, sf_dir), path)
            _STAGED[key] = path
        return _STAGED[key]


def _csv_ingest(spark, sf_dir):
    """SRC-1..3: CSV text ingested to a fresh Parquet raw table.  The text is staged
    compressed: plain, it is most of the disk that the query takes."""
    from ..session import scratch_path
    from ..sources import csv_ingest
    out = scratch_path(spark, "csv_ingest", uuid.uuid4().hex)
    csv_ingest.ingest_csv(spark, _staged_csv(spark, sf_dir, compressed=True), out)
    return _ingest_summary(spark.read.parquet(out))


def _stream_ingest(spark, sf_dir):
    """Same CSV files appended micro-batch by micro-batch with a file stream."""
    from ..session import scratch_path
    from ..streaming.ingest import run_csv_append
    base = scratch_path(spark, "stream_ingest", uuid.uuid4().hex)
    out = run_csv_append(spark, _staged_csv(spark, sf_dir), f"{base}/raw", f"{base}/_checkpoint",
                         max_files_per_trigger=2)
    return _ingest_summary(out)


def _written(spark, df: DataFrame, name: str, key: str) -> DataFrame:
    """A report written as CSV and read back: (report, key, column, value) of
    every cell but the empty ones."""
    from ..session import scratch_path
    path = scratch_path(spark, "export_csv", uuid.uuid4().hex, name)
    export.write_csv(df, path, key)
    back = spark.read.option("header", True).csv(path)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in back.columns if c != key]
    return (back.select(F.lit(name).alias("report"), F.col(key).alias("key"), F.explode(F.array(*cells)).alias("c"))
                .select("report", "key", "c.column", "c.value").where("value is not null"))


def _export_csv(spark, sf_dir):
    """SRC-8: the dashboard reports as headed CSVs (key column first)."""
    sc, sg = _scored(spark, sf_dir), _seg(spark, sf_dir)
    reports = {
        "default_rate_by_grade": (export.default_rate_by_grade(sc), "grade"),
        "cohort_analysis": (export.cohort_analysis(sc), "issue_year"),
        "realized_margin_by_grade": (export.realized_margin_by_grade(sc), "grade"),
        "segment_sensitivity": (segments.segment_sensitivity(sg), "segment"),
        "segment_summary": (segments.segment_summary(sg), "segment"),
    }
    out = None
    for name, (df, key) in reports.items():
        back = _written(spark, df, name, key)
        out = back if out is None else out.unionByName(back)
    return out


def _export_coefficients(spark, sf_dir):
    """SRC-8: the model's coefficients as a headed CSV."""
    return _written(spark, _model_coefficients(spark, sf_dir), "feature_importance", "feature")


QUERIES.update({
    "export_csv": _export_csv,
    "export_coefficients": _export_coefficients,
    "csv_ingest": _csv_ingest,
    "stream_ingest": _stream_ingest,
    "good_grades": _good_grades,
    "kth_grade_rate": _kth_grade_rate,
    "pct_rank_in_grade": _pct_rank_in_grade,
    "pct_rank_income": _pct_rank_income,
    "avg_rank_pct": _avg_rank_pct,
    "income_ntile": _income_ntile,
    "segment_assign": lambda sp, d: segments.segment_assignments(_seg(sp, d)),
    "segment_summary": lambda sp, d: segments.segment_summary(_seg(sp, d)),
    "segment_sensitivity": lambda sp, d: segments.segment_sensitivity(_seg(sp, d)),
    "segment_robust": lambda sp, d: segments.segment_robustness(segments.segment_sensitivity(_seg(sp, d))),
    "export_default_rate": lambda sp, d: export.default_rate_by_grade(_scored(sp, d)),
    "export_cohort": lambda sp, d: export.cohort_analysis(_scored(sp, d)),
    "export_margin": lambda sp, d: export.realized_margin_by_grade(_scored(sp, d)),
    "contingency": lambda sp, d: stats.contingency(_scored(sp, d)),
    "chi_square": lambda sp, d: stats.chi_square(_scored(sp, d)),
    "chi_square_test": lambda sp, d: stats.chi_square_test(_scored(sp, d)),
    "correlations": lambda sp, d: stats.correlations(_scored(sp, d)),
    "correlations_test": lambda sp, d: stats.correlations_test(_scored(sp, d)),
    "underpriced_welch": lambda sp, d: stats.underpriced_welch(_scored(sp, d), _ctx(sp, d)),
    "underpriced_welch_test": lambda sp, d: stats.underpriced_welch_test(_scored(sp, d), _ctx(sp, d)),
    "rate_gap": lambda sp, d: stats.rate_gap(_scored(sp, d), _ctx(sp, d)),
    "ab_assign": lambda sp, d: experiment.assignments(_simulation(sp, d)),
    "ab_compare": _ab_compare,
    "ab_compare_test": lambda sp, d: experiment.compare_arms_test(_simulation(sp, d)),
    "ab_power": lambda sp, d: experiment.power(_ab_compare(sp, d)),
    "ab_power_by_segment": lambda sp, d: experiment.power_by_segment(
        experiment.simulate(_seg(sp, d), _ctx(sp, d))),
    "ab_duration": lambda sp, d: experiment.duration(_scored(sp, d), _ab_compare(sp, d), _ctx(sp, d)),
    "portfolio_lift": lambda sp, d: experiment.portfolio_lift(_scored(sp, d), _ctx(sp, d)),
    "model_split": lambda sp, d: model.stratified_split(model.model_frame(_scored(sp, d))).select(
        "loan_id", "is_default", F.col("is_train").cast("bigint").alias("is_train")),
    "model_features": _model_features,
    "model_coefficients": _model_coefficients,
    "model_top_features": lambda sp, d: model.top_coefficients(_model_coefficients(sp, d)),
    "model_metrics": _model_metrics,
})


# Statistics whose last bits depend on summation order are reported to 6
# decimal places (their oracle rounds the same way).
ROUNDED_6 = ("chi_square", "chi_square_test", "correlations", "correlations_test",
             "underpriced_welch", "underpriced_welch_test", "rate_gap", "ab_compare",
             "ab_compare_test", "ab_power", "ab_power_by_segment", "ab_duration", "portfolio_lift")


def _round_doubles(fn: QueryFn, digits: int = 6) -> QueryFn:
    """For the comparison only: the operators keep full precision.  K / d^2 magnifies
    the last bits of a small d, so the required n is compared to 0.1 of a loan."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        shown = lambda f: (F.format_string("%.6e", F.col(f.name)).try_cast("double") if f.name == "p_value"
                           else F.round(F.col(f"`{f.name}`"), 1 if f.name == "required_n_per_arm" else digits))
        return df.select(*[
            (shown(f) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields])
    return run


QUERIES = {k: _tidy(_round_doubles(v) if k in ROUNDED_6 else v) for k, v in QUERIES.items()}
