"""Column names, status sets and labels shared by all operators."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
COMPLETED_STATUSES = ("Fully Paid", "Charged Off", "Default")
DEFAULT_STATUSES = ("Charged Off", "Default")
POLICY_PREFIX = "Does not meet the credit policy. Status:"
MONTH_ABBREVIATIONS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
                       "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
RISK_TIER_LABELS = ("Low Risk", "Medium Risk", "High Risk")
VALUE_TIER_LABELS = ("Low Value", "High Value")
SEGMENT_SEPARATOR = " / "
SMALL_SAMPLE_N = 30
SMALL_SAMPLE_LABEL = "low-confidence (n<30)"
OK_SAMPLE_LABEL = "ok"
SCENARIO_MULTIPLIERS = {"margin_pessimistic_20pct_more_defaults": 1.2,
                        "margin_optimistic_20pct_fewer_defaults": 0.8}
INCOME_REVIEW_THRESHOLD = 5_000_000
RATE_MAX_PCT = 40
RANDOM_SEED = 42
CORRELATION_PAIRS = (("interest_rate", "annual_income"),
                     ("interest_rate", "is_default"),
                     ("annual_income", "is_default"))
# ---------------------------------------------------------------------------

# Unscored rows (grade without any completed loan) get an explicit tier label
# instead of pandas' 'nan' text.
UNSCORED_LABEL = "Unscored"

# Raw columns in ingest order; amounts stay exact DECIMAL through every sum.
MONEY = T.DecimalType(18, 2)

RAW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("loan_amnt", MONEY),
    T.StructField("term", T.StringType()),
    T.StructField("int_rate", T.StringType()),
    T.StructField("installment", MONEY),
    T.StructField("grade", T.StringType()),
    T.StructField("annual_inc", MONEY),
    T.StructField("purpose", T.StringType()),
    T.StructField("issue_d", T.StringType()),
    T.StructField("dti", T.DoubleType()),
    T.StructField("addr_state", T.StringType()),
    T.StructField("loan_status", T.StringType()),
    T.StructField("total_pymnt", MONEY),
    T.StructField("total_rec_prncp", MONEY),
    T.StructField("total_rec_int", MONEY),
    T.StructField("recoveries", MONEY),
])

# The 11 raw columns whose equality defines a duplicate loan record.
DEDUP_KEYS = ("loan_amnt", "term", "int_rate", "installment", "grade",
              "annual_inc", "purpose", "issue_d", "dti", "addr_state",
              "loan_status")

CLEAN_COLUMNS = ("loan_id", "loan_amount", "interest_rate", "grade",
                 "annual_income", "purpose", "term_months", "loan_status",
                 "issue_date", "total_payment_received", "principal_received",
                 "interest_received", "post_default_recoveries")

SCORED_EXTRA = ("is_completed", "is_default", "issue_year")
