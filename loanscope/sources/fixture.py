"""Loan-shaped raw table derived from the TPC-H-style test tables.

One raw loan record per ``lineitem`` row, joined to its order, customer, part
and nation.  Rows whose order key is a multiple of 97 are ingested twice (a
second copy with a later ``loan_id``) so that de-duplication has work to do.
Every derived value is integer or DECIMAL arithmetic, so any SQL engine
reproduces it exactly; ``plans/oracle.py`` holds the same definition in SQL.

The joins are plain equi-joins: the big ``lineitem``/``orders`` pair is a
sort-merge join on the order key at every size, dimension sides are picked for
broadcast by Spark's own size statistics (``autoBroadcastJoinThreshold``) and by
AQE at runtime, so nothing is broadcast without a measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY, POLICY_PREFIX
from ..session import parquet_path

GRADE_LETTERS = "ABCDEFG"
DUPLICATE_EVERY = 97


def _dec(c: Column) -> Column:
    return c.cast(MONEY)


def loan_id_expr(copy_no: Column) -> Column:
    """60-bit id from an md5 of the lineitem identity (same in any engine)."""
    ident = F.concat_ws(
        "|",
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        copy_no.cast("string"),
    )
    return F.conv(F.substring(F.md5(ident), 1, 15), 16, 10).cast("bigint")


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan records (``loans_raw`` schema plus ``loan_id`` and ``audit_note``)."""
    li = spark.read.parquet(parquet_path(sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = spark.read.parquet(parquet_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customer = spark.read.parquet(parquet_path(sf_dir, "customer")).select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    part = spark.read.parquet(parquet_path(sf_dir, "part")).select("p_partkey", "p_size")
    nation = spark.read.parquet(parquet_path(sf_dir, "nation")).select("n_nationkey", "n_name")

    # The borrower joins the order, and the part the bare lineitem, before the big pair
    # meets: where they are too large to broadcast, narrow rows move once for each key.
    placed = (orders.join(customer, F.col("o_custkey") == customer.c_custkey)
                    .join(nation, F.col("c_nationkey") == nation.n_nationkey)
                    .select("o_orderkey", "o_orderstatus", _dec(F.col("c_acctbal").cast(MONEY) * 10).alias("annual_inc"),
                            F.lower("c_mktsegment").alias("purpose"), F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
                            F.col("n_name").alias("addr_state")))  # text is made once an order, not once a lineitem
    joined = (li.join(part, li.l_partkey == part.p_partkey)
                .join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")))

    # Every row once, rows whose order key is a multiple of 97 twice: an
    # explode in the same pass (no union, so the join runs once).
    copies = F.when(F.col("l_orderkey") % DUPLICATE_EVERY == 0, F.array(F.lit(0), F.lit(1))) \
              .otherwise(F.array(F.lit(0)))
    rows = joined.withColumn("copy_no", F.explode(copies))

    # Stage 1: small integer codes.  All money is whole units, so the money
    # columns are exact BIGINT arithmetic, cast to DECIMAL(18,2) at the end.
    grade_no = F.col("p_size") % 7
    default_draw = (7 * F.col("l_orderkey") + 31 * F.col("l_partkey")
                    + 17 * F.col("l_suppkey") + F.col("l_linenumber")) % 20
    is_current = F.col("l_returnflag") == "N"
    is_def = (~is_current) & (default_draw < 1 + 2 * grade_no)
    stage1 = rows.select(
        loan_id_expr(F.col("copy_no")).alias("loan_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("id"),
        (F.floor(F.col("l_extendedprice") / 25) * 25).cast("bigint").alias("amt"),
        F.when(F.col("l_quantity") > 25, F.lit(60)).otherwise(F.lit(36)).alias("term_n"),
        # rint: the products are within 1e-9 of whole numbers, never at a .5 tie.
        (F.lit(5) + F.rint(F.col("l_discount") * 100).cast("bigint")
         + F.rint(F.col("l_tax") * 100).cast("bigint") + 2 * grade_no).cast("bigint").alias("rate_n"),
        F.substring(F.lit(GRADE_LETTERS), (grade_no + 1).cast("int"), 1).alias("grade"),
        "annual_inc", "purpose", "issue_d",
        (F.col("l_suppkey") % 40).cast("double").alias("dti"),
        "addr_state",
        F.when(is_current, F.lit("C")).when(is_def, F.lit("D")).otherwise(F.lit("P")).alias("kind"),
        F.col("l_linestatus"), F.col("o_orderstatus"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.when(F.col("l_suppkey") % 10 == 0, F.lit(None).cast("string"))
         .when(F.col("l_suppkey") % 10 == 1, F.lit("  "))
         .otherwise(F.lit("x")).alias("audit_note"),
    )

    # Stage 2: money in whole units (integer division = floor, all >= 0).
    kind = F.col("kind")
    full_int = F.expr("(amt * rate_n * (term_n div 12)) div 100")
    stage2 = stage1.select(
        "*",
        F.when(kind == "P", F.col("amt"))
         .when(kind == "D", F.expr("(amt * qty) div 100"))
         .otherwise(F.expr("(amt * 3) div 10")).alias("prncp"),
        F.when(kind == "P", full_int).otherwise(F.expr("((amt * rate_n * (term_n div 12)) div 100) div 2")).alias("intr"),
        F.when(kind == "D", F.expr("amt div 20")).otherwise(F.lit(0).cast("bigint")).alias("recov"),
    )

    base_status = (F.when(kind == "C", F.lit("Current"))
                    .when((kind == "D") & (F.col("l_linestatus") == "O"), F.lit("Default"))
                    .when(kind == "D", F.lit("Charged Off"))
                    .otherwise(F.lit("Fully Paid")))
    status = F.when((F.col("o_orderstatus") == "P") & (kind != "C"),
                    F.concat(F.lit(POLICY_PREFIX), base_status)).otherwise(base_status)
    return stage2.select(
        "loan_id", "id",
        _dec(F.col("amt")).alias("loan_amnt"),
        F.concat(F.lit(" "), F.col("term_n").cast("string"), F.lit(" months")).alias("term"),
        F.concat(F.col("rate_n").cast("string"), F.lit("%")).alias("int_rate"),
        _dec(F.expr("amt div term_n")).alias("installment"),
        "grade", "annual_inc", "purpose", "issue_d", "dti", "addr_state",
        status.alias("loan_status"),
        _dec(F.col("prncp") + F.col("intr") + F.col("recov")).alias("total_pymnt"),
        _dec(F.col("prncp")).alias("total_rec_prncp"),
        _dec(F.col("intr")).alias("total_rec_int"),
        _dec(F.col("recov")).alias("recoveries"),
        "audit_note")
