import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanscope.operators import ranking


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        # One value holds a third of all rows (the hot-key case), plus NULLs.
        v = rnd.choice([None] + [float(x) for x in range(40)]) if i % 3 else 5.0
        rows.append((i, rnd.choice(["A", "B", "C", None]), v))
    rows.append((99999, "D", 1.0))  # one-row group
    return spark.createDataFrame(rows, "loan_id long, grade string, v double")


def test_percent_rank_matches_native(spark, frame):
    mine = ranking.percent_rank(frame, "v", "pr", keys=["grade"])
    native = frame.withColumn("pr", F.percent_rank().over(
        Window.partitionBy("grade").orderBy(F.col("v").asc_nulls_first())))
    assert sorted(mine.select("loan_id", "pr").collect()) == sorted(native.select("loan_id", "pr").collect())
    mine_g = ranking.percent_rank(frame, "v", "pr")
    native_g = frame.withColumn("pr", F.percent_rank().over(Window.orderBy(F.col("v").asc_nulls_first())))
    assert sorted(mine_g.select("loan_id", "pr").collect()) == sorted(native_g.select("loan_id", "pr").collect())


@pytest.mark.parametrize("k", [4, 7])
def test_ntile_matches_native(spark, frame, k):
    mine = ranking.ntile(frame, "v", k, "q")
    native = frame.withColumn("q", F.ntile(k).over(Window.orderBy(F.col("v").asc_nulls_first(), "loan_id")))
    got = sorted((r.loan_id, r.q) for r in mine.collect())
    want = sorted((r.loan_id, r.q) for r in native.collect())
    assert got == want


def test_ntile_fewer_rows_than_buckets(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 1.0)], "loan_id long, v double")
    got = sorted((r.loan_id, r.q) for r in ranking.ntile(df, "v", 4, "q").collect())
    assert got == [(1, 2), (2, 3), (3, 1)]


def test_average_rank_pct_matches_pandas(spark, frame):
    mine = ranking.average_rank_pct(frame, "v", "p", keys=["grade"]).toPandas().set_index("loan_id")
    pdf = frame.toPandas()
    pdf["p"] = pdf.groupby("grade", dropna=True)["v"].rank(pct=True)
    pdf = pdf.set_index("loan_id")
    both = pdf.join(mine["p"].rename("mine"))
    assert np.allclose(both["p"].fillna(-1), both["mine"].fillna(-1), rtol=0, atol=1e-12)


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(3).integers(0, 50, 1001)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0, 0.1, 1 / 3, 0.5, 2 / 3, 0.99, 1]
    row = ranking.exact_quantiles(df, "v", probs).first()
    want = np.quantile(np.array([v for v in vals if v is not None]), probs)
    assert np.allclose([row[f"q{i}"] for i in range(len(probs))], want, rtol=0, atol=1e-9)


def test_quantile_cut_matches_pandas_qcut(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 30, 500).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, v double")
    labels = ["lo", "mid", "hi"]
    got = dict(ranking.quantile_cut(df, "v", labels, "t").select("i", "t").collect())
    want = pd.qcut(pd.Series(vals), 3, labels=labels).astype(str)
    assert [got[i] for i in range(len(vals))] == list(want)


def test_quantile_cut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)], "v double")
    with pytest.raises(ValueError):
        ranking.quantile_cut(df, "v", ["a", "b", "c"], "t")


def test_upper_median_even_and_odd(spark):
    odd = spark.createDataFrame([(x,) for x in [5.0, 1.0, 3.0]], "r double")
    even = spark.createDataFrame([(x,) for x in [4.0, 1.0, 3.0, 2.0]], "r double")
    assert ranking.upper_median(odd, "r").first()[0] == 3.0
    assert ranking.upper_median(even, "r").first()[0] == 3.0  # offset n div 2, not 2.5


def test_no_single_task_over_data_sized_input(spark, frame):
    """Only the bucket table (fixed range, not fixed rows) is summed by one task."""
    import io
    import re
    from contextlib import redirect_stdout
    for df in (ranking.percent_rank(frame, "v", "pr"), ranking.ntile(frame, "v", 4, "q")):
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        tree = buf.getvalue()
        for m in re.finditer(r"Exchange SinglePartition[^\n]*\n([^\n]*)", tree):
            assert "HashAggregate(keys=[_b" in m[1], m[0]


def test_buckets_never_fall(spark):
    vals = [-1e9, -5.0, -0.1, 0.0, 1e-9, 0.1, 0.100001, 1.0, 7.25, 7.26, 1e4, 1e4 + 0.01, 1e12, 1e300]
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", ranking.bucket(F.col("v")).alias("b"))
    b = [r.b for r in sorted(df.collect())]
    assert b == sorted(b) and b[0] < b[3] < b[-1]


def test_narrow_doubles_are_cut_evenly(spark, monkeypatch):
    """All distinct values in one bucket by size: quantiles cut it, the ranks stay exact."""
    monkeypatch.setattr(ranking, "CUT_ROWS", 500)
    rng = np.random.default_rng(2)
    vals = np.concatenate([1 + rng.random(30_000) / 1000, [1.0, np.nan, np.inf, -3.0], 1 + rng.integers(0, 9, 3000) / 1e9])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)] + [(-1, None)], "loan_id long, v double")
    cells = ranking.cut_buckets(df.select("v").distinct(), "v").groupBy("_b", "_s").count().collect()
    assert max(r["count"] for r in cells) < 1000 and len(cells) > 100
    mine = ranking.percent_rank(df, "v", "pr").select("loan_id", "pr").collect()
    native = df.withColumn("pr", F.percent_rank().over(Window.orderBy(F.col("v").asc_nulls_first()))).select("loan_id", "pr")
    assert sorted(mine) == sorted(native.collect())


@pytest.mark.parametrize("spread", [1, 1 << 38, 7])
def test_positions_in_a_hot_tie(spark, monkeypatch, spread):
    """A third and more of the rows on one value, ids of many files: counted, not ranked."""
    from loanscope.operators import selection
    monkeypatch.setattr(selection, "FEW", 16)
    monkeypatch.setattr(selection, "BITS", 4)
    rng = random.Random(spread)
    ids = rng.sample(range(-3000, 40_000), 6000)
    rows = [(i * spread + rng.randrange(spread), 7.5 if n % 3 else float(rng.randrange(30))) for n, i in enumerate(ids)] + [(None, 7.5)]
    df = spark.createDataFrame(rows, "loan_id long, v double")
    for k in (4, 7, 100):
        mine = ranking.ntile(df, "v", k, "q").collect()
        native = df.withColumn("q", F.ntile(k).over(Window.orderBy(F.col("v").asc_nulls_first(), F.col("loan_id").asc_nulls_first()))).collect()
        assert sorted(map(str, mine)) == sorted(map(str, native))
    plan = ranking.ntile(df, "v", 4, "q")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # a projection


def test_thresholds_by_several_columns(spark, monkeypatch):
    from loanscope.operators import selection
    monkeypatch.setattr(selection, "FEW", 3)
    rng = random.Random(4)
    rows = [("a" if i % 2 else None, rng.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, h long, loan_id long")
    for g in ("a", None):
        order = sorted((h, i) for x, h, i in rows if x == g)
        asked = [(g, p) for p in (0, 1, 57, 120, 199)]
        for (_, p), t in zip(asked, selection.thresholds(df, "g", ["h", "loan_id"], asked)):
            reached = {(r.h, r.loan_id) for r in df.where(F.col("g").eqNullSafe(F.lit(g))).where(selection.behind(["h", "loan_id"], t)).collect()}
            assert reached == set(order[p:])
