"""Ranking, percentiles and quantile cuts without single-task windows (W-2..8, T-4).

A plain ``percent_rank() OVER (ORDER BY x)`` or ``ntile(k) OVER (ORDER BY x)``
puts every row into one task.  The forms here keep all loan-grain work
distributed, by one algorithm at every size:

* Peer counts are aggregated first (``groupBy(keys, value).count()``): a value
  held by a third of all rows becomes one row, combined map-side.
* Values fall into buckets by a monotone function of the value (``bucket``), so
  all of a bucket's values lie below those of the next.  Where many distinct values
  share a bucket, approximate quantiles of them cut it into parts (any cuts are right,
  these are even).  Running totals over the parts are a small window, running totals
  inside a part one window partition each, and their sum is the running count.
* NTILE needs the rows at k-1 positions, which ``selection`` finds by counting; every
  row is then compared with them, and no loan row moves.
* Results join back to the loans on the value (AQE broadcasts the frequency
  table when it is small and splits skewed join partitions when it is not; average ranks,
  whose loans are whole rows, count it first: AQE knows its size when the loans have moved).

Group-grain tables (one row per grade or purpose) use native windows; their
size is bounded by the number of groups, not by the number of loans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import behind, thresholds

# Buckets per e-fold of the value; about 30,000 buckets cover 0 to 10^12.
BUCKETS_PER_E = 1024
# Buckets with more distinct values than this are cut, the fullest first; the others
# then have less than 1 / CUT_BUCKETS of the distinct values each.
CUT_ROWS, CUT_BUCKETS, CUT_PARTS = 50_000, 1024, 256


def _asc(c: str) -> Column:
    return F.col(c).asc_nulls_first()


def _null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how="inner") -> DataFrame:
    cond = None
    renamed = right
    for c in cols:
        renamed = renamed.withColumnRenamed(c, f"__r_{c}")
    for c in cols:
        e = left[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` grows: the logarithm of its
    size with its sign, for NaN the largest.  NULL stays NULL."""
    x = value.cast("double")
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * BUCKETS_PER_E))


def cut_buckets(table: DataFrame, value: str) -> DataFrame:
    """``table`` with ``_b``, its value's bucket, and ``_s``, the part of it."""
    x = F.col(value).cast("double")
    table = table.withColumn("_b", bucket(F.col(value)))
    edges = F.percentile_approx(x, [i / CUT_PARTS for i in range(1, CUT_PARTS)], 4 * CUT_PARTS)
    full = (table.where(F.col("_b").isNotNull()).groupBy("_b").agg(F.count(F.lit(1)).alias("_d"), edges.alias("_edges")).where(F.col("_d") > CUT_ROWS)
                 .orderBy(F.desc("_d"), "_b").limit(CUT_BUCKETS).select("_b", "_edges"))
    part = F.coalesce(F.size(F.filter("_edges", lambda e: e <= x)), F.lit(0))
    return (table.join(F.broadcast(full), "_b", "left")  # CUT_BUCKETS rows at most
                 .withColumn("_s", F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(part)).drop("_edges"))


def running_before(table: DataFrame, keys: Sequence[str], value: str, weight: str,
                   out_col: str = "_before", total_col: str = "_n") -> DataFrame:
    """Add ``out_col``, the sum of ``weight`` over the rows of the same ``keys``
    with a smaller ``value`` (NULL is smallest), and ``total_col``, the sum over
    all rows of the keys.  (keys, value) must identify rows."""
    cells = [*keys, "_b", "_s"]
    table = cut_buckets(table, value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    heads = table.groupBy(*cells).agg(F.sum(weight).alias("_t")).select(
        *cells, F.coalesce(F.sum("_t").over(before(group.orderBy(_asc("_b"), "_s"))), F.lit(0)).alias("_head"),
        F.sum("_t").over(group).alias(total_col))
    inside = F.coalesce(F.sum(weight).over(before(Window.partitionBy(*cells).orderBy(_asc(value)))), F.lit(0))
    return (_null_safe_join(table.withColumn("_inside", inside), heads, cells)
            .withColumn(out_col, (F.col("_head") + F.col("_inside")).cast("bigint"))
            .drop("_b", "_s", "_head", "_inside"))


# Rows a lookup table may have to be broadcast.
LOOKUP_ROWS = 10_000


def lookup(table: DataFrame) -> DataFrame:
    """A group-grain table as the small side of a join: broadcast if it was seen
    to be small (a grade column can be dirty), else left to the planner."""
    return F.broadcast(table) if table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else table


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str,
                      drop_null_values: bool = False, weight: str | None = None) -> DataFrame:
    """Peer table: one row per (keys, value) with ``_c`` rows (or their summed
    ``weight``), ``_before`` earlier in the same key group, and ``_n`` in the group."""
    src = df.where(F.col(value).isNotNull()) if drop_null_values else df
    freq = src.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    return running_before(freq, keys, value, "_c")


def percent_ranks(df: DataFrame, value: str, out_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, value): (rows before the value's peers) / (group rows
    - 1), 0 for one-row groups.  NULL values rank first, as in the SQL window."""
    freq = value_frequencies(df, keys, value)
    pr = F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(
        F.col("_before").cast("double") / (F.col("_n") - 1).cast("double"))
    return freq.select(*keys, value, pr.alias(out_col))


def percent_rank(df: DataFrame, value: str, out_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """W-3 / W-4: SQL ``PERCENT_RANK() OVER (PARTITION BY keys ORDER BY value)``."""
    return _null_safe_join(df, percent_ranks(df, value, out_col, keys), [*keys, value])


def average_rank_pct(df: DataFrame, value: str, out_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """W-6: pandas ``rank(pct=True)`` (average method): mean 1-based rank of the
    value's peers divided by the group's non-null count.  NULL value or NULL
    key -> NULL: pandas has no group for a missing key."""
    named = df
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    freq = value_frequencies(named, keys, value, drop_null_values=True)
    pct = ((F.col("_before").cast("double") + (F.col("_c") + 1) / 2.0) / F.col("_n").cast("double"))
    ranked = lookup(freq.select(*keys, value, pct.alias(out_col)))
    return _null_safe_join(df, ranked, [*keys, value], how="left")


def _ntile_of(pos: Column, n: Column, k: int) -> Column:
    """1-based NTILE bucket of a 0-based position among n rows (SQL semantics:
    the first n mod k buckets hold one extra row)."""
    q = (n / k).cast("bigint")
    r = n % k
    big = r * (q + 1)
    return (F.when(pos < big, F.floor(pos / (q + 1)))
             .otherwise(r + F.floor((pos - big) / F.greatest(q, F.lit(1))))).cast("bigint") + 1


def ntile(df: DataFrame, value: str, k: int, out_col: str, tie_col: str = "loan_id") -> DataFrame:
    """W-5: ``NTILE(k) OVER (ORDER BY value, tie_col)`` over the whole frame.

    The frequency table tells on which value each of the k-1 tiles begins and at which of
    its rows; ``selection`` finds that row's ``tie_col`` (a whole number that identifies
    rows).  A row's tile is the number of beginnings it has reached: a projection, so a
    value held by a third of the rows is not gathered anywhere."""
    freq = value_frequencies(df, [], value)
    first, last = (_ntile_of(p, F.col("_n"), k) for p in (F.greatest(F.col("_before") - 1, F.lit(0)), F.col("_before") + F.col("_c") - 1))
    holders = freq.where(first < last).select(value, "_before", "_c", "_n").collect()  # values on which a tile begins: k-1 at most
    starts = []
    for x, before, c, n in holders:
        q, r = divmod(n, k)
        starts += [(x, p - before) for p in (j * q + min(j, r) for j in range(1, k)) if before <= p < before + c and p < n]
    starts = list(dict.fromkeys(starts))
    inside = [s for s in starts if s[1]]
    at = dict(zip(inside, thresholds(df.select(value, tie_col), value, [tie_col], inside))) if inside else {}
    kind, v = df.schema[value].dataType, F.col(value)
    tile = F.lit(1).cast("bigint")
    for start in starts:
        x = F.lit(start[0]).cast(kind)
        later = v.isNotNull() if start[0] is None else F.coalesce(v > x, F.lit(False))
        same = v.eqNullSafe(x) & (behind([tie_col], at[start]) if start[1] else F.lit(True))
        tile = tile + (later | same).cast("bigint")
    return df.withColumn(out_col, tile)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles (NumPy/pandas default) of the non-null
    values (each ``weight`` times if given), exact, from the frequency table.
    Returns one row with columns ``q0, q1, ...`` (DOUBLE)."""
    freq = value_frequencies(df, [], value, drop_null_values=True, weight=weight).select(
        F.col(value).cast("double").alias("_v"), "_before", "_c", "_n")
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo_i = F.floor(h)
        frac = h - lo_i
        hi_i = F.least(lo_i + 1, F.col("_n") - 1)
        covers_lo = (F.col("_before") <= lo_i) & (lo_i < F.col("_before") + F.col("_c"))
        covers_hi = (F.col("_before") <= hi_i) & (hi_i < F.col("_before") + F.col("_c"))
        x_lo = F.max(F.when(covers_lo, F.col("_v")))
        x_hi = F.max(F.when(covers_hi, F.col("_v")))
        t = F.max(F.when(covers_lo, frac))
        aggs.append((x_lo + (x_hi - x_lo) * t).alias(f"q{i}"))
    return freq.agg(*aggs)


def quantile_edges(source: DataFrame, value: str, k: int, weight: str | None = None) -> list[float]:
    """The k+1 qcut edges (quantiles 0, 1/k, ..., 1) of ``value``: a bounded
    summary, fetched to the driver once like Spark ML's QuantileDiscretizer."""
    probs = [i / k for i in range(k + 1)]
    row = exact_quantiles(source, value, probs, weight).first()
    return [row[f"q{i}"] for i in range(k + 1)]


def quantile_cut(df: DataFrame, value: str, labels: Sequence[str], out_col: str,
                 source: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """W-7 / W-8: ``pandas.qcut(value, len(labels), labels)``.

    Bins are (edge_i, edge_i+1], the lowest edge included; equal edges raise
    ``ValueError`` as pandas does.  NULL -> NULL.  ``source`` (default the
    ``value`` column of ``df``) is a narrow frame the edges are computed from,
    each of its rows standing for ``weight`` rows if given.
    """
    k = len(labels)
    edges = quantile_edges(source if source is not None else df.select(value), value, k, weight)
    if any(e is None for e in edges):
        raise ValueError(f"quantile_cut({value}): no non-null values")
    if any(not (a < b) for a, b in zip(edges, edges[1:])):
        raise ValueError(f"quantile_cut({value}): bin edges must be unique: {edges}")
    x = F.col(value).cast("double")
    tier = F.lit(labels[-1])
    for i in range(k - 1, 0, -1):
        tier = F.when(x <= F.lit(edges[i]), F.lit(labels[i - 1])).otherwise(tier)
    return df.withColumn(out_col, F.when(x.isNotNull(), tier))


def kth_smallest(table: DataFrame, value: str, k: Column) -> DataFrame:
    """T-4: the element at 0-based offset ``k`` of ``value`` ascending
    (``ORDER BY value LIMIT 1 OFFSET k``) over a group-grain table."""
    w = Window.orderBy(F.col(value).asc_nulls_first())
    return (table.withColumn("_rn", F.row_number().over(w))
                 .where(F.col("_rn") == k + 1).select(value))


def upper_median(table: DataFrame, value: str) -> DataFrame:
    """Upper-middle element: offset n div 2 (the reference's SQL median)."""
    n = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kth_smallest(table, value, F.floor(n / 2))


def competition_rank_desc(table: DataFrame, value: str, out_col: str) -> DataFrame:
    """W-2: ``RANK() OVER (ORDER BY value DESC)`` on a group-grain table."""
    return table.withColumn(out_col, F.rank().over(Window.orderBy(F.col(value).desc_nulls_last())).cast("bigint"))
