"""Rows at given positions of an order, found without sorting (W-5, ML-2).

Asked for the row at position ``p`` of a group, a pass counts the group's rows by the
leading bits of the order's column; the running count names the one prefix that holds the
position, and the next pass looks at that prefix alone, at its next bits.  A pass is a
partial aggregate of fixed size (``2 ** BITS`` counts a position and task), so a group with
a third of all rows costs no more than a scan, and nothing is ranked, sorted or moved.  When
a prefix holds few rows, those are fetched and the descent ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a pass; a full 64-bit column takes six passes.
BITS = 12
#: Rows a prefix may have to be fetched.
FEW = 4096
LEAST = -(1 << 63)


def _among(df: DataFrame, group: str, cells: list[tuple]) -> DataFrame:
    """Rows of ``df`` (``group`` and a long ``_x``) inside a cell (number, group value, lo, hi, shift)."""
    kind = df.schema[group].dataType
    table = df.sparkSession.createDataFrame(cells, T.StructType(
        [T.StructField("_j", T.IntegerType()), T.StructField("_g", kind), *[T.StructField(n, T.LongType()) for n in ("_lo", "_hi")],
         T.StructField("_s", T.IntegerType())]))
    wanted = reduce(lambda a, b: a | b, [F.col(group).eqNullSafe(F.lit(c[1]).cast(kind)) for c in {c[1]: c for c in cells}.values()])
    return df.where(wanted).join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_g")) & F.col("_x").between(F.col("_lo"), F.col("_hi")))


def _descend(df: DataFrame, group: str, asked: dict[int, tuple]) -> dict[int, tuple[int, int, int]]:
    """For each asked (group value, position): the value of ``_x`` there, how many rows of
    the group have a smaller one, and how many this one."""
    ends = {r[0]: (r[1], r[2]) for r in _among(df, group, [(j, g, LEAST, -LEAST - 1, 0) for j, (g, _) in asked.items()])
            .groupBy("_j").agg(F.min("_x"), F.max("_x")).collect()}
    cells = {j: (*ends[j], g, p, 0) for j, (g, p) in asked.items()}  # lo, hi, group, position inside, rows before
    found = {}
    while cells:
        shift = {j: max(0, (hi - lo).bit_length() - BITS) for j, (lo, hi, *_) in cells.items()}
        rows = _among(df, group, [(j, g, lo, hi, shift[j]) for j, (lo, hi, g, *_) in cells.items()])
        counts = rows.groupBy("_j", F.expr("shiftright(_x, _s)").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        counts = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy("_j").orderBy("_b")))  # 2 ** (BITS + 1) rows at most
        position = reduce(lambda e, j: e.when(F.col("_j") == j, cells[j][3]), cells, F.when(F.lit(False), 0))
        few = []
        for j, b, c, to in counts.where((F.col("_to") - F.col("_c") <= position) & (position < F.col("_to"))).select("_j", "_b", "_c", "_to").collect():
            lo, hi, g, p, before = cells.pop(j)
            lo, hi = max(lo, b << shift[j]), min(hi, (b + 1 << shift[j]) - 1)
            p, before = p - (to - c), before + to - c
            if lo == hi:
                found[j] = (lo, before, c)
            else:
                cells[j] = (lo, hi, g, p, before)
                if c <= FEW:
                    few.append(j)
        if few:
            near: dict[int, list] = {}
            for j, x in _among(df, group, [(j, cells[j][2], cells[j][0], cells[j][1], 0) for j in few]).select("_j", "_x").collect():
                near.setdefault(j, []).append(x)
            for j, xs in near.items():
                *_, p, before = cells.pop(j)
                x = sorted(xs)[p]
                found[j] = (x, before + sum(y < x for y in xs), xs.count(x))
    return found


def thresholds(df: DataFrame, group: str, cols: Sequence[str], wanted: Sequence[tuple]) -> list[tuple]:
    """For each wanted (group value, position): the values of ``cols`` (longs, NULL first)
    from which rows of that group are at the position or behind it.  Trailing columns
    that do not matter are left out; rows alike in all ``cols`` are not told apart."""
    out: list[tuple] = [()] * len(wanted)
    where = {j: (g, p) for j, (g, p) in enumerate(wanted)}
    for col in cols:
        # The columns fixed so far become part of the group: one descent for each of their values.
        by_prefix: dict[tuple, dict] = {}
        for j, asked in where.items():
            by_prefix.setdefault(out[j], {})[j] = asked
        where = {}
        for prefix, asked in by_prefix.items():
            rows = reduce(lambda d, cv: d.where(F.coalesce(F.col(cv[0]), F.lit(LEAST)) == cv[1]), zip(cols, prefix), df)
            found = _descend(rows.select(group, F.coalesce(F.col(col).cast("long"), F.lit(LEAST)).alias("_x")), group, asked)
            for j, (x, before, _) in found.items():
                out[j] = (*prefix, x)
                if asked[j][1] > before:
                    where[j] = (asked[j][0], asked[j][1] - before)
        if not where:
            break
    return out


def behind(cols: Sequence[str], threshold: tuple):
    """Whether a row is at the threshold or behind it, in the order of ``cols``."""
    at = [F.coalesce(F.col(c).cast("long"), F.lit(LEAST)) for c in cols]
    out = at[len(threshold) - 1] >= F.lit(threshold[-1])
    for c, x in reversed(list(zip(at, threshold[:-1]))):
        out = (c > F.lit(x)) | ((c == F.lit(x)) & out)
    return out
