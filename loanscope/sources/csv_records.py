"""Records of CSV text files whose quoted values may hold newlines, read by split.

Spark's own reader either takes a newline for the end of a record, and can then split a
file, or follows the quotes from the file's first byte, and then one task reads the
file.  Here lines are read by split and the quotes are followed over them as functions:
each line says in which state (inside a quoted value or outside) it ends if it begins
outside, and if it begins inside.  Such functions compose: over the lines of a split
(a window of one split each), and over the splits of a file (one row a split).  With the
state known where each line begins, lines that begin and end outside are records as
they stand; only the lines of records with newlines are gathered, by record.

The function of a line is exact for the quoting rules of the reader: a quote opens a
value only as its first character, a doubled quote stands for one, and what follows a
closing quote is taken as it is up to the next delimiter.  Lines end with LF or CR LF;
a CR inside a value stays.  Blank records are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import lookup

# Whole values, then one that is open at the end.  Possessive: no way back, no deep stack.
_OPEN = r'(?s)^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+$'


def location(file: str) -> str:
    """The path to read a file by; as metadata it comes with characters encoded."""
    return unquote(file)


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``start`` (of the split), ``at`` (rises in a split) and ``line``."""
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def ends_inside(line: Column, begins_inside: bool = False) -> Column:
    """Whether a line ends inside a quoted value."""
    quoted = F.contains(line, F.lit('"'))
    if begins_inside:
        return F.when(quoted, F.concat(F.lit('"'), line).rlike(_OPEN)).otherwise(F.lit(True))
    return F.when(quoted, line.rlike(_OPEN)).otherwise(F.lit(False))


def surveyed(spark: SparkSession, path: str | Sequence[str], quotes: bool = True) -> DataFrame:
    """One row for each file that has a record: its first line ``head`` and whether
    some value has a newline (``broken``).  One job for all files.

    Until a line that begins outside ends inside, every line begins outside: so a file
    has a newline inside a value if and only if one of its lines, taken alone, ends inside."""
    own = lines(spark, path)
    # A set, whose aggregate hashes: beside a maximum the text of ``head`` would be kept by
    # an aggregate that sorts, and spills, all lines of a task.
    broken = F.array_contains(F.collect_set(ends_inside(F.col("line")) if quotes else F.lit(False)), True)
    head = F.min_by("line", F.struct("start", "at"))
    return own.where("trim(replace(line, '\\r', '')) != ''").groupBy("file").agg(head.alias("head"), broken.alias("broken"))


def _composed(order: Column, by: Sequence[str]) -> tuple[Column, Column]:
    """The function of all rows before each one, in its window: the state it is known to
    end in (null: it depends on the first) and whether it swaps the states since.
    Rows have ``ends`` (from outside) and ``stays`` (from inside)."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("ends") == F.col("stays")
    swaps = F.coalesce(F.sum((F.col("ends") & ~F.col("stays")).cast("long")).over(before), F.lit(0))
    last = F.last(F.when(fixed, F.struct(F.col("ends").alias("state"), "swaps")), ignorenulls=True).over(before)
    return swaps, last


def _state(first: Column) -> Column:
    """State before a row, from its ``swaps``, ``last`` and the first row's state."""
    since = F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))
    return F.coalesce(F.col("last.state"), first) != (since % 2 == 1)


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``start`` and ``at`` of a record's first line, and the ``record``."""
    own = lines(spark, path).withColumns({"ends": ends_inside(F.col("line")), "stays": ends_inside(F.col("line"), True)})
    split = ["file", "start"]
    swaps, last = _composed(F.col("at"), split)
    own = own.withColumn("swaps", swaps).withColumn("last", last)
    # A split as one function: what its last line makes of the lines before it.
    from_outside = lambda first: F.when(_state(F.lit(first)), F.col("stays")).otherwise(F.col("ends"))
    splits = own.groupBy(*split).agg(F.max_by(F.struct(from_outside(False).alias("ends"), from_outside(True).alias("stays")), "at").alias("f"))
    splits = splits.select(*split, "f.*")
    swaps, last = _composed(F.col("start"), ["file"])
    splits = splits.withColumn("swaps", swaps).withColumn("last", last).select(*split, _state(F.lit(False)).alias("first"))
    own = own.join(lookup(splits), split).withColumn("inside", _state(F.col("first")))
    own = own.withColumn("open", F.when(F.col("inside"), F.col("stays")).otherwise(F.col("ends")))
    whole = own.where("not inside and not open").select("file", "start", "at", F.col("line").alias("record"))
    # The rest, by the place of the line that opened the record: in its own split, or in an earlier one.
    rest = own.where("inside or open").select("file", "start", "at", "line", "inside")
    opener = F.when(~F.col("inside"), F.struct("start", "at"))
    here = Window.partitionBy(*split).orderBy("at")
    rest = rest.withColumn("opener", F.last(opener, ignorenulls=True).over(here))
    tails = rest.groupBy(*split).agg(F.max(opener).alias("o"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*split, F.last("o", ignorenulls=True).over(earlier).alias("carried"))
    rest = rest.join(lookup(tails), split).withColumn("opener", F.coalesce("opener", "carried"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "at", "line")))
    joined = (rest.groupBy("file", "opener").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("record"))
                  .select("file", "opener.start", "opener.at", "record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("trim(record) != ''")
