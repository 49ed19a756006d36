"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Row group of staged tables in bytes: writers and readers hold one a task.
ROW_GROUP = 16 << 20
#: Bytes of one Arrow batch: whole texts of 10,000 rows would be several times as many.
BATCH_BYTES = 8 << 20
#: Text handled at once by the numpy kernels, in characters.
SLICE_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: later
    jobs, and retries after a lost executor, see the same rows in the same files."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column | str) -> list[Column]:
    """128 bits of a text's content as two longs ``_t1``, ``_t2``."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(F.lit(1), text).alias("_t1"), F.xxhash64(F.lit(2), text, F.lit(3)).alias("_t2")]


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Words of the filter that spares rows a shuffle: 16 million bits, at most 2 MB.
FILTER_WORDS = 1 << 18


def screened(df: DataFrame, key: str, keys: DataFrame, keys_key: str, flag: str) -> DataFrame:
    """``df`` with ``flag``: false if its ``key`` (a hash) is for sure not among
    those of ``keys``, true if it may be.  A bit table of fixed size, broadcast;
    with too many keys it says true too often, which costs a shuffle, not a result."""
    word = lambda c: F.pmod(F.col(c), F.lit(FILTER_WORDS)).cast("int")
    place = lambda c: f"cast(pmod(shiftright({c}, 20), 64) as int)"
    bits = keys.select(word(keys_key).alias(f"{flag}w"), F.expr(f"shiftleft(1L, {place(keys_key)})").alias(f"{flag}b"))
    bits = bits.groupBy(f"{flag}w").agg(F.bit_or(f"{flag}b").alias(f"{flag}b"))
    out = df.withColumn(f"{flag}w", word(key)).join(F.broadcast(bits), f"{flag}w", "left")
    hit = F.expr(f"(shiftright({flag}b, {place(key)}) & 1L) = 1L")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(f"{flag}w", f"{flag}b")


def slices(batch: pa.RecordBatch, column: int = 0, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of rows holding about ``limit`` characters at
    most; a longer single text is a run of its own, never cut."""
    start, run, size = 0, [], 0
    col = batch.column(column)
    for i in range(batch.num_rows):
        t = col[i].as_py()
        n = len(t) if t else 0
        if run and size + n > limit:
            yield start, run
            start, run, size = i, [], 0
        run.append(t)
        size += n
    if run:
        yield start, run


#: Functions that empty the modules' caches, called when a task begins and ends: workers
#: are reused, memory is not theirs to keep.
REMEMBERED: list = []


def release(keep=None) -> None:
    """Empty the modules' caches, but for the one that ``keep`` empties, and give freed
    memory back to the system."""
    for clear in REMEMBERED:
        if clear is not keep:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send tasks Arrow batches of ``BATCH_BYTES`` at most (a row that is
    longer by itself goes alone); a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes  # a setting may have a unit
    if not 0 < bytes_of(spark.conf.get(name, "1g").replace("-1b", "1g")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn, schema: str, keep=None) -> DataFrame:
    """``mapInArrow`` for ``fn()(batch) -> batches``, built once in each task.  ``keep``: the
    function of ``REMEMBERED`` whose cache outlives a task, until one without it comes."""
    bounded_batches(df.sparkSession)

    def run(it: Iterable[pa.RecordBatch]):
        release(keep)
        step = fn()
        for b in it:
            yield from step(b)
        step = None
        release(keep)
    return df.mapInArrow(run, schema)
