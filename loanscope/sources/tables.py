"""Table access: raw loans, the materialised clean ``loans`` table, the scored view.

The clean loans with their flags are written once per application as Parquet under
the shared checkpoint folder (``loans`` is a view of that table) and every question
reads it back with column pruning and predicate pushdown.  Writing it also
cuts the lineage of the join + de-dup plan, so a lost executor re-reads Parquet
instead of recomputing the ingest.

Where the session names a folder in ``spark.loanscope.tables``, the tables are named
tables there instead (``named``): the next application reads them as they are, and they
are rebuilt and switched when the input's files have changed.
"""

from __future__ import annotations

import contextlib
import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import build_clean, score
from ..schema import CLEAN_COLUMNS, SCORED_EXTRA
from ..session import input_state, scratch_path
from . import fixture, named

#: Session setting: the folder of tables that outlive an application.
SHARED = "spark.loanscope.tables"

#: Bytes of stored table that one task of a build reads: the loans take ten times as
#: much in memory, where the de-dup sorts them, and splits of 128 MB spill.
BUILD_SPLIT = 32 << 20

_MATERIALISED: dict[tuple, str] = {}
# Re-entrant: building one table may materialise the table it is built from.
_LOCK = threading.RLock()


def raw_loans(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    """``loans_raw``: the ingested raw records, written once as Parquet."""
    if not materialise:
        return fixture.raw_loans(spark, sf_dir)
    return _materialise(spark, sf_dir, "loans_raw", lambda: fixture.raw_loans(spark, sf_dir))


@contextlib.contextmanager
def raw_loans_once(spark: SparkSession, sf_dir: str):
    """The raw records for a single read: the stored table where this application has it
    or keeps named tables, else their build itself, of which no copy is written."""
    if spark.conf.get(SHARED, None) or _key(spark, sf_dir, "loans_raw") in _MATERIALISED:
        yield raw_loans(spark, sf_dir)
    else:
        with _LOCK, _build_splits(spark), _freed_shuffles(spark):
            yield fixture.raw_loans(spark, sf_dir)


def clean_loans(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    """``loans``: filter + de-dup + parse of the raw table.  With ``materialise``
    it is a view of the stored scored table, which has every clean column."""
    if not materialise:
        return build_clean(raw_loans(spark, sf_dir))
    return scored_loans(spark, sf_dir).select(*CLEAN_COLUMNS)


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return (spark.sparkContext.applicationId, name, sf_dir, input_state(spark, sf_dir))


def _materialise(spark: SparkSession, sf_dir: str, name: str, build,
                 partition_by: tuple = ()) -> DataFrame:
    key = _key(spark, sf_dir, name)
    with _LOCK, _build_splits(spark):
        path = _build_once(spark, sf_dir, name, build, partition_by, key)
    return spark.read.parquet(path)


@contextlib.contextmanager
def _build_splits(spark: SparkSession):
    """Scan splits of ``BUILD_SPLIT`` at most; a smaller setting stays."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)  # a setting may have a unit
    spark.conf.set(name, str(min(size, BUILD_SPLIT)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession):
    """Shuffle files go when the query that wrote them ends, not when the driver happens
    to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _build_once(spark, sf_dir, name, build, partition_by, key) -> str:
    path = _MATERIALISED.get(key)
    if path is None:
        digest = lambda x: hashlib.sha1(repr(x).encode()).hexdigest()[:12]
        shared = spark.conf.get(SHARED, None)
        if shared:
            # Named by the input's place; the state of its files tells a table that is out of date.
            folder, state = f"{shared.rstrip('/')}/{name}_{digest(sf_dir)}", digest(key[2:])
            known = named.versions(spark, folder)
            if not known or known[-1].state != state:
                named.replace(build(), folder, partition_by, state)
            path = f"{folder}/{named.versions(spark, folder)[-1].name}"
        else:
            path = scratch_path(spark, f"{name}_{digest(key[2:])}")
            writer = build().write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
        _MATERIALISED[key] = path
    return path


def segmented_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored loans with risk/value segments, written once per application."""
    from ..operators.segments import build_segments
    # Partitioned like loans_scored: the outcome reports read completed loans only.
    return _materialise(spark, sf_dir, "segments",
                        lambda: build_segments(scored_loans(spark, sf_dir)),
                        partition_by=("is_completed",))


def scored_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loans_scored``: clean loans plus completed/default flags and issue year.

    The one stored copy of the clean loans, partitioned by ``is_completed`` (most
    questions read completed loans only: partition pruning skips the rest) and
    sorted by grade inside each task's files (a local sort that begins with the
    partition column, so the writer keeps it): grade predicates skip row groups
    by their min/max statistics."""
    df = _materialise(spark, sf_dir, "loans_scored",
                      lambda: score(build_clean(raw_loans(spark, sf_dir))).sortWithinPartitions("is_completed", "grade", "purpose"),
                      partition_by=("is_completed",))
    return df.select(*CLEAN_COLUMNS, *SCORED_EXTRA)


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """SRC-6: expose the stage tables to ``spark.sql`` as temp views
    (``loans_raw``, ``loans``, ``loans_scored``); replaced on every call."""
    views = {"loans_raw": raw_loans(spark, sf_dir), "loans": clean_loans(spark, sf_dir),
             "loans_scored": scored_loans(spark, sf_dir)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
