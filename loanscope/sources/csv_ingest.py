"""CSV ingest of raw loan records (SRC-1..3, S14).

Columns are bound by the names in each file's own header: files may order them
differently, lack optional ones or bring more, which are kept as text.  Every
column is read as text (no schema inference), pandas' missing-value tokens become
NULL in one projection, and numeric columns are parsed with ``try_cast``
(unparseable -> NULL, never an error).

``loan_id`` follows ingest order, files by name and rows by their place in the file,
however Spark deals the splits: the file's number in the high bits, below them the
split's byte offset plus the number of the row (or of its first line) in its task.  (A row or line has a byte
at least, so none reaches the next split's offset.)

``raw_key`` is a digest of the duplicate-defining columns as read, before any
rounding: numbers by their value, unparseable text by its characters.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEDUP_KEYS, RAW_SCHEMA
from ..session import scratch_path
from . import csv_records

# The tokens pandas' CSV reader treats as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

# loan_id: 25 bits of file number above 38 bits of place (256 GB a file).
PLACE_BITS = 38
MAX_FILES = 1 << 25
# File numbers are broadcast up to this many files, joined beyond.
BROADCAST_FILES = 100_000
# Records of a staged file that is compressed: one task reads such a file.
COMPRESSED_RECORDS = 250_000


def _na_to_null(c: str) -> F.Column:
    col = F.col(f"`{c}`")
    return F.when(col.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def raw_key() -> F.Column:
    """Digest of the duplicate-defining columns of a text frame."""
    parts = []
    for c in DEDUP_KEYS:
        v = _na_to_null(c)
        if not isinstance(RAW_SCHEMA[c].dataType, T.StringType):
            v = F.coalesce(v.try_cast("double").cast("string"), v)
        parts.append(F.coalesce(F.concat(F.lit("="), v), F.lit("0")))
    return F.md5(F.concat_ws("\x1f", *parts))


def typed_raw(text: DataFrame, loan_id: F.Column) -> DataFrame:
    """Text columns -> the raw schema (NA tokens -> NULL, try_cast numerics), the
    columns beyond it as text, and ``raw_key``."""
    cols = [loan_id.alias("loan_id")]
    for f in RAW_SCHEMA.fields:
        v = _na_to_null(f.name)
        cols.append((v if isinstance(f.dataType, T.StringType) else v.try_cast(f.dataType)).alias(f.name))
    known = {f.name for f in RAW_SCHEMA.fields} | {"loan_id", "raw_key"}
    cols += [_na_to_null(c).alias(c) for c in text.columns if c not in known and not c.startswith("__")]
    return text.select(*cols, raw_key().alias("raw_key"))


class Source(NamedTuple):
    """A file: its header and, if values have newlines, the place of its first record."""
    path: str
    names: tuple[str, ...]
    broken: bool
    start: int | None = None
    at: int | None = None


def _names(head: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([head.lstrip("\ufeff").rstrip("\r")])))


def sources(spark: SparkSession, path: str | Sequence[str], multiline: bool = True) -> tuple[list[Source], DataFrame | None]:
    """Every file that is not empty, by name, and the records of those whose values have
    newlines.  One job reads all first lines and looks for open quotes; a second one, only
    where it found some, cuts the records of those files and writes them once."""
    try:
        found = csv_records.surveyed(spark, path, quotes=multiline).collect()  # a row for each file
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} not found") from e
        raise
    out, broken, records = [Source(r.file, _names(r.head), False) for r in found if not r.broken], [r.file for r in found if r.broken], None
    if broken:
        kept = scratch_path(spark, "csv_records", uuid.uuid4().hex)
        csv_records.records(spark, [csv_records.location(f) for f in broken]).write.parquet(kept)
        records = spark.read.parquet(kept)
        place = F.struct("start", "at")
        heads = records.groupBy("file").agg(F.min_by(F.struct("record", "start", "at"), place).alias("h")).select("file", "h.*")
        out += [Source(r.file, _names(r.record), True, r.start, r.at) for r in heads.collect()]
    return sorted(out), records


# The reader's rules; the same ones parse a record that was cut beforehand.
_OPTIONS = {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}


def read_raw_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = True, first_file: int = 0) -> DataFrame:
    """SRC-1/2: headed CSV -> typed raw frame, columns by name.

    ``multiline`` (the default) takes quoted newlines for part of their value, as pandas
    does; without it a newline ends the record.  Files are split either way: those
    without a quoted newline by Spark's reader, the others by :mod:`csv_records`."""
    found, records = sources(spark, path, multiline)
    if not found:
        raise ValueError(f"{path}: no header")
    if first_file + len(found) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files")
    by_header: dict[tuple, list[Source]] = {}
    for s in found:
        missing = [f.name for f in RAW_SCHEMA.fields if f.name not in s.names]
        if missing:
            raise ValueError(f"{s.path}: no column {', '.join(missing)}")
        by_header.setdefault((s.names, s.broken), []).append(s)
    groups = {key: i for i, key in enumerate(by_header)}
    files = spark.createDataFrame([(s.path, first_file + i, groups[s.names, s.broken], s.start, s.at) for i, s in enumerate(found)],
                                  "__file string, __no long, __group int, __head_start long, __head_at long")
    files = F.broadcast(files) if len(found) <= BROADCAST_FILES else files
    if records is not None:
        records = (records.join(files, F.col("file") == F.col("__file"))
                          .where("start != __head_start or at != __head_at"))
    frames = []
    for (names, broken), own in by_header.items():
        # Repeated names get their place, so that each column can be addressed.
        unique = [n if names.count(n) == 1 else f"{n}_{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
        if broken:
            # Under names of their own: a header may have any.
            plain = ", ".join(f"c{i} string" for i in range(len(unique)))
            cut = records.where(F.col("__group") == groups[names, broken])
            cut = cut.select("__file", "start", "at", F.from_csv("record", plain, _OPTIONS | {"multiLine": "true"}).alias("r"))
            frames.append(cut.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(unique)], "__file",
                                     F.col("start").alias("__start"), F.col("at").alias("__row")))
            continue
        text = spark.read.schema(schema).options(header=True, **_OPTIONS).csv([csv_records.location(s.path) for s in own])
        frames.append(text.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                                  F.monotonically_increasing_id().alias("__row")))
    text = frames[0]
    for f in frames[1:]:
        text = text.unionByName(f, allowMissingColumns=True)
    text = text.join(files.select("__file", "__no"), "__file")
    place = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return typed_raw(text, F.shiftleft("__no", PLACE_BITS) + place)


def ingest_csv(spark: SparkSession, path: str, out_path: str, multiline: bool = True) -> int:
    """SRC-1/3/5: CSV -> Parquet ``loans_raw`` (overwrite); returns the row
    count, answered from the written Parquet footers (no second CSV pass).

    (``DataFrame.observe`` would count during the write, but once a session
    holds an observation, fitted ML models that keep a training summary can
    no longer be serialised in that session.)"""
    # Snappy finds nothing in the digests of ``raw_key``, which are hex text.
    read_raw_csv(spark, path, multiline).write.mode("overwrite").option("compression", "zstd").parquet(out_path)
    return spark.read.parquet(out_path).count()


def write_raw_csv(raw: DataFrame, path: str, compressed: bool = False) -> None:
    """Write raw records as headed CSV text (used to stage CSV inputs), in plain files
    that can be split, or by gzip in files of ``COMPRESSED_RECORDS`` at most."""
    cols = [F.col(f.name).cast("string").alias(f.name) for f in RAW_SCHEMA.fields]
    if "audit_note" in raw.columns:
        cols.append(F.col("audit_note"))
    how = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": COMPRESSED_RECORDS} if compressed else {}
    (raw.select(*cols).write.mode("overwrite").options(**how)
        .option("header", True).option("quoteAll", True).option("escape", '"')
        .option("nullValue", "").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))
