"""Named tables that other applications read, and that are replaced as a whole (SRC-5).

A table is a folder.  Every rebuild writes Parquet into a new folder beside the ones
before; only when that is complete, an empty file in ``_current`` gives the new folder's
number and name, and the file of the highest number tells readers where the table is.
Creating that file is the switch: a reader sees the old table or the new one, whole, a
rebuild that fails leaves the old one, and of two rebuilds at once one is the later.
Nothing is renamed, so stores without renames will do.

Files of former versions stay until :func:`vacuum`, so jobs that read them go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Version(NamedTuple):
    number: int
    name: str
    state: str


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, place = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def versions(spark: SparkSession, folder: str) -> list[Version]:
    """The complete versions of a table, the current one last."""
    found = [n.split(".") for n in _names(spark, f"{folder}/_current") if n[0].isdigit()]
    return sorted(Version(int(n), name, state) for n, name, state in found)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it is now."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"{folder} has no table")
    return spark.read.parquet(f"{folder}/{known[-1].name}")


def replace(df: DataFrame, folder: str, partition_by: Sequence[str] = (), state: str = "") -> DataFrame:
    """Write ``df`` as the table's next version and switch to it.  ``state`` (letters and
    digits) may say what it was made from."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder}/{name}")
    number = max([0, *(v.number for v in versions(spark, folder))]) + 1
    fs, place = _at(spark, f"{folder}/_current/{number:012d}.{name}.{state}")
    fs.create(place, False).close()
    return spark.read.parquet(f"{folder}/{name}")


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete all versions but the ``keep`` last (one at least), and what failed rebuilds
    left; not while a rebuild runs.  Returns the names of the folders that went."""
    known = versions(spark, folder)
    for v in known[:-max(keep, 1)]:
        fs, place = _at(spark, f"{folder}/_current/{v.number:012d}.{v.name}.{v.state}")
        fs.delete(place, False)
    kept = {v.name for v in known[-max(keep, 1):]}
    gone = [n for n in _names(spark, folder) if n.startswith("v-") and n not in kept]
    for n in gone:
        fs, place = _at(spark, f"{folder}/{n}")
        fs.delete(place, True)
    return gone
