"""SparkSession helpers: config for analytics jobs and a shared checkpoint dir."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Delete checkpoint files once their DataFrames are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app_name: str = "loanscope",
                  extra: dict | None = None, input_bytes: int | None = None, cores: int = 8) -> SparkSession:
    """A session for an input of ``input_bytes`` (see :func:`scale_conf`) or, for
    small local work, with a plain number of shuffle partitions."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if input_bytes is not None:
        conf.update(scale_conf(input_bytes, cores))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing that follows the input size.

    Scan splits and the initial shuffle fan-out aim at ~``target_partition_bytes``
    per task (so a task's sort/aggregate buffers fit executor memory at any
    scale), never fewer than 2 tasks per core; AQE then coalesces small
    partitions and splits skewed join partitions at runtime.  At 100 TB this
    gives ~400k shuffle partitions before coalescing; locally, a few dozen.
    """
    by_size = max(1, input_bytes // target_partition_bytes)
    partitions = int(max(2 * cores, by_size))
    # Row groups are the unit a Parquet scan can split on: 128 MB at scale,
    # smaller when the whole input is small so stage tables still spread over
    # every core when read back.
    row_group = int(min(128 << 20, max(4 << 20, input_bytes // (4 * cores))))
    return {
        "spark.hadoop.parquet.block.size": str(row_group),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint dir.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it the executors would write to their own disks, so that
    raises.  Only a local master gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="loanscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint dir, unique to this application."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "loanscope", spark.sparkContext.applicationId, *parts])


def input_state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a folder's entries: what a result kept for the
    folder was made from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def parquet_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
