"""Incremental raw-table ingest with Structured Streaming.

The reference loads its CSV in chunks, replacing the table with the first
chunk and appending the rest.  Here new CSV files landing in a folder are
appended to the Parquet ``loans_raw`` table by a file-source stream.  Each
micro-batch is written by ``foreachBatch`` into its own ``batch_id=`` folder
(overwrite, so a replayed batch is idempotent), read by the same header-bound
reader as a batch ingest; ``loan_id`` numbers the files over all batches, so ids of
different batches never meet: each batch leaves the number of the next file beside the
stream's progress, whatever number of files a later run takes at once.  Progress lives
in a checkpoint folder under the shared checkpoint dir, so a restarted or retried run
neither skips nor duplicates files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.csv_ingest import read_raw_csv
from ..sources.csv_records import location


def start_csv_append(spark: SparkSession, csv_dir: str, table_path: str, checkpoint: str,
                     max_files_per_trigger: int = 1, available_now: bool = True, multiline: bool = True):
    """Start the stream; with ``available_now`` it processes every file present
    and stops (the batch-equivalent run)."""
    # The stream says which files are new; their columns are bound per file.
    # A row a file, whose content is not read here; empty files are not counted.
    arrived = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
               .option("maxFilesPerTrigger", max_files_per_trigger)
               .load(csv_dir).where("length > 0").select("_metadata.file_path"))

    counts = f"{checkpoint.rstrip('/')}/file_numbers"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # foreachBatch is at-least-once: a replayed batch overwrites its own
        # folder instead of appending twice, so the table stays exact.
        files = sorted(location(r.file_path) for r in batch.distinct().collect())  # max_files_per_trigger at most
        first = spark.read.schema("next_file long").parquet(f"{counts}/{batch_id - 1}").first().next_file if batch_id else 0
        if files:
            typed = read_raw_csv(spark, files, multiline, first_file=first)
            typed.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")
        spark.createDataFrame([(first + len(files),)], "next_file long").coalesce(1).write.mode("overwrite").parquet(f"{counts}/{batch_id}")

    writer = (arrived.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_csv_append(spark: SparkSession, csv_dir: str, table_path: str, checkpoint: str,
                   max_files_per_trigger: int = 1) -> DataFrame:
    q = start_csv_append(spark, csv_dir, table_path, checkpoint, max_files_per_trigger)
    q.awaitTermination()
    return spark.read.option("mergeSchema", True).parquet(table_path).drop("batch_id")
