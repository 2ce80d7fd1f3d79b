"""Audits of workbooks as they arrive, with the state of findings kept from run to run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrid.operators.algebra import cross_run, merged_history

FILES = "path string, modificationTime timestamp, length long, content binary"
HISTORY = "fingerprint string, status string, times_closed int"


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of their bytes."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)


def with_history(spark: SparkSession, path: str) -> DataFrame:
    """The history of the last run; none yet is an empty one."""
    last = f"{path}/last"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], HISTORY)
    at = spark.read.text(last).first()[0]
    return spark.read.schema(HISTORY).parquet(f"{path}/{at}")


def keep_history(history: DataFrame, path: str, run: int) -> None:
    """Writes history beside the earlier ones and points to it; a run that is done again writes the same folder."""
    history.write.mode("overwrite").parquet(f"{path}/run={run}")
    history.sparkSession.createDataFrame([(f"run={run}",)], "at string").coalesce(1).write.mode("overwrite").text(f"{path}/last")


def audit_stream(files: DataFrame, findings_of: Callable[[DataFrame], DataFrame], history_path: str, checkpoint: str) -> StreamingQuery:
    """For each batch of files: findings (fingerprint and others), compared with history and merged into it."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        found = findings_of(rows)
        keep_history(merged_history(cross_run(found, with_history(spark, history_path))), history_path, batch_id)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finding_counts(findings: DataFrame, time: str = "found_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Findings of a stream by day and priority; those later than `late` don't count."""
    return findings.withWatermark(time, late).groupBy(F.window(time, window), "priority").agg(F.count("*").alias("findings"))
