"""Reading the document tables and the settings that Arrow batches need."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.session import stage, stage_folder

__all__ = ["arrow_batches", "discard", "discard_folder", "documents", "release", "shared_path", "stage", "table", "text_bytes"]

#: Rows and bytes of an Arrow batch sent to Python workers: a task holds a few of these at a time.
BATCH_ROWS, BATCH_BYTES = 1200, 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the batches by rows and by bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path for files of one run, in the folder that all executors share."""
    return f"{stage_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver drops their plans. The last
    job's plan is kept until another job has run, so a small one goes first."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later job reads: what was made of them is staged itself."""
    for df in staged:
        if files := df.inputFiles():
            discard_folder(df.sparkSession, files[0].rpartition("/")[0])


def discard_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
