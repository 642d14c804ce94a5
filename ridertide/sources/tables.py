"""Bucket tables, station metadata, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Bucket table with its time columns as zone-less timestamps."""
    buckets = spark.read.parquet(path)
    times = [c for c in buckets.columns if c.startswith("bucket_")]
    return buckets.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def read_station_metadata(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Station metadata by file suffix; no path gives None."""
    if not path:
        return None
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.option("header", True).csv(path)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported station metadata format: {path}")


def write_buckets(buckets: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Bucket table in the order of the given columns, over all files: each file holds one range of them.

    The ranges show in the files' statistics, so a filter on the leading columns skips the files of other ranges.
    ``files`` is the number of ranges; without it the session's number of shuffle partitions.
    """
    ranged = buckets.repartitionByRange(files, *order) if files else buckets.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as a CSV folder of its own; returns where each one went."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").option("header", True).csv(paths[name])
    return paths
