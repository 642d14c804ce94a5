"""Tap events: reading, filtering, pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.functions.numeric import to_long

# The columns every later step may use.
EVENT_COLUMNS = ("TRAN_DATE", "TRANSPORT_TYPE_ID", "PLACE_ID", "VALIDATION_MODE", "APP_ID")
EVENT_IDS = ("TRANSPORT_TYPE_ID", "PLACE_ID", "VALIDATION_MODE")


def read_events_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Delimited event files with a header; types are set by rule, so the data is never scanned to infer them.

    Columns are found by name. Columns beyond the known ones pass through as text.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return typed_events(raw)


def typed_events(raw: DataFrame) -> DataFrame:
    typed = {c: to_long(F.col(c)) for c in EVENT_IDS if c in raw.columns}
    if "TRAN_DATE" in raw.columns:
        typed["TRAN_DATE"] = F.col("TRAN_DATE").try_cast("timestamp_ntz")
    return raw.withColumns(typed)


def read_events_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def filter_terms(
    transport_type_id: int | None = None,
    place_ids: tuple[int, ...] = (),
    validation_modes: tuple[int, ...] = (),
) -> list[str]:
    """The event filter as SQL predicates, one per given setting."""
    terms = []
    if transport_type_id is not None:
        terms.append(f"TRANSPORT_TYPE_ID = {int(transport_type_id)}")
    for column, wanted in (("PLACE_ID", place_ids), ("VALIDATION_MODE", validation_modes)):
        if wanted:
            terms.append(f"{column} IN ({', '.join(str(int(v)) for v in wanted)})")
    return terms


def filter_events(events: DataFrame, terms: list[str]) -> DataFrame:
    """Keep the known columns and the rows that meet every predicate; no predicate keeps all rows."""
    kept = events.select(*[c for c in EVENT_COLUMNS if c in events.columns])
    return reduce(lambda df, term: df.filter(F.expr(term)), terms, kept)


def timed_events(events: DataFrame) -> DataFrame:
    """Drop events whose time is missing or unreadable."""
    parsed = events.withColumn("TRAN_DATE", F.col("TRAN_DATE").try_cast("timestamp_ntz"))
    return parsed.filter(F.col("TRAN_DATE").isNotNull())


def at_places(events: DataFrame, places: DataFrame) -> DataFrame:
    """Events at a set of places, for sets too long for an IN list."""
    return events.join(places.select("PLACE_ID"), "PLACE_ID", "left_semi")
