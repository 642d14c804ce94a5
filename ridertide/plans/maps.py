"""Jobs that write the station maps and the bucket table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridertide.config import NetworkConfig
from ridertide.operators.buckets import bucket_table, station_counts
from ridertide.operators.stations import labelled_station_maps, station_maps, station_summary
from ridertide.sources.events import filter_events, filter_terms, timed_events
from ridertide.sources.tables import write_buckets, write_csv_tables


def save_network_maps(places: DataFrame, cfg: NetworkConfig, folder: str) -> dict[str, str]:
    """Place map and station table of the configured scope."""
    stations, mapped = station_maps(places, cfg)
    return write_csv_tables({"network_places": mapped, "network_stations": stations}, folder)


def save_labelled_maps(
    places: DataFrame, line_short: str, folder: str, transport_type_id: int | None = 1, include_test: bool = False
) -> dict[str, str]:
    """The four reviewable tables: all lines and one line, by place and by station."""
    return write_csv_tables(labelled_station_maps(places, line_short, transport_type_id, include_test), folder)


def save_bucket_table(events: DataFrame, places: DataFrame, cfg: NetworkConfig, path: str) -> None:
    """Station buckets from events and a place map (labelled or not), ordered for pruning inside each file."""
    terms = filter_terms(cfg.transport_type_id, validation_modes=cfg.validation_modes)
    counts = station_counts(timed_events(filter_events(events, terms)), places, cfg)
    table = bucket_table(counts, station_summary(places), cfg)
    write_buckets(table, path, ["LN_CODE", "ST_CODE", cfg.time_col])


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A saved place map, ids as numbers."""
    saved = spark.read.option("header", True).csv(path)
    ids = [c for c in ("PLACE_ID", "TYPE_ID", "ST_CODE", "LN_CODE") if c in saved.columns]
    return saved.withColumns({c: saved[c].try_cast("bigint") for c in ids})
