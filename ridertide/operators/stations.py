"""Place and station maps, and the position of each station on its line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridertide.config import RING_LINE_CODE, RING_LINE_TEXT, NetworkConfig
from ridertide.functions.numeric import to_long
from ridertide.functions.text import contains_text, loose_station_key, station_key, station_label

# Column names of the maps.
STATION_NAMES = ("ST_CODE", "ST_NAME", "ST_NAME_SHORT", "LN_CODE", "LN_NAME", "LN_NAME_SHORT")
PLACE_MAP_COLUMNS = ("PLACE_ID", "PLACE_NAME", "TYPE_ID", *STATION_NAMES, "station_key")
LABELLED_COLUMNS = (
    "PLACE_ID",
    "CODE",
    "NAME",
    "TYPE_ID",
    "IS_PARKING",
    "IS_TEST",
    *STATION_NAMES,
    "station_key",
    "station_label",
)
STRUCTURE_COLUMNS = (
    "station_order_on_line_proxy",
    "line_n_stations",
    "station_order_norm",
    "is_ring_line_proxy",
    "distance_to_nearest_terminal_proxy",
    "distance_to_nearest_terminal_norm",
    "is_terminal_proxy",
)


def place_map(places: DataFrame, cfg: NetworkConfig) -> DataFrame:
    """Places in scope, keyed by (line, station): equal station names on two lines stay apart."""
    kept = places.filter(F.col("TYPE_ID") == cfg.place_type_id)
    if cfg.line_filter:
        kept = kept.filter(contains_text(F.col("LN_NAME_SHORT"), cfg.line_filter))
    if cfg.line_codes is not None:
        kept = kept.filter(F.col("LN_CODE").isin(*cfg.line_codes))
    kept = kept.dropna(subset=["PLACE_ID", "ST_CODE", "LN_CODE"])
    kept = kept.withColumn("station_key", station_key(F.col("LN_CODE"), F.col("ST_CODE")))
    return kept.select(*[c for c in PLACE_MAP_COLUMNS if c in kept.columns])


def labelled_place_map(
    places: DataFrame,
    transport_type_id: int | None = 1,
    line_short: str | None = None,
    include_test: bool = False,
) -> DataFrame:
    """Place map of the second reader: codes may be text, test places can be left out, stations carry a label."""
    kept = places
    if transport_type_id is not None:
        kept = kept.filter(F.col("TYPE_ID") == transport_type_id)
    if not include_test and "IS_TEST" in places.columns:
        kept = kept.filter(F.coalesce(to_long(F.col("IS_TEST")), F.lit(0)) == 0)
    if line_short is not None:
        kept = kept.filter(F.coalesce(F.col("LN_NAME_SHORT"), F.lit("")) == line_short)
    kept = kept.dropna(subset=["PLACE_ID", "ST_CODE", "LN_CODE"])
    label = station_label(F.col("ST_NAME"), F.col("ST_NAME_SHORT"), F.col("LN_NAME_SHORT"), F.col("LN_NAME"))
    kept = kept.withColumns(
        {
            "station_key": loose_station_key(F.col("LN_CODE"), F.col("ST_CODE")),
            "station_label": label,
            "PLACE_ID": to_long(F.col("PLACE_ID")),
        }
    )
    return kept.select(*[c for c in LABELLED_COLUMNS if c in kept.columns])


def station_summary(places: DataFrame) -> DataFrame:
    """One row per station: attributes of its first place, number of places, and their ids in order.

    The id list is as long as the reference file has places for the station; events play no part in it.
    """
    attributes = [c for c in (*STATION_NAMES, "station_label") if c in places.columns]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("PLACE_ID"))).alias(c) for c in attributes]
    ids = F.array_sort(F.collect_set("PLACE_ID"))
    return places.groupBy("station_key").agg(
        *first,
        F.count_distinct("PLACE_ID").alias("n_place_ids"),
        F.array_join(ids, ",").alias("place_ids"),
    )


def line_structure(stations: DataFrame) -> DataFrame:
    """Adds the order on the line by station code, the distance to the nearest end, and end and ring flags.

    A ring has no ends, so its stations are at distance zero.
    """
    out = stations.withColumns(
        {
            "ST_CODE": F.coalesce(to_long(F.col("ST_CODE")), F.lit(-1)),
            "LN_CODE": F.coalesce(to_long(F.col("LN_CODE")), F.lit(-1)),
        }
    )
    line = Window.partitionBy("LN_CODE")
    ordered = line.orderBy("ST_CODE", "station_key")
    out = out.withColumns(
        {
            "station_order_on_line_proxy": F.row_number().over(ordered).cast("bigint"),
            "line_n_stations": F.count(F.lit(1)).over(line),
        }
    )
    order, size = F.col("station_order_on_line_proxy"), F.col("line_n_stations")
    gaps = F.nullif(size - 1, F.lit(0))
    ring = (F.col("LN_CODE") == RING_LINE_CODE) | contains_text(
        F.concat_ws(" ", "LN_NAME_SHORT", "LN_NAME"), RING_LINE_TEXT
    )
    is_ring = ring.cast("int")
    distance = F.when(ring, F.lit(0.0)).otherwise(F.least(order - 1, size - order).cast("double"))
    at_end = ~ring & ((order == 1) | (order == size))
    return out.withColumns(
        {
            "station_order_norm": F.coalesce((order - 1) / gaps, F.lit(0.0)),
            "is_ring_line_proxy": is_ring,
            "distance_to_nearest_terminal_proxy": distance,
            "distance_to_nearest_terminal_norm": F.coalesce(distance / gaps, F.lit(0.0)),
            "is_terminal_proxy": at_end.cast("int"),
        }
    )


def station_maps(places: DataFrame, cfg: NetworkConfig) -> tuple[DataFrame, DataFrame]:
    """(stations with structure, place map) for the scope in the settings."""
    mapped = place_map(places, cfg)
    return line_structure(station_summary(mapped)), mapped


def labelled_station_maps(
    places: DataFrame, line_short: str, transport_type_id: int | None = 1, include_test: bool = False
) -> dict[str, DataFrame]:
    """The four reviewable map tables: all lines and one line, by place and by station."""
    everything = labelled_place_map(places, transport_type_id, None, include_test)
    line = labelled_place_map(places, transport_type_id, line_short, include_test)
    return {
        "all_places": everything,
        "all_stations": station_summary(everything),
        "line_places": line,
        "line_stations": station_summary(line),
    }


def map_profile(places: DataFrame) -> DataFrame:
    """Number of stations, places and lines in a place map."""
    return places.agg(
        F.count_distinct("station_key").alias("stations"),
        F.count_distinct("PLACE_ID").alias("places"),
        F.count_distinct("LN_CODE").alias("lines"),
    )
