"""How the given tables stand for flow data: event row = tap, customer = place, nation = station, region = line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.config import RICH_CONTEXT, NetworkConfig, StationConfig, TreeParams
from ridertide.operators.buckets import series_counts, station_counts
from ridertide.operators.context import attach_context, attach_series_context
from ridertide.operators.features import network_frame, station_frame
from ridertide.operators.folds import clip_per_day, clip_per_segment, day_folds, fold_dates, fold_range
from ridertide.operators.forecasts import anchors, seasonal_naive
from ridertide.operators.stations import place_map, station_maps
from ridertide.session import stage
from ridertide.sources.weather import hourly_weather

# Three candidates as in the default grids, with few rounds: the defaults take hours in one process.
FEW_TREES = (TreeParams(8, 0.1, 3), TreeParams(12, 0.1, 4), TreeParams(16, 0.1, 4))

NETWORK = NetworkConfig(
    name="network_60m_180m",
    bucket_minutes=60,
    horizon_minutes=180,
    line_codes=None,
    tree_grid=FEW_TREES,
    top_k=2,
)
# One-level trees in one round: the splits and leaf values that SQL can repeat. Candidates differ in rows per leaf.
STUMPS = tuple(TreeParams(1, 0.1, 1, min_rows=n, exhaustive=True) for n in (1, 40, 150))
NETWORK_STUMPS = NETWORK.but(tree_grid=STUMPS)
STUMP_ROWS = 3
STATION = StationConfig(
    name="series_60m_180m",
    bucket_minutes=60,
    horizon_minutes=180,
    day_start_hour=3,
    place_ids=(),
    lag_minutes=(60, 120, 180, 240, 360, 720, 1440, 1500, 2880),
    rolling_minutes=(60, 120, 180, 240, 360),
    context_features=RICH_CONTEXT,
    tree_grid=FEW_TREES,
)

STATION_STUMPS = STATION.but(tree_grid=(TreeParams(1, 0.1, 1, min_rows=STUMP_ROWS, exhaustive=True),))

# A sequence window that stations starting after the first fold day are too short for.
LONG_WINDOW = 44

# Codes given to the event types.
EVENT_CODES = {"view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def taps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    mode = F.create_map(*[F.lit(x) for pair in EVENT_CODES.items() for x in pair])[F.col("event_type")]
    return events.select(
        F.col("ts").alias("TRAN_DATE"),
        F.lit(1).cast("bigint").alias("TRANSPORT_TYPE_ID"),
        F.col("user_id").alias("PLACE_ID"),
        mode.cast("bigint").alias("VALIDATION_MODE"),
        F.col("event_id").alias("APP_ID"),
    )


def place_reference(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, region = (table(spark, folder, n) for n in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("c_custkey").alias("PLACE_ID"),
        F.col("c_name").alias("PLACE_NAME"),
        F.col("c_mktsegment").alias("CODE"),
        F.col("c_name").alias("NAME"),
        F.lit(1).alias("TYPE_ID"),
        F.lit(0).alias("IS_PARKING"),
        F.lit(0).alias("IS_TEST"),
        F.col("n_nationkey").cast("bigint").alias("ST_CODE"),
        F.col("n_name").alias("ST_NAME"),
        F.col("n_name").alias("ST_NAME_SHORT"),
        F.col("r_regionkey").cast("bigint").alias("LN_CODE"),
        F.col("r_name").alias("LN_NAME"),
        F.col("r_name").alias("LN_NAME_SHORT"),
    )


def varied_reference(spark: SparkSession, folder: str) -> DataFrame:
    """The reference with places of another type, test places, a ring line, and codes that are missing."""
    places = place_reference(spark, folder)
    return places.withColumns(
        {
            "TYPE_ID": F.when(F.col("CODE") == "BUILDING", 2).otherwise(1),
            "IS_TEST": (F.col("PLACE_ID") % 11 == 0).cast("int"),
            "LN_CODE": F.when(F.col("LN_CODE") == 3, F.lit(609)).otherwise(F.col("LN_CODE")).cast("bigint"),
            "ST_CODE": F.when(F.col("ST_CODE") % 7 != 5, F.col("ST_CODE")),
        }
    )


SCOPE = NETWORK.but(line_codes=(0, 1, 609))


def maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return station_maps(place_reference(spark, folder), NETWORK)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    places = place_map(place_reference(spark, folder), NETWORK)
    return station_counts(taps(spark, folder), places, NETWORK)


def total_counts(spark: SparkSession, folder: str, cfg: StationConfig = STATION) -> DataFrame:
    """All events as one series."""
    return series_counts(taps(spark, folder), cfg)


def hourly_stand_in(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in weather: event values by time, as temperature and wind."""
    raw = table(spark, folder, "events").select(
        F.col("ts").alias("time"),
        F.col("value").alias("temperature_2m"),
        F.length("props").cast("string").alias("wind_speed_10m"),
        F.struct("ts", "event_id").alias("file_order"),
    )
    return hourly_weather(raw, F.col("file_order"))


def patchy_weather(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in without every fifth hour."""
    return hourly_stand_in(spark, folder).filter(F.hour("weather_hour") % 5 != 0)


def network_folds(spark: SparkSession, folder: str, static: bool = False, weather: DataFrame | None = None) -> DataFrame:
    """Fold rows before the horizon clip. Counts are staged: the fold days come from their bounds, and the frame is
    then built from the few days it needs."""
    stations = maps(spark, folder)[0] if static else None
    counted = stage(counts(spark, folder))
    dates = fold_dates(counted, NETWORK)
    within = fold_range(dates, NETWORK)
    return day_folds(network_frame(counted, stations, NETWORK, weather, within), dates, NETWORK)


def network_context(spark: SparkSession, folder: str, static: bool = False, weather: DataFrame | None = None) -> DataFrame:
    """Clipped fold rows with load context. Staged, since the statistics and the rows both read them."""
    clipped = stage(clip_per_day(network_folds(spark, folder, static, weather), NETWORK))
    return attach_context(clipped, NETWORK)


def recent_mean(cfg, otherwise: Column) -> Column:
    """A second SQL-expressible forecast: the mean of recent counts over the horizon."""
    return F.coalesce(F.col(f"roll_mean_{cfg.rolls[-1]}") * F.lit(cfg.horizon_steps), otherwise)


MODELS = ["seasonal", "recent", "typical"]


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation anchors of both folds with three SQL-expressible forecasts."""
    table_ = anchors(network_context(spark, folder)).withColumn("seasonal", seasonal_naive(NETWORK))
    return table_.withColumns(
        {"recent": recent_mean(NETWORK, F.col("seasonal")), "typical": F.col("station_train_mean_target")}
    )


def series_folds(
    spark: SparkSession, folder: str, cfg: StationConfig = STATION, counted: DataFrame | None = None
) -> DataFrame:
    counted = stage(total_counts(spark, folder, cfg)) if counted is None else counted
    dates = fold_dates(counted, cfg, ())
    within = fold_range(dates, cfg)
    return day_folds(station_frame(counted, cfg, within), dates, cfg)


def series_context(
    spark: SparkSession, folder: str, cfg: StationConfig = STATION, counted: DataFrame | None = None
) -> DataFrame:
    clipped = stage(clip_per_segment(series_folds(spark, folder, cfg, counted), cfg))
    return attach_series_context(clipped, cfg)


SERIES_MODELS = ["daylag", "recent"]


def series_predictions(
    spark: SparkSession, folder: str, cfg: StationConfig = STATION, counted: DataFrame | None = None
) -> DataFrame:
    """Test anchors of the single series with two SQL-expressible forecasts."""
    test = anchors(series_context(spark, folder, cfg, counted)).filter("fold = 'full'")
    daylag = F.coalesce(F.col("target_daylag"), F.col(f"lag_{cfg.day_lag}") * F.lit(cfg.horizon_steps))
    return test.withColumn("daylag", daylag).withColumn("recent", recent_mean(cfg, F.col("daylag")))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: times and dates as text, doubles rounded."""
    out = []
    for field in df.schema:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind.startswith("timestamp") or kind == "date":
            column = column.cast("string")
        elif kind == "double":
            column = F.round(column, digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)
