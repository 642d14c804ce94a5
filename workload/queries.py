"""Registered queries. Each reads the given tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.functions.calendar import calendar_columns, time_of
from ridertide.operators import blending, bootstrap, boosting, buckets, context, features, folds, forecasts, metrics
from ridertide.operators.densify import dense_series
from ridertide.operators.sequence import pooled_autoregression, scaled_windows
from ridertide.operators.smoothing import holt_winters
from ridertide.operators.stations import labelled_place_map, station_maps, station_summary
from ridertide.operators.stations import map_profile as map_profile_of
from ridertide.plans.maps import read_map, save_labelled_maps
from ridertide.plans.network import run_network
from ridertide.plans.station import layered_events, run_station, station_metadata_of
from ridertide.session import stage, stage_folder
from ridertide.sources.events import at_places, filter_events, filter_terms, read_events_csv, timed_events
from ridertide.sources.places import HEADERLESS_COLUMNS, latest_file, read_places, read_plain_places
from ridertide.sources.tables import read_buckets, write_buckets, write_csv_tables
from ridertide.sources.weather import read_weather, require_times
from workload import inputs
from workload.inputs import MODELS, NETWORK, SERIES_MODELS, STATION, tidy

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TIME = NETWORK.time_col
STATION_KEY = ("station_key",)


def query(fn):
    """Registers a query under its function name, without the trailing underscore that avoids a clash."""
    REGISTRY[fn.__name__.rstrip("_")] = lambda spark, folder: tidy(fn(spark, folder))
    return fn


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn(TIME, time_of(F.col("step"), NETWORK.bucket_minutes))


# Maps and events


@query
def station_map(spark, folder):
    return station_summary(inputs.maps(spark, folder)[1])


@query
def labelled_station_map(spark, folder):
    return station_summary(labelled_place_map(inputs.place_reference(spark, folder)))


@query
def scoped_line_structure(spark, folder):
    """Places of one type on listed lines, one of them a ring; places without a code are out."""
    return station_maps(inputs.varied_reference(spark, folder), inputs.SCOPE)[0].drop("place_ids")


@query
def scoped_bucket_counts(spark, folder):
    mapped = station_maps(inputs.varied_reference(spark, folder), inputs.SCOPE)[1]
    return _timed(buckets.station_counts(inputs.taps(spark, folder), mapped, NETWORK)).drop("step")


@query
def textual_station_map(spark, folder):
    """Codes as text, some with a fraction or symbols; test places left out."""
    places = inputs.varied_reference(spark, folder)
    code = F.col("ST_CODE").cast("string")
    text = F.when(F.col("ST_CODE") > 12, F.concat(F.lit("N-"), code, F.lit(" "))).otherwise(F.concat(code, F.lit(".0")))
    return station_summary(labelled_place_map(places.withColumn("ST_CODE", text))).drop("ST_CODE", "LN_CODE")


@query
def line_structure(spark, folder):
    return inputs.maps(spark, folder)[0].drop("place_ids")


@query
def event_filter(spark, folder):
    terms = filter_terms(transport_type_id=1, validation_modes=(1, 2, 3))
    asia = inputs.place_reference(spark, folder).filter("LN_NAME = 'ASIA'")
    return at_places(timed_events(filter_events(inputs.taps(spark, folder), terms)), asia)


@query
def bucket_counts(spark, folder):
    stations, places = inputs.maps(spark, folder)
    counted = buckets.station_counts(inputs.taps(spark, folder), places, NETWORK)
    return buckets.bucket_table(counted, stations, NETWORK)


@query
def bucket_profile(spark, folder):
    return buckets.bucket_profile(_timed(inputs.counts(spark, folder)), TIME)


@query
def map_profile(spark, folder):
    return map_profile_of(inputs.maps(spark, folder)[1])


@query
def line_flow(spark, folder):
    stations = inputs.maps(spark, folder)[0]
    return buckets.line_flow(_timed(inputs.counts(spark, folder)), stations, "eur").drop("step")


# Features


@query
def dense_series_(spark, folder):
    dense = dense_series(inputs.counts(spark, folder), STATION_KEY, NETWORK.slice_steps)
    return _timed(dense).drop("step")


def _windows(spark, folder, *columns) -> DataFrame:
    wide = _timed(features.network_windows(inputs.counts(spark, folder), NETWORK))
    return wide.select("station_key", TIME, *columns)


@query
def horizon_target(spark, folder):
    return _windows(spark, folder, "target_h", "target_daylag")


@query
def lag_features(spark, folder):
    return _windows(spark, folder, *[f"lag_{n}" for n in NETWORK.lags])


@query
def rolling_features(spark, folder):
    sums = [f"roll_{kind}_{n}" for n in NETWORK.rolls for kind in ("sum", "mean")]
    return _windows(spark, folder, *sums, "roll_std_2", "roll_std_4")


@query
def calendar_features(spark, folder):
    dense = dense_series(inputs.counts(spark, folder), STATION_KEY, NETWORK.slice_steps)
    calendar = [c.alias(n) for n, c in calendar_columns(F.col("step"), NETWORK).items()]
    return _timed(dense).select("station_key", TIME, *calendar)


@query
def slope_ratio_features(spark, folder):
    frame = features.network_frame(inputs.counts(spark, folder), None, NETWORK)
    slopes = ("local_slope_1", "local_slope_2", "daylag_deviation", "prev_count_ratio_daylag")
    return frame.select("station_key", TIME, *slopes)


@query
def weather_hourly(spark, folder):
    return inputs.hourly_stand_in(spark, folder)


@query
def weather_join(spark, folder):
    dense = dense_series(inputs.counts(spark, folder), STATION_KEY, NETWORK.slice_steps)
    return features.attach_weather(_timed(dense), inputs.hourly_stand_in(spark, folder), TIME).drop("step")


@query
def category_codes(spark, folder):
    stations = inputs.maps(spark, folder)[0]
    coded = features.station_codes(stations, inputs.counts(spark, folder))
    codes = ("station_key_code", "station_name_code", "line_name_code", "station_id_raw", "line_id_raw")
    return coded.select("station_key", *codes, "station_code", "line_code")


@query
def supervised_frame(spark, folder):
    stations = inputs.maps(spark, folder)[0]
    weather = inputs.hourly_stand_in(spark, folder)
    return features.network_frame(inputs.counts(spark, folder), stations, NETWORK, weather).drop("step")


@query
def partial_map_frame(spark, folder):
    """Stations that the map lacks keep their rows, without static columns."""
    stations = inputs.maps(spark, folder)[0].filter("LN_NAME <> 'ASIA'")
    frame = features.network_frame(inputs.counts(spark, folder), stations, NETWORK)
    filled = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_place_ids", "line_n_stations")]
    return frame.select("station_key", TIME, "target_h", "ST_NAME", *filled)


@query
def single_series_frame(spark, folder):
    return features.station_frame(inputs.total_counts(spark, folder), STATION).drop("step")


@query
def sequence_windows(spark, folder):
    wide = _timed(features.sequence_windows(inputs.counts(spark, folder), NETWORK, NETWORK.seq_window))
    history = F.array_join(F.transform("history", lambda x: x.cast("bigint").cast("string")), " ")
    return wide.select("station_key", TIME, history.alias("history"), "target_h")


# Folds and context


@query
def day_split(spark, folder):
    return inputs.network_folds(spark, folder).select("fold", "role", "station_key", TIME, "date", "target_h")


@query
def horizon_clip(spark, folder):
    clipped = folds.clip_per_day(inputs.network_folds(spark, folder), NETWORK)
    return clipped.select("fold", "role", "station_key", TIME, "target_h")


@query
def split_profile(spark, folder):
    return folds.split_profile(folds.clip_per_day(inputs.network_folds(spark, folder), NETWORK), TIME)


@query
def series_split(spark, folder):
    columns = ("hl_daylag", "hl_actual", "continuous_load_score", "q_train")
    return inputs.series_context(spark, folder).select("fold", "role", TIME, "target_h", *columns)


@query
def station_stats(spark, folder):
    clipped = folds.clip_per_day(inputs.network_folds(spark, folder), NETWORK)
    return context.station_stats(clipped, NETWORK)


@query
def highload_flags(spark, folder):
    attached = inputs.network_context(spark, folder)
    columns = ("q80_station", "hl_daylag", "hl_actual", "continuous_load_score", *context.STATION_STATS)
    relative = [name for name, _ in context.RELATIVE_STATS]
    return attached.select("fold", "role", "station_key", TIME, *columns, *relative)


@query
def normalized_features(spark, folder):
    wanted = ["lag_1", "lag_24", "roll_sum_4", "roll_mean_8", "target_daylag", "hour_sin"]
    scaled, names = context.normalize_scale(stage(inputs.network_context(spark, folder)), wanted)
    return scaled.select("fold", "role", "station_key", TIME, "station_scale", "target_norm", *names)


@query
def sample_weights(spark, folder):
    table = stage(inputs.predictions(spark, folder).filter("fold = 'tune'"))
    typical = F.lit(context.median_station_mean(table))
    weight = context.sample_weight(F.col("y_true"), F.col("station_train_mean_target"), typical, NETWORK.load_gamma)
    return table.select("station_key", TIME, weight.alias("weight"))


# Forecasts


@query
def seasonal_naive(spark, folder):
    table = forecasts.anchors(inputs.network_context(spark, folder))
    return table.select("fold", "station_key", TIME, "y_true", forecasts.seasonal_naive(NETWORK).alias("pred"))


@query
def scaled_sequence(spark, folder):
    rows = inputs.network_folds(spark, folder)
    wide = _timed(scaled_windows(rows, NETWORK, NETWORK.seq_window))
    first, last = F.col("history")[0].alias("oldest"), F.col("history")[NETWORK.seq_window - 1].alias("newest")
    return wide.select("fold", "role", "station_key", TIME, first, last, "target_scaled", "series_mean", "series_std")


@query
def unreached_anchors(spark, folder):
    rows = stage(inputs.network_folds(spark, folder))
    keys = ["fold", "station_key", "step"]
    wanted = forecasts.anchors(folds.clip_per_day(rows, NETWORK))
    reached = scaled_windows(rows, NETWORK, inputs.LONG_WINDOW).filter("role = 'eval'")
    return _timed(forecasts.unreached(wanted, reached, keys)).drop("step")


@query
def holt_winters_(spark, folder):
    return _timed(holt_winters(inputs.network_folds(spark, folder), NETWORK)).drop("step")


@query
def pooled_autoregression_(spark, folder):
    rows = stage(inputs.network_folds(spark, folder))
    return _timed(pooled_autoregression(rows, NETWORK, NETWORK.seq_window))


@query
def two_lag_autoregression(spark, folder):
    """The pooled autoregression on windows of two counts, whose sums have a closed form."""
    rows = stage(inputs.network_folds(spark, folder))
    return _timed(pooled_autoregression(rows, NETWORK, 2)).drop("step")


@query
def aligned_experts(spark, folder):
    """Two experts beside the anchors; one lacks every third hour, the other the stations with short series."""
    rows = stage(inputs.network_folds(spark, folder))
    wanted = _timed(forecasts.anchors(inputs.network_context(spark, folder)))
    wanted = stage(wanted.withColumn("seasonal", forecasts.seasonal_naive(NETWORK)))
    recent = inputs.recent_mean(NETWORK, F.col("seasonal")).alias("pred")
    partly = wanted.filter(F.hour(TIME) % 3 != 0).select("fold", "station_key", "step", recent)
    level = (F.col("series_mean") * NETWORK.horizon_steps).alias("pred")
    reached = scaled_windows(rows, NETWORK, inputs.LONG_WINDOW).filter("role = 'eval'").select("fold", "station_key", "step", level)
    found = {"recent": partly, "level": reached}
    table = forecasts.aligned(wanted, found, ["fold", "station_key", "step"], {"recent": F.col("seasonal"), "level": None})
    missing = F.array_join(F.array_sort("without"), " ").alias("without")
    return table.select("fold", "station_key", TIME, "y_true", "seasonal", "recent", "level", missing)


def _stump_rows(spark, folder) -> DataFrame:
    """Context rows with static columns, and weather that lacks every fifth hour."""
    return stage(inputs.network_context(spark, folder, static=True, weather=inputs.patchy_weather(spark, folder)))


def _stump_expert(spark, folder) -> boosting.Expert:
    cfg = inputs.NETWORK_STUMPS
    return boosting.network_trees(_stump_rows(spark, folder), boosting.rich_features(cfg), cfg, "stump")


@query
def stump_grid(spark, folder):
    """One-level candidates over all features, the best two averaged."""
    return _timed(_stump_expert(spark, folder).forecasts).drop("step")


@query
def stump_candidates(spark, folder):
    return _stump_expert(spark, folder).candidates("stump")


@query
def stump_normalized(spark, folder):
    cfg = inputs.NETWORK_STUMPS
    expert = boosting.normalized_trees(_stump_rows(spark, folder), boosting.rich_features(cfg), cfg, "stump")
    return _timed(expert.forecasts).drop("step")


def _series_stumps(spark, folder) -> boosting.Expert:
    return boosting.station_trees(stage(inputs.series_context(spark, folder)), inputs.STATION_STUMPS)


@query
def stump_series(spark, folder):
    """One candidate for each named feature set, the best three averaged."""
    return _timed(_series_stumps(spark, folder).forecasts).drop("step")


@query
def stump_series_candidates(spark, folder):
    return _series_stumps(spark, folder).candidates("stump")


@query
def boosted_grid(spark, folder):
    rows = stage(inputs.network_context(spark, folder, static=True))
    return _timed(boosting.network_trees(rows, boosting.base_features(NETWORK), NETWORK, "trees_base").forecasts)


@query
def boosted_normalized(spark, folder):
    rows = stage(inputs.network_context(spark, folder, static=True))
    return _timed(boosting.normalized_trees(rows, boosting.rich_features(NETWORK), NETWORK, "trees_norm").forecasts)


@query
def boosted_series(spark, folder):
    rows = stage(inputs.series_context(spark, folder))
    return _timed(boosting.station_trees(rows, STATION).forecasts)


# Blends


def _two_parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    table = stage(inputs.predictions(spark, folder))
    return table.filter("fold = 'tune'"), table.filter("fold = 'full'")


PAIR = ["seasonal", "recent"]


@query
def blend_static(spark, folder):
    validation, test = _two_parts(spark, folder)
    blend = blending.fit_blend(validation, PAIR, blending.network_least_rows(PAIR))
    return test.select("station_key", TIME, blend.static().alias("pred"))


@query
def blend_gaps(spark, folder):
    """Weights from the complete rows where one forecast is missing at every third hour."""
    validation, test = _two_parts(spark, folder)
    partly = F.when(F.hour(TIME) % 3 != 0, F.col("recent"))
    blend = blending.fit_blend(validation.withColumn("recent", partly), PAIR, blending.network_least_rows(PAIR))
    return test.select("station_key", TIME, blend.static().alias("pred"), blend.contextual().alias("pred_context"))


@query
def blend_context(spark, folder):
    validation, test = _two_parts(spark, folder)
    blend = blending.fit_blend(validation, PAIR, blending.network_least_rows(PAIR))
    return test.select("station_key", TIME, blend.contextual().alias("pred"))


@query
def blend_weighted(spark, folder):
    validation, test = _two_parts(spark, folder)
    typical = F.lit(context.median_station_mean(validation))
    weight = context.sample_weight(F.col("y_true"), F.col("station_train_mean_target"), typical, NETWORK.load_gamma)
    blend = blending.fit_blend(validation.withColumn("w", weight), PAIR, blending.network_least_rows(PAIR), F.col("w"))
    return test.select("station_key", TIME, blend.static().alias("pred"), blend.contextual().alias("pred_context"))


@query
def meta_features(spark, folder):
    test = inputs.predictions(spark, folder).filter("fold = 'full'")
    built = blending.meta_features(MODELS, "seasonal", ["hl_daylag", "prev_count_ratio_daylag"], extremes=True)
    return test.select("station_key", TIME, *[c.alias(n) for n, c in built.items()])


@query
def model_pool(spark, folder):
    scores = metrics.micro_metrics(inputs.predictions(spark, folder).filter("fold = 'tune'"), MODELS)
    scores = stage(scores)
    chosen = blending.select_pool(scores, "seasonal", NETWORK.pool_tolerance)
    return scores.filter(F.col("model").isin(*chosen)).select("model", "mae", "lw_mae", "hl_mae")


def _ridge_inputs(spark, folder):
    validation, test = _two_parts(spark, folder)
    built = {"recent": F.col("recent"), "hl_daylag": F.coalesce(F.col("hl_daylag"), F.lit(0)).cast("double")}
    validation, names = blending.with_meta(blending.with_residual(validation, "seasonal"), built)
    return validation, blending.with_meta(test, built)[0], names


@query
def residual_ridge(spark, folder):
    validation, test, names = _ridge_inputs(spark, folder)
    fit = blending.fit_ridge(validation, names, "residual", NETWORK.ridge_alpha)
    bounds = blending.residual_bounds(validation, "seasonal", NETWORK.ridge_clip)
    pred = blending.corrected("seasonal", fit.value(), bounds)
    return test.select("station_key", TIME, pred.alias("pred"))


@query
def ridge_terms(spark, folder):
    validation, _, names = _ridge_inputs(spark, folder)
    fit = blending.fit_ridge(validation, names, "residual", NETWORK.ridge_alpha)
    return metrics.top_terms(fit.terms(spark), "coef", 20)


def _meta_inputs(spark, folder):
    validation, test = _two_parts(spark, folder)
    built = blending.meta_features(MODELS, "seasonal", list(blending.STATION_META_CONTEXT))
    validation, names = blending.with_meta(blending.with_residual(validation, "seasonal"), built)
    return validation, blending.with_meta(test, built)[0], names


@query
def residual_boosted(spark, folder):
    validation, test, names = _meta_inputs(spark, folder)
    trees = blending.fit_residual_trees(validation, names, NETWORK.residual_trees, NETWORK.seed)
    bounds = blending.residual_bounds(validation, "seasonal", NETWORK.trees_clip)
    scored = trees.add_prediction(test, "correction")
    return scored.select("station_key", TIME, blending.corrected("seasonal", F.col("correction"), bounds).alias("pred"))


def _residual_stump(spark, folder):
    validation, test, names = _meta_inputs(spark, folder)
    return validation, test, blending.fit_residual_trees(validation, names, inputs.STUMPS[1], NETWORK.seed)


@query
def residual_stump(spark, folder):
    validation, test, trees = _residual_stump(spark, folder)
    bounds = blending.residual_bounds(validation, "seasonal", NETWORK.trees_clip)
    pred = blending.corrected("seasonal", F.col("correction"), bounds).alias("pred")
    return trees.add_prediction(test, "correction").select("station_key", TIME, pred)


@query
def stump_importance(spark, folder):
    """Shares of the features in the gains of the residual stump, those that it uses."""
    trees = _residual_stump(spark, folder)[2]
    return blending.importance_terms(trees, spark).filter("importance > 0")


@query
def direct_stump(spark, folder):
    validation, test = _two_parts(spark, folder)
    columns = [*MODELS, "hl_daylag", "hour_sin", "hour_cos"]
    scored = blending.direct_blend(validation, test, columns, inputs.STUMPS[1], NETWORK.seed, "pred")
    return scored.select("station_key", TIME, "pred")


@query
def primary_model(spark, folder):
    """The network's primary model by load-weighted error, the single line's by absolute error."""
    network = stage(metrics.micro_metrics(_two_parts(spark, folder)[0], MODELS))
    series = stage(metrics.series_metrics(inputs.series_predictions(spark, folder), SERIES_MODELS))
    chosen = {"network": metrics.best_model(network, "lw_mae"), "series": metrics.best_model(series, "mae")}
    return spark.createDataFrame(list(chosen.items()), "line string, model string")


@query
def direct_boosted(spark, folder):
    validation, test = _two_parts(spark, folder)
    columns = [*MODELS, "hl_daylag", "hour_sin", "hour_cos"]
    scored = blending.direct_blend(validation, test, columns, STATION.meta_trees, NETWORK.seed, "pred")
    return scored.select("station_key", TIME, "pred")


# Scores


def _test(spark, folder) -> DataFrame:
    return inputs.predictions(spark, folder).filter("fold = 'full'")


@query
def micro_metrics(spark, folder):
    return metrics.micro_metrics(_test(spark, folder), MODELS).select("model", "mae", "rmse", "wmape", "lw_mae")


@query
def highload_metrics(spark, folder):
    scores = metrics.micro_metrics(_test(spark, folder), MODELS)
    return scores.select("model", "hl_mae", "hl_under_mae", "hl_under_rate")


@query
def macro_metrics(spark, folder):
    return metrics.macro_metrics(_test(spark, folder), MODELS)


@query
def single_metrics(spark, folder):
    return metrics.series_metrics(inputs.series_predictions(spark, folder), SERIES_MODELS)


@query
def leaderboard(spark, folder):
    return metrics.ranked(metrics.micro_metrics(_test(spark, folder), MODELS))


@query
def station_bootstrap(spark, folder):
    test = stage(_test(spark, folder))
    reps = bootstrap.station_replicates(test, MODELS, NETWORK.n_bootstrap, NETWORK.seed)
    return bootstrap.metric_intervals(reps, bootstrap.station_estimates(test, MODELS))


@query
def delta_ci(spark, folder):
    test = stage(_test(spark, folder))
    reps = bootstrap.station_replicates(test, MODELS, NETWORK.n_bootstrap, NETWORK.seed)
    return bootstrap.delta_intervals(reps, bootstrap.station_estimates(test, MODELS), ["seasonal"])


@query
def selected_deltas(spark, folder):
    test = stage(_test(spark, folder))
    reps = bootstrap.station_replicates(test, MODELS, NETWORK.n_bootstrap, NETWORK.seed)
    deltas = bootstrap.delta_intervals(reps, bootstrap.station_estimates(test, MODELS), ["seasonal", "recent"])
    return bootstrap.selected_deltas(deltas, "micro", ["seasonal"], ["lw_mae", "hl_mae", "hl_under_mae"])


@query
def block_bootstrap(spark, folder):
    test = stage(inputs.series_predictions(spark, folder))
    reps = bootstrap.block_replicates(
        test, SERIES_MODELS, "step", STATION.n_bootstrap, STATION.block_size, STATION.seed
    )
    return bootstrap.metric_intervals(reps, bootstrap.block_estimates(test, SERIES_MODELS))


@query
def abs_errors(spark, folder):
    return metrics.absolute_errors(_test(spark, folder), MODELS, ["station_key", TIME])


@query
def residual_corrections(spark, folder):
    table = metrics.residual_corrections(_test(spark, folder), "seasonal", ["recent", "typical"])
    return table.select("station_key", TIME, "recent_correction", "typical_correction")


@query
def blend_deltas(spark, folder):
    scores = metrics.micro_metrics(_test(spark, folder), MODELS).drop(*metrics.NETWORK_METRICS[4:])
    return metrics.blend_deltas(stage(scores), ["seasonal", "recent"], ["typical"])


@query
def busiest_station(spark, folder):
    return metrics.busiest_station(_test(spark, folder))


@query
def sweep_summary(spark, folder):
    boards = None
    fine = stage(inputs.total_counts(spark, folder, STATION.but(bucket_minutes=30)))  # one scan of the events
    for minutes in (60, 180):
        cfg = STATION.but(name=f"series_60m_{minutes}m", horizon_minutes=minutes)
        counted = stage(buckets.rolled_up(fine, 30, cfg))
        scores = metrics.series_metrics(inputs.series_predictions(spark, folder, cfg, counted), SERIES_MODELS)
        board = scores.select(
            F.lit(cfg.name).alias("config_name"),
            F.lit(cfg.bucket_minutes).alias("bucket_minutes"),
            F.lit(cfg.horizon_minutes).alias("horizon_minutes"),
            "*",
        )
        boards = board if boards is None else boards.unionByName(board)
    return metrics.sweep_summary(boards)


# Readers and writers: given tables as delimited or Parquet files in the stage folder, read by the real readers


def _stage_path(spark) -> str:
    return f"{stage_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _delimited(df: DataFrame, header: bool = True) -> str:
    path = _stage_path(df.sparkSession)
    df.write.option("sep", ";").option("header", header).csv(path)
    return path


@query
def event_files(spark, folder):
    """Events from delimited files in which every seventh time is unreadable."""
    taps = inputs.taps(spark, folder)
    unreadable = F.when(F.col("APP_ID") % 7 == 0, "no time").otherwise(F.col("TRAN_DATE").cast("string"))
    path = _delimited(taps.withColumn("TRAN_DATE", unreadable))
    return timed_events(filter_events(read_events_csv(spark, path), filter_terms(1, (), (1, 2)))).drop("APP_ID")


PLACE_COLUMNS = ("PLACE_ID", "TYPE_ID", "ST_CODE", "ST_NAME", "ST_NAME_SHORT", "LN_CODE", "LN_NAME", "LN_NAME_SHORT")


@query
def place_files(spark, folder):
    """Places by other column names, without the short names, from the last of the matching files."""
    places = inputs.place_reference(spark, folder).select(
        F.col("PLACE_ID").alias("id"),
        F.col("TYPE_ID").alias("transport type id"),
        F.col("ST_CODE").alias("Station ID"),
        F.concat(F.lit(" "), "ST_NAME", F.lit(" ")).alias("station_name"),
        F.when(F.col("LN_CODE") == 2, "two").otherwise(F.col("LN_CODE").cast("string")).alias("line_id"),
        F.col("LN_NAME").alias("line name"),
    )
    path = _delimited(places.coalesce(1))
    read = read_places(spark, latest_file(spark, path, "part-*.csv")).select(*PLACE_COLUMNS)
    return read.withColumn("LN_CODE", F.coalesce("LN_CODE", F.lit(-1)))


@query
def place_files_without_header(spark, folder):
    places = inputs.place_reference(spark, folder).withColumns({c: F.lit("x") for c in ("PLACE_NUM", "COL_4", "COL_5")})
    path = _delimited(places.select(*HEADERLESS_COLUMNS), header=False)
    return read_places(spark, path).select(*PLACE_COLUMNS, "PLACE_NAME")


@query
def weather_files(spark, folder):
    """Hourly weather from a delimited file, one row for each hour."""
    hourly = inputs.hourly_stand_in(spark, folder).select(
        F.col("weather_hour").alias("datetime"),
        F.col("weather_temperature_2m").alias("temperature_2m"),
        F.col("weather_wind_speed_10m").alias("wind_speed_10m"),
    )
    path = _stage_path(spark)
    hourly.write.option("header", True).csv(path)
    return require_times(read_weather(spark, path))


@query
def bucket_files(spark, folder):
    """Station buckets through the Parquet sink and back as counts."""
    buckets_ = buckets.bucket_table(inputs.counts(spark, folder), inputs.maps(spark, folder)[0], NETWORK)
    path = _stage_path(spark)
    write_buckets(buckets_, path, ["LN_CODE", "ST_CODE", TIME])
    return _timed(buckets.counts_of(read_buckets(spark, path), NETWORK)).drop("step")


@query
def result_files(spark, folder):
    """Station tables through the CSV sink."""
    paths = write_csv_tables({"stations": inputs.maps(spark, folder)[0].drop("place_ids")}, _stage_path(spark))
    written = spark.read.option("header", True).csv(paths["stations"])
    return written.select("station_key", "ST_NAME", "LN_NAME", F.col("n_place_ids").cast("bigint"))


@query
def plain_place_files(spark, folder):
    """The plain reference: columns as they stand, codes that don't read as numbers missing."""
    places = inputs.place_reference(spark, folder)
    code = F.when(F.col("PLACE_ID") % 4 == 0, F.concat(F.col("PLACE_ID").cast("string"), F.lit(".0"))).otherwise(F.col("CODE"))
    path = _delimited(places.select("PLACE_ID", code.alias("CODE"), "NAME", "TYPE_ID", "IS_PARKING", "IS_TEST", "ST_NAME"))
    return read_plain_places(spark, path)


@query
def station_metadata(spark, folder):
    """Station metadata by file suffix: lines from a delimited file, places of each station from a Parquet file."""
    stations = inputs.maps(spark, folder)[0]
    named = {suffix: f"{_stage_path(spark)}.{suffix}" for suffix in ("csv", "pq")}
    stations.select("station_key", "LN_NAME").write.option("header", True).csv(named["csv"])
    stations.select("station_key", "n_place_ids").write.parquet(named["pq"])
    read = {suffix: station_metadata_of(spark, STATION.but(station_metadata_path=path)) for suffix, path in named.items()}
    return read["csv"].join(read["pq"], "station_key")


@query
def map_files(spark, folder):
    """Place and station maps of all lines and of one line through the sink, counted as read back."""
    saved = save_labelled_maps(inputs.varied_reference(spark, folder), "EUROPE", _stage_path(spark), include_test=True)
    parts = None
    for name, path in sorted(saved.items()):
        read = read_map(spark, path) if "PLACE_ID" in spark.read.option("header", True).csv(path).columns else spark.read.option("header", True).csv(path)
        counted = read.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_distinct("station_key").alias("stations"))
        parts = counted if parts is None else parts.unionByName(counted)
    return parts


@query
def event_layers(spark, folder):
    """The single line's events through its full and its filtered layer."""
    taps = inputs.taps(spark, folder).withColumns({"TRAN_DATE": F.col("TRAN_DATE").cast("string"), "EXTRA": F.lit("x")})
    path = _delimited(taps)
    cfg = STATION.but(validation_modes=(1, 4), place_ids=tuple(range(0, 90)))
    return layered_events(spark, path, cfg, _stage_path(spark)).drop("APP_ID")


@query
def line_buckets(spark, folder):
    """One line's buckets from the range-partitioned sink."""
    buckets_ = buckets.bucket_table(inputs.counts(spark, folder), inputs.maps(spark, folder)[0], NETWORK)
    path = _stage_path(spark)
    write_buckets(buckets_, path, ["LN_CODE", "ST_CODE", TIME], files=16)
    return _timed(buckets.counts_of(read_buckets(spark, path).filter("LN_CODE = 3"), NETWORK)).drop("step")


# Whole runs


@query
def network_run(spark, folder):
    stations = inputs.maps(spark, folder)[0]
    return run_network(inputs.counts(spark, folder), stations, NETWORK, inputs.hourly_stand_in(spark, folder)).micro


@query
def series_run(spark, folder):
    return run_station(inputs.total_counts(spark, folder), STATION).summary
