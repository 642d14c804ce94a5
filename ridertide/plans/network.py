"""The multi-station run: folds, experts, blends, residual models, scores, intervals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig
from ridertide.operators import blending, bootstrap, boosting, context, folds, forecasts, metrics
from ridertide.operators.buckets import bucket_table, counts_of, require_counts, station_counts
from ridertide.operators.features import network_frame
from ridertide.operators.sequence import pooled_autoregression
from ridertide.operators.smoothing import holt_winters
from ridertide.operators.stations import station_maps
from ridertide.session import stage
from ridertide.sources.events import filter_events, filter_terms, read_events_csv, timed_events
from ridertide.sources.places import latest_file, read_places
from ridertide.sources.tables import write_csv_tables
from ridertide.sources.weather import read_weather, require_times

KEYS = ["fold", "station_key", "step"]
EXPERTS = ("seasonal", "smoothing", "trees_base_norm", "trees_rich_norm", "trees_base", "trees_rich", "sequence")
BLENDS = ("meta_static", "meta_context", "meta_static_lw", "meta_context_lw")
RESIDUALS = ("residual_linear", "residual_trees", "residual_linear_lw", "residual_trees_lw")


@dataclass
class NetworkResult:
    predictions: DataFrame
    models: list[str]
    pool: list[str]
    primary: str | None
    blend: blending.Blend
    blend_lw: blending.Blend
    pool_scores: DataFrame
    micro: DataFrame
    macro: DataFrame
    metric_ci: DataFrame
    delta_ci: DataFrame
    stations: DataFrame
    #: Scores of all boosted candidates, and the anchors per expert, fold and station that took the fallback.
    candidates: DataFrame | None = None
    fallbacks: DataFrame | None = None
    terms: dict[str, DataFrame] = field(default_factory=dict)

    def validation(self) -> DataFrame:
        return self.predictions.filter(F.col("fold") == folds.TUNE)

    def test(self) -> DataFrame:
        return self.predictions.filter(F.col("fold") == folds.FULL)


def prepare_network(
    spark: SparkSession, events_csv: str, places_folder: str, places_pattern: str, cfg: NetworkConfig
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, stations, bucket table) from the raw files."""
    places = read_places(spark, latest_file(spark, places_folder, places_pattern))
    stations, mapped = station_maps(places, cfg)
    terms = filter_terms(cfg.transport_type_id, validation_modes=cfg.validation_modes)
    taps = timed_events(filter_events(read_events_csv(spark, events_csv), terms))
    counts = require_counts(stage(station_counts(taps, mapped, cfg)))
    return counts, stations, bucket_table(counts, stations, cfg)


def network_weather(spark: SparkSession, cfg: NetworkConfig) -> DataFrame | None:
    """Hourly weather of the settings; None without a path, a file, or a known covariate in it."""
    if not cfg.weather_path:
        return None
    try:
        weather = read_weather(spark, cfg.weather_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if weather is None else require_times(stage(weather))


def run_from_buckets(buckets: DataFrame, stations: DataFrame, cfg: NetworkConfig, weather=None) -> NetworkResult:
    return run_network(counts_of(buckets, cfg), stations, cfg, weather)


def fold_tables(
    counts: DataFrame, stations: DataFrame, cfg: NetworkConfig, weather: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(fold rows before the clip, clipped rows with load context), both staged."""
    counted = stage(counts)
    dates = folds.fold_dates(counted, cfg)
    within = folds.fold_range(dates, cfg)
    frame = network_frame(counted, stations, cfg, weather, within)
    rows = stage(folds.day_folds(frame, dates, cfg))
    return rows, stage(context.attach_context(folds.clip_per_day(rows, cfg), cfg))


def expert_table(
    rows: DataFrame, attached: DataFrame, cfg: NetworkConfig
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(evaluation anchors with one column per expert, candidate scores, anchors that took the fallback)."""
    table = forecasts.anchors(attached).withColumn("seasonal", forecasts.seasonal_naive(cfg))
    found: dict[str, DataFrame] = {}
    candidates = None
    if cfg.run_smoothing:
        found["smoothing"] = holt_winters(rows, cfg)
    if cfg.run_trees:
        base, rich = boosting.base_features(cfg), boosting.rich_features(cfg)
        fits = {
            "trees_base": boosting.network_trees(attached, base, cfg, "trees_base"),
            "trees_rich": boosting.network_trees(attached, rich, cfg, "trees_rich"),
            "trees_base_norm": boosting.normalized_trees(attached, base, cfg, "trees_base_norm"),
            "trees_rich_norm": boosting.normalized_trees(attached, rich, cfg, "trees_rich_norm"),
        }
        found.update({name: fit.forecasts for name, fit in fits.items()})
        candidates = union_all([fit.candidates(name) for name, fit in fits.items()])
    if cfg.run_sequence:
        found["sequence"] = pooled_autoregression(rows, cfg, cfg.seq_window)
    # Trees reach every anchor; a gap in them stops the run later.
    fallbacks = {name: None if name.startswith("trees") else F.col("seasonal") for name in found}
    if not found:
        return stage(table), None, None
    table = stage(forecasts.aligned(table, found, KEYS, fallbacks))
    filled = [name for name, value in fallbacks.items() if value is not None]
    missed = table.select("fold", "station_key", F.explode("without").alias("expert")).filter(F.col("expert").isin(*filled))
    missed = missed.groupBy("expert", "fold", "station_key").agg(F.count(F.lit(1)).alias("anchors")) if filled else None
    return table.drop("without"), candidates, missed


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def run_network(
    counts: DataFrame, stations: DataFrame, cfg: NetworkConfig, weather: DataFrame | None = None
) -> NetworkResult:
    spark = counts.sparkSession
    weather = network_weather(spark, cfg) if weather is None else weather
    rows, attached = fold_tables(counts, stations, cfg, weather)
    table, candidates, fallbacks = expert_table(rows, attached, cfg)
    validation = table.filter(F.col("fold") == folds.TUNE)
    experts = [m for m in EXPERTS if m in table.columns]
    blending.require_forecasts(table, experts)

    scores = stage(metrics.micro_metrics(validation, experts, cfg.load_gamma))
    pool = blending.select_pool(scores, "seasonal", cfg.pool_tolerance)
    typical = F.lit(context.median_station_mean(validation))
    weight = context.sample_weight(F.col("y_true"), F.col("station_train_mean_target"), typical, cfg.load_gamma)
    validation = stage(validation.withColumn("fit_lw", weight))
    least = blending.network_least_rows(pool)
    plain = blending.fit_blend(validation, pool, least)
    loaded = blending.fit_blend(validation, pool, least, F.col("fit_lw"))
    columns = {
        "meta_static": plain.static(),
        "meta_context": plain.contextual(),
        "meta_static_lw": loaded.static(),
        "meta_context_lw": loaded.contextual(),
    }
    scored = table.withColumns(columns)
    models = [*experts, *BLENDS]

    primary, terms = None, {}
    if cfg.run_residual:
        primary = metrics.best_model(scores.filter(F.col("model").isin(*pool)), "lw_mae")
        scored, terms = _residual_models(spark, scored, validation, pool, primary, cfg)
        models += RESIDUALS

    scored = stage(scored)
    test = scored.filter(F.col("fold") == folds.FULL)
    reps = stage(bootstrap.station_replicates(test, models, cfg.n_bootstrap, cfg.seed, cfg.load_gamma))
    points = stage(bootstrap.station_estimates(test, models, cfg.load_gamma))
    baselines = [m for m in experts if m != "sequence"]
    return NetworkResult(
        predictions=scored,
        models=models,
        pool=pool,
        primary=primary,
        blend=plain,
        blend_lw=loaded,
        pool_scores=scores,
        micro=metrics.leaderboard(metrics.micro_metrics(test, models, cfg.load_gamma)),
        macro=metrics.leaderboard(metrics.macro_metrics(test, models, cfg.load_gamma)),
        metric_ci=bootstrap.metric_intervals(reps, points).orderBy("mode", "metric", "estimate"),
        delta_ci=bootstrap.delta_intervals(reps, points, baselines).orderBy(
            "mode", "baseline", "metric", F.col("delta_estimate").desc()
        ),
        stations=stations,
        candidates=candidates,
        fallbacks=fallbacks,
        terms=terms,
    )


def _residual_models(spark, scored, validation, pool, primary, cfg):
    """Ridge and boosted corrections of the primary expert, plain and load-weighted."""
    extra = boosting.available(validation, blending.NETWORK_META_CONTEXT)
    built = blending.meta_features(pool, primary, extra)
    fit_table, names = blending.with_meta(blending.with_residual(validation, primary), built)
    fit_table = stage(fit_table)
    wide, _ = blending.with_meta(scored, built)
    ridge_bounds = blending.residual_bounds(fit_table, primary, cfg.ridge_clip)
    tree_bounds = blending.residual_bounds(fit_table, primary, cfg.trees_clip)
    terms = {}
    for suffix, weight, seed in (("", None, cfg.seed), ("_lw", "fit_lw", cfg.seed + 333)):
        ridge = blending.fit_ridge(fit_table, names, "residual", cfg.ridge_alpha, weight)
        wide = wide.withColumn(f"residual_linear{suffix}", blending.corrected(primary, ridge.value(), ridge_bounds))
        trees = blending.fit_residual_trees(fit_table, names, cfg.residual_trees, seed, weight)
        wide = trees.add_prediction(wide, "tree_correction")
        wide = wide.withColumn(
            f"residual_trees{suffix}", blending.corrected(primary, F.col("tree_correction"), tree_bounds)
        ).drop("tree_correction")
        terms[f"residual_linear{suffix}_coef"] = ridge.terms(spark)
        terms[f"residual_trees{suffix}_importance"] = blending.importance_terms(trees, spark)
    return wide.drop(*names), terms


def save_network(result: NetworkResult, folder: str) -> dict[str, str]:
    """Metric, interval, prediction and station tables as CSV."""
    extra = {"candidate_scores": result.candidates, "fallback_stations": result.fallbacks}
    return write_csv_tables(
        {
            **{name: table for name, table in extra.items() if table is not None},
            "micro_metrics": result.micro,
            "macro_metrics": result.macro,
            "station_bootstrap_metric_ci": result.metric_ci,
            "station_bootstrap_delta_ci": result.delta_ci,
            "test_predictions": result.test(),
            "validation_predictions": result.validation(),
            "stations_used": result.stations,
        },
        folder,
    )
