"""The single-station run and the sweep over configurations."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import gcd

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridertide.config import StationConfig
from ridertide.operators import blending, bootstrap, boosting, context, folds, forecasts, metrics
from ridertide.operators.buckets import rolled_up, series_counts
from ridertide.operators.features import station_frame
from ridertide.operators.sequence import pooled_autoregression
from ridertide.operators.smoothing import holt_winters
from ridertide.session import stage
from ridertide.sources.events import filter_events, filter_terms, read_events_csv, read_events_parquet, timed_events
from ridertide.sources.tables import read_station_metadata, write_csv_tables, write_parquet

EXPERTS = ("smoothing", "trees", "sequence")
BLENDS = ("meta_static", "meta_context", "residual_linear", "residual_trees", "direct_static", "direct_context")


@dataclass
class StationResult:
    predictions: DataFrame
    models: list[str]
    best_base: str
    primary: str | None
    blend: blending.Blend
    summary: DataFrame
    validation_ranking: DataFrame
    metric_ci: DataFrame
    delta_ci: DataFrame
    profile: DataFrame
    blend_deltas: DataFrame
    candidates: DataFrame
    station_metadata: DataFrame | None = None
    terms: dict[str, DataFrame] = field(default_factory=dict)

    def validation(self) -> DataFrame:
        return self.predictions.filter(F.col("fold") == folds.TUNE)

    def test(self) -> DataFrame:
        return self.predictions.filter(F.col("fold") == folds.FULL)


def station_taps(spark: SparkSession, events_csv: str, cfg: StationConfig) -> DataFrame:
    """Events of the configured places."""
    terms = filter_terms(cfg.transport_type_id, cfg.place_ids, cfg.validation_modes)
    return timed_events(filter_events(read_events_csv(spark, events_csv), terms))


def layered_events(spark: SparkSession, events_csv: str, cfg: StationConfig, folder: str) -> DataFrame:
    """The line's timed events by way of two stored layers: all events with all columns, then the filtered rows with the
    known columns. Later runs read the second, which is as small as the line."""
    full, slim = f"{folder.rstrip('/')}/full", f"{folder.rstrip('/')}/filtered"
    write_parquet(read_events_csv(spark, events_csv), full)
    terms = filter_terms(cfg.transport_type_id, cfg.place_ids, cfg.validation_modes)
    write_parquet(filter_events(read_events_parquet(spark, full), terms), slim)
    return timed_events(read_events_parquet(spark, slim))


def station_metadata_of(spark: SparkSession, cfg: StationConfig) -> DataFrame | None:
    """The metadata that goes with a run; None without a path or a file."""
    try:
        return read_station_metadata(spark, cfg.station_metadata_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_station_events(events: DataFrame, cfg: StationConfig) -> StationResult:
    return run_station(series_counts(events, cfg), cfg)


def run_station(counts: DataFrame, cfg: StationConfig) -> StationResult:
    spark = counts.sparkSession
    counted = stage(counts)
    dates = folds.fold_dates(counted, cfg, ())
    within = folds.fold_range(dates, cfg)
    rows = stage(folds.day_folds(station_frame(counted, cfg, within), dates, cfg))
    attached = stage(context.attach_series_context(folds.clip_per_segment(rows, cfg), cfg))

    keys = ["fold", "step"]
    table = forecasts.anchors(attached)
    trees = boosting.station_trees(attached, cfg)
    found = {"smoothing": holt_winters(rows, cfg, (), floor=False), "trees": trees.forecasts}
    if cfg.run_sequence:
        found["sequence"] = pooled_autoregression(rows, cfg, cfg.seq_window, ())
    table = stage(forecasts.aligned(table, found, keys, {}).drop("without"))
    experts = [m for m in EXPERTS if m in table.columns]
    blending.require_forecasts(table, experts)
    validation, test = (table.filter(F.col("fold") == f) for f in (folds.TUNE, folds.FULL))

    ranking = stage(metrics.series_metrics(validation, experts, cfg.load_gamma))
    blend = blending.fit_blend(validation, experts, blending.station_least_rows(experts))
    scored = table.withColumns({"meta_static": blend.static(), "meta_context": blend.contextual()})
    models = [*experts, "meta_static", "meta_context"]
    primary, terms = None, {}
    if cfg.run_residual:
        names = metrics.top_models(ranking, "mae", 3)
        primary = names[0] if cfg.primary_mode == "auto" else cfg.primary_mode
        if cfg.sequence_in_residual and "sequence" in experts and "sequence" not in names:
            names.append("sequence")
        scored, terms = _residual_models(spark, scored, validation, names, primary, cfg)
        models += ["residual_linear", "residual_trees"]
    if cfg.run_direct:
        base = [m for m in ("smoothing", "trees") if m in experts]
        extra = boosting.available(validation, ("hl_daylag", "hour_sin", "hour_cos"))
        for name, columns in (("direct_static", base), ("direct_context", [*base, *extra])):
            scored = blending.direct_blend(validation, scored, columns, cfg.meta_trees, cfg.seed, name)
        models += ["direct_static", "direct_context"]

    scored = stage(scored)
    test = scored.filter(F.col("fold") == folds.FULL)
    summary = stage(metrics.series_metrics(test, models, cfg.load_gamma))
    best_base = metrics.best_model(summary.filter(F.col("model").isin(*experts)), "mae")
    reps = stage(
        bootstrap.block_replicates(test, models, "step", cfg.n_bootstrap, cfg.block_size, cfg.seed, cfg.load_gamma)
    )
    points = stage(bootstrap.block_estimates(test, models, cfg.load_gamma))
    return StationResult(
        predictions=scored,
        models=models,
        best_base=best_base,
        primary=primary,
        blend=blend,
        summary=metrics.leaderboard(summary, "mae"),
        validation_ranking=metrics.leaderboard(ranking, "mae"),
        metric_ci=bootstrap.metric_intervals(reps, points),
        delta_ci=bootstrap.delta_intervals(reps, points, [best_base]),
        profile=folds.split_profile(attached, cfg.time_col, None),
        blend_deltas=metrics.blend_deltas(summary, experts, [m for m in BLENDS if m in models]),
        candidates=trees.candidates("trees"),
        station_metadata=station_metadata_of(spark, cfg),
        terms=terms,
    )


def _residual_models(spark, scored, validation, names, primary, cfg):
    extra = boosting.available(validation, blending.STATION_META_CONTEXT)
    built = blending.meta_features(names, primary, extra, extremes=True)
    fit_table, columns = blending.with_meta(blending.with_residual(validation, primary), built)
    fit_table = stage(fit_table)
    wide, _ = blending.with_meta(scored, built)
    ridge = blending.fit_ridge(fit_table, columns, "residual", cfg.ridge_alpha)
    bounds = blending.residual_bounds(fit_table, primary, cfg.ridge_clip)
    wide = wide.withColumn("residual_linear", blending.corrected(primary, ridge.value(), bounds))
    trees = blending.fit_residual_trees(fit_table, columns, cfg.meta_trees, cfg.seed)
    bounds = blending.residual_bounds(fit_table, primary, cfg.trees_clip)
    wide = trees.add_prediction(wide, "tree_correction")
    wide = wide.withColumn("residual_trees", blending.corrected(primary, F.col("tree_correction"), bounds))
    terms = {
        "residual_linear_coef": ridge.terms(spark),
        "residual_trees_importance": blending.importance_terms(trees, spark),
    }
    return wide.drop("tree_correction", *columns), terms


def save_station(result: StationResult, folder: str) -> dict[str, str]:
    tables = {
        "summary_table": result.summary,
        "validation_base_ranking": result.validation_ranking,
        "bootstrap_metric_ci": result.metric_ci,
        "bootstrap_delta_ci": result.delta_ci,
        "test_predictions": result.test(),
        "validation_predictions": result.validation(),
        "split_profile": result.profile,
        "blend_deltas": result.blend_deltas,
        "candidate_scores": result.candidates,
    }
    if result.station_metadata is not None:
        tables["station_metadata"] = result.station_metadata
    tables.update({name: metrics.top_terms(t, t.columns[1], 20, name.endswith("coef")) for name, t in result.terms.items()})
    return write_csv_tables(tables, folder)


def run_sweep(events: DataFrame, configs: list[StationConfig]) -> tuple[DataFrame, dict[str, StationResult]]:
    """Each configuration in turn, and the best model of each.

    Events are counted once, at the largest bucket size that divides all others; each configuration sums these counts.
    """
    boards, results = None, {}
    finest = gcd(*[cfg.bucket_minutes for cfg in configs])
    counted = stage(series_counts(events, configs[0].but(bucket_minutes=finest, horizon_minutes=finest)))
    for cfg in configs:
        result = results[cfg.name] = run_station(rolled_up(counted, finest, cfg), cfg)
        board = result.summary.select(
            F.lit(cfg.name).alias("config_name"),
            F.lit(cfg.bucket_minutes).alias("bucket_minutes"),
            F.lit(cfg.horizon_minutes).alias("horizon_minutes"),
            "*",
        )
        boards = board if boards is None else boards.unionByName(board)
    return metrics.sweep_summary(boards), results
