"""Boosted-tree experts: a grid of candidates, scored on validation, the best few averaged and refitted."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridertide.config import NetworkConfig, SeriesConfig, StationConfig, TreeParams
from ridertide.functions.numeric import finite, row_mean
from ridertide.operators.context import RELATIVE_STATS, STATION_STATS, normalize_scale
from ridertide.operators.folds import EVAL, FULL, TRAIN, TUNE
from ridertide.operators.metrics import micro_metrics, series_metrics, top_models
from ridertide.operators.stumps import FittedStumps, fit_stumps
from ridertide.session import ensure_checkpoints, stage
from ridertide.sources.weather import WEATHER_FEATURES

# Feature lists of the network experts. The day lags follow the bucket size.
STATIC_FEATURES = (
    "station_key_code",
    "station_id_raw",
    "line_id_raw",
    "station_name_code",
    "line_name_code",
    "n_place_ids",
    "line_n_stations",
    "station_order_on_line_proxy",
    "station_order_norm",
    "distance_to_nearest_terminal_proxy",
    "distance_to_nearest_terminal_norm",
    "is_terminal_proxy",
    "is_ring_line_proxy",
)
CONTEXT_FEATURES = (
    "hl_daylag",
    "continuous_load_score",
    "local_slope_1",
    "local_slope_2",
    "daylag_deviation",
    "prev_count_ratio_daylag",
    "roll_std_2",
    "roll_std_4",
)
STATISTIC_FEATURES = ("q80_station", *STATION_STATS, *[name for name, _ in RELATIVE_STATS])


def available(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def base_features(cfg: SeriesConfig) -> list[str]:
    day = cfg.day_lag
    lags = list(dict.fromkeys((1, 2, 3, 4, 8, 12, 16, 24, day, day + 1)))
    return [*STATIC_FEATURES, *[f"lag_{n}" for n in lags], "roll_sum_4", "roll_mean_8", "hour_sin", "hour_cos"]


def rich_features(cfg: SeriesConfig) -> list[str]:
    return [*base_features(cfg), *CONTEXT_FEATURES, *STATISTIC_FEATURES, *WEATHER_FEATURES]


# Feature groups behind each context setting.
CONTEXT_GROUPS = {
    "highload_daylag": ("hl_daylag",),
    "continuous_load_score": ("continuous_load_score",),
    "local_slope": ("local_slope_1", "local_slope_2"),
    "daylag_deviation": ("daylag_deviation", "prev_count_ratio_daylag"),
}


@dataclass(frozen=True)
class SetSpec:
    """What a named feature set holds: the first lags, windows (by place in the settings) of sum and mean, switches."""

    name: str
    n_lags: int
    sum_window: int | None = None
    mean_window: int | None = None
    day: bool = False
    regime: bool = False


# The single-station feature sets.
SET_SPECS = (
    SetSpec("lags_short", 3, 0, 0),
    SetSpec("lags_hour", 5, 1, 1),
    SetSpec("lags_day_time", 5, day=True),
    SetSpec("lags_day_time_ctx", 5, day=True, regime=True),
    SetSpec("lags_extended", 8, 1, 2, day=True),
    SetSpec("lags_extended_ctx", 8, 1, 2, day=True, regime=True),
)


def set_columns(spec: SetSpec, cfg: StationConfig) -> tuple[str, ...]:
    """Columns of one feature set under the settings, each once."""
    context = cfg.context_features if cfg.boosting_context_features is None else cfg.boosting_context_features
    columns = [f"lag_{n}" for n in cfg.lags[: spec.n_lags]]
    if spec.day:
        columns += [f"lag_{cfg.day_lag}", f"lag_{cfg.day_lag + 1}"]
        if "hour_cyclical" in context:
            columns += ["hour_sin", "hour_cos"]  # fixed values
    for kind, window in (("sum", spec.sum_window), ("mean", spec.mean_window)):
        if window is not None:
            columns.append(f"roll_{kind}_{cfg.rolls[: window + 1][-1]}")
    if spec.regime:
        columns += [c for name, group in CONTEXT_GROUPS.items() if name in context for c in group]
        if "rolling_volatility" in context:
            columns.append(f"roll_std_{cfg.rolls[0]}")
    return tuple(dict.fromkeys(columns))


def feature_sets(cfg: StationConfig) -> dict[str, list[str]]:
    """The named single-station feature sets; a set equal to an earlier one is left out."""
    by_content = {}
    for spec in SET_SPECS:
        columns = set_columns(spec, cfg)
        by_content.setdefault(frozenset(columns), (spec.name, list(columns)))
    return dict(by_content.values())


def model_inputs(columns: list[str]) -> dict[str, Column]:
    """Clean feature columns: infinities and NaN count as missing, missing becomes 0 with a flag beside it.

    Spark trees have no branch for missing values, so the flag carries that information.
    """
    inputs = {}
    for c in columns:
        value = finite(F.col(c))
        inputs[f"in_{c}"] = F.coalesce(value, F.lit(0.0))
        if c.startswith(("lag_", "norm__", "roll_", "prev_", "daylag_", "continuous_", "local_", "weather_")):
            inputs[f"gap_{c}"] = value.isNull().cast("double")
    return inputs


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    inputs = model_inputs(columns)
    wide = df.withColumns(inputs)
    return VectorAssembler(inputCols=list(inputs), outputCol=out).transform(wide).drop(*inputs)


@dataclass
class FittedTrees:
    """A fitted booster and the factor that turns its output back into target units."""

    model: GBTRegressionModel
    columns: list[str]
    scale: float

    def on_features(self, df: DataFrame, name: str) -> DataFrame:
        """The prediction, where ``df`` has the assembled features."""
        scored = self.model.setFeaturesCol("features").setPredictionCol("tree_value").transform(df)
        return scored.withColumn(name, F.col("tree_value") * F.lit(self.scale)).drop("tree_value")

    def add_prediction(self, df: DataFrame, name: str) -> DataFrame:
        return self.on_features(assembled(df, self.columns), name).drop("features")

    def importances(self) -> dict[str, float]:
        """By feature; a feature and its missing flag count together."""
        out: dict[str, float] = {}
        for name, value in zip(model_inputs(self.columns), self.model.featureImportances.toArray(), strict=True):
            feature = name.split("_", 1)[1]
            out[feature] = out.get(feature, 0.0) + float(value)
        return out


@dataclass
class Training:
    """Training rows as one staged table of assembled features and scaled labels, which all fits on them share."""

    data: DataFrame
    columns: list[str]
    scale: float
    weight: str | None

    def fit(self, params: TreeParams, seed: int) -> FittedTrees:
        learner = GBTRegressor(
            featuresCol="features",
            labelCol="label",
            lossType="absolute",
            maxIter=params.rounds,
            stepSize=params.step,
            maxDepth=params.depth,
            subsamplingRate=params.row_fraction,
            featureSubsetStrategy=str(params.column_fraction) if params.column_fraction < 1 else "all",
            minInstancesPerNode=params.min_rows,
            maxBins=params.bins,
            seed=seed,
        )
        if self.weight:
            learner = learner.setWeightCol(self.weight)
        return FittedTrees(learner.fit(self.data), self.columns, self.scale)


def training(train: DataFrame, columns: list[str], label: str, weight: str | None = None) -> Training:
    """Rows without a label are left out; none left is an error.

    The label is divided by its spread first: boosting steps on absolute error have a fixed size, and this makes
    them fit the volume of the data.
    """
    ensure_checkpoints(train.sparkSession)
    labelled = train.filter(F.col(label).isNotNull())
    spread = labelled.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    if not spread[0]:
        raise ValueError("no training row has a target")
    scale = spread[1] or 1.0
    keep = ["features", "label"] + ([weight] if weight else [])
    data = assembled(labelled, columns).withColumn("label", F.col(label) / F.lit(scale)).select(*keep)
    return Training(stage(data), columns, scale, weight)


def fit_trees(
    train: DataFrame, columns: list[str], label: str, params: TreeParams, seed: int, weight: str | None = None
) -> FittedTrees | FittedStumps:
    """Boosted trees on absolute error, binned or with one level by exhaustive search."""
    if params.exhaustive:
        return fit_stumps(train, columns, label, params.rounds, params.step, params.min_rows, weight)
    return training(train, columns, label, weight).fit(params, seed)


def _fold(folds: DataFrame, fold: str, role: str) -> DataFrame:
    return folds.filter((F.col("fold") == fold) & (F.col("role") == role))


@dataclass
class Expert:
    """Forecasts of both folds, the validation scores of all candidates, and those chosen."""

    forecasts: DataFrame
    scores: DataFrame
    chosen: list[str]

    def candidates(self, name: str) -> DataFrame:
        """(expert, model, scores..., chosen): one row for each candidate."""
        return self.scores.select(F.lit(name).alias("expert"), "*", F.col("model").isin(self.chosen).alias("chosen"))


def tree_expert(
    folds: DataFrame,
    keys: list[str],
    sets: dict[str, list[str]],
    grid: tuple[TreeParams, ...],
    cfg: SeriesConfig,
    score: Callable[[DataFrame, list[str]], DataFrame],
    metric: str,
    label: str = "target_h",
    scale_back: Column | None = None,
    seed_step: int = 0,
) -> Expert:
    """Fit every (feature set, parameters) candidate on the tune fold, average the best ``top_k`` and refit those.

    Candidates are a driver-side list. Those of one feature set share a staged table of assembled features, and
    ``fit_threads`` of them are fitted at a time, so that the cluster is not idle between the small jobs of one fit.
    """
    candidates = {
        f"{name}__cfg{i}": (name, params, cfg.seed + seed_step * i)
        for name in sets
        for i, params in enumerate(grid, start=1)
    }

    def fitted(fold: str, names: list[str]) -> dict[str, FittedTrees | FittedStumps]:
        train = _fold(folds, fold, TRAIN)
        binned = dict.fromkeys(candidates[n][0] for n in names if not candidates[n][1].exhaustive)

        def prepare(set_name: str) -> Training:
            return training(train, sets[set_name], label)

        def fit(name: str) -> FittedTrees | FittedStumps:
            set_name, params, seed = candidates[name]
            if params.exhaustive:
                return fit_trees(train, sets[set_name], label, params, seed)
            return shared[set_name].fit(params, seed)

        with ThreadPoolExecutor(max(1, cfg.fit_threads)) as pool:
            inherited = inheritable_thread_target(folds.sparkSession)
            shared = dict(zip(binned, pool.map(inherited(prepare), binned), strict=True))
            return dict(zip(names, pool.map(inherited(fit), names), strict=True))

    def predict(fold: str, names: list[str]) -> DataFrame:
        rows, models = _fold(folds, fold, EVAL), fitted(fold, names)
        for set_name, columns in sets.items():
            own = [n for n in names if candidates[n][0] == set_name]
            trees = [n for n in own if isinstance(models[n], FittedTrees)]
            if trees:
                rows = assembled(rows, columns)
                for name in trees:
                    rows = models[name].on_features(rows, name)
                rows = rows.drop("features")
            for name in (n for n in own if n not in trees):
                rows = models[name].add_prediction(rows, name)
        if scale_back is not None:
            rows = rows.withColumns({n: F.greatest(F.col(n) * scale_back, F.lit(0.0)) for n in names})
        return rows

    validation = stage(predict(TUNE, list(candidates)))
    scores = score(validation.withColumnRenamed("target_h", "y_true"), list(candidates))
    chosen = top_models(scores, metric, cfg.top_k)
    average = row_mean([F.col(c) for c in chosen]).alias("pred")
    both = [validation.select("fold", *keys, average), predict(FULL, chosen).select("fold", *keys, average)]
    return Expert(both[0].unionByName(both[1]), scores, chosen)


def network_trees(folds: DataFrame, columns: list[str], cfg: NetworkConfig, label: str) -> Expert:
    """Global expert over all stations, candidates ranked by MAE."""
    return tree_expert(
        folds,
        ["station_key", "step"],
        {label: available(folds, columns)},
        cfg.tree_grid,
        cfg,
        lambda table, names: micro_metrics(table, names, cfg.load_gamma),
        "mae",
        seed_step=1,
    )


def normalized_trees(folds: DataFrame, columns: list[str], cfg: NetworkConfig, label: str) -> Expert:
    """Global expert on scale-free features and target, ranked by load-weighted MAE."""
    scaled, names = normalize_scale(folds, available(folds, columns))
    return tree_expert(
        stage(scaled),
        ["station_key", "step"],
        {label: names},
        cfg.tree_grid,
        cfg.but(seed=cfg.seed + 1000),
        lambda table, models: micro_metrics(table, models, cfg.load_gamma),
        "lw_mae",
        label="target_norm",
        scale_back=F.col("station_scale"),
        seed_step=1,
    )


def station_trees(folds: DataFrame, cfg: StationConfig) -> Expert:
    """Single-station expert over the named feature sets."""
    sets = {name: available(folds, columns) for name, columns in feature_sets(cfg).items()}
    return tree_expert(
        folds,
        ["step"],
        sets,
        cfg.tree_grid,
        cfg,
        lambda table, names: series_metrics(table, names, cfg.load_gamma),
        "mae",
    )
