"""Run settings for the two product lines: a network of stations, and one station."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Line codes that make up the default network scope.
DEFAULT_LINE_CODES = (8, 9, 12, 13, 14, 15, 16, 17, 18, 609, 1500, 1509, 1691, 1749, 1779, 2162)

# The ring line's code and the text its name contains.
RING_LINE_CODE = 609
RING_LINE_TEXT = "кольцев"

MINUTES_PER_DAY = 1440


@dataclass(frozen=True)
class TreeParams:
    """One boosted-tree candidate."""

    rounds: int
    step: float
    depth: int
    row_fraction: float = 1.0
    column_fraction: float = 1.0
    min_rows: int = 1
    #: Split candidates per feature; at least the number of distinct station codes that should stay apart.
    bins: int = 256
    #: One-level trees by a search over all values of all features, in place of binned trees.
    exhaustive: bool = False


# Candidate grids and meta-layer boosters.
NETWORK_GRID = (
    TreeParams(250, 0.05, 4, 0.85, 0.85),
    TreeParams(400, 0.04, 5, 0.85, 0.85),
    TreeParams(600, 0.03, 6, 0.90, 0.90),
)
STATION_GRID = (
    TreeParams(200, 0.05, 4, 0.80, 0.80),
    TreeParams(300, 0.05, 5, 0.80, 0.80),
    TreeParams(500, 0.03, 6, 0.85, 0.85),
)
NETWORK_RESIDUAL_TREES = TreeParams(100, 0.03, 2, 0.85, 0.85, 20)
STATION_META_TREES = TreeParams(20, 0.03, 1, 0.80, 0.80, 8)


@dataclass(frozen=True)
class SeriesConfig:
    """Grid settings shared by both lines."""

    bucket_minutes: int = 15
    horizon_minutes: int = 60
    day_start_hour: int = 0
    weekdays: tuple[int, ...] = (0, 1, 2, 3)
    highload_quantile: float = 0.8
    load_gamma: float = 1.0
    seed: int = 3228
    top_k: int = 3
    # Window operators run on slices of this many days, so one long series spreads over many tasks.
    slice_days: int = 28
    # Candidates that are fitted at the same time; each fit is a row of small jobs.
    fit_threads: int = 6

    def __post_init__(self):
        if MINUTES_PER_DAY % self.bucket_minutes:
            raise ValueError("bucket_minutes must divide 1440")
        if self.horizon_minutes % self.bucket_minutes:
            raise ValueError("horizon_minutes must be divisible by bucket_minutes")

    @property
    def day_lag(self) -> int:
        return MINUTES_PER_DAY // self.bucket_minutes

    @property
    def horizon_steps(self) -> int:
        return self.horizon_minutes // self.bucket_minutes

    @property
    def time_col(self) -> str:
        return f"bucket_{self.bucket_minutes}m"

    @property
    def slice_steps(self) -> int:
        return self.slice_days * self.day_lag

    def but(self, **changes):
        return replace(self, **changes)


@dataclass(frozen=True)
class NetworkConfig(SeriesConfig):
    """Many stations at once; the unit of observation is (station, time)."""

    name: str = "network_15m_60m_opday3"
    day_start_hour: int = 3
    transport_type_id: int | None = 1
    validation_modes: tuple[int, ...] = ()
    place_type_id: int = 1
    line_codes: tuple[int, ...] | None = DEFAULT_LINE_CODES
    line_filter: str | None = None
    n_bootstrap: int = 1000
    tree_grid: tuple[TreeParams, ...] = NETWORK_GRID
    residual_trees: TreeParams = NETWORK_RESIDUAL_TREES
    run_trees: bool = True
    run_residual: bool = True
    run_smoothing: bool = True
    run_sequence: bool = True
    seq_window: int = 24
    ridge_alpha: float = 10.0
    ridge_clip: tuple[float, float] = (0.05, 0.95)
    trees_clip: tuple[float, float] = (0.10, 0.90)
    pool_tolerance: float = 1.05
    #: Hourly weather file; a run goes on without weather if there is none.
    weather_path: str | None = None

    @property
    def lags(self) -> tuple[int, ...]:
        # Lags and windows in buckets.
        day = self.day_lag
        return tuple(sorted({1, 2, 3, 4, 8, 12, 16, 24, day, day + 1, 2 * day}))

    @property
    def rolls(self) -> tuple[int, ...]:
        return (2, 4, 8, 12, 16)

    @property
    def volatility_rolls(self) -> tuple[int, ...]:
        return (2, 4)

    @property
    def lookback(self) -> int:
        """Rows before an anchor that its features reach."""
        return max(*self.lags, *self.rolls)


@dataclass(frozen=True)
class StationConfig(SeriesConfig):
    """One station; the unit of observation is time."""

    name: str = "station_15m_60m"
    transport_type_id: int | None = 1
    place_ids: tuple[int, ...] = (1623, 1624)
    validation_modes: tuple[int, ...] = ()
    # Lags, windows, seed and clip quantiles of the default settings.
    lag_minutes: tuple[int, ...] = (15, 30, 45, 60, 120, 180, 240, 360, 1440, 1455, 2880)
    rolling_minutes: tuple[int, ...] = (30, 60, 120, 180, 240)
    context_features: tuple[str, ...] = ("highload_daylag", "hour_cyclical")
    boosting_context_features: tuple[str, ...] | None = None
    primary_mode: str = "auto"
    n_bootstrap: int = 2000
    tree_grid: tuple[TreeParams, ...] = STATION_GRID
    meta_trees: TreeParams = STATION_META_TREES
    run_sequence: bool = True
    run_residual: bool = True
    run_direct: bool = False
    sequence_in_residual: bool = False
    ridge_alpha: float = 10.0
    ridge_clip: tuple[float, float] = (0.05, 0.95)
    trees_clip: tuple[float, float] = (0.10, 0.90)
    #: Table that goes with a run's results, by suffix .csv, .parquet or .pq.
    station_metadata_path: str | None = None

    def _steps(self, minutes, least: int) -> tuple[int, ...]:
        return tuple(sorted({max(least, round(m / self.bucket_minutes)) for m in minutes}))

    @property
    def lags(self) -> tuple[int, ...]:
        return self._steps(self.lag_minutes, 1)

    @property
    def rolls(self) -> tuple[int, ...]:
        return self._steps(self.rolling_minutes, 2)

    @property
    def lookback(self) -> int:
        """Rows before an anchor that its features reach."""
        return max(*self.lags, *self.rolls, self.day_lag + 1, 3)

    @property
    def seq_window(self) -> int:
        return self.day_lag

    @property
    def block_size(self) -> int:
        return max(self.horizon_steps, 4)


# The rich context groups.
RICH_CONTEXT = (
    "highload_daylag",
    "hour_cyclical",
    "continuous_load_score",
    "local_slope",
    "daylag_deviation",
    "rolling_volatility",
)


def station_presets() -> dict[str, StationConfig]:
    """The named single-station set-ups."""
    # Names, sizes, lags and windows of the presets.
    base = StationConfig()
    rich = base.but(context_features=RICH_CONTEXT)
    presets = [
        base.but(name="15m_15m", horizon_minutes=15),
        base.but(name="15m_60m"),
        base.but(
            name="60m_360m",
            bucket_minutes=60,
            horizon_minutes=360,
            lag_minutes=(60, 120, 180, 240, 360, 720, 1440, 1500, 2880),
            rolling_minutes=(60, 120, 180, 240, 360),
        ),
        rich.but(name="15m_60m_rich"),
        rich.but(name="15m_60m_rich_meta", boosting_context_features=("highload_daylag", "hour_cyclical")),
        rich.but(name="15m_60m_rich_base_boost", boosting_context_features=("hour_cyclical",)),
        rich.but(name="15m_60m_rich_rich_boost", boosting_context_features=RICH_CONTEXT),
        rich.but(
            name="15m_60m_rich_base_boost_opday3",
            boosting_context_features=("hour_cyclical",),
            day_start_hour=3,
        ),
        rich.but(
            name="15m_60m_rich_rich_boost_opday3",
            boosting_context_features=RICH_CONTEXT,
            day_start_hour=3,
        ),
    ]
    return {p.name: p for p in presets}
