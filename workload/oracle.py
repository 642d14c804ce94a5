"""SQL counterparts of the registered queries, for DuckDB over the same tables.

The statements are written for clarity, not speed: bootstrap replicates, for one, join the drawn rows again instead
of using sums, so both sides reach the result in their own way.
"""

from __future__ import annotations

import re

from ridertide.functions.draws import draw_sql
from ridertide.operators.boosting import feature_sets, rich_features
from ridertide.operators.context import is_magnitude
from ridertide.operators.smoothing import CONSTANTS
from workload.inputs import LONG_WINDOW, NETWORK, STATION, STUMP_ROWS, STUMPS

LAGS = NETWORK.lags
ROLLS = NETWORK.rolls
MODELS = ("seasonal", "recent", "typical")


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


CTES = {
    "place_map": """
        SELECT c_custkey AS place_id, n_nationkey::BIGINT AS st_code, n_name AS st_name, r_regionkey::BIGINT AS ln_code,
               r_name AS ln_name, printf('ln%05d_st%05d', r_regionkey, n_nationkey) AS station_key
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "stations": """
        SELECT station_key, any_value(st_code) AS st_code, any_value(st_name) AS st_name,
               any_value(ln_code) AS ln_code, any_value(ln_name) AS ln_name,
               count(DISTINCT place_id) AS n_place_ids,
               array_to_string(list_sort(list(DISTINCT place_id)), ',') AS place_ids
        FROM place_map GROUP BY station_key""",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY ln_code ORDER BY st_code, station_key) AS pos,
               count(*) OVER (PARTITION BY ln_code) AS line_n
        FROM stations""",
    "structure": """
        SELECT station_key, pos AS station_order_on_line_proxy, line_n AS line_n_stations,
               CASE WHEN line_n > 1 THEN (pos - 1) / (line_n - 1)::DOUBLE ELSE 0.0 END AS station_order_norm,
               CASE WHEN ln_code = 609 THEN 1 ELSE 0 END::BIGINT AS is_ring_line_proxy,
               CASE WHEN ln_code = 609 THEN 0.0 ELSE least(pos - 1, line_n - pos)::DOUBLE END
                   AS distance_to_nearest_terminal_proxy,
               CASE WHEN ln_code = 609 OR line_n = 1 THEN 0.0 ELSE least(pos - 1, line_n - pos) / (line_n - 1)::DOUBLE
                   END AS distance_to_nearest_terminal_norm,
               CASE WHEN ln_code <> 609 AND (pos = 1 OR pos = line_n) THEN 1 ELSE 0 END::BIGINT AS is_terminal_proxy
        FROM placed""",
    "counts": """
        SELECT station_key, time_bucket(INTERVAL 60 MINUTE, ts) AS t, count(*)::DOUBLE AS cnt
        FROM events JOIN place_map ON user_id = place_id GROUP BY 1, 2""",
    "bounds": "SELECT station_key, min(t) AS lo, max(t) AS hi FROM counts GROUP BY 1",
    "grid": "SELECT station_key, unnest(generate_series(lo, hi, INTERVAL 60 MINUTE)) AS t FROM bounds",
    "dense": """
        SELECT station_key, t, coalesce(cnt, 0.0) AS cnt FROM grid LEFT JOIN counts USING (station_key, t)""",
    "codes": """
        SELECT station_key, dense_rank() OVER (ORDER BY station_key) - 1 AS station_key_code,
               dense_rank() OVER (ORDER BY st_name) - 1 AS station_name_code,
               dense_rank() OVER (ORDER BY ln_name) - 1 AS line_name_code,
               st_code AS station_id_raw, ln_code AS line_id_raw
        FROM stations WHERE station_key IN (SELECT station_key FROM counts)""",
    "weather": """
        SELECT date_trunc('hour', ts) AS weather_hour, arg_max(value, ts) AS weather_temperature_2m,
               arg_max(length(props), ts)::DOUBLE AS weather_wind_speed_10m
        FROM events GROUP BY 1""",
}


def _windows(sizes, lags, stds, horizon: int, partition: str, extra: str = "") -> str:
    columns = []
    for n in lags:
        columns.append(f"lag(cnt, {n}) OVER w AS lag_{n}")
    for n in sizes:
        frame = f"(w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for kind, fn in (("sum", "sum"), ("mean", "avg")):
            columns.append(
                f"CASE WHEN count(*) OVER {frame} = {n} THEN {fn}(cnt) OVER {frame} END AS roll_{kind}_{n}"
            )
    for n in stds:
        frame = f"(w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        columns.append(f"CASE WHEN count(*) OVER {frame} = {n} THEN stddev_samp(cnt) OVER {frame} END AS roll_std_{n}")
    ahead = f"(w ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)"
    columns.append(f"CASE WHEN count(*) OVER {ahead} = {horizon} THEN sum(cnt) OVER {ahead} END AS target_h")
    return f"SELECT *, {', '.join(columns)}{extra} FROM {{source}} WINDOW w AS ({partition} ORDER BY t)"


CALENDAR = """
    (t - INTERVAL 3 HOUR)::DATE AS date, isodow(t - INTERVAL 3 HOUR) - 1 AS day_of_week,
    hour(t - INTERVAL 3 HOUR) AS slot_in_day,
    sin(2 * pi() * hour(t - INTERVAL 3 HOUR) / 24) AS hour_sin,
    cos(2 * pi() * hour(t - INTERVAL 3 HOUR) / 24) AS hour_cos"""

SLOPES = """
    lag_1 - lag_2 AS local_slope_1, lag_1 - lag_3 AS local_slope_2, lag_1 - lag_24 AS daylag_deviation,
    lag_1 / nullif(lag_24, 0) AS prev_count_ratio_daylag"""

CTES["windowed"] = _windows(ROLLS, LAGS, (2, 4), 3, "PARTITION BY station_key").format(source="dense")
CTES["frame"] = f"""
    SELECT *, lag(target_h, 24) OVER (PARTITION BY station_key ORDER BY t) AS target_daylag, {CALENDAR}, {SLOPES}
    FROM windowed"""
CTES["days"] = """
    SELECT date, row_number() OVER (ORDER BY date) AS d
    FROM (SELECT DISTINCT date FROM frame WHERE day_of_week <= 3)"""
CTES["parts"] = """
    SELECT * FROM (VALUES (1, 'tune', 'train'), (2, 'tune', 'train'), (3, 'tune', 'eval'), (1, 'full', 'train'),
                          (2, 'full', 'train'), (3, 'full', 'train'), (4, 'full', 'eval')) v(d, fold, role)"""
CTES["split"] = "SELECT fold, role, f.* FROM frame f JOIN days USING (date) JOIN parts USING (d)"
CTES["clipped"] = """
    SELECT * FROM split
    QUALIFY t <= max(t) OVER (PARTITION BY fold, role, station_key, date) - INTERVAL 180 MINUTE"""
CTES["own"] = """
    SELECT fold, station_key, avg(target_h) AS station_train_mean_target,
           quantile_cont(target_h, 0.5) AS station_train_median_target,
           quantile_cont(target_h, 0.8) AS station_train_q80_target,
           quantile_cont(target_h, 0.95) AS station_train_q95_target,
           max(target_h) AS station_train_max_target, avg(cnt) AS station_train_mean_count
    FROM clipped WHERE role = 'train' GROUP BY ALL"""
CTES["overall"] = """
    SELECT fold, avg(target_h) AS g_mean, quantile_cont(target_h, 0.5) AS g_median,
           quantile_cont(target_h, 0.8) AS g_q80, quantile_cont(target_h, 0.95) AS g_q95, max(target_h) AS g_max,
           avg(cnt) AS g_count
    FROM clipped WHERE role = 'train' GROUP BY ALL"""
CTES["filled"] = """
    SELECT c.*, g.g_mean,
           coalesce(station_train_mean_target, g_mean) AS station_train_mean_target,
           coalesce(station_train_median_target, g_median) AS station_train_median_target,
           coalesce(station_train_q80_target, g_q80) AS station_train_q80_target,
           coalesce(station_train_q95_target, g_q95) AS station_train_q95_target,
           coalesce(station_train_max_target, g_max) AS station_train_max_target,
           coalesce(station_train_mean_count, g_count) AS station_train_mean_count,
           coalesce(station_train_mean_target, g_mean) / greatest(g_mean, 1e-9) AS station_mean_target_vs_global,
           coalesce(station_train_q80_target, g_q80) / greatest(g_q80, 1e-9) AS station_q80_target_vs_global,
           coalesce(station_train_mean_count, g_count) / greatest(g_count, 1e-9) AS station_mean_count_vs_global
    FROM clipped c JOIN overall g USING (fold) LEFT JOIN own o USING (fold, station_key)"""
CTES["context"] = """
    SELECT *, nullif(station_train_q80_target, 0) AS q80_station,
           CASE WHEN target_daylag > nullif(station_train_q80_target, 0) THEN 1 ELSE 0 END::BIGINT AS hl_daylag,
           CASE WHEN target_h > nullif(station_train_q80_target, 0) THEN 1 ELSE 0 END::BIGINT AS hl_actual,
           target_daylag / nullif(station_train_q80_target, 0) AS continuous_load_score
    FROM filled"""
CTES["seasonal_table"] = """
    SELECT *, target_h AS y_true, coalesce(target_daylag, lag_24, g_mean) AS seasonal
    FROM context WHERE role = 'eval'"""
CTES["predictions"] = """
    SELECT *, coalesce(roll_mean_16 * 3, seasonal) AS recent, station_train_mean_target AS typical
    FROM seasonal_table"""
CTES["validation"] = "SELECT * FROM predictions WHERE fold = 'tune'"
CTES["test"] = "SELECT * FROM predictions WHERE fold = 'full'"
CTES["long"] = " UNION ALL ".join(
    f"SELECT station_key, t, y_true, hl_actual, station_train_mean_target AS sm, '{m}' AS model, {m} AS pred FROM test"
    for m in MODELS
)
CTES["typical_mean"] = """
    SELECT median(station_train_mean_target) AS m FROM validation WHERE station_train_mean_target > 0"""
CTES["weighted"] = """
    SELECT v.*, least(greatest(greatest(y_true, 0) / greatest(CASE WHEN station_train_mean_target > 0
               THEN station_train_mean_target ELSE coalesce(m, 1.0) END, 1e-9), 0.25), 8.0) AS w
    FROM validation v CROSS JOIN typical_mean"""


def _metrics(source: str, by: str) -> str:
    """Metric values straight from rows, per group."""
    return f"""
        SELECT {by}, avg(ae) AS mae, sqrt(avg(ae * ae)) AS rmse, sum(ae) / nullif(sum(abs(y_true)), 0) AS wmape,
               avg(ae * greatest(y_true, 0) / greatest(coalesce(nullif(sm, 0), set_mean), 1e-9)) AS lw_mae,
               avg(ae) FILTER (hl_actual = 1) AS hl_mae,
               avg(greatest(y_true - pred, 0)) FILTER (hl_actual = 1) AS hl_under_mae,
               avg((pred < y_true)::INT) FILTER (hl_actual = 1) AS hl_under_rate
        FROM (SELECT *, abs(y_true - pred) AS ae, avg(y_true) OVER (PARTITION BY {by}) AS set_mean FROM {source})
        GROUP BY {by}"""


CTES["micro"] = _metrics("long", "model")
CTES["per_station"] = _metrics("long", "model, station_key")
METRICS = ("mae", "rmse", "wmape", "lw_mae", "hl_mae", "hl_under_mae", "hl_under_rate")
CTES["macro"] = f"SELECT model, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM per_station GROUP BY model"


def _unpivot(source: str, mode: str, keys: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{mode}' AS mode, '{m}' AS metric, {m} AS {value} FROM {source}" for m in METRICS
    )


CTES["points"] = f"{_unpivot('micro', 'micro', 'model', 'estimate')} UNION ALL {_unpivot('macro', 'macro', 'model', 'estimate')}"
CTES["ranked_stations"] = """
    SELECT station_key, row_number() OVER (ORDER BY station_key) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT station_key FROM test)"""
CTES["draws"] = f"""
    SELECT rep, {draw_sql("rep", "i", NETWORK.seed, "n")} AS i
    FROM ranked_stations, range({NETWORK.n_bootstrap}) reps(rep)"""
CTES["drawn"] = """
    SELECT rep, l.* FROM draws d JOIN ranked_stations s USING (i) JOIN long l USING (station_key)"""
CTES["micro_reps"] = _metrics("drawn", "rep, model")
CTES["station_reps"] = _metrics("drawn", "rep, model, station_key")
CTES["macro_reps"] = (
    f"SELECT rep, model, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM station_reps GROUP BY rep, model"
)
CTES["reps"] = f"{_unpivot('micro_reps', 'micro', 'rep, model', 'value')} UNION ALL {_unpivot('macro_reps', 'macro', 'rep, model', 'value')}"

# The single series: all events together.
SERIES_LAGS = STATION.lags
SERIES_ROLLS = STATION.rolls


def _series(horizon: int, suffix: str) -> dict[str, str]:
    """CTEs of the single series for one horizon."""
    steps = horizon // 60
    recent = SERIES_ROLLS[-1]
    extra = ", lag(cnt, 24) OVER w AS count_daylag, lag(cnt, 1) OVER w AS prev_count, lag(cnt, 25) OVER w AS prev_count_daylag"
    windowed = _windows(SERIES_ROLLS, SERIES_LAGS, SERIES_ROLLS[:1], steps, "", extra)
    return {
        f"s_windowed{suffix}": windowed.format(source="s_dense"),
        f"s_frame{suffix}": f"""
            SELECT *, lag(target_h, 24) OVER (ORDER BY t) AS target_daylag, {CALENDAR},
                   prev_count - prev_count_daylag AS daylag_deviation, lag_1 - lag_2 AS local_slope_1,
                   lag_1 - lag_3 AS local_slope_2, prev_count / nullif(prev_count_daylag, 0) AS prev_count_ratio_daylag
            FROM s_windowed{suffix}""",
        f"s_days{suffix}": f"""
            SELECT date, row_number() OVER (ORDER BY date) AS d
            FROM (SELECT DISTINCT date FROM s_frame{suffix} WHERE day_of_week <= 3)""",
        f"s_clipped{suffix}": f"""
            SELECT fold, role, f.* FROM s_frame{suffix} f JOIN s_days{suffix} USING (date) JOIN parts USING (d)
            QUALIFY t <= max(t) OVER (PARTITION BY fold, role) - INTERVAL {horizon} MINUTE""",
        f"s_context{suffix}": f"""
            SELECT c.*, q_train, CASE WHEN target_h > q_train THEN 1 ELSE 0 END::BIGINT AS hl_actual,
                   CASE WHEN target_daylag > q_train THEN 1 ELSE 0 END::BIGINT AS hl_daylag,
                   target_daylag / nullif(q_train, 0) AS continuous_load_score
            FROM s_clipped{suffix} c
            JOIN (SELECT fold, quantile_cont(target_h, 0.8) AS q_train FROM s_clipped{suffix}
                  WHERE role = 'train' GROUP BY fold) USING (fold)""",
        f"s_test{suffix}": f"""
            SELECT t, target_h AS y_true, coalesce(target_daylag, lag_24 * {steps}) AS daylag,
                   coalesce(roll_mean_{recent} * {steps}, target_daylag, lag_24 * {steps}) AS recent
            FROM s_context{suffix} WHERE fold = 'full' AND role = 'eval'""",
        f"s_long{suffix}": " UNION ALL ".join(
            f"SELECT t, y_true, '{m}' AS model, {m} AS pred FROM s_test{suffix}" for m in ("daylag", "recent")
        ),
        f"s_metrics{suffix}": _series_metrics(f"s_long{suffix}", "model"),
    }


def _series_metrics(source: str, by: str) -> str:
    return f"""
        SELECT {by}, avg(ae) AS mae, sqrt(avg(ae * ae)) AS rmse, sum(ae) / nullif(sum(abs(y_true)), 0) AS wmape,
               avg(ae * y_true / nullif(set_mean, 0)) AS lw_mae
        FROM (SELECT *, abs(y_true - pred) AS ae, avg(y_true) OVER (PARTITION BY {by}) AS set_mean FROM {source})
        GROUP BY {by}"""


CTES["s_counts"] = "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS t, count(*)::DOUBLE AS cnt FROM events GROUP BY 1"
CTES["s_dense"] = """
    SELECT t, coalesce(cnt, 0.0) AS cnt
    FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 60 MINUTE)) AS t FROM s_counts)
    LEFT JOIN s_counts USING (t)"""
CTES.update(_series(180, ""))
CTES.update(_series(60, "_h60"))
BLOCK = STATION.block_size
CTES["s_rows"] = "SELECT *, row_number() OVER (PARTITION BY model ORDER BY t) - 1 AS i FROM s_long"
CTES["s_size"] = "SELECT count(*) AS n FROM s_test"
CTES["s_blocks"] = f"""
    SELECT rep, block, {draw_sql("rep", "block", STATION.seed, f"n - {BLOCK} + 1")} AS start, n
    FROM (SELECT rep, n, unnest(range((n + {BLOCK} - 1) // {BLOCK})) AS block
          FROM s_size, range({STATION.n_bootstrap}) a(rep))"""
CTES["s_places"] = f"""
    SELECT rep, start + k AS i FROM s_blocks, range({BLOCK}) c(k) WHERE block * {BLOCK} + k < n"""
CTES["s_drawn"] = "SELECT rep, s.* FROM s_places p JOIN s_rows s USING (i)"
CTES["s_reps"] = _series_metrics("s_drawn", "rep, model")

# Closed forms for two forecasts. With gaps, one of them is missing at some hours.
GAP_SQL = "hour(t) % 3 = 0"
CTES["gram_all"] = """
    SELECT CASE WHEN ctx.c IS NULL THEN -1 ELSE ctx.c END AS c, count(*) AS n, sum(seasonal * seasonal) AS a,
           sum(seasonal * recent) AS b, sum(recent * recent) AS d, sum(seasonal * y_true) AS p, sum(recent * y_true) AS q
    FROM validation, (VALUES (NULL), (0), (1)) ctx(c)
    WHERE ctx.c IS NULL OR ctx.c = hl_daylag GROUP BY 1"""
CTES["gram_lw"] = """
    SELECT CASE WHEN ctx.c IS NULL THEN -1 ELSE ctx.c END AS c, count(*) AS n, sum(w * seasonal * seasonal) AS a,
           sum(w * seasonal * recent) AS b, sum(w * recent * recent) AS d, sum(w * seasonal * y_true) AS p,
           sum(w * recent * y_true) AS q
    FROM weighted, (VALUES (NULL), (0), (1)) ctx(c)
    WHERE ctx.c IS NULL OR ctx.c = hl_daylag GROUP BY 1"""


def _pair_weights(gram: str) -> str:
    """Non-negative weights for two columns: both free if both come out non-negative, else the better single one."""
    return f"""
        SELECT c, n, CASE WHEN u >= 0 AND v >= 0 THEN u
                          WHEN p * p / a >= q * q / d THEN greatest(p / a, 0) ELSE 0 END AS u,
               CASE WHEN u >= 0 AND v >= 0 THEN v
                    WHEN p * p / a >= q * q / d THEN 0 ELSE greatest(q / d, 0) END AS v
        FROM (SELECT *, (d * p - b * q) / (a * d - b * b) AS u, (a * q - b * p) / (a * d - b * b) AS v FROM {gram})"""


def _shares(weights: str) -> str:
    return f"""
        SELECT c, n, CASE WHEN u + v > 0 THEN u / (u + v) ELSE 0.5 END AS u,
               CASE WHEN u + v > 0 THEN v / (u + v) ELSE 0.5 END AS v FROM {weights}"""


CTES["gram_gaps"] = CTES["gram_all"].replace("WHERE ctx", f"WHERE ({GAP_SQL}) IS FALSE AND (ctx").replace(" GROUP BY", ") GROUP BY")

for _name, _gram in (("", "gram_all"), ("_lw", "gram_lw"), ("_gaps", "gram_gaps")):
    CTES[f"raw_weights{_name}"] = _pair_weights(_gram)
    CTES[f"shares{_name}"] = _shares(f"raw_weights{_name}")
    CTES[f"blended{_name}"] = f"""
        SELECT x.station_key, x.t, g.u * seasonal + g.v * recent AS pred,
               CASE WHEN s.n >= 30 THEN s.u * seasonal + s.v * recent ELSE g.u * seasonal + g.v * recent END
                   AS pred_context
        FROM test x JOIN shares{_name} g ON g.c = -1 LEFT JOIN shares{_name} s ON s.c = x.hl_daylag"""

CTES["resid"] = "SELECT *, recent AS x1, hl_daylag::DOUBLE AS x2, y_true - seasonal AS res FROM validation"
CTES["ridge"] = """
    SELECT m1, m2, mr, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1,
           (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2, lo, hi
    FROM (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(res) AS mr, var_pop(x1) * count(*) + 10 AS s11,
                 var_pop(x2) * count(*) + 10 AS s22, covar_pop(x1, x2) * count(*) AS s12,
                 covar_pop(x1, res) * count(*) AS c1, covar_pop(x2, res) * count(*) AS c2,
                 quantile_cont(res, 0.05) AS lo, quantile_cont(res, 0.95) AS hi FROM resid)"""

CTES["scales"] = """
    SELECT *, coalesce(station_train_q80_target, q80_station, station_train_mean_target, station_train_median_target,
                       station_train_mean_count) AS own_scale FROM context"""
CTES["scaled"] = """
    SELECT s.*, greatest(coalesce(own_scale, typical, 1.0), 1.0) AS station_scale
    FROM scales s JOIN (SELECT fold, role, median(own_scale) AS typical FROM scales GROUP BY ALL) USING (fold, role)"""

W = NETWORK.seq_window
CTES["numbered"] = """
    SELECT *, row_number() OVER (PARTITION BY fold, station_key ORDER BY t) - 1 AS i,
           count(*) FILTER (role = 'train') OVER (PARTITION BY fold, station_key) AS n_train,
           count(*) FILTER (role = 'eval') OVER (PARTITION BY fold, station_key) AS n_eval,
           avg(cnt) FILTER (role = 'train') OVER (PARTITION BY fold, station_key) AS series_mean,
           stddev_pop(cnt) FILTER (role = 'train') OVER (PARTITION BY fold, station_key) + 1e-8 AS series_std
    FROM split"""


def _sequence(window: int) -> str:
    return f"""
        SELECT * FROM (
            SELECT fold, role, station_key, t, i, n_train, n_eval, series_mean, series_std, cnt,
                   lag(cnt, {window - 1}) OVER w AS oldest_count,
                   sum(cnt) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future
            FROM numbered WINDOW w AS (PARTITION BY fold, station_key ORDER BY t))
        WHERE n_train >= {window + 4} AND n_eval >= 4 AND i >= {window - 1}
          AND i + 3 < CASE WHEN role = 'train' THEN n_train ELSE n_train + n_eval END"""


CTES["seq"] = _sequence(W)
CTES["seq_long"] = _sequence(LONG_WINDOW)
CTES["seq_two"] = _sequence(2)
CTES["two_lags"] = """
    SELECT *, (oldest_count - series_mean) / series_std AS x1, (cnt - series_mean) / series_std AS x2,
           (future - 3 * series_mean) / series_std AS y FROM seq_two"""
CTES["two_fit"] = """
    SELECT fold, m1, m2, my, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1,
           (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2
    FROM (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1,
                 covar_pop(x2, y) AS c2, var_pop(x1) + 0.01 / stddev_pop(y) AS s11,
                 var_pop(x2) + 0.01 / stddev_pop(y) AS s22
          FROM two_lags WHERE role = 'train' GROUP BY fold)"""

# Holt-Winters as a recursion over the counts, for all constants at once.
CTES["hw_grid"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(CONSTANTS)) + ") g(place, a, b, c)"
CTES["hw_series"] = """
    SELECT *, list_sum(ys[1:24]) / 24 AS first_day, list_sum(ys[25:48]) / 24 AS second_day
    FROM (SELECT fold, station_key, list(cnt ORDER BY t) FILTER (role = 'train') AS ys,
                 list(t ORDER BY t) FILTER (role = 'eval') AS ahead FROM split GROUP BY ALL)
    WHERE len(ys) >= 48 AND len(ahead) > 3"""
CTES["hw_state"] = """
    SELECT fold, station_key, place, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, 0 AS i, first_day AS level,
           (second_day - first_day) / 24 AS trend, list_transform(ys[1:24], lambda x: x - first_day) AS seasons,
           0.0::DOUBLE AS cost
    FROM hw_series CROSS JOIN hw_grid
    UNION ALL
    SELECT fold, station_key, place, a, b, c, i + 1, raised, b * (raised - level) + (1 - b) * trend,
           list_append(seasons[2:], c * (y - raised) + (1 - c) * season), cost + error * error
    FROM (SELECT s.*, ys[i + 1] AS y, seasons[1] AS season,
                 a * (ys[i + 1] - seasons[1]) + (1 - a) * (level + trend) AS raised,
                 ys[i + 1] - level - trend - seasons[1] AS error
          FROM hw_state s JOIN hw_series USING (fold, station_key) WHERE i < len(ys))"""
CTES["hw_path"] = """
    SELECT fold, station_key, ahead, list_transform(range(1, len(ahead) + 1),
           lambda k: greatest(level + k * trend + seasons[(k - 1) % 24 + 1], 0)) AS path
    FROM hw_state JOIN hw_series USING (fold, station_key) WHERE i = len(ys)
    QUALIFY row_number() OVER (PARTITION BY fold, station_key ORDER BY round(cost, 9), place) = 1"""


# One-level trees: every threshold of every feature, missing values on either side.


def _listed(columns: dict[str, str]) -> str:
    return f"[{', '.join(f'round(({c})::DOUBLE, 9)' for c in columns.values())}]"


def _stumps(name: str, train: str, ahead: str, columns: dict[str, str], label: str, least: list[int]) -> None:
    """CTEs that fit and apply the stumps with ``least`` rows on each side: <name>_best and <name>_pred. ``train`` and
    ``ahead`` have a fold column."""
    CTES[f"{name}_long"] = f"""
        SELECT fold, unnest(range(1, {len(columns) + 1})) AS idx, unnest({_listed(columns)}) AS v, ({label})::DOUBLE AS y
        FROM {train} WHERE ({label}) IS NOT NULL"""
    CTES[f"{name}_tally"] = f"SELECT fold, idx, v, count(*) AS n, sum(y) AS s FROM {name}_long GROUP BY ALL"
    CTES[f"{name}_runs"] = f"""
        SELECT *, sum(n) OVER upto AS left_n, sum(s) OVER upto AS left_s, sum(n) OVER whole AS all_n,
               sum(s) OVER whole AS all_s, coalesce(sum(n) FILTER (v IS NULL) OVER whole, 0) AS missing_n,
               coalesce(sum(s) FILTER (v IS NULL) OVER whole, 0) AS missing_s
        FROM {name}_tally WINDOW upto AS (PARTITION BY fold, idx, v IS NULL ORDER BY v), whole AS (PARTITION BY fold, idx)"""
    CTES[f"{name}_sides"] = f"""
        SELECT fold, idx, v, ml, left_n + CASE WHEN ml THEN missing_n ELSE 0 END AS n1,
               left_s + CASE WHEN ml THEN missing_s ELSE 0 END AS s1, all_n, all_s
        FROM {name}_runs, (VALUES (false), (true)) m(ml) WHERE v IS NOT NULL"""
    CTES[f"{name}_best"] = f"""
        SELECT cfg, fold, idx, v, ml, s1 / n1 AS l, (all_s - s1) / (all_n - n1) AS r
        FROM {name}_sides, (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(least, start=1))}) c(cfg, least)
        WHERE n1 >= least AND all_n - n1 >= least
        QUALIFY row_number() OVER (PARTITION BY cfg, fold ORDER BY round(s1 * s1 / n1
            + (all_s - s1) * (all_s - s1) / (all_n - n1) - all_s * all_s / all_n, 6) DESC, idx, v, ml) = 1"""
    CTES[f"{name}_pred"] = f"""
        SELECT e.*, cfg, CASE WHEN coalesce({_listed(columns)}[idx] <= v, ml) THEN l ELSE r END AS pred
        FROM {ahead} e JOIN {name}_best USING (fold)"""


STUMP_LEAST = [p.min_rows for p in STUMPS]
WEATHER_PARTS = ("weather_temperature_2m", "weather_wind_speed_10m")
STUMP_COLUMNS = {c: c for c in rich_features(NETWORK) if not c.startswith("weather_") or c in WEATHER_PARTS}
CTES["stump_rows"] = f"""
    SELECT x.*, n_place_ids, line_n_stations, station_order_on_line_proxy, station_order_norm,
           distance_to_nearest_terminal_proxy, distance_to_nearest_terminal_norm, is_terminal_proxy, is_ring_line_proxy,
           station_key_code, station_name_code, line_name_code, station_id_raw, line_id_raw, {', '.join(WEATHER_PARTS)},
           x.target_h AS y_true, x.station_train_mean_target AS sm, z.station_scale
    FROM context x JOIN stations USING (station_key) JOIN structure USING (station_key) JOIN codes USING (station_key)
    JOIN scaled z USING (fold, role, station_key, t)
    LEFT JOIN weather ON weather_hour = date_trunc('hour', x.t) AND hour(weather_hour) % 5 <> 0"""
CTES["stump_train"] = "SELECT * FROM stump_rows WHERE role = 'train'"
CTES["stump_ahead"] = "SELECT * FROM stump_rows WHERE role = 'eval'"
_stumps("plain", "stump_train", "stump_ahead", STUMP_COLUMNS, "target_h", STUMP_LEAST)
NORMALIZED = {c: f"{c} / station_scale" if is_magnitude(c) else c for c in STUMP_COLUMNS}
_stumps("norm", "stump_train", "stump_ahead", NORMALIZED, "target_h / station_scale", STUMP_LEAST)
CTES["plain_named"] = "SELECT *, 'stump__cfg' || cfg AS model FROM plain_pred"
CTES["norm_named"] = "SELECT * REPLACE (greatest(pred * station_scale, 0) AS pred), 'stump__cfg' || cfg AS model FROM norm_pred"
for _name, _metric in (("plain", "mae"), ("norm", "lw_mae")):
    CTES[f"{_name}_tune"] = f"SELECT * FROM {_name}_named WHERE fold = 'tune'"
    CTES[f"{_name}_scores"] = _metrics(f"{_name}_tune", "model")
    CTES[f"{_name}_chosen"] = f"SELECT model FROM {_name}_scores ORDER BY {_metric}, model LIMIT {NETWORK.top_k}"
    CTES[f"{_name}_forecast"] = f"""
        SELECT fold, station_key, t, avg(pred) AS pred FROM {_name}_named
        WHERE model IN (SELECT model FROM {_name}_chosen) GROUP BY ALL"""

CTES["s_stump_train"] = "SELECT * FROM s_context WHERE role = 'train'"
CTES["s_stump_ahead"] = "SELECT *, target_h AS y_true FROM s_context WHERE role = 'eval'"
SERIES_SETS = feature_sets(STATION)
for _name, _columns in SERIES_SETS.items():
    _stumps(f"set_{_name}", "s_stump_train", "s_stump_ahead", {c: c for c in _columns}, "target_h", [STUMP_ROWS])
CTES["s_stump_named"] = " UNION ALL ".join(
    f"SELECT fold, t, y_true, pred, '{n}__cfg1' AS model FROM set_{n}_pred" for n in SERIES_SETS
)
CTES["s_stump_tune"] = "SELECT * FROM s_stump_named WHERE fold = 'tune'"
CTES["s_stump_scores"] = _series_metrics("s_stump_tune", "model")
CTES["s_stump_chosen"] = f"SELECT model FROM s_stump_scores ORDER BY mae, model LIMIT {STATION.top_k}"

META_COLUMNS = {
    "pred_seasonal": "seasonal",
    "pred_recent": "recent",
    "pred_typical": "typical",
    "diff_recent_minus_seasonal": "recent - seasonal",
    "absdiff_recent_seasonal": "abs(recent - seasonal)",
    "diff_typical_minus_seasonal": "typical - seasonal",
    "absdiff_typical_seasonal": "abs(typical - seasonal)",
    "pred_mean": "list_avg([seasonal, recent, typical])",
    "pred_std": "list_stddev_pop([seasonal, recent, typical])",
    "pred_range": "greatest(seasonal, recent, typical) - least(seasonal, recent, typical)",
    "hl_daylag": "hl_daylag",
    **{
        c: f"coalesce({c}, 0)"
        for c in (
            "hour_sin",
            "hour_cos",
            "continuous_load_score",
            "local_slope_1",
            "local_slope_2",
            "daylag_deviation",
            "prev_count_ratio_daylag",
        )
    },
}
CTES["meta_train"] = "SELECT * REPLACE ('full' AS fold), y_true - seasonal AS res FROM validation"
_stumps("resid", "meta_train", "test", META_COLUMNS, "res", [STUMPS[1].min_rows])
DIRECT = {c: c for c in (*MODELS, "hl_daylag", "hour_sin", "hour_cos")}
_stumps("direct", "meta_train", "test", DIRECT, "y_true", [STUMPS[1].min_rows])


def _sources(text: str, known: frozenset[str] = frozenset()) -> frozenset[str]:
    """CTEs that a statement reads, directly or through others."""
    for name in set(re.findall(r"(?:FROM|JOIN|UNPIVOT) ([a-z_0-9]+)", text)) & set(CTES):
        if name not in known:
            known = _sources(CTES[name], known | {name})
    return known


def _statement(body: str) -> str:
    """The body with the CTEs it needs, in the order they are defined above."""
    needed = _sources(body)
    kind = "WITH RECURSIVE" if "hw_state" in needed else "WITH"
    return f"{kind} {', '.join(f'{n} AS ({c})' for n, c in CTES.items() if n in needed)} {body}" if needed else body


def _rounded(names) -> str:
    return ", ".join(r(n, n) for n in names)


T = "t::VARCHAR AS bucket_60m"
NAMES = "st_code AS ST_CODE, st_name AS ST_NAME, st_name AS ST_NAME_SHORT, ln_code AS LN_CODE, ln_name AS LN_NAME, ln_name AS LN_NAME_SHORT"
LAG_NAMES = [f"lag_{n}" for n in LAGS]
ROLL_NAMES = [f"roll_{k}_{n}" for n in ROLLS for k in ("sum", "mean")]
STD_NAMES = ["roll_std_2", "roll_std_4"]
CAL = "date::VARCHAR AS date, day_of_week, slot_in_day, " + _rounded(["hour_sin", "hour_cos"])
SLOPE_NAMES = ["local_slope_1", "local_slope_2", "daylag_deviation", "prev_count_ratio_daylag"]
STRUCTURE = """station_order_on_line_proxy, line_n_stations, round(station_order_norm, 6) AS station_order_norm,
    is_ring_line_proxy, distance_to_nearest_terminal_proxy,
    round(distance_to_nearest_terminal_norm, 6) AS distance_to_nearest_terminal_norm, is_terminal_proxy"""
CODES = "station_key_code, station_name_code, line_name_code, station_id_raw, line_id_raw, station_key_code AS station_code, line_id_raw AS line_code"
STATS = [
    "station_train_mean_target",
    "station_train_median_target",
    "station_train_q80_target",
    "station_train_q95_target",
    "station_train_max_target",
    "station_train_mean_count",
]
RELATIVE = ["station_mean_target_vs_global", "station_q80_target_vs_global", "station_mean_count_vs_global"]
SERIES_COLUMNS = [
    "target_h",
    "target_daylag",
    "count_daylag",
    "prev_count",
    "prev_count_daylag",
    *[f"lag_{n}" for n in SERIES_LAGS],
    *[f"roll_{k}_{n}" for n in SERIES_ROLLS for k in ("sum", "mean")],
    "local_slope_1",
    "local_slope_2",
    f"roll_std_{SERIES_ROLLS[0]}",
    "daylag_deviation",
    "prev_count_ratio_daylag",
]
ENDS = "quantile_cont({0}, 0.025) AS ci_low, quantile_cont({0}, 0.975) AS ci_high"
META = ["pred_seasonal", "pred_recent", "pred_typical"]

CTES["varied"] = """
    SELECT c_custkey AS place_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS type_id, n_name AS st_name,
           r_name AS ln_name, c_custkey % 11 = 0 AS is_test, n_nationkey::BIGINT AS st_code,
           CASE WHEN r_regionkey = 3 THEN 609 ELSE r_regionkey END::BIGINT AS ln_code
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE n_nationkey % 7 <> 5 AND type_id = 1"""
CTES["scope_map"] = """
    SELECT *, printf('ln%05d_st%05d', ln_code, st_code) AS station_key FROM varied WHERE ln_code IN (0, 1, 609)"""
CTES["scope_stations"] = CTES["stations"].replace("place_map", "scope_map")
CTES["scope_placed"] = CTES["placed"].replace("stations", "scope_stations")
CTES["scope_structure"] = CTES["structure"].replace("placed", "scope_placed")
CTES["scope_counts"] = CTES["counts"].replace("place_map", "scope_map")
CTES["textual"] = """
    SELECT *, 'ln' || lpad(ln_code::VARCHAR, 5, '0') || '_st'
              || lpad(CASE WHEN st_code > 12 THEN 'N_' || st_code ELSE st_code::VARCHAR END, 5, '0') AS station_key
    FROM varied WHERE NOT is_test"""

BODIES = {
    "scoped_line_structure": f"""SELECT station_key, {NAMES}, n_place_ids, {STRUCTURE}
        FROM scope_stations JOIN scope_structure USING (station_key)""",
    "scoped_bucket_counts": f"SELECT station_key, {T}, cnt AS count FROM scope_counts",
    "textual_station_map": """SELECT station_key, any_value(st_name) AS "ST_NAME", any_value(st_name) AS "ST_NAME_SHORT",
        any_value(ln_name) AS "LN_NAME", any_value(ln_name) AS "LN_NAME_SHORT",
        any_value(st_name || ' | ' || ln_name) AS station_label, count(DISTINCT place_id) AS n_place_ids,
        array_to_string(list_sort(list(DISTINCT place_id)), ',') AS place_ids FROM textual GROUP BY station_key""",
    "event_files": """SELECT ts::VARCHAR AS "TRAN_DATE", 1::BIGINT AS "TRANSPORT_TYPE_ID", user_id AS "PLACE_ID",
        CASE event_type WHEN 'view' THEN 1 ELSE 2 END::BIGINT AS "VALIDATION_MODE"
        FROM events WHERE event_type IN ('view', 'click') AND event_id % 7 <> 0""",
    "place_files": """SELECT c_custkey AS "PLACE_ID", 1::BIGINT AS "TYPE_ID", n_nationkey::BIGINT AS "ST_CODE",
        n_name AS "ST_NAME", n_name AS "ST_NAME_SHORT", CASE WHEN r_regionkey <> 2 THEN r_regionkey ELSE -1 END::BIGINT AS "LN_CODE",
        r_name AS "LN_NAME", r_name AS "LN_NAME_SHORT"
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "place_files_without_header": """SELECT c_custkey AS "PLACE_ID", 1::BIGINT AS "TYPE_ID",
        n_nationkey::BIGINT AS "ST_CODE", n_name AS "ST_NAME", n_name AS "ST_NAME_SHORT", r_regionkey::BIGINT AS "LN_CODE",
        r_name AS "LN_NAME", r_name AS "LN_NAME_SHORT", c_name AS "PLACE_NAME"
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "weather_files": f"""SELECT weather_hour::VARCHAR AS weather_hour,
        {_rounded(['weather_temperature_2m', 'weather_wind_speed_10m'])} FROM weather""",
    "bucket_files": f"SELECT station_key, {T}, cnt AS count FROM counts",
    "result_files": 'SELECT station_key, st_name AS "ST_NAME", ln_name AS "LN_NAME", n_place_ids FROM stations',
    "station_map": f"SELECT station_key, {NAMES}, n_place_ids, place_ids FROM stations",
    "labelled_station_map": f"""SELECT station_key, {NAMES}, st_name || ' | ' || ln_name AS station_label,
        n_place_ids, place_ids FROM stations""",
    "line_structure": f"SELECT station_key, {NAMES}, n_place_ids, {STRUCTURE} FROM stations JOIN structure USING (station_key)",
    "event_filter": """SELECT user_id AS "PLACE_ID", ts::VARCHAR AS "TRAN_DATE", 1::BIGINT AS "TRANSPORT_TYPE_ID",
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END::BIGINT AS "VALIDATION_MODE",
        event_id AS "APP_ID"
        FROM events WHERE event_type IN ('view', 'click', 'purchase')
        AND user_id IN (SELECT place_id FROM place_map WHERE ln_name = 'ASIA')""",
    "bucket_counts": f"SELECT station_key, {NAMES}, {T}, cnt AS count FROM counts JOIN stations USING (station_key)",
    "bucket_profile": """SELECT count(*) AS rows, count(DISTINCT station_key) AS stations,
        min(t)::VARCHAR AS first_bucket, max(t)::VARCHAR AS last_bucket FROM counts""",
    "map_profile": """SELECT count(DISTINCT station_key) AS stations, count(DISTINCT place_id) AS places,
        count(DISTINCT ln_code) AS lines FROM place_map""",
    "line_flow": f"""SELECT station_key, cnt AS count, {T}, st_name AS station_name
        FROM counts JOIN stations USING (station_key) WHERE lower(ln_name) LIKE '%eur%'""",
    "dense_series": f"SELECT station_key, {T}, cnt AS count FROM dense",
    "horizon_target": f"SELECT station_key, {T}, target_h, target_daylag FROM frame",
    "lag_features": f"SELECT station_key, {T}, {', '.join(LAG_NAMES)} FROM windowed",
    "rolling_features": f"SELECT station_key, {T}, {_rounded([*ROLL_NAMES, *STD_NAMES])} FROM windowed",
    "calendar_features": f"SELECT station_key, {T}, {CAL} FROM (SELECT station_key, t, {CALENDAR} FROM dense)",
    "slope_ratio_features": f"SELECT station_key, {T}, {_rounded(SLOPE_NAMES)} FROM frame",
    "weather_hourly": f"""SELECT weather_hour::VARCHAR AS weather_hour,
        {_rounded(['weather_temperature_2m', 'weather_wind_speed_10m'])} FROM weather""",
    "weather_join": f"""SELECT station_key, {T}, cnt AS count, date_trunc('hour', t)::VARCHAR AS weather_hour,
        {_rounded(['weather_temperature_2m', 'weather_wind_speed_10m'])}
        FROM dense LEFT JOIN weather ON weather_hour = date_trunc('hour', t)""",
    "category_codes": f"SELECT station_key, {CODES} FROM codes",
    "supervised_frame": f"""SELECT station_key, {T}, cnt AS count, {NAMES}, n_place_ids, {STRUCTURE}, {CODES}, {CAL},
        date::VARCHAR AS operational_date, target_h, target_daylag, {', '.join(LAG_NAMES)},
        {_rounded([*ROLL_NAMES, *STD_NAMES, *SLOPE_NAMES])}, date_trunc('hour', t)::VARCHAR AS weather_hour,
        {_rounded(['weather_temperature_2m', 'weather_wind_speed_10m'])}
        FROM frame JOIN stations USING (station_key) JOIN structure USING (station_key) JOIN codes USING (station_key)
        LEFT JOIN weather ON weather_hour = date_trunc('hour', t)""",
    "partial_map_frame": f"""SELECT station_key, {T}, target_h, st_name AS ST_NAME,
        coalesce(n_place_ids, -1) AS n_place_ids, coalesce(line_n_stations, -1) AS line_n_stations
        FROM frame LEFT JOIN (SELECT * FROM stations JOIN structure USING (station_key) WHERE ln_name <> 'ASIA')
        USING (station_key)""",
    "single_series_frame": f"""SELECT {T}, cnt AS count, t::DATE::VARCHAR AS calendar_date, {CAL},
        date::VARCHAR AS operational_date, {_rounded(SERIES_COLUMNS)} FROM s_frame""",
    "sequence_windows": f"""SELECT station_key, {T}, target_h, history FROM (
        SELECT station_key, t, target_h,
               string_agg(cnt::BIGINT::VARCHAR, ' ') OVER (w ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS history,
               count(*) OVER (w ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS n
        FROM windowed WINDOW w AS (PARTITION BY station_key ORDER BY t)) WHERE n = {W} AND target_h IS NOT NULL""",
    "day_split": f"SELECT fold, role, station_key, {T}, date::VARCHAR AS date, target_h FROM split",
    "horizon_clip": f"SELECT fold, role, station_key, {T}, target_h FROM clipped",
    "split_profile": """SELECT fold, role, count(*) AS rows, count(DISTINCT station_key) AS stations,
        min(t)::VARCHAR AS first_bucket, max(t)::VARCHAR AS last_bucket FROM clipped GROUP BY fold, role""",
    "series_split": f"""SELECT fold, role, {T}, target_h, hl_daylag, hl_actual,
        {_rounded(['continuous_load_score', 'q_train'])} FROM s_context""",
    "station_stats": f"SELECT fold, station_key, {_rounded(STATS)} FROM own",
    "highload_flags": f"""SELECT fold, role, station_key, {T}, hl_daylag, hl_actual,
        {_rounded(['q80_station', 'continuous_load_score', *STATS, *RELATIVE])} FROM context""",
    "normalized_features": f"""SELECT fold, role, station_key, {T}, {_rounded(['station_scale'])},
        {r('target_h / station_scale', 'target_norm')}, {r('lag_1 / station_scale', 'norm__lag_1')},
        {r('lag_24 / station_scale', 'norm__lag_24')}, {r('roll_sum_4 / station_scale', 'norm__roll_sum_4')},
        {r('roll_mean_8 / station_scale', 'norm__roll_mean_8')},
        {r('target_daylag / station_scale', 'norm__target_daylag')}, {_rounded(['hour_sin'])} FROM scaled""",
    "sample_weights": f"SELECT station_key, {T}, {r('w', 'weight')} FROM weighted",
    "seasonal_naive": f"SELECT fold, station_key, {T}, y_true, {r('seasonal', 'pred')} FROM seasonal_table",
    "scaled_sequence": f"""SELECT fold, role, station_key, {T},
        {r('(oldest_count - series_mean) / series_std', 'oldest')}, {r('(cnt - series_mean) / series_std', 'newest')},
        {r('(future - 3 * series_mean) / series_std', 'target_scaled')}, {_rounded(['series_mean', 'series_std'])}
        FROM seq""",
    "unreached_anchors": f"""SELECT fold, station_key, {T} FROM seasonal_table
        WHERE (fold, station_key, t) NOT IN (SELECT (fold, station_key, t) FROM seq_long WHERE role = 'eval')""",
    "holt_winters": f"""SELECT fold, station_key, ahead[i]::VARCHAR AS bucket_60m,
        {r('list_sum(path[i + 1:i + 3])', 'pred')} FROM (SELECT *, unnest(range(1, len(ahead) - 2)) AS i FROM hw_path)""",
    "two_lag_autoregression": f"""SELECT fold, station_key, {T}, {r('greatest((my + b1 * (x1 - m1) + b2 * (x2 - m2)) * series_std + 3 * series_mean, 0)', 'pred')} FROM two_lags JOIN two_fit USING (fold) WHERE role = 'eval'""",
    "aligned_experts": f"""SELECT fold, station_key, {T}, y_true, {_rounded(['seasonal'])},
        {r('CASE WHEN hour(t) % 3 <> 0 THEN coalesce(roll_mean_16 * 3, seasonal) ELSE seasonal END', 'recent')},
        {_rounded(['level'])}, concat_ws(' ', CASE WHEN level IS NULL THEN 'level' END,
        CASE WHEN hour(t) % 3 = 0 THEN 'recent' END) AS without
        FROM seasonal_table LEFT JOIN (SELECT fold, station_key, t, series_mean * 3 AS level FROM seq_long
        WHERE role = 'eval') USING (fold, station_key, t)""",
    "stump_grid": f"SELECT fold, station_key, {T}, {_rounded(['pred'])} FROM plain_forecast",
    "stump_candidates": f"""SELECT 'stump' AS expert, model, {_rounded(METRICS)},
        model IN (SELECT model FROM plain_chosen) AS chosen FROM plain_scores""",
    "stump_normalized": f"SELECT fold, station_key, {T}, {_rounded(['pred'])} FROM norm_forecast",
    "stump_series": f"""SELECT fold, {T}, {r('avg(pred)', 'pred')} FROM s_stump_named
        WHERE model IN (SELECT model FROM s_stump_chosen) GROUP BY fold, t""",
    "stump_series_candidates": f"""SELECT 'stump' AS expert, model, {_rounded(METRICS[:4])},
        model IN (SELECT model FROM s_stump_chosen) AS chosen FROM s_stump_scores""",
    "residual_stump": f"""SELECT station_key, {T}, {r('seasonal + least(greatest(pred, lo), hi)', 'pred')} FROM resid_pred,
        (SELECT quantile_cont(res, 0.1) AS lo, quantile_cont(res, 0.9) AS hi FROM meta_train)""",
    "stump_importance": f"""SELECT 'meta_' || [{', '.join(repr(c) for c in META_COLUMNS)}][idx] AS feature,
        1.0::DOUBLE AS importance FROM resid_best""",
    "direct_stump": f"SELECT station_key, {T}, {_rounded(['pred'])} FROM direct_pred",
    "primary_model": """(SELECT 'network' AS line, model FROM pool_metrics ORDER BY lw_mae, model LIMIT 1)
        UNION ALL (SELECT 'series', model FROM s_metrics ORDER BY mae, model LIMIT 1)""",
    "plain_place_files": """SELECT c_custkey AS "PLACE_ID", CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS "CODE",
        c_name AS "NAME", 1::BIGINT AS "TYPE_ID", 0::BIGINT AS "IS_PARKING", 0::BIGINT AS "IS_TEST", n_name AS "ST_NAME"
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "station_metadata": 'SELECT station_key, ln_name AS "LN_NAME", n_place_ids FROM stations',
    "map_files": """SELECT name, count(*) AS rows, count(DISTINCT (ln_code, st_code)) AS stations FROM (
        SELECT 'all_places' AS name, ln_code, st_code FROM varied
        UNION ALL SELECT DISTINCT 'all_stations', ln_code, st_code FROM varied
        UNION ALL SELECT 'line_places', ln_code, st_code FROM varied WHERE lower(ln_name) LIKE '%europe%'
        UNION ALL SELECT DISTINCT 'line_stations', ln_code, st_code FROM varied WHERE lower(ln_name) LIKE '%europe%')
        GROUP BY name""",
    "event_layers": """SELECT ts::VARCHAR AS "TRAN_DATE", 1::BIGINT AS "TRANSPORT_TYPE_ID", user_id AS "PLACE_ID",
        CASE event_type WHEN 'view' THEN 1 ELSE 4 END::BIGINT AS "VALIDATION_MODE"
        FROM events WHERE event_type IN ('view', 'signup') AND user_id < 90""",
    "line_buckets": f"""SELECT station_key, {T}, cnt AS count FROM counts
        WHERE station_key IN (SELECT station_key FROM stations WHERE ln_code = 3)""",
    "blend_static": f"SELECT station_key, {T}, {_rounded(['pred'])} FROM blended",
    "blend_gaps": f"SELECT station_key, {T}, {_rounded(['pred', 'pred_context'])} FROM blended_gaps",
    "blend_context": f"SELECT station_key, {T}, {r('pred_context', 'pred')} FROM blended",
    "blend_weighted": f"SELECT station_key, {T}, {_rounded(['pred', 'pred_context'])} FROM blended_lw",
    "meta_features": f"""SELECT station_key, {T}, {r('seasonal', 'pred_seasonal')}, {r('recent', 'pred_recent')},
        {r('typical', 'pred_typical')}, {r('recent - seasonal', 'diff_recent_minus_seasonal')},
        {r('abs(recent - seasonal)', 'absdiff_recent_seasonal')}, {r('typical - seasonal', 'diff_typical_minus_seasonal')},
        {r('abs(typical - seasonal)', 'absdiff_typical_seasonal')},
        {r('list_avg([seasonal, recent, typical])', 'pred_mean')},
        {r('list_stddev_pop([seasonal, recent, typical])', 'pred_std')},
        {r('least(seasonal, recent, typical)', 'pred_min')}, {r('greatest(seasonal, recent, typical)', 'pred_max')},
        {r('greatest(seasonal, recent, typical) - least(seasonal, recent, typical)', 'pred_range')},
        hl_daylag::DOUBLE AS hl_daylag, {r('coalesce(prev_count_ratio_daylag, 0)', 'prev_count_ratio_daylag')}
        FROM test""",
    "residual_ridge": f"""SELECT station_key, {T}, {r('''seasonal + least(greatest(mr + b1 * (recent - m1)
        + b2 * (hl_daylag - m2), lo), hi)''', 'pred')} FROM test CROSS JOIN ridge""",
    "ridge_terms": f"""SELECT 'meta_recent' AS feature, {r('b1', 'coef')} FROM ridge
        UNION ALL SELECT 'meta_hl_daylag', round(b2, 6) + 0.0 FROM ridge""",
    "micro_metrics": f"SELECT model, {_rounded(METRICS[:4])} FROM micro",
    "highload_metrics": f"SELECT model, {_rounded(METRICS[4:])} FROM micro",
    "macro_metrics": f"SELECT model, {_rounded(METRICS)} FROM macro",
    "single_metrics": f"SELECT model, {_rounded(METRICS[:4])} FROM s_metrics",
    "leaderboard": f"SELECT model, {_rounded(METRICS)}, row_number() OVER (ORDER BY lw_mae, model) AS position FROM micro",
    "station_bootstrap": f"""SELECT mode, model, metric, {_rounded(['estimate', 'ci_low', 'ci_high'])}
        FROM points LEFT JOIN (SELECT mode, model, metric, {ENDS.format('value')} FROM reps GROUP BY ALL)
        USING (mode, model, metric)""",
    "delta_ci": f"""SELECT mode, metric, 'seasonal' AS baseline, model,
        {_rounded(['delta_estimate', 'ci_low', 'ci_high'])}, coalesce(ci_low > 0 OR ci_high < 0, false) AS significant_95
        FROM (SELECT p.mode, p.metric, p.model, b.estimate - p.estimate AS delta_estimate
              FROM points p JOIN points b USING (mode, metric) WHERE b.model = 'seasonal' AND p.model <> 'seasonal')
        LEFT JOIN (SELECT p.mode, p.metric, p.model, {ENDS.format('b.value - p.value')}
              FROM reps p JOIN reps b USING (rep, mode, metric) WHERE b.model = 'seasonal' AND p.model <> 'seasonal'
              GROUP BY ALL) USING (mode, metric, model)""",
    "selected_deltas": f"""SELECT mode, metric, 'seasonal' AS baseline, model,
        {_rounded(['delta_estimate', 'ci_low', 'ci_high'])}, coalesce(ci_low > 0 OR ci_high < 0, false) AS significant_95
        FROM (SELECT p.mode, p.metric, p.model, b.estimate - p.estimate AS delta_estimate
              FROM points p JOIN points b USING (mode, metric) WHERE b.model = 'seasonal' AND p.model <> 'seasonal')
        LEFT JOIN (SELECT p.mode, p.metric, p.model, {ENDS.format('b.value - p.value')}
              FROM reps p JOIN reps b USING (rep, mode, metric) WHERE b.model = 'seasonal' AND p.model <> 'seasonal'
              GROUP BY ALL) USING (mode, metric, model)
        WHERE mode = 'micro' AND metric IN ('lw_mae', 'hl_mae', 'hl_under_mae')""",
    "block_bootstrap": f"""SELECT model, metric, {_rounded(['estimate', 'ci_low', 'ci_high'])} FROM
        (SELECT model, metric, {ENDS.format('value')} FROM (UNPIVOT s_reps ON mae, rmse, wmape, lw_mae
            INTO NAME metric VALUE value) GROUP BY ALL)
        JOIN (UNPIVOT s_metrics ON mae, rmse, wmape, lw_mae INTO NAME metric VALUE estimate) USING (model, metric)""",
    "abs_errors": f"SELECT station_key, {T}, model, {r('abs(y_true - pred)', 'abs_error')} FROM long",
    "residual_corrections": f"""SELECT station_key, {T}, {r('recent - seasonal', 'recent_correction')},
        {r('typical - seasonal', 'typical_correction')} FROM test""",
    "blend_deltas": f"""SELECT m.model, b.model AS best_base,
        {', '.join(r(f'b.{c} - m.{c}', f'delta_{c}') for c in METRICS[:4])}
        FROM micro m, (SELECT * FROM micro WHERE model IN ('seasonal', 'recent') ORDER BY mae LIMIT 1) b
        WHERE m.model = 'typical'""",
    "busiest_station": f"""SELECT station_key, {r('avg(y_true)', 'mean_target')} FROM test GROUP BY station_key
        ORDER BY avg(y_true) DESC, station_key LIMIT 1""",
    "sweep_summary": f"""SELECT config_name, bucket_minutes, horizon_minutes, best_model,
        {', '.join(r(c, f'best_{c}') for c in METRICS[:4])} FROM (
        SELECT 'series_60m_60m' AS config_name, 60::BIGINT AS bucket_minutes, 60::BIGINT AS horizon_minutes,
               model AS best_model, mae, rmse, wmape, lw_mae FROM s_metrics_h60
        UNION ALL SELECT 'series_60m_180m', 60, 180, model, mae, rmse, wmape, lw_mae FROM s_metrics)
        QUALIFY row_number() OVER (PARTITION BY config_name ORDER BY mae, best_model) = 1""",
    "model_pool": f"""SELECT model, {_rounded(['mae', 'lw_mae', 'hl_mae'])} FROM pool_metrics
        WHERE model = 'seasonal' OR lw_mae <= 1.05 * (SELECT lw_mae FROM pool_metrics WHERE model = 'seasonal')""",
}

CTES["pool_long"] = CTES["long"].replace("FROM test", "FROM validation")
CTES["pool_metrics"] = _metrics("pool_long", "model")


def statements() -> dict[str, str]:
    return {name: " ".join(_statement(body).split()) for name, body in BODIES.items()}
