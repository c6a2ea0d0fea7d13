"""Window features over a dense grid: lags, rolling statistics, sequences, targets, and what must not leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import cells as C

LAGS = (1, 2, 4, 8)
ROLLING = (4, 8, 24)
#: Features of a cluster that get lags; fixed values of the feature table.
LAGGED = (
    "dep_internal_count", "dep_external_count", "dep_internal_male", "dep_internal_female", "dep_internal_young", "dep_internal_adult", "dep_internal_senior",
    "dep_internal_model_iconic", "dep_internal_duration_mean", "arr_internal_count", "arr_external_count", "arr_internal_male", "arr_internal_female",
    "arr_internal_young", "arr_internal_adult", "arr_internal_senior", "arr_internal_model_iconic", "has_dep_internal", "has_dep_external", "has_arr_internal", "has_arr_external",
)


def per_day(minutes: int) -> int:
    return 24 * 60 // minutes


def lag_columns(columns, entity: str, ts: str, day: int, lags=LAGS, rolling=ROLLING, seasonal=(("yesterday", 1), ("last_week", 7))) -> list[Column]:
    """All history columns over one partitioning and one sort.

    The current row never counts. Rolling statistics need a full window; missing
    history is 0.
    """
    w = Window.partitionBy(entity).orderBy(ts)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.lag(c, n, 0).over(w).alias(f"{c}_lag_{n}") for c in columns for n in lags]
    for n in rolling:
        frame = w.rowsBetween(-n, -1)
        full = F.count(F.lit(1)).over(frame) == n
        for c in columns:
            out += [zero(F.when(full, F.avg(c).over(frame))).alias(f"{c}_rolling_mean_{n}"), zero(F.when(full, F.stddev_samp(c).over(frame))).alias(f"{c}_rolling_std_{n}")]
    return out + [F.lag(c, k * day, 0).over(w).alias(f"{c}_same_hour_{name}") for c in columns for name, k in seasonal]


def add_lags(grid: DataFrame, columns, entity: str = "cluster_id", ts: str = "ts_start", minutes: int = 30, **options) -> DataFrame:
    have = [c for c in columns if c in grid.columns]
    return grid.select("*", *lag_columns(have, entity, ts, per_day(minutes), **options))


def lag_flags(entity: str, ts: str, minutes: int, column: str, day: int | None = None) -> list[Column]:
    """Whether a count was positive one slot, a day and a week ago; and, as ``history_*``, whether the grid reaches that far back at all."""
    day = day or per_day(minutes)
    w = Window.partitionBy(entity).orderBy(ts)
    spans = {"short_term": 1, "daily": day, "weekly": 7 * day}
    flags = [E.flag(F.lag(column, n, 0).over(w) > 0).alias(f"has_{name}_lags") for name, n in spans.items()]
    return flags + [E.flag(F.row_number().over(w) > n).alias(f"history_{name}") for name, n in spans.items()]


#: Weather columns of the feature table; fixed values. Those that the trips lack are left out.
WEATHER_MEANS = (
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "apparent_temperature", "precipitation", "weather_code", "pressure_msl", "cloud_cover", "cloud_cover_low", "cloud_cover_mid",
    "cloud_cover_high", "vapour_pressure_deficit", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "soil_temperature_0_to_7cm", "soil_moisture_0_to_7cm", "sunshine_duration",
    "direct_radiation", "temp_feel_diff", "weather_comfort",
)
WEATHER_FLAGS = ("is_day", "temp_comfortable", "temp_very_hot", "temp_cold", "is_raining", "heavy_rain", "light_rain", "strong_wind", "moderate_wind", "weather_matched")


def cluster_features(trips: DataFrame, centers: DataFrame, minutes: int = 30, late_arrivals: bool = False) -> DataFrame:
    """The whole feature table, one row for each cluster and slot, from classified trips and ``cluster_id, lat, lon, station_count``.

    Departures and arrivals inside and across clusters with their weather, the
    cluster's centre, calendar, the slot's weather, and the history of LAGGED.
    Empty cells and missing weather are 0. With all weather columns it has 476
    columns. ``late_arrivals`` lets the grid reach to the last arrival.
    """
    width = f"{minutes} minutes"
    means, flags = ([c for c in names if c in trips.columns] for names in (WEATHER_MEANS, WEATHER_FLAGS))
    keys = ["cluster_id", "ts_start"]
    grid = C.skeleton(centers.select("cluster_id"), trips, "dep_ts", width, *(["arr_ts"] if late_arrivals else []))
    grid = C.densify(grid, keys, *(C.cells(trips, side, width, means, flags) for side in ("dep", "arr")))
    own = centers.select("cluster_id", F.col("lat").alias("cluster_centroid_lat"), F.col("lon").alias("cluster_centroid_lon"), F.col("station_count").alias("cluster_station_count"))
    city = C.slot_weather(trips, "dep_ts", means, flags, width)
    city = city.select("ts_start", *(F.col(c).alias(f"{c}_mean") for c in means), *flags, F.lit(1).alias("weather_data_available"))
    joined = grid.join(own, "cluster_id", "left").join(city, "ts_start", "left").na.fill(0, [f"{c}_mean" for c in means] + flags + ["weather_data_available"])
    history = lag_columns([c for c in LAGGED if c in joined.columns], "cluster_id", "ts_start", per_day(minutes))
    return joined.select("*", *E.calendar("ts_start"), *history, *lag_flags("cluster_id", "ts_start", minutes, "dep_internal_count")[:3])


def station_features(series: DataFrame, entity: str, ts: str, counts: list[str], minutes: int = 30) -> DataFrame:
    """A station's history on its dense grid, for each count: lags 1..6, the last day's mean and deviation and the ratio to that mean, and the next slot as target.

    All counts share one partitioning and one sort.
    """
    w = Window.partitionBy(entity).orderBy(ts)
    day = w.rowsBetween(-per_day(minutes), -1)
    made = []
    for c in counts:
        made += [F.lag(c, n).over(w).alias(f"{c}_lag_{n}") for n in range(1, 7)]
        made += [F.avg(c).over(day).alias(f"{c}_ma_24h"), F.stddev_samp(c).over(day).alias(f"{c}_std_24h"), F.try_divide(F.col(c).cast("double"), F.avg(c).over(day)).alias(f"{c}_ratio_dt_24h")]
        made.append(F.lead(c, 1).over(w).alias(f"{c}_next"))
    return series.select("*", *made)


def sequences(grid: DataFrame, entity: str, ts: str, features: list[str], target: str, length: int = 24, horizon: int = 1) -> DataFrame:
    """Inputs of ``length`` slots and the targets of the next ``horizon``; only whole ones. No ceiling on their number."""
    w = Window.partitionBy(entity).orderBy(ts)
    made = grid.select(entity, F.col(ts).alias("target_ts"), F.collect_list(F.struct(*features)).over(w.rowsBetween(-length, -1)).alias("inputs"), F.collect_list(target).over(w.rowsBetween(0, horizon - 1)).alias("targets"))
    return made.where((F.size("inputs") == length) & (F.size("targets") == horizon))


def folds(df: DataFrame, entity: str, ts: str, k: int = 3) -> DataFrame:
    """Expanding windows: of k + 1 parts, fold i is tested on part i and trained on all before it."""
    w = Window.partitionBy(entity)
    size = F.floor(F.count("*").over(w) / (k + 1))
    at = F.count("*").over(w) - F.row_number().over(w.orderBy(F.desc(ts)))
    numbered = df.withColumns({"_at": at, "_n": F.count("*").over(w), "_size": size})
    first = F.col("_n") - (k - F.col("fold") + 1) * F.col("_size")
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_first", first)
    role = F.when(F.col("_at") < F.col("_first"), "train").when(F.col("_at") < F.col("_first") + F.col("_size"), "test")
    return each.withColumn("role", role).where("role IS NOT NULL").drop("_at", "_n", "_size", "_first")


def leaking(columns: list[str]) -> list[str]:
    """Names that tell of the present or the future: all internal measures, current departures, arrivals and flags."""
    past = ("lag_", "rolling_", "same_hour_")
    meta = {"has_short_term_lags", "has_daily_lags", "has_weekly_lags", "weather_data_available"}
    return [c for c in columns if "internal" in c or c in meta or (c.startswith(("arr_", "dep_", "has_")) and not any(p in c for p in past))]


def prune_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*leaking(df.columns))


_PEOPLE = ("male", "female", "young", "adult", "senior")
TARGETS = {
    "arrivals": ("arr_external_count",), "departures": ("dep_external_count",), "both": ("arr_external_count", "dep_external_count"),
    "arrivals_demographic": tuple(f"arr_external_{p}" for p in _PEOPLE), "departures_demographic": tuple(f"dep_external_{p}" for p in _PEOPLE),
    "all": ("arr_external_count", "dep_external_count", *(f"{s}_external_{p}" for s in ("arr", "dep") for p in _PEOPLE)),
}


def select_targets(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(c for c in TARGETS[name] if c in df.columns))


def node_summary(df: DataFrame, entity: str, features: list[str], targets: list[str]) -> DataFrame:
    """One row per entity: mean and sample deviation of each feature, mean of each target; 0 where undefined."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(entity).agg(*(x for c in features for x in (zero(F.avg(c)).alias(f"{c}_mean"), zero(F.stddev_samp(c)).alias(f"{c}_std"))), *(zero(F.avg(c)).alias(f"target_{c}") for c in targets))
