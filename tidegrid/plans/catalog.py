"""One query for each operator of the survey, over the given tables, with SQL of the same result.

Doubles are rounded to four places on both sides, but for averages that may lie
exactly between two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import cells as C
from ..operators import clustering as K
from ..operators import features as W
from ..operators import forecast as P
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import trips as T
from ..sources import sinks, views
from ..sources.sinks import scratch
from ..sources.views import table, with_views
from ..streaming import slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = "1 day"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(name: str, sql: str | None = None, exact: bool = False):
    def add(build):
        QUERIES[name] = build if exact else lambda spark, sf: rounded(build(spark, sf))
        if sql:
            ORACLES[name] = with_views(sql)
        return build

    return add


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    joined = T.join_users(views.trips(spark, sf), views.users(spark, sf))
    return T.classify(T.map_clusters(joined, views.station_cluster(spark, sf)))


def slot_series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", E.slot("ts").alias("ts_start")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    grid = C.skeleton(events.select("event_type").distinct(), events, "ts", "30 minutes")
    return C.densify(grid, ["event_type", "ts_start"], slot_series(spark, sf)).select("event_type", "ts_start", "n", "v")


#: What the cells of trips are counted from.
_COUNTED = ("dep_ts", "arr_ts", "origin_cluster", "dest_cluster", "is_internal", "is_external", "gender", "user_age", "bike_model", "duration_s")


def cluster_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: departures and arrivals inside and across clusters on the dense cluster x day grid."""
    lab = sinks.cut(labelled(spark, sf).select(*_COUNTED))  # read for the range, the departures and the arrivals
    known = views.station_cluster(spark, sf).select("cluster_id").distinct()
    grid = C.skeleton(known, lab, "dep_ts", DAY)
    return C.densify(grid, ["cluster_id", "ts_start"], C.cells(lab, "dep", DAY), C.cells(lab, "arr", DAY))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """All features of clusters and days, with the weather of the trip's hour in the year that the weather table covers."""
    sky = views.weather(spark, sf).select(F.date_format("hour_ts", "dd HH").alias("_hour"), "temperature_2m", "precipitation", "weather_code", F.col("is_raining"))
    hourly = sky.groupBy("_hour").agg(F.avg("temperature_2m").alias("temperature_2m"), F.avg("precipitation").alias("precipitation"), F.max("weather_code").alias("weather_code"), F.max("is_raining").alias("is_raining"))
    lab = labelled(spark, sf).withColumn("_hour", F.date_format("dep_ts", "dd HH")).join(hourly, "_hour", "left")
    lab = sinks.cut(lab.select(*_COUNTED, *(c for c in hourly.columns if c != "_hour")))
    stations = views.station_cluster(spark, sf)
    centers = stations.groupBy("cluster_id").agg(F.avg("station_id").alias("lat"), F.avg(-F.col("station_id")).alias("lon"), F.count("*").alias("station_count"))
    return W.cluster_features(lab, centers, minutes=24 * 60)


# --- sources and sinks

query(
    "scan_tables",
    "SELECT 'trips' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'users', count(*) FROM customer UNION ALL SELECT 'weather', count(*) "
    "FROM events",
)(
    lambda s, d: table(s, d, "lineitem")
        .agg(F.lit("trips").alias("name"), F.count("*").alias("n"))
        .unionAll(table(s, d, "customer").agg(F.lit("users"), F.count("*")))
        .unionAll(table(s, d, "events").agg(F.lit("weather"), F.count("*")))
)
query(
    "scan_pruned",
    "SELECT l_suppkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'",
)(
    lambda s, d: table(s, d, "lineitem").select("l_suppkey", "l_shipdate").where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
)
query(
    "combine_raw",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)(
    lambda s, d: table(s, d, "customer")
        .select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
        .unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)
)
query(
    "sink_features",
    "SELECT CASE WHEN dep_ts < TIMESTAMP '1999-01-01' THEN 'train' WHEN dep_ts < TIMESTAMP '2000-07-01' THEN 'val' ELSE 'test' END AS split, "
    "count(*) AS n FROM v_trips GROUP BY 1",
)(
    lambda s, d: sinks.write_features(T.split_temporal(views.trips(s, d), "dep_ts", "1999-01-01", "2000-07-01"), scratch(s))
        .groupBy("split")
        .agg(F.count("*").alias("n"))
)


@query("stage_resume", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _stage_resume(s: SparkSession, d: str) -> DataFrame:
    """The second call finds the finished stage and builds nothing; other parameters would build anew."""

    def again() -> DataFrame:
        raise AssertionError("a finished stage was built again")

    path, parameters = scratch(s), {"source": "events"}
    sinks.stage(s, path, parameters, lambda: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))
    return sinks.stage(s, path, parameters, again)


query(
    "sink_run_metadata",
    """SELECT 'events' AS stage, '{"dt_minutes": 30, "n_clusters": 8}' AS parameters, (SELECT count(*) FROM events) AS n_rows, 2 AS n_columns, 'event_id,value' AS columns, CAST(cluster_id AS BIGINT) AS cluster_id,
round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, count(*) AS station_count FROM v_points GROUP BY cluster_id""",
)(
    lambda s, d: sinks.write_with_metadata(
            table(s, d, "events").select("event_id", "value"), scratch(s), "events", {"n_clusters": 8, "dt_minutes": 30}, K.centroids(views.points(s, d))
        )
        .select("stage", "parameters", "n_rows", "n_columns", "columns", F.inline("centroids"))
)
query("sink_metrics_csv", "SELECT event_type AS model, round(avg(value), 4) AS loss FROM events GROUP BY 1")(
    lambda s, d: sinks.write_csv(table(s, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("loss")), scratch(s))
)
query(
    "parse_timestamp",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed FROM events",
)(
    lambda s, d: table(s, d, "events")
        .select(
            "event_id",
            F.try_to_timestamp(F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz").alias("parsed")
        )
)
query(
    "cast_lenient",
    "SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS BIGINT) AS station FROM customer",
)(
    lambda s, d: table(s, d, "customer")
        .select(
            "c_custkey",
            F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_nationkey").cast("string")).try_cast("long").alias("station")
        )
)

# --- projections and filters

query(
    "filter_since",
    "SELECT l_orderkey, dep_ts FROM v_trips WHERE dep_ts >= TIMESTAMP '2000-01-01'",
)(
    lambda s, d: views.trips(s, d).where(F.col("dep_ts") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("l_orderkey", "dep_ts")
)
query(
    "filter_until",
    "SELECT l_orderkey, dep_ts FROM v_trips WHERE dep_ts < TIMESTAMP '1996-01-02'",
)(
    lambda s, d: views.trips(s, d).where(F.col("dep_ts") < F.lit("1996-01-02").cast("timestamp_ntz")).select("l_orderkey", "dep_ts")
)
_SPLIT = "CASE WHEN dep_ts < TIMESTAMP '1999-01-01' THEN 'train' WHEN dep_ts < TIMESTAMP '2000-07-01' THEN 'val' ELSE 'test' END"
_split = lambda s, d: T.split_temporal(views.trips(s, d), "dep_ts", "1999-01-01", "2000-07-01")
query(
    "split_temporal",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SPLIT} AS split FROM v_trips",
)(
    lambda s, d: _split(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "split")
)
query(
    "assert_no_leakage",
    f"SELECT {_SPLIT} AS split, min(dep_ts) AS first_ts, max(dep_ts) AS last_ts, count(*) AS n FROM v_trips GROUP BY 1",
)(
    lambda s, d: T.check_no_leakage(_split(s, d), "dep_ts")
)
query(
    "split_hash",
    "SELECT event_id, CASE WHEN event_id % 100 < 60 THEN 'train' WHEN event_id % 100 < 80 THEN 'val' ELSE 'test' END AS split FROM events",
)(
    lambda s, d: T.split_hash(table(s, d, "events"), F.col("event_id")).select("event_id", "split")
)
query(
    "bounds_check",
    "SELECT count(*) FILTER (WHERE lat NOT BETWEEN -34.7 AND -34.5 OR lon NOT BETWEEN -58.5 AND -58.3) AS n_outside, count(*) AS n FROM v_points",
)(
    lambda s, d: views.points(s, d)
        .agg(F.count_if(~F.col("lat").between(-34.7, -34.5) | ~F.col("lon").between(-58.5, -58.3)).alias("n_outside"), F.count("*").alias("n"))
)
query(
    "null_profile",
    "SELECT 'gender' AS column_name, count(*) - count(gender) AS n_null, round(100.0 * (count(*) - count(gender)) / count(*), 4) AS pct_null FROM "
    "v_trips UNION ALL SELECT 'dep_ts', count(*) - count(dep_ts), round(100.0 * (count(*) - count(dep_ts)) / count(*), 4) FROM v_trips",
)(
    lambda s, d: M.null_profile(views.trips(s, d).select("gender", "dep_ts"))
)
query(
    "fill_then_drop",
    "SELECT user_id, coalesce(user_age, 0) AS user_age FROM v_users WHERE gender_full IS NOT NULL",
)(
    lambda s, d: views.users(s, d).na.fill(0, ["user_age"]).na.drop().select("user_id", "user_age")
)
query("fill_zero", "SELECT user_id, gender_full, coalesce(user_age, 0) AS user_age FROM v_users")(lambda s, d: views.users(s, d).na.fill(0))
query(
    "sanitize_numeric",
    "SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE greatest(value - 50, 0.0) END, 4) AS clean FROM events",
)(
    lambda s, d: table(s, d, "events")
        .select("event_id", E.sanitized(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 50), 0.0).alias("clean"))
)
query(
    "guard_targets",
    "SELECT event_type, max(value) > 200 AS rejected FROM events GROUP BY 1",
)(
    lambda s, d: T.guard_targets(table(s, d, "events"), "event_type", "value", 200)
)
_LAMBDA = "SELECT user_id % 10 AS k, value / 3 AS up, value / 5 AS down FROM events"
_lambda = lambda s, d: table(s, d, "events").select((F.col("user_id") % 10).alias("k"), (F.col("value") / 3).alias("up"), (F.col("value") / 5).alias("down"), F.col("event_id").alias("id"))
query(
    "guard_intensity",
    f"SELECT k, count(*) FILTER (WHERE NOT (up > 0 AND up <= 100 AND down > 0 AND down <= 100)) AS n_dropped, count(*) AS n FROM ({_LAMBDA}) GROUP "
    f"BY 1",
)(
    lambda s, d: P.guard_intensity(_lambda(s, d), "up", "down")
        .groupBy("k")
        .agg(F.count_if(~F.col("usable")).alias("n_dropped"), F.count("*").alias("n"))
)
query(
    "sample_rows",
    "SELECT event_id, value FROM events WHERE event_id % 100 < 20",
)(
    lambda s, d: T.sample_rows(table(s, d, "events"), F.col("event_id"), 20).select("event_id", "value")
)

query(
    "sample_exactly",
    "SELECT event_id, value FROM events ORDER BY CAST('0x' || substr(md5('42|' || event_id), 1, 15) AS BIGINT) LIMIT 500",
)(
    lambda s, d: T.sample_exactly(table(s, d, "events").select("event_id", "value"), 500, T.seeded_hash(42, F.col("event_id")))
)

# --- joins

query(
    "join_users_flags",
    "SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, u.gender_full IS NOT NULL AS user_matched, u.user_age IS NOT NULL AS "
    "age_available FROM v_trips t LEFT JOIN v_users u USING (user_id)",
)(
    lambda s, d: T.join_users(views.trips(s, d), views.users(s, d))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "user_matched", "age_available")
)
query(
    "completeness_flag",
    "SELECT event_id, true AS in_main, value IS NOT NULL AS weather_available FROM events",
)(
    lambda s, d: table(s, d, "events").select("event_id", F.lit(True).alias("in_main"), F.col("value").isNotNull().alias("weather_available"))
)
query(
    "missing_trips",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)(
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")
)
query(
    "join_weather_hour",
    "SELECT e.event_id, round(w.temperature_2m, 4) AS temperature_2m, w.is_raining, w.hour_ts IS NOT NULL AS weather_matched FROM events e LEFT "
    "JOIN v_weather w ON date_trunc('hour', e.ts) = w.hour_ts",
)(
    lambda s, d: T.join_weather(table(s, d, "events"), views.weather(s, d), "ts")
        .select("event_id", "temperature_2m", "is_raining", "weather_matched")
)
query(
    "map_od_cluster",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, origin_cluster, dest_cluster FROM v_lab",
)(
    lambda s, d: T.map_clusters(views.trips(s, d), views.station_cluster(s, d))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "origin_cluster", "dest_cluster")
)
query(
    "combine_int_ext",
    "SELECT origin_cluster AS cluster_id, time_bucket(INTERVAL 1 day, dep_ts) AS ts_start, count(*) FILTER (WHERE is_internal) AS "
    "dep_internal_count, count(*) FILTER (WHERE NOT is_internal) AS dep_external_count FROM v_lab GROUP BY 1, 2",
)(
    lambda s, d: C.cells(labelled(s, d), "dep", DAY).select("cluster_id", "ts_start", "dep_internal_count", "dep_external_count")
)
query(
    "skeleton_grid",
    "SELECT event_type, ts_start FROM v_dense",
)(
    lambda s, d: C.skeleton(table(s, d, "events").select("event_type").distinct(), table(s, d, "events"), "ts", "30 minutes")
)
query("densify", "SELECT event_type, ts_start, n, round(v, 4) AS v FROM v_dense")(dense)
query(
    "attach_centroids",
    "SELECT p.station_id, p.cluster_id, round(c.lat, 4) AS cluster_lat, round(c.lon, 4) AS cluster_lon, c.n AS station_count FROM v_points p LEFT "
    "JOIN (SELECT cluster_id, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM v_points GROUP BY 1) c USING (cluster_id)",
)(
    lambda s, d: K.attach_centroids(views.points(s, d), K.centroids(views.points(s, d)))
        .select("station_id", "cluster_id", "cluster_lat", "cluster_lon", "station_count")
)
query(
    "attach_slot_weather",
    "SELECT d.event_type, d.ts_start, coalesce(w.t, 0.0) AS temperature_2m, CAST(w.t IS NOT NULL AS INT) AS weather_data_available FROM v_dense d "
    "LEFT JOIN (SELECT ts_start, avg(v) AS t FROM v_slots GROUP BY 1) w USING (ts_start)",
    exact=True,
)(
    lambda s, d: dense(s, d)
        .drop("v")
        .join(slot_series(s, d).groupBy("ts_start").agg(F.avg("v").alias("t")), "ts_start", "left")
        .select(
            "event_type", "ts_start", F.coalesce("t", F.lit(0.0)).alias("temperature_2m"),
            E.flag(F.col("t").isNotNull()).alias("weather_data_available")
        )
)
_ACT = "SELECT station_id, CAST(sum(o) AS BIGINT) AS n_dep, CAST(sum(1 - o) AS BIGINT) AS n_arr, count(*) AS n_total FROM (SELECT origin_station_id AS station_id, 1 AS o FROM v_trips UNION ALL SELECT dest_station_id, 0 FROM v_trips) GROUP BY 1"
query("station_activity", _ACT)(lambda s, d: T.station_activity(views.trips(s, d)))
query(
    "active_stations",
    f"SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT station_id FROM ({_ACT}) WHERE n_total >= 4700)",
)(
    lambda s, d: table(s, d, "nation")
        .select("n_nationkey", "n_name")
        .join(T.station_activity(views.trips(s, d)).where("n_total >= 4700"), F.col("n_nationkey") == F.col("station_id"), "left_semi")
)
_knn = lambda s, d: G.knn_pairs(views.points(s, d), 5, 5.0)
_edges = lambda s, d: sinks.cut(G.undirected(_knn(s, d)))  # noqa: E731  written, as most queries read them twice
query("knn_pairs", "SELECT src, dst, round(km, 4) AS km FROM v_knn")(_knn)
_SERIES = "SELECT station_id, ts_start, n FROM (SELECT CAST(user_id AS BIGINT) AS station_id, time_bucket(INTERVAL 1 day, ts) AS ts_start, count(*) AS n FROM events GROUP BY 1, 2)"
_series = lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("station_id"), E.slot("ts", DAY).alias("ts_start")).agg(F.count("*").alias("n"))
query(
    "neighbor_demand",
    f"WITH x AS ({_SERIES}), g AS (SELECT station_id, ts_start FROM (SELECT DISTINCT src AS station_id FROM v_edges), (SELECT unnest(generate_series(min(ts_start), max(ts_start), "
    f"INTERVAL 1 day)) AS ts_start FROM x)), y AS (SELECT src AS station_id, ts_start, CAST(sum(n) AS BIGINT) AS n FROM v_edges JOIN x ON x.station_id = dst GROUP BY 1, 2) "
    f"SELECT *, lag(near_n, 1, 0) OVER (PARTITION BY station_id ORDER BY ts_start) AS near_n_lag_1 FROM (SELECT station_id, ts_start, CAST(coalesce(n, 0) AS BIGINT) AS near_n FROM g "
    f"LEFT JOIN y USING (station_id, ts_start))",
)(
    lambda s, d: G.neighbor_demand(_edges(s, d), _series(s, d), "n")
)

# --- aggregations


def _cell_sql(side: str, inside: bool, digits: bool = True) -> str:
    cluster, ts, cond = ("origin_cluster", "dep_ts", "is_internal") if side == "dep" else ("dest_cluster", "coalesce(arr_ts, dep_ts)", "is_internal")
    cond, p = (cond if inside else f"NOT {cond}"), f"{side}_{'internal' if inside else 'external'}"
    f = lambda more: f"count(*) FILTER (WHERE {cond} AND {more})"
    parts = [f"count(*) FILTER (WHERE {cond}) AS {p}_count", *(f"{f(f"gender = '{g.upper()}'")} AS {p}_{g}" for g in ("male", "female", "other"))]
    parts += [f"{f(f'user_age BETWEEN {a} AND {b}')} AS {p}_{n}" for n, (a, b) in E.AGE_BINS.items()]
    parts += [f"{f('user_age IS NOT NULL')} AS {p}_age_available", f"{f("bike_model = 'ICONIC'")} AS {p}_model_iconic"]
    if side == "dep":
        made = {"mean": f"coalesce(avg(duration_s) FILTER (WHERE {cond}), 0.0)", "std": f"coalesce(stddev_samp(duration_s) FILTER (WHERE {cond}), 0.0)"}
        parts += [f"{f'round({x}, 4)' if digits else x} AS {p}_duration_{name}" for name, x in made.items()]
    return f"SELECT {cluster} AS cluster_id, time_bucket(INTERVAL 1 day, {ts}) AS ts_start, {', '.join(parts)} FROM v_lab GROUP BY 1, 2"


for _side in ("dep", "arr"):
    for _inside in (True, False):
        _p = f"{_side}_{'internal' if _inside else 'external'}"
        query(_p, _cell_sql(_side, _inside))(lambda s, d, side=_side, p=_p: (c := C.cells(labelled(s, d), side, DAY)).select("cluster_id", "ts_start", *(x for x in c.columns if x.startswith(p))))
query(
    "cell_weather",
    "SELECT e.event_type, time_bucket(INTERVAL 30 minute, e.ts) AS ts_start, round(avg(w.temperature_2m), 4) AS temperature_2m_mean, "
    "CAST(sum(w.is_raining) AS BIGINT) AS is_raining_sum FROM events e LEFT JOIN v_weather w ON date_trunc('hour', e.ts) = w.hour_ts GROUP BY 1, 2",
)(
    lambda s, d: C.cell_weather(
        T.join_weather(table(s, d, "events"), views.weather(s, d), "ts"), ["event_type", E.slot("ts").alias("ts_start")],
        ["temperature_2m", "dew_point_2m"], ["is_raining", "heavy_rain"]
    )
)
query(
    "activity_flags",
    "SELECT dest_cluster AS cluster_id, time_bucket(INTERVAL 1 day, arr_ts) AS ts_start, CAST(count(*) FILTER (WHERE is_internal) > 0 AS INT) AS "
    "has_arr_internal, CAST(count(*) FILTER (WHERE NOT is_internal) > 0 AS INT) AS has_arr_external FROM v_lab GROUP BY 1, 2",
)(
    lambda s, d: C.cells(labelled(s, d), "arr", DAY).select("cluster_id", "ts_start", "has_arr_internal", "has_arr_external")
)
query(
    "slot_weather",
    "SELECT time_bucket(INTERVAL 30 minute, e.ts) AS ts_start, avg(w.temperature_2m) AS temperature_2m, CAST(round(avg(w.is_raining)) AS INT) AS "
    "is_raining FROM events e LEFT JOIN v_weather w ON date_trunc('hour', e.ts) = w.hour_ts GROUP BY 1",
    exact=True,
)(
    lambda s, d: C.slot_weather(T.join_weather(table(s, d, "events"), views.weather(s, d), "ts"), "ts", ["temperature_2m"], ["is_raining"], "30 minutes")
)
query(
    "node_summary",
    "SELECT event_type, round(avg(n), 4) AS n_mean, round(stddev_samp(n), 4) AS n_std, round(avg(v), 4) AS v_mean, round(stddev_samp(v), 4) AS "
    "v_std, round(avg(n), 4) AS target_n FROM v_dense GROUP BY 1",
)(
    lambda s, d: W.node_summary(dense(s, d), "event_type", ["n", "v"], ["n"])
)
_UNM = "(origin_cluster = -1 OR dest_cluster = -1)"
query(
    "trip_class_stats",
    "SELECT count(*) AS n_trips, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{n}, round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 4) AS pct_{n}" for n, c in {"internal": "is_internal", "external": "NOT is_internal", "ghost": "is_internal", "unmapped": _UNM, "iconic": "bike_model = 'ICONIC'"}.items())
    + " FROM v_lab",
)(
    lambda s, d: T.class_stats(labelled(s, d))
)
query(
    "age_stats",
    "SELECT count(*) FILTER (WHERE user_age BETWEEN 0 AND 25) AS n_young, count(*) FILTER (WHERE user_age BETWEEN 26 AND 55) AS n_adult, count(*) "
    "FILTER (WHERE user_age BETWEEN 56 AND 120) AS n_senior, count(user_age) AS n_known FROM v_lab",
)(
    lambda s, d: T.age_stats(labelled(s, d))
)
query(
    "match_rates",
    "SELECT round(100 * avg(CAST(gender_full IS NOT NULL AS INT)), 4) AS pct_user, round(100 * avg(CAST(user_age IS NOT NULL AS INT)), 4) AS "
    "pct_age FROM v_lab",
)(
    lambda s, d: labelled(s, d)
        .agg((100 * F.avg(E.flag(F.col("user_matched")))).alias("pct_user"), (100 * F.avg(E.flag(F.col("age_available")))).alias("pct_age"))
)
query(
    "coverage_stats",
    "SELECT count(*) AS n, count(*) FILTER (WHERE n > 0) AS n_active, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 4) AS pct_active "
    "FROM v_dense",
)(
    lambda s, d: dense(s, d)
        .agg(
            F.count("*").alias("n"), F.count_if(F.col("n") > 0).alias("n_active"),
            (100.0 * F.count_if(F.col("n") > 0) / F.count("*")).alias("pct_active")
        )
)
query(
    "cluster_sizes",
    "SELECT min(c) AS min_size, max(c) AS max_size, round(avg(c), 4) AS mean_size, round(stddev_pop(c), 4) AS std_size FROM (SELECT count(*) AS c "
    "FROM v_points GROUP BY cluster_id)",
)(
    lambda s, d: K.cluster_sizes(views.points(s, d))
)
query(
    "size_histogram",
    "SELECT CASE WHEN c <= 0 THEN '0' WHEN c = 1 THEN '1' WHEN c <= 4 THEN '2-4' WHEN c <= 9 THEN '5-9' WHEN c <= 19 THEN '10-19' ELSE '20+' END "
    "AS bucket, count(*) AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey) GROUP BY 1",
)(
    lambda s, d: K.size_histogram(table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c")), "c")
)
query(
    "describe_numeric",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std FROM events" for c in ("value", "user_id")),
)(
    lambda s, d: M.describe(table(s, d, "events"), ["value", "user_id"])
)
query(
    "duration_by_flag",
    "SELECT CAST(gender IS NULL AS INT) AS dur_is_null, round(avg(duration_s), 4) AS mean_duration, count(*) AS n FROM v_trips GROUP BY 1",
)(
    lambda s, d: views.trips(s, d)
        .groupBy(E.flag(F.col("gender").isNull()).alias("dur_is_null"))
        .agg(F.avg("duration_s").alias("mean_duration"), F.count("*").alias("n"))
)
_ENDS = "(SELECT origin_station_id AS station_id, dep_ts AS ts, 1 AS o, duration_s, bike_model, gender FROM v_trips UNION ALL SELECT dest_station_id, arr_ts, 0, duration_s, bike_model, gender FROM v_trips)"
query(
    "station_slot_counts",
    "SELECT station_id, time_bucket(INTERVAL 1 day, ts) AS ts_start, count(*) FILTER (WHERE o = 1) AS dep_last_dt, count(*) FILTER (WHERE o = 0) AS arr_last_dt, round(avg(duration_s) FILTER (WHERE o = 1), 4) AS trip_dur_mean_last_dt, "
    + ", ".join(f"count(*) FILTER (WHERE o = 1 AND bike_model = '{m}') AS model_{m.lower()}_cnt" for m in ("FIT", "ICONIC")) + ", "
    + ", ".join(f"round(CASE WHEN count(*) FILTER (WHERE o = 1) > 0 THEN count(*) FILTER (WHERE o = 1 AND gender = '{g.upper()}') / count(*) FILTER (WHERE o = 1) END, 4) AS share_{g}" for g in ("male", "female", "other"))
    + f" FROM {_ENDS} GROUP BY 1, 2",
)(
    lambda s, d: T.station_slots(views.trips(s, d), DAY)
)
query(
    "activity_heatmap",
    "SELECT CAST(isodow(ts) AS INT) AS dow, " + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24))
    + " FROM events GROUP BY 1",
)(
    lambda s, d: table(s, d, "events")
        .groupBy(E.iso_weekday("ts").alias("dow"))
        .agg(*(F.count_if(F.hour("ts") == h).alias(f"h{h}") for h in range(24)))
)
query(
    "weather_impact",
    "SELECT w.is_raining, count(*) AS n, round(avg(e.value), 4) AS mean_value FROM events e LEFT JOIN v_weather w ON date_trunc('hour', e.ts) = "
    "w.hour_ts GROUP BY 1",
)(
    lambda s, d: T.join_weather(table(s, d, "events"), views.weather(s, d), "ts")
        .groupBy("is_raining")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
)
query(
    "user_profile",
    "SELECT user_id, count(*) AS n_trips, round(avg(duration_s), 4) AS mean_duration, count(DISTINCT origin_station_id) AS n_stations, min(dep_ts) "
    "AS first_ts FROM v_trips GROUP BY 1",
)(
    lambda s, d: views.trips(s, d)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n_trips"), F.avg("duration_s").alias("mean_duration"), F.count_distinct("origin_station_id").alias("n_stations"),
            F.min("dep_ts").alias("first_ts")
        )
)
query(
    "station_profile",
    "SELECT origin_station_id AS station_id, count(*) AS n_trips, count(DISTINCT user_id) AS n_users, round(avg(duration_s), 4) AS mean_duration "
    "FROM v_trips GROUP BY 1",
)(
    lambda s, d: views.trips(s, d)
        .groupBy(F.col("origin_station_id").alias("station_id"))
        .agg(F.count("*").alias("n_trips"), F.count_distinct("user_id").alias("n_users"), F.avg("duration_s").alias("mean_duration"))
)
query(
    "distinct_count",
    "SELECT count(DISTINCT origin_station_id) AS n FROM v_trips",
)(
    lambda s, d: views.trips(s, d).agg(F.count_distinct("origin_station_id").alias("n"))
)
@query(
    "distinct_sketch",
    "SELECT week, n_exact, true AS within FROM (SELECT date_trunc('week', ts) AS week, count(DISTINCT user_id) AS n_exact FROM events GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT user_id) FROM events)",
)
def _distinct_sketch(s: SparkSession, d: str) -> DataFrame:
    """Users of each week and of all time by merged sketches of slots, held against the exact counts: within five standard errors."""
    events = table(s, d, "events")
    sketches = sinks.cut(M.slot_sketches(events, E.slot("ts"), "user_id", 14))
    week = lambda ts: F.date_trunc("week", ts).cast("timestamp_ntz")
    rough = M.distinct_over(sketches, week("slot").alias("week")).unionByName(M.distinct_over(sketches).select(F.lit(None).cast("timestamp_ntz").alias("week"), "n"))
    exact = events.groupBy(week("ts").alias("week")).agg(F.count_distinct("user_id").alias("n_exact"))
    exact = exact.unionByName(events.agg(F.lit(None).cast("timestamp_ntz").alias("week"), F.count_distinct("user_id").alias("n_exact")))
    off = F.abs(F.col("n") - F.col("n_exact")) <= 5 * 1.04 / 2**7 * F.col("n_exact") + 1
    return exact.join(rough.withColumnRenamed("week", "_week"), F.col("week").eqNullSafe(F.col("_week"))).select("week", "n_exact", off.alias("within"))


query(
    "zero_share",
    "SELECT round(avg(CAST(n = 0 AS INT)), 4) AS zero_share FROM v_dense",
)(
    lambda s, d: dense(s, d).agg(F.avg(E.flag(F.col("n") == 0)).alias("zero_share"))
)
query(
    "imbalance_count",
    f"SELECT count(*) FILTER (WHERE n_arr > n_dep) AS n_over, count(*) FILTER (WHERE n_arr < n_dep) AS n_under FROM ({_ACT})",
)(
    lambda s, d: T.station_activity(views.trips(s, d))
        .agg(F.count_if(F.col("n_arr") > F.col("n_dep")).alias("n_over"), F.count_if(F.col("n_arr") < F.col("n_dep")).alias("n_under"))
)

# --- windows

_W = "OVER (PARTITION BY event_type ORDER BY ts_start)"


def _roll(fn: str, n: int) -> str:
    frame = f"OVER (PARTITION BY event_type ORDER BY ts_start ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count(*) {frame} = {n} THEN coalesce({fn}(n) {frame}, 0.0) ELSE 0.0 END, 4)"


_lagged = lambda s, d: dense(s, d).select("event_type", "ts_start", *W.lag_columns(["n"], "event_type", "ts_start", W.per_day(30)))
query(
    "lags",
    "SELECT event_type, ts_start, " + ", ".join(f"lag(n, {k}, 0) {_W} AS n_lag_{k}" for k in W.LAGS) + " FROM v_dense",
)(
    lambda s, d: _lagged(s, d).select("event_type", "ts_start", *(f"n_lag_{k}" for k in W.LAGS))
)
query(
    "sorted_lags",
    "SELECT event_type, ts_start, n, " + ", ".join(f"lag(n, {k}, 0) {_W} AS n_lag_{k}" for k in W.LAGS) + " FROM v_dense",
)(
    lambda s, d: sinks.sorted_table(dense(s, d).select("event_type", "ts_start", "n"), ["event_type"], ["ts_start"])
        .select("event_type", "ts_start", "n", *W.lag_columns(["n"], "event_type", "ts_start", 48, rolling=(), seasonal=()))
)
query(
    "rolling_mean",
    "SELECT event_type, ts_start, " + ", ".join(f"{_roll('avg', k)} AS n_rolling_mean_{k}" for k in W.ROLLING) + " FROM v_dense",
)(
    lambda s, d: _lagged(s, d).select("event_type", "ts_start", *(f"n_rolling_mean_{k}" for k in W.ROLLING))
)
query(
    "rolling_std",
    "SELECT event_type, ts_start, " + ", ".join(f"{_roll('stddev_samp', k)} AS n_rolling_std_{k}" for k in W.ROLLING) + " FROM v_dense",
)(
    lambda s, d: _lagged(s, d).select("event_type", "ts_start", *(f"n_rolling_std_{k}" for k in W.ROLLING))
)
query(
    "seasonal_lags",
    f"SELECT event_type, ts_start, lag(n, 48, 0) {_W} AS n_same_hour_yesterday, lag(n, 336, 0) {_W} AS n_same_hour_last_week FROM v_dense",
)(
    lambda s, d: _lagged(s, d).select("event_type", "ts_start", "n_same_hour_yesterday", "n_same_hour_last_week")
)
_SPANS = {"short_term": 1, "daily": 48, "weekly": 336}
query(
    "lag_flags",
    "SELECT event_type, ts_start, "
    + ", ".join(f"CAST(lag(n, {k}, 0) {_W} > 0 AS INT) AS has_{x}_lags, CAST(row_number() {_W} > {k} AS INT) AS history_{x}" for x, k in _SPANS.items())
    + " FROM v_dense",
)(
    lambda s, d: dense(s, d).select("event_type", "ts_start", *W.lag_flags("event_type", "ts_start", 30, "n"))
)
_station = lambda s, d: W.station_features(dense(s, d), "event_type", "ts_start", ["n"])
query(
    "next_targets",
    f"SELECT event_type, ts_start, lead(n, 1) {_W} AS y_next FROM v_dense",
)(
    lambda s, d: _station(s, d).select("event_type", "ts_start", F.col("n_next").alias("y_next"))
)
query(
    "station_lags",
    "SELECT event_type, ts_start, " + ", ".join(f"lag(n, {k}) {_W} AS n_lag_{k}" for k in range(1, 7)) + " FROM v_dense",
)(
    lambda s, d: _station(s, d).select("event_type", "ts_start", *(f"n_lag_{k}" for k in range(1, 7)))
)
_D = "OVER (PARTITION BY event_type ORDER BY ts_start ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)"
query(
    "daily_stats",
    f"SELECT event_type, ts_start, round(avg(n) {_D}, 4) AS dep_ma_24h, round(stddev_samp(n) {_D}, 4) AS dep_std_24h, round(CASE WHEN avg(n) {_D} = "
    f"0 THEN NULL ELSE n / avg(n) {_D} END, 4) AS dep_ratio_dt_24h FROM v_dense",
)(
    lambda s, d: _station(s, d).select("event_type", "ts_start", *(F.col(f"n_{c}").alias(f"dep_{c}") for c in ("ma_24h", "std_24h", "ratio_dt_24h")))
)
_DAYS = f"""d AS (SELECT station_id, time_bucket(INTERVAL 1 day, ts) AS ts_start, count(*) FILTER (WHERE o = 1) AS dep, count(*) FILTER (WHERE o = 0) AS arr FROM {_ENDS} GROUP BY 1, 2),
g AS (SELECT station_id, ts_start FROM (SELECT DISTINCT station_id FROM d), (SELECT unnest(generate_series(min(ts_start), max(ts_start), INTERVAL 1 day)) AS ts_start FROM d)),
h AS (SELECT station_id, ts_start, CAST(coalesce(dep, 0) AS BIGINT) AS dep, CAST(coalesce(arr, 0) AS BIGINT) AS arr FROM g LEFT JOIN d USING (station_id, ts_start))"""
_OF = "OVER (PARTITION BY station_id ORDER BY ts_start)"


@query("station_history", f"WITH {_DAYS} SELECT station_id, ts_start, dep, arr, " + ", ".join(f"lag({c}, {k}) {_OF} AS {c}_lag_{k}" for c in ("dep", "arr") for k in range(1, 7)) + f", lead(dep, 1) {_OF} AS dep_next, lead(arr, 1) {_OF} AS arr_next FROM h")
def _station_history(s: SparkSession, d: str) -> DataFrame:
    """Departures and arrivals of every station and day, dense, with their lags and next days."""
    days = sinks.cut(T.station_slots(views.trips(s, d), DAY).select("station_id", "ts_start", F.col("dep_last_dt").alias("dep"), F.col("arr_last_dt").alias("arr")))
    span = days.agg(F.min("ts_start").alias("lo"), F.max("ts_start").alias("hi"))
    grid = days.select("station_id").distinct().crossJoin(span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 day"))).alias("ts_start")))
    made = W.station_features(C.densify(grid, ["station_id", "ts_start"], days), "station_id", "ts_start", ["dep", "arr"], 24 * 60)
    return made.select("station_id", "ts_start", "dep", "arr", *(f"{c}_lag_{k}" for c in ("dep", "arr") for k in range(1, 7)), "dep_next", "arr_next")


query(
    "weather_lag",
    "SELECT a.hour_ts, b.precipitation AS precipitation_1h_ago, b.is_raining AS is_raining_1h_ago FROM v_weather a LEFT JOIN v_weather b ON "
    "b.hour_ts = a.hour_ts - INTERVAL 1 hour",
    exact=True,
)(
    lambda s, d: (w := views.weather(s, d))
        .select("hour_ts")
        .join(
            w.select((F.col("hour_ts") + F.expr("INTERVAL 1 HOUR")).alias("hour_ts"), F.col("precipitation").alias("precipitation_1h_ago"), F.col("is_raining").alias("is_raining_1h_ago")),
            "hour_ts", "left"
        )
)
_PAST = "OVER (PARTITION BY event_type ORDER BY ts_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
query(
    "sequences",
    f"SELECT event_type, target_ts, inputs, v_sum, targets FROM (SELECT event_type, ts_start AS target_ts, array_to_string(list(n) {_PAST}, ',') AS "
    f"inputs, round(sum(v) {_PAST}, 4) AS v_sum, n || ',' || lead(n, 1) {_W} AS targets, row_number() {_W} AS rn FROM v_dense) WHERE rn > 24 AND "
    f"targets IS NOT NULL",
)(
    lambda s, d: W.sequences(dense(s, d), "event_type", "ts_start", ["n", "v"], "n", 24, 2)
        .select(
            "event_type", "target_ts", F.array_join(F.col("inputs.n").cast("array<string>"), ",").alias("inputs"),
            F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x["v"]).alias("v_sum"),
            F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets")
        )
)
query(
    "ts_folds",
    """WITH r AS (SELECT event_type, ts_start, row_number() OVER (PARTITION BY event_type ORDER BY ts_start) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM v_dense),
f AS (SELECT r.*, fold, c // 4 AS sz, c - (3 - fold + 1) * (c // 4) AS lo FROM r CROSS JOIN (SELECT unnest([1, 2, 3]) AS fold))
SELECT event_type, fold, CASE WHEN i < lo THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(ts_start) AS first_ts, max(ts_start) AS last_ts FROM f WHERE i < lo + sz GROUP BY 1, 2, 3""",
)(
    lambda s, d: W.folds(dense(s, d), "event_type", "ts_start", 3)
        .groupBy("event_type", "fold", "role")
        .agg(F.count("*").alias("n"), F.min("ts_start").alias("first_ts"), F.max("ts_start").alias("last_ts"))
)
_SWEEP = "SELECT CAST(p_size AS INT) * 5 AS k, 1000.0 / p_size AS inertia, avg(p_retailprice) / 10000 AS silhouette FROM part GROUP BY p_size"
_sweep = lambda s, d: table(s, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("p")).select((F.col("p_size").cast("int") * 5).alias("k"), (F.lit(1000.0) / F.col("p_size")).alias("inertia"), (F.col("p") / 10000).alias("silhouette"))
query(
    "rank_best_k",
    "WITH r AS (" + _SWEEP
    + ") SELECT (SELECT k FROM r ORDER BY silhouette DESC, k LIMIT 1) AS best, (SELECT k FROM r WHERE k >= 50 ORDER BY silhouette DESC, k LIMIT 1) "
      "AS best_50, (SELECT k FROM r WHERE k > 100 ORDER BY silhouette DESC, k LIMIT 1) AS best_100",
)(
    lambda s, d: K.best_k(_sweep(s, d))
)
query(
    "elbow_k",
    "WITH r AS (" + _SWEEP
    + "), m AS (SELECT min(k) AS k0, max(k) AS k1, min(inertia) AS i0, max(inertia) AS i1 FROM r) SELECT k AS elbow_k FROM r, m ORDER BY (1 - (k - "
      "k0) / (k1 - k0)::DOUBLE) - (inertia - i0) / (i1 - i0) DESC, k LIMIT 1",
)(
    lambda s, d: K.elbow(_sweep(s, d))
)
query(
    "station_index",
    "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS idx FROM nation",
)(
    lambda s, d: T.dense_index(table(s, d, "nation"), "n_nationkey")
)

# --- order, top, sets

query(
    "sort_series",
    "SELECT event_type, ts_start, n FROM v_slots ORDER BY 1, 2",
)(
    lambda s, d: slot_series(s, d).select("event_type", "ts_start", "n").orderBy("event_type", "ts_start")
)
query(
    "top_stations",
    "SELECT origin_station_id, count(*) AS n FROM v_trips GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
)(
    lambda s, d: views.trips(s, d).groupBy("origin_station_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origin_station_id").limit(10)
)
query(
    "best_model",
    "SELECT event_type AS best FROM events GROUP BY 1 ORDER BY avg(value), 1 LIMIT 1",
)(
    lambda s, d: table(s, d, "events")
        .groupBy("event_type")
        .agg(F.avg("value").alias("loss"))
        .agg(F.min_by("event_type", F.struct("loss", "event_type")).alias("best"))
)
query(
    "station_dim",
    f"SELECT a.station_id, a.n_total AS n_ends, round(p.lat, 4) AS lat, round(p.lon, 4) AS lon FROM ({_ACT}) a JOIN v_points p ON a.station_id = "
    f"p.station_id",
)(
    lambda s, d: T.station_dim(views.trips(s, d), views.points(s, d).select("station_id", "lat", "lon"))
)
query(
    "union_splits",
    f"SELECT split, count(*) AS n FROM (SELECT {_SPLIT} AS split FROM v_trips) WHERE split <> 'test' GROUP BY 1",
)(
    lambda s, d: (t := _split(s, d)).where("split = 'train'").unionByName(t.where("split = 'val'")).groupBy("split").agg(F.count("*").alias("n"))
)
query(
    "diff_ids",
    "SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM v_users",
)(
    lambda s, d: table(s, d, "customer").select("c_custkey").subtract(views.users(s, d).select("user_id"))
)

# --- scalar functions

query(
    "slot_floor",
    "SELECT event_id, time_bucket(INTERVAL 30 minute, ts) AS ts_start FROM events",
)(
    lambda s, d: table(s, d, "events").select("event_id", E.slot("ts").alias("ts_start"))
)
_cal = lambda s, d: table(s, d, "events").select("event_id", *E.calendar("ts"))
query(
    "calendar_parts",
    "SELECT event_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(year(ts) "
    "AS INT) AS year FROM events",
)(
    lambda s, d: _cal(s, d).select("event_id", "hour_of_day", "day_of_week", "month", "year")
)
query(
    "cyclic",
    "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 4) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 4) + 0.0 AS hour_cos, "
    "round(sin(2 * pi() * isodow(ts) / 7), 4) + 0.0 AS dow_sin, round(cos(2 * pi() * isodow(ts) / 7), 4) + 0.0 AS dow_cos FROM events",
)(
    lambda s, d: _cal(s, d).select("event_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")))
)
query(
    "calendar_flags",
    "SELECT event_id, CAST(isodow(ts) IN (6, 7) AS INT) AS is_weekend, CAST(hour(ts) BETWEEN 7 AND 9 AS INT) AS is_morning_rush, CAST(hour(ts) "
    "BETWEEN 17 AND 19 AS INT) AS is_evening_rush, CAST(hour(ts) BETWEEN 6 AND 22 AS INT) AS is_daytime, CAST(month(ts) IN (12, 1, 2) AS INT) AS "
    "is_summer, CAST(month(ts) BETWEEN 6 AND 8 AS INT) AS is_winter FROM events",
)(
    lambda s, d: _cal(s, d).select("event_id", "is_weekend", "is_morning_rush", "is_evening_rush", "is_daytime", "is_summer", "is_winter")
)
query(
    "age_bins",
    "SELECT user_id, " + ", ".join(f"CAST(coalesce(user_age BETWEEN {a} AND {b}, false) AS INT) AS age_{n}" for n, (a, b) in E.AGE_BINS.items())
    + ", CAST(user_age IS NOT NULL AS INT) AS age_known FROM v_users",
)(
    lambda s, d: views.users(s, d).select("user_id", *E.age_flags(F.col("user_age")))
)
query(
    "bike_flag",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(bike_model = 'ICONIC' AS INT) AS is_iconic FROM v_trips",
)(
    lambda s, d: labelled(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "is_iconic")
)
query(
    "od_class",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, is_internal, NOT is_internal AS is_external, is_internal AS is_ghost, {_UNM} AS "
    f"is_unmapped FROM v_lab",
)(
    lambda s, d: labelled(s, d)
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_internal", "is_external", "is_ghost", "is_unmapped")
)
_HAV = "2 * 6371.0 * asin(sqrt(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2)))"
query(
    "haversine_km",
    f"SELECT station_id, round({_HAV.format(a='lat', b='-34.6', c='lon', d='-58.4')}, 4) AS km FROM v_points",
)(
    lambda s, d: views.points(s, d).select("station_id", E.haversine_km(F.col("lat"), F.col("lon"), F.lit(-34.6), F.lit(-58.4)).alias("km"))
)
query(
    "centroid_distance",
    f"SELECT p.station_id, p.cluster_id, round({_HAV.format(a='p.lat', b='c.lat', c='p.lon', d='c.lon')}, 4) AS km FROM v_points p JOIN (SELECT "
    f"cluster_id, avg(lat) AS lat, avg(lon) AS lon FROM v_points GROUP BY 1) c USING (cluster_id)",
)(
    lambda s, d: K.centroid_distance(views.points(s, d), K.centroids(views.points(s, d)))
)
_Z = "SELECT station_id, round((lat - m1) / s1, 4) AS lat_z, round((lon - m2) / s2, 4) AS lon_z FROM v_points, (SELECT avg(lat) AS m1, stddev_pop(lat) AS s1, avg(lon) AS m2, stddev_pop(lon) AS s2 FROM v_points)"
query("standardize", _Z)(lambda s, d: K.standardize(views.points(s, d), ["lat", "lon"]).select("station_id", "lat_z", "lon_z"))
_ANGLE = {"lat": "2 * pi() * (lat - lo1) / (hi1 - lo1)", "lon": "2 * pi() * (lon - lo2) / (hi2 - lo2)"}
query(
    "coord_features",
    "SELECT station_id, round((lat - m1) / s1, 4) AS lat_z, round((lon - m2) / s2, 4) AS lon_z, "
    + ", ".join(f"round({f}({k} * {_ANGLE[c]}), 4) + 0.0 AS {c}_{f}_{k}" for c in _ANGLE for k in (1, 2) for f in ("sin", "cos"))
    + " FROM v_points, (SELECT avg(lat) AS m1, stddev_pop(lat) AS s1, avg(lon) AS m2, stddev_pop(lon) AS s2, min(lat) AS lo1, max(lat) AS hi1, "
      "min(lon) AS lo2, max(lon) AS hi2 FROM v_points)",
)(
    lambda s, d: K.coord_features(K.standardize(views.points(s, d), ["lat", "lon"]))
        .select(
            "station_id", "lat_z", "lon_z",
            *((F.round(f"{c}_{f}_{k}", 4) + 0.0).alias(f"{c}_{f}_{k}") for c in ("lat", "lon") for k in (1, 2) for f in ("sin", "cos"))
        )
)
query(
    "wind_encoding",
    "SELECT event_id, round(sin(radians(user_id)), 4) + 0.0 AS wind_dir_sin, round(cos(radians(user_id)), 4) + 0.0 AS wind_dir_cos FROM events",
)(
    lambda s, d: table(s, d, "events")
        .select(
            "event_id", (F.round(F.sin(F.radians("user_id")), 4) + 0.0).alias("wind_dir_sin"),
            (F.round(F.cos(F.radians("user_id")), 4) + 0.0).alias("wind_dir_cos")
        )
)
_CODES = ("clear", "clouds", "drizzle", "rain")
query(
    "weather_code_onehot",
    "SELECT hour_ts, " + ", ".join(f"CAST(coalesce(weather_code = {i}, false) AS INT) AS weather_{n}" for i, n in enumerate(_CODES))
    + ", CAST(weather_code IS NULL AS INT) AS weather_null FROM v_weather",
)(
    lambda s, d: views.weather(s, d)
        .select(
            "hour_ts", *(E.flag(F.coalesce(F.col("weather_code") == i, F.lit(False))).alias(f"weather_{n}") for i, n in enumerate(_CODES)),
            E.flag(F.col("weather_code").isNull()).alias("weather_null")
        )
)
_SKY = "(SELECT *, temperature_2m - 2 AS apparent_temperature, temperature_2m / 2 AS wind_speed_10m FROM v_weather)"
_BANDS = {"temp_very_hot": "temperature_2m > 30", "temp_cold": "temperature_2m < 10", "temp_comfortable": "temperature_2m BETWEEN 15 AND 25", "is_raining": "precipitation > 0", "heavy_rain": "precipitation > 4", "light_rain": "precipitation > 0 AND precipitation <= 4", "moderate_wind": "wind_speed_10m >= 20 AND wind_speed_10m < 40", "strong_wind": "wind_speed_10m >= 40"}
query(
    "weather_flags",
    "SELECT hour_ts, " + ", ".join(f"CAST({c} AS INT) AS {n}" for n, c in _BANDS.items())
    + f", round(apparent_temperature - temperature_2m, 4) AS temp_feel_diff, CAST(temperature_2m BETWEEN 15 AND 25 AS INT) + CAST(precipitation <= "
      f"0 AS INT) + CAST(wind_speed_10m < 20 AS INT) AS weather_comfort FROM {_SKY}",
)(
    lambda s, d: views.weather(s, d)
        .withColumns({"apparent_temperature": F.col("temperature_2m") - 2, "wind_speed_10m": F.col("temperature_2m") / 2})
        .select("hour_ts", *E.weather_flags())
)
query(
    "precip_flag",
    "SELECT hour_ts, CAST(precipitation > 0 AS INT) AS has_precip FROM v_weather",
)(
    lambda s, d: views.weather(s, d).select("hour_ts", E.flag(F.col("precipitation") > 0).alias("has_precip"))
)
query(
    "occurrence_flags",
    "SELECT event_type, ts_start, CAST(n > 0 AS INT) AS has_dep, CAST(lead(n, 1, 0) OVER (PARTITION BY event_type ORDER BY ts_start) > 0 AS INT) "
    "AS has_arr, CAST(s.v IS NULL AS INT) AS dur_is_null, round(coalesce(s.v, 0.0), 4) AS duration FROM v_dense d LEFT JOIN (SELECT event_type, "
    "ts_start, v FROM v_slots) s USING (event_type, ts_start)",
)(
    lambda s, d: dense(s, d).select("event_type", "ts_start", "n", F.lead("n", 1, 0).over(Window.partitionBy("event_type").orderBy("ts_start")).alias("arr")).join(slot_series(s, d).select("event_type", "ts_start", "v"), ["event_type", "ts_start"], "left")
    .select("event_type", "ts_start", E.flag(F.col("n") > 0).alias("has_dep"), E.flag(F.col("arr") > 0).alias("has_arr"), E.flag(F.col("v").isNull()).alias("dur_is_null"), F.coalesce("v", F.lit(0.0)).alias("duration"))
)
query(
    "net_flow",
    f"SELECT station_id, n_arr - n_dep AS delta FROM ({_ACT})",
)(
    lambda s, d: T.station_activity(views.trips(s, d)).select("station_id", (F.col("n_arr") - F.col("n_dep")).alias("delta"))
)
_HOLIDAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS holiday FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('01-01', '05-01', '12-25')"
query(
    "business_calendar",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(holiday IS NOT NULL AS INT) AS is_holiday, CAST(day(dep_ts) <= 5 AS INT) AS "
    f"payday_flag, CAST(month(dep_ts) IN (1, 2, 7) AS INT) AS vacation_season, CAST(isodow(dep_ts) < 6 AND (hour(dep_ts) BETWEEN 7 AND 9 OR "
    f"hour(dep_ts) BETWEEN 17 AND 19) AS INT) AS peak_commute FROM v_trips LEFT JOIN ({_HOLIDAYS}) ON CAST(dep_ts AS DATE) = holiday",
)(
    lambda s, d: T.mark_holidays(
            views.trips(s, d),
            table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).where(F.date_format("date", "MM-dd").isin("01-01", "05-01", "12-25")),
            "dep_ts"
        )
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_holiday", *E.business_flags("dep_ts"))
)

# --- clustering

query(
    "cluster_centroids",
    "SELECT cluster_id, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, count(*) AS station_count FROM v_points GROUP BY 1",
)(
    lambda s, d: K.centroids(views.points(s, d))
)
_CEN = "(SELECT cluster_id AS c, avg(lat) AS clat, avg(lon) AS clon FROM v_points GROUP BY 1)"
_NEAR = f"SELECT station_id, c AS assigned, d2 FROM (SELECT station_id, c, power(lat - clat, 2) + power(lon - clon, 2) AS d2, row_number() OVER (PARTITION BY station_id ORDER BY power(lat - clat, 2) + power(lon - clon, 2), c) AS rn FROM v_points, {_CEN}) WHERE rn = 1"
query(
    "kmeans_assign",
    f"SELECT station_id, assigned FROM ({_NEAR})",
)(
    lambda s, d: K.assign(p := views.points(s, d), K.centroids(p)).select("station_id", "assigned")
)
query("inertia", f"SELECT round(sum(d2), 4) AS inertia FROM ({_NEAR})")(lambda s, d: K.inertia(K.assign(p := views.points(s, d), K.centroids(p))))
query(
    "silhouette",
    """WITH z AS (SELECT * FROM v_points), d AS (SELECT a.station_id, a.cluster_id, b.cluster_id AS oc, avg(sqrt(power(a.lat - b.lat, 2) + power(a.lon - b.lon, 2))) AS d FROM z a JOIN z b ON a.station_id <> b.station_id GROUP BY 1, 2, 3)
SELECT station_id, round((min(d) FILTER (WHERE oc <> cluster_id) - min(d) FILTER (WHERE oc = cluster_id)) / greatest(min(d) FILTER (WHERE oc <> cluster_id), min(d) FILTER (WHERE oc = cluster_id)), 4) AS silhouette FROM d GROUP BY 1""",
)(
    lambda s, d: K.silhouette(views.points(s, d), "lat", "lon")
)


@query("kmeans_fit")
def _kmeans_fit(s: SparkSession, d: str) -> DataFrame:
    """93 clusters, the best of ten seeds, fitted on stations of the train split only; the others go to the nearest centre."""
    points = views.points(s, d)
    train = points.where(T.hundredth(F.col("station_id")) < 80)
    scaled = K.standardize_by(train, points, ["lat", "lon"])
    k = min(93, train.count() - 1)
    model = K.fit_kmeans(scaled.where(T.hundredth(F.col("station_id")) < 80), k, ["lat_z", "lon_z"])
    return model.transform(K._vectors(scaled, ["lat_z", "lon_z"])).select("station_id", F.col("prediction").alias("cluster"))


@query("k_sweep")
def _k_sweep(s: SparkSession, d: str) -> DataFrame:
    """The sweep, with the knee and the best numbers of clusters that it gives."""
    sweep = K.k_sweep(K.standardize(views.points(s, d), ["lat", "lon"]), ["lat_z", "lon_z"])
    return sweep.crossJoin(K.elbow(sweep)).crossJoin(K.best_k(sweep))


@query("cluster_model_io", "SELECT count(*) AS n_stations, true AS same_clusters, true AS same_sizes FROM v_points")
def _model_io(s: SparkSession, d: str) -> DataFrame:
    """A model written with its map and centroids, read again: whether it gives every station the cluster of the map, and the sizes of the centroids."""
    data = K.standardize(views.points(s, d), ["lat", "lon"])
    fitted = K.fit_kmeans(data, 5, ["lat_z", "lon_z"], seeds=1, max_iter=20)
    K.save_clusters(fitted, data, ["lat_z", "lon_z"], path := scratch(s))
    model, mapped, centers = K.load_clusters(s, path)
    again = model.transform(K._vectors(data, ["lat_z", "lon_z"])).select("station_id", "prediction").join(mapped, "station_id")
    sizes = centers.agg(F.sum("station_count").alias("total"), F.count("*").alias("k"))
    return again.agg(F.count("*").alias("n_stations"), F.bool_and(F.col("prediction") == F.col("cluster_id")).alias("same_clusters"), F.count_distinct("cluster_id").alias("seen")).crossJoin(sizes).select(
        "n_stations", "same_clusters", ((F.col("total") == F.col("n_stations")) & (F.col("k") == F.col("seen"))).alias("same_sizes")
    )


# --- graph

query("knn_graph", "SELECT src, dst, round(km, 4) AS km FROM v_edges")(_edges)
query("edge_list", "SELECT src, dst FROM v_edges")(lambda s, d: _edges(s, d).select("src", "dst"))
query(
    "graph_stats",
    "SELECT count(*) AS n_edges, round(count(*) / (m * (m - 1.0)), 4) AS density, round(count(*) / m, 4) AS edges_per_node FROM v_edges, (SELECT "
    "count(*)::DOUBLE AS m FROM v_points) GROUP BY m",
)(
    lambda s, d: G.graph_stats(_edges(s, d), views.points(s, d).count())
)
query(
    "sink_graph",
    "SELECT src, count(*) AS degree FROM v_edges GROUP BY 1",
)(
    lambda s, d: sinks.write_features(_edges(s, d).withColumn("part", F.col("src") % 4), scratch(s), "part")
        .groupBy("src")
        .agg(F.count("*").alias("degree"))
)
query(
    "neighbor_mean",
    "SELECT src, round(avg(lat), 4) AS neighbor_lat FROM v_edges JOIN v_points ON station_id = dst GROUP BY 1",
)(
    lambda s, d: G.neighbor_mean(_edges(s, d), views.points(s, d), ["lat"])
)
query(
    "gcn_propagate",
    "WITH g AS (SELECT p.station_id, coalesce(k.c, 0) + 1.0 AS deg, p.lat AS x FROM v_points p LEFT JOIN (SELECT src, count(*) AS c FROM v_edges "
    "GROUP BY 1) k ON k.src = p.station_id) SELECT a.station_id, round(coalesce(sum(b.x / sqrt(a.deg * b.deg)), 0) + a.x / a.deg, 4) AS lat_prop "
    "FROM g a LEFT JOIN v_edges e ON e.src = a.station_id LEFT JOIN g b ON b.station_id = e.dst GROUP BY a.station_id, a.x, a.deg",
)(
    lambda s, d: G.propagate(_edges(s, d), views.points(s, d), "lat")
)
query(
    "khop_neighbors",
    "SELECT src, dst, min(hops) AS hops FROM (SELECT src, dst, 1 AS hops FROM v_edges UNION ALL SELECT a.src, b.dst, 2 FROM v_edges a JOIN v_edges "
    "b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1, 2",
)(
    lambda s, d: G.reach(_edges(s, d), 2)
)

# --- forecasting

_SK = "SELECT event_id AS id, event_id % 7 - 3 AS delta, 0.5 + event_id % 5 AS up, 0.25 + event_id % 3 AS down FROM events"
_sk = lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7 - 3).alias("delta"), (0.5 + F.col("event_id") % 5).alias("up"), (0.25 + F.col("event_id") % 3).alias("down"))
query(
    "skellam_forecast",
    f"SELECT id, round(up - down, 4) AS net_mean, round(up + down, 4) AS net_var FROM ({_SK})",
)(
    lambda s, d: P.net_flow(_sk(s, d), "up", "down").select("id", "net_mean", "net_var")
)
query(
    "skellam_loglik",
    f"WITH x AS (SELECT DISTINCT delta, up, down FROM ({_SK})), l AS (SELECT delta, up, down, ln(sum(exp((j + greatest(delta, 0)) * ln(up) - up - "
    f"lgamma(j + greatest(delta, 0) + 1) + (j + greatest(-delta, 0)) * ln(down) - down - lgamma(j + greatest(-delta, 0) + 1)))) AS lp FROM x, "
    f"(SELECT unnest(range(80)) AS j) GROUP BY 1, 2, 3) SELECT round(sum(lp), 2) AS loglik FROM ({_SK}) JOIN l USING (delta, up, down)",
)(
    lambda s, d: _sk(s, d).withColumn("lp", E.skellam_logpmf(F.col("delta"), F.col("up"), F.col("down"))).agg(F.round(F.sum("lp"), 2).alias("loglik"))
)
query(
    "pit_calibration",
    "WITH p AS (SELECT doc_id % 4 AS fold, score AS pit FROM v_scores), r AS (SELECT fold, abs(pit - (row_number() OVER (PARTITION BY fold ORDER "
    "BY pit) - 1) / (count(*) OVER (PARTITION BY fold) - 1)::DOUBLE) AS gap FROM p) SELECT fold, round(max(gap), 4) AS max_gap FROM r GROUP BY 1",
)(
    lambda s, d: M.pit_gap(views.scores(s, d).select((F.col("doc_id") % 4).alias("fold"), F.col("score").alias("pit")), "fold", "pit")
)
query(
    "skellam_cdf",
    f"WITH x AS (SELECT DISTINCT delta, up, down FROM ({_SK})), j AS (SELECT unnest(range(80)) AS j), p AS (SELECT delta, up, down, i.j - k.j AS v, exp(i.j * ln(up) - up - lgamma(i.j + 1) + k.j * ln(down) - down - "
    f"lgamma(k.j + 1)) AS m FROM x, j i, j k WHERE i.j - k.j <= delta), c AS (SELECT delta, up, down, sum(m) AS below FROM p GROUP BY 1, 2, 3) SELECT id, round(below, 4) AS below FROM ({_SK}) JOIN c USING (delta, up, down)",
)(
    lambda s, d: _sk(s, d).select("id", E.skellam_cdf(F.col("delta"), F.col("up"), F.col("down")).alias("below"))
)
query(
    "skellam_pit",
    f"WITH x AS (SELECT DISTINCT delta, up, down FROM ({_SK})), j AS (SELECT unnest(range(80)) AS j), p AS (SELECT delta, up, down, i.j - k.j AS v, exp(i.j * ln(up) - up - lgamma(i.j + 1) + k.j * ln(down) - down - "
    f"lgamma(k.j + 1)) AS m FROM x, j i, j k WHERE i.j - k.j <= delta), c AS (SELECT delta, up, down, sum(m) AS pit FROM p GROUP BY 1, 2, 3), t AS (SELECT id % 3 AS fold, pit FROM ({_SK}) JOIN c USING (delta, up, down)), "
    f"r AS (SELECT fold, abs(pit - (row_number() OVER (PARTITION BY fold ORDER BY pit) - 1) / (count(*) OVER (PARTITION BY fold) - 1)::DOUBLE) AS gap FROM t) SELECT fold, round(max(gap), 4) AS max_gap FROM r GROUP BY 1",
)(
    lambda s, d: M.pit_gap(
        _sk(s, d).withColumn("pit", E.skellam_cdf(F.col("delta"), F.col("up"), F.col("down"))).withColumn("fold", F.col("id") % 3), "fold", "pit"
    )
)
query(
    "regression_metrics",
    "SELECT count(*) AS n, round(avg(power(y - score, 2)), 4) AS mse, round(sqrt(avg(power(y - score, 2))), 4) AS rmse, round(avg(abs(y - score)), "
    "4) AS mae, round(1 - sum(power(y - score, 2)) / (var_pop(y) * count(*)), 4) AS r2 FROM v_scores",
)(
    lambda s, d: M.regression_metrics(views.scores(s, d), "y", "score")
)
query(
    "classification_metrics",
    """WITH c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= 0.5 AND y <> 1) AS fp, count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND y <> 1) AS tn FROM v_scores),
m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS prec, tp / (tp + fn) AS rec FROM c),
a AS (SELECT avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auc FROM v_scores p, v_scores q WHERE p.y = 1 AND q.y <> 1)
SELECT round(accuracy, 4) AS accuracy, round(prec, 4) AS "precision", round(rec, 4) AS recall, round(auc, 4) AS auc, round(2 * prec * rec / (prec + rec), 4) AS f1 FROM m, a""",
)(
    lambda s, d: M.classification_metrics(views.scores(s, d), "y", "score")
)
query(
    "fold_summary",
    "SELECT round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std, count(*) AS n FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)",
)(
    lambda s, d: M.fold_summary(table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m")), "m")
)
query(
    "weighted_compare",
    "SELECT round(sum(m * n) / sum(n), 4) AS weighted_mae, round(sum(r * n) / sum(n), 4) AS weighted_rmse, round(avg(m), 4) AS mean_mae, "
    "round(avg(r), 4) AS mean_rmse, round(100 * (0.434 - sum(m * n) / sum(n)) / 0.434, 4) AS gain_mae_pct, round(100 * (0.994 - sum(r * n) / "
    "sum(n)) / 0.994, 4) AS gain_rmse_pct FROM (SELECT event_type, avg(value) / 100 AS m, stddev_pop(value) / 100 AS r, count(*) AS n FROM events "
    "GROUP BY 1)",
)(
    lambda s, d: M.weighted_compare(
        table(s, d, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("m"), (F.stddev_pop("value") / 100).alias("r"), F.count("*").alias("n")),
        "m", "r", "n", 0.434, 0.994
    )
)
query(
    "pinball_loss",
    "SELECT round(avg(greatest(0.9 * (y - score), -0.1 * (y - score))), 4) AS pinball FROM v_scores",
)(
    lambda s, d: M.pinball(views.scores(s, d), "y", "score", 0.9)
)
query(
    "compare_models",
    "SELECT 'score' AS model, round(avg(abs(y - score)), 4) AS mae FROM v_scores UNION ALL SELECT 'mean', round(avg(abs(y - m)), 4) FROM v_scores, "
    "(SELECT avg(y) AS m FROM v_scores)",
)(
    lambda s, d: M.regression_metrics(views.scores(s, d), "y", "score")
        .select(F.lit("score").alias("model"), "mae")
        .unionAll(M.regression_metrics((v := views.scores(s, d)).crossJoin(v.agg(F.avg("y").alias("m"))), "y", "m").select(F.lit("mean"), "mae"))
)


def _slots(s: SparkSession, d: str) -> DataFrame:
    """Each type's slots with what is known before them; arrivals are taken to be the next slot's count."""
    rows = dense(s, d).select("event_type", "ts_start", "n", *E.calendar("ts_start"), *W.lag_columns(["n"], "event_type", "ts_start", 48))
    return rows.withColumn("arr", F.lead("n", 1, 0).over(Window.partitionBy("event_type").orderBy("ts_start")))


def _train_test(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first four fifths of the time that the data cover, and the rest."""
    rows = _slots(s, d)
    lo, hi = rows.agg(F.min("ts_start"), F.max("ts_start")).first()
    cut = F.lit(lo + (hi - lo) * 0.8).cast("timestamp_ntz")
    return rows.where(F.col("ts_start") < cut), rows.where(F.col("ts_start") >= cut)


_FEATURES = ["hour_sin", "hour_cos", "is_weekend", "n_lag_1", "n_lag_2", "n_rolling_mean_24"]


@query("poisson_global")
def _poisson_global(s: SparkSession, d: str) -> DataFrame:
    """Departures and arrivals by one model each, over three expanding folds of slots, and the Skellam errors of their difference."""
    folded = W.folds(_slots(s, d), "event_type", "ts_start", 3)
    parts = []
    for fold in (1, 2, 3):
        train, test = (folded.where((F.col("fold") == fold) & (F.col("role") == role)) for role in ("train", "test"))
        for target in ("n", "arr"):
            test = P.poisson_global(train, test, _FEATURES, target)
        parts.append(test.select("event_type", "ts_start", "fold", "n", "arr", "n_mean", "arr_mean"))
    return P.skellam_baseline(parts[0].unionByName(parts[1]).unionByName(parts[2]), "arr", "n", "fold")


query(
    "poisson_per_station",
)(
    lambda s, d: P.skellam_baseline(
        P.poisson_pair_per_entity(W.folds(_slots(s, d), "event_type", "ts_start", 3), "event_type", "ts_start", _FEATURES, "arr", "n"), "arr", "n",
        "event_type", "fold"
    )
)
query("gbt_demand")(lambda s, d: P.gbt_forecast(*_train_test(s, d), _FEATURES, "n", 5)[0].select("event_type", "ts_start", "n", "prediction"))
query("top_features")(lambda s, d: P.gbt_forecast(*_train_test(s, d), _FEATURES, "n", 5)[1])
query(
    "activity_gate",
)(
    lambda s, d: P.activity_gate(*_train_test(s, d), _FEATURES, "n").select("event_type", "ts_start", "n", "p_active", "gated", "forecast")
)
query(
    "sink_predictions",
)(
    lambda s, d: sinks.write_features(
            P.poisson_global(*_train_test(s, d), _FEATURES, "n").select("event_type", "ts_start", "n", "n_mean"), scratch(s), "event_type"
        )
        .groupBy("event_type")
        .agg(F.count("*").alias("rows"), F.avg("n_mean").alias("mean"))
)

# --- the feature table of clusters

_GRID = "r AS (SELECT date_trunc('hour', min(dep_ts)) AS lo, date_trunc('hour', max(dep_ts)) + INTERVAL 1 hour AS hi FROM v_trips), g AS (SELECT cluster_id, ts_start FROM (SELECT DISTINCT cluster_id FROM v_map), (SELECT unnest(generate_series(lo, hi, INTERVAL 1 day)) AS ts_start FROM r))"
_SIDES = {f"{side}_{'internal' if inside else 'external'}": (side, inside) for side in ("dep", "arr") for inside in (True, False)}
_PART = ("count", "male", "female", "other", "young", "adult", "senior", "age_available", "model_iconic")
_ALL = [f"{p}_{c}" for p in _SIDES for c in _PART]
_TIMES = [f"dep_{k}_duration_{f}" for k in ("internal", "external") for f in ("mean", "std")]
_CELLS = ", ".join(f"{p}_t AS ({_cell_sql(*which)})" for p, which in _SIDES.items()) + f", {_GRID}, grid AS (SELECT cluster_id, ts_start, " + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _ALL) + ", " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _TIMES) + ", " + ", ".join(f"CAST(coalesce({p}_count, 0) > 0 AS INT) AS has_{p}" for p in _SIDES) + " FROM g " + " ".join(f"LEFT JOIN {p}_t USING (cluster_id, ts_start)" for p in _SIDES) + ")"
query("cluster_grid", f"WITH {_CELLS} SELECT * FROM grid")(cluster_grid)


def _history_sql(column: str, nudge: str = "") -> list[str]:
    """The twelve history columns of a measure; a grid of days has one slot a day."""
    w, out = "OVER (PARTITION BY cluster_id ORDER BY ts_start)", []
    out += [f"lag({column}, {n}, 0) {w} AS {column}_lag_{n}" for n in W.LAGS]
    for n in W.ROLLING:
        frame = f"OVER (PARTITION BY cluster_id ORDER BY ts_start ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out += [f"round(CASE WHEN count(*) {frame} = {n} THEN coalesce({f}({column}) {frame}, 0.0) ELSE 0.0 END{nudge}, 4) AS {column}_rolling_{x}_{n}" for x, f in (("mean", "avg"), ("std", "stddev_samp"))]
    out += [f"lag({column}, {k}, 0) {w} AS {column}_same_hour_{x}" for x, k in (("yesterday", 1), ("last_week", 7))]
    return [f"round({x}{nudge}, 4) AS {y}" if nudge and "duration" in column and "rolling" not in y else f"{x} AS {y}" for x, y in (o.rsplit(" AS ", 1) for o in out)]


_PRUNED = [c for c in W.LAGGED if "internal" not in c]
_CALENDAR_SQL = "CAST(hour(ts_start) AS INT) AS hour_of_day, CAST(isodow(ts_start) AS INT) AS day_of_week, CAST(month(ts_start) AS INT) AS month, CAST(year(ts_start) AS INT) AS year, " + ", ".join(f"round({f}(2 * pi() * {x} / {p}), 4) + 0.0 AS {n}_{f}" for n, x, p in (("hour", "hour(ts_start)", 24), ("dow", "isodow(ts_start)", 7), ("month", "month(ts_start)", 12)) for f in ("sin", "cos"))
_CALENDAR_SQL += ", CAST(isodow(ts_start) IN (6, 7) AS INT) AS is_weekend, CAST(hour(ts_start) BETWEEN 7 AND 9 AS INT) AS is_morning_rush, CAST(hour(ts_start) BETWEEN 17 AND 19 AS INT) AS is_evening_rush, CAST(hour(ts_start) BETWEEN 6 AND 22 AS INT) AS is_daytime, CAST(month(ts_start) IN (12, 1, 2) AS INT) AS is_summer, CAST(month(ts_start) BETWEEN 6 AND 8 AS INT) AS is_winter"
_SKIES = ("temperature_2m", "precipitation", "weather_code")
_SKY_CTE = f"""hourly AS (SELECT strftime(hour_ts, '%d %H') AS _hour, avg(temperature_2m) AS temperature_2m, avg(precipitation) AS precipitation, max(weather_code) AS weather_code, max(is_raining) AS is_raining FROM v_weather GROUP BY 1),
wl AS (SELECT l.*, h.* FROM v_lab l LEFT JOIN hourly h ON h._hour = strftime(dep_ts, '%d %H')),
city AS (SELECT time_bucket(INTERVAL 1 day, dep_ts) AS ts_start, {", ".join(f"avg({c}) AS {c}" for c in _SKIES)}, CAST(round(avg(is_raining)) AS INT) AS is_raining, 1 AS there FROM wl GROUP BY 1),
c AS (SELECT cluster_id, avg(station_id) AS cluster_centroid_lat, avg(-station_id) AS cluster_centroid_lon, count(*) AS cluster_station_count FROM v_map GROUP BY 1)"""
_CITY = ", ".join(f"round(coalesce(city.{c}, 0.0), 4) AS {c}_mean" for c in _SKIES) + ", coalesce(city.is_raining, 0) AS is_raining"


def _sky_sql(side: str) -> str:
    """The weather of a cell's trips, inside and across clusters."""
    cluster, ts = ("origin_cluster", "dep_ts") if side == "dep" else ("dest_cluster", "coalesce(arr_ts, dep_ts)")
    parts = [f"avg({c}) FILTER (WHERE {w}) AS {side}_{k}_{c}_mean" for k, w in (("internal", "is_internal"), ("external", "NOT is_internal")) for c in _SKIES]
    parts += [f"sum(is_raining) FILTER (WHERE {w}) AS {side}_{k}_is_raining_count" for k, w in (("internal", "is_internal"), ("external", "NOT is_internal"))]
    return f"SELECT {cluster} AS cluster_id, time_bucket(INTERVAL 1 day, {ts}) AS ts_start, {', '.join(parts)} FROM wl GROUP BY 1, 2"


_OWN_SKY = ", ".join([f"round(coalesce({p}_{c}_mean, 0.0), 4) AS {p}_{c}_mean" for p in _SIDES for c in _SKIES] + [f"CAST(coalesce({p}_is_raining_count, 0) AS BIGINT) AS {p}_is_raining_count" for p in _SIDES])
_REACH_BACK = ", ".join(f"CAST(lag(dep_internal_count, {n}, 0) OVER (PARTITION BY cluster_id ORDER BY ts_start) > 0 AS INT) AS has_{x}_lags" for x, n in (("short_term", 1), ("daily", 1), ("weekly", 7)))


def _even(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Doubles to four places without a negative 0; a nudge makes averages halfway between two places go up in every engine."""
    return df.select(*((F.round(F.col(c) + nudge, 4) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


_RAW = _CELLS
for _p, _which in _SIDES.items():
    _RAW = _RAW.replace(_cell_sql(*_which), _cell_sql(*_which, digits=False))
_UP = " + 1e-7"
_CENTER_UP = f"round(cluster_centroid_lat{_UP}, 4) AS cluster_centroid_lat, round(cluster_centroid_lon{_UP}, 4) AS cluster_centroid_lon, cluster_station_count"
query(
    "feature_table",
    f"WITH {_RAW}, {_SKY_CTE}, dep_sky AS ({_sky_sql('dep')}), arr_sky AS ({_sky_sql('arr')}) SELECT cluster_id, ts_start, {', '.join(f'grid.{c}' for c in [*_ALL, *(f'has_{p}' for p in _SIDES)])}, "
    f"{', '.join(f'round(grid.{c}{_UP}, 4) AS {c}' for c in _TIMES)}, {_OWN_SKY.replace(', 0.0), 4)', f', 0.0){_UP}, 4)')}, {_CENTER_UP}, "
    f"{_CITY.replace(', 0.0), 4)', f', 0.0){_UP}, 4)')}, coalesce(city.there, 0) AS weather_data_available, "
    f"{_CALENDAR_SQL.replace('), 4)', f'){_UP}, 4)')}, {', '.join(x for c in W.LAGGED for x in _history_sql(c, _UP))}, {_REACH_BACK} FROM grid JOIN c USING (cluster_id) "
    f"LEFT JOIN city USING (ts_start) LEFT JOIN dep_sky USING (cluster_id, ts_start) LEFT JOIN arr_sky USING (cluster_id, ts_start)",
    exact=True,
)(
    lambda s, d: _even(feature_table(s, d), 1e-7)
)
query(
    "prune_leakage",
    f"WITH {_CELLS}, {_SKY_CTE} SELECT cluster_id, ts_start, {_CENTER_UP}, {_CITY.replace(', 0.0), 4)', f', 0.0){_UP}, 4)')}, {_CALENDAR_SQL.replace('), 4)', f'){_UP}, 4)')}, "
    f"{', '.join(x for c in _PRUNED for x in _history_sql(c, _UP))} FROM grid JOIN c USING (cluster_id) LEFT JOIN city USING (ts_start)",
    exact=True,
)(
    lambda s, d: _even(W.prune_leakage(feature_table(s, d)), 1e-7)
)
query(
    "select_targets",
    "WITH a AS (" + _cell_sql("dep", False)
    + ") SELECT cluster_id, ts_start, dep_external_count, dep_external_male, dep_external_female, dep_external_young, dep_external_adult, "
      "dep_external_senior FROM a",
)(
    lambda s, d: W.select_targets(C.cells(labelled(s, d), "dep", DAY), "all", ["cluster_id", "ts_start"])
)

# --- streaming


#: Micro-batches of the live queries, and those between two stops.
_RUNS = ((0, 1, 2), (3, 4, 5))


def _arrivals(s: SparkSession, d: str) -> DataFrame:
    """The events as they come in: five days a batch, every twentieth event one batch late, every thirtieth twice."""
    batch = F.least(F.lit(5), F.floor((F.dayofmonth("ts") - 1) / 5).cast("int") + E.flag(F.col("event_id") % 20 == 0))
    return table(s, d, "events").withColumn("batch", batch).withColumn("_n", F.explode(F.sequence(F.lit(0), E.flag(F.col("event_id") % 30 == 0)))).drop("_n")


_LATE = """a AS (SELECT *, least(5, (day(ts) - 1) // 5 + CAST(event_id % 20 = 0 AS INT)) AS batch FROM events),
b AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS batch), m AS (SELECT b.batch, date_trunc('millisecond', max(a.ts)) AS seen FROM b LEFT JOIN a ON a.batch <= CASE WHEN b.batch = 3 THEN 2 ELSE b.batch - 2 END GROUP BY 1),
fed AS (SELECT a.*, seen, date_trunc('millisecond', max(ts) OVER ()) AS last FROM (SELECT * FROM a UNION ALL SELECT * FROM a WHERE event_id % 30 = 0) a JOIN m USING (batch))"""


def _live(name: str, build, sql: str) -> None:
    """Registers a stream of several batches, stopped and restarted midway, against SQL that drops the rows that came late and shows the slots that the last watermark closed."""

    def run(s: SparkSession, d: str) -> DataFrame:
        return slots.in_runs(_arrivals(s, d), "batch", _RUNS, lambda stream: build(s, d, stream), scratch(s))

    query(name, sql)(run)


def _closed(width: str, late: str) -> str:
    """Slots of a width that were open as their row came, and that the end has closed."""
    return f"(seen IS NULL OR ts_start + INTERVAL {width} > seen - INTERVAL {late}) AND ts_start + INTERVAL {width} <= last - INTERVAL {late}"


_live(
    "stream_slot_counts",
    lambda s, d, stream: slots.slot_counts(stream, "ts", "event_type"),
    f"WITH {_LATE} SELECT ts_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 30 minute, ts) AS ts_start "
    f"FROM fed) WHERE {_closed('30 minute', '10 minute')} GROUP BY 1, 2",
)
_live(
    "stream_sliding",
    lambda s, d, stream: slots.slot_counts(stream, "ts", "event_type", "2 hours", "10 minutes", "30 minutes"),
    f"WITH {_LATE} SELECT ts_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 30 minute, ts) - k * INTERVAL "
    f"30 minute AS ts_start FROM fed, (SELECT unnest([0, 1, 2, 3]) AS k)) WHERE {_closed('2 hour', '10 minute')} GROUP BY 1, 2",
)
_live(
    "stream_dedup",
    lambda s, d, stream: slots.dedup(stream, "ts", ["event_id"]).select("event_id", "event_type"),
    f"WITH {_LATE} SELECT DISTINCT event_id, event_type FROM fed WHERE seen IS NULL OR ts > seen - INTERVAL 10 minute",
)
_live(
    "stream_od_counts",
    lambda s, d, stream: slots.od_counts(
        stream.select("ts", (F.col("user_id") % 25).cast("int").alias("origin_station_id"), (F.col("event_id") % 25).cast("int").alias("dest_station_id"), F.lit("FIT").alias("bike_model")),
        views.station_cluster(s, d), "ts"
    ),
    f"WITH {_LATE}, t AS (SELECT time_bucket(INTERVAL 1 day, ts) AS ts_start, seen, last, coalesce(o.cluster_id, -1) AS oc, coalesce(p.cluster_id, -1) AS dc FROM fed "
    f"e LEFT JOIN v_map o ON o.station_id = e.user_id % 25 LEFT JOIN v_map p ON p.station_id = e.event_id % 25) SELECT ts_start, oc AS "
    f"origin_cluster, count(*) FILTER (WHERE oc = dc AND oc <> -1) AS n_internal, count(*) FILTER (WHERE NOT (oc = dc AND oc <> -1)) AS n_external "
    f"FROM t WHERE {_closed('1 day', '1 day')} GROUP BY 1, 2",
)


@query(
    "stream_lags",
    f"WITH {_LATE}, c AS (SELECT event_type, ts_start, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 30 minute, ts) AS ts_start FROM fed) WHERE {_closed('30 minute', '10 minute')} GROUP BY 1, 2), "
    f"g AS (SELECT event_type, ts_start FROM (SELECT DISTINCT event_type FROM c), (SELECT unnest(generate_series(min(ts_start), max(ts_start), INTERVAL 30 minute)) AS ts_start FROM c)), "
    f"e AS (SELECT event_type, ts_start, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (event_type, ts_start)) "
    f"SELECT event_type, ts_start, n, {', '.join(f'lag(n, {k}, 0) {_W} AS n_lag_{k}' for k in (1, 48, 336))} FROM e",
)
def _stream_lags(s: SparkSession, d: str) -> DataFrame:
    """Lags of a table of closed slots that a stream keeps in six batches and two runs; the second batch fails once it is written, and is run again."""
    at, failed = scratch(s), []
    put = slots.put(f"{at}/slots")

    def sink(rows: DataFrame, number: int) -> None:
        put(rows, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the batch was written and before that was noted")

    rows = _arrivals(s, d)
    for run in _RUNS:
        slots.arrive(rows, f"{at}/in", "batch", run)
        counted = slots.slot_counts(slots.watch(s, f"{at}/in", rows.drop("batch").schema), "ts", "event_type")
        slots.keep(counted, sink, f"{at}/check")
    return slots.slot_lags(slots.closed_slots(s, f"{at}/slots", counted.schema, ["event_type", "ts_start"]), "event_type", "n", (1, 48, 336))
