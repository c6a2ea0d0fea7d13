"""Trip-shaped views over the given tables, as DataFrames and as SQL of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trip; station is the nation, times are days."""
    line, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    gender = F.when(F.col("c_mktsegment") == "BUILDING", "MALE").when(F.col("c_mktsegment") == "HOUSEHOLD", "FEMALE").when(F.col("c_mktsegment") == "MACHINERY", "OTHER")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("o_custkey").cast("long").alias("user_id"),
        F.col("s_nationkey").cast("int").alias("origin_station_id"), F.col("c_nationkey").cast("int").alias("dest_station_id"),
        F.col("o_orderdate").alias("dep_ts"), F.col("l_shipdate").alias("arr_ts"), (F.col("l_quantity") * 60.0).alias("duration_s"),
        gender.alias("gender"), F.when(F.col("l_returnflag") == "R", "ICONIC").otherwise("FIT").alias("bike_model"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 0)
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("gender_full"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 90).cast("int")).alias("user_age"))


def station_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("station_id"), F.col("n_regionkey").alias("cluster_id"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    by_hour = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"))
    return by_hour.agg(
        F.avg("value").alias("temperature_2m"), F.avg(F.when(error, F.col("value")).otherwise(0.0)).alias("precipitation"),
        F.max(F.when(error & (F.col("value") > 100), 1).otherwise(0)).alias("is_raining"), (F.max("user_id") % 4).cast("int").alias("weather_code"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("station_id"), (e[0].cast("double") * 0.1 - 34.6).alias("lat"), (e[1].cast("double") * 0.1 - 58.4).alias("lon"), F.col("label").alias("cluster_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101).cast("double") / 101.0).alias("score"))


#: SQL of the same views, by name.
SQL = {
    "v_trips": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(o_custkey AS BIGINT) AS user_id,
  CAST(s_nationkey AS INT) AS origin_station_id, CAST(c_nationkey AS INT) AS dest_station_id, o_orderdate AS dep_ts, l_shipdate AS arr_ts, l_quantity * 60.0 AS duration_s,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'MALE' WHEN 'HOUSEHOLD' THEN 'FEMALE' WHEN 'MACHINERY' THEN 'OTHER' END AS gender,
  CASE WHEN l_returnflag = 'R' THEN 'ICONIC' ELSE 'FIT' END AS bike_model
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_users": """SELECT c_custkey AS user_id, c_mktsegment AS gender_full, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS INT) END AS user_age FROM customer WHERE c_custkey % 10 <> 0""",
    "v_map": "SELECT n_nationkey AS station_id, n_regionkey AS cluster_id FROM nation WHERE n_regionkey <> 4",
    "v_weather": """SELECT date_trunc('hour', ts) AS hour_ts, avg(value) AS temperature_2m, avg(CASE WHEN event_type = 'error' THEN value ELSE 0.0 END) AS precipitation,
  max(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END) AS is_raining, CAST(max(user_id) % 4 AS INT) AS weather_code FROM events GROUP BY 1""",
    "v_points": "SELECT vec_id AS station_id, CAST(embedding[1] AS DOUBLE) * 0.1 - 34.6 AS lat, CAST(embedding[2] AS DOUBLE) * 0.1 - 58.4 AS lon, label AS cluster_id FROM embeddings",
    "v_scores": "SELECT doc_id, quality AS y, CAST((doc_id * 37) % 101 AS DOUBLE) / 101.0 AS score FROM labels",
    "v_lab": """SELECT t.*, u.user_age, u.gender_full, coalesce(o.cluster_id, -1) AS origin_cluster, coalesce(d.cluster_id, -1) AS dest_cluster,
  coalesce(o.cluster_id, -1) = coalesce(d.cluster_id, -1) AND coalesce(o.cluster_id, -1) <> -1 AS is_internal
  FROM v_trips t LEFT JOIN v_map o ON t.origin_station_id = o.station_id LEFT JOIN v_map d ON t.dest_station_id = d.station_id LEFT JOIN v_users u ON t.user_id = u.user_id""",
    "v_slots": "SELECT event_type, time_bucket(INTERVAL 30 minute, ts) AS ts_start, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2",
    "v_range": "SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) + INTERVAL 1 hour AS hi FROM events",
    "v_dense": """SELECT e.event_type, s.ts_start, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT event_type FROM events) e
  CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 30 minute)) AS ts_start FROM v_range) s LEFT JOIN v_slots USING (event_type, ts_start)""",
    "v_pairs": """SELECT a.station_id AS src, b.station_id AS dst, 2 * 6371.0 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) AS km
  FROM v_points a JOIN v_points b ON a.station_id <> b.station_id""",
    "v_knn": "SELECT src, dst, km FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rn FROM v_pairs) WHERE rn <= 5 AND km <= 5.0",
    "v_edges": "SELECT src, dst, min(km) AS km FROM (SELECT src, dst, km FROM v_knn UNION ALL SELECT dst, src, km FROM v_knn) GROUP BY 1, 2",
}
_NEEDS = {"v_lab": ("v_trips", "v_map", "v_users"), "v_dense": ("v_slots", "v_range"), "v_pairs": ("v_points",), "v_knn": ("v_pairs",), "v_edges": ("v_knn",)}


def with_views(query: str) -> str:
    """The query with the views it names as common table expressions."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            want(other)
        if name not in wanted:
            wanted.append(name)

    for name in SQL:
        if name in query:
            want(name)
    if not wanted:
        return query
    ctes = ", ".join(f"{name} AS ({SQL[name]})" for name in wanted)
    return query.replace("WITH ", f"WITH {ctes}, ", 1) if query.lstrip().startswith("WITH ") else f"WITH {ctes} {query}"
