"""Trip enrichment: user and weather joins, quality flags, origin-destination classes, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import AGE_BINS, flag, slot
from ..sources.sinks import cut


def dedup_users(users: DataFrame) -> DataFrame:
    """One row per user, the least by all columns, so that the join can't fan out."""
    return users.groupBy("user_id").agg(F.min(F.struct(*[c for c in users.columns if c != "user_id"])).alias("u")).select("user_id", "u.*")


def join_users(trips: DataFrame, users: DataFrame) -> DataFrame:
    joined = trips.join(dedup_users(users), "user_id", "left")
    return joined.withColumns({"user_matched": F.col("gender_full").isNotNull(), "age_available": F.col("user_age").isNotNull()})


def join_weather(trips: DataFrame, weather: DataFrame, ts: str) -> DataFrame:
    """Hourly weather by the hour of ``ts``; an equi-join that Spark broadcasts if the hourly table is small."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    marked = weather.withColumn("weather_matched", F.lit(True))
    joined = trips.withColumn("hour_ts", hour).join(marked, "hour_ts", "left")
    return joined.withColumn("weather_matched", F.coalesce("weather_matched", F.lit(False)))


def map_clusters(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Cluster of origin and destination; -1 for stations that are null or unknown."""
    of = lambda side: stations.select(F.col("station_id").alias(f"{side}_station_id"), F.col("cluster_id").alias(f"{side}_cluster"))
    joined = trips.join(of("origin"), "origin_station_id", "left").join(of("dest"), "dest_station_id", "left")
    return joined.na.fill(-1, ["origin_cluster", "dest_cluster"])


def classify(trips: DataFrame) -> DataFrame:
    """Internal trips stay in a known cluster; ghost is an alias of internal; trips at an unknown station are external."""
    inside = (F.col("origin_cluster") == F.col("dest_cluster")) & (F.col("origin_cluster") != -1)
    unmapped = (F.col("origin_cluster") == -1) | (F.col("dest_cluster") == -1)
    return trips.withColumns({"is_internal": inside, "is_external": ~inside, "is_ghost": inside, "is_unmapped": unmapped, "is_iconic": flag(F.col("bike_model") == "ICONIC")})


def split_temporal(df: DataFrame, ts: str, validate_from: str, test_from: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return df.withColumn("split", F.when(F.col(ts) < day(validate_from), "train").when(F.col(ts) < day(test_from), "val").otherwise("test"))


def check_no_leakage(df: DataFrame, ts: str) -> DataFrame:
    """Bounds of each split; raises if an earlier split reaches into a later one. Empty splits are passed over."""
    bounds = df.groupBy("split").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    by_name = {row.split: row for row in bounds.collect()}  # three rows at most
    present = [by_name[s] for s in ("train", "val", "test") if s in by_name]
    for a, b in zip(present, present[1:]):
        if a.last_ts >= b.first_ts:
            raise ValueError(f"{a.split} reaches into {b.split}")
    return bounds


def hundredth(key: Column, seed: int | None = None) -> Column:
    """0..99, stable for a key whatever the partitioning: by a seeded hash, or without a seed by the number itself."""
    return F.pmod(key, F.lit(100)) if seed is None else F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100))


def sample_rows(df: DataFrame, key: Column, per_cent: int, seed: int | None = None) -> DataFrame:
    """About that share of the rows, the same ones each time."""
    return df.where(hundredth(key, seed) < per_cent)


#: Bands that a hash is counted in at once, and rows of a band that the driver takes the hashes of.
BANDS, FEW = 4_096, 10_000


def sample_exactly(df: DataFrame, n: int, hashed: Column) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those with the least ``hashed``, a long of 0 to 2**60; the same ones for any partitioning.

    The hash of the last row is found by counting bands of hashes, finer ones each
    time, so nothing is sorted. Of the rows that share it, the least by all columns
    are taken, and rows that are equal in all columns stand for one another.
    """
    columns, h = df.columns, F.col("_hash")
    marked = df.withColumn("_hash", hashed)
    left, low, width, threshold = n, 0, 2**60, None
    while threshold is None and n > 0:
        inside = marked.where((h >= low) & (h < low + width)).select("_hash")
        width = max(1, width // BANDS)
        bands = sorted(inside.groupBy(F.floor((h - low) / width).cast("long").alias("band")).count().collect())
        for band, count in bands:
            if left <= count:
                break
            left -= count
        else:
            return df  # fewer than n rows
        low += band * width
        if width == 1:
            threshold = low
        elif count <= FEW:
            found = sorted(r[0] for r in marked.where((h >= low) & (h < low + width)).select("_hash").collect())
            threshold = found[left - 1]
            left -= sum(x < threshold for x in found)
    if threshold is None:
        return df.where("false")
    counted = marked.where(h == threshold).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = counted.withColumn("_n", F.least("_n", F.lit(left) - before)).where("_n > 0")  # the different rows of one hash
    last = taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*columns)
    return marked.where(h < threshold).select(*columns).unionByName(last)


def seeded_hash(seed: int, *keys: Column) -> Column:
    """A long of 0 to 2**60 from the keys' text: the first fifteen hex digits of an MD5, which other engines agree on."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def guard_targets(df: DataFrame, entity: str, target: str, most: float = 10_000.0) -> DataFrame:
    """Which series hold a target beyond what is credible."""
    return df.groupBy(entity).agg((F.max(target) > most).alias("rejected"))


def split_hash(df: DataFrame, key: Column, shares=(60, 20), seed: int | None = None) -> DataFrame:
    """60/20/20 by ``hundredth``."""
    at = hundredth(key, seed)
    return df.withColumn("split", F.when(at < shares[0], "train").when(at < sum(shares), "val").otherwise("test"))


def mark_holidays(df: DataFrame, holidays: DataFrame, ts: str) -> DataFrame:
    """Adds ``is_holiday`` from a table of ``date``; dates that it repeats count once."""
    days = holidays.select(F.col("date").alias("_date")).distinct()
    return df.join(days, F.to_date(ts) == F.col("_date"), "left").withColumn("is_holiday", flag(F.col("_date").isNotNull())).drop("_date")


def class_stats(trips: DataFrame) -> DataFrame:
    n = F.count("*")
    out = [n.alias("n_trips")]
    for name, c in {"internal": F.col("is_internal"), "external": F.col("is_external"), "ghost": F.col("is_ghost"), "unmapped": F.col("is_unmapped"), "iconic": F.col("is_iconic") == 1}.items():
        out += [F.count_if(c).alias(f"n_{name}"), F.round(100.0 * F.count_if(c) / n, 4).alias(f"pct_{name}")]
    return trips.agg(*out)


def age_stats(trips: DataFrame) -> DataFrame:
    return trips.agg(*(F.count_if(F.col("user_age").between(*b)).alias(f"n_{name}") for name, b in AGE_BINS.items()), F.count_if(F.col("user_age").isNotNull()).alias("n_known"))


def station_dim(trips: DataFrame, coords: DataFrame) -> DataFrame:
    """Stations at either end, one row per id, with coordinates; those without are dropped."""
    both = trips.select(F.col("origin_station_id").alias("station_id")).unionByName(trips.select(F.col("dest_station_id").alias("station_id")))
    ids = both.where(F.col("station_id").isNotNull()).groupBy("station_id").agg(F.count("*").alias("n_ends"))
    return ids.join(coords.where("lat IS NOT NULL AND lon IS NOT NULL"), "station_id")


def station_activity(trips: DataFrame) -> DataFrame:
    """Departures, arrivals and their sum for each station, in one shuffle."""
    ends = trips.select(F.explode(F.array(F.struct(F.col("origin_station_id").alias("station_id"), F.lit(1).alias("o")), F.struct(F.col("dest_station_id").alias("station_id"), F.lit(0).alias("o")))).alias("e"))
    return ends.where("e.station_id IS NOT NULL").groupBy(F.col("e.station_id").alias("station_id")).agg(F.sum("e.o").alias("n_dep"), F.sum(1 - F.col("e.o")).alias("n_arr"), F.count("*").alias("n_total"))


def station_slots(trips: DataFrame, width: str) -> DataFrame:
    """Departures and arrivals of each station and slot, in one shuffle: ``station_id, ts_start``, both counts, and the departures' mean duration, bike models and gender shares.

    A departure counts in the slot it leaves in, an arrival in the one it arrives
    in. Shares and duration are null in a slot without departures; riders of
    unknown gender are in no share.
    """
    end = lambda side, ts, o: F.struct(F.col(f"{side}_station_id").alias("station_id"), F.col(ts).alias("ts"), F.lit(o).alias("o"))
    ends = trips.select("duration_s", "bike_model", "gender", F.explode(F.array(end("origin", "dep_ts", 1), end("dest", "arr_ts", 0))).alias("e"))
    ends = ends.where("e.station_id IS NOT NULL AND e.ts IS NOT NULL")
    left = F.col("e.o") == 1
    counts = [F.count_if(left).alias("dep_last_dt"), F.count_if(~left).alias("arr_last_dt"), F.avg(F.when(left, F.col("duration_s"))).alias("trip_dur_mean_last_dt")]
    counts += [F.count_if(left & (F.col("bike_model") == m)).alias(f"model_{m.lower()}_cnt") for m in ("FIT", "ICONIC")]
    shares = [F.try_divide(F.count_if(left & (F.col("gender") == g.upper())), F.count_if(left)).alias(f"share_{g}") for g in ("male", "female", "other")]
    return ends.groupBy(F.col("e.station_id").alias("station_id"), slot(F.col("e.ts"), width).alias("ts_start")).agg(*counts, *shares)


def first_by(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """0-based index over the distinct keys in their order; ranges of keys are numbered apart, on top of how many keys come before."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranged = cut(ids.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + F.col("before")
    return ranged.join(F.broadcast(sizes.select("_range", before.alias("before"))), "_range").select(key, at.cast("int").alias("idx"))
