"""Cells: trips of a cluster and slot, inside and across clusters, in one aggregation each side; the dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import AGE_BINS, slot


def _counts(prefix: str, inside: Column, durations: bool, means: list[str], flags: list[str]) -> list[Column]:
    c = lambda cond: F.count_if(inside & cond)
    out = [F.count_if(inside).alias(f"{prefix}_count")]
    out += [c(F.col("gender") == g.upper()).alias(f"{prefix}_{g}") for g in ("male", "female", "other")]
    out += [c(F.col("user_age").between(*b)).alias(f"{prefix}_{name}") for name, b in AGE_BINS.items()]
    out += [c(F.col("user_age").isNotNull()).alias(f"{prefix}_age_available"), c(F.col("bike_model") == "ICONIC").alias(f"{prefix}_model_iconic")]
    if durations:
        own = F.when(inside, F.col("duration_s"))
        out += [F.coalesce(F.avg(own), F.lit(0.0)).alias(f"{prefix}_duration_mean"), F.coalesce(F.stddev_samp(own), F.lit(0.0)).alias(f"{prefix}_duration_std")]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out += [zero(F.avg(F.when(inside, F.col(c)))).alias(f"{prefix}_{c}_mean") for c in means]
    return out + [F.coalesce(F.sum(F.when(inside, F.col(c).cast("int"))), F.lit(0)).alias(f"{prefix}_{c}_count") for c in flags]


def cells(trips: DataFrame, side: str, width: str, means: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """``side`` is dep (by origin and departure) or arr (by destination and arrival, or departure where that is absent).

    ``means`` and ``flags`` are weather columns; those that ``trips`` lacks are left out.

    Internal and external measures come from one conditional aggregation, so no
    outer join can lose a cell that only one of them has.
    """
    cluster, ts = ("origin_cluster", F.col("dep_ts")) if side == "dep" else ("dest_cluster", F.coalesce("arr_ts", "dep_ts") if "arr_ts" in trips.columns else F.col("dep_ts"))
    means, flags = ([c for c in names if c in trips.columns] for names in (means, flags))
    measures = [m for kind in ("internal", "external") for m in _counts(f"{side}_{kind}", F.col(f"is_{kind}"), side == "dep", means, flags)]
    grouped = trips.groupBy(F.col(cluster).alias("cluster_id"), slot(ts, width).alias("ts_start")).agg(*measures)
    return grouped.withColumns({f"has_{side}_{k}": (F.col(f"{side}_{k}_count") > 0).cast("int") for k in ("internal", "external")})


def cell_weather(rows: DataFrame, keys: list, means: list[str], sums: list[str]) -> DataFrame:
    """Means and sums of whichever weather columns there are."""
    have = set(rows.columns)
    return rows.groupBy(*keys).agg(*(F.avg(c).alias(f"{c}_mean") for c in means if c in have), *(F.sum(F.col(c).cast("int")).alias(f"{c}_sum") for c in sums if c in have))


def slot_weather(rows: DataFrame, ts: str, means: list[str], flags: list[str], width: str) -> DataFrame:
    """City-wide means of a slot; a flag holds if at least half of the rows have it."""
    return rows.groupBy(slot(ts, width).alias("ts_start")).agg(*(F.avg(c).alias(c) for c in means), *(F.round(F.avg(F.col(c).cast("int"))).cast("int").alias(c) for c in flags))


def skeleton(entities: DataFrame, events: DataFrame, ts: str, width: str, *also: str) -> DataFrame:
    """Every entity at every slot from the first hour to an hour past the last, both ends included.

    The range is that of ``ts``; with further time columns in ``also``, of all of
    them, so that late arrivals find a slot. It is one row; the slots are exploded on the executors and met by the
    entities, of which there is one row each.
    """
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    low, high = (F.least, F.greatest) if also else (lambda c: c,) * 2
    span = events.agg(hour(low(*(F.min(c) for c in (ts, *also)))).alias("lo"), (hour(high(*(F.max(c) for c in (ts, *also)))) + F.expr("INTERVAL 1 HOUR")).alias("hi"))
    slots = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {width}"))).alias("ts_start"))
    return entities.crossJoin(slots)


def densify(grid: DataFrame, keys: list[str], *sides: DataFrame) -> DataFrame:
    """The grid with each side's measures, 0 where a cell is empty."""
    for side in sides:
        grid = grid.join(side, keys, "left")
    return grid.na.fill(0, [c for c in grid.columns if c not in keys])
