"""Live slot counts: the batch expressions under a watermark, over many micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import cells as C
from ..operators import features as W


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def slot_counts(stream: DataFrame, ts: str, entity: str, width: str = "30 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = timed(stream, ts, late).groupBy(window.alias("w"), entity).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("ts_start"), entity, "n", "total")


def od_counts(stream: DataFrame, stations: DataFrame, ts: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Internal and external departures of a trip stream; the station map is a static dimension."""
    from ..operators.trips import classify, map_clusters

    labelled = classify(map_clusters(timed(stream, ts, late), stations))
    counted = labelled.groupBy(F.window(ts, width).alias("w"), "origin_cluster").agg(F.count_if("is_internal").alias("n_internal"), F.count_if("is_external").alias("n_external"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("ts_start"), "origin_cluster", "n_internal", "n_external")


def dedup(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def arrive(rows: DataFrame, path: str, batch: str, numbers: Iterable[int], files: int = 1) -> None:
    """Write each numbered batch of the rows into the folder that a stream watches, ``files`` files a batch, one batch after another."""
    for number in numbers:
        own = rows.where(F.col(batch) == number).drop(batch)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)


def watch(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """The folder as a stream, ``files`` files a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, append it to ``path``, and read that. Called again with the same checkpoint, it goes on with its state and watermark."""
    result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


def in_runs(rows: DataFrame, batch: str, runs: Iterable[Iterable[int]], build: Callable[[DataFrame], DataFrame], at: str) -> DataFrame:
    """The result of a stream that gets the rows in numbered batches and is stopped and started again after each run of them.

    A row is dropped as late if the watermark had passed its slot's end (for
    ``dedup``: its time) one micro-batch earlier, or before the stop if its batch
    is a run's first.
    """
    spark, schema = rows.sparkSession, rows.drop(batch).schema
    for run in runs:
        arrive(rows, f"{at}/in", batch, run)
        out = drain(build(watch(spark, f"{at}/in", schema)), f"{at}/out", f"{at}/check")
    return out


# --- a table of closed slots


def put(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a batch's rows are the partition of its number, so a batch that is run again replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def keep(result: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, retries: int = 1) -> None:
    """Run a stream of closed slots into a sink; a failed query is started again from its checkpoint, where its last batch is run anew."""
    while True:
        query = result.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            return query.awaitTermination()
        except StreamingQueryException:
            if not retries:
                raise
            retries -= 1


def closed_slots(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The table that ``put`` keeps, one row for each key: that of the latest batch, should several have it."""
    rows = spark.read.schema(StructType([*schema, StructField("batch", IntegerType())])).parquet(path)
    latest = F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch"))), "batch")
    return rows.groupBy(*keys).agg(latest.alias("_l")).select(*keys, "_l.*")


def slot_lags(slots: DataFrame, entity: str, value: str, lags: Iterable[int], width: str = "30 minutes") -> DataFrame:
    """Lags of closed slots on the dense grid from the first to the last of them, 0 where there is none; an entity without any has no rows."""
    span = slots.agg(F.min("ts_start").alias("lo"), F.max("ts_start").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {width}"))).alias("ts_start"))
    grid = C.densify(slots.select(entity).distinct().crossJoin(every), [entity, "ts_start"], slots.select(entity, "ts_start", value))
    return grid.select(entity, "ts_start", value, *W.lag_columns([value], entity, "ts_start", 1, lags=tuple(lags), rolling=(), seasonal=()))
