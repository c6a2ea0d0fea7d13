"""Sinks that keep a run's results, each returning what it wrote, read back."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names, or in the warehouse where it names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidegrid-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again, which cuts its lineage."""
    df.write.parquet(path := scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed_cut(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``cut``, with aggregates of the frame that the writing job takes along, so that no second one is run for them."""
    seen = Observation()
    made = cut(df.observe(seen, *(c.alias(name) for name, c in measures.items())))
    return made, seen.get


def write_with_metadata(df: DataFrame, path: str, stage: str, parameters: dict, centroids: DataFrame | None = None) -> DataFrame:
    """Write a stage's rows to ``path/data`` and what it was to ``path/run``, and return the latter: ``stage, parameters, n_rows, n_columns, columns, centroids``.

    The rows are counted by the job that writes them. Centroids (``cluster_id, lat,
    lon, station_count``) are one row a cluster, and kept as an array.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/data")
    fixed = {"stage": stage, "parameters": json.dumps(parameters, sort_keys=True), "n_rows": seen.get["n"], "n_columns": len(df.columns), "columns": ",".join(df.columns)}
    kinds = "cluster_id long, lat double, lon double, station_count long"
    rows = [] if centroids is None else [tuple(r) for r in centroids.select("cluster_id", "lat", "lon", "station_count").orderBy("cluster_id").collect()]
    made = df.sparkSession.createDataFrame([(*fixed.values(), rows)], f"stage string, parameters string, n_rows long, n_columns int, columns string, centroids array<struct<{kinds}>>")
    return write_json(made, f"{path}/run")


def sorted_table(df: DataFrame, by: list[str], order: list[str], buckets: int = 8) -> DataFrame:
    """The frame as a table in ``buckets`` files by the hash of ``by``, each sorted by ``by`` and ``order``.

    A window over ``by`` in that order, or a join on ``by`` with a table made alike,
    then needs neither a shuffle nor a sort. The files lie in the shared folder.
    """
    spark, name = df.sparkSession, f"sorted_{uuid.uuid4().hex}"
    # a bucket is one file, so its order may be relied on; a join on more columns than `by` may keep to the buckets
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by, *order).option("path", scratch(spark)).saveAsTable(name)
    return spark.table(name)


def write_features(df: DataFrame, path: str, by: str = "split") -> DataFrame:
    df.write.mode("overwrite").partitionBy(by).option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def stage(spark: SparkSession, path: str, parameters: dict, build) -> DataFrame:
    """A finished stage is read again only if it was built with the same parameters; else it is built anew under their digest."""
    at = f"{path}/{hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]}"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
