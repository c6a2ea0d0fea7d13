"""Helpers that the corpus operators share: table access and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus: a run of ASCII letters and digits or non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a frame that is broadcast, at most, as counted before.
BROADCAST_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is
    unset (local tests) a folder of this machine is set instead.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tidegrid-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so lost executors cost no more than the running stage.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many leading underscores as make it none of the frames' columns."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row(docs: DataFrame, row: str) -> DataFrame:
    """The frame with a long ``row`` that no two rows share and that stays the same however often the frame is read.

    A frame as Parquet files give it (or filtered, or with fewer columns) is
    keyed by file and place in the file, without writing its texts again; any
    other is written once with the key. The file names, one row for each, are
    joined as Spark sees fit. The frame may not be a join.
    """
    file, place, nth = (unused(name, docs) for name in ("_file", "_place", "_nth"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    files = materialize(placed.select(file).distinct().coalesce(1).select(file, F.monotonically_increasing_id().alias(nth)))
    return placed.join(files, file).withColumn(row, F.col(nth) * F.lit(2**40) + F.col(place)).drop(file, place, nth)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    plain = F.octet_length(text) == F.length(text)  # ASCII throughout, where lower() does the same and faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null. Splitting between them costs a third of extracting them."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def counted_bytes(df: DataFrame) -> int:
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(16))
    return df.agg(F.sum(width)).first()[0] or 0


def broadcast_parts(df: DataFrame, key: str, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """A written frame as broadcasts of at most about ``most`` bytes each: one, or parts by a hash of ``key``, of whose values none has many rows."""
    counted = counted_bytes(df)
    if counted <= most:
        return [F.broadcast(df)]
    parts = -(-2 * counted // max(1, most))
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)) for i in range(parts)]
