"""Exact top-k search by tiled matrix products.

Vectors come in tiles, queries in blocks of a bounded size. Each tile meets
each block once; their scores are one matrix product, of which only each query's
k best are kept. Those meet in a tree: per tile, per task, per salted group, per
query. Blocks are broadcast; of more than one broadcast holds, each share is a
pass of its own over the vectors, whose best are written before the next. So
vectors are read, never shuffled. No vector is handled by the driver's program.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Queries of a block, about, and vectors of a tile at most.
BLOCK, TILE = 4_096, 1_024
#: Bytes of a block, about, and of a tile at most, where vectors are long.
BLOCK_BYTES = 8_000_000
#: Bytes of query blocks that are broadcast in one pass, about.
BROADCAST_BYTES = 64_000_000
#: Blocks whose best lists a task holds; of more, the oldest is handed on and may come again.
HELD = 16
#: Groups into which a query's lists are dealt before the last merge.
FAN_IN = 32


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles ``d, ids, vectors`` of ``vec_id, v``: at most TILE vectors of one length, as raw numbers."""
    for batch in batches:
        lists = batch.column("v")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        ids, sizes = batch.column("vec_id").to_numpy(zero_copy_only=False), np.diff(ends)
        rows = []
        for d in np.unique(sizes):
            of_d = np.flatnonzero(sizes == d)
            step = max(1, min(TILE, BLOCK_BYTES // (8 * max(1, int(d)))))
            for begin in range(0, len(of_d), step):
                at = of_d[begin : begin + step]
                own = np.ascontiguousarray(ids[at], np.int64)
                rows.append((int(d), own.tobytes(), flat[ends[at][:, None] + np.arange(d)].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["d", "ids", "vectors"])


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else with Python's integers, cut to a long's range."""
    most = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * max(1, tile.shape[1])
    if most < 2**53:
        return (queries @ tile.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(tile).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to smaller ids."""
    order = np.lexsort((vec_id, -score, query))
    query = query[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(query)), bool), query[1:] != query[:-1]]))
    kept = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < k
    return query[kept], score[order][kept], vec_id[order][kept]


def _of_tile(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, tile: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial selection: what may be among each query's k best of one tile."""
    scores = _products(queries, tile)
    others = names[:, None] != ids[None, :]
    if len(ids) > k:
        masked = np.where(others, scores, np.iinfo(np.int64).min)
        least = np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k]
        others &= masked >= least[:, None]
    q, c = np.nonzero(others)
    return _best(q, scores[q, c], ids[c], k)


def _search(k: int):
    """``query_id, vec_id, score`` of joined blocks and tiles; each task merges its tiles' lists block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, tuple]] = {}

        def out(names: np.ndarray, found: tuple) -> pa.RecordBatch:
            q, score, vec_id = found
            return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(vec_id), pa.array(score.tolist(), pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("d")[i].as_py()
                members = batch.column("q")[i].values
                names = members.field("vec_id").to_numpy(zero_copy_only=False)
                queries = members.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(names), d)
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                tile = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.float64).reshape(len(ids), d)
                found = _of_tile(names, queries, ids, tile, k)
                key = (batch.column("block")[i].as_py(), d)
                if before := held.pop(key, None):
                    found = _best(*(np.concatenate(pair) for pair in zip(before[1], found)), k)
                held[key] = names.copy(), found
                if len(held) > HELD:
                    yield out(*held.pop(next(iter(held))))
        for names, found in held.values():
            yield out(names, found)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products of ``floor(1024 * x)`` vectors.

    Candidates are all rows but those of the query's own id, of the same length;
    ties go to the smaller vec_id; fewer than k rows give all. A null id, and a
    vector that is null or has null or non-finite components, takes no part.
    Components and scores beyond a long's range count as its nearest end. Rows
    that repeat a query's id are one query, with the least of their vectors
    (component by component); other repeated ids are each a candidate. Other
    columns are left out. An empty table gives no rows.
    """
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    slim = slim.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    slim = slim.select("vec_id", F.transform("v", lambda x: F.floor(x * 1024).cast("double")).alias("v"))
    queries = materialize(slim.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, components = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()
    passes = max(1, -(-8 * components // max(1, broadcast_bytes)))
    blocks = max(passes, -(-n // block), -(-8 * components // BLOCK_BYTES))
    asked = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.size("v").alias("d")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    if passes == 1:
        return _best_of(slim, asked, k)
    asked = materialize(asked)
    shares = (asked.where(F.col("block") % passes == i) for i in range(passes))
    return reduce(DataFrame.unionAll, [materialize(_best_of(slim, share, k)) for share in shares])


def _best_of(slim: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The result for the queries of some blocks, which are broadcast: one pass over all vectors."""
    tiles = slim.mapInArrow(_tiles, "d int, ids binary, vectors binary")
    found = tiles.join(F.broadcast(asked), "d").select("block", "d", "q", "ids", "vectors").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best_first = [F.desc("score"), F.asc("vec_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(FAN_IN)))
    partly = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*best_first))).where(F.col("rank") <= k)
    return partly.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the ids divisible by 100, candidates the whole of ``embeddings``; odd rows as ``top_k`` says."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
