"""Spatial clusters of stations and their quality."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import haversine_km
from ..sources.sinks import cut
from .trips import dense_index


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    return standardize_by(df, df, columns)


def centroids(stations: DataFrame) -> DataFrame:
    return stations.groupBy("cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("station_count"))


def attach_centroids(df: DataFrame, centers: DataFrame) -> DataFrame:
    return df.join(centers.select("cluster_id", F.col("lat").alias("cluster_lat"), F.col("lon").alias("cluster_lon"), "station_count"), "cluster_id", "left")


#: Centres that points are held against at most, as they are part of the expression.
MOST_CENTERS = 1_000


def assign(stations: DataFrame, centers: DataFrame) -> DataFrame:
    """``station_id, assigned, d2``: the nearest center by squared distance, ties to the smaller id. Narrow.

    The centers, one row a cluster and MOST_CENTERS at most, become one array that
    each point is held against where it lies. Without centers there are no rows;
    points without a place are nearest to none.
    """
    held = centers.select("cluster_id", "lat", "lon").where("cluster_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").limit(MOST_CENTERS + 1).collect()
    if len(held) > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} centers")
    if not held:
        return stations.where("false").select("station_id", F.lit(0).alias("assigned"), F.lit(0.0).alias("d2"))
    kind = dict(centers.dtypes)["cluster_id"]
    each = ", ".join(f"struct(power(lat - {r.lat!r}D, 2) + power(lon - {r.lon!r}D, 2) AS d2, CAST({r.cluster_id} AS {kind}) AS c)" for r in held)
    nearest = F.expr(f"CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN array_min(array({each})) END")
    return stations.select("station_id", nearest.alias("_n")).select("station_id", F.col("_n.c").alias("assigned"), F.col("_n.d2").alias("d2"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("inertia"))


def centroid_distance(stations: DataFrame, centers: DataFrame) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("cluster_lat"), F.col("cluster_lon"))
    return attach_centroids(stations, centers).select("station_id", "cluster_id", km.alias("km"))


def cluster_sizes(stations: DataFrame) -> DataFrame:
    n = stations.groupBy("cluster_id").count()
    return n.agg(F.min("count").alias("min_size"), F.max("count").alias("max_size"), F.avg("count").alias("mean_size"), F.stddev_pop("count").alias("std_size"))


def size_histogram(sizes: DataFrame, size: str) -> DataFrame:
    s = F.col(size)
    name = F.when(s <= 0, "0").when(s == 1, "1").when(s <= 4, "2-4").when(s <= 9, "5-9").when(s <= 19, "10-19").otherwise("20+")
    return sizes.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


#: Points of a tile at most, sums that a task holds at most (one for each point of its tiles and cluster near them), and tiles that one task has as targets at most.
BLOCK, SUMS, MOST_TILES = 512, 16_000_000, 16


def tiles(points: DataFrame, x: str, y: str, most: int = BLOCK, *more: str) -> DataFrame:
    """The points in tiles of at most ``most`` that lie close together, one row each: ``ids, x, y`` and ``more`` (ints) as arrays, written.

    The points are dealt by x into strips, each of which is cut by y; points at one
    place are dealt by id, so none is too large.
    """
    spark = points.sparkSession
    n = points.count()
    flat = points.select(F.col("station_id").cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *more)
    strips = flat.repartitionByRange(max(1, math.isqrt(n // max(1, most))), "x", "id").sortWithinPartitions("y", "id")

    def packed(rows: pa.Table) -> pa.RecordBatch:
        each = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), c.combine_chunks()) for c in rows.columns]
        return pa.RecordBatch.from_arrays(each, ["ids", *rows.column_names[1:]])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            full = whole.num_rows // most * most
            for begin in range(0, full, most):
                yield packed(whole.slice(begin, most))
            left = whole.slice(full).to_batches()[0] if whole.num_rows > full else None
        if left is not None:
            yield packed(pa.Table.from_batches([left]))

    kinds = "ids array<long>, x array<double>, y array<double>" + "".join(f", {c} array<int>" for c in more)
    numbered = strips.mapInArrow(cut_up, kinds).withColumn("_b", F.monotonically_increasing_id())
    # tiles are few and small, so they are dealt evenly, neighbours together
    return cut(numbered.repartitionByRange(3 * spark.sparkContext.defaultParallelism, "_b").sortWithinPartitions("_b").drop("_b"))


def _near(xy: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Which clusters may be the nearest other one, by mean distance, of any point in the box around ``xy``.

    The mean distance to a cluster is at least the distance to its mean, and at most
    the root of that distance squared plus the cluster's variance. What is further
    than the second least upper bound, as the least may be a point's own cluster's,
    is out for every point.
    """
    lo, hi = xy.min(axis=0), xy.max(axis=0)
    d = np.sqrt(((stats[:, 1:3] - (lo + hi) / 2) ** 2).sum(axis=1))
    r = np.sqrt(((hi - lo) ** 2).sum()) / 2
    top = np.where(stats[:, 0] > 0, np.sqrt((d + r) ** 2 + stats[:, 3]), np.inf)
    limit = np.partition(top, 1)[1] if len(top) > 1 else np.inf
    return (stats[:, 0] > 0) & (d - r <= limit * (1 + 1e-9) + 1e-12)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, places and cluster numbers of a tile's row of NumPy-ready values."""
    xy = np.column_stack([row["x"].values.to_numpy(), row["y"].values.to_numpy()])
    labels = np.frombuffer(row["l"].as_py(), np.int32).reshape(len(xy), -1)
    return row["ids"].values.to_numpy(), xy, labels


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}


def _lists(values: np.ndarray, at: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _apart(a: np.ndarray, b: np.ndarray, rows: int = 32) -> np.ndarray:
    """Distances of all pairs of two tiles, a few rows at a time, as those stay in the processor's cache."""
    out, dx, dy = np.empty((len(a), len(b))), np.empty((rows, len(b))), np.empty((rows, len(b)))
    for i in range(0, len(a), rows):
        some = slice(i, min(i + rows, len(a)))
        x, y = dx[: some.stop - i], dy[: some.stop - i]
        np.subtract.outer(a[some, 0], b[:, 0], out=x)
        np.subtract.outer(a[some, 1], b[:, 1], out=y)
        np.multiply(x, x, out=x)
        np.multiply(y, y, out=y)
        np.sqrt(np.add(x, y, out=x), out=out[some])
    return out


def silhouettes(labelled: DataFrame, sizes: list[int]) -> DataFrame:
    """``station_id, silhouettes``: the exact Euclidean silhouette of each point under several labellings, 0 for singletons and where there is one cluster.

    ``labelled`` are tiles (``ids, x, y``) with ``l``, the points' cluster numbers as
    int32 bytes, the i-th from 0 to ``sizes[i]`` - 1. A task has some tiles as its
    targets and meets every tile that has a point of a cluster near them, with the
    labellings for which it does; their distances are one matrix, and the sums by
    cluster its product with a matrix of memberships. A task holds SUMS sums, about;
    no pair of points is ever a row. Sums are made only for clusters that can be a
    point's own or its nearest other one, by bounds that hold for every point.
    """
    spark = labelled.sparkSession
    sizes = [int(k) for k in sizes]
    ends = np.cumsum([0, *sizes])
    stats = np.zeros((ends[-1], 4))

    def codes(l: np.ndarray) -> np.ndarray:
        return l + ends[:-1].astype(np.int32)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ends[-1], 3 if middle is None else 1))
        for row in _rows(batches):
            _, xy, l = _unpacked(row)
            at = codes(l)
            for j in range(len(sizes)):
                k = slice(ends[j], ends[j + 1])
                if middle is None:
                    weights = [None, *xy.T]
                else:
                    weights = [((xy - middle.value[at[:, j], 1:3]) ** 2).sum(axis=1)]
                for c, w in enumerate(weights):
                    sums[k, c] += np.bincount(l[:, j], w, sizes[j])
        hit = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), _lists(sums[hit].ravel(), np.arange(len(hit) + 1) * sums.shape[1], pa.float64())], ["c", "s"])

    def summed(width: int) -> np.ndarray:
        out = np.zeros((ends[-1], width))
        found = labelled.mapInArrow(moments, "c int, s array<double>").groupBy("c").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).toArrow()
        out[found.column(0).to_numpy()] = np.column_stack([c.to_numpy() for c in found.columns[1:]])
        return out

    middle = None
    first = summed(3)
    stats[:, 0] = first[:, 0]
    stats[:, 1:3] = first[:, 1:] / np.maximum(1, first[:, :1])
    middle = spark.sparkContext.broadcast(stats)
    stats = stats.copy()
    stats[:, 3] = summed(1)[:, 0] / np.maximum(1, stats[:, 0])
    shared = spark.sparkContext.broadcast(stats)

    def wanted(xy: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a tile takes sums of each cluster: its points' own and those near it."""
        out = np.concatenate([_near(xy, shared.value[ends[j] : ends[j + 1]]) for j in range(len(sizes))])
        out[at.ravel()] = True
        return out

    most_tiles = max(1, min(MOST_TILES, labelled.count() // (3 * spark.sparkContext.defaultParallelism)))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles with the number of their task, and, in the last row of each task, the clusters it takes sums of."""
        part, nth, union, held, n = TaskContext.get().partitionId(), 0, None, 0, 0

        def row(ids, xy, l, want):
            m = [0, len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | nth], pa.int64()), _lists(ids, m, pa.int64()), _lists(xy[:, 0], m, pa.float64()), _lists(xy[:, 1], m, pa.float64()), pa.array([l.tobytes()], pa.binary()), pa.array([want], pa.binary())], ["u", "ids", "x", "y", "l", "want"])

        none = (np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(0, np.int32))
        for read in _rows(batches):
            ids, xy, l = _unpacked(read)
            want = wanted(xy, codes(l))
            size = len(ids) * int(want.sum())
            if n and (n >= most_tiles or held + size > SUMS):
                yield row(*none, np.packbits(union).tobytes())
                nth, union, held, n = nth + 1, None, 0, 0
            union, held, n = want if union is None else union | want, held + size, n + 1
            yield row(ids, xy, l, None)
        if n:
            yield row(*none, np.packbits(union).tobytes())

    kinds = "ids array<long>, x array<double>, y array<double>, l binary"
    held = cut(labelled.mapInArrow(grouped, f"u long, {kinds}, want binary"))
    tasks = held.where("want IS NOT NULL").select("u", "want").collect()
    number = {r.u: i for i, r in enumerate(tasks)}
    takers = spark.sparkContext.broadcast((number, np.array([np.frombuffer(r.want, np.uint8) for r in tasks])))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile once as a target, whole, and once for each task that takes sums of its clusters, with those labellings only."""
        number, takes = takers.value
        for row in _rows(batches):
            ids, xy, l = _unpacked(row)
            bits = np.zeros(ends[-1], bool)
            bits[codes(l).ravel()] = True
            shares = takes & np.packbits(bits)
            every = np.arange(len(sizes), dtype=np.int32)
            out = [(number[row["u"].as_py()], True, ids, every)]
            for t in np.flatnonzero(shares.any(axis=1)):
                some = np.flatnonzero(np.unpackbits(shares[t], count=ends[-1]))
                out.append((int(t), False, ids[:0], np.unique(np.searchsorted(ends, some, "right") - 1).astype(np.int32)))
            for t, own, own_ids, which in out:
                m = [0, len(xy)]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([own]), _lists(own_ids, [0, len(own_ids)], pa.int64()), _lists(xy[:, 0], m, pa.float64()), _lists(xy[:, 1], m, pa.float64()), pa.array([np.ascontiguousarray(l[:, which]).tobytes()], pa.binary()), pa.array([which.tobytes()], pa.binary())], ["t", "own", "ids", "x", "y", "l", "which"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, targets = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for ids, xy, l, takes, _, sums in targets:
                out, m = np.zeros((len(ids), len(sizes))), np.arange(len(ids))
                first = np.searchsorted(takes, ends)
                for j in range(len(sizes)):
                    k = slice(first[j], first[j + 1])
                    n = np.repeat(shared.value[takes[k], :1], len(ids), axis=1)
                    own = np.searchsorted(takes[k], ends[j] + l[:, j])
                    n[own, m] -= 1  # itself
                    with np.errstate(divide="ignore", invalid="ignore"):
                        mean = np.where(n > 0, sums[k] / n, np.inf)
                    a = mean[own, m].copy()
                    mean[own, m] = np.inf
                    b = mean.min(axis=0)
                    fine = np.isfinite(a) & np.isfinite(b) & (np.maximum(a, b) > 0)
                    out[fine, j] = ((b - a)[fine]) / np.maximum(a, b)[fine]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(out.ravel(), np.arange(len(ids) + 1) * len(sizes), pa.float64())], ["station_id", "silhouettes"])

        for row in _rows(batches):
            if (t := row["t"].as_py()) != at:
                yield from done()
                at, targets = t, []
            ids, xy, l = _unpacked(row)
            if row["own"].as_py():
                want = wanted(xy, codes(l))
                takes = np.flatnonzero(want)
                place = np.full(ends[-1], -1)
                place[takes] = np.arange(len(takes))
                targets.append((ids, xy, l, takes, place, np.zeros((len(takes), len(ids)))))
                continue
            which = np.frombuffer(row["which"].as_py(), np.int32)
            at_codes = l + ends[which].astype(np.int32)
            seen = np.zeros(ends[-1], bool)
            seen[at_codes.ravel()] = True
            clusters = np.flatnonzero(seen)
            index = np.cumsum(seen) - 1
            members = np.zeros((len(clusters), len(xy)))
            members[index[at_codes], np.arange(len(xy))[:, None]] = 1
            for _, mine, _, _, place, sums in targets:
                to = place[clusters]
                hit = to >= 0
                if hit.any():
                    sums[to[hit]] += members[hit] @ _apart(xy, mine)
        yield from done()

    pairs = held.where("want IS NULL").select("u", "ids", "x", "y", "l").mapInArrow(met, f"t int, own boolean, {kinds}, which binary")
    dealt = pairs.repartitionById(max(1, len(tasks)), F.col("t")).sortWithinPartitions("t", F.expr("NOT own"))
    return dealt.mapInArrow(run, "station_id long, silhouettes array<double>")


def silhouette(points: DataFrame, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """``station_id, silhouette`` under ``cluster_id``; rows without a cluster are left out, and those without a place have none and count for no other."""
    numbers = cut(dense_index(points, "cluster_id"))
    k = numbers.count()
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    numbered = points.select("station_id", "cluster_id", x, y).join(numbers, "cluster_id")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l = [x.values.to_numpy().tobytes() for x in batch.column("idx")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(l, pa.binary())], ["ids", "x", "y", "l"])

    most = max(1, min(block, SUMS // max(1, k)))
    labelled = tiles(numbered.where(placed), x, y, most, "idx").mapInArrow(label, "ids array<long>, x array<double>, y array<double>, l binary")
    found = silhouettes(labelled, [k]).select("station_id", F.col("silhouettes")[0].alias("silhouette"))
    return found.unionByName(numbered.where(~placed).select("station_id", F.lit(None).cast("double").alias("silhouette")))


def coord_features(points: DataFrame, columns=("lat", "lon"), waves=(1, 2)) -> DataFrame:
    """Each coordinate scaled to an angle of one turn between its least and greatest value, and the sine and cosine of its multiples; 0 and 1 where it is constant."""
    ends = points.agg(*(x for c in columns for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))))
    angle = lambda c: 2 * math.pi * F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")), F.lit(0.0))
    made = {f"{c}_{name}_{k}": f(k * angle(c)) for c in columns for k in waves for name, f in (("sin", F.sin), ("cos", F.cos))}
    return points.crossJoin(ends).withColumns(made).drop(*(f"{c}_{end}" for c in columns for end in ("lo", "hi")))


def standardize_by(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """As ``standardize``, with the mean and deviation of ``train``."""
    stats = train.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))))
    z = {f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.nullif(F.col(f"{c}_s"), F.lit(0.0))), F.lit(0.0)) for c in columns}
    return df.crossJoin(stats).withColumns(z).select(*df.columns, *z)


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fit_kmeans(stations: DataFrame, k: int, columns: list[str], seeds: int = 10, max_iter: int = 300):
    """The best by training cost of several seeds, ties to the first.

    The points are dealt evenly to all cores, as a table of few files would leave
    most idle. Seeds are fitted at the same time, so that one's jobs run while
    another's wait for the driver.
    """
    cores = stations.sparkSession.sparkContext.defaultParallelism
    data = _vectors(stations, columns).select("features").repartition(cores).cache()
    try:
        data.count()  # else each of the first fits computes it
        fit = inheritable_thread_target(stations.sparkSession)(lambda s: KMeans(k=k, seed=s, maxIter=max_iter, initMode="k-means||").fit(data))
        with ThreadPool(min(seeds, cores)) as pool:
            return min(pool.map(fit, range(seeds)), key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def save_clusters(model: KMeansModel, stations: DataFrame, columns: list[str], path: str) -> None:
    """Write a fitted model, the map of its stations, and the clusters' centroids and sizes, to ``path``."""
    model.write().overwrite().save(f"{path}/model")
    mapped = model.transform(_vectors(stations, columns)).select("station_id", F.col("prediction").alias("cluster_id"), "lat", "lon")
    mapped.write.mode("overwrite").parquet(f"{path}/stations")
    centroids(stations.sparkSession.read.parquet(f"{path}/stations")).write.mode("overwrite").parquet(f"{path}/centroids")


def load_clusters(spark: SparkSession, path: str) -> tuple[KMeansModel, DataFrame, DataFrame]:
    """The model, ``station_id, cluster_id, lat, lon``, and ``cluster_id, lat, lon, station_count``."""
    return KMeansModel.load(f"{path}/model"), spark.read.parquet(f"{path}/stations"), spark.read.parquet(f"{path}/centroids")


#: Points that the seeds of a sweep are drawn from, about.
SEED_POINTS = 5_000


def _seeds(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k points, each drawn by its squared distance from those before it; the first few are as good a start for fewer clusters."""
    draw = np.random.default_rng(seed)
    chosen = [points[draw.integers(len(points))]]
    near = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and near.sum() > 0:
        chosen.append(points[draw.choice(len(points), p=near / near.sum())])
        near = np.minimum(near, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def k_sweep(stations: DataFrame, columns: list[str], ks=range(2, 251), seed: int = 42, max_iter: int = 25) -> DataFrame:
    """``k, inertia, silhouette`` for each k below the number of different points, and both scaled to 0..1 over the sweep.

    All numbers of clusters are fitted at once: each round is one pass over the
    written points, in which a point is held against the centres of every k, and
    tasks hand on a sum for each centre. Seeds come from a sample of SEED_POINTS
    points, about. A k whose centres rest takes no further part. The silhouettes,
    Euclidean ones of all points, come from one pass over pairs of blocks. A round's
    centres, whose number ks set, are what the driver holds.
    """
    if len(columns) != 2:
        raise ValueError("a sweep takes two coordinates")
    spark = stations.sparkSession
    written = tiles(stations, *columns, max(1, min(BLOCK, SUMS // max(1, sum(ks)))))
    n = written.agg(F.sum(F.size("ids"))).first()[0] or 0
    flat = written.select(F.explode(F.arrays_zip("ids", "x", "y")).alias("t")).select(F.col("t.ids").alias("station_id"), F.array("t.x", "t.y").alias("p"))
    share = SEED_POINTS / max(1, n)
    drawn = flat.where(F.pmod(F.xxhash64("station_id"), F.lit(1_000_000)) < share * 1_000_000).orderBy("station_id").select("p").collect()
    start = _seeds(np.array([r.p for r in drawn]), max(ks), seed) if drawn else np.zeros((0, len(columns)))
    ks = [k for k in ks if k < n and k <= len(start)]
    ends, centers = np.cumsum([0, *ks]), np.concatenate([start[:k] for k in ks]) if ks else start
    active = list(range(len(ks)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for row in _rows(batches):
            yield np.column_stack([row["x"].values.to_numpy(), row["y"].values.to_numpy()])

    def nearest(xy: np.ndarray, at: np.ndarray, which: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each point's centre and its squared distance, for each k; centres that none of the tile's points can be nearest to are left out before."""
        lo, hi = xy.min(axis=0), xy.max(axis=0)
        away = np.sqrt(((at - (lo + hi) / 2) ** 2).sum(axis=1))
        r = np.sqrt(((hi - lo) ** 2).sum()) / 2
        for i in which:
            d = away[ends[i] : ends[i + 1]]
            some = np.flatnonzero(d <= (d.min() + 2 * r) * (1 + 1e-9) + 1e-12)
            d2 = ((xy[:, None] - at[ends[i] + some][None]) ** 2).sum(-1)
            own = d2.argmin(axis=1)
            yield i, some[own], d2[np.arange(len(xy)), own]

    def totals(shared, which: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((ends[-1], len(columns) + 2))
            for xy in places(batches):
                for i, own, d2 in nearest(xy, shared.value, which):
                    for c, weights in enumerate([None, d2, *xy.T]):
                        sums[ends[i] : ends[i + 1], c] += np.bincount(own, weights, ends[i + 1] - ends[i])
            hit = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), _lists(sums[hit].ravel(), np.arange(len(hit) + 1) * sums.shape[1], pa.float64())], ["c", "s"])

        parts = written.mapInArrow(run, "c int, s array<double>")
        each = [F.sum(F.col("s")[c]).alias(f"s{c}") for c in range(len(columns) + 2)]
        out = np.zeros((ends[-1], len(columns) + 2))
        found = parts.groupBy("c").agg(*each).toArrow()
        out[found.column(0).to_numpy()] = np.column_stack([c.to_numpy() for c in found.columns[1:]])
        return out

    for _ in range(max_iter if ks else 0):
        sums = totals(spark.sparkContext.broadcast(centers), active)
        moved = centers.copy()
        hit = sums[:, 0] > 0  # a centre without points stays
        moved[hit] = sums[hit, 2:] / sums[hit, :1]
        active = [i for i in active if np.abs(moved[ends[i] : ends[i + 1]] - centers[ends[i] : ends[i + 1]]).max() > 1e-6]
        centers = moved
        if not active:
            break
    if not ks:
        return spark.createDataFrame([], "k int, inertia double, silhouette double, inertia_norm double, silhouette_norm double")
    shared = spark.sparkContext.broadcast(centers)
    inertia = totals(shared, list(range(len(ks))))[:, 1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns = [np.column_stack([own for _, own, _ in nearest(xy, shared.value, range(len(ks)))]).astype(np.int32) for xy in places([batch])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.tobytes() for own in owns], pa.binary())], ["ids", "x", "y", "l"])

    labelled = cut(written.mapInArrow(label, "ids array<long>, x array<double>, y array<double>, l binary"))
    each = silhouettes(labelled, ks).select(F.posexplode("silhouettes").alias("i", "s")).groupBy("i").agg(F.avg("s").alias("silhouette"))
    fits = [(i, k, float(inertia[ends[i] : ends[i + 1]].sum())) for i, k in enumerate(ks)]
    sweep = cut(spark.createDataFrame(fits, "i int, k int, inertia double").join(each, "i").drop("i"))
    spans = sweep.agg(*(f(c).alias(f"_{name}_{c}") for c in ("inertia", "silhouette") for name, f in (("lo", F.min), ("hi", F.max))))
    norm = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)).alias(f"{c}_norm")
    return sweep.crossJoin(spans).select("k", "inertia", "silhouette", norm("inertia"), norm("silhouette"))


def elbow(sweep: DataFrame) -> DataFrame:
    """The k furthest below the line from first to last, both axes scaled to 0..1; ties to the smallest k.

    Equals the usual knee for a decreasing convex curve; it doesn't smooth or look for several knees.
    """
    w = sweep.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("inertia").alias("i0"), F.max("inertia").alias("i1"))
    x = F.try_divide(F.col("k") - F.col("k0"), F.col("k1") - F.col("k0"))
    y = F.try_divide(F.col("inertia") - F.col("i0"), F.col("i1") - F.col("i0"))
    return sweep.crossJoin(w).agg(F.max_by("k", F.struct(F.coalesce((1 - x) - y, F.lit(0.0)), -F.col("k"))).alias("elbow_k"))


def best_k(sweep: DataFrame) -> DataFrame:
    top = lambda cond: F.max_by(F.when(cond, F.col("k")), F.when(cond, F.struct("silhouette", -F.col("k"))))
    return sweep.agg(top(F.lit(True)).alias("best"), top(F.col("k") >= 50).alias("best_50"), top(F.col("k") > 100).alias("best_100"))
