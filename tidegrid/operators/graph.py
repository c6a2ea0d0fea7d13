"""Nearest-neighbour graph over stations and what flows along its edges."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EARTH_RADIUS, haversine_km
from ..sources.sinks import cut, observed_cut
from .cells import densify

#: Halvings of the cube round the globe at most: cells of a centimetre.
DEPTH = 30
#: A cell is searched whole if it holds at most this many points for each neighbour that is asked for.
LEAF = 256
#: What rounding may add to or take from a distance on the unit sphere.
SLACK = 1e-12
_AXES = ("x", "y", "z")


def _axes(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere, where neither poles nor the date line are special."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [(F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")]


def _cube(axis: str) -> Column:
    """A coordinate's cell at ``level``: that of the deepest one, without its last bits."""
    return F.expr(f"shiftright(CAST(floor(({axis} + 1) * {2.0 ** (DEPTH - 1)}D) AS LONG), {DEPTH} - level)")


def _steps(*each: int) -> Column:
    """A row for each combination of steps along the axes."""
    return F.expr("explode(array(" + ", ".join("named_struct('x', {}, 'y', {}, 'z', {})".format(*step) for step in product(each, repeat=3)) + "))")


def _reach(farthest: bool) -> Column:
    """The least or the greatest distance of the point ``x, y, z`` from the cell ``cx, cy, cz`` of a level."""
    side = "power(2D, 1 - level)"
    ends = [f"{a} - (c{a} * {side} - 1)" for a in _AXES]
    apart = (f"greatest({e}, {side} - ({e}))" if farthest else f"greatest(-({e}), ({e}) - {side}, 0D)" for e in ends)
    return F.expr(f"sqrt({' + '.join(f'power({a}, 2)' for a in apart)})")


def _narrowed(met: DataFrame, k: int) -> DataFrame:
    """Places and cells, without those farther than cells that hold k candidates are at most; ``r`` is that distance."""
    nearest = Window.partitionBy("place").orderBy("_far", "cx", "cy", "cz").rowsBetween(Window.unboundedPreceding, 0)
    enough = met.withColumn("_far", _reach(True)).withColumn("_sum", F.sum("n").over(nearest))
    bound = F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(Window.partitionBy("place"))
    kept = enough.withColumn("r", F.least("r", F.coalesce(bound, "r"))).where(_reach(False) <= F.col("r") + SLACK)
    return kept.drop("_far", "_sum")


def knn_pairs(points: DataFrame, k: int, max_km: float) -> DataFrame:
    """``src, dst, km``: the k nearest other points within ``max_km``; ties go to the smaller id.

    Points at one place are searched once, and of them only the k + 1 least ids
    can be anyone's neighbours. Places lie in a tree of cubes round the globe. A
    place starts from the smallest cube of its own that holds k + 1 points, which
    bounds how far its neighbours can be; it meets the cubes within that bound,
    and goes down into crowded ones, each as deep as its own points ask for, while
    the bound shrinks. So a place meets few points, however unevenly they lie.
    Rows without id or place are left out.
    """
    p = points.where("station_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("station_id", "lat", "lon")
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("station_id"))
    # the limit works before the shuffle too, so a crowded place sends k + 1 rows from each task
    ids = cut(p.withColumn("_rank", first).where(F.col("_rank") <= k + 1).select("station_id", "lat", "lon", F.col("_rank") == 1, *_axes(F.col("lat"), F.col("lon"))).toDF("id", "lat", "lon", "leads", *_AXES))
    chord = 2 * math.sin(min(math.pi / 2, max_km / (2 * EARTH_RADIUS))) + SLACK
    top = max(0, math.floor(math.log2(2 / chord)))  # cubes at least as wide as max_km
    keys = ["level", "cx", "cy", "cz"]
    at = lambda df, levels: df.withColumn("level", F.explode(levels)).withColumns({f"c{a}": _cube(a) for a in _AXES})
    tree = cut(at(ids.select(*_AXES), F.sequence(F.lit(top), F.lit(DEPTH))).groupBy(*keys).agg(F.count("*").alias("n")))

    places = ids.where("leads").select(F.col("id").alias("place"), *_AXES)
    own = at(places, F.sequence(F.lit(top), F.lit(DEPTH))).join(tree.where(F.col("n") > k), keys).groupBy("place").agg(F.max("level").alias("own"))
    found = places.join(own, "place", "left").withColumn("level", F.greatest(F.coalesce(F.col("own") - 1, F.lit(top)), F.lit(top)))
    widest = F.when(F.col("own").isNull(), chord).otherwise(F.least(F.lit(chord), math.sqrt(3) * F.pow(F.lit(2.0), 1 - F.col("own")) + SLACK))
    own_cube = {f"c{a}": _cube(a) + F.col(f"_s.{a}") for a in _AXES}
    met = found.withColumns({"r": widest, "_s": _steps(-1, 0, 1)}).withColumns(own_cube).drop("own", "_s")
    crowded = (F.col("n") > LEAF * k) & (F.col("level") < DEPTH)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    seen = {"levels": F.bit_or(bit), "crowded": F.count_if(crowded)}
    met, held = observed_cut(met.where(_reach(False) <= F.col("r") + SLACK).join(tree, keys), **seen)
    while held["crowded"]:
        halves = {f"c{a}": 2 * F.col(f"c{a}") + F.col(f"_s.{a}") for a in _AXES}
        children = met.where(crowded).drop("n").withColumns({"level": F.col("level") + 1, "_s": _steps(0, 1)}).withColumns(halves).drop("_s")
        deeper = children.where(_reach(False) <= F.col("r") + SLACK).join(tree, keys)
        met, held = observed_cut(_narrowed(met.where(~crowded).unionByName(deeper), k + 1), **seen)

    used = F.array(*(F.lit(level) for level in range(top, DEPTH + 1) if (held["levels"] or 0) >> level & 1)).cast("array<int>")
    there = at(ids.select("id", "lat", "lon", *_AXES), used).select(*keys, F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    here = ids.where("leads").select(F.col("id").alias("place"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pairs = met.select("place", *keys).join(here, "place").join(there, keys).select("place", "lat1", "lon1", "dst", km.alias("km")).where(F.col("km") <= max_km)
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("place").orderBy("km", "dst"))).where(F.col("_rank") <= k + 1)
    near = ranked.groupBy("place").agg(F.first("lat1").alias("lat"), F.first("lon1").alias("lon"), F.sort_array(F.collect_list(F.struct("km", "dst"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["dst"] != F.col("src")), 1, k)
    each = p.withColumnRenamed("station_id", "src").join(near.drop("place"), ["lat", "lon"])
    return each.select("src", F.explode(others).alias("n")).select("src", "n.dst", "n.km")


def undirected(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km"))
    return both.groupBy("src", "dst").agg(F.min("km").alias("km"))


def graph_stats(edges: DataFrame, n_nodes: int) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), (F.count("*") / F.lit(float(n_nodes * (n_nodes - 1)))).alias("density"), (F.count("*") / F.lit(float(n_nodes))).alias("edges_per_node"))


def neighbor_mean(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    own = nodes.select(F.col("station_id").alias("dst"), *columns)
    return edges.join(own, "dst").groupBy("src").agg(*(F.avg(c).alias(f"neighbor_{c}") for c in columns))


def propagate(edges: DataFrame, nodes: DataFrame, value: str, hops: int = 1) -> DataFrame:
    """Symmetric-normalised propagation with a self loop; between hops the state is written to the shared folder."""
    degree = edges.groupBy("src").agg((F.count("*") + 1).alias("deg"))
    state = nodes.select(F.col("station_id").alias("id"), F.col(value).cast("double").alias("x")).join(degree.withColumnRenamed("src", "id"), "id", "left").na.fill(1, ["deg"])
    for hop in range(hops):
        sent = edges.join(state.select(F.col("id").alias("dst"), (F.col("x") / F.sqrt("deg")).alias("m")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("m").alias("m"))
        mixed = state.join(sent, "id", "left")
        state = mixed.select("id", (F.coalesce("m", F.lit(0.0)) / F.sqrt("deg") + F.col("x") / F.col("deg")).alias("x"), "deg")
        if hop + 1 < hops:
            state = cut(state)
    return state.select(F.col("id").alias("station_id"), F.col("x").alias(f"{value}_prop"))


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """``src, dst, hops``: nodes first reached in that many steps.

    Each step goes on from the pairs of the step before alone, and is written, so
    a step's plan is the same however many came before. The edges are written once.
    Stops early where nothing new is reached. A graph that goes both ways needs no
    look at all that was found: what lies one step on is new, or was reached by one
    of the last two steps; any other is held against all steps.
    """
    known = cut(edges.select("src", "dst").distinct())
    onward = known.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    both_ways = not known.join(known.toDF("dst", "src"), ["src", "dst"], "left_anti").limit(1).count()
    steps = [known.where("src <> dst")]
    for _ in range(2, hops + 1):
        ahead = steps[-1].withColumnRenamed("dst", "mid").join(onward, "mid").where("src <> to").select("src", F.col("to").alias("dst")).distinct()
        for before in steps[-2:] if both_ways else steps:
            ahead = ahead.join(before, ["src", "dst"], "left_anti")
        front, held = observed_cut(ahead, n=F.count(F.lit(1)))
        if not held["n"]:
            break
        steps.append(front)
    each = [step.withColumn("hops", F.lit(n)) for n, step in enumerate(steps, 1)]
    return reduce(DataFrame.unionByName, each)


def neighbor_demand(edges: DataFrame, series: DataFrame, value: str, width: str = "1 day") -> DataFrame:
    """Sum over a node's neighbours in each slot and in the slot before, on the dense grid.

    Every node with a neighbour has every slot from the first to the last of
    ``series`` (``station_id, ts_start``, slots of ``width``); a slot in which no
    neighbour has a row is 0, and so is what lies before the first one.
    """
    near = edges.join(series.withColumnRenamed("station_id", "dst"), "dst").groupBy(F.col("src").alias("station_id"), "ts_start").agg(F.sum(value).alias(f"near_{value}"))
    span = series.agg(F.min("ts_start").alias("lo"), F.max("ts_start").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {width}"))).alias("ts_start"))
    grid = densify(edges.select(F.col("src").alias("station_id")).distinct().crossJoin(every), ["station_id", "ts_start"], near)
    return grid.withColumn(f"near_{value}_lag_1", F.lag(f"near_{value}", 1, 0).over(Window.partitionBy("station_id").orderBy("ts_start")))
