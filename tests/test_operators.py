"""Small hand-made frames, one for each rule."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import expressions as E
from tidegrid.operators import cells, features, forecast, graph, metrics, trips
from tidegrid.operators import clustering as K
from tidegrid.sources import sinks
from tidegrid.streaming import slots


def trip_rows(spark, rows):
    base = spark.createDataFrame(rows, "origin_station_id int, dest_station_id int, dep_ts timestamp_ntz, arr_ts timestamp_ntz, duration_s double, gender string, user_age int, bike_model string")
    stations = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "station_id int, cluster_id int")
    return trips.classify(trips.map_clusters(base, stations))


def test_external_only_cell_keeps_its_count(spark):
    t = dt.datetime(2024, 1, 1, 8, 10)
    lab = trip_rows(spark, [(1, 3, t, t, 60.0, None, None, "FIT"), (1, None, t, t, 90.0, "MALE", 25, "ICONIC"), (9, 1, t, t, 1.0, None, 26, "FIT")])
    got = {r.cluster_id: r for r in cells.cells(lab, "dep", "30 minutes").collect()}
    assert (got[10].dep_external_count, got[10].dep_internal_count, got[10].has_dep_internal) == (2, 0, 0)
    assert got[10].dep_external_young == 1 and got[-1].dep_external_adult == 1
    assert got[-1].dep_external_duration_std == 0.0  # one trip has no deviation


def test_history_needs_a_full_window(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i), i) for i in range(6)]
    grid = spark.createDataFrame(rows, "cluster_id string, ts_start timestamp_ntz, n long")
    got = [r.asDict() for r in features.add_lags(grid, ["n"]).orderBy("ts_start").collect()]
    assert [r["n_lag_1"] for r in got] == [0, 0, 1, 2, 3, 4]
    assert [r["n_rolling_mean_4"] for r in got] == [0, 0, 0, 0, 1.5, 2.5]
    assert features.sequences(grid, "cluster_id", "ts_start", ["n"], "n", 24).count() == 0


def test_calendar_is_iso(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 6, 0),), (dt.datetime(2024, 1, 8, 9, 59),)], "ts_start timestamp_ntz")
    sunday, monday = df.select(*E.calendar()).collect()
    assert (sunday.day_of_week, sunday.is_weekend, sunday.is_daytime) == (7, 1, 1)
    assert (monday.day_of_week, monday.is_weekend, monday.is_morning_rush) == (1, 0, 1)


def test_lagged_features_and_leaks():
    assert len(features.LAGGED) * (4 + 3 + 3 + 2) == 252
    assert features.leaking(["dep_external_count", "dep_external_count_lag_1", "arr_internal_count_lag_1", "has_dep_external", "hour_sin"]) == ["dep_external_count", "arr_internal_count_lag_1", "has_dep_external"]


def test_duplicate_user_does_not_fan_out(spark):
    users = spark.createDataFrame([(1, "A", 30), (1, "A", 31), (2, None, None)], "user_id long, gender_full string, user_age int")
    got = trips.join_users(spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), users).collect()
    assert sorted((r.user_id, r.user_matched, r.age_available) for r in got) == [(1, True, True), (2, False, False), (3, False, False)]


def test_overlapping_splits_are_refused(spark):
    df = spark.createDataFrame([("train", 5), ("val", 3)], "split string, ts int")
    with pytest.raises(ValueError):
        trips.check_no_leakage(df, "ts")


def test_graph_is_symmetric_and_ties_go_low(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 0.0, -0.01), (4, 1.0, 1.0)], "station_id long, lat double, lon double")
    pairs = {(r.src, r.dst) for r in graph.knn_pairs(p, 1, 5.0).collect()}
    assert (1, 2) in pairs and (1, 3) not in pairs and not any(4 in x for x in pairs)
    both = {(r.src, r.dst) for r in graph.undirected(graph.knn_pairs(p, 1, 5.0)).collect()}
    assert both == {(b, a) for a, b in both}


def km(a, b):
    (lat1, lon1), (lat2, lon2) = np.radians(a), np.radians(b)
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2))


@pytest.mark.parametrize("middle, crowded", [((0.0, 0.0), 256), ((0.0, 0.0), 1), ((-34.6, 180.0), 4), ((89.7, 0.0), 1), ((60.0, -179.99), 4)])
def test_tree_search_equals_all_pairs(spark, monkeypatch, middle, crowded):
    rng = np.random.default_rng(3)
    near = rng.normal(0, 0.02, (60, 2)) + rng.choice([-0.05, 0.05], (60, 1))
    spots = [*near, *rng.uniform(-0.1, 0.1, (40, 2)), *[(0.03, 0.01)] * 9, *rng.normal(0.05, 1e-7, (20, 2))]
    places = [(max(-90.0, min(90.0, middle[0] + a)), (middle[1] + b * 2 + 180) % 360 - 180) for a, b in spots]
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)] + [(None, 0.0, 0.0), (500, None, 0.0)], "station_id long, lat double, lon double")
    monkeypatch.setattr(graph, "LEAF", crowded)
    want = set()
    for i, a in enumerate(places):
        ranked = sorted((0.0 if a == b else round(float(km(a, b)), 12), j) for j, b in enumerate(places) if j != i)
        want |= {(i, j) for d, j in ranked[:4] if d <= 3.0}
    assert {(r.src, r.dst) for r in graph.knn_pairs(p, 4, 3.0).collect()} == want
    assert graph.knn_pairs(p.where("false"), 4, 3.0).count() == 0


def test_poisson_fit_recovers_rates(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 2000)
    rows = [("s", float(a), float(b)) for a, b in zip(x, rng.poisson(np.exp(0.5 + 1.2 * x)))]
    got = forecast.poisson_per_entity(spark.createDataFrame(rows, "station string, x double, y double"), "station", ["x"], "y").first()
    assert abs(got.intercept - 0.5) < 0.1 and abs(got.weights[0] - 1.2) < 0.15


def test_skellam_mass_sums_to_one(spark):
    df = spark.range(-30, 31).select(F.col("id").alias("d"), F.lit(2.5).alias("a"), F.lit(4.0).alias("b"))
    lp = df.select(E.skellam_logpmf(F.col("d"), F.col("a"), F.col("b")).alias("lp"), E.skellam_cdf(F.col("d"), F.col("a"), F.col("b")).alias("c")).orderBy("c").collect()
    assert abs(sum(np.exp(r.lp) for r in lp) - 1) < 1e-9 and abs(lp[-1].c - 1) < 1e-9


def test_silhouette_in_blocks_is_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(i, i % 4 if i else 99, float(a), float(b)) for i, (a, b) in enumerate(draw.normal(size=(90, 2)) + np.arange(90)[:, None] % 4)]
    points = spark.createDataFrame(rows, "station_id long, cluster_id long, lat double, lon double")
    xy, of = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d, want = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), {}
    for i, c in enumerate(of):
        means = {k: d[i, (of == k) & (np.arange(90) != i)].mean() for k in set(of) if k != c or (of == k).sum() > 1}
        b = min(v for k, v in means.items() if k != c)
        want[i] = (b - means[c]) / max(means[c], b) if c in means else 0.0
    for block in (90, 20, 7):
        got = {r.station_id: r.silhouette for r in K.silhouette(points, "lat", "lon", block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), block


def test_silhouette_of_more_than_10_000_points(spark):
    points = spark.range(10_001).select(F.col("id").alias("station_id"), (F.col("id") % 2).alias("cluster_id"), (F.col("id") % 2 * 10.0).alias("lat"), F.lit(1.0).alias("lon"))
    got = K.silhouette(points, "lat", "lon").agg(F.count("*").alias("n"), F.min("silhouette").alias("low")).first()
    assert (got.n, got.low) == (10_001, 1.0)


def test_silhouettes_by_near_clusters_are_exact(spark):
    draw = np.random.default_rng(5)
    xy = np.concatenate([draw.normal(size=(150, 2)) * 0.2 + [i % 3 * 4, i // 3 * 4] for i in range(6)] + [np.full((60, 2), 7.0)])
    of = [np.arange(960) % 3, np.minimum(np.arange(960) // 150, 6), np.arange(960) // 40]  # scattered, compact, and parts of compact ones
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    made = K.tiles(spark.createDataFrame(rows, "station_id long, x double, y double"), "x", "y", 40)
    assert made.count() >= 24 and made.agg(F.sum(F.size("ids"))).first()[0] == 960
    label = F.udf(lambda ids: bytearray(np.column_stack([o[ids] for o in of]).astype(np.int32).tobytes()), "binary")
    got = {r.station_id: r.silhouettes for r in K.silhouettes(sinks.cut(made.withColumn("l", label("ids"))), [3, 7, 24]).collect()}
    d, at = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), np.arange(960)
    for j, o in enumerate(of):
        sums = np.stack([d[:, o == c].sum(axis=1) for c in range(o.max() + 1)])
        n = np.bincount(o)[:, None] - (o[None] == np.arange(o.max() + 1)[:, None])
        mean = sums / n
        a = mean[o, at].copy()
        mean[o, at] = np.inf
        b = mean.min(axis=0)
        assert np.abs(np.array([got[i][j] for i in at]) - (b - a) / np.maximum(a, b)).max() < 1e-9, j


def test_feature_table_has_all_columns(spark):
    t = dt.datetime(2024, 1, 1, 8, 10)
    lab = trip_rows(spark, [(1, 3, t, t, 60.0, None, None, "FIT"), (1, 2, t, t + dt.timedelta(hours=30), 90.0, "MALE", 25, "ICONIC")])
    sky = lab.withColumns({c: F.lit(2.5) for c in features.WEATHER_MEANS} | {c: F.lit(True) for c in features.WEATHER_FLAGS})
    centers = spark.createDataFrame([(10, 1.0, 2.0, 2), (20, 3.0, 4.0, 1)], "cluster_id int, lat double, lon double, station_count long")
    whole = features.cluster_features(sky, centers)
    assert len(whole.columns) == 476 and len(set(whole.columns)) == 476
    kept = features.prune_leakage(whole)
    numeric = [c for c in kept.columns if c not in ("cluster_id", "ts_start")]
    assert len(numeric) == 98
    summary = features.node_summary(kept, "cluster_id", numeric, [])
    assert len(summary.columns) - 1 == 196
    rows = {(r.cluster_id, r.ts_start): r for r in whole.where("dep_internal_count + dep_external_count + weather_data_available > 0").collect()}
    slot = rows[10, dt.datetime(2024, 1, 1, 8)]
    assert (slot.dep_internal_count, slot.dep_external_count, slot.dep_internal_precipitation_mean, slot.dep_external_heavy_rain_count, slot.temperature_2m_mean, slot.is_raining) == (1, 1, 2.5, 1, 2.5, 1)
    assert whole.agg(F.max("ts_start")).first()[0] == dt.datetime(2024, 1, 1, 9)
    assert features.cluster_features(sky, centers, late_arrivals=True).agg(F.max("ts_start"), F.sum("arr_internal_count")).first()[:] == (dt.datetime(2024, 1, 2, 15), 1)


def test_a_finished_stage_is_read_again(spark):
    path, built = sinks.scratch(spark), []

    def build():
        built.append(1)
        return spark.range(3)

    for parameters in ({"a": 1}, {"a": 1}, {"a": 2}, {"a": 1}):
        assert sinks.stage(spark, path, parameters, build).count() == 3
    assert len(built) == 2


def test_ranks_by_band_equal_whole_sorts(spark):
    draw = np.random.default_rng(5)
    rows = [(g, float(x)) for g in range(3) for x in np.round(draw.beta(2, 5, 200 if g else 1), 2)]
    got = {r.g: r.max_gap for r in metrics.pit_gap(spark.createDataFrame(rows, "g long, pit double"), "g", "pit").collect()}
    for g in range(3):
        own = np.sort([x for k, x in rows if k == g])
        assert abs(got[g] - np.abs(own - np.linspace(0, 1, len(own))).max()) < 1e-9 if len(own) > 1 else got[g] == own[0]
    keys = spark.createDataFrame([(f"k{i % 700:04}",) for i in range(2000)] + [(None,)], "k string")
    assert [(r.k, r.idx) for r in trips.dense_index(keys, "k").orderBy("k").collect()] == [(f"k{i:04}", i) for i in range(700)]


def test_pairs_of_models_per_entity_and_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i), float(x := rng.uniform()), int(rng.poisson(np.exp(0.5 + x))), int(rng.poisson(np.exp(1 - x)))) for s in ("a", "b") for i in range(400)]
    folded = features.folds(spark.createDataFrame(rows, "station string, ts timestamp_ntz, x double, up long, down long"), "station", "ts", 3)
    made = forecast.poisson_pair_per_entity(folded, "station", "ts", ["x"], "up", "down")
    assert made.count() == 600
    got = forecast.skellam_baseline(made, "up", "down", "station", "fold").collect()
    assert len(got) == 6 and all(r.n_dropped == 0 and r.n == 100 and 0 < r.r2 < 1 and r.max_gap < 0.3 for r in got)


def test_propagation_over_several_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.0), (4, 5.0)], "station_id long, v double")
    a = np.eye(4) + np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]])
    d = np.diag(a.sum(0) ** -0.5)
    want = np.linalg.matrix_power(d @ a @ d, 3) @ [1.0, 0.0, 0.0, 5.0]
    got = {r.station_id: r.v_prop for r in graph.propagate(edges, nodes, "v", 3).collect()}
    assert np.allclose([got[i] for i in (1, 2, 3, 4)], want)


def test_clusters_of_blobs(spark, tmp_path):
    from pyspark.ml.clustering import KMeansModel

    rng = np.random.default_rng(7)
    rows = [(3 * i + b, float(10 * b + x), float(-5 * b + y)) for i in range(20) for b, (x, y) in enumerate(rng.normal(0, 0.1, (3, 2)))]
    points = spark.createDataFrame(rows, "station_id long, lat double, lon double")
    scaled = K.standardize(points, ["lat", "lon"])
    model = K.fit_kmeans(scaled, 3, ["lat_z", "lon_z"], seeds=3, max_iter=20)
    model.write().overwrite().save(path := sinks.scratch(spark))
    found = KMeansModel.load(path).transform(K._vectors(scaled, ["lat_z", "lon_z"])).select("station_id", "prediction").collect()
    assert len({(r.station_id % 3, r.prediction) for r in found}) == 3
    sweep = K.k_sweep(scaled, ["lat_z", "lon_z"], ks=(2, 3, 4, 5, 6, 1000))
    by_k = {r.k: r for r in sweep.collect()}
    assert by_k[2].inertia_norm == 1.0 and by_k[3].silhouette_norm == 1.0 and by_k[3].inertia < 0.1 * by_k[2].inertia
    own = scaled.select("station_id", (F.col("station_id") % 3).alias("cluster_id"), "lat_z", "lon_z")
    assert abs(K.silhouette(own, "lat_z", "lon_z").agg(F.avg("silhouette")).first()[0] - by_k[3].silhouette) < 1e-9
    assert K.k_sweep(scaled.where("false"), ["lat_z", "lon_z"]).count() == 0
    assert sweep.count() == 5 and K.elbow(sweep).first()[0] == 3 and K.best_k(sweep).first()[:] == (3, None, None)
    unseen = K.standardize_by(points.where("station_id < 30"), points, ["lat", "lon"])
    assert abs(unseen.where("station_id < 30").agg(F.avg("lat_z")).first()[0]) < 1e-9 and abs(unseen.agg(F.avg("lat_z")).first()[0]) < 1


def test_kmeans_fits_points_of_one_file_on_all_cores(spark, monkeypatch):
    seen, fit = [], K.KMeans.fit
    monkeypatch.setattr(K.KMeans, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    points = spark.range(0, 200, 1, 1).select((F.col("id") % 2 * 9.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert K.fit_kmeans(points, 2, ["a", "b"], seeds=2, max_iter=5).getK() == 2
    assert seen == [spark.sparkContext.defaultParallelism] * 2


def test_forecasts_of_known_series(spark):
    rng = np.random.default_rng(8)
    x, noise = rng.uniform(0, 1, 800), rng.uniform(0, 1, 800)
    rows = [(i, float(a) if i % 50 else None, float(b), float(10 * (a > 0.5)), int(rng.poisson(np.exp(1 + a)))) for i, (a, b) in enumerate(zip(x, noise))]
    df = spark.createDataFrame(rows, "i long, x double, z double, y double, n long")
    train, test = df.where("i < 600"), df.where("i >= 600")
    made, ranked = forecast.gbt_forecast(train, test, ["x", "z"], "y", 5)
    assert ranked.first().feature == "x" and made.count() == 200  # missing features lose no row
    assert made.where("x IS NOT NULL").agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.5
    gated = forecast.activity_gate(train, test, ["x", "z"], "y").where("x IS NOT NULL").collect()
    assert np.mean([r.gated == (r.y > 0) for r in gated]) > 0.97 and all(r.forecast == 0 for r in gated if not r.gated) and all(r.forecast > 5 for r in gated if r.gated)
    mean = forecast.poisson_global(train, test, ["x", "z"], "n").where("x IS NOT NULL").collect()
    assert np.mean([abs(r.n_mean - np.exp(1 + r.x)) for r in mean]) < 0.35


def test_samples_are_stable_and_even(spark):
    df = spark.range(10_000)
    once, again = (trips.sample_rows(d, F.col("id"), 20, seed=42) for d in (df, df.repartition(3)))
    assert {r.id for r in once.collect()} == {r.id for r in again.collect()} and 1_800 < once.count() < 2_200
    split = {r.split: r["count"] for r in trips.split_hash(df, F.col("id"), seed=1).groupBy("split").count().collect()}
    assert abs(split["train"] - 6_000) < 300 and abs(split["val"] - 2_000) < 200
    assert trips.guard_targets(df.selectExpr("id % 2 AS k", "id AS y"), "k", "y", 9_998).where("rejected").first().k == 1


def test_neighbours_lag_over_empty_slots(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "src long, dst long")
    series = spark.createDataFrame([(2, day(1), 5), (2, day(4), 7), (1, day(2), 3), (9, day(5), 1)], "station_id long, ts_start timestamp_ntz, n long")
    got = {(r.station_id, r.ts_start.day): (r.near_n, r.near_n_lag_1) for r in graph.neighbor_demand(edges, series, "n").collect()}
    assert [got[1, d] for d in range(1, 6)] == [(5, 0), (0, 5), (0, 0), (7, 0), (0, 7)]
    assert [got[2, d][0] for d in range(1, 6)] == [0, 3, 0, 0, 0] and got[3, 5] == (0, 0) and len(got) == 15


def test_both_ends_of_trips_are_counted(spark):
    t = dt.datetime(2024, 1, 1, 8, 10)
    lab = trip_rows(spark, [(1, 3, t, t + dt.timedelta(hours=1), 60.0, "OTHER", None, "FIT"), (1, None, t, None, 90.0, None, 25, "ICONIC")])
    got = {(r.station_id, r.ts_start.hour): r for r in trips.station_slots(lab, "30 minutes").collect()}
    assert set(got) == {(1, 8), (3, 9)}
    left, came = got[1, 8], got[3, 9]
    assert (left.dep_last_dt, left.arr_last_dt, left.trip_dur_mean_last_dt, left.model_fit_cnt, left.model_iconic_cnt, left.share_other, left.share_male) == (2, 0, 75.0, 1, 1, 0.5, 0.0)
    assert (came.dep_last_dt, came.arr_last_dt, came.trip_dur_mean_last_dt, came.model_fit_cnt, came.share_other) == (0, 1, None, 0, None)


def test_a_batch_that_is_run_again_replaces_itself(spark):
    at = sinks.scratch(spark)
    t = dt.datetime(2024, 1, 1)
    rows = lambda n: spark.createDataFrame([("a", t, n)], "k string, ts_start timestamp_ntz, n long")
    put = slots.put(f"{at}/t")
    put(rows(1), 0), put(rows(2), 0)
    table = lambda: [r.n for r in slots.closed_slots(spark, f"{at}/t", rows(0).schema, ["k", "ts_start"]).collect()]
    assert table() == [2]
    put(rows(3), 1)
    assert table() == [3]  # the latest batch has the last word


def test_a_failed_stream_goes_on_where_it_stood(spark):
    at, calls = sinks.scratch(spark), []
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(120)]
    rows = spark.createDataFrame([(t, "a", 1.0, i // 40) for i, t in enumerate(times)], "ts timestamp_ntz, event_type string, value double, batch int")
    slots.arrive(rows, f"{at}/in", "batch", range(3))
    counted = slots.slot_counts(slots.watch(spark, f"{at}/in", rows.drop("batch").schema), "ts", "event_type")
    put = slots.put(f"{at}/t")

    def sink(df, number):
        calls.append(number)
        put(df, number)
        if calls.count(1) == 1 and number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        slots.keep(counted, lambda df, number: sink(df, number), f"{at}/check", retries=0)
    slots.keep(counted, sink, f"{at}/check")
    assert calls.count(1) == 2 and calls.count(0) == 1
    table = slots.closed_slots(spark, f"{at}/t", counted.schema, ["event_type", "ts_start"])
    last = times[-1] - dt.timedelta(minutes=10)
    closed = [t for t in times if (t - dt.datetime(2024, 1, 1)) // dt.timedelta(minutes=30) * dt.timedelta(minutes=30) + dt.timedelta(minutes=30) <= last - dt.datetime(2024, 1, 1)]
    assert table.agg(F.sum("n")).first()[0] == len(closed)
    lagged = {r.ts_start: (r.n, r.n_lag_1, r.n_lag_2) for r in slots.slot_lags(table.where(F.col("ts_start") != dt.datetime(2024, 1, 1, 1)), "event_type", "n", (1, 2)).collect()}
    assert lagged[dt.datetime(2024, 1, 1, 1)][0] == 0 and lagged[dt.datetime(2024, 1, 1, 1, 30)][1:] == (0, lagged[dt.datetime(2024, 1, 1, 0, 30)][0])


@pytest.mark.parametrize("both_ways", [True, False])
def test_reach_equals_breadth_first_search(spark, both_ways):
    draw = np.random.default_rng(9)
    pairs = {(int(a), int(b)) for a, b in draw.integers(0, 60, (80, 2))} | {(i, i + 1) for i in range(60, 75)}
    pairs |= {(b, a) for a, b in pairs} if both_ways else set()
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = set()
    for start in out:
        seen, front = {start}, {start}
        for step in range(1, 7):
            front = {b for a in front for b in out.get(a, ())} - seen
            seen |= front
            want |= {(start, b, step) for b in front}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = graph.reach(edges.unionAll(edges), 6)
    assert {tuple(r) for r in got.collect()} == want
    plans = [graph.reach(edges, hops)._jdf.queryExecution().optimizedPlan().toString().count("Join") for hops in (2, 6)]
    assert plans == [0, 0]
    assert graph.reach(edges.where("false"), 3).count() == 0


def test_ranks_are_exact_without_large_buffers(spark, monkeypatch):
    draw = np.random.default_rng(10)
    nan, inf = float("nan"), float("inf")
    columns = {
        "normal": [float(x) for x in draw.normal(size=3001)], "ties": [float(x) for x in draw.integers(0, 2, 3001)], "steep": [float(x) for x in 10.0 ** draw.uniform(-300, 300, 3001)],
        "one": [7.0] * 3001, "odd": [nan if i % 3 == 0 else inf if i % 3 == 1 else -inf for i in range(3001)], "nulls": [None if i % 2 else float(i) for i in range(3001)], "none": [None] * 3001,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    for few, accuracy in ((10_000, 10_000), (20, 100), (0, 50)):
        monkeypatch.setattr(metrics, "FEW", few)
        monkeypatch.setattr(metrics, "ACCURACY", accuracy)
        for c, values in columns.items():
            if few == 0 and c not in ("normal", "ties", "one"):
                continue
            known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
            ranks = sorted({0, len(known) // 4, (len(known) - 1) // 2, len(known) // 2, max(0, len(known) - 1)}) if known else []
            got = metrics.at_ranks(df, {c: ranks})[c]
            assert str(got) == str([known[r] for r in ranks]), (c, few)
    got = {r.column_name: r for r in metrics.describe(df, ["normal", "nulls", "none", "one"]).collect()}
    assert got["normal"].median == sorted(columns["normal"])[1500] and got["nulls"].median == 1500.0 and got["none"].median is None and got["one"].std < 1e-12


def test_sketches_merge_over_any_range(spark):
    rows = spark.range(40_000).select((F.col("id") % 20).alias("slot"), (F.col("id") * 7 % 15_000).alias("user"))
    sketches = metrics.slot_sketches(rows, F.col("slot"), "user")
    assert abs(metrics.distinct_over(sketches).first().n - 15_000) < 5 * 1.04 / 2**7 * 15_000
    some = rows.where("slot < 5").select("user").distinct().count()
    assert abs(metrics.distinct_over(sketches.where("slot < 5")).first().n - some) < 5 * 1.04 / 2**7 * some
    assert metrics.distinct_over(sketches.where("false")).first().n == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [10_000, 3])
def test_samples_have_exactly_as_many_rows(spark, monkeypatch, few):
    monkeypatch.setattr(trips, "FEW", few)
    df = spark.range(3_000).select((F.col("id") % 1_000).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("v")).unionAll(spark.range(700).select(F.lit(5).alias("k"), F.lit(1).alias("v")))
    hashed = trips.seeded_hash(1, F.col("k"))
    for n in (0, 1, 10, 1_234, 3_699, 3_700, 9_999):
        once, again = (sorted(map(str, trips.sample_exactly(d, n, hashed).collect())) for d in (df, df.repartition(7)))
        assert len(once) == min(n, 3_700) and once == again
    least = sorted((r.h, r.k) for r in df.select(hashed.alias("h"), "k").collect())
    assert sorted(r.k for r in trips.sample_exactly(df, 1_000, hashed).collect()) == sorted(k for _, k in least[:1_000])
    assert trips.sample_exactly(df, 50, trips.seeded_hash(2, F.col("k"))).exceptAll(trips.sample_exactly(df, 50, hashed)).count() > 0


def test_skellam_far_out_stays_small(spark):
    import tracemalloc

    d = np.concatenate([[10**6, -(10**6), 0, 3], np.arange(9_996) % 50 - 25]).astype(float)
    a, b = np.full(10_000, 40.0), np.full(10_000, 60.0)
    tracemalloc.start()
    got = E._skellam_log(d, a, b)
    below = E._skellam_below(d, a, b)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert np.isfinite(got).all() and got[0] < -1e6 and below[0] > 1 - 1e-12 and below[1] == 0.0
    span = np.arange(-400, 400.0)
    mass = np.exp(E._skellam_log(span, np.full(800, 40.0), np.full(800, 60.0)))
    mean = (mass * span).sum()
    assert abs(mass.sum() - 1) < 1e-12 and abs(mean + 20) < 1e-9 and abs((mass * (span - mean) ** 2).sum() - 100) < 1e-8
    assert np.abs(E._skellam_below(span, np.full(800, 40.0), np.full(800, 60.0)) - np.cumsum(mass)).max() < 1e-12
    # one count without the other is Poisson; large means need no larger buffers
    assert abs(E._skellam_log(np.array([4.0]), np.array([3.0]), np.array([1e-300]))[0] - (4 * np.log(3) - 3 - np.log(24))) < 1e-12
    assert abs(np.exp(E._skellam_log(np.array([0.0]), np.array([1e5]), np.array([1e5]))[0]) * np.sqrt(2 * np.pi * 2e5) - 1) < 1e-5
    assert abs(E._skellam_below(np.array([0.0]), np.array([1e5]), np.array([1e5]))[0] - 0.5) < 1e-3


def test_sorted_tables_spare_shuffles_and_sorts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"c{i % 9}", t + dt.timedelta(minutes=30 * (i // 9)), i) for i in range(900)]
    grid = sinks.sorted_table(spark.createDataFrame(rows, "cluster_id string, ts_start timestamp_ntz, n long").repartition(5), ["cluster_id"], ["ts_start"])
    lagged = features.add_lags(grid, ["n"])
    other = sinks.sorted_table(grid.select("cluster_id", "ts_start", (F.col("n") + 1).alias("m")), ["cluster_id"], ["ts_start"])
    both = lagged.join(other.hint("merge"), ["cluster_id", "ts_start"])
    for df in (lagged, both):
        assert "Exchange" not in plan_of(df) and "Sort " not in plan_of(df)
    got = {(r.cluster_id, r.ts_start): r for r in both.collect()}
    assert len(got) == 900 and all(got[c, ts].n_lag_1 == (n - 9 if n >= 9 else 0) and got[c, ts].m == n + 1 for c, ts, n in rows)


def test_centres_are_met_in_place(spark):
    rng = np.random.default_rng(11)
    xy, cxy = rng.normal(size=(200, 2)), rng.normal(size=(30, 2))
    cxy[7] = cxy[3]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(900, None, 1.0)], "station_id long, lat double, lon double")
    centers = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cxy)] + [(None, 0.0, 0.0)], "cluster_id int, lat double, lon double")
    near = K.assign(points, centers)
    assert "Exchange" not in plan_of(near)
    d2 = ((xy[:, None] - cxy[None]) ** 2).sum(-1)
    got = {r.station_id: r for r in near.collect()}
    assert all(got[i].assigned == d2[i].argmin() and abs(got[i].d2 - d2[i].min()) < 1e-12 for i in range(200)) and got[900].assigned is None
    assert K.assign(points, centers.where("false")).count() == 0


def test_run_metadata_counts_as_it_writes(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS v")
    centers = spark.createDataFrame([(2, 1.5, 2.5, 3), (1, 0.5, 0.25, 4)], "cluster_id long, lat double, lon double, station_count long")
    row = sinks.write_with_metadata(df, at := sinks.scratch(spark), "features", {"b": 1, "a": [2]}, centers).first()
    assert (row.stage, row.parameters, row.n_rows, row.n_columns, row.columns) == ("features", '{"a": [2], "b": 1}', 50, 2, "id,v")
    assert [tuple(c) for c in row.centroids] == [(1, 0.5, 0.25, 4), (2, 1.5, 2.5, 3)] and spark.read.parquet(f"{at}/data").count() == 50


def test_crowded_places_are_searched_once(spark):
    rng = np.random.default_rng(12)
    spread = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.2, 0.2, (20_000, 2)))], "station_id long, lat double, lon double")
    one = spark.range(20_000, 40_000).select(F.col("id").alias("station_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    got = graph.knn_pairs(spread.unionByName(one), 5, 5.0)
    counted = got.where("src >= 20000").groupBy("src").agg(F.collect_set("dst").alias("d"), F.max("km").alias("km")).collect()
    assert got.count() == 200_000 and len(counted) == 20_000
    assert all(r.km == 0.0 and set(r.d) == set(range(20_000, 20_006)) - {r.src} if r.src < 20_006 else set(r.d) == set(range(20_000, 20_005)) for r in counted)
