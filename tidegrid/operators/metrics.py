"""Quality metrics as aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """mse, rmse, mae, r2; r2 is 0 where the target is constant."""
    e = F.col(y) - F.col(p)
    g = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("res"), (F.var_pop(y) * F.count("*")).alias("tot"), F.count("*").alias("n"))
    return g.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", F.coalesce(1 - F.try_divide("res", F.nullif("tot", F.lit(0.0))), F.lit(0.0)).alias("r2"))


def classification_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined), and AUC by average ranks; scores lie in 0..1."""
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = df.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    # running sums inside 1024 bands of the score, and over the bands' totals
    per = df.groupBy(score).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")).withColumn("band", F.floor(F.col(score) * 1024))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = per.groupBy("band").agg(F.sum("n").alias("n")).select("band", before(Window.orderBy("band")).alias("under"))
    below = before(Window.partitionBy("band").orderBy(score)) + F.col("under")
    auc = per.join(bands, "band").withColumn("area", F.col("p") * (below + F.col("n") / 2)).agg(rate(F.sum("area"), F.sum("p") * F.sum("n")).alias("auc"))
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    m = counts.crossJoin(auc).select(((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), "auc")
    return m.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def pinball(df: DataFrame, y: str, p: str, q: float) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(F.avg(F.greatest(q * e, (q - 1) * e)).alias("pinball"))


def fold_summary(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.count(metric).alias("n"))


def weighted_compare(df: DataFrame, mae: str, rmse: str, weight: str, global_mae: float, global_rmse: float) -> DataFrame:
    """Weighted and plain means of per-station errors, and the gain over global ones in per cent."""
    w = lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(weight)
    m = df.agg(w(mae).alias("weighted_mae"), w(rmse).alias("weighted_rmse"), F.avg(mae).alias("mean_mae"), F.avg(rmse).alias("mean_rmse"))
    return m.withColumns({"gain_mae_pct": 100 * (global_mae - F.col("weighted_mae")) / global_mae, "gain_rmse_pct": 100 * (global_rmse - F.col("weighted_rmse")) / global_rmse})


def pit_gap(df: DataFrame, by: str, pit: str) -> DataFrame:
    """Largest distance of a group's sorted PIT values, which lie in 0..1, from an even spread over 0..1; a single value is compared with 0.

    Equal values are counted first. Ranks are running sums inside 1024 bands of
    the value, on top of the bands' totals, so no task sorts a whole group.
    """
    per = df.groupBy(by, pit).agg(F.count("*").alias("c")).withColumn("band", F.floor(F.col(pit) * 1024))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = per.groupBy(by, "band").agg(F.sum("c").alias("total"))
    bands = bands.select(F.col(by).alias("_by"), F.col("band").alias("_band"), before(Window.partitionBy(by).orderBy("band"), "total").alias("under"), F.sum("total").over(Window.partitionBy(by)).alias("n"))
    joined = per.join(bands, per[by].eqNullSafe(bands["_by"]) & per["band"].eqNullSafe(bands["_band"]))
    first = F.col("under") + before(Window.partitionBy(by, "band").orderBy(pit), "c")
    gap = lambda rank: F.abs(F.col(pit) - F.coalesce(F.try_divide(rank, F.col("n") - 1), F.lit(0.0)))
    placed = joined.withColumn("first", first)
    return placed.groupBy(by).agg(F.max(F.greatest(gap(F.col("first")), gap(F.col("first") + F.col("c") - 1))).alias("max_gap"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls of each column and their percentage, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot(["_n"], df.columns, "column_name", "n_null").select("column_name", "n_null", F.round(100.0 * F.col("n_null") / F.col("_n"), 4).alias("pct_null"))


#: Values of a column that the driver takes at most, to find a rank among them; accuracy of the quantiles that narrow them down.
FEW, ACCURACY = 10_000, 10_000


@dataclass
class _Probe:
    """A rank sought among the ``n`` values of a column that lie between two bounds; None is no bound."""

    column: str
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        v = F.col(self.column)
        found = v.isNotNull() & ~F.isnan(v)
        found = found if self.low is None else found & (v > self.low)
        return found if self.high is None else found & (v < self.high)


def at_ranks(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    """The exact values at ranks (from 0) of double columns; nulls aren't counted, NaN comes last, a rank beyond the end gives NaN.

    A pass finds quantiles on both sides of each rank, the next counts what lies
    below, at and between them: a ten-thousandth or so of the values is left, until
    the driver can take the rest. No buffer grows with the rows or their distinct
    values, and equal values, however many, are settled by their count.
    """
    columns = list(ranks)
    numbers = df.agg(*(F.count_if(_Probe(c, 0, 0).inside()).alias(c) for c in columns)).first()
    probes = [_Probe(c, r, numbers[c], value=None if r < numbers[c] else float("nan")) for c in columns for r in ranks[c]]
    while many := [p for p in probes if p.value is None and p.n > FEW]:
        margin = lambda p: [max(0.0, p.rank / p.n - 2 / ACCURACY), min(1.0, p.rank / p.n + 2 / ACCURACY)]
        ends = df.agg(*(F.percentile_approx(F.when(p.inside(), F.col(p.column)), margin(p), ACCURACY).alias(f"_{i}") for i, p in enumerate(many))).first()
        counts = []
        for i, p in enumerate(many):
            v, (a, b) = F.col(p.column), ends[f"_{i}"]
            counts += [F.count_if(p.inside() & c).alias(f"_{name}{i}") for name, c in (("lt", v < a), ("a", v == a), ("in", (v > a) & (v < b)), ("b", (v == b) & (v > a)))]
        seen = df.agg(*counts).first()
        for i, p in enumerate(many):
            below, at_a, between, at_b = (seen[f"_{name}{i}"] for name in ("lt", "a", "in", "b"))
            a, b = ends[f"_{i}"]
            if p.rank < below:
                p.n, p.high = below, a
            elif p.rank < below + at_a:
                p.value = a
            elif p.rank < below + at_a + between:
                p.rank, p.n, p.low, p.high = p.rank - below - at_a, between, a, b
            elif p.rank < below + at_a + between + at_b:
                p.value = b
            else:
                p.rank, p.n, p.low = p.rank - below - at_a - between - at_b, p.n - below - at_a - between - at_b, b
    few = [p for p in probes if p.value is None]
    if few:
        each = F.array(*(F.when(p.inside(), F.struct(F.lit(i).alias("probe"), F.col(p.column).alias("v"))) for i, p in enumerate(few)))
        held: dict[int, list[float]] = {}
        for probe, v in df.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*").collect():
            held.setdefault(probe, []).append(v)
        for i, p in enumerate(few):
            p.value = sorted(held[i])[p.rank]
    out: dict[str, list[float]] = {c: [] for c in columns}
    for p in probes:
        out[p.column].append(p.value)
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, min, max, mean, median, std`` of each column; the medians exact, by ``at_ranks``. Columns without values have nulls."""
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    counts = doubles.agg(*(F.count(c).alias(c) for c in columns)).first()
    found = at_ranks(doubles, {c: [(counts[c] - 1) // 2, counts[c] // 2] for c in columns if counts[c]})
    median = {c: F.lit((a + b) / 2 if a != b else a) for c, (a, b) in found.items()}
    of = lambda c: F.struct(F.lit(c).alias("column_name"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), median.get(c, F.lit(None).cast("double")).alias("median"), F.stddev_samp(c).alias("std"))
    return doubles.agg(F.array(*map(of, columns)).alias("all")).select(F.inline("all"))


def slot_sketches(df: DataFrame, slot: Column, value: str, precision: int = 14) -> DataFrame:
    """``slot, sketch``: what each slot needs to be counted with any others, a few kilobytes whatever it holds."""
    return df.groupBy(slot.alias("slot")).agg(F.hll_sketch_agg(value, F.lit(precision)).alias("sketch"))


def distinct_over(sketches: DataFrame, *by: Column) -> DataFrame:
    """``n``: distinct values over the slots of each group, from the sketches alone; the standard error is about 1.04 / 2 ** (precision / 2)."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
