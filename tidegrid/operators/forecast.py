"""Poisson pairs, Skellam net flow, boosted trees and the activity gate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import metrics as M


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features count as 0, so no row is lost."""
    whole = df.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(whole)


def poisson_global(train: DataFrame, test: DataFrame, features: list[str], target: str, penalty: float = 1e-4) -> DataFrame:
    """``test`` with ``<target>_mean`` from a Poisson regression with log link."""
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol=target, regParam=penalty, predictionCol=f"{target}_mean").fit(_assembled(train, features))
    return model.transform(_assembled(test, features)).drop("features")


def _irls(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.mean(), 1e-6))
    ridge = penalty * len(x) * np.eye(x.shape[1])
    ridge[0, 0] = 1e-9
    for _ in range(rounds):
        mean = np.exp(np.clip(x @ beta, -20, 20))
        step = np.linalg.solve(x.T @ (x * mean[:, None]) + ridge, x.T @ (y - mean) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def poisson_per_entity(df: DataFrame, entity: str, features: list[str], target: str, penalty: float = 1e-4) -> DataFrame:
    """One Poisson model per entity over its slots: ``entity, n, intercept, weights, deviance, failed``.

    A group is one entity's slots, whose number the calendar bounds, not the trips.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[features].to_numpy(float), rows[target].to_numpy(float)
        key = rows[entity].iloc[0]
        try:
            beta = _irls(x, y, penalty)
            mean = np.exp(np.clip(np.column_stack([np.ones(len(x)), x]) @ beta, -20, 20))
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(y > 0, y * np.log(y / mean), 0.0)
            out = (key, len(y), float(beta[0]), beta[1:].tolist(), float(2 * (part - (y - mean)).sum()), None)
        except np.linalg.LinAlgError as e:
            out = (key, len(y), None, None, None, str(e))
        return pd.DataFrame([out], columns=[entity, "n", "intercept", "weights", "deviance", "failed"])

    kind = dict(df.dtypes)[entity]
    return df.select(entity, *features, target).groupBy(entity).applyInPandas(fit, f"{entity} {kind}, n long, intercept double, weights array<double>, deviance double, failed string")


def poisson_pair_per_entity(folded: DataFrame, entity: str, ts: str, features: list[str], up: str, down: str, penalty: float = 1e-4) -> DataFrame:
    """``entity, ts, fold, up, down, <up>_mean, <down>_mean, failed`` of every test row of ``fold, role``.

    One pair of models for each entity and fold, fitted on the fold's train rows;
    a group is one entity's slots in one fold, whose number the calendar bounds.
    A failed fit gives null means and says why.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        train, test = rows[rows.role == "train"], rows[rows.role == "test"]
        out = test[[entity, ts, "fold", up, down]].copy()
        out["failed"] = None
        for target in (up, down):
            try:
                beta = _irls(train[features].to_numpy(float), train[target].to_numpy(float), penalty)
                out[f"{target}_mean"] = np.exp(np.clip(np.column_stack([np.ones(len(test)), test[features].to_numpy(float)]) @ beta, -20, 20))
            except (np.linalg.LinAlgError, ValueError) as e:
                out[f"{target}_mean"], out["failed"] = np.nan, str(e)
        return out[[entity, ts, "fold", up, down, f"{up}_mean", f"{down}_mean", "failed"]]

    kinds = dict(folded.dtypes)
    made = f"{entity} {kinds[entity]}, {ts} {kinds[ts]}, fold int, {up} {kinds[up]}, {down} {kinds[down]}, {up}_mean double, {down}_mean double, failed string"
    slim = folded.select(entity, ts, "fold", "role", *features, up, down).na.fill(0.0, features)
    return slim.groupBy(entity, "fold").applyInPandas(fit, made)


def skellam_baseline(forecast: DataFrame, up: str, down: str, *by: str) -> DataFrame:
    """Per group: errors of the net flow, its log-likelihood and PIT gap, and how many rows the intensity guard dropped."""
    guarded = guard_intensity(forecast, f"{up}_mean", f"{down}_mean").withColumns({"_delta": F.col(up) - F.col(down), "_up": F.col(f"{up}_mean"), "_down": F.col(f"{down}_mean"), "_mean": F.col(f"{up}_mean") - F.col(f"{down}_mean")})
    dropped = guarded.groupBy(*by).agg(F.count_if(~F.col("usable")).alias("n_dropped"))
    used = guarded.where("usable").withColumns({"_lp": E.skellam_logpmf(F.col("_delta"), F.col("_up"), F.col("_down")), "_pit": E.skellam_cdf(F.col("_delta"), F.col("_up"), F.col("_down"))})
    used = used.withColumn("_unit", F.concat_ws("|", *(F.col(c).cast("string") for c in by)))
    errors = M.regression_metrics(used, "_delta", "_mean", *by, "_unit")
    likely = used.groupBy("_unit").agg(F.sum("_lp").alias("loglik"))
    return dropped.join(errors.join(likely, "_unit").join(M.pit_gap(used, "_unit", "_pit"), "_unit"), list(by), "left").drop("_unit")


def net_flow(df: DataFrame, up: str, down: str) -> DataFrame:
    """Mean and variance of the difference of two Poisson counts."""
    return df.withColumns({"net_mean": F.col(up) - F.col(down), "net_var": F.col(up) + F.col(down)})


def guard_intensity(df: DataFrame, up: str, down: str, most: float = 100.0) -> DataFrame:
    """Marks the rows whose means are usable: positive and at most ``most``."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) <= most)
    return df.withColumn("usable", fine(up) & fine(down))


def gbt_forecast(train: DataFrame, test: DataFrame, features: list[str], target: str, trees: int = 20) -> tuple[DataFrame, DataFrame]:
    """``test`` with ``prediction``, and the features by importance; a tenth of the rows, by the hash of all their columns, stops the training early."""
    marked = train.withColumn("_validate", F.pmod(F.xxhash64(*train.columns), F.lit(10)) == 0)
    model = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=4, seed=42, validationIndicatorCol="_validate").fit(_assembled(marked, features))
    weights = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    ranked = test.sparkSession.createDataFrame(weights, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(10)
    return model.transform(_assembled(test, features)).drop("features"), ranked


def activity_gate(train: DataFrame, test: DataFrame, features: list[str], target: str, threshold: float = 0.5) -> DataFrame:
    """Whether a slot is active, and a forecast that is 0 where it isn't: ``p_active, gated, forecast``."""
    label = lambda df: df.withColumn("_active", (F.col(target) > 0).cast("double"))
    model = GBTClassifier(labelCol="_active", maxIter=10, maxDepth=3, seed=42).fit(_assembled(label(train), features))
    scored = model.transform(_assembled(test, features))
    active = train.where(F.col(target) > 0)
    level = GBTRegressor(labelCol=target, predictionCol="_level", maxIter=10, maxDepth=3, seed=42).fit(_assembled(active, features))
    gated = level.transform(scored).withColumn("p_active", vector_to_array("probability")[1]).withColumn("gated", F.col("p_active") > threshold)
    return gated.withColumn("forecast", F.when(F.col("gated"), F.greatest("_level", F.lit(0.0))).otherwise(0.0)).drop("features", "rawPrediction", "probability", "prediction", "_level")
