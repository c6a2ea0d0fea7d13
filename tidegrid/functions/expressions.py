"""Scalar expressions; all native columns but the Skellam forms, which run on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres.
EARTH_RADIUS = 6371.0
#: Ages of the bins, both ends included.
AGE_BINS = {"young": (0, 25), "adult": (26, 55), "senior": (56, 120)}


def flag(condition: Column) -> Column:
    return condition.cast("int")


def slot(ts, width: str = "30 minutes") -> Column:
    return F.window(ts, width)["start"]


def iso_weekday(ts) -> Column:
    """1 is Monday, 7 Sunday."""
    return F.weekday(ts) + 1


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * np.pi / period)
    return F.sin(angle), F.cos(angle)


def calendar(ts: str = "ts_start") -> list[Column]:
    """Hour, ISO weekday, month, year, their cycles, and the day-part flags (ranges inclusive)."""
    hour, dow, month = F.hour(ts), iso_weekday(ts), F.month(ts)
    out = [hour.alias("hour_of_day"), dow.alias("day_of_week"), month.alias("month"), F.year(ts).alias("year")]
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        sin, cos = cyclic(value, period)
        out += [sin.alias(f"{name}_sin"), cos.alias(f"{name}_cos")]
    flags = {"is_weekend": dow.isin(6, 7), "is_morning_rush": hour.between(7, 9), "is_evening_rush": hour.between(17, 19), "is_daytime": hour.between(6, 22), "is_summer": month.isin(12, 1, 2), "is_winter": month.between(6, 8)}
    return out + [flag(c).alias(name) for name, c in flags.items()]


def business_flags(ts: str = "ts_start") -> list[Column]:
    """Pay days (the first five of a month), the vacation season (January, February, July), and rush hours of working days."""
    rush = (F.hour(ts).between(7, 9) | F.hour(ts).between(17, 19)) & ~iso_weekday(ts).isin(6, 7)
    return [flag(F.dayofmonth(ts) <= 5).alias("payday_flag"), flag(F.month(ts).isin(1, 2, 7)).alias("vacation_season"), flag(rush).alias("peak_commute")]


def weather_flags(temperature: str = "temperature_2m", feels: str = "apparent_temperature", rain: str = "precipitation", wind: str = "wind_speed_10m") -> list[Column]:
    """Bands of temperature (10, 15 to 25, 30 degrees), rain (4 mm) and wind (20, 40 km/h), how much colder or warmer it feels, and a comfort index of 0 to 3."""
    t, r, w = F.col(temperature), F.col(rain), F.col(wind)
    mild, dry, calm = t.between(15, 25), r <= 0, w < 20
    bands = {"temp_very_hot": t > 30, "temp_cold": t < 10, "temp_comfortable": mild, "is_raining": r > 0, "heavy_rain": r > 4, "light_rain": (r > 0) & (r <= 4), "moderate_wind": (w >= 20) & (w < 40), "strong_wind": w >= 40}
    return [flag(c).alias(name) for name, c in bands.items()] + [(F.col(feels) - t).alias("temp_feel_diff"), (flag(mild) + flag(dry) + flag(calm)).alias("weather_comfort")]


def age_flags(age: Column) -> list[Column]:
    """A null age falls in no bin."""
    known = F.coalesce(age.isNotNull(), F.lit(False))
    return [flag(F.coalesce(age.between(*b), F.lit(False))).alias(f"age_{name}") for name, b in AGE_BINS.items()] + [flag(known).alias("age_known")]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def sanitized(value: Column, least: float | None = None) -> Column:
    """NaN and infinities become 0; ``least`` clamps from below."""
    clean = F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    return clean if least is None else F.greatest(clean, F.lit(least))


def _once(function, d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The function of each distinct triple, once."""
    rows = np.column_stack([d.to_numpy(float), a.to_numpy(float), b.to_numpy(float)])
    each, at = np.unique(rows, axis=0, return_inverse=True)
    return pd.Series(function(each[:, 0], each[:, 1], each[:, 2])[at.ravel()])


def _skellam_log(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log mass of the difference d of two Poisson counts with means a and b.

    The terms of the joint mass, beginning with the least counts that differ by d,
    follow from one another by a ratio; a row holds the last one and their sum
    alone, however large d is.
    """
    n, most = np.abs(d), np.where(d >= 0, a, b)
    sizes, at = np.unique(n, return_inverse=True)
    log_factorial = np.array([math.lgamma(x + 1) for x in sizes])[at.ravel()]
    product, total, term, scale = a * b, np.ones(len(d)), np.ones(len(d)), np.zeros(len(d))
    k = 0
    while (term > 1e-18 * total).any():
        k += 1
        term = term * (product / (k * (n + k)))
        total = total + term
        if k % 16 == 0:  # before they overflow
            high = np.maximum(total, 1.0)
            term, total, scale = term / high, total / high, scale + np.log(high)
    with np.errstate(divide="ignore"):
        return n * np.log(most) - log_factorial - a - b + np.log(total) + scale


def _poisson(mean: float) -> tuple[int, np.ndarray]:
    """The least count that matters, and the masses from there on."""
    spread = 12 * math.sqrt(mean)
    low, high = max(0, int(mean - spread - 30)), int(mean + spread + 60)
    k = np.arange(low, high + 1)
    logs = k * math.log(mean) - mean - math.lgamma(low + 1) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return low, np.exp(logs)


def _skellam_below(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mass at or below d: the two counts' masses are folded once for each pair of means."""
    out = np.zeros(len(d))
    pairs, at = np.unique(np.column_stack([a, b]), axis=0, return_inverse=True)
    for i, (up, down) in enumerate(pairs):
        (low_up, mass_up), (low_down, mass_down) = _poisson(up), _poisson(down)
        below = np.cumsum(np.convolve(mass_up, mass_down[::-1]))
        own = at.ravel() == i
        place = d[own] - (low_up - low_down - len(mass_down) + 1)
        out[own] = np.where(place < 0, 0.0, below[np.clip(place, 0, len(below) - 1).astype(np.int64)])
    return np.minimum(1.0, out)


def skellam_logpmf(d: Column, mean_up: Column, mean_down: Column) -> Column:
    """Means are positive."""

    @F.pandas_udf("double")
    def udf(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _once(_skellam_log, d, a, b)

    return udf(d, mean_up, mean_down)


def skellam_cdf(d: Column, mean_up: Column, mean_down: Column) -> Column:
    @F.pandas_udf("double")
    def udf(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _once(_skellam_below, d, a, b)

    return udf(d, mean_up, mean_down)
