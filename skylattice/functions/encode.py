"""Column expressions for features, weights, quality flags and stable identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(value: Column, flags: Column, excluded: list[str]) -> Column:
    """A reading counts unless it is missing or not finite, or carries an excluded flag."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return finite & ~F.arrays_overlap(flags, F.array(*[F.lit(f) for f in excluded]))


def cyclic_features(at: Column, mean: Column, median: Column, coverage: Column, centres: tuple[float, float], scales: tuple[float, float]) -> dict[str, Column]:
    """Seven inputs of a forecaster: scaled log values, coverage in [-1, 1], hour of day and day of year on circles."""
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    hour = 2 * math.pi * seconds / 86400
    leap = (F.year(at) % 4 == 0) & ((F.year(at) % 100 != 0) | (F.year(at) % 400 == 0))
    year = 2 * math.pi * (F.dayofyear(at) - 1 + seconds / 86400) / F.when(leap, 366).otherwise(365)
    return {
        "log_mean": (F.log1p(mean) - centres[0]) / scales[0], "log_median": (F.log1p(median) - centres[1]) / scales[1], "cover": coverage * 2 - 1,
        "sin_hour": F.sin(hour), "cos_hour": F.cos(hour), "sin_year": F.sin(year), "cos_year": F.cos(year),
    }


def stable_id(prefix: str, *keys: Column, length: int = 24) -> Column:
    """prefix-hash of the keys' texts, joined by the unit separator."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256), 1, length))


def support_weight(value: Column, observed: Column, in_time: Column, in_space: Column) -> Column:
    """1 for observed, 0.5 for interpolated in time, less 15 % if interpolated in space; 0 where missing."""
    weight = F.when(observed, 1.0).when(in_time, 0.5).otherwise(0.0) * F.when(in_space, 0.85).otherwise(1.0)
    return F.when(value.isNull(), 0.0).otherwise(weight)


def reliability(scale: float, rms: Column) -> Column:
    """scale^2 / (scale^2 + rms^2); null where the error is unknown."""
    return F.lit(scale * scale) / (F.lit(scale * scale) + rms * rms)


def relative_anomaly(anomaly: Column, background: Column, floor: float) -> Column:
    """anomaly / background where the background is larger than the floor, else null."""
    return F.when(F.abs(background) > floor, anomaly / background)


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def flag_mask(flags: Column, names: list[str]) -> Column:
    """Bit mask of flags; bit = rank of the name among the sorted names (32 at most)."""
    ranked = sorted(set(names))
    if len(ranked) > 32:
        raise ValueError("at most 32 flags")
    bit = lambda name, i: F.when(F.array_contains(flags, name), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    total = F.lit(0).cast("bigint")
    for i, name in enumerate(ranked):
        total = total + bit(name, i)
    return total


def flags_of_mask(mask: Column, names: list[str]) -> Column:
    """The sorted flag names of a bit mask."""
    ranked = sorted(set(names))
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(ranked)]))
