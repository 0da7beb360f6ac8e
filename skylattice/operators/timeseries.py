"""Windows over ordered series: cadence, gaps, regular axes, baselines, derivatives, causal windows, splits, recurrences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_report(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Median and largest step between successive instants (a number column), and whether all steps are equal."""
    w = Window.partitionBy(*keys).orderBy(at)
    steps = df.withColumn("_step", F.col(at) - F.lag(at).over(w))
    out = steps.groupBy(*keys).agg(F.median("_step").alias("cadence"), F.max("_step").alias("max_gap"), F.min("_step").alias("min_gap"), F.count("*").alias("n"))
    return out.select(*keys, "n", "cadence", "max_gap", (F.col("max_gap") == F.col("min_gap")).alias("regular"))


def missing_gap(df: DataFrame, keys: list[str], at: str, step: float, start: float, end: float, requested: DataFrame | None = None) -> DataFrame:
    """The longest stretch of each series without a slot it should have, both ends of the requested span included.

    Slots are ``step`` apart from ``start`` to ``end``, the first and last slot. Before the first instant and after the last
    one, all the time to the end of the span is missing; between two instants, what is beyond one step. Rows
    outside the span and without an instant don't count. Series of ``requested`` (keys) without a row have a null.
    """
    inside = df.where(F.col(at).between(start, end))
    w = Window.partitionBy(*keys).orderBy(at)
    steps = inside.withColumn("_gap", F.col(at) - F.lag(at).over(w) - step)
    out = steps.groupBy(*keys).agg(F.greatest(F.lit(0), F.min(at) - start, end - F.max(at), F.coalesce(F.max("_gap"), F.lit(0))).alias("missing_gap"), F.count("*").alias("n"))
    if requested is None:
        return out
    return requested.select(*keys).distinct().join(out.hint("merge"), keys, "left").fillna(0, ["n"])


def regular_slots(df: DataFrame, keys: list[str], at: str, step: int, values: list[str], coverage: str, filler: float = 1e-6) -> DataFrame:
    """Every slot from first to last instant; missing ones carry the values before them with coverage ``filler``."""
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    spine = span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step))).alias(at))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = spine.join(df.select(*keys, at, *values, coverage).hint("merge"), [*keys, at], "left")
    missing = F.col(coverage).isNull()
    return joined.select(*keys, at, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values], F.when(missing, F.lit(filler)).otherwise(F.col(coverage)).alias(coverage), missing.alias("carried"))


def fill_axis(df: DataFrame, keys: list[str], at: str, value: str, step: int, limit: int, causal: bool = False) -> DataFrame:
    """Values on a regular axis: exact ones untouched; between two within ``limit`` linear, or, if causal, the last one held."""
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    spine = span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step))).alias(at))
    joined = spine.join(df.select(*keys, at, value).hint("merge"), [*keys, at], "left")
    w = Window.partitionBy(*keys).orderBy(at)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    joined = joined.withColumn("_p", F.last(pair, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.withColumn("_n", F.first(pair, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    if causal:
        filled = F.when(F.col(at) - F.col("_p.t") <= limit, F.col("_p.v"))
    else:
        share = (F.col(at) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
        filled = F.when(F.col("_n.t") - F.col("_p.t") <= limit, F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v")))
    return joined.select(*keys, at, F.coalesce(F.col(value), filled).alias(value), F.col(value).isNull().alias("interpolated"))


def rolling_median(value: str, window, half: int, causal: bool = False) -> Column:
    """Median over a full frame of 2 half + 1 rows (centred, or ending here); null where the frame is not full."""
    size = 2 * half + 1
    frame = window.rowsBetween(-(size - 1), 0) if causal else window.rowsBetween(-half, half)
    return F.when(F.count(value).over(frame) == size, F.percentile(value, F.lit(0.5)).over(frame))


def savgol_weights(size: int, order: int) -> np.ndarray:
    """Row p: weights over a window of ``size`` samples that give the fitted polynomial at position p."""
    x = np.arange(size) - size // 2
    basis = np.vander(x, order + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def savgol(df: DataFrame, keys: list[str], at: str, value: str, size: int, order: int, causal: bool = False) -> DataFrame:
    """Savitzky-Golay baseline: the ends use the polynomial of the first or last window; null if a sample of the window is missing."""
    weights, half = savgol_weights(size, order), size // 2
    w = Window.partitionBy(*keys).orderBy(at)
    held = F.coalesce(F.col(value), F.lit(float("nan")))  # collect_list skips nulls; NaN keeps its place and spoils its windows
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    if causal:
        df = df.withColumn("_f", F.collect_list(held).over(w.rowsBetween(-(size - 1), 0))).withColumn("_p", F.lit(size - 1))
    else:
        df = df.withColumn("_wide", F.collect_list(held).over(w.rowsBetween(-(size - 1), size - 1)))
        start = F.greatest(F.lit(0), F.least(F.col("_i") - half, F.col("_n") - size))  # first sample of the window
        df = df.withColumn("_s", start).withColumn("_p", F.col("_i") - F.col("_s"))
        df = df.withColumn("_f", F.slice("_wide", F.col("_s") - F.greatest(F.col("_i") - (size - 1), F.lit(0)) + 1, F.lit(size)))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    total = F.aggregate(F.zip_with("_f", F.get(rows, F.col("_p")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    baseline = F.when((F.size("_f") == size) & ~F.isnan(total), total)
    return df.withColumn("baseline", baseline).drop("_i", "_n", "_f", "_wide", "_s", "_p")


def derivative(value: str, at: str, window, backward: bool = False) -> Column:
    """Rate of change on uneven steps: second-order central, one-sided at the ends; or the backward difference."""
    v, t = F.col(value), F.col(at)
    v0, t0, v1, t1 = F.lag(value).over(window), F.lag(at).over(window), F.lead(value).over(window), F.lead(at).over(window)
    back, ahead = (v - v0) / (t - t0), (v1 - v) / (t1 - t)
    if backward:
        return back
    a, b = t - t0, t1 - t
    central = (back * b + ahead * a) / (a + b)
    return F.when(t0.isNull(), ahead).when(t1.isNull(), back).otherwise(central)


def islands(df: DataFrame, keys: list[str], at: str, step: float) -> DataFrame:
    """Numbers runs of rows whose steps are at most ``step``: island, and position in it from 1."""
    w = Window.partitionBy(*keys).orderBy(at)
    df = df.withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) <= step, 0).otherwise(1))
    df = df.withColumn("island", F.sum("_new").over(w)).drop("_new")
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(at)))


def causal_windows(df: DataFrame, keys: list[str], at: str, value: str, step: float, history: int = 12) -> DataFrame:
    """Rows with ``history`` rows exactly a step apart before them, as an array, oldest first; a gap starts anew."""
    numbered = islands(df, keys, at, step)
    w = Window.partitionBy(*keys, "island").orderBy(at)
    return numbered.withColumn("window", F.collect_list(value).over(w.rowsBetween(-history, -1))).where(F.col("position") > history)


def lag_in_island(df: DataFrame, keys: list[str], at: str, value: str, step: float, back: int = 12) -> DataFrame:
    """Residual against the value ``back`` rows before in the same island."""
    numbered = islands(df, keys, at, step)
    before = F.lag(value, back).over(Window.partitionBy(*keys, "island").orderBy(at))
    return numbered.withColumn("reference", before).withColumn("residual", F.col(value) - F.col("reference"))


def chronological_split(days: DataFrame, day: str, names=("train", "validation", "calibration", "test"), cuts=(0.7, 0.8, 0.9)) -> DataFrame:
    """Days by position into consecutive parts; positions come from counts of months, so no task has all days."""
    month = F.trunc(day, "month")
    months = days.groupBy(month.alias("_m")).agg(F.count("*").alias("_k"))
    later = months.select(F.col("_m").alias("_o"), F.col("_k").alias("_c"))
    before = months.join(F.broadcast(later), F.col("_o") < F.col("_m"), "left").groupBy("_m").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_before"))  # a row a month
    placed = days.withColumn("_m", month).join(F.broadcast(before), "_m").join(F.broadcast(months.agg(F.sum("_k").alias("_n"))))
    placed = placed.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_m").orderBy(day)) - 1).drop("_m", "_before")
    part = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts, strict=False))):
        part = F.when(F.col("_i") < F.floor(F.col("_n") * cut), name).otherwise(part)
    return placed.withColumn("part", part).drop("_i", "_n")


def next_step_pairs(df: DataFrame, keys: list[str], at: str, value: str, coverage: str, calibration: float = 0.25, least: float = 1e-5) -> DataFrame:
    """Each row with the next row's value as target, where that row is no filler; the last share calibrates."""
    w = Window.partitionBy(*keys).orderBy(at)
    df = df.withColumn("target", F.lead(value).over(w)).withColumn("_c", F.lead(coverage).over(w)).where(F.col("_c") > least).drop("_c")
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return df.withColumn("part", F.when(F.col("_i") > F.col("_n") - F.floor(F.col("_n") * calibration), "calibration").otherwise("fit")).drop("_i", "_n")


def next_map_residuals(df: DataFrame, keys: list[str], at: str, value: str, until: int, ridge: float) -> DataFrame:
    """What is left of each row's step from the row before, after the part of the step before it that a ridge fit carries over.

    The gain of a key is fitted on its rows up to ``until``; ``err`` = step - gain * step before. Another
    predictor takes this one's place by giving ``err`` for the same rows.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    steps = df.withColumn("res", F.col(value) - F.lag(value).over(w)).withColumn("prev", F.lag("res").over(w)).where("prev IS NOT NULL")
    fit = F.col(at) <= until
    total = lambda c: F.coalesce(F.sum(F.when(fit, c)), F.lit(0.0))
    gains = steps.groupBy(*keys).agg((total(F.col("res") * F.col("prev")) / (total(F.col("prev") * F.col("prev")) + ridge)).alias("gain"))
    return steps.join(gains, keys).withColumn("err", F.col("res") - F.col("gain") * F.col("prev"))


def longest_run(df: DataFrame, keys: list[str], at: str, ok: str, step: float) -> DataFrame:
    """Length of the longest run of successive rows with ``ok``, steps at most ``step`` apart."""
    runs = islands(df.where(F.col(ok)), keys, at, step)
    return runs.groupBy(*keys, "island").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest"))


def block_mean(df: DataFrame, keys: list[str], iy: str, ix: str, value: str, factor: int) -> DataFrame:
    """Coarser cells: mean of factor x factor cells, all of which must be there."""
    by, bx = F.floor(F.col(iy) / factor).cast("int"), F.floor(F.col(ix) / factor).cast("int")
    out = df.groupBy(*keys, by.alias("by"), bx.alias("bx")).agg(F.avg(value).alias(value), F.count(value).alias("cells"))
    return out.where(F.col("cells") == factor * factor)


def degrade(df: DataFrame, keys: list[str], at: str, iy: str, ix: str, value: str, rms: str, factor: int, stride: int, noise: float = 0.0) -> DataFrame:
    """Coarser maps at every ``stride``-th instant of each key, from its first: block means with the mean of their RMS.

    All factor x factor cells must be there. The RMS of a block is the mean of its cells' plus ``noise``, with no reduction by
    their number (errors are not known to be independent), and null where a cell's is missing, infinite or negative.
    """
    times = df.select(*keys, at).distinct()
    order = Window.partitionBy(*keys).orderBy(at) if keys else Window.partitionBy(F.lit(0)).orderBy(at)  # instants, not rows
    kept = times.withColumn("_k", F.row_number().over(order)).where((F.col("_k") - 1) % stride == 0).drop("_k")
    by, bx = F.floor(F.col(iy) / factor).cast("int"), F.floor(F.col(ix) / factor).cast("int")
    good = F.when((F.col(rms) >= 0) & (F.col(rms) < float("inf")), F.col(rms))
    blocks = df.join(kept.hint("merge"), [*keys, at], "left_semi").groupBy(*keys, at, by.alias("by"), bx.alias("bx"))
    size = factor * factor
    out = blocks.agg(F.avg(value).alias(value), F.when(F.count(good) == size, F.avg(good) + noise).alias(rms), F.count(value).alias("_cells"))
    return out.where(F.col("_cells") == size).drop("_cells")


def even_sample(df: DataFrame, frame: list[str], order: list[str], most: int, phase: int = 0) -> DataFrame:
    """At most ``most`` rows of each frame at even distances, shifted by ``phase``."""
    w = Window.partitionBy(*frame)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    shifted = F.pmod(F.col("_i") + phase, F.col("_n"))
    first = F.floor(shifted * most / F.col("_n")) != F.floor((shifted - 1) * most / F.col("_n"))
    return df.where((F.col("_n") <= most) | first).drop("_i", "_n")


def expanding_score(df: DataFrame, keys: list[str], at: str, value: str, floor: float = 1e-6) -> DataFrame:
    """Robust z-score of each row against the rows of its key up to it: median and MAD of the growing array."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("centre", F.percentile(value, F.lit(0.5)).over(w)).withColumn("_all", F.collect_list(value).over(w))
    df = df.withColumn("_dev", F.expr("array_sort(transform(_all, x -> abs(x - centre)))")).withColumn("_k", F.size("_dev"))
    mad = (F.get("_dev", F.expr("(_k - 1) div 2")) + F.get("_dev", F.expr("_k div 2"))) / 2
    return df.withColumn("scale", F.greatest(F.lit(floor), 1.4826 * mad)).withColumn("z", (F.col(value) - F.col("centre")) / F.col("scale")).drop("_all", "_dev", "_k")


def recurrence(df: DataFrame, keys: list[str], at: str, value: str, decay: float = 0.9, gain: float = 0.5, threshold: float = 4.5) -> DataFrame:
    """Scores each row before it is seen: an ordered fold over a key's series with an input-dependent gate.

    state <- a state + (1 - a) tanh(x / scale), a = decay ** (1 + gain |x| / scale); the forecast is
    scale * state plus the running mean; the score is |residual| over the running deviation. Series are
    folded in slices (:mod:`skylattice.operators.recurrences`), so none has to fit into a task.
    """
    from skylattice.operators.recurrences import recurrence_scan

    scores, _ = recurrence_scan(df.select(*keys, at, value), keys, at, value, None, decay, gain)
    return scores.withColumn("candidate", F.col("score") >= threshold)


def fold_step(state: dict, x: float, decay: float, gain: float) -> tuple[float, float]:
    """Forecast and score of ``x`` from the state before it; then the state takes ``x`` in."""
    n = state["n"]
    spread = (state["m2"] / (n - 1)) ** 0.5 if n > 1 else 0.0
    scale = max(spread, 1e-6) if n > 1 else 1.0
    forecast = state["mean"] + scale * state["h"] if n else x
    score = abs(x - forecast) / scale if n > 1 else 0.0
    z = (x - state["mean"]) / scale if n else 0.0
    a = decay ** (1 + gain * min(abs(z), 10.0))
    state["h"] = a * state["h"] + (1 - a) * float(np.tanh(z))
    state["n"] = n + 1
    step = x - state["mean"]
    state["mean"] += step / (n + 1)
    state["m2"] += step * (x - state["mean"])
    return forecast, score


def fold_many(held: dict, at: np.ndarray, x: np.ndarray, decay: float, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fold_step` for one value of each of several keys; ``held`` has arrays, and ``at`` no place twice."""
    n, mean, m2, h = (held[c][at] for c in ("n", "mean", "m2", "h"))
    scale = np.where(n > 1, np.maximum(np.sqrt(m2 / np.maximum(n - 1, 1)), 1e-6), 1.0)
    forecast = np.where(n > 0, mean + scale * h, x)
    score = np.where(n > 1, np.abs(x - forecast) / scale, 0.0)
    z = np.where(n > 0, (x - mean) / scale, 0.0)
    a = decay ** (1 + gain * np.minimum(np.abs(z), 10.0))
    held["h"][at], held["n"][at] = a * h + (1 - a) * np.tanh(z), n + 1
    held["mean"][at] = after = mean + (x - mean) / (n + 1)
    held["m2"][at] = m2 + (x - mean) * (x - after)
    return forecast, score


def fold_rows(held: dict, at: np.ndarray, x: np.ndarray, decay: float, gain: float, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fold_step` for all rows of several keys, those of a key together and in order.

    The j-th rows of all keys are taken at once; keys that go on when fewer than ``few`` are left are taken by themselves.
    """
    forecast, score = np.empty(len(x)), np.empty(len(x))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    order = np.argsort(-count, kind="stable")
    first, count, j = first[order], count[order], 0
    while (left := int(np.searchsorted(-count, -j))) >= max(1, few):
        rows = first[:left] + j
        forecast[rows], score[rows] = fold_many(held, at[rows], x[rows], decay, gain)
        j += 1
    for start, end in zip((first[:left] + j).tolist(), (first[:left] + count[:left]).tolist(), strict=True):
        k = at[start]
        state = {c: held[c][k].item() for c in ("n", "mean", "m2", "h")}
        for i in range(start, end):
            forecast[i], score[i] = fold_step(state, float(x[i]), decay, gain)
        for c, v in state.items():
            held[c][k] = v
    return forecast, score


def fold_series(x: np.ndarray, decay: float, gain: float) -> tuple[list[float], list[float]]:
    state = {"n": 0, "mean": 0.0, "m2": 0.0, "h": 0.0}
    got = [fold_step(state, float(v), decay, gain) for v in x]
    return [g[0] for g in got], [g[1] for g in got]
