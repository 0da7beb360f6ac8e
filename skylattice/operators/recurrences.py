"""The selective recurrence over series of any length, in slices.

A row's forecast needs the moments of all rows before it and the state h that they have left. Both can be
handed over: moments of slices add up, and with the moments known a slice turns h into A h + B, whatever h is. So
series are sorted by ranges and cut into slices; slices are folded in parallel, once for A and B and once for the
scores, and only one row a slice is ever followed along a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.plans.store import stored

STATE = ("n", "mean", "m2", "h")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A merge join whose keys may be null; the right side's keys go."""
    named = right.select(*[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in right.columns if c not in on])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on])
    return left.join(named.hint("merge"), same, how).drop(*[f"_on_{k}" for k in on])


def gates(x: np.ndarray, n: int, mean: float, m2: float, decay: float, gain: float) -> tuple[np.ndarray, ...]:
    """For the rows of a slice, from the moments before it: what stood before each row (count, mean, scale), and a, b of h -> a h + b."""
    shift = mean if n else x[0]
    d = x - shift
    before = n + np.arange(len(x))
    some, total, square = np.maximum(before, 1), np.cumsum(d) - d, np.cumsum(d * d) - d * d
    means = np.where(before > 0, shift + total / some, 0.0)
    spread = np.sqrt(np.maximum(m2 + square - total * total / some, 0.0) / np.maximum(before - 1, 1))
    scale = np.where(before > 1, np.maximum(spread, 1e-6), 1.0)
    z = np.where(before > 0, (x - means) / scale, 0.0)
    a = decay ** (1 + gain * np.minimum(np.abs(z), 10.0))
    return before, means, scale, a, (1 - a) * np.tanh(z)


def states(a: np.ndarray, b: np.ndarray, h: float) -> tuple[np.ndarray, float]:
    """h before each row, and after the last."""
    out = np.empty(len(a))
    for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        out[i] = h
        h = p * h + q
    return out, h


def per_run(df: DataFrame, run: str, order: str, fold, schema: str) -> DataFrame:
    """``fold(arrays by column)`` of each run of rows, many runs to a batch; a run that a batch cuts waits for the next.

    A group function is called once a group, which costs more than a short series' own work.
    """
    columns = df.columns

    def fold_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in chain(frames, [None]):
            last = frame is None
            if last or rest is not None:
                frame = rest if last else pd.concat([rest, frame])
            if frame is None or not len(frame):
                continue
            arrays = {c: frame[c].to_numpy() for c in columns}
            ids = arrays[run]
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
            whole = len(cuts) - 1 if last else len(cuts) - 2
            out = [fold({c: v[cuts[i] : cuts[i + 1]] for c, v in arrays.items()}) for i in range(whole)]
            rest = None if last else frame.iloc[cuts[whole] :]
            if out:
                yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    return df.repartition(run).sortWithinPartitions(run, order).mapInPandas(fold_all, schema)


def _starts(rows: DataFrame, state: DataFrame | None, keys: list[str]) -> DataFrame:
    """Each slice's run (its first place), series (the first run), moments before it, and the series' h at its start.

    A series' state from an earlier scan counts as slice -1.
    """
    sums = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_k"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("*")).alias("_q"), F.min("_pos").alias("_run"), F.lit(None).cast("double").alias("_h0"))
    if state is not None:
        old = [F.lit(-1).cast("bigint").alias("_slice"), F.col("n").alias("_k"), F.col("mean").alias("_m"), F.col("m2").alias("_q"), F.lit(None).cast("bigint").alias("_run"), F.col("h").alias("_h0")]
        sums = sums.unionByName(state.select(*keys, *old))
    all_rows, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_slice")  # a row a slice
    centred = sums.withColumn("_c", F.sum(F.col("_k") * F.col("_m")).over(all_rows) / F.sum("_k").over(all_rows)).withColumn("_d", F.col("_m") - F.col("_c"))
    before, upto = so_far.rowsBetween(Window.unboundedPreceding, -1), so_far.rowsBetween(Window.unboundedPreceding, 0)

    def moments(frame: Window, names: tuple[str, str, str]) -> list:
        add = lambda e: F.coalesce(F.sum(e).over(frame), F.lit(0.0))
        n, first = F.coalesce(F.sum("_k").over(frame), F.lit(0)), add(F.col("_k") * F.col("_d"))
        second = add(F.col("_q") + F.col("_k") * F.col("_d") * F.col("_d"))
        some = F.greatest(n, F.lit(1))
        return [n.alias(names[0]), F.when(n > 0, F.col("_c") + first / some).otherwise(0.0).alias(names[1]), F.greatest(second - first * first / some, F.lit(0.0)).alias(names[2])]

    series = [F.min("_run").over(all_rows).alias("_series"), F.coalesce(F.max("_h0").over(all_rows), F.lit(0.0)).alias("_h0")]
    return centred.select(*keys, "_slice", "_run", *series, *moments(before, ("_n", "_mean", "_m2")), *moments(upto, ("_n_end", "_mean_end", "_m2_end"))).where("_slice >= 0")


def recurrence_scan(df: DataFrame, keys: list[str], at: str, value: str, state: DataFrame | None = None, decay: float = 0.9, gain: float = 0.5, slice_bits: int = 12) -> tuple[DataFrame, DataFrame]:
    """Scores each row before it is seen, and the state that each series of ``df`` is left in.

    The first table has the rows of ``df`` with forecast and score, the second keys, n, mean, m2, h and last (the latest
    instant). ``state``, a second table of an earlier scan, is where its series go on; others start anew. Values
    must not be null. A task holds 2**slice_bits rows of a series at a time.
    """
    order = [*keys, at]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_slice", F.shiftright("_pos", slice_bits)).withColumn("_x", F.col(value).cast("double"))
    rows = stored(rows, "recurrence-rows")
    starts = stored(_starts(rows, state, keys), "recurrence-starts")
    narrow = joined(rows.select(*keys, "_slice", "_pos", "_x"), starts.select(*keys, "_slice", "_run", "_n", "_mean", "_m2"), [*keys, "_slice"]).drop(*keys, "_slice")

    def gated(run: dict) -> tuple[np.ndarray, ...]:
        return gates(run["_x"].astype(float), int(run["_n"][0]), float(run["_mean"][0]), float(run["_m2"][0]), decay, gain)

    def compose(run: dict) -> dict:
        *_, a, b = gated(run)
        return {"_run": run["_run"][:1], "_a": np.array([np.prod(a)]), "_b": np.array([states(a, b, 0.0)[1]])}

    def follow(series: dict) -> dict:
        before, last = states(series["_a"], series["_b"], float(series["_h0"][0]))
        return {"_run": series["_run"], "_h": before, "_h_end": np.append(before[1:], last)}

    def score(run: dict) -> dict:
        before, means, scale, a, b = gated(run)
        forecast = np.where(before > 0, means + scale * states(a, b, float(run["_h"][0]))[0], run["_x"])
        return {"_pos": run["_pos"], "forecast": forecast, "score": np.where(before > 1, np.abs(run["_x"] - forecast) / scale, 0.0)}

    maps = per_run(narrow, "_run", "_pos", compose, "_run bigint, _a double, _b double")
    slices = starts.select("_run", "_series", "_slice", "_h0").join(maps.hint("merge"), "_run")
    handed = stored(per_run(slices, "_series", "_slice", follow, "_run bigint, _h double, _h_end double"), "recurrence-states")
    scored = per_run(narrow.join(handed.select("_run", "_h").hint("merge"), "_run"), "_run", "_pos", score, "_pos bigint, forecast double, score double")
    out = rows.join(scored.hint("merge"), "_pos").drop("_pos", "_slice", "_x")
    ends = starts.join(handed.hint("merge"), "_run").groupBy(*keys).agg(F.max_by(F.struct(F.col("_n_end").alias("n"), F.col("_mean_end").alias("mean"), F.col("_m2_end").alias("m2"), F.col("_h_end").alias("h")), "_slice").alias("_s"))
    ends = joined(ends, rows.groupBy(*keys).agg(F.max(at).alias("last")), keys)
    return out, ends.select(*keys, *[f"_s.{c}" for c in STATE], "last")
