"""Predictors of the next map behind one interface: causal windows in, one value a row out.

A model is anything with ``version`` and ``predict(windows) -> values`` for an array of (rows, history). It is
loaded in the workers, once for all tasks that a worker runs; only its loader travels with the plan. Rows say
which version predicted them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators import aggregates
from skylattice.operators.timeseries import causal_windows


class Model(Protocol):
    version: str

    def predict(self, windows: np.ndarray) -> np.ndarray: ...


class Linear(NamedTuple):
    """intercept + weights . window, oldest value first."""

    intercept: float
    weights: tuple[float, ...]
    version: str

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return self.intercept + windows @ np.array(self.weights)


_LOADED: dict[str, Model] = {}


def _model(version: str, load: Callable[[], Model]) -> Model:
    """The model of a version, from this worker's memory after the first time."""
    if version not in _LOADED:
        model = load()
        if model.version != version:
            raise ValueError(f"the loader gave version {model.version} instead of {version}")
        _LOADED[version] = model
    return _LOADED[version]


def predict_next(windows: DataFrame, version: str, load: Callable[[], Model], window: str = "window") -> DataFrame:
    """Adds predicted and model_version; a window with a null or NaN in it has no prediction."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(version, load)
        for batch in batches:
            out = np.full(len(batch), np.nan)
            if len(batch):
                values = np.stack(batch.to_numpy()).astype(float)
                whole = ~np.isnan(values).any(axis=1)
                if whole.any():
                    out[whole] = model.predict(values[whole])
            yield pd.Series(out)

    got = predict(F.col(window).cast("array<double>"))
    return windows.withColumn("predicted", got).withColumn("predicted", F.when(~F.isnan("predicted"), F.col("predicted"))).withColumn("model_version", F.lit(version))


def fit_linear(windows: DataFrame, value: str, history: int, penalty: float, where: Column) -> Linear:
    """A ridge on the windows' values: sums over all rows ``where`` it may learn, one small solve, a version of its own."""
    lags = [f"x{i}" for i in range(history)]
    rows = windows.where(where).select(F.lit(0).alias("all"), F.col(value).alias("target"), *[F.get("window", i).alias(c) for i, c in enumerate(lags)])
    fitted = aggregates.ridge_fit(rows, ["all"], lags, "target", penalty).first()
    intercept, weights = (fitted["intercept"], tuple(fitted[c] for c in lags)) if fitted else (0.0, (0.0,) * (history - 1) + (1.0,))
    return Linear(intercept, weights, "ridge-" + hashlib.sha256(repr((intercept, weights)).encode()).hexdigest()[:12])


def model_scan(cells: DataFrame, cell: list[str], frame: str, value: str, step: float, history: int, version: str, load: Callable[[], Model], floor: float = 1.0) -> DataFrame:
    """Frames whose cells the model has not foreseen: frame, model_version, score, cells, candidate.

    A cell's error is scaled by its own median and MAD; a frame's score is the 95th percentile of its cells, and a
    candidate reaches the calibrated threshold. Cells without ``history`` frames ``step`` apart before them have no part.
    """
    windows = causal_windows(cells, cell, frame, value, step, history)
    errors = predict_next(windows, version, load).where("predicted IS NOT NULL").withColumn("_err", F.col(value) - F.col("predicted")).withColumn("_one", F.lit(1.0))
    scaled = errors.join(aggregates.robust_scale(errors, cell, "_err", floor).hint("merge"), cell).withColumn("_res", F.col("_err") - F.col("centre"))
    maps = aggregates.map_scores(scaled, [frame], "_res", "_one", "scale", cell)
    judged = maps.join(F.broadcast(aggregates.calibrated_threshold(maps, "score")))  # one row
    return judged.select(frame, F.lit(version).alias("model_version"), "score", "cells", (F.col("score") >= F.col("threshold")).alias("candidate"))
