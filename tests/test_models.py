"""Models behind the window interface: a fitted ridge and a user's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import models
from skylattice.operators.timeseries import causal_windows


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(0, i, t, float(0.5 * t + i + (20 if (i, t) == (2, 30) else 0))) for i in range(4) for t in range(40)]
    return spark.createDataFrame(rows, "iy int, ix int, day long, v double")


def test_a_ridge_continues_a_line(cells):
    windows = causal_windows(cells, ["iy", "ix"], "day", "v", 1, 3)
    model = models.fit_linear(windows, "v", 3, 1e-6, F.col("day") < 28)
    assert model.predict(np.array([[1.0, 1.5, 2.0]]))[0] == pytest.approx(2.5, abs=1e-3)
    got = models.predict_next(windows, model.version, lambda: model).collect()
    assert all(r["predicted"] == pytest.approx(r["v"], abs=0.01) for r in got if r["day"] < 30)
    assert {r["model_version"] for r in got} == {model.version}


def test_a_users_model_takes_the_same_path(cells):
    class Last:
        version = "last-7"

        def predict(self, windows):
            return windows[:, -1] + 0.5

    found = {r["day"]: r for r in models.model_scan(cells, ["iy", "ix"], "day", "v", 1, 3, "last-7", Last, 0.1).collect()}
    assert found[30]["model_version"] == "last-7" and found[30]["cells"] == 4
    assert max(found, key=lambda d: found[d]["score"]) in (30, 31)


def test_a_model_is_loaded_once_a_worker(spark, cells, tmp_path):
    log = str(tmp_path / "loads")

    class Logged:
        version = "logged-1"

        def predict(self, windows):
            return windows.mean(axis=1)

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return Logged()

    windows = causal_windows(cells.repartition(8), ["iy", "ix"], "day", "v", 1, 3).repartition(16)
    for _ in range(2):
        models.predict_next(windows, "logged-1", load).agg(F.sum("predicted")).collect()
    workers = open(log).read().split()
    assert 0 < len(workers) == len(set(workers))


def test_another_version_than_asked_for_is_refused(cells):
    wrong = models.Linear(0.0, (0.0, 0.0, 1.0), "b")
    with pytest.raises(Exception, match="version b instead of a"):
        models.predict_next(causal_windows(cells, ["iy", "ix"], "day", "v", 1, 3), "a", lambda: wrong).collect()


def test_holes_have_no_prediction(spark):
    df = spark.createDataFrame([([1.0, None],), ([1.0, float("nan")],), ([1.0, 3.0],)], "window array<double>")
    mean = models.Linear(0.0, (0.5, 0.5), "mean")
    assert [r["predicted"] for r in models.predict_next(df, "mean", lambda: mean).collect()] == [None, None, 2.0]
