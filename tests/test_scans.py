"""Long series in slices, and scans that fail on the way, go on, or meet revisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators.recurrences import recurrence_scan
from skylattice.operators.timeseries import fold_series
from skylattice.plans import scans


def plain(x):
    forecasts, scores = fold_series(np.asarray(x, float), 0.9, 0.5)
    return list(zip(forecasts, scores, strict=True))


def test_a_long_series_in_slices(spark):
    """200,000 instants of one key beside short ones, no task with more than 1,024 rows of a series."""
    noise = F.sin(F.col("id") * 12.9898) * 43758.5453
    long = spark.range(200_000).select(F.lit("long").alias("k"), F.col("id").alias("t"), (100 + 5 * (noise - F.floor(noise))).alias("v"))
    short = spark.createDataFrame([(k, t, float(t * t % 7)) for k in ("a", None) for t in range(5)], "k string, t long, v double")
    scores, ends = recurrence_scan(long.unionByName(short).repartition(6), ["k"], "t", "v", slice_bits=10)
    got = scores.toPandas().sort_values(["k", "t"])
    for key, x in got.groupby("k", dropna=False):
        want = plain(x["v"])
        assert x["forecast"].tolist() == pytest.approx([w[0] for w in want], rel=1e-7)
        assert x["score"].tolist() == pytest.approx([w[1] for w in want], rel=1e-5, abs=1e-7)
    states = {r["k"]: r for r in ends.collect()}
    assert states["long"]["n"] == 200_000 and states["long"]["last"] == 199_999 and set(states) == {"long", "a", None}


def test_a_scan_goes_on_from_a_state(spark):
    rows = [(k, t, float((t * 37 + len(k)) % 11)) for k in ("a", "bb") for t in range(60)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    _, state = recurrence_scan(df.where("t < 25"), ["k"], "t", "v", slice_bits=3)
    after, end = recurrence_scan(df.where("t >= 25"), ["k"], "t", "v", state, slice_bits=3)
    whole, whole_end = recurrence_scan(df, ["k"], "t", "v", slice_bits=3)
    table = lambda d: {(r["k"], r["t"]): (r["forecast"], r["score"]) for r in d.collect()}
    got, want = table(after), table(whole.where("t >= 25"))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for a, b in zip(end.orderBy("k").collect(), whole_end.orderBy("k").collect(), strict=True):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])


def publications(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, number long, v double")


ROWS = [("a" if i % 3 else "b", i // 3, i, float((i * 31) % 17)) for i in range(90)]


def scores_of(spark, path):
    return {(r["k"], r["t"], r["number"]): (pytest.approx(r["forecast"]), pytest.approx(r["score"])) for r in scans.committed_scores(spark, path).collect()}


def run(spark, path, rows, *snapshots):
    for snapshot in snapshots:
        scans.scan_run(publications(spark, rows), ["k"], "t", "number", "v", path, snapshot)


def test_two_half_scans_are_one(spark, tmp_path):
    halves, whole = str(tmp_path / "halves"), str(tmp_path / "whole")
    run(spark, halves, ROWS, 44, 44, 89)  # the second one finds nothing
    run(spark, whole, ROWS, 89)
    assert {(k, t): v for (k, t, _), v in scores_of(spark, halves).items()}.keys() == {(k, t): v for (k, t, _), v in scores_of(spark, whole).items()}.keys()
    latest = {}
    for r in scans.committed_scores(spark, halves).collect():
        if r["number"] > latest.get((r["k"], r["t"]), (-1,))[0]:
            latest[r["k"], r["t"]] = (r["number"], r["forecast"], r["score"])
    for r in scans.committed_scores(spark, whole).collect():
        assert latest[r["k"], r["t"]] == (r["number"], pytest.approx(r["forecast"]), pytest.approx(r["score"]))


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path, other = str(tmp_path / "failed"), str(tmp_path / "calm")
    run(spark, path, ROWS, 44)
    before = scores_of(spark, path)
    with monkeypatch.context() as m:
        m.setattr(scans, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(spark, path, ROWS, 70)
    assert scores_of(spark, path) == before
    run(spark, path, ROWS, 89)
    run(spark, other, ROWS, 44, 89)
    assert scores_of(spark, path) == scores_of(spark, other)


def test_a_revision_of_an_old_instant_folds_its_series_again(spark, tmp_path):
    path = str(tmp_path / "revised")
    rows = [*ROWS, ("b", 2, 100, 50.0)]
    run(spark, path, rows, 89, 100)
    last = [r for r in scans.committed_scores(spark, path).collect() if r["run"] == 1]
    assert [(r["k"], r["t"], r["number"]) for r in last] == [("b", 2, 100)]
    series = [(t, v) for k, t, n, v in ROWS if k == "b" and t < 2]
    want = plain([v for _, v in sorted(series)] + [50.0])[-1]
    assert (last[0]["forecast"], last[0]["score"]) == pytest.approx(want)
