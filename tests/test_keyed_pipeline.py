"""Regions of different cadence in one run of the field pipeline, one of them without waves."""

import math

import pytest

from skylattice.plans.fields import keyed_pipeline


@pytest.fixture(scope="module")
def run(spark):
    rows = []
    for region, step, top in ((0, 3600, 0), (1, 7200, 8)):
        for t in range(12):
            for y in range(top, top + 8):
                for x in range(8):
                    rows.append((region, 1000 + t * step, "a", y, x, 50 + 5 * math.cos(2 * math.pi * (t / 4 - x / 8)) + y))
    rows += [(1, 1000 + 5 * 7200, "b", y, x, v + 1) for r, e, _, y, x, v in rows if r == 1 and e == 1000 + 5 * 7200]  # contradicts frame a
    rows += [(0, 1000 + 2 * 3600, "b", y, x, v) for r, e, _, y, x, v in rows if r == 0 and e == 1000 + 2 * 3600]  # says the same
    rows += [(0, 1000 + 3600 // 2, "a", 0, 0, 1.0)]
    frames = spark.createDataFrame(rows, "region long, epoch long, frame string, iy int, ix int, v double")
    waves = [(kx / 8, 0.0) for kx in (-2, -1, 1, 2)]
    out, refused = keyed_pipeline(frames, 16, 8, 1.0, 1.0, 40.0, 60.0, [3.0, 4.0, 6.0], waves)
    return out.collect(), refused.collect()


def test_each_region_keeps_its_cadence(run):
    out, _ = run
    assert sorted(r["epoch"] for r in out if r["region"] == 0) == [1000 + 3600 * t for t in range(12)]
    assert sorted(r["epoch"] for r in out if r["region"] == 1) == [1000 + 7200 * t for t in range(12)]  # the refused one is filled


def test_refused_epochs_have_a_reason(run):
    assert sorted((r["region"], r["epoch"], r["reason"]) for r in run[1]) == [(0, 2800, "off_the_axis"), (1, 37000, "frames_contradict")]


def test_waves_are_switched_off_where_they_are_not_supported(run):
    out, _ = run
    assert {r["status"] for r in out if r["region"] == 1} == {"unsupported_resolution"}
    assert {r["wave"] for r in out if r["region"] == 1} == {0.0}
    assert all(0.0 <= r[c] <= 1.0 for r in out for c in ("quiet", "flow", "wave", "front", "localized", "disturbed", "uncertain"))
