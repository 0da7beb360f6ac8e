"""Carriers between the bins, packets that come and go, and phases without a carrier."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import spectral

WAVES = [(kx / 24, ky / 24) for kx in range(-4, 5) for ky in (-2, -1, 0, 1, 2) if (kx, ky) != (0, 0)]


def field(kind):
    """One value for (t, y, x): 48 epochs of 12 rows and 24 columns; carriers are off the bins in period and wavelength."""
    pick = random.Random(5)
    jitter = [pick.uniform(0, 2 * math.pi) for _ in range(48)]

    def value(t, y, x):
        turn = 2 * math.pi * (t / 7.3 - x / 9.4)
        if kind == "steady":
            return 3 * math.cos(turn)
        if kind == "packet":
            return 3 * math.exp(-(((t - 24) / 16) ** 2)) * math.cos(turn)
        if kind == "burst":
            return 3 * math.cos(turn) if 20 <= t < 30 else 0.0
        return 3 * math.cos(turn + jitter[t])

    return [(kind, t, y, x, value(t, y, x)) for t in range(48) for y in range(12) for x in range(24)]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [r for kind in ("steady", "packet", "burst", "random") for r in field(kind)]
    df = spark.createDataFrame(rows, "region string, t int, iy int, ix int, v double")
    region = ["region"]
    capable = spectral.capabilities(df, region, "t", "v")
    bins = spectral.admissible_bins(capable, region, WAVES)
    assert bins.agg(F.max(1 / F.col("f")), F.min(1 / F.col("f"))).first()[1] >= 2.0
    residual = spectral.hann(spectral.detrended(df, region, "t", "v"), region, "t")
    power = spectral.wave_power(residual, region, "t", "residual", [], [], 1.0, 1.0, "hann", bins).cache()
    carrier = spectral.refined_peak(power, region).cache()
    evidence = spectral.carrier_evidence(residual, region, "t", "residual", carrier, 1.0, 1.0)
    out = spectral.judged_waves(spectral.wave_peak(power, region).join(carrier, region), evidence, region, least_concentration=0.05)
    return {r["region"]: r for r in out.collect()}


def test_a_carrier_between_the_bins_is_found(judged):
    for kind in ("steady", "packet"):
        assert 1 / judged[kind]["f"] == pytest.approx(7.3, rel=0.01), kind
        assert 1 / judged[kind]["kx"] == pytest.approx(9.4, rel=0.05), kind
        assert judged[kind]["ky"] == pytest.approx(0.0, abs=1e-6)
        assert judged[kind]["status"] == "estimated" and judged[kind]["coherence"] > 0.9
    # the bins alone are further off: 48 epochs have periods of 8, 6.86 and so on
    assert judged["steady"]["period"] == pytest.approx(48 / 7)


def test_a_burst_does_not_last(judged):
    assert judged["burst"]["status"] == "insufficient_persistence" and judged["burst"]["occupancy"] < 0.3


def test_random_phases_are_refused(judged):
    assert judged["random"]["status"] != "estimated" and judged["random"]["coherence"] < 0.5


def test_unsupported_regions_have_no_bins(spark):
    capable = spark.createDataFrame([("a", 4, 1.0, 2.0, 1.5, "insufficient_samples")], "region string, epochs long, cadence double, min_period double, max_period double, status string")
    assert spectral.admissible_bins(capable, ["region"], WAVES).collect() == []
