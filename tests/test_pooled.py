"""Scores against pools that grow with time, beside a plain version."""

import random

import numpy as np
import pytest

from skylattice.operators import pooled


@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_pooled_score_against_whole_pools(spark, buckets):
    pick = random.Random(buckets)
    rows = []
    for region in ("a", "b", None):
        for t in range(25):
            for _ in range(pick.randint(1, 12)):
                rows.append((region, t, pick.choice([0.0, 0.0, 7.0, pick.gauss(0, 5), 1e6 * pick.random(), float("nan"), None])))
    rows.append(("lone", 3, 4.0))
    df = spark.createDataFrame(rows, "region string, t long, v double").repartition(4)
    got = {}
    for r in pooled.pooled_score(df.where("region IS NOT NULL"), ["region"], "t", "v", 1e-6, buckets).collect():
        got.setdefault((r["region"], r["t"]), []).append(r)
    for (region, t), cells in got.items():
        pool = np.array([v for g, s, v in rows if g == region and s <= t and v is not None and not np.isnan(v)])
        if not len(pool):
            assert all(c["centre"] is None for c in cells)
            continue
        centre = np.median(pool)
        scale = max(1e-6, 1.4826 * np.median(np.abs(pool - centre)))
        now = [c for c in cells if c["centre"] is not None]
        assert all(c["centre"] == pytest.approx(centre) and c["scale"] == pytest.approx(scale) for c in now)
        assert len(cells) == sum(1 for g, s, _ in rows if (g, s) == (region, t))
        for c in now:
            assert c["z"] is None if c["v"] is None or np.isnan(c["v"]) else c["z"] == pytest.approx((c["v"] - centre) / scale)


def test_an_empty_table_gives_an_empty_result(spark):
    assert pooled.pooled_score(spark.createDataFrame([], "region string, t long, v double"), ["region"], "t", "v").collect() == []


def test_no_plan_gathers_a_pool(spark):
    df = spark.createDataFrame([("a", t, float(t % 7)) for t in range(50)], "region string, t long, v double")
    values = pooled._bucketed(df, ["region"], "t", "v", 8)
    pools = pooled._prefix_counts(values, ["region"])
    assert max(len(r["bucket"]) for r in pools.collect()) <= 15
