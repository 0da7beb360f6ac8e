"""Median and MAD of pools that grow with time, by exact selection from value-ordered buckets.

The pool of an instant is every reading of its region up to it. Pools are never gathered: the values of a
region are cut at quantiles into buckets, counts of each bucket are added up over the instants, and these
prefix counts say in which bucket a rank lies. Only that bucket's values are looked at, and a value that
is frequent is a bucket of its own, which needs no look at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.plans.store import stored

#: Copies of a bucket's values, so that the instants that ask for the same bucket are not met in one task.
SALTS = 16


def _bucketed(df: DataFrame, region: list[str], at: str, value: str, buckets: int) -> DataFrame:
    """region, at, value, k (readings with this value), and the bucket: even between two cuts, odd on a cut."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.groupBy(*region).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, shares, F.lit(100 * buckets)))).alias("_cuts"))
    counted = df.groupBy(*region, at, value).agg(F.count("*").alias("k"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    joined = counted.join(stored(cuts, "pool-cuts").hint("merge"), region)
    # binary search: the number of cuts below the value
    below = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= F.size("_cuts")) & (F.get("_cuts", i + s - 1) < F.col(value)), i + s).otherwise(i))
    bucket = 2 * F.col("_i") + F.when(F.coalesce(F.get("_cuts", F.col("_i")) == F.col(value), F.lit(False)), 1).otherwise(0)
    return joined.withColumn("_i", below).select(*region, F.col(at).alias("at"), F.col(value).alias("x"), "k", bucket.alias("bucket"))


def _prefix_counts(values: DataFrame, region: list[str]) -> DataFrame:
    """One row per region and instant: the buckets with their least and largest values and the readings up to then."""
    counts = stored(values.groupBy(*region, "at", "bucket").agg(F.sum("k").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")), "pool-counts")
    cells = counts.groupBy(*region, "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    grid = counts.select(*region, "at").distinct().join(cells.hint("merge"), region)  # instants times buckets of a region
    dense = grid.join(counts.select(*region, "at", "bucket", "k").hint("merge"), [*region, "at", "bucket"], "left")
    upto = Window.partitionBy(*region, "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    dense = dense.withColumn("c", F.coalesce(F.sum("k").over(upto), F.lit(0))).where("c > 0")
    lists = F.array_sort(F.collect_list(F.struct("lo", "hi", "bucket", "c"))).alias("b")
    rows = dense.groupBy(*region, "at").agg(lists)
    return rows.select(*region, "at", F.col("b.bucket").alias("bucket"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.col("b.c").alias("c"))


def _requests(pools: DataFrame, region: list[str], ranks, centred: bool) -> DataFrame:
    """For each pool and rank: the buckets that may hold the value (or the distance from ``centre``) of the rank, and the rank among theirs."""
    kinds = {f.name: f.dataType.simpleString() for f in pools.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*region, "at"]), "centre double, which int, rank bigint, buckets array<int>"])

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            centres = frame["centre"] if centred else [0.0] * len(frame)
            for head, centre, bucket, lo, hi, c in zip(frame[[*region, "at"]].itertuples(index=False), centres, frame["bucket"], frame["lo"], frame["hi"], frame["c"], strict=True):
                near, far = lo, hi
                if centred:
                    near, far = np.maximum(np.maximum(lo - centre, centre - hi), 0.0), np.maximum(np.abs(lo - centre), np.abs(hi - centre))
                for which, rank in enumerate(ranks(int(c.sum()))):
                    top, low = _reaches(far, c, rank), _reaches(near, c, rank)
                    some = (near <= top) & (far >= low)
                    out.append((*head, centre, which, rank - int(c[far < low].sum()), bucket[some].tolist()))
            yield pd.DataFrame(out, columns=[*region, "at", "centre", "which", "rank", "buckets"])

    return pools.mapInPandas(find, schema)


def _reaches(edge: np.ndarray, c: np.ndarray, rank: int) -> float:
    """The least edge at which the buckets that end there hold more than ``rank`` values."""
    order = np.argsort(edge, kind="stable")
    return edge[order][np.searchsorted(np.cumsum(c[order]), rank, side="right")]


def _selected(requests: DataFrame, values: DataFrame, region: list[str], centred: bool) -> DataFrame:
    """region, at and the mean of the values at the ranks asked for."""
    requests = stored(requests, "pool-requests")
    asked = requests.select(*region, "at", "centre", "which", "rank", F.explode("buckets").alias("bucket")).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    wanted = asked.select(*region, "bucket").distinct()
    held = values.join(wanted.hint("merge"), [*region, "bucket"], "left_semi")
    held = held.select(*region, F.col("at").alias("since"), "x", "k", "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    met = asked.join(held.hint("merge"), [*region, "bucket", "salt"]).where("since <= at")
    size = F.abs(F.col("x") - F.col("centre")) if centred else F.col("x")
    counted = met.groupBy(*region, "at", "which", "rank", size.alias("d")).agg(F.sum("k").alias("k"))
    upto = Window.partitionBy(*region, "at", "which").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("upto", F.sum("k").over(upto)).where("upto > rank").groupBy(*region, "at", "which").agg(F.min("d").alias("d"))
    return found.groupBy(*region, "at").agg(F.avg("d").alias("selected"))


def pooled_score(df: DataFrame, region: list[str], at: str, value: str, floor: float = 1e-6, buckets: int = 256) -> DataFrame:
    """Robust z-score of each reading against the pool of all readings of its region up to its instant.

    Adds centre (the pool's median), scale (1.4826 times the pool's median distance from it, at least ``floor``) and
    z. Exact whatever ``buckets`` is, a choice between longer lists of counts and larger buckets. Readings
    that are null or NaN have no part in a pool, and no z.
    """
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*region, at, F.col(value).cast("double").alias(value))
    values = stored(_bucketed(good, region, at, value, buckets), "pool-values")
    pools = stored(_prefix_counts(values, region), "pool-prefix")
    middle = lambda n: ((n - 1) // 2, n // 2)
    centre = stored(_selected(_requests(pools, region, middle, False), values, region, False).withColumnRenamed("selected", "centre"), "pool-centre")
    around = pools.join(centre.hint("merge"), [*region, "at"])
    spread = _selected(_requests(around, region, middle, True), values, region, True)
    both = centre.join(spread.hint("merge"), [*region, "at"]).select(*region, F.col("at").alias(at), "centre", F.greatest(F.lit(floor), 1.4826 * F.col("selected")).alias("scale"))
    z = F.when(F.col(value).isNotNull() & ~F.isnan(value), (F.col(value) - F.col("centre")) / F.col("scale"))
    return df.join(both.hint("merge"), [*region, at], "left").withColumn("z", z)
