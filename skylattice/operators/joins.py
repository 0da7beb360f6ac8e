"""Joins that Spark has no single operator for: as-of, intervals, same time of day, grid corners, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each left row the last right row of its key at or before it.

    One shuffle by key: both sides are stacked and the last right row is carried forward. The number
    of right rows at that last instant comes along, so that ties can be rejected.
    """
    right = right.groupBy(*keys, right_at).agg(F.max(F.struct(*values)).alias("_right"), F.count("*").alias("_ties"))
    stacked_right = right.select(*keys, F.col(right_at).alias("_at"), F.struct(F.col(right_at).alias("at"), "_right", "_ties").alias("_held"), F.lit(0).alias("_side"))
    stacked_left = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = stacked_right.unionByName(stacked_left, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_held", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_left.*", F.col("_held.at").alias(f"matched_{right_at}"), *[F.col(f"_held._right.{v}").alias(f"matched_{v}") for v in values], F.col("_held._ties").alias("ties"))


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, at: str, width: int, value: str, key: str) -> DataFrame:
    """Left intervals [start, end] with the right intervals [at, at + width) that they touch; times in seconds.

    Both sides are cut into buckets of ``width``, joined on the bucket, and the exact predicate and a
    distinct follow, instead of a nested loop. Left rows without a match stay, as "unavailable".
    """
    bucket = lambda c: F.floor(c / width)
    wide = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)) - 1, bucket(F.col(end)))))
    held = right.select(F.col(at).alias("_at"), F.col(value).alias("_value"), bucket(F.col(at)).alias("_bucket"))
    hits = wide.join(held.hint("shuffle_hash"), "_bucket").where((F.col("_at") <= F.col(end)) & (F.col("_at") + width > F.col(start))).select(key, "_at", "_value").distinct()
    found = hits.groupBy(key).agg(F.max("_value").alias("max_value"), F.count("*").alias("n_matches"))
    return left.join(found.hint("merge"), key, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0))).withColumn("status", F.when(F.col("n_matches") > 0, "available").otherwise("unavailable"))


def same_time_history(df: DataFrame, cell: list[str], day: str, time_of_day: str, value: str, days: int = 7) -> DataFrame:
    """The values of a cell at the same time on the 1 to ``days`` days before: one window, no join."""
    w = Window.partitionBy(*cell, time_of_day).orderBy(day).rangeBetween(-days, -1)
    return df.withColumn("prior", F.collect_list(value).over(w)).withColumn("n_prior", F.size("prior"))


def array_median(column: str) -> Column:
    """Median of an array column without nulls: the mean of the middle pair; null if it is empty."""
    ordered = F.array_sort(column)
    pair = F.get(ordered, F.expr(f"(size({column}) - 1) div 2")) + F.get(ordered, F.expr(f"size({column}) div 2"))
    return F.when(F.size(column) > 0, pair / 2)


def neighbours(df: DataFrame, keys: list[str], iy: str, ix: str, ring: int | None = None, itself: bool = False) -> DataFrame:
    """Each cell beside its four neighbours' places (ny, nx); longitude wraps on a full ring of ``ring`` cells."""
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + [(0, 0)] * itself
    moved = df.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    nx = F.col(ix) + F.col("_s.b")
    return moved.withColumn("ny", F.col(iy) + F.col("_s.a")).withColumn("nx", F.pmod(nx, F.lit(ring)) if ring else nx).drop("_s")


def neighbour_join(df: DataFrame, keys: list[str], iy: str, ix: str, value: str, ring: int | None = None) -> DataFrame:
    """Mean of the four neighbours and their number, by an equi-join on shifted places."""
    asked = neighbours(df.select(*keys, iy, ix), keys, iy, ix, ring)
    held = df.select(*keys, F.col(iy).alias("ny"), F.col(ix).alias("nx"), F.col(value).alias("_v"))
    around = asked.join(held.hint("merge"), [*keys, "ny", "nx"]).groupBy(*keys, iy, ix).agg(F.avg("_v").alias("neighbour_mean"), F.count("_v").alias("neighbours"))
    return df.join(around.hint("merge"), [*keys, iy, ix], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def changed_and_next(days: DataFrame, changed: DataFrame, day: str) -> DataFrame:
    """Days to score again: changed ones and the day after each."""
    again = changed.select(F.explode(F.array(F.col(day), F.col(day) + 1)).alias(day)).distinct()
    return days.join(again.hint("merge"), day, "left_semi")


def violations(df: DataFrame, key: str, rules: dict, details: dict | None = None) -> DataFrame:
    """Rows (rule, key) for each rule that fails; a null result counts as a failure.

    With ``details`` (rule to the columns that it looks at), a third column says their values: ``name=value``, null for a null.
    """
    said = lambda name: F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in (details or {}).get(name, [])])
    checks = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(~ok, F.lit(True)).alias("failed"), *([said(name).alias("detail")] if details else [])) for name, ok in rules.items()])
    return df.select(F.col(key).alias("key"), F.explode(checks).alias("c")).where("c.failed").select("c.rule", "key", *(["c.detail"] if details else []))
