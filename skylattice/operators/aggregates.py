"""Aggregations over cells, epochs and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_FACTOR = 1.4826


def regional_readout(df: DataFrame, keys: list[str], value: str, flags: str, excluded: list[str], expected: int, minimum: float = 0.5, low: float = 0.9, cell: list[str] | None = None) -> DataFrame:
    """Mean, median, coverage and flags of each group, with a reason where it is rejected.

    Coverage is usable cells over ``expected`` ones. Flags: those of usable cells, ``excluded_cell:x``
    for dropped ones, and missing_cells, excluded_cells, low_coverage. With ``cell`` (columns that name a
    cell within its group), a group that has a cell twice, usable or not, is rejected as duplicate_cell.
    """
    dropped = F.arrays_overlap(F.col(flags), F.array(*[F.lit(f) for f in excluded]))
    ok = F.col(value).isNotNull() & ~F.isnan(value) & ~dropped
    grouped = df.groupBy(*keys).agg(
        F.avg(F.when(ok, F.col(value))).alias("mean_v"), F.median(F.when(ok, F.col(value))).alias("median_v"), F.count_if(ok).alias("cell_count"), F.count_if(~ok).alias("excluded_count"), F.count("*").alias("rows_in"), (F.count_distinct(F.struct(*cell)) if cell else F.count("*")).alias("_cells"),
        F.flatten(F.collect_set(F.when(ok, F.col(flags)))).alias("_kept"), F.flatten(F.collect_set(F.when(~ok, F.col(flags)))).alias("_dropped"),
    )
    coverage = F.col("cell_count") / F.lit(float(expected))
    gone = F.transform(F.array_distinct("_dropped"), lambda f: F.concat(F.lit("excluded_cell:"), f))
    extra = F.array_compact(F.array(F.when(F.col("rows_in") < expected, F.lit("missing_cells")), F.when(F.col("excluded_count") > 0, F.lit("excluded_cells")), F.when(coverage < low, F.lit("low_coverage"))))
    reason = F.when(F.col("_cells") < F.col("rows_in"), "duplicate_cell").when(F.col("cell_count") == 0, "no_usable_cell").when(F.col("rows_in") > expected, "too_many_cells").when(coverage < minimum, "coverage_below_minimum")
    out = grouped.withColumn("coverage", coverage).withColumn("flags", F.array_sort(F.array_distinct(F.concat("_kept", gone, extra)))).withColumn("reject_reason", reason)
    return out.select(*keys, "mean_v", "median_v", "cell_count", "coverage", "flags", "reject_reason")


def epoch_statistics(df: DataFrame, keys: list[str], value: str, cells: int) -> DataFrame:
    """Valid and missing cells, least, largest and mean value."""
    out = df.groupBy(*keys).agg(F.count(value).alias("valid"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.avg(value).alias("mean_v"))
    return out.withColumn("missing", F.lit(cells) - F.col("valid"))


def calibration(df: DataFrame, keys: list[str], residual: str) -> DataFrame:
    """Mean and sample deviation of residuals where there are two at least and they differ."""
    return df.groupBy(*keys).agg(F.avg(residual).alias("mean_r"), F.stddev_samp(residual).alias("sd_r"), F.count(residual).alias("n")).where("n >= 2 AND sd_r > 0")


def robust_scale(df: DataFrame, keys: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """Median, and 1.4826 times the median absolute deviation (``floor`` at least). Exact medians."""
    centre = df.groupBy(*keys).agg(F.median(value).alias("centre"))
    spread = df.join(centre, keys).groupBy(*keys).agg(F.first("centre").alias("centre"), F.median(F.abs(F.col(value) - F.col("centre"))).alias("mad"))
    return spread.select(*keys, "centre", F.greatest(F.lit(floor), MAD_FACTOR * F.col("mad")).alias("scale"))


def area_mean(value: Column, latitude: Column) -> Column:
    """Aggregate: mean weighted by the cosine of latitude, missing values skipped."""
    weight = F.when(value.isNotNull(), F.cos(F.radians(latitude)))
    return F.sum(weight * value) / F.sum(weight)


def map_scores(df: DataFrame, keys: list[str], residual: str, centre: str, scale: str, cell: list[str], quantile: float = 0.95) -> DataFrame:
    """Score of a map: quantile of its cells' positive normalised residuals, with its peak cell."""
    score = F.greatest(F.lit(0.0), (F.abs(residual) - F.col(centre)) / F.col(scale))
    scored = df.withColumn("_score", score)
    peak = F.max_by(F.struct(*cell), F.struct("_score", *[-F.col(c) for c in cell])).alias("peak")
    return scored.groupBy(*keys).agg(F.percentile("_score", F.lit(quantile)).alias("score"), F.count("_score").alias("cells"), peak).select(*keys, "score", "cells", *[F.col(f"peak.{c}").alias(f"peak_{c}") for c in cell])


def calibrated_threshold(scores: DataFrame, score: str, quantile: float = 0.995, least: float = 3.0) -> DataFrame:
    return scores.agg(F.greatest(F.lit(least), F.percentile(score, F.lit(quantile))).alias("threshold"))


def masked_mae(predicted: Column, target: Column) -> Column:
    """Aggregate: mean absolute error over rows where both are present."""
    return F.avg(F.abs(predicted - target))


def shortest_arc(df: DataFrame, keys: list[str], lon: str) -> DataFrame:
    """West and east end of the shortest arc that holds all longitudes: the largest circular gap is left out."""
    points = df.select(*keys, F.col(lon).alias("_lon")).distinct()
    w = Window.partitionBy(*keys).orderBy("_lon")
    first = F.min("_lon").over(Window.partitionBy(*keys))
    nxt = F.lead("_lon").over(w)
    gaps = points.withColumn("_next", F.coalesce(nxt, first + 360)).withColumn("_gap", F.col("_next") - F.col("_lon"))
    cut = gaps.groupBy(*keys).agg(F.max_by(F.struct("_lon", "_next", "_gap"), F.struct("_gap", "_lon")).alias("g"))
    east = F.col("g._lon")
    west = F.when(F.col("g._next") >= 180, F.col("g._next") - 360).otherwise(F.col("g._next"))
    return cut.select(*keys, west.alias("west"), east.alias("east"), (360 - F.col("g._gap")).alias("width"))


def shape_descriptors(cells: DataFrame, keys: list[str], iy: str, ix: str, dx: float, dy: float, weight: str | None = None, grid: tuple[int, int] | None = None) -> DataFrame:
    """Area, perimeter, compactness and elongation of each object of cells; with ``grid`` (rows, columns), also whether it touches the border.

    ``weight`` is the mass of a cell in the moments (1e-30 at least; a null counts as that), and has no part in area and perimeter.
    """
    w = F.greatest(F.col(weight), F.lit(1e-30)) if weight else F.lit(1.0)
    x, y = F.col(ix) * dx, F.col(iy) * dy
    sums = cells.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"),
        F.min(iy).alias("_y0"), F.max(iy).alias("_y1"), F.min(ix).alias("_x0"), F.max(ix).alias("_x1"),
    )
    own = cells.select(*keys, F.col(iy).alias("_y"), F.col(ix).alias("_x"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("side")) for a, b, s in ((0, 1, dy), (0, -1, dy), (1, 0, dx), (-1, 0, dx))])
    around = own.select(*keys, F.explode(steps).alias("s"), "_y", "_x").select(*keys, (F.col("_y") + F.col("s.a")).alias("_y"), (F.col("_x") + F.col("s.b")).alias("_x"), "s.side")
    rim = around.join(own.hint("merge"), [*keys, "_y", "_x"], "left_anti").groupBy(*keys).agg(F.sum("side").alias("perimeter"))
    out = sums.join(rim.hint("merge"), keys)
    var = lambda a, b: F.col(f"w{a}{b}") / F.col("w") - F.col(f"w{a}") * F.col(f"w{b}") / F.col("w") ** 2
    out = out.withColumn("vx", var("x", "x") + dx * dx / 12).withColumn("vy", var("y", "y") + dy * dy / 12).withColumn("vxy", var("x", "y"))
    mid, half = (F.col("vx") + F.col("vy")) / 2, F.sqrt(((F.col("vx") - F.col("vy")) / 2) ** 2 + F.col("vxy") ** 2)
    area = F.col("cells") * (dx * dy)
    return out.select(
        *keys, "cells", area.alias("area"), "perimeter", F.least(F.lit(1.0), 12.566370614359172 * area / F.col("perimeter") ** 2).alias("compactness"), F.sqrt((mid + half) / F.greatest(mid - half, F.lit(1e-12))).alias("elongation"),
        *([((F.col("_y0") == 0) | (F.col("_x0") == 0) | (F.col("_y1") == grid[0] - 1) | (F.col("_x1") == grid[1] - 1)).alias("border")] if grid else []),
    )


def running_total(df: DataFrame, order: str, amount: str, name: str, ranges: int = 64) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before each in an order without ties, with no single-task window.

    Rows are cut into ranges at approximate quantiles; windows run inside a range, and the ranges'
    own totals, of which there are at most ``ranges``, are added from a broadcast table.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.005)))
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(order) > cut).cast("int")
    parted = df.withColumn("_part", part)
    totals = parted.groupBy("_part").agg(F.sum(amount).alias("_total"))
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, inside + F.col("_offset")).drop("_part", "_offset")


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho with average ranks, from counts of distinct values, so that ties share a rank."""

    def ranks(column: str) -> DataFrame:
        counts = df.groupBy(column).agg(F.count("*").alias("_n"))
        placed = running_total(counts, column, "_n", "_before")
        return placed.select(F.col(column).alias(f"_{column}"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_r{column}"))

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_m"))
    joined = pairs.join(ranks(x).hint("merge"), F.col(x) == F.col(f"_{x}")).join(ranks(y).hint("merge"), F.col(y) == F.col(f"_{y}"))
    a, c, m = F.col(f"_r{x}"), F.col(f"_r{y}"), F.col("_m")
    sums = joined.agg(F.sum(m).alias("n"), F.sum(m * a).alias("a"), F.sum(m * c).alias("c"), F.sum(m * a * a).alias("aa"), F.sum(m * c * c).alias("cc"), F.sum(m * a * c).alias("ac"))
    spread = F.sqrt((F.col("aa") - F.col("a") ** 2 / F.col("n")) * (F.col("cc") - F.col("c") ** 2 / F.col("n")))
    return sums.select(F.when(spread > 0, (F.col("ac") - F.col("a") * F.col("c") / F.col("n")) / spread).alias("rho"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confidence_report(df: DataFrame, confidence: str, error: str, accepted: Column, limit: float) -> DataFrame:
    """One row: Spearman's rho of confidence and error, the mean error of the least and the most confident third, accepted rows, and those of them with an error over ``limit``.

    A third has n div 3 rows, one at least. Rows of equal confidence that a third holds only in part count with
    their mean error, so the order within a tie makes no difference. Rows without confidence or error are left out;
    an empty table gives nulls and zeros.
    """
    known = df.where(F.col(confidence).isNotNull() & F.col(error).isNotNull())
    levels = known.groupBy(confidence).agg(F.count("*").alias("_n"), F.avg(error).alias("_mean"))
    counted = known.agg(F.count("*").alias("n"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & (F.col(error) > limit)).alias("accepted_wrong"))
    counted = counted.withColumn("_third", F.greatest(F.lit(1), F.expr("n div 3")))
    placed = running_total(levels, confidence, "_n", "_before").crossJoin(F.broadcast(counted))  # one row
    end = F.col("_before") + F.col("_n")
    low = F.greatest(F.lit(0), F.least(end, F.col("_third")) - F.col("_before"))
    high = F.greatest(F.lit(0), end - F.greatest(F.col("_before"), F.col("n") - F.col("_third")))
    thirds = placed.agg((F.sum(low * F.col("_mean")) / F.sum(low)).alias("low_error"), (F.sum(high * F.col("_mean")) / F.sum(high)).alias("high_error"))
    rho = rank_correlation(known, confidence, error).select("rho")
    return rho.crossJoin(F.broadcast(thirds)).crossJoin(F.broadcast(counted.drop("_third")))  # one row each


def gram_sums(df: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Sums of pairwise products: all that a ridge fit needs, added up before the shuffle."""
    names = ["_one", *features]
    df = df.withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.groupBy(*keys).agg(*sums, *[F.sum(F.col(a) * F.col(target)).alias(f"b{i}") for i, a in enumerate(names)], F.count("*").alias("n"))


def ridge_fit(df: DataFrame, keys: list[str], features: list[str], target: str, penalty: float) -> DataFrame:
    """Coefficients of each group: the penalty spares the intercept. A tiny solve for each group of sums."""
    import numpy as np
    import pandas as pd

    size = len(features) + 1

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float)
        gram[range(1, size), range(1, size)] += penalty
        answer = np.linalg.solve(gram + 1e-12 * np.eye(size), np.array([row[f"b{i}"] for i in range(size)], dtype=float))
        return pd.DataFrame([[*(row[k] for k in keys), int(row["n"]), *answer]], columns=[*keys, "n", "intercept", *features])

    sums = gram_sums(df, keys, features, target)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n bigint", "intercept double", *(f"{f} double" for f in features)])
    return sums.groupBy(*keys).applyInPandas(solve, schema)
