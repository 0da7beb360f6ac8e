"""Grids as long tables keyed (epoch, iy, ix): axes, densifying, interpolation, smoothing, derivatives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.plans.store import sized

#: Targets of one regional table (fixed limit of the request).
MOST_TARGETS = 10_000


def axis(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Regular step of an axis, its ends and number of values, and whether one odd gap cuts it: status regular, cut or ambiguous."""
    values = df.select(*keys, column).distinct()
    w = Window.partitionBy(*keys).orderBy(column)
    gaps = values.withColumn("_g", F.round(F.lead(column).over(w) - F.col(column), 9))
    step = gaps.groupBy(*keys).agg(F.min("_g").alias("step"), F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("size"))
    odd = gaps.join(step.select(*keys, "step"), keys).groupBy(*keys).agg(F.count_if(F.col("_g") > F.col("step") + 1e-9).alias("odd")) if keys else gaps.crossJoin(step.select("step")).agg(F.count_if(F.col("_g") > F.col("step") + 1e-9).alias("odd"))
    joined = step.join(odd, keys) if keys else step.crossJoin(odd)
    status = F.when(F.col("size") < 2, "ambiguous").when(F.col("odd") == 0, "regular").when(F.col("odd") == 1, "cut").otherwise("ambiguous")
    return joined.withColumn("status", status)


def densify(df: DataFrame, epochs: DataFrame, lats: list[float], lons: list[float], value: str) -> DataFrame:
    """Every (epoch, cell) of the axes with its value and a valid flag. The axes are small and broadcast."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(i, y, j, x) for i, y in enumerate(lats) for j, x in enumerate(lons)], "iy int, lat double, ix int, lon double")
    full = epochs.crossJoin(F.broadcast(cells))
    return full.join(df.select(*epochs.columns, "lat", "lon", value).hint("merge"), [*epochs.columns, "lat", "lon"], "left").withColumn("valid", F.col(value).isNotNull() & ~F.isnan(value))


def corner_table(spark: SparkSession, lats: list[float], lons: list[float], step_lat: float, step_lon: float, targets_lat: list[float], targets_lon: list[float], ring: bool = False) -> DataFrame:
    """Targets (ty, tx) with their one, two or four corners (iy, ix), bilinear weights, and the number needed.

    More than MOST_TARGETS targets are refused.
    """
    if len(targets_lat) * len(targets_lon) > MOST_TARGETS:
        raise ValueError(f"a regional table has at most {MOST_TARGETS} targets")

    def places(targets: list[float], values: list[float], step: float, around: bool) -> list[list[tuple[int, float]]]:
        out = []
        for t in targets:
            at = (t - values[0]) / step
            low = math.floor(at + 1e-9)
            share = at - low
            n = len(values)
            if abs(share) < 1e-9:
                out.append([(low % n if around else low, 1.0)] if around or 0 <= low < n else [])
            elif around or (0 <= low and low + 1 < n):
                out.append([(low % n if around else low, 1 - share), ((low + 1) % n if around else low + 1, share)])
            else:
                out.append([])
        return out

    rows = []
    ys, xs = places(targets_lat, lats, step_lat, False), places(targets_lon, lons, step_lon, ring)
    for ty, cy in enumerate(ys):
        for tx, cx in enumerate(xs):
            corners = [(iy, ix, wy * wx) for iy, wy in cy for ix, wx in cx]
            rows += [(ty, tx, float(targets_lat[ty]), float(targets_lon[tx]), iy, ix, w, len(corners)) for iy, ix, w in corners]
    return spark.createDataFrame(rows, "ty int, tx int, target_lat double, target_lon double, iy int, ix int, weight double, needed int")


def interpolate(df: DataFrame, keys: list[str], corners: DataFrame, value: str) -> DataFrame:
    """Bilinear values at the corner table's targets; ``reject_reason`` where a needed corner is missing. One equi-join, no extrapolation."""
    got = df.where(F.col(value).isNotNull()).join(F.broadcast(corners), ["iy", "ix"])
    out = got.groupBy(*keys, "ty", "tx", "target_lat", "target_lon", "needed").agg(F.sum(F.col("weight") * F.col(value)).alias("_v"), F.count("*").alias("corners"))
    whole = F.col("corners") == F.col("needed")
    return out.select(*keys, "ty", "tx", "target_lat", "target_lon", F.when(whole, F.col("_v")).alias(value), "corners", "needed", F.when(~whole, "missing_corner").alias("reject_reason"))


def target_axis(first: float, last: float, step: float) -> list[float]:
    """From first by step; the exact end is appended if the steps miss it."""
    n = int(math.floor((last - first) / step + 1e-9))
    out = [round(first + i * step, 10) for i in range(n + 1)]
    return out if abs(out[-1] - last) < 1e-9 else [*out, last]


def refine(df: DataFrame, keys: list[str], value: str, mask: str, rows: int, ring: int, fy: int, fx: int) -> DataFrame:
    """Working grid ``fy`` x ``fx`` times finer: each native cell serves the targets around it, by integer arithmetic alone.

    A target needs all its corners of nonzero weight; its mask is the OR of theirs. Longitude wraps.
    """
    offsets = df.sparkSession.createDataFrame([(a, b, (1 - abs(a) / fy) * (1 - abs(b) / fx)) for a in range(-fy + 1, fy) for b in range(-fx + 1, fx)], "dy int, dx int, weight double")
    spread = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(offsets))
    ty, tx = F.col("iy") * fy + F.col("dy"), F.pmod(F.col("ix") * fx + F.col("dx"), F.lit(ring * fx))
    spread = spread.withColumn("ty", ty).withColumn("tx", tx).where(F.col("ty").between(0, (rows - 1) * fy))
    out = spread.groupBy(*keys, "ty", "tx").agg(F.sum(F.col("weight") * F.col(value)).alias("_v"), F.sum("weight").alias("_w"), F.bit_or(mask).alias(mask))
    return out.where(F.col("_w") > 1 - 1e-9).select(*keys, "ty", "tx", F.col("_v").alias(value), mask)


def local_metres(lat: Column, lon: Column, lat0: float, lon0: float, radius: float = 6371008.8) -> tuple[Column, Column]:
    """Azimuthal-equidistant x (east) and y (north) in metres on the sphere around a centre."""
    p, p0, d = F.radians(lat), math.radians(lat0), F.radians(lon - lon0)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(d)))
    c = F.acos(cosine)
    k = F.when(c < 1e-12, 1.0).otherwise(c / F.sin(c)) * radius
    return k * F.cos(p) * F.sin(d), k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(d))


def metric_targets(lat0: float, lon0: float, half_width: float, spacing: float, radius: float = 6371008.8, scale_error: float = 0.08) -> list[tuple[int, int, float, float, float, float]]:
    """Regular metric grid around a centre: (ty, tx, y, x, latitude, longitude), by the inverse projection."""
    if half_width > 2_500_000:
        raise ValueError("a local grid reaches 2,500 km at most")
    c = math.hypot(half_width, half_width) / radius  # the projection stretches most at the corners, across the line to the centre
    if c / math.sin(c) - 1 > scale_error:
        raise ValueError("the projection stretches the grid's corners too much")
    n, out, p0 = int(half_width // spacing), [], math.radians(lat0)
    for ty in range(2 * n + 1):
        for tx in range(2 * n + 1):
            y, x = (ty - n) * spacing, (tx - n) * spacing
            r = math.hypot(x, y)
            c = r / radius
            if r == 0:
                out.append((ty, tx, y, x, lat0, lon0))
                continue
            lat = math.asin(math.cos(c) * math.sin(p0) + y * math.sin(c) * math.cos(p0) / r)
            lon = math.radians(lon0) + math.atan2(x * math.sin(c), r * math.cos(p0) * math.cos(c) - y * math.sin(p0) * math.sin(c))
            out.append((ty, tx, y, x, math.degrees(lat), (math.degrees(lon) + 180) % 360 - 180))
    return out


def regrid_metric(df: DataFrame, keys: list[str], value: str, lat0: float, lon0: float, step_lat: float, step_lon: float, first_lat: float, first_lon: float, half_width: float, spacing: float) -> DataFrame:
    """Bilinear values on a regular metric grid around a centre; all corners must be observed."""
    rows = []
    for ty, tx, y, x, lat, lon in metric_targets(lat0, lon0, half_width, spacing):
        ay, ax = (lat - first_lat) / step_lat, (lon - first_lon) / step_lon
        iy, ix = math.floor(ay), math.floor(ax)
        corners = [(iy + a, ix + b, wy * wx) for a, wy in ((0, 1 - ay + iy), (1, ay - iy)) for b, wx in ((0, 1 - ax + ix), (1, ax - ix)) if wy * wx > 1e-12]
        rows += [(ty, tx, float(y), float(x), cy, cx, w, len(corners)) for cy, cx, w in corners]
    table = df.sparkSession.createDataFrame(rows, "ty int, tx int, y_m double, x_m double, iy int, ix int, weight double, needed int")
    got = df.where(F.col(value).isNotNull()).join(sized(table, rows=len(rows)), ["iy", "ix"])
    out = got.groupBy(*keys, "ty", "tx", "y_m", "x_m", "needed").agg(F.sum(F.col("weight") * F.col(value)).alias(value), F.count("*").alias("_n"))
    return out.where(F.col("_n") == F.col("needed")).drop("_n", "needed").withColumn("spatially_interpolated", F.lit(True))


def kernel(sigma: float) -> list[tuple[int, float]]:
    """Normed Gaussian offsets, cut at four sigma."""
    reach = int(4 * sigma + 0.5)
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def smooth(df: DataFrame, keys: list[str], values: list[str], sigma: float, rows: int, columns: int, support: float = 0.8) -> DataFrame:
    """Masked Gaussian smoothing on a (iy, ix) grid of known size: normalised convolution, axis by axis.

    A value is null if its centre is missing or the kernel's weight on valid cells, over its weight
    inside the grid, is under ``support``.
    """
    offsets = F.broadcast(df.sparkSession.createDataFrame(kernel(sigma), "_k int, _w double"))

    def along(frame: DataFrame, column: str, size: int, sums: list[str]) -> DataFrame:
        spread = frame.crossJoin(offsets).withColumn(column, F.col(column) + F.col("_k")).where(F.col(column).between(0, size - 1))
        return spread.groupBy(*keys, "iy", "ix").agg(*[F.sum(F.col("_w") * F.col(s)).alias(s) for s in sums])

    valid = df
    for v in values:
        ok = F.col(v).isNotNull() & ~F.isnan(v)
        valid = valid.withColumn(f"_v_{v}", F.when(ok, F.col(v)).otherwise(0.0)).withColumn(f"_m_{v}", F.when(ok, 1.0).otherwise(0.0))
    sums = [f"_{x}_{v}" for v in values for x in ("v", "m")]
    part = along(along(valid.select(*keys, "iy", "ix", *sums), "iy", rows, sums), "ix", columns, sums)
    inside = lambda c, n: sum((F.when((F.col(c) - k).between(0, n - 1), w).otherwise(0.0) for k, w in kernel(sigma)), F.lit(0.0))
    part = part.withColumn("_d", inside("iy", rows) * inside("ix", columns))
    joined = valid.select(*keys, "iy", "ix", *[F.col(f"_m_{v}").alias(f"_c_{v}") for v in values]).join(part.hint("merge"), [*keys, "iy", "ix"])
    result = lambda v: F.when((F.col(f"_c_{v}") > 0) & (F.col(f"_m_{v}") / F.col("_d") >= support), F.col(f"_v_{v}") / F.col(f"_m_{v}"))
    return joined.select(*keys, "iy", "ix", *[result(v).alias(f"{v}_smooth") for v in values])


def spatial_derivatives(df: DataFrame, keys: list[str], value: str, dy: float, dx: float) -> DataFrame:
    """Gradient, its magnitude and the Laplacian; one window by row and one by column, neighbours one step apart.

    Second-order central differences where both neighbours are there; one-sided at the grid's ends;
    null where a stencil is incomplete.
    """

    def parts(line: str, along: str, step: float) -> tuple[Column, Column]:
        w = Window.partitionBy(*keys, line).orderBy(along)
        near = lambda f, s: F.when(f(along).over(w) == F.col(along) + s, f(value).over(w))
        before, after, edge = near(F.lag, -1), near(F.lead, 1), Window.partitionBy(*keys)
        first, last = F.col(along) == F.min(along).over(edge), F.col(along) == F.max(along).over(edge)
        slope = F.when(first, (after - F.col(value)) / step).when(last, (F.col(value) - before) / step).otherwise((after - before) / (2 * step))
        return slope, (after - 2 * F.col(value) + before) / (step * step)

    (gx, gxx), (gy, gyy) = parts("iy", "ix", dx), parts("ix", "iy", dy)
    out = df.withColumn("d_dx", gx).withColumn("_xx", gxx).withColumn("d_dy", gy).withColumn("_yy", gyy)
    return out.withColumn("grad_mag", F.hypot("d_dx", "d_dy")).withColumn("laplacian", F.col("_xx") + F.col("_yy")).drop("_xx", "_yy")


def structure_tensor(df: DataFrame, keys: list[str], sigma: float, rows: int, columns: int) -> DataFrame:
    """Eigenvalues, coherence and orientation (modulo pi) of the smoothed outer product of d_dx, d_dy."""
    products = df.select(*keys, "iy", "ix", (F.col("d_dx") ** 2).alias("xx"), (F.col("d_dy") ** 2).alias("yy"), (F.col("d_dx") * F.col("d_dy")).alias("xy"))
    s = smooth(products, keys, ["xx", "yy", "xy"], sigma, rows, columns)
    xx, yy, xy = (F.col(f"{c}_smooth") for c in ("xx", "yy", "xy"))
    mid, half = (xx + yy) / 2, F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    coherence = F.when(mid > 1e-20, half / mid)
    return s.select(*keys, "iy", "ix", (mid + half).alias("major"), F.greatest(mid - half, F.lit(0.0)).alias("minor"), coherence.alias("coherence"), F.pmod(0.5 * F.atan2(2 * xy, xx - yy), F.lit(math.pi)).alias("orientation"))
