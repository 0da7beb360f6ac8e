"""Apparent motion between frames, its ambiguity with growth, and kinematics of a flow field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.grid import smooth, spatial_derivatives


def frame_pairs(df: DataFrame, keys: list[str], at: str, value: str, cadence: float) -> DataFrame:
    """Each cell beside its value one frame before (gap up to 1.5 cadences): previous, current, dt."""
    w = Window.partitionBy(*keys, "iy", "ix").orderBy(at)
    pairs = df.withColumn("previous", F.lag(value).over(w)).withColumn("dt", F.col(at) - F.lag(at).over(w))
    return pairs.where(F.col("dt") <= 1.5 * cadence).withColumnRenamed(value, "current").where("previous IS NOT NULL AND current IS NOT NULL")


def supported_pairs(pairs: DataFrame, keys: list[str], cells: int, least_share: float = 0.8, least_spread: float = 1e-10) -> DataFrame:
    """The pairs of those frames that motion can be read from: enough of the region's ``cells`` have both values,

    and neither frame is flat (95th less 5th percentile).
    """
    spread = [F.percentile(c, F.lit(0.95)) - F.percentile(c, F.lit(0.05)) for c in ("previous", "current")]
    frames = pairs.groupBy(*keys).agg(F.count("*").alias("_n"), F.least(*spread).alias("_spread"))
    good = frames.where((F.col("_n") >= least_share * cells) & (F.col("_spread") >= least_spread)).select(*keys)
    return pairs.join(good.hint("merge"), keys, "left_semi")


def feature_flow(pairs: DataFrame, keys: list[str], dy: float, dx: float, sigma: float, rows: int, columns: int, least: float = 0.4) -> DataFrame:
    """Velocity by windowed least squares: Gaussian sums of gradient products, a 2 x 2 solve for each cell.

    ``confidence`` = smaller over larger eigenvalue of the normal matrix, times the share of the change
    that the motion explains; flows under ``least`` are not accepted. Where the gradients all point one
    way, the matrix is singular but for rounding, and there is no flow.
    """
    mean = pairs.withColumn("mid", (F.col("previous") + F.col("current")) / 2).withColumn("gt", (F.col("current") - F.col("previous")) / F.col("dt"))
    g = spatial_derivatives(mean, keys, "mid", dy, dx).withColumnRenamed("d_dx", "gx").withColumnRenamed("d_dy", "gy")
    names = {"xx": "gx * gx", "xy": "gx * gy", "yy": "gy * gy", "xt": "gx * gt", "yt": "gy * gt", "tt": "gt * gt"}
    sums = smooth(g.select(*keys, "iy", "ix", *[F.expr(e).alias(n) for n, e in names.items()]), keys, list(names), sigma, rows, columns, 0.5)
    xx, xy, yy, xt, yt, tt = (F.col(f"{n}_smooth") for n in names)
    det = xx * yy - xy * xy
    u, v = -(yy * xt - xy * yt) / det, -(xx * yt - xy * xt) / det
    half = F.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    corner = ((xx + yy) / 2 - half) / F.greatest((xx + yy) / 2 + half, F.lit(1e-30))
    explained = F.greatest(F.lit(0.0), 1 - (tt + u * xt + v * yt) / F.greatest(tt, F.lit(1e-30)))
    out = sums.where(det > 1e-9 * (xx + yy) * (xx + yy)).select(*keys, "iy", "ix", u.alias("u"), v.alias("v"), (F.sqrt(F.greatest(corner, F.lit(0.0))) * F.least(explained, F.lit(1.0))).alias("confidence"))
    return out.withColumn("accepted", F.col("confidence") >= least)


def growth_ambiguity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How much of a pair's change a stationary brightness model current = gain * previous + offset explains, over all cells."""
    sums = pairs.groupBy(*keys).agg(
        F.covar_pop("previous", "current").alias("_c"), F.var_pop("previous").alias("_p"), F.corr("previous", "current").alias("correlation"),
        F.var_pop(F.col("current") - F.col("previous")).alias("_d"), F.var_pop("current").alias("_v"), F.count("*").alias("cells"),
    )
    gain = F.when(F.col("_p") > 0, F.col("_c") / F.col("_p"))
    left = F.col("_v") - F.col("_c") * F.col("_c") / F.col("_p")
    explained = F.when((F.col("_d") > 0) & (F.col("_p") > 0), F.greatest(F.lit(0.0), 1 - left / F.col("_d")))
    return sums.select(*keys, gain.alias("gain"), "correlation", F.when(gain > 0, F.log(gain)).alias("log_gain"), explained.alias("ambiguity"), "cells")


def local_ambiguity(pairs: DataFrame, keys: list[str], sigma: float, rows: int, columns: int, support: float, threshold: float) -> DataFrame:
    """The same model fitted around each cell, from Gaussian-weighted moments of previous, current and their products.

    ``explained`` is the share of the change that gain and offset explain (0 where the window has too
    little support or no contrast), ``ambiguity`` what of it lies over ``threshold``, from 0 to 1.
    """
    names = {"p": "previous", "c": "current", "pp": "previous * previous", "cc": "current * current", "pc": "previous * current", "dd": "(current - previous) * (current - previous)"}
    m = smooth(pairs.select(*keys, "iy", "ix", *[F.expr(e).alias(n) for n, e in names.items()]), keys, list(names), sigma, rows, columns, support)
    p, c, pp, cc, pc, dd = (F.col(f"{n}_smooth") for n in names)
    vp, vc, both = pp - p * p, F.greatest(cc - c * c, F.lit(0.0)), pc - p * c
    contrast = vp > 1e-9 * pp
    left = F.greatest(vc - both * both / vp, F.lit(0.0))
    explained = F.when(contrast & (dd > 1e-9 * pp), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - left / dd))).otherwise(0.0)
    out = m.select(*keys, "iy", "ix", F.when(contrast, both / vp).alias("gain"), explained.alias("explained"))
    return out.withColumn("ambiguity", F.greatest(F.lit(0.0), (F.col("explained") - threshold) / (1 - threshold)))


def flow_kinematics(flow: DataFrame, keys: list[str], dy: float, dx: float) -> DataFrame:
    """Divergence, vorticity and strain of (u, v)."""
    du = spatial_derivatives(flow, keys, "u", dy, dx).select(*keys, "iy", "ix", "u", "v", F.col("d_dx").alias("ux"), F.col("d_dy").alias("uy"))
    dv = spatial_derivatives(du, keys, "v", dy, dx)
    out = dv.withColumn("divergence", F.col("ux") + F.col("d_dy")).withColumn("vorticity", F.col("d_dx") - F.col("uy"))
    return out.withColumn("strain", F.hypot(F.col("ux") - F.col("d_dy"), F.col("d_dx") + F.col("uy"))).select(*keys, "iy", "ix", "u", "v", "divergence", "vorticity", "strain")


def advection_residual(df: DataFrame, rate: str, gx: str, gy: str, u: str = "u", v: str = "v", accepted: str | None = None) -> DataFrame:
    """Rate of change plus u . gradient; a copy that is null where the flow is not accepted."""
    out = df.withColumn("residual_raw", F.col(rate) + F.col(u) * F.col(gx) + F.col(v) * F.col(gy))
    return out.withColumn("residual", F.when(F.col(accepted), F.col("residual_raw")) if accepted else F.col("residual_raw"))
