"""The field pipeline: baseline, smoothing, derivatives, motion and a label for each epoch, keyed so that many regions run in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators import aggregates, grid, motion, revisions, spectral, timeseries, topk, tracks
from skylattice.plans.store import stored


def analyse(obs: DataFrame, rows: int, columns: int, dy: float = 3.0, dx: float = 2.0, sigma: float = 1.0, scale: float = 40.0) -> DataFrame:
    """One row an epoch (day): mean strengths in 0..1, the label with the largest score, and its lead."""
    w = Window.partitionBy("iy", "ix").orderBy("day")
    field = obs.select("day", "iy", "ix", "v").withColumn("baseline", timeseries.rolling_median("v", w, 2)).where("baseline IS NOT NULL")
    field = field.withColumn("a", F.col("v") - F.col("baseline")).withColumn("rate", timeseries.derivative("v", "day", w))
    smooth = grid.smooth(field, ["day"], ["a"], sigma, rows, columns)
    slopes = grid.spatial_derivatives(smooth.where("a_smooth IS NOT NULL"), ["day"], "a_smooth", dy, dx)
    tensor = grid.structure_tensor(slopes, ["day"], sigma, rows, columns)
    flow = motion.feature_flow(motion.frame_pairs(obs.select("day", "iy", "ix", "v"), [], "day", "v", 1.0), ["day"], dy, dx, 1.5, rows, columns)
    means = field.groupBy("day").agg(F.tanh(F.avg(F.abs("a")) / scale).alias("anomaly"), F.tanh(F.avg(F.abs("rate")) / scale).alias("temporal"))
    means = means.join(slopes.groupBy("day").agg(F.tanh(F.avg("grad_mag") / 10).alias("gradient")), "day", "left")
    means = means.join(tensor.groupBy("day").agg(F.avg("coherence").alias("coherence")), "day", "left")
    means = means.join(flow.groupBy("day").agg(F.avg("confidence").alias("flow")), "day", "left").fillna(0.0, ["gradient", "coherence", "flow"])
    quiet = (1 - F.col("anomaly")) * (1 - F.col("temporal")) * (1 - F.col("gradient"))
    scores = {"quiet": quiet, "front": F.col("gradient") * F.col("coherence"), "flow": F.col("flow"), "disturbed": F.col("temporal") * (1 - F.col("coherence"))}
    label, margin = topk.best_label(scores)
    return means.withColumn("label", label).withColumn("margin", margin)


def _shape(rows: int, columns: int) -> tuple[Column, Column, Column]:
    """Aggregates of an object's cells: elongation from their second moments, share of the bounding box, contact with the grid's border."""
    own = 1 / 12  # a cell has an extent itself
    vy, vx = F.var_pop("iy") + own, F.var_pop("ix") + own
    half = F.sqrt(((vy - vx) / 2) ** 2 + F.covar_pop("iy", "ix") ** 2)
    box = (F.max("iy") - F.min("iy") + 1) * (F.max("ix") - F.min("ix") + 1)
    border = (F.min("iy") == 0) | (F.min("ix") == 0) | (F.max("iy") == rows - 1) | (F.max("ix") == columns - 1)
    return F.sqrt(((vy + vx) / 2 + half) / ((vy + vx) / 2 - half)), F.count("*") / box, border


def event_means(frames: DataFrame, wave: DataFrame, rows: int, columns: int, dy: float, dx: float, scale: float, strong: float, focused: bool = False) -> DataFrame:
    """What the seven scores are made of, one row a day, for frames (day, iy, ix, a, n) and one wave score for all.

    If ``wave`` has a row a region instead, days are those of :func:`keyed_pipeline`, which tell their region.

    Objects are the cells with |a| of at least ``strong`` and a quarter of the day's largest, fronts those with
    a quarter of its steepest gradient. Days without a day before have no motion.

    If ``focused``, the object is the strongest connected one alone, all means are over it and one cell around it
    (over the whole frame where there is no object), compactness is that of its outline, and the front's
    elongation is weighted by the gradient. Its share is still that of all cells of the frame.
    """
    day, cell = ["day"], ["day", "iy", "ix"]
    if focused:
        frames = stored(tracks.focus_region(frames.select(*cell, "a", "n"), day, "a", strong), "event-focus")
        inside = frames.where("focus").select(*cell)
    within = lambda t: t.join(inside.hint("merge"), cell, "left_semi") if focused else t
    here = F.col("focus") if focused else F.lit(True)
    base = frames.groupBy("day").agg(F.avg(F.when(here, F.when(F.col("n") >= 2, 1.0).otherwise(0.0))).alias("support"), F.tanh(F.avg(F.when(here, F.abs("a"))) / scale).alias("anomaly"), F.count("*").alias("_cells"), F.max(F.abs("a")).alias("_peak"))
    pairs = motion.frame_pairs(frames.select("day", "iy", "ix", "a"), [], "day", "a", 1.0)
    temporal = within(pairs).groupBy("day").agg(F.tanh(F.avg(F.abs((F.col("current") - F.col("previous")) / F.col("dt"))) / scale).alias("temporal"))
    slopes = grid.spatial_derivatives(frames.select("day", "iy", "ix", "a"), day, "a", dy, dx)
    tensor = grid.structure_tensor(slopes, day, 1.0, rows, columns).select("day", "iy", "ix", "coherence")
    steepest = within(slopes).groupBy("day").agg(F.max("grad_mag").alias("_peak"))
    steep = within(slopes).join(steepest, day).where(F.col("grad_mag") >= F.greatest(0.25 * F.col("_peak"), F.lit(1e-12))).join(tensor.hint("merge"), ["day", "iy", "ix"])
    front = steep.groupBy("day").agg(F.tanh(F.avg("grad_mag") / 10).alias("gradient"), F.avg("coherence").alias("coherence"), _shape(rows, columns)[0].alias("front_elongation"))
    if focused:
        lean = aggregates.shape_descriptors(steep, day, "iy", "ix", dx, dy, "grad_mag").select("day", F.col("elongation").alias("front_elongation"))
        front = front.drop("front_elongation").join(lean.hint("merge"), day)
        objects = aggregates.shape_descriptors(frames.where("object"), day, "iy", "ix", dx, dy, grid=(rows, columns))
        objects = objects.select("day", "elongation", "compactness", "border", F.col("cells").alias("_object"))
    else:
        elongation, compactness, border = _shape(rows, columns)
        things = frames.join(base.select("day", "_peak"), day).where(F.abs("a") >= F.greatest(F.lit(strong), 0.25 * F.col("_peak")))
        objects = things.groupBy("day").agg(elongation.alias("elongation"), compactness.alias("compactness"), border.alias("border"), F.count("*").alias("_object"))
    flow = motion.feature_flow(pairs, day, dy, dx, 1.5, rows, columns)
    rate = grid.spatial_derivatives(pairs, day, "current", dy, dx).withColumn("rate", (F.col("current") - F.col("previous")) / F.col("dt")).select("day", "iy", "ix", "rate", "d_dx", "d_dy")
    moved = motion.advection_residual(flow.join(rate.hint("merge"), ["day", "iy", "ix"]), "rate", "d_dx", "d_dy", accepted="accepted")
    motions = within(moved).groupBy("day").agg(F.tanh(F.avg(F.hypot("u", "v")) / 5).alias("speed"), F.avg("confidence").alias("flow_confidence"), F.tanh(F.avg(F.abs("residual")) / scale).alias("residual"))
    growth = within(motion.local_ambiguity(pairs, day, 2.0, rows, columns, 0.5, 0.95)).groupBy("day").agg(F.avg("ambiguity").alias("growth"))
    out = base
    for part in (temporal, front, objects, motions, growth):
        out = out.join(part, day, "left")
    out = out.withColumn("share", F.coalesce("_object", F.lit(0)) / F.col("_cells"))
    if "region" in wave.columns:
        out = out.withColumn("region", F.expr(f"day div {FRAMES}")).join(wave.hint("merge"), "region", "left").drop("region").fillna(0.0, ["wave"])
    else:
        out = out.crossJoin(F.broadcast(wave))  # one row
    out = out.drop("_object", "_cells", "_peak")
    return out.fillna(0.0, ["temporal", "gradient", "coherence", "speed", "flow_confidence", "growth", "compactness"]).fillna(1.0, ["elongation", "front_elongation"]).fillna(False, ["border"])


def wave_score(peaks: DataFrame) -> DataFrame:
    """One row: how clearly the regions' peaks stand out, as the mean of concentration times uniqueness."""
    return peaks.agg(F.coalesce(F.avg(F.col("concentration") * F.col("uniqueness")), F.lit(0.0)).alias("wave"))


def event_scores(means: DataFrame) -> DataFrame:
    """Seven scores from 0 to 1, the label with the largest one, and the lead among all but "uncertain"."""
    c = F.col
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    still, left = 1 - c("anomaly"), F.coalesce("residual", F.lit(0.0))
    compact = F.sqrt(c("compactness") / F.greatest("elongation", F.lit(1.0))) * F.sqrt(1 - c("share")) * F.when(c("border"), 0.5).otherwise(1.0)
    scores = {
        "quiet": c("support") * still * (1 - c("temporal")) * (1 - c("gradient")) * (1 - c("wave")),
        "flow": F.when(c("residual").isNotNull(), c("flow_confidence") * c("speed") * (1 - c("residual")) * (1 - 0.5 * c("wave"))).otherwise(0.0),
        "wave": c("wave"),
        "front": c("support") * c("gradient") * c("coherence") * clip((c("front_elongation") - 1) / 3) * (1 - 0.7 * c("wave")),
        "localized": c("support") * c("anomaly") * compact * (1 - c("wave")),
        "disturbed": c("support") * clip((c("temporal") + c("gradient") * (1 - c("coherence")) + left + c("temporal") * c("growth")) / 3),
    }
    scored = means.select("day", c("support"), c("anomaly"), *[clip(x).alias(n) for n, x in scores.items()])
    scored = scored.withColumn("uncertain", clip(F.greatest(1 - c("support"), c("anomaly") * (1 - F.greatest(*scores)))))
    _, margin = topk.best_label({n: c(n) for n in scores})
    label, _ = topk.best_label({n: c(n) for n in [*scores, "uncertain"]})
    return scored.select("day", *scores, "uncertain", label.alias("label"), margin.alias("margin"))


#: A frame of the keyed pipeline is region * FRAMES + its place on the region's axis.
FRAMES = 1_000_000
#: Target days of one chain of prefixes.
MOST_DAYS = 10_000


def keyed_pipeline(frames: DataFrame, rows: int, columns: int, dy: float, dx: float, scale: float, strong: float, periods: list[float], waves: list[tuple[float, float]], limit: int = 2, focused: bool = False) -> tuple[DataFrame, DataFrame]:
    """From the frames of many regions to seven scores an epoch, each region on its own cadence, in one plan.

    ``frames`` has region (a whole number from 0), epoch (seconds), frame, iy, ix, v; regions share no cells. Steps,
    all keyed by region: epochs whose frames contradict each other are refused; cadence and support decide what a
    region can show; its axis is filled between readings up to ``limit`` cadences apart; cells are taken
    against their own medians; motion, growth, fronts and objects follow, and waves where the region's status
    is "supported" (``periods`` in cadences). ``focused`` as for :func:`event_means`. A step that is switched off for a region leaves 0 and the status.

    Returns region, epoch, status, the scores, label and margin; and the refused epochs with their reason.
    """
    key, cell = ["region"], ["region", "iy", "ix"]
    named = frames.withColumn("_key", F.concat_ws(":", "region", "epoch"))
    judged = revisions.frame_conflicts(named, "_key", "frame", ["iy", "ix"], "v").select("_key", F.col("frame").alias("_kept"), "conflict")
    judged = stored(named.join(judged.hint("merge"), "_key"), "field-frames")
    refused = judged.where("conflict").select(*key, "epoch").distinct().withColumn("reason", F.lit("frames_contradict"))
    good = judged.where("NOT conflict AND frame = _kept").select(*cell, "epoch", "v")

    capable = stored(spectral.capabilities(good, key, "epoch", "v"), "field-capable")
    first = good.groupBy(*key).agg(F.min("epoch").alias("_first"))
    axis = capable.select(*key, "cadence", "status").join(first.hint("merge"), key)
    placed = good.join(axis.hint("merge"), key).withColumn("_place", (F.col("epoch") - F.col("_first")) / F.col("cadence"))
    off = F.col("_place") != F.round("_place")
    refused = refused.unionByName(placed.where(off).select(*key, "epoch").distinct().withColumn("reason", F.lit("off_the_axis")))
    placed = stored(placed.where(~off).select(*cell, F.round("_place").cast("bigint").alias("slot"), "v"), "field-placed")
    filled = timeseries.fill_axis(placed, cell, "slot", "v", 1, limit).where("v IS NOT NULL")
    filled = stored(filled.withColumn("n", F.when(F.col("interpolated"), 1).otherwise(2)), "field-filled")
    centre = filled.groupBy(*cell).agg(F.median("v").alias("_centre"))
    field = filled.join(centre.hint("merge"), cell).select(*cell, "slot", (F.col("v") - F.col("_centre")).alias("a"), "n")
    field = stored(field.withColumn("day", F.col("region") * F.lit(FRAMES).cast("bigint") + F.col("slot")), "field-anomalies")

    able = field.join(capable.where("status = 'supported'").select(*key).hint("merge"), key, "left_semi")
    residual = spectral.hann(spectral.detrended(able, key, "slot", "a"), key, "slot")
    peaks = spectral.wave_peak(spectral.wave_power(residual, key, "slot", "residual", periods, waves, dy, dx, "hann"), key)
    wave = peaks.select(*key, (F.col("concentration") * F.coalesce("uniqueness", F.lit(0.0))).alias("wave"))
    scores = event_scores(event_means(field.select("day", "iy", "ix", "a", "n"), stored(wave, "field-waves"), rows, columns, dy, dx, scale, strong, focused))
    scores = scores.withColumn("region", F.expr(f"day div {FRAMES}")).join(axis.hint("merge"), key)
    epoch = F.col("_first") + F.col("day") % FRAMES * F.col("cadence")
    return scores.select(*key, epoch.cast("bigint").alias("epoch"), "status", *[c for c in scores.columns if c not in ("region", "day", "cadence", "status", "_first")]), refused


def prefix_chain(obs: DataFrame, targets: DataFrame, rows: int, columns: int, dy: float, dx: float, floor: float = 1.0) -> DataFrame:
    """The chain of baseline, anomaly, smoothing, gradient at exact target days, each from the days up to it alone.

    ``target`` is a key of every step, so all targets run in one job. A target without readings has no row. More than
    MOST_DAYS targets are refused: each holds all days up to it.
    """
    if targets.count() > MOST_DAYS:
        raise ValueError(f"a chain has at most {MOST_DAYS} target days")
    prefix = obs.join(F.broadcast(targets), F.col("day") <= F.col("target"))
    scale = aggregates.robust_scale(prefix, ["target", "iy", "ix"], "v", floor)
    now = prefix.where("day = target").select("target", "iy", "ix", "v").join(scale, ["target", "iy", "ix"])
    field = now.select("target", "iy", "ix", ((F.col("v") - F.col("centre")) / F.col("scale")).alias("z"))
    smooth = grid.smooth(field, ["target"], ["z"], 1.0, rows, columns).where("z_smooth IS NOT NULL")
    return grid.spatial_derivatives(smooth, ["target"], "z_smooth", dy, dx)
