"""The persistent-anomaly survey: baseline, score, regions, tracks, candidates, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import circular_mean_longitude
from skylattice.operators.joins import array_median, same_time_history
from skylattice.operators.tracks import frame_components, link_tracks
from skylattice.plans.store import stored


def deviations(obs: DataFrame, days: int = 7, least_days: int = 3, least_scale: float = 2.0) -> DataFrame:
    """Each reading against the same time on the days before, for obs(day, slot, iy, ix, v, rms, ...).

    baseline = median of the prior days (null under ``least_days``), scale = the largest of 1.4826 MAD,
    the reading's own rms, the median rms of the prior days, and ``least_scale``.
    """
    both = obs.withColumn("_both", F.when(F.col("v").isNotNull() | F.col("rms").isNotNull(), F.struct("v", "rms")))
    df = same_time_history(both, ["iy", "ix"], "day", "slot", "_both", days).drop("n_prior", "_both")
    df = df.withColumn("_v", F.expr("filter(prior.v, x -> x IS NOT NULL)")).withColumn("_r", F.expr("filter(prior.rms, x -> x IS NOT NULL)")).drop("prior")
    df = df.withColumn("n_prior", F.size("_v")).withColumn("_centre", array_median("_v"))
    df = df.withColumn("_dev", F.expr("transform(_v, x -> abs(x - _centre))"))
    scale = F.greatest(1.4826 * array_median("_dev"), F.col("rms"), array_median("_r"), F.lit(least_scale))
    df = df.withColumn("scale", scale).withColumn("baseline", F.when(F.col("n_prior") >= least_days, F.col("_centre")))
    df = df.withColumn("deviation", F.col("v") - F.col("baseline"))
    return df.withColumn("score", F.col("deviation") / F.col("scale")).drop("_v", "_r", "_dev", "_centre")


def flagged(dev: DataFrame, from_epoch: float, epoch: str = "epoch", least_deviation: float = 5.0, least_score: float = 3.0) -> DataFrame:
    """Cells after ``from_epoch`` whose deviation and score reach the thresholds on one side: polarity 1 or -1."""
    sign = F.signum("deviation")
    hit = (F.abs("deviation") >= least_deviation) & (F.abs("score") >= least_score)
    return dev.where((F.col(epoch) > from_epoch) & hit).withColumn("polarity", sign.cast("int"))


def candidates(cells: DataFrame, cadence: float, least_cells: int = 2, least_epochs: int = 2, ring: int | None = None) -> DataFrame:
    """Tracks of connected flagged cells (epoch, iy, ix, lat, lon, polarity, deviation, score) as candidate rows.

    The flagged cells are few and written once, since regions, tracks and descriptions all read them.
    Ties for the peak: earliest epoch, then least latitude and longitude.
    """
    cells = stored(cells.select("epoch", "iy", "ix", "lat", "lon", "polarity", "deviation", "score"), "survey-cells")
    blobs = frame_components(cells, ["epoch", "polarity"], ring)
    sized = blobs.groupBy("epoch", "polarity", "blob").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_cells).drop("_n")
    tracked = link_tracks(blobs.join(sized.hint("merge"), ["epoch", "polarity", "blob"]), "epoch", "polarity", cadence, ring)
    full = tracked.join(cells.hint("merge"), ["epoch", "polarity", "iy", "ix"])
    peak = F.max_by(F.struct("epoch", "lat", "lon", "deviation", "score"), F.struct(F.abs("score"), -F.col("epoch"), -F.col("lat"), -F.col("lon")))
    weight = F.abs("deviation")
    grouped = full.groupBy("track", "polarity").agg(
        F.min("epoch").alias("start"), F.max("epoch").alias("end"), F.count_distinct("epoch").alias("epochs"), F.count_distinct("iy", "ix").alias("cells"), peak.alias("p"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), (F.sum(weight * F.col("lat")) / F.sum(weight)).alias("centre_lat"), circular_mean_longitude(F.col("lon")).alias("centre_lon"),
        F.array_sort(F.collect_set(F.col("iy") * 100_000 + F.col("ix"))).alias("footprint"),
    ).where(F.col("epochs") >= least_epochs)
    strength = F.when((F.col("epochs") >= 3) & (F.col("cells") >= 3), "moderate").otherwise("limited")
    rank = -(F.abs("p.score") * F.sqrt(F.least("cells", F.lit(25))) * F.sqrt("epochs"))
    return grouped.select(
        "track", "polarity", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "epochs", "cells", F.col("p.epoch").alias("peak_epoch"), F.col("p.lat").alias("peak_lat"), F.col("p.lon").alias("peak_lon"),
        F.col("p.deviation").alias("peak_deviation"), F.col("p.score").alias("peak_score"), "south", "north", "centre_lat", "centre_lon", strength.alias("strength"), rank.alias("rank"), "footprint",
    )


def survey_status(dev: DataFrame, from_epoch: float, least_cells: int = 2, least_epochs: int = 2) -> DataFrame:
    """no_usable_data, insufficient_baseline or complete, with the counts behind it."""
    recent = dev.where(F.col("epoch") > from_epoch)
    frames = recent.groupBy("epoch").agg(F.count("v").alias("_seen"), F.count("deviation").alias("_ok"))
    out = frames.agg(F.coalesce(F.sum("_seen"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("supported"), F.count_if(F.col("_ok") >= least_cells).alias("supported_epochs"))
    status = F.when(F.col("scanned") == 0, "no_usable_data").when(F.col("supported_epochs") < least_epochs, "insufficient_baseline").otherwise("complete")
    return out.withColumn("status", status)
