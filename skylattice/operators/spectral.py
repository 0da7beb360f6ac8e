"""What a data set can show, and the search for plane waves in it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.plans.store import sized, stored


def capabilities(df: DataFrame, keys: list[str], at: str, value: str, least_epochs: int = 8, least_valid: float = 0.5, cells: int | None = None) -> DataFrame:
    """Per region: epochs, cadence, valid share, the admissible period band, and a status."""
    frames = df.groupBy(*keys, at).agg(F.count(value).alias("_valid"), F.count("*").alias("_cells"))
    w = Window.partitionBy(*keys).orderBy(at)
    steps = frames.withColumn("_step", F.col(at) - F.lag(at).over(w))
    whole = F.lit(cells) if cells else F.max("_cells")
    out = steps.groupBy(*keys).agg(F.count("*").alias("epochs"), F.median("_step").alias("cadence"), F.max("_step").alias("_gap"), (F.max(at) - F.min(at)).alias("span"), (F.sum("_valid") / (F.count("*") * whole)).alias("valid_share"))
    status = F.when(F.col("epochs") < least_epochs, "insufficient_samples").when(F.col("valid_share") < least_valid, "invalid_support").when(F.col("_gap") > 1.5 * F.col("cadence"), "unsupported_resolution").otherwise("supported")
    return out.select(*keys, "epochs", "cadence", "span", "valid_share", (2 * F.col("cadence")).alias("min_period"), (F.col("span") / 2).alias("max_period"), status.alias("status"))


def detrended(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Residual of each cell's linear trend: sums by cell joined back."""
    cell = [*keys, "iy", "ix"]
    fit = df.groupBy(*cell).agg(F.regr_slope(value, at).alias("_b"), F.avg(value).alias("_m"), F.avg(at).alias("_t"))
    return df.join(fit, cell).withColumn("residual", F.col(value) - F.col("_m") - F.coalesce("_b", F.lit(0.0)) * (F.col(at) - F.col("_t"))).drop("_b", "_m", "_t")


def hann(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds ``hann``: the weight of each instant in a raised-cosine window over its region's record (1 in a record of one instant)."""
    span = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    place = (F.col(at) - F.col("_a")) / (F.col("_z") - F.col("_a"))
    return df.join(span, keys).withColumn("hann", F.when(F.col("_z") > F.col("_a"), 0.5 * (1 - F.cos(2 * math.pi * place))).otherwise(1.0)).drop("_a", "_z")


def wave_power(df: DataFrame, keys: list[str], at: str, residual: str, periods: list[float], waves: list[tuple[float, float]], dy: float, dx: float, weight: str | None = None, bins: DataFrame | None = None) -> DataFrame:
    """Power of each (frequency, kx, ky) bin per region: one pass over the cells, sums added up before the shuffle.

    Amplitude and phase are those of the least-squares fit of a cos + b sin in the bin, null where the
    readings can't tell the two apart. The bins are a broadcast table of fixed size; no cube is ever on one node.
    Instead of ``periods`` and ``waves``, ``bins`` (keys, f, kx, ky) may name bins for each region.
    """
    own = bins is not None
    if not own:
        bins = df.sparkSession.createDataFrame([(1.0 / p, kx, ky) for p in periods for kx, ky in waves], "f double, kx double, ky double")
    phase = 2 * math.pi * (F.col("f") * F.col(at) - F.col("kx") * F.col("ix") * dx - F.col("ky") * F.col("iy") * dy)
    held = df.where(F.col(residual).isNotNull()).withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    spread = held.join(sized(bins, "spectral-side"), keys) if own else held.crossJoin(F.broadcast(bins))
    spread = spread.withColumn("_cos", F.cos(phase)).withColumn("_sin", F.sin(phase))
    total = lambda e, name: F.sum(F.expr(f"_w * {e}")).alias(name)
    sums = spread.groupBy(*keys, "f", "kx", "ky").agg(
        total(f"`{residual}` * _cos", "_c"), total(f"`{residual}` * _sin", "_s"), total("_cos * _cos", "_cc"), total("_sin * _sin", "_ss"), total("_sin * _cos", "_cs"), F.sum("_w").alias("_n"), F.count("*").alias("n")
    )
    det = F.expr("_cc * _ss - _cs * _cs")
    fit = lambda e: F.when(det > 1e-9 * F.expr("_n * _n"), F.expr(e) / det)
    sums = sums.withColumn("_a", fit("_ss * _c - _cs * _s")).withColumn("_b", fit("_cc * _s - _cs * _c"))
    return sums.select(*keys, "f", "kx", "ky", F.expr("(_c * _c + _s * _s) / (_n * _n)").alias("power"), F.hypot("_a", "_b").alias("amplitude"), F.atan2("_b", "_a").alias("phase"), "n")


def wave_peak(power: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest bin of each region: period, wavelength, phase speed, bearing of propagation, fit and clarity.

    ``concentration`` is the peak's share of all power; ``uniqueness`` is 1 - power of the strongest bin
    that is no neighbour of the peak (a step in frequency and each wave number) over the peak's.
    """
    places = [F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)).alias(f"_{c}") for c in ("f", "kx", "ky")]  # a table of bins a region
    placed = power.select(*power.columns, *places)
    best = placed.groupBy(*keys).agg(F.max_by(F.struct("f", "kx", "ky", "power", "amplitude", "phase", "_f", "_kx", "_ky"), F.struct("power", "f", "kx", "ky")).alias("p"), F.sum("power").alias("_all"))
    far = F.greatest(*[F.abs(F.col(f"_{c}") - F.col(f"p._{c}")) for c in ("f", "kx", "ky")]) > 1
    other = placed.join(best.select(*keys, "p").hint("merge"), keys).where(far).groupBy(*keys).agg(F.max("power").alias("_other"))
    best = best.join(other.hint("merge"), keys, "left")
    k = F.hypot("p.kx", "p.ky")
    bearing = F.pmod(F.degrees(F.atan2(F.col("p.kx"), F.col("p.ky"))), F.lit(360.0))
    return best.select(
        *keys, (1 / F.col("p.f")).alias("period"), F.when(k > 0, 1 / k).alias("wavelength"), F.when(k > 0, F.col("p.f") / k).alias("phase_speed"), F.when(k > 0, bearing).alias("bearing"), F.col("p.amplitude").alias("amplitude"), F.col("p.phase").alias("phase"),
        (F.col("p.power") / F.col("_all")).alias("concentration"), F.when(F.col("p.power") > 0, 1 - F.coalesce("_other", F.lit(0.0)) / F.col("p.power")).alias("uniqueness"),
    )


def admissible_bins(capable: DataFrame, keys: list[str], waves: list[tuple[float, float]]) -> DataFrame:
    """keys, f, kx, ky: the Fourier frequencies of each region's record whose periods lie in its admissible band.

    ``capable`` is the result of :func:`capabilities`; regions that it does not call supported have no bins.
    """
    length = F.col("epochs") * F.col("cadence")
    first, last = F.ceil(length / F.col("max_period")), F.floor(length / F.col("min_period"))
    held = capable.where("status = 'supported'").where(first <= last).withColumn("_j", F.explode(F.sequence(first, last)))
    vectors = F.array(*[F.struct(F.lit(float(kx)).alias("kx"), F.lit(float(ky)).alias("ky")) for kx, ky in waves])
    return held.select(*keys, (F.col("_j") / length).alias("f"), F.explode(vectors).alias("_k")).select(*keys, "f", "_k.kx", "_k.ky")


def refined_peak(power: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f, kx, ky of each region's strongest bin, moved along each axis to the top of a parabola.

    The parabola goes through the logarithms of the peak's power and of its two neighbours on the axis. On
    the edge of the bins, or where a neighbour has no power, the bin's own place counts on that axis.
    """
    axes = ("f", "kx", "ky")
    places = [F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)).alias(f"_{c}") for c in axes]  # a table of bins a region
    placed = power.select(*keys, *axes, "power", *places)
    best = placed.groupBy(*keys).agg(F.max_by(F.struct(*axes, "power", *[f"_{c}" for c in axes]), F.struct("power", *axes)).alias("p"))
    beside = placed.join(best.hint("merge"), keys)
    out = best
    for c in axes:
        others = [F.col(f"_{o}") == F.col(f"p._{o}") for o in axes if o != c]
        step = F.col(f"_{c}") - F.col(f"p._{c}")
        line = beside.where(others[0] & others[1] & (F.abs(step) == 1) & (F.col("power") > 0))
        ends = line.groupBy(*keys).agg(*[F.max(F.when(step == side, F.struct("power", F.col(c).alias("at")))).alias(f"_{c}{name}") for side, name in ((-1, "low"), (1, "high"))])
        out = out.join(ends.hint("merge"), keys, "left")

    def top(c: str):
        low, mid, high = F.log(f"_{c}low.power"), F.log("p.power"), F.log(f"_{c}high.power")
        bend = low - 2 * mid + high
        shift = F.when(bend < 0, 0.5 * (low - high) / bend)
        return (F.col(f"p.{c}") + F.coalesce(shift * (F.col(f"_{c}high.at") - F.col(f"_{c}low.at")) / 2, F.lit(0.0))).alias(c)

    return out.select(*keys, *[top(c) for c in axes])


def carrier_evidence(df: DataFrame, keys: list[str], at: str, residual: str, carrier: DataFrame, dy: float, dx: float, fraction: float = 0.25) -> DataFrame:
    """How long, and how steadily, each region's carrier (keys, f, kx, ky) is there.

    Each epoch's cells, Hann weights over the region's extent, are brought down by the carrier to one complex
    amplitude. An epoch is active if its amplitude is at least ``fraction`` of the 95th percentile. occupancy =
    active share of the record, cycles = active time over the period, coherence = resultant length of the
    active amplitudes' phases, weighted by size: 1 if the carrier keeps its phase, near 0 if it has none.
    """
    extent = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in ("iy", "ix") for f, n in ((F.min, "low"), (F.max, "high"))])
    side = sized(carrier.select(*keys, "f", "kx", "ky").join(extent.hint("merge"), keys), "spectral-side")
    cells = df.where(F.col(residual).isNotNull()).join(side, keys)

    def hanning(c: str):
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        return F.when(high > low, 0.5 * (1 - F.cos(2 * math.pi * (F.col(c) - low) / (high - low)))).otherwise(1.0)

    phase = 2 * math.pi * (F.col("f") * F.col(at) - F.col("kx") * F.col("ix") * dx - F.col("ky") * F.col("iy") * dy)
    cells = cells.withColumn("_w", hanning("iy") * hanning("ix")).withColumn("_ph", phase)
    part = lambda e: (2 * F.sum(F.col("_w") * F.col(residual) * e) / F.sum("_w"))
    trace = cells.groupBy(*keys, at, "f").agg(part(F.cos("_ph")).alias("_re"), part(-F.sin("_ph")).alias("_im"), F.sum("_w").alias("_sw")).where("_sw > 0")
    trace = stored(trace.withColumn("_a", F.hypot("_re", "_im")), "carrier-trace")
    level = trace.groupBy(*keys).agg(F.greatest(F.percentile("_a", F.lit(0.95)) * fraction, F.lit(1e-12)).alias("_level"))
    active = trace.join(level.hint("merge"), keys).withColumn("_on", (F.col("_a") >= F.col("_level")).cast("double"))
    w = Window.partitionBy(*keys).orderBy(at)  # a row an epoch
    active = active.withColumn("_next", F.lead(at).over(w) - F.col(at)).withColumn("_then", F.lead("_on").over(w))
    on = lambda c: F.sum(F.when(F.col("_on") > 0, F.col(c)))
    out = active.groupBy(*keys, "f").agg(
        F.sum("_on").cast("bigint").alias("active"), F.coalesce(F.sum(F.col("_next") * (F.col("_on") + F.col("_then")) / 2), F.lit(0.0)).alias("_time"), (F.max(at) - F.min(at)).alias("_span"),
        F.coalesce(F.hypot(on("_re"), on("_im")) / on("_a"), F.lit(0.0)).alias("coherence"),
    )
    return out.select(*keys, "active", F.when(F.col("_span") > 0, F.col("_time") / F.col("_span")).otherwise(0.0).alias("occupancy"), (F.col("_time") * F.abs("f")).alias("cycles"), "coherence")


def judged_waves(peaks: DataFrame, evidence: DataFrame, keys: list[str], least_concentration: float = 0.2, least_occupancy: float = 0.65, least_cycles: float = 3.0, least_coherence: float = 0.5) -> DataFrame:
    """Adds confidence (concentration x occupancy x coherence x uniqueness) and status to peaks.

    A carrier that is there for too short a time, or without a steady phase, is refused whatever its power.
    """
    both = peaks.join(evidence.hint("merge"), keys, "left")
    lasting = (F.col("occupancy") >= least_occupancy) & (F.col("cycles") >= least_cycles)
    confidence = F.col("concentration") * F.col("occupancy") * F.col("coherence") * F.coalesce("uniqueness", F.lit(0.0))
    status = F.when(~F.coalesce(lasting, F.lit(False)), "insufficient_persistence").when(F.col("coherence") < least_coherence, "no_carrier").when(F.col("concentration") < least_concentration, "low_confidence").otherwise("estimated")
    return both.withColumn("confidence", F.coalesce(confidence, F.lit(0.0))).withColumn("status", status)
