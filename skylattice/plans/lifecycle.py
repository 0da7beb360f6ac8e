"""Forecast, reconcile, supersede: set operations over all forecasts at once.

Instants are timestamps; ``now`` and cut-offs are parameters, so a sweep can be repeated. Rows that a
rule refuses keep a reason instead of disappearing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.encode import stable_id
from skylattice.operators.joins import as_of_join
from skylattice.operators.revisions import best_revision, chain_tips

GRACE_SECONDS = 6 * 3600


def issue_forecasts(requests: DataFrame, history: DataFrame, keys: list[str], minimum: float = 0.5, created: tuple[str, ...] = ()) -> DataFrame:
    """Persistence forecasts for requests (keys, origin_at, issued_at, valid_at, live).

    ``history`` has keys, observed_at, produced_at, value, coverage. The last observation at or before
    the origin is used; its quality is tested without falling back to an older one. For each name in ``created``
    (model, processing, region) requests have ``<name>_created_at``: what is newer than the forecast, or of
    unknown age, may not have a part in it.
    """
    got = as_of_join(requests, history, keys, "origin_at", "observed_at", ["value", "coverage", "produced_at"])
    reason = (
        F.when(F.col("matched_observed_at").isNull(), "no_history")
        .when(F.col("ties") > 1, "ambiguous_history")
        .when(F.col("matched_coverage") < minimum, "coverage_below_minimum")
    )
    for name in created:
        known = F.coalesce(F.col(f"{name}_created_at") <= F.col("issued_at"), F.lit(False))
        reason = reason.when(~known, f"{name}_created_after_issue")
    reason = (
        reason.when(F.col("live") & (F.col("matched_produced_at") > F.col("issued_at")), "input_not_available")
        .when(F.col("live") & (F.col("issued_at") >= F.col("valid_at")), "issued_after_valid")
    )
    out = got.withColumn("reject_reason", reason).withColumn("predicted", F.when(reason.isNull(), F.col("matched_value")))
    return out.withColumn("forecast_id", stable_id("forecast", *[F.col(k) for k in keys], F.col("origin_at"), F.col("valid_at"), F.col("matched_observed_at"))).drop("matched_value", "matched_coverage", "matched_produced_at", "ties")


def match_actuals(forecasts: DataFrame, actuals: DataFrame, keys: list[str], available: Column) -> DataFrame:
    """Each forecast with the best revision of its actual that was available; null columns if there is none."""
    rows = actuals.where(F.col("ingested_at") <= available)
    rows = best_revision(rows, [*keys, "observed_at"]).select(*keys, F.col("observed_at").alias("valid_at"), F.col("value").alias("actual"), F.col("coverage").alias("actual_coverage"), F.col("artifact_id").alias("actual_id"))
    return forecasts.join(rows, [*keys, "valid_at"], "left")


def quality_floor(value: Column, coverage: Column, cells: Column, flags: Column, disqualifying: list[str], minimum: float = 0.5) -> Column:
    """Why a readout is not good enough for a detector, or null: no finite value, no cells, too little coverage, a disqualifying flag."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    bad = F.arrays_overlap(flags, F.array(*[F.lit(f) for f in disqualifying])) if disqualifying else F.lit(False)
    return (
        F.when(~F.coalesce(finite, F.lit(False)), "no_finite_value").when(F.coalesce(cells, F.lit(0)) <= 0, "no_cells")
        .when(F.coalesce(coverage, F.lit(0.0)) < minimum, "coverage_below_minimum").when(F.coalesce(bad, F.lit(False)), "disqualifying_flag")
    )


def decide(df: DataFrame, mean: Column, sd: Column, threshold: float, minimum: float = 0.5, uncertain: Column | None = None, floor: Column | None = None) -> DataFrame:
    """Residual, score and assessment of rows with ``actual`` and ``predicted``; unknown beats candidate.

    ``floor`` (:func:`quality_floor`) says why a row may not be judged; without it, value and coverage count.
    """
    usable = F.col("actual").isNotNull() & ~F.isnan("actual") & (F.coalesce(F.col("actual_coverage"), F.lit(0.0)) >= minimum)
    if floor is not None:
        usable = usable & floor.isNull()
    residual = F.when(usable, F.col("actual") - F.col("predicted"))
    score = F.abs((residual - mean) / sd)
    anomaly = score >= threshold
    assessment = F.when(~usable, None).when(uncertain if uncertain is not None else F.lit(False), "unknown").when(anomaly, "candidate").otherwise("normal")
    return df.withColumn("usable", usable).withColumn("residual", residual).withColumn("anomaly_score", score).withColumn("is_anomaly", anomaly).withColumn("assessment", assessment)


def reconcile(decided: DataFrame, now: Column, cutoff: Column, grace: int = GRACE_SECONDS) -> DataFrame:
    """Status of forecasts due by ``cutoff``: SCORED, PENDING within the grace period, else INSUFFICIENT_DATA."""
    waiting = F.unix_seconds(now) - F.unix_seconds("valid_at") < grace
    status = F.when(F.col("valid_at") > cutoff, "NOT_DUE").when(F.col("usable"), "SCORED").when(waiting, "PENDING").otherwise("INSUFFICIENT_DATA")
    return decided.withColumn("status", status)


def retry(earlier: DataFrame, decided_now: DataFrame, key: str = "forecast_id") -> DataFrame:
    """Forecasts that had too little data and can be scored now; no grace applies."""
    stuck = earlier.where("status = 'INSUFFICIENT_DATA'").select(key)
    return decided_now.join(stuck, key, "left_semi").withColumn("status", F.when(F.col("usable"), "SCORED").otherwise("INSUFFICIENT_DATA"))


def reassess(decisions: DataFrame, decided_now: DataFrame, key: str = "forecast_id") -> DataFrame:
    """New decisions where the best actual has changed since the last one; each names the decision it supersedes."""
    w = Window.partitionBy(key).orderBy(F.desc("decided_at"), F.desc("decision_id"))
    last = decisions.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col("decision_id").alias("supersedes_decision_id"), F.col("actual_id").alias("_old"))
    changed = decided_now.where("usable").join(last, key).where(~F.col("actual_id").eqNullSafe(F.col("_old"))).drop("_old")
    return changed.withColumn("decision_id", stable_id("decision", F.col(key), F.col("actual_id")))


def search(decisions: DataFrame, start: Column, end: Column, anomaly: bool | None = None, assessment: str | None = None, tips: bool = True) -> DataFrame:
    """Decisions whose forecasts are valid in [start, end), by flag and assessment; superseded ones only on request."""
    if tips:
        decisions = chain_tips(decisions, "decision_id", "supersedes_decision_id")
    out = decisions.where((F.col("valid_at") >= start) & (F.col("valid_at") < end))
    if anomaly is not None:
        out = out.where(F.col("is_anomaly") == anomaly)
    return out if assessment is None else out.where(F.col("assessment") == assessment)


def vertical_slice(obs: DataFrame, region: str, now: Column, cutoff: Column, start: Column, end: Column, sd: float, threshold: float = 3.0, minimum: float = 0.5) -> DataFrame:
    """Load, regional readout, forecast, reconcile and search in one plan, for cells (region, day, v) of daily maps.

    A region's readout is the mean of its cells; its coverage is their number over the most on a day. Each
    readout forecasts the next day's, which is known a day after its own. Rows are the decisions valid in
    [start, end), with their status at ``now``.
    """
    readout = obs.groupBy(region, "day").agg(F.avg("v").alias("value"), F.count("v").alias("_cells"))
    most = readout.groupBy(region).agg(F.max("_cells").alias("_most"))
    at, a_day = F.timestamp_seconds(F.col("day") * 86400), F.expr("INTERVAL 1 DAY")
    readout = readout.join(most, region).select(region, "value", (F.col("_cells") / F.col("_most")).alias("coverage"), at.alias("observed_at"))
    requests = readout.select(region, F.col("observed_at").alias("origin_at"), (F.col("observed_at") + a_day).alias("issued_at"), (F.col("observed_at") + a_day).alias("valid_at"), F.lit(False).alias("live"))
    issued = issue_forecasts(requests, readout.withColumn("produced_at", F.col("observed_at")), [region], minimum).where("reject_reason IS NULL")
    known = readout.withColumn("ingested_at", F.col("observed_at") + a_day).withColumn("revision_priority", F.lit(1)).withColumn("artifact_id", F.unix_seconds("observed_at"))
    made = reconcile(decide(match_actuals(issued, known, [region], now), F.lit(0.0), F.lit(sd), threshold, minimum), now, cutoff)
    made = made.withColumn("decision_id", F.col("forecast_id")).withColumn("supersedes_decision_id", F.lit(None).cast("string"))
    return search(made, start, end)


def outcome_counts(df: DataFrame) -> DataFrame:
    """Forecasts considered, scored, short of data, and still to be retried."""
    count = lambda s: F.count_if(F.col("status") == s)
    return df.where("status <> 'NOT_DUE'").agg(F.count("*").alias("considered"), count("SCORED").alias("scored"), count("INSUFFICIENT_DATA").alias("insufficient"), count("PENDING").alias("retryable"))


def incremental_scan(readouts: DataFrame, keys: list[str], at: str, number: str, cursor: int, snapshot: int) -> DataFrame:
    """Rows to score: the latest publication of each instant up to ``snapshot``; ``fresh`` if it lies beyond the cursor.

    The rows at or below the cursor come along to rebuild the state; the cursor moves with the scores.
    """
    from skylattice.operators.revisions import latest_publication

    latest = latest_publication(readouts, [*keys, at], number, snapshot)
    return latest.withColumn("fresh", F.col(number) > cursor)
