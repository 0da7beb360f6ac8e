"""Registered queries: each operator bound to the driver's tables, and its SQL twin where SQL can express it.

Instants are seconds or days since 1970 as integers; floating results are rounded to six decimals on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import encode, geo
from skylattice.operators import aggregates as agg
from skylattice.operators import grid, joins, models, motion, pooled, revisions, spectral, timeseries, topk, tracks
from skylattice.plans import bindings as b
from skylattice.plans import lifecycle, survey
from skylattice.plans.store import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(column: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded to six decimals (nine where ties at the seventh are common), without a negative zero."""
    out = F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)
    return out.alias(name or column) if name or isinstance(column, str) else out


def rs(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


OBS, OBS6 = b.obs_sql(), b.obs_sql(6)
DAY0 = 19723  # 2024-01-01

# --- filters and projections -------------------------------------------------------------------


@query(f"WITH {OBS} SELECT day, iy, ix, {rs('v', 'v')} FROM obs WHERE lat BETWEEN -10 AND 10 AND (lon >= 170 OR lon <= -170)")
def f1_bounding_box(spark, sf_dir):
    return b.obs_grid(spark, sf_dir).where(geo.in_bounds(F.col("lat"), F.col("lon"), -10, 170, 10, -170)).select("day", "iy", "ix", r("v"))


POLYGON = [(-12.5, -178.0), (12.5, -170.0), (12.5, -150.0), (0.0, -162.0), (-12.5, -155.0)]
_EDGES = ", ".join(f"({i}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for i, (p, q) in enumerate(zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)))


@query(f"""WITH {OBS}, e(i, y1, x1, y2, x2) AS (VALUES {_EDGES}), c AS (SELECT DISTINCT iy, ix, lat, lon FROM obs)
SELECT iy, ix FROM c JOIN e ON true GROUP BY iy, ix, lat, lon
HAVING sum(CASE WHEN ((y1 > lat) <> (y2 > lat)) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or(abs((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)) <= 1e-10 AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2))""")
def f2_point_in_polygon(spark, sf_dir):
    cells = b.obs_grid(spark, sf_dir).select("iy", "ix", "lat", "lon").distinct()
    return cells.where(geo.in_polygon(F.col("lat"), F.col("lon"), POLYGON)).select("iy", "ix")


@query(f"WITH {b.REV_SQL} SELECT day, count(*) AS usable, {rs('avg(value)', 'mean_v')} FROM rev WHERE event_type NOT IN ('error', 'view') GROUP BY day")
def f3_quality_filter(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).where(encode.usable(F.col("value"), F.col("flags"), ["error", "view"]))
    return rows.groupBy("day").agg(F.count("*").alias("usable"), r(F.avg("value"), "mean_v"))


@query(f"WITH {b.obs_sql(1)} SELECT epoch, iy, ix, {rs('v', 'v')} FROM obs WHERE epoch >= {DAY0 + 4} * 86400 AND epoch < {DAY0 + 5} * 86400 AND (epoch // 3600) % 2 = 0")
def f4_owned_cadence(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir, 1)
    return obs.where((F.col("epoch") >= (DAY0 + 4) * 86400) & (F.col("epoch") < (DAY0 + 5) * 86400) & (F.col("epoch") % 7200 == 0)).select("epoch", "iy", "ix", r("v"))


@query("""WITH x AS (SELECT o_orderkey, o_custkey * 7.3 - 400 + 180.0 AS y FROM orders)
SELECT o_orderkey, round(round(y - 360 * floor(y / 360) - 180.0, 10), 6) + CAST(0 AS DOUBLE) AS lon FROM x""")
def f5_canonical_longitude(spark, sf_dir):
    lon = geo.canonical_longitude(F.col("o_custkey") * F.lit(7.3) - 400)
    return b.table(spark, sf_dir, "orders").select("o_orderkey", r(lon, "lon"))


@query(f"WITH {b.REV_SQL} SELECT series, count(*) AS n FROM rev WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND ingested_at <= TIMESTAMP '2024-01-18 12:00:00' GROUP BY series")
def f6_event_availability_window(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND ingested_at <= TIMESTAMP '2024-01-18 12:00:00'")
    return rows.groupBy("series").agg(F.count("*").alias("n"))


@query(f"""WITH {b.SERIES_SQL}, p AS (SELECT *, 2 * pi() * (dayofyear(day) - 1) / 366 AS a FROM ser)
SELECT day, {rs('(ln(1 + mean_v) - 3.5) / 0.5', 'log_mean')}, {rs('(ln(1 + median_v) - 3.5) / 0.5', 'log_median')}, {rs('n / 4000.0 * 2 - 1', 'cover')},
       CAST(0 AS DOUBLE) AS sin_hour, CAST(1 AS DOUBLE) AS cos_hour, {rs('sin(a)', 'sin_year')}, {rs('cos(a)', 'cos_year')} FROM p""")
def f7_cyclic_features(spark, sf_dir):
    s = b.daily_series(spark, sf_dir)
    features = encode.cyclic_features(F.col("day").cast("timestamp"), F.col("mean_v"), F.col("median_v"), F.col("n") / 4000.0, (3.5, 3.5), (0.5, 0.5))
    return s.select("day", *[r(c, n) for n, c in features.items()])


@query(f"WITH {b.REV_SQL} SELECT artifact_id, 'regional-' || substr(sha256(concat_ws(chr(31), series, day, revision_priority)), 1, 24) AS id FROM rev")
def f8_stable_ids(spark, sf_dir):
    return b.obs_rev(spark, sf_dir).select("artifact_id", encode.stable_id("regional", F.col("series"), F.col("day"), F.col("revision_priority")).alias("id"))


@query(f"WITH {OBS} SELECT day, iy, ix, {rs('sqrt((v - 50) * (v - 50) + lat * lat)', 'speed')}, {rs('(degrees(atan2(v - 50, lat)) + 360) - 360 * floor((degrees(atan2(v - 50, lat)) + 360) / 360)', 'bearing')} FROM obs")
def f9_speed_bearing(spark, sf_dir):
    speed, bearing = geo.speed_and_bearing(F.col("v") - 50, F.col("lat"))
    return b.obs_grid(spark, sf_dir).select("day", "iy", "ix", r(speed, "speed"), r(bearing, "bearing"))


@query(f"""WITH {OBS} SELECT day, iy, ix, {rs('(CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.5 ELSE 0.0 END) * (CASE WHEN iy % 3 = 0 THEN 0.85 ELSE 1.0 END)', 'support')},
       {rs('9.0 / (9.0 + n * n)', 'reliability')} FROM obs""")
def f10_support_weight(spark, sf_dir):
    n = F.col("n")
    weight = encode.support_weight(F.col("v"), n >= 3, n == 2, F.col("iy") % 3 == 0)
    return b.obs_grid(spark, sf_dir).select("day", "iy", "ix", r(weight, "support"), r(encode.reliability(3.0, n), "reliability"))


@query(f"WITH {OBS} SELECT day, iy, ix, CASE WHEN abs(lat * 4) > 15 THEN round((v - 50) / (lat * 4), 6) + CAST(0 AS DOUBLE) END AS relative FROM obs")
def f11_relative_anomaly(spark, sf_dir):
    return b.obs_grid(spark, sf_dir).select("day", "iy", "ix", r(encode.relative_anomaly(F.col("v") - 50, F.col("lat") * 4, 15), "relative"))


def _share_of(rows: DataFrame, number: str, part: int, of: int) -> int:
    """A snapshot bound that follows the table: ``part`` / ``of`` of its largest number."""
    return (rows.agg(F.max(number)).first()[0] or 0) * part // of


# --- revisions ---------------------------------------------------------------------------------

_ORDER = "ORDER BY revision_priority DESC, ingested_at DESC, artifact_id DESC"


@query(f"WITH {b.REV_SQL} SELECT series, day, artifact_id, {rs('value', 'value')} FROM rev QUALIFY row_number() OVER (PARTITION BY series, day {_ORDER}) = 1")
def r1_best_revision(spark, sf_dir):
    return revisions.best_revision(b.obs_rev(spark, sf_dir), ["series", "day"]).select("series", "day", "artifact_id", r("value"))


@query(f"""WITH {b.REV_SQL} SELECT series, day, artifact_id, {rs('value', 'value')} FROM rev WHERE ingested_at <= TIMESTAMP '2024-01-15 09:00:00'
QUALIFY row_number() OVER (PARTITION BY series, day {_ORDER}) = 1""")
def r2_as_of_revision(spark, sf_dir):
    instant = F.lit("2024-01-15 09:00:00").cast("timestamp")
    return revisions.as_of(b.obs_rev(spark, sf_dir), ["series", "day"], instant, ["ingested_at"]).select("series", "day", "artifact_id", r("value"))


@query(f"WITH {b.REV_SQL} SELECT series, max(artifact_id) AS artifact_id, {rs('arg_max(value, artifact_id)', 'value')} FROM rev WHERE artifact_id <= (SELECT max(artifact_id) * 4 // 5 FROM rev) GROUP BY series")
def r3_latest_publication(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).select("series", "artifact_id", "value")
    return revisions.latest_publication(rows, ["series"], "artifact_id", _share_of(rows, "artifact_id", 4, 5)).select("series", "artifact_id", r("value"))


@query(f"""WITH {b.REV_SQL} SELECT day, artifact_id FROM rev a WHERE NOT EXISTS (
SELECT 1 FROM rev c WHERE c.day = a.day AND (c.revision_priority > a.revision_priority OR (c.revision_priority = a.revision_priority AND c.artifact_id > a.artifact_id)))""")
def r4_no_newer_row(spark, sf_dir):
    return revisions.best(b.obs_rev(spark, sf_dir), ["day"], [F.desc("revision_priority"), F.desc("artifact_id")]).select("day", "artifact_id")


_CHAIN = "SELECT *, lag(artifact_id) OVER (PARTITION BY series ORDER BY ingested_at, artifact_id) AS supersedes FROM rev"


@query(f"WITH {b.REV_SQL}, c AS ({_CHAIN}) SELECT series, artifact_id FROM c WHERE artifact_id NOT IN (SELECT supersedes FROM c WHERE supersedes IS NOT NULL)")
def r5_chain_tips(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("ingested_at", "artifact_id")
    chain = b.obs_rev(spark, sf_dir).withColumn("supersedes", F.lag("artifact_id").over(w))
    return revisions.chain_tips(chain, "artifact_id", "supersedes").select("series", "artifact_id")


@query(f"""WITH {b.REV_SQL}, f AS (SELECT day, revision_priority AS frame, max(artifact_id // 500) AS late, string_agg(series || ':' || value, ',' ORDER BY series, artifact_id) AS content FROM rev GROUP BY 1, 2),
n AS (SELECT *, max(late) OVER (PARTITION BY day) AS newest FROM f)
SELECT day, max(frame) AS frame, count(*) AS rivals, count(DISTINCT content) > 1 AS conflict FROM n WHERE late = newest GROUP BY day""")
def r6_frame_conflicts(spark, sf_dir):
    frames = b.obs_rev(spark, sf_dir).withColumn("late", F.expr("artifact_id div 500"))
    return revisions.frame_conflicts(frames, "day", "revision_priority", ["series"], "value", "late").select("day", "frame", "rivals", "conflict")


@query(f"WITH {b.REV_SQL} SELECT series, revision_priority, day, artifact_id FROM rev QUALIFY row_number() OVER (PARTITION BY series, revision_priority ORDER BY day DESC, artifact_id DESC) = 1")
def r7_later_product_wins(spark, sf_dir):
    return revisions.best(b.obs_rev(spark, sf_dir), ["series", "revision_priority"], [F.desc("day"), F.desc("artifact_id")]).select("series", "revision_priority", "day", "artifact_id")


@query(f"WITH {b.REV_SQL} SELECT checksum, artifact_id FROM (SELECT *, sha256(CAST(CAST(floor(value) AS INT) AS VARCHAR)) AS checksum FROM rev) QUALIFY row_number() OVER (PARTITION BY checksum {_ORDER}) = 1")
def r8_best_by_checksum(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).withColumn("checksum", F.sha2(F.floor("value").cast("int").cast("string"), 256))
    return revisions.best_revision(rows, ["checksum"]).select("checksum", "artifact_id")


@query("""SELECT a.event_id FROM events a WHERE a.event_id > (SELECT max(event_id) // 2 FROM events) AND EXISTS (
SELECT 1 FROM events c WHERE c.event_id <= (SELECT max(event_id) // 2 FROM events) AND c.user_id = a.user_id AND c.event_type = a.event_type AND CAST(c.ts AS DATE) = CAST(a.ts AS DATE))""")
def r9_equivalent_lookup(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    known = F.col("event_id") <= _share_of(e, "event_id", 1, 2)
    return e.where(~known).join(e.where(known).select("user_id", "event_type", "day").distinct(), ["user_id", "event_type", "day"], "left_semi").select("event_id")


# --- aggregations ------------------------------------------------------------------------------


@query(f"""WITH {b.REV_SQL}, g AS (
  SELECT day, avg(value) FILTER (event_type <> 'error') AS mean_v, median(value) FILTER (event_type <> 'error') AS median_v, count(*) FILTER (event_type <> 'error') AS cell_count, count(*) AS rows_in,
         count(*) FILTER (event_type = 'error') AS ex, list(DISTINCT event_type) AS kinds FROM rev GROUP BY day), e AS (SELECT 350 * (count(DISTINCT series) / 150.0) AS expected FROM rev)
SELECT day, {rs('mean_v', 'mean_v')}, {rs('median_v', 'median_v')}, cell_count, {rs('cell_count / 400.0', 'coverage')},
  array_to_string(list_sort(list_concat(list_filter(kinds, lambda x: x <> 'error'), CASE WHEN ex > 0 THEN ['excluded_cell:error', 'excluded_cells'] ELSE [] END,
    CASE WHEN rows_in < 400 THEN ['missing_cells'] ELSE [] END, CASE WHEN cell_count / 400.0 < 0.9 THEN ['low_coverage'] ELSE [] END)), ',') AS flags,
  CASE WHEN cell_count = 0 THEN 'no_usable_cell' WHEN rows_in > 400 THEN 'too_many_cells' WHEN cell_count / 400.0 < 0.5 THEN 'coverage_below_minimum' END AS reject_reason FROM g""")
def a1_regional_readout(spark, sf_dir):
    out = agg.regional_readout(b.obs_rev(spark, sf_dir), ["day"], "value", "flags", ["error"], 400)
    return out.select("day", r("mean_v"), r("median_v"), "cell_count", r("coverage"), F.array_join("flags", ",").alias("flags"), "reject_reason")


@query(f"""WITH {b.REV_SQL}, c AS (SELECT day, series % 15 AS region, series, event_type, value FROM rev WHERE event_type IN ('signup', 'error')),
g AS (SELECT day, region, avg(value) FILTER (event_type <> 'error') AS mean_v, count(*) FILTER (event_type <> 'error') AS cell_count, count(*) AS rows_in, count(DISTINCT series) AS cells FROM c GROUP BY ALL)
SELECT day, region, {rs('mean_v', 'mean_v')}, cell_count, CASE WHEN cells < rows_in THEN 'duplicate_cell' WHEN cell_count = 0 THEN 'no_usable_cell' WHEN rows_in > 20 THEN 'too_many_cells' WHEN cell_count / 20.0 < 0.1 THEN 'coverage_below_minimum' END AS reject_reason FROM g""")
def a1_duplicate_cells(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).where("array_contains(array('signup', 'error'), flags[0])").withColumn("region", F.col("series") % 15)
    out = agg.regional_readout(rows, ["day", "region"], "value", "flags", ["error"], 20, 0.1, cell=["series"])
    return out.select("day", "region", r("mean_v"), "cell_count", "reject_reason")


@query(f"""WITH {b.obs_sql(2)}, e AS (SELECT day, epoch, count(*) AS cells, avg(v) AS m FROM obs GROUP BY ALL)
SELECT day, count(*) AS readouts, min(cells) AS least_cells, {rs('avg(m)', 'mean_v')}, CASE WHEN min(cells) < 10 THEN 'incomplete_epoch' WHEN count(*) < 6 THEN 'too_few_readouts' END AS reject_reason FROM e GROUP BY day""")
def a2_two_hour_readout(spark, sf_dir):
    epochs = b.obs_grid(spark, sf_dir, 2).groupBy("day", "epoch").agg(F.count("*").alias("cells"), F.avg("v").alias("m"))
    reason = F.when(F.min("cells") < 10, "incomplete_epoch").when(F.count("*") < 6, "too_few_readouts")
    return epochs.groupBy("day").agg(F.count("*").alias("readouts"), F.min("cells").alias("least_cells"), r(F.avg("m"), "mean_v"), reason.alias("reject_reason"))


@query(f"WITH {OBS} SELECT day, count(v) AS valid, {rs('min(v)', 'min_v')}, {rs('max(v)', 'max_v')}, {rs('avg(v)', 'mean_v')}, 1500 - count(v) AS missing FROM obs GROUP BY day")
def a3_epoch_statistics(spark, sf_dir):
    out = agg.epoch_statistics(b.obs_grid(spark, sf_dir), ["day"], "v", 1500)
    return out.select("day", "valid", r("min_v"), r("max_v"), r("mean_v"), "missing")


@query("SELECT count(*) AS rows_total, count(DISTINCT user_id) AS series, count(DISTINCT CAST(ts AS DATE)) AS days, max(event_id) AS last_id FROM events")
def a4_catalog_totals(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("rows_total"), F.count_distinct("user_id").alias("series"), F.count_distinct(F.to_date("ts")).alias("days"), F.max("event_id").alias("last_id"))


@query(f"WITH {OBS} SELECT iy, ix, {rs('avg(v - 50)', 'mean_r')}, {rs('stddev_samp(v - 50)', 'sd_r')}, count(*) AS n FROM obs GROUP BY iy, ix HAVING count(*) >= 2 AND stddev_samp(v) > 0")
def a5_residual_calibration(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir).withColumn("residual", F.col("v") - 50)
    return agg.calibration(obs, ["iy", "ix"], "residual").select("iy", "ix", r("mean_r"), r("sd_r"), "n")


@query(f"""WITH {OBS}, c AS (SELECT *, median(v) OVER (PARTITION BY iy, ix) AS centre FROM obs)
SELECT iy, ix, {rs('any_value(centre)', 'centre')}, {rs('greatest(2.0, 1.4826 * median(abs(v - centre)))', 'scale')} FROM c GROUP BY iy, ix""")
def a6_robust_scale(spark, sf_dir):
    return agg.robust_scale(b.obs_grid(spark, sf_dir), ["iy", "ix"], "v", 2.0).select("iy", "ix", r("centre"), r("scale"))


@query(f"""WITH {OBS}, m AS (SELECT day, sum(cos(radians(lat)) * v) / sum(cos(radians(lat))) AS m FROM obs GROUP BY day)
SELECT a.day, {rs('a.m', 'mean_v')}, {rs('a.m - c.m', 'difference')} FROM m a LEFT JOIN m c ON c.day = {DAY0}""")
def a7_area_mean(spark, sf_dir):
    means = b.obs_grid(spark, sf_dir).groupBy("day").agg(agg.area_mean(F.col("v"), F.col("lat")).alias("m"))
    reference = means.where(F.col("day") == DAY0).select(F.col("m").alias("m0"))
    return means.join(F.broadcast(reference), how="left").select("day", r("m", "mean_v"), r(F.col("m") - F.col("m0"), "difference"))


@query(f"WITH {OBS} SELECT day, {rs('quantile_cont(abs(v - 50), 0.95)', 'p95')} FROM obs GROUP BY day")
def a8_frame_quantile(spark, sf_dir):
    return b.obs_grid(spark, sf_dir).groupBy("day").agg(r(F.percentile(F.abs(F.col("v") - 50), F.lit(0.95)), "p95"))


_SCORED = f"""{OBS}, c AS (SELECT *, median(v) OVER (PARTITION BY iy, ix) AS centre FROM obs), k AS (SELECT iy, ix, greatest(1.0, 1.4826 * median(abs(v - centre))) AS scale FROM c GROUP BY iy, ix),
z AS (SELECT c.day, c.iy, c.ix, greatest(0.0, (abs(v - centre) - 1.0) / scale) AS s FROM c JOIN k USING (iy, ix)),
maps AS (SELECT day, quantile_cont(s, 0.95) AS score, count(s) AS cells, arg_max(iy, (s, -iy, -ix)) AS peak_iy, arg_max(ix, (s, -iy, -ix)) AS peak_ix FROM z GROUP BY day)"""


def _maps(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    scaled = obs.join(agg.robust_scale(obs, ["iy", "ix"], "v", 1.0), ["iy", "ix"]).withColumn("residual", F.col("v") - F.col("centre")).withColumn("zero", F.lit(1.0))
    return agg.map_scores(scaled, ["day"], "residual", "zero", "scale", ["iy", "ix"])


@query(f"WITH {_SCORED} SELECT day, {rs('score', 'score')}, cells, peak_iy, peak_ix FROM maps")
def a9_map_score(spark, sf_dir):
    return _maps(spark, sf_dir).select("day", r("score"), "cells", "peak_iy", "peak_ix")


@query(f"WITH {_SCORED} SELECT {rs('greatest(3.0, quantile_cont(score, 0.995))', 'threshold')} FROM maps")
def a10_calibrated_threshold(spark, sf_dir):
    return agg.calibrated_threshold(_maps(spark, sf_dir), "score").select(r("threshold"))


@query(f"WITH {OBS}, l AS (SELECT *, lag(v) OVER (PARTITION BY iy, ix ORDER BY day) AS p FROM obs) SELECT day, {rs('avg(abs(p - v))', 'mae')}, count(p) AS cells FROM l WHERE p IS NOT NULL GROUP BY day")
def a11_masked_mae(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    obs = b.obs_grid(spark, sf_dir).withColumn("p", F.lag("v").over(w)).where("p IS NOT NULL")
    return obs.groupBy("day").agg(r(agg.masked_mae(F.col("p"), F.col("v")), "mae"), F.count("p").alias("cells"))


@query(f"WITH {OBS} SELECT day, count(*) AS cells, count(*) FILTER (n >= 3) AS scored, count(*) FILTER (n = 1) AS insufficient, count(*) FILTER (n >= 2) >= 0.5 * count(*) AS available FROM obs GROUP BY day")
def a12_outcome_counts(spark, sf_dir):
    return b.obs_grid(spark, sf_dir).groupBy("day").agg(F.count("*").alias("cells"), F.count_if(F.col("n") >= 3).alias("scored"), F.count_if(F.col("n") == 1).alias("insufficient"), (F.count_if(F.col("n") >= 2) >= 0.5 * F.count("*")).alias("available"))


@query(f"""WITH {OBS}, m AS (SELECT day, iy, avg(sin(radians(lon))) AS east, avg(cos(radians(lon))) AS north FROM obs GROUP BY day, iy), d AS (SELECT *, degrees(atan2(east, north)) AS mean FROM m)
SELECT day, iy, {rs('CASE WHEN sqrt(east * east + north * north) < 1e-9 THEN NULL WHEN abs(mean) >= 180 - 1e-9 THEN -180 ELSE mean END', 'lon')} FROM d""")
def a13_circular_mean(spark, sf_dir):
    return b.obs_grid(spark, sf_dir).groupBy("day", "iy").agg(r(geo.circular_mean_longitude(F.col("lon")), "lon"))


@query(f"""WITH {OBS}, p AS (SELECT DISTINCT day, iy, lon FROM obs), g AS (SELECT *, coalesce(lead(lon) OVER (PARTITION BY day, iy ORDER BY lon), min(lon) OVER (PARTITION BY day, iy) + 360) AS nx FROM p)
SELECT day, iy, {rs('arg_max(CASE WHEN nx >= 180 THEN nx - 360 ELSE nx END, (nx - lon, lon))', 'west')}, {rs('arg_max(lon, (nx - lon, lon))', 'east')}, {rs('360 - max(nx - lon)', 'width')} FROM g GROUP BY day, iy""")
def a14_shortest_arc(spark, sf_dir):
    return agg.shortest_arc(b.obs_grid(spark, sf_dir), ["day", "iy"], "lon").select("day", "iy", r("west"), r("east"), r("width"))


@query(f"""WITH {OBS}, c AS (SELECT day, iy, ix FROM obs WHERE v > 60), s AS (
  SELECT day, count(*) AS cells, var_pop(ix * 2.0) + 4.0 / 12 AS vx, var_pop(iy * 3.0) + 9.0 / 12 AS vy, covar_pop(ix * 2.0, iy * 3.0) AS vxy FROM c GROUP BY day),
st(a, e, side) AS (VALUES (0, 1, 3.0), (0, -1, 3.0), (1, 0, 2.0), (-1, 0, 2.0)),
p AS (SELECT c.day, sum(side) AS perimeter FROM c, st WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.day = c.day AND d.iy = c.iy + a AND d.ix = c.ix + e) GROUP BY c.day)
SELECT day, cells, CAST(cells * 6.0 AS DOUBLE) AS area, CAST(perimeter AS DOUBLE) AS perimeter, {rs('least(1.0, 4 * pi() * cells * 6.0 / (perimeter * perimeter))', 'compactness')},
  {rs('sqrt(((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vxy ** 2)) / greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 1e-12))', 'elongation')} FROM s JOIN p USING (day)""")
def a15_shape_descriptors(spark, sf_dir):
    cells = b.obs_grid(spark, sf_dir).where("v > 60").select("day", "iy", "ix")
    return agg.shape_descriptors(cells, ["day"], "iy", "ix", 2.0, 3.0).select("day", "cells", "area", "perimeter", r("compactness"), r("elongation"))


@query(f"""WITH {OBS}, c AS (SELECT day, iy, ix, v, ix * 2.0 AS x, iy * 3.0 AS y FROM obs WHERE v > 60 AND iy >= 1), s AS (
  SELECT day, count(*) AS cells, sum(v) AS w, sum(v * x) / sum(v) AS mx, sum(v * y) / sum(v) AS my, min(iy) = 0 OR min(ix) = 0 OR max(iy) = {b.ROWS - 1} OR max(ix) = {b.RING - 1} AS border FROM c GROUP BY day),
m AS (SELECT day, sum(v * (x - mx) ** 2) / any_value(w) + 4.0 / 12 AS vx, sum(v * (y - my) ** 2) / any_value(w) + 9.0 / 12 AS vy, sum(v * (x - mx) * (y - my)) / any_value(w) AS vxy FROM c JOIN s USING (day) GROUP BY day)
SELECT day, cells, {rs('sqrt(((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vxy ** 2)) / greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 1e-12))', 'elongation')}, border FROM s JOIN m USING (day)""")
def a15_weighted_shapes(spark, sf_dir):
    cells = b.obs_grid(spark, sf_dir).where("v > 60 AND iy >= 1").select("day", "iy", "ix", "v")
    return agg.shape_descriptors(cells, ["day"], "iy", "ix", 2.0, 3.0, "v", (b.ROWS, b.RING)).select("day", "cells", r("elongation"), "border")


def _event_scores() -> dict[str, Column]:
    anomaly, spread = F.tanh(F.avg(F.abs(F.col("v") - 50)) / 40), F.tanh(F.stddev_pop("v") / 60)
    support = F.avg(F.when(F.col("n") >= 2, 1.0).otherwise(0.0))
    return {"quiet": support * (1 - anomaly) * (1 - spread), "localized": support * anomaly * (1 - spread), "disturbed": support * spread, "uncertain": 1 - support}


@query(f"""WITH {OBS}, m AS (SELECT day, tanh(avg(abs(v - 50)) / 40) AS a, tanh(stddev_pop(v) / 60) AS s, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS u FROM obs GROUP BY day),
q AS (SELECT day, unnest([{{'score': u * (1 - a) * (1 - s), 'name': 'quiet'}}, {{'score': u * a * (1 - s), 'name': 'localized'}}, {{'score': u * s, 'name': 'disturbed'}}, {{'score': 1 - u, 'name': 'uncertain'}}]) AS x FROM m),
o AS (SELECT day, x.name AS name, x.score AS score, row_number() OVER (PARTITION BY day ORDER BY x.score DESC, x.name DESC) AS i FROM q)
SELECT day, max(CASE WHEN i = 1 THEN name END) AS label, {rs('(max(CASE WHEN i = 1 THEN score END) - max(CASE WHEN i = 2 THEN score END)) / max(CASE WHEN i = 1 THEN score END)', 'margin')} FROM o GROUP BY day""")
def a16_event_descriptor(spark, sf_dir):
    scores = _event_scores()
    means = b.obs_grid(spark, sf_dir).groupBy("day").agg(*[c.alias(n) for n, c in scores.items()])
    label, margin = topk.best_label({n: F.col(n) for n in scores})
    return means.select("day", label.alias("label"), r(margin, "margin"))


@query("""WITH x AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, sum(CAST(floor(value) AS BIGINT)) AS s FROM events GROUP BY user_id),
k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs FROM x)
SELECT round(corr(rn, rs), 6) + CAST(0 AS DOUBLE) AS rho, count(*) AS n FROM k""")
def a17_rank_correlation(spark, sf_dir):
    users = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n_events"), F.sum(F.floor("value")).alias("total"))
    return agg.rank_correlation(users, "n_events", "total").select(r("rho"), "n")


@query("""WITH x AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS c, abs(avg(value) - 50) AS e FROM events GROUP BY user_id), n AS (SELECT count(*) AS n, greatest(1, count(*) // 3) AS third FROM x),
k AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM x),
l AS (SELECT c, count(*) AS m, avg(e) AS e, sum(count(*)) OVER (ORDER BY c) AS upto FROM x GROUP BY c), t AS (SELECT e, greatest(0, least(upto, third) - (upto - m)) AS lo, greatest(0, upto - greatest(upto - m, n - third)) AS hi FROM l, n)
SELECT round((SELECT corr(rc, re) FROM k), 6) + CAST(0 AS DOUBLE) AS rho, round(sum(lo * e) / sum(lo), 6) + CAST(0 AS DOUBLE) AS low_error, round(sum(hi * e) / sum(hi), 6) + CAST(0 AS DOUBLE) AS high_error, (SELECT n FROM n) AS n,
  (SELECT count(*) FROM x WHERE c >= 5) AS accepted, (SELECT count(*) FROM x WHERE c >= 5 AND e > 20) AS accepted_wrong FROM t""")
def a17_confidence_report(spark, sf_dir):
    users = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("confidence"), F.abs(F.avg("value") - 50).alias("error"))
    out = agg.confidence_report(users, "confidence", "error", F.col("confidence") >= 5, 20.0)
    return out.select(r("rho"), r("low_error"), r("high_error"), "n", "accepted", "accepted_wrong")


_GRAM = f"""{OBS}, l AS (SELECT ix, v AS y, lag(v) OVER (PARTITION BY iy, ix ORDER BY day) AS x FROM obs),
g AS (SELECT ix, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) + 10 AS sxx, sum(x * y) AS sxy FROM l WHERE x IS NOT NULL GROUP BY ix)"""


@query(f"WITH {_GRAM} SELECT ix, n, {rs('(sy * sxx - sx * sxy) / (n * sxx - sx * sx)', 'intercept')}, {rs('(n * sxy - sx * sy) / (n * sxx - sx * sx)', 'before')} FROM g")
def a18_ridge_fit(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    pairs = b.obs_grid(spark, sf_dir).withColumn("before", F.lag("v").over(w)).where("before IS NOT NULL").withColumnRenamed("v", "target")
    return agg.ridge_fit(pairs, ["ix"], ["before"], "target", 10.0).select("ix", "n", r("intercept"), r("before"))


# --- joins -------------------------------------------------------------------------------------


def _forecasts(spark, sf_dir) -> DataFrame:
    """Persistence forecasts of the daily value of each series: that of the day before."""
    w = Window.partitionBy("series").orderBy("day")
    days = b.obs_rev(spark, sf_dir).groupBy("series", "day").agg(F.avg("value").alias("value"))
    return days.select("series", "day", F.date_add("day", 1).alias("valid_day"), F.col("value").alias("predicted"))


_FORECASTS = "f AS (SELECT series, day, CAST(day + INTERVAL 1 DAY AS DATE) AS valid_day, avg(value) AS predicted FROM rev GROUP BY 1, 2)"


@query(f"""WITH {b.REV_SQL}, {_FORECASTS}
SELECT f.series, f.valid_day, {rs('predicted', 'predicted')}, artifact_id, {rs('value', 'actual')} FROM f JOIN rev ON rev.series = f.series AND rev.day = f.valid_day AND ingested_at <= TIMESTAMP '2024-01-25 10:00:00'
QUALIFY row_number() OVER (PARTITION BY f.series, f.valid_day {_ORDER}) = 1""")
def j1_forecast_actual(spark, sf_dir):
    actuals = b.obs_rev(spark, sf_dir).where("ingested_at <= TIMESTAMP '2024-01-25 10:00:00'").withColumnRenamed("day", "valid_day")
    joined = _forecasts(spark, sf_dir).join(actuals, ["series", "valid_day"])
    return revisions.best_revision(joined, ["series", "valid_day"]).select("series", "valid_day", r("predicted"), "artifact_id", r("value", "actual"))


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS value, count(*) AS ties FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT a.event_id, c.t AS matched_t, round(c.value, 6) + CAST(0 AS DOUBLE) AS matched_value, c.ties FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t >= c.t""")
def j2_as_of_join(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    out = joins.as_of_join(left, e.where("event_type = 'view'"), ["user_id"], "t", "t", ["value"])
    return out.select("event_id", "matched_t", r("matched_value"), "ties")


_SECONDS = "CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60"


def _minutes() -> Column:
    return F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60


@query(f"""WITH k AS (SELECT DISTINCT ({_SECONDS}) // 10800 * 10800 AS t0 FROM events WHERE event_type = 'error' AND value > 150), k2 AS (SELECT t0, CAST(t0 % 7 AS DOUBLE) AS kp FROM k),
w AS (SELECT event_id, {_SECONDS} AS s, {_SECONDS} + (event_id % 9) * 1800 AS e FROM events WHERE event_type = 'purchase')
SELECT event_id, max(kp) AS max_value, count(kp) AS n_matches, CASE WHEN count(kp) > 0 THEN 'available' ELSE 'unavailable' END AS status
FROM w LEFT JOIN k2 ON t0 <= e AND t0 + 10800 > s GROUP BY event_id""")
def j3_interval_overlap(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").withColumn("s", _minutes()).withColumn("e", F.col("s") + (F.col("event_id") % 9) * 1800)
    context = e.where("event_type = 'error' AND value > 150").select(F.expr("s div 10800 * 10800").alias("at")).distinct().withColumn("kp", (F.col("at") % 7).cast("double"))
    out = joins.overlap_join(e.where("event_type = 'purchase'").select("event_id", "s", "e"), context, "s", "e", "at", 10800, "kp", "event_id")
    return out.select("event_id", "max_value", "n_matches", "status")


@query(f"""WITH {OBS6} SELECT o.iy, o.ix, o.epoch, count(p.v) AS n_prior, round(median(p.v), 6) + CAST(0 AS DOUBLE) AS baseline FROM obs o
LEFT JOIN obs p ON p.iy = o.iy AND p.ix = o.ix AND p.epoch % 86400 = o.epoch % 86400 AND p.day BETWEEN o.day - 7 AND o.day - 1 GROUP BY ALL""")
def j4_same_time_prior_days(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir, 6).withColumn("slot", F.col("epoch") % 86400)
    out = joins.same_time_history(obs, ["iy", "ix"], "day", "slot", "v", 7)
    return out.select("iy", "ix", "epoch", F.col("n_prior").cast("bigint").alias("n_prior"), r(joins.array_median("prior"), "baseline"))


TARGET_LATS, TARGET_LONS = grid.target_axis(-15.0, 15.0, 4.0), grid.target_axis(-178.0, 176.0, 5.0)


def _corners(spark):
    return grid.corner_table(spark, *b.axes(), 2.5, 3.6, TARGET_LATS, TARGET_LONS)


_listed = lambda values: ", ".join(map(str, enumerate(values)))
_TARGETS = f"""tl(ty, y) AS (SELECT * FROM (VALUES {_listed(TARGET_LATS)})), tn(tx, x) AS (VALUES {_listed(TARGET_LONS)}),
ya AS (SELECT ty, CAST(y AS DOUBLE) AS y, (CAST(y AS DOUBLE) + 17.5) / 2.5 AS a FROM tl), xa AS (SELECT tx, CAST(x AS DOUBLE) AS x, (CAST(x AS DOUBLE) + 180) / 3.6 AS a FROM tn),
yc AS (SELECT ty, y, CAST(floor(a + 1e-9) AS INT) AS iy, CASE WHEN abs(a - floor(a + 1e-9)) < 1e-9 THEN 1.0 ELSE 1 - (a - floor(a + 1e-9)) END AS w, a FROM ya UNION ALL SELECT ty, y, CAST(floor(a + 1e-9) AS INT) + 1, a - floor(a + 1e-9), a FROM ya WHERE abs(a - floor(a + 1e-9)) >= 1e-9),
xc AS (SELECT tx, x, CAST(floor(a + 1e-9) AS INT) AS ix, CASE WHEN abs(a - floor(a + 1e-9)) < 1e-9 THEN 1.0 ELSE 1 - (a - floor(a + 1e-9)) END AS w FROM xa UNION ALL SELECT tx, x, CAST(floor(a + 1e-9) AS INT) + 1, a - floor(a + 1e-9) FROM xa WHERE abs(a - floor(a + 1e-9)) >= 1e-9),
co AS (SELECT ty, tx, iy, ix, yc.w * xc.w AS weight, count(*) OVER (PARTITION BY ty, tx) AS needed FROM yc, xc)"""


@query(f"WITH {OBS}, {_TARGETS} SELECT day, ty, tx, {rs('sum(weight * v)', 'weighted')}, count(*) AS corners FROM obs JOIN co USING (iy, ix) GROUP BY day, ty, tx HAVING count(*) = max(needed)")
def j5_grid_corner_join(spark, sf_dir):
    out = grid.interpolate(b.obs_grid(spark, sf_dir), ["day"], _corners(spark), "v")
    return out.where("reject_reason IS NULL").select("day", "ty", "tx", r("v", "weighted"), "corners")


_REGIONS = [("north", 5.0, -180.0, 20.0, -160.0), ("south", -20.0, -175.0, -5.0, -150.0), ("across", -10.0, 170.0, 10.0, -172.0)]


@query(f"""WITH {OBS}, g(region, south, west, north, east) AS (VALUES {', '.join(map(str, _REGIONS))})
SELECT region, day, count(*) AS cells, {rs('avg(v)', 'mean_v')} FROM obs JOIN g ON lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END GROUP BY region, day""")
def j6_region_membership(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    cells = obs.select("iy", "ix", "lat", "lon").distinct()
    members = [cells.where(geo.in_bounds(F.col("lat"), F.col("lon"), s, w, n, e)).select("iy", "ix", F.lit(name).alias("region")) for name, s, w, n, e in _REGIONS]
    table = members[0].unionByName(members[1]).unionByName(members[2])
    return obs.join(table, ["iy", "ix"]).groupBy("region", "day").agg(F.count("*").alias("cells"), r(F.avg("v"), "mean_v"))


@query("""WITH l AS (SELECT user_id, max(event_id) AS readout_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id),
s AS (SELECT user_id, event_id AS score_id FROM events WHERE event_type = 'purchase' AND value > 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, readout_id, round(value, 6) + CAST(0 AS DOUBLE) AS value, score_id FROM l LEFT JOIN s USING (user_id)""")
def j7_latest_with_score(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    latest = revisions.latest_publication(e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("readout_id"), "value"), ["user_id"], "readout_id")
    scores = revisions.best(e.where("event_type = 'purchase' AND value > 100"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_id").alias("score_id"))
    return latest.join(scores, "user_id", "left").select("user_id", "readout_id", r("value"), "score_id")


@query(f"WITH {OBS}, c AS (SELECT DISTINCT day FROM obs WHERE v > 280) SELECT DISTINCT day FROM obs WHERE day IN (SELECT day FROM c) OR day - 1 IN (SELECT day FROM c)")
def j8_changed_days(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    return joins.changed_and_next(obs.select("day").distinct(), obs.where("v > 280").select("day"), "day")


@query(f"""WITH {OBS}, n AS (SELECT o.day, o.iy, o.ix, avg(p.v) AS m, count(p.v) AS k FROM obs o LEFT JOIN obs p ON p.day = o.day AND ((p.iy = o.iy AND (p.ix = (o.ix + 1) % {b.RING} OR p.ix = (o.ix + {b.RING - 1}) % {b.RING})) OR (p.ix = o.ix AND abs(p.iy - o.iy) = 1)) GROUP BY ALL)
SELECT day, iy, ix, {rs('m', 'neighbour_mean')}, k AS neighbours FROM n""")
def j9_neighbour_join(spark, sf_dir):
    out = joins.neighbour_join(b.obs_grid(spark, sf_dir), ["day"], "iy", "ix", "v", b.RING)
    return out.select("day", "iy", "ix", r("neighbour_mean"), "neighbours")


@query("""WITH x AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS key, o.o_orderkey, o.o_orderdate, l.l_shipdate, s.s_suppkey, n.n_nationkey FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey)
SELECT rule, key FROM (SELECT key, unnest(['order_exists', 'shipped_after_order', 'supplier_exists', 'nation_exists']) AS rule, unnest([o_orderkey IS NOT NULL, coalesce(l_shipdate >= o_orderdate, false), s_suppkey IS NOT NULL, n_nationkey IS NOT NULL]) AS ok FROM x) WHERE NOT ok""")
def j10_provenance_check(spark, sf_dir):
    t = lambda n: b.table(spark, sf_dir, n)
    x = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_orderkey", "l_suppkey", "l_shipdate")
    x = x.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rules = {"order_exists": F.col("o_orderkey").isNotNull(), "shipped_after_order": F.col("l_shipdate") >= F.col("o_orderdate"), "supplier_exists": F.col("s_suppkey").isNotNull(), "nation_exists": F.col("n_nationkey").isNotNull()}
    return joins.violations(x, "key", rules)


@query(f"""WITH {OBS}, c AS (SELECT day, iy, ix, v FROM obs WHERE v > 150), k AS (SELECT DISTINCT day FROM obs WHERE n >= 8)
SELECT c.day, iy, ix, {rs('v', 'v')}, k.day IS NOT NULL AS also_flagged FROM c LEFT JOIN k ON k.day = c.day""")
def j11_also_flagged(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    other = obs.where("n >= 8").select("day", F.lit(True).alias("_hit")).distinct()
    return obs.where("v > 150").join(other, "day", "left").select("day", "iy", "ix", r("v"), F.col("_hit").isNotNull().alias("also_flagged"))


# --- time series -------------------------------------------------------------------------------


@query(f"""WITH {OBS}, s AS (SELECT iy, ix, day - lag(day) OVER (PARTITION BY iy, ix ORDER BY day) AS step FROM obs)
SELECT iy, ix, count(*) AS n, CAST(median(step) AS DOUBLE) AS cadence, max(step) AS max_gap, max(step) = min(step) AS regular FROM s GROUP BY iy, ix""")
def w1_gap_report(spark, sf_dir):
    return timeseries.gap_report(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day")


@query(f"""WITH {OBS}, q AS (SELECT DISTINCT iy, ix FROM obs), k AS (SELECT iy, ix, day FROM obs WHERE n >= 2 AND day BETWEEN {DAY0} AND {DAY0 + 29}), s AS (SELECT *, day - lag(day) OVER (PARTITION BY iy, ix ORDER BY day) - 1 AS gap FROM k),
g AS (SELECT iy, ix, greatest(0, min(day) - {DAY0}, {DAY0 + 29} - max(day), coalesce(max(gap), 0)) AS missing_gap, count(*) AS n FROM s GROUP BY iy, ix)
SELECT q.iy, q.ix, g.missing_gap, coalesce(g.n, 0) AS n FROM q LEFT JOIN g ON g.iy = q.iy AND g.ix = q.ix""")
def w1_missing_gap(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    return timeseries.missing_gap(obs.where("n >= 2"), ["iy", "ix"], "day", 1, DAY0, DAY0 + 29, obs).select("iy", "ix", "missing_gap", "n")


_SLOTS = f"{OBS}, sp AS (SELECT iy, ix, unnest(range(min(day), max(day) + 1)) AS day FROM obs GROUP BY iy, ix), j AS (SELECT sp.iy, sp.ix, sp.day, v FROM sp LEFT JOIN obs USING (iy, ix, day))"


@query(f"WITH {_SLOTS} SELECT iy, ix, day, round(last_value(v IGNORE NULLS) OVER (PARTITION BY iy, ix ORDER BY day ROWS UNBOUNDED PRECEDING), 6) + CAST(0 AS DOUBLE) AS v, CAST(CASE WHEN v IS NULL THEN 1e-6 ELSE 0.96 END AS DOUBLE) AS coverage, v IS NULL AS carried FROM j")
def w2_regular_slots(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir).withColumn("coverage", F.lit(0.96))
    out = timeseries.regular_slots(obs, ["iy", "ix"], "day", 1, ["v"], "coverage")
    return out.select("iy", "ix", "day", r("v"), "coverage", "carried")


@query(f"""WITH {_SLOTS}, p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER a AS t0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER z AS t1, first_value(v IGNORE NULLS) OVER z AS v1 FROM j
WINDOW a AS (PARTITION BY iy, ix ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY iy, ix ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT iy, ix, day, round(coalesce(v, CASE WHEN t1 - t0 <= 2 THEN v0 + (day - t0) * (v1 - v0) / (t1 - t0) END), 6) + CAST(0 AS DOUBLE) AS v, v IS NULL AS interpolated FROM p""")
def w3_fill_axis(spark, sf_dir):
    out = timeseries.fill_axis(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", 1, 2)
    return out.select("iy", "ix", "day", r("v"), "interpolated")


@query(f"""WITH {OBS} SELECT iy, ix, day, CASE WHEN count(v) OVER w = 5 THEN round(quantile_cont(v, 0.5) OVER w, 6) + CAST(0 AS DOUBLE) END AS baseline FROM obs
WINDOW w AS (PARTITION BY iy, ix ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w4_rolling_median(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    return b.obs_grid(spark, sf_dir).select("iy", "ix", "day", r(timeseries.rolling_median("v", w, 2), "baseline"))


@query(f"""WITH {OBS} SELECT iy, ix, day, CASE WHEN count(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN
  round((-3 * lag(v, 2) OVER w + 12 * lag(v) OVER w + 17 * v + 12 * lead(v) OVER w - 3 * lead(v, 2) OVER w) / 35, 6) + CAST(0 AS DOUBLE) END AS baseline FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day)""")
def w5_savgol(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    out = timeseries.savgol(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", 5, 2)
    inner = F.count("v").over(w.rowsBetween(-2, 2)) == 5
    return out.select("iy", "ix", "day", F.when(inner, r("baseline")).alias("baseline"))


@query(f"""WITH {OBS}, c AS (SELECT a.iy, a.ix, a.day, a.v, list(p.v) AS l, median(p.v) AS centre FROM obs a JOIN obs p ON p.iy = a.iy AND p.ix = a.ix AND p.day <= a.day GROUP BY ALL)
SELECT iy, ix, day, round((v - centre) / greatest(1.0, 1.4826 * list_median(list_transform(l, lambda x: abs(x - centre)))), 6) + CAST(0 AS DOUBLE) AS z FROM c""")
def w6_expanding_score(spark, sf_dir):
    return timeseries.expanding_score(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", 1.0).select("iy", "ix", "day", r("z"))


@query(f"""WITH {OBS}, o AS (SELECT *, iy % 3 AS region FROM obs), d AS (SELECT DISTINCT region, day FROM o), p AS (SELECT d.region, d.day, list(o.v) AS l FROM d JOIN o ON o.region = d.region AND o.day <= d.day GROUP BY ALL), m AS (SELECT *, list_median(l) AS centre FROM p),
s AS (SELECT region, day, centre, greatest(1.0, 1.4826 * list_median(list_transform(l, lambda x: abs(x - centre)))) AS scale FROM m)
SELECT iy, ix, day, {rs('centre', 'centre')}, {rs('scale', 'scale')}, {rs('(v - centre) / scale', 'z')} FROM o JOIN s USING (region, day)""")
def w6_pooled_score(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir).withColumn("region", F.col("iy") % 3)
    return pooled.pooled_score(obs, ["region"], "day", "v", 1.0).select("iy", "ix", "day", r("centre"), r("scale"), r("z"))


@query(f"""WITH {OBS}, n AS (SELECT *, lag(v) OVER w AS v0, lag(day) OVER w AS t0, lead(v) OVER w AS v1, lead(day) OVER w AS t1 FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day))
SELECT iy, ix, day, round(CASE WHEN t0 IS NULL THEN (v1 - v) / (t1 - day) WHEN t1 IS NULL THEN (v - v0) / (day - t0)
  ELSE ((v - v0) / (day - t0) * (t1 - day) + (v1 - v) / (t1 - day) * (day - t0)) / (t1 - t0) END, 6) + CAST(0 AS DOUBLE) AS rate FROM n""")
def w7_time_derivative(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    return b.obs_grid(spark, sf_dir).select("iy", "ix", "day", r(timeseries.derivative("v", "day", w), "rate"))


_ISLANDS = f"{OBS}, a AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY iy, ix ORDER BY day) <= 1 THEN 0 ELSE 1 END AS new FROM obs), i AS (SELECT *, sum(new) OVER (PARTITION BY iy, ix ORDER BY day) AS island FROM a)"


@query(f"""WITH {_ISLANDS} SELECT iy, ix, day, {rs('list_sum(w)', 'window_sum')}, {rs('w[1]', 'oldest')} FROM (SELECT *, list(v) OVER (PARTITION BY iy, ix, island ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS w, row_number() OVER (PARTITION BY iy, ix, island ORDER BY day) AS p FROM i) WHERE p > 4""")
def w8_causal_windows(spark, sf_dir):
    out = timeseries.causal_windows(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", 1, 4)
    return out.select("iy", "ix", "day", r(F.aggregate("window", F.lit(0.0), lambda s, x: s + x), "window_sum"), r(F.get("window", 0), "oldest"))


@query(f"WITH {_ISLANDS} SELECT iy, ix, day, round(v - lag(v, 3) OVER (PARTITION BY iy, ix, island ORDER BY day), 6) + CAST(0 AS DOUBLE) AS residual FROM i")
def w9_prior_reference(spark, sf_dir):
    return timeseries.lag_in_island(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", 1, 3).select("iy", "ix", "day", r("residual"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT day, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'validation' WHEN i < floor(n * 0.9::DOUBLE) THEN 'calibration' ELSE 'test' END AS part FROM n""")
def w10_chronological_split(spark, sf_dir):
    days = b.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return timeseries.chronological_split(days, "day")


@query(f"""WITH {OBS}, l AS (SELECT iy, ix, day, v, lead(v) OVER w AS target, lead(n) OVER w AS c FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day)),
k AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY day) AS i, count(*) OVER (PARTITION BY iy, ix) AS m FROM l WHERE c > 1)
SELECT iy, ix, day, {rs('target', 'target')}, CASE WHEN i > m - floor(m * 0.25::DOUBLE) THEN 'calibration' ELSE 'fit' END AS part FROM k""")
def w11_next_step_pairs(spark, sf_dir):
    out = timeseries.next_step_pairs(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", "n", 0.25, 1)
    return out.select("iy", "ix", "day", r("target"), "part")


@query(f"""WITH {OBS}, k AS (SELECT iy, ix, day, day - row_number() OVER (PARTITION BY iy, ix ORDER BY day) AS g FROM obs WHERE n >= 2)
SELECT iy, ix, max(c) AS longest FROM (SELECT iy, ix, count(*) AS c FROM k GROUP BY iy, ix, g) GROUP BY iy, ix""")
def w12_longest_run(spark, sf_dir):
    return timeseries.longest_run(b.obs_grid(spark, sf_dir).withColumn("ok", F.col("n") >= 2), ["iy", "ix"], "day", "ok", 1)


@query(f"WITH {OBS} SELECT day, CAST(iy // 2 AS INT) AS by, CAST(ix // 2 AS INT) AS bx, {rs('avg(v)', 'v')} FROM obs GROUP BY ALL HAVING count(v) = 4")
def w13_block_mean(spark, sf_dir):
    return timeseries.block_mean(b.obs_grid(spark, sf_dir), ["day"], "iy", "ix", "v", 2).select("day", "by", "bx", r("v"))


@query(f"""WITH {b.obs_sql(12)}, t AS (SELECT epoch FROM (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS k FROM (SELECT DISTINCT epoch FROM obs)) WHERE k % 3 = 0)
SELECT epoch, CAST(iy // 2 AS INT) AS by, CAST(ix // 2 AS INT) AS bx, {rs('avg(v)', 'v')}, {rs('CASE WHEN min(2 - n) >= 0 THEN avg(2 - n) + 0.5 END', 'rms')} FROM obs JOIN t USING (epoch) GROUP BY ALL HAVING count(v) = 4""")
def w13_degrade(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir, 12).withColumn("rms", (2 - F.col("n")).cast("double"))
    return timeseries.degrade(obs, [], "epoch", "iy", "ix", "v", "rms", 2, 3, 0.5).select("epoch", "by", "bx", r("v"), r("rms"))


@query(f"""WITH {OBS}, k AS (SELECT day, iy, ix, row_number() OVER (PARTITION BY day ORDER BY iy, ix) - 1 AS i, count(*) OVER (PARTITION BY day) AS m FROM obs), s AS (SELECT *, (i + 3) % m AS j FROM k)
SELECT day, iy, ix FROM s WHERE m <= 20 OR floor(j * 20 / m::DOUBLE) <> floor((j - 1) * 20 / m::DOUBLE)""")
def w14_even_sample(spark, sf_dir):
    return timeseries.even_sample(b.obs_grid(spark, sf_dir), ["day"], ["iy", "ix"], 20, 3).select("day", "iy", "ix")


def _fold_sql(key: str, at: str) -> str:
    """The recurrence over rows s(key, at, x, i) as a recursion: score from the state before a row, then the new state."""
    return f"""fold AS (SELECT {key}, {at}, i, x AS forecast, CAST(0 AS DOUBLE) AS score, 1 AS n, x AS mean, CAST(0 AS DOUBLE) AS m2, CAST(0 AS DOUBLE) AS h FROM s WHERE i = 1
UNION ALL SELECT {key}, {at}, i, mean + scale * h, CASE WHEN n > 1 THEN abs(x - mean - scale * h) / scale ELSE 0.0 END, n + 1, mean + (x - mean) / (n + 1), m2 + (x - mean) * (x - (mean + (x - mean) / (n + 1))), a * h + (1 - a) * tanh(z)
FROM (SELECT *, 0.9 ** (1 + 0.5 * least(abs(z), 10.0)) AS a FROM (SELECT *, (x - mean) / scale AS z FROM (SELECT {', '.join(f's.{c.strip()}' for c in f'{key}, {at}'.split(','))}, s.i, s.x, n, mean, m2, h, CASE WHEN n > 1 THEN greatest(sqrt(m2 / (n - 1)), 1e-6) ELSE 1.0 END AS scale
  FROM fold JOIN s ON s.i = fold.i + 1 AND {' AND '.join(f's.{c.strip()} = fold.{c.strip()}' for c in key.split(','))}))))"""


@query(f"""WITH RECURSIVE {OBS}, s AS (SELECT iy, ix, day, v AS x, row_number() OVER (PARTITION BY iy, ix ORDER BY day) AS i FROM obs), {_fold_sql('iy, ix', 'day')}
SELECT iy, ix, day, {rs('forecast', 'forecast')}, {rs('score', 'score')}, score >= 4.5 AS candidate FROM fold""")
def w15_recurrence(spark, sf_dir):
    out = timeseries.recurrence(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v")
    return out.select("iy", "ix", "day", r("forecast"), r("score"), "candidate")


# --- order, limits, sets -----------------------------------------------------------------------


@query("SELECT event_id, round(value, 6) + CAST(0 AS DOUBLE) AS value FROM events ORDER BY value DESC, ts DESC, event_id LIMIT 50")
def k1_top_candidates(spark, sf_dir):
    return topk.top(b.table(spark, sf_dir, "events"), [F.desc("value"), F.desc("ts"), F.col("event_id")], 50).select("event_id", r("value"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id")
def k2_pending_list(spark, sf_dir):
    return b.table(spark, sf_dir, "events").where("event_type = 'signup' AND ts <= TIMESTAMP_NTZ '2024-01-20 00:00:00'").orderBy("ts", "event_id").select("event_id", "user_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5 ORDER BY 1, 2")
def k3_last_n(spark, sf_dir):
    return revisions.last_n(b.table(spark, sf_dir, "events"), ["user_id"], "event_id", 5).select("user_id", "event_id")


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT day, iy, ix FROM obs WHERE v > 150), c AS (SELECT DISTINCT day, iy, ix FROM obs WHERE n >= 4)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM c)) AS "both", (SELECT count(*) FROM (FROM a EXCEPT FROM c)) AS only_a, (SELECT count(*) FROM (FROM c EXCEPT FROM a)) AS only_b,
       round((SELECT count(*) FROM (FROM a INTERSECT FROM c)) / (SELECT count(*) FROM (FROM a UNION FROM c))::DOUBLE, 6) + CAST(0 AS DOUBLE) AS overlap""")
def k5_compare_sets(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    return topk.compare_sets(obs.where("v > 150"), obs.where("n >= 4"), ["day", "iy", "ix"]).select("both", "only_a", "only_b", r("overlap"))


@query("""WITH x AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id),
q AS (SELECT user_id, CAST(unnest([c, e, v]) AS DOUBLE) AS score, unnest(['click', 'error', 'view']) AS name FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, name DESC) AS i FROM q)
SELECT user_id, max(CASE WHEN i = 1 THEN name END) AS label, round((max(CASE WHEN i = 1 THEN score END) - max(CASE WHEN i = 2 THEN score END)) / greatest(max(CASE WHEN i = 1 THEN score END), 1e-12), 6) + CAST(0 AS DOUBLE) AS margin FROM o GROUP BY user_id""")
def k6_argmax_label(spark, sf_dir):
    kinds = ("click", "error", "view")
    counts = b.table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    label, margin = topk.best_label({k: F.col(k) for k in kinds})
    return counts.select("user_id", label.alias("label"), r(margin, "margin"))


@query(f"WITH {OBS} SELECT iy, ix, max(day) AS day, {rs('arg_max(v, day)', 'v')}, count(*) AS versions FROM obs GROUP BY iy, ix")
def k7_merge_series(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir).withColumn("source", F.pmod("day", F.lit(6)).cast("string"))
    parts = [obs.where(F.col("source") == str(i)) for i in range(6)]
    whole, _ = topk.merge_series(parts, "source", ["lat"], ["iy", "ix"])
    return whole.groupBy("iy", "ix").agg(F.max("day").alias("day"), r(F.max_by("v", "day"), "v"), F.count("*").alias("versions"))


@query(f"""WITH {b.REV_SQL}, p AS (SELECT *, series % 15 AS iy FROM rev WHERE event_type <> 'error' OR series % 15 < 7), x AS (SELECT event_type, list_sort(list(DISTINCT iy)) AS axis FROM p GROUP BY event_type),
odd AS (SELECT event_type FROM x WHERE axis <> (SELECT axis FROM x ORDER BY event_type LIMIT 1)), g AS (SELECT * FROM p WHERE event_type NOT IN (SELECT event_type FROM odd))
SELECT series, day, 'row' AS kind, artifact_id, event_type AS source FROM g QUALIFY row_number() OVER (PARTITION BY series, day ORDER BY revision_priority DESC, ingested_at DESC, artifact_id DESC) = 1
UNION ALL SELECT NULL, NULL, 'refused', NULL, event_type FROM odd""")
def k7_concatenate(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).select("*", F.col("flags")[0].alias("source"), (F.col("series") % 15).alias("iy")).where("source <> 'error' OR iy < 7")
    parts = [rows.where(F.col("source") == k) for k in b.EVENT_TYPES]
    whole, odd = topk.merge_series(parts, "source", ["iy"], ["series", "day"], [F.desc("revision_priority"), F.desc("ingested_at"), F.desc("artifact_id")])
    return whole.select("series", "day", F.lit("row").alias("kind"), "artifact_id", "source").unionByName(odd.select("source", F.lit("refused").alias("kind")), allowMissingColumns=True)


# --- grids and fields --------------------------------------------------------------------------


@query(f"""WITH {OBS}, {_TARGETS} SELECT day, ty, tx, CASE WHEN count(*) = max(needed) THEN round(sum(weight * v), 6) + CAST(0 AS DOUBLE) END AS v, count(*) AS corners, CASE WHEN count(*) < max(needed) THEN 'missing_corner' END AS reject_reason
FROM obs JOIN co USING (iy, ix) GROUP BY day, ty, tx""")
def g1_regional_table(spark, sf_dir):
    out = grid.interpolate(b.obs_grid(spark, sf_dir), ["day"], _corners(spark), "v")
    return out.select("day", "ty", "tx", r("v"), "corners", "reject_reason")


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT day, ix, lat FROM obs), s AS (SELECT day, ix, lat, round(lead(lat) OVER (PARTITION BY day, ix ORDER BY lat) - lat, 9) AS gap FROM a), t AS (SELECT *, min(gap) OVER (PARTITION BY day, ix) AS step FROM s)
SELECT day, ix, {rs('min(step)', 'step')}, {rs('min(lat)', 'first')}, {rs('max(lat)', 'last')}, count(*) AS size, CASE WHEN count(*) < 2 THEN 'ambiguous' WHEN count(*) FILTER (gap > step + 1e-9) = 0 THEN 'regular' WHEN count(*) FILTER (gap > step + 1e-9) = 1 THEN 'cut' ELSE 'ambiguous' END AS status FROM t GROUP BY day, ix""")
def g2_axis_inference(spark, sf_dir):
    out = grid.axis(b.obs_grid(spark, sf_dir), ["day", "ix"], "lat")
    return out.select("day", "ix", r("step"), r("first"), r("last"), "size", "status")


@query(f"""WITH {OBS}, d AS (SELECT DISTINCT day FROM obs), c AS (SELECT CAST(y AS INT) AS iy, CAST(x AS INT) AS ix FROM range({b.ROWS}) a(y), range({b.RING}) e(x)),
k AS (SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, CAST(user_id % 15 AS INT) AS iy, CAST(user_id // 15 % {b.RING} AS INT) AS ix, CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END) AS BIGINT) AS mask FROM events GROUP BY ALL)
SELECT d.day, c.iy, c.ix, {rs('v', 'v')}, v IS NOT NULL AS valid, coalesce(mask, 0) AS mask FROM d, c LEFT JOIN obs ON obs.day = d.day AND obs.iy = c.iy AND obs.ix = c.ix LEFT JOIN k ON k.day = d.day AND k.iy = c.iy AND k.ix = c.ix""")
def g3_densify(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    full = grid.densify(obs, obs.select("day").distinct(), *b.axes(), "v")
    e = b.table(spark, sf_dir, "events").select(F.unix_date(F.to_date("ts")).cast("bigint").alias("day"), b.cell_row().alias("iy"), b.cell_column().alias("ix"), "event_type")
    masks = e.groupBy("day", "iy", "ix").agg(encode.flag_mask(F.collect_set("event_type"), list(b.EVENT_TYPES)).alias("mask"))
    return full.join(masks, ["day", "iy", "ix"], "left").select("day", "iy", "ix", r("v"), "valid", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))


@query(f"""WITH {OBS}, off AS (SELECT CAST(a AS INT) AS dy, CAST(e AS INT) AS dx, (1 - abs(a) / 3.0::DOUBLE) * (1 - abs(e) / 4.0::DOUBLE) AS w FROM range(-2, 3) x(a), range(-3, 4) y(e)),
t AS (SELECT day, iy * 3 + dy AS ty, (ix * 4 + dx + {4 * b.RING}) % {4 * b.RING} AS tx, sum(w * v) AS v, sum(w) AS w, CAST(bit_or(n) AS BIGINT) AS mask FROM obs, off GROUP BY ALL)
SELECT day, ty, tx, {rs('v', 'v', 9)}, mask FROM t WHERE w > 1 - 1e-9 AND ty BETWEEN 0 AND 42""")
def g4_working_grid(spark, sf_dir):
    return grid.refine(b.obs_grid(spark, sf_dir), ["day"], "v", "n", b.ROWS, b.RING, 3, 4).select("day", "ty", "tx", r("v", digits=9), F.col("n").alias("mask"))


@query(f"WITH {OBS} SELECT lat, lon, {rs('v', 'v')} FROM obs WHERE day = {DAY0 + 9} AND v IS NOT NULL")
def g5_epoch_rows(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir).where(F.col("day") == DAY0 + 9)
    return grid.densify(obs, obs.select("day").distinct(), *b.axes(), "v").where("valid").select("lat", "lon", r("v"))


@query(f"""WITH {OBS}, t AS (SELECT CAST(a AS INT) AS ty, CAST(e AS INT) AS tx, CAST((a - 8) * 125000 AS DOUBLE) AS y, CAST((e - 8) * 125000 AS DOUBLE) AS x FROM range(17) p(a), range(17) q(e)),
c AS (SELECT *, sqrt(x * x + y * y) AS r, sqrt(x * x + y * y) / 6371008.8 AS c FROM t),
l AS (SELECT ty, tx, y, x, CASE WHEN r = 0 THEN 0.0 ELSE degrees(asin(y * sin(c) / r)) END AS lat, CASE WHEN r = 0 THEN -165.0 ELSE degrees(radians(-165.0) + atan2(x * sin(c), r * cos(c))) END AS lon FROM c),
a AS (SELECT *, (lat + 17.5) / 2.5 AS ay, (lon + 180) / 3.6 AS ax FROM l),
w AS (SELECT ty, tx, y, x, CAST(floor(ay) AS INT) + dy AS iy, CAST(floor(ax) AS INT) + dx AS ix, (CASE WHEN dy = 1 THEN ay - floor(ay) ELSE 1 - ay + floor(ay) END) * (CASE WHEN dx = 1 THEN ax - floor(ax) ELSE 1 - ax + floor(ax) END) AS w FROM a, (VALUES (0), (1)) d(dy), (VALUES (0), (1)) e(dx)),
k AS (SELECT *, count(*) OVER (PARTITION BY ty, tx) AS needed FROM w WHERE w > 1e-12)
SELECT day, ty, tx, y AS y_m, x AS x_m, {rs('sum(w * v)', 'v')}, true AS spatially_interpolated FROM k JOIN obs USING (iy, ix) GROUP BY day, ty, tx, y, x, needed HAVING count(*) = needed""")
def g6_metric_regrid(spark, sf_dir):
    out = grid.regrid_metric(b.obs_grid(spark, sf_dir), ["day"], "v", 0.0, -165.0, 2.5, 3.6, -17.5, -180.0, 1_000_000, 125_000)
    return out.select("day", "ty", "tx", "y_m", "x_m", r("v"), "spatially_interpolated")


_KERNEL = ", ".join(f"({k}, {w!r})" for k, w in grid.kernel(1.0))


@query(f"""WITH {OBS}, o AS (SELECT day, iy, ix, v FROM obs), k(k, w) AS (SELECT k, CAST(w AS DOUBLE) FROM (VALUES {_KERNEL}) t(k, w)),
s AS (SELECT day, iy + a.k AS iy, ix + e.k AS ix, sum(a.w * e.w * v) AS s, sum(a.w * e.w) AS m FROM o, k a, k e GROUP BY ALL),
dy AS (SELECT CAST(y AS INT) AS iy, sum(w) AS d FROM range(15) r(y), k WHERE y - k BETWEEN 0 AND 14 GROUP BY y), dx AS (SELECT CAST(x AS INT) AS ix, sum(w) AS d FROM range({b.RING}) r(x), k WHERE x - k BETWEEN 0 AND {b.RING - 1} GROUP BY x)
SELECT day, iy, ix, round(CASE WHEN m / (dy.d * dx.d) >= 0.8 THEN s / m END, 6) + CAST(0 AS DOUBLE) AS v_smooth FROM o JOIN s USING (day, iy, ix) JOIN dy USING (iy) JOIN dx USING (ix)""")
def g7_masked_smoothing(spark, sf_dir):
    out = grid.smooth(b.obs_grid(spark, sf_dir), ["day"], ["v"], 1.0, b.ROWS, b.RING)
    return out.select("day", "iy", "ix", r("v_smooth"))


_SLOPES = """n AS (SELECT o.day, o.iy, o.ix, o.v, e.v AS e, w.v AS w, n.v AS n, s.v AS s, max(o.ix) OVER (PARTITION BY o.day, o.iy) AS xm, min(o.ix) OVER (PARTITION BY o.day, o.iy) AS x0, max(o.iy) OVER (PARTITION BY o.day) AS ym, min(o.iy) OVER (PARTITION BY o.day) AS y0,
  max(o.ix) OVER (PARTITION BY o.day) AS gx1, min(o.ix) OVER (PARTITION BY o.day) AS gx0 FROM obs o
  LEFT JOIN obs e ON e.day = o.day AND e.iy = o.iy AND e.ix = o.ix + 1 LEFT JOIN obs w ON w.day = o.day AND w.iy = o.iy AND w.ix = o.ix - 1
  LEFT JOIN obs n ON n.day = o.day AND n.ix = o.ix AND n.iy = o.iy + 1 LEFT JOIN obs s ON s.day = o.day AND s.ix = o.ix AND s.iy = o.iy - 1),
d AS (SELECT *, CASE WHEN ix = gx0 THEN (e - v) / 2 WHEN ix = gx1 THEN (v - w) / 2 ELSE (e - w) / 4 END AS dx, CASE WHEN iy = y0 THEN (n - v) / 3 WHEN iy = ym THEN (v - s) / 3 ELSE (n - s) / 6 END AS dy, (e - 2 * v + w) / 4 + (n - 2 * v + s) / 9 AS lap FROM n)"""


@query(f"""WITH {OBS}, {_SLOPES}
SELECT day, iy, ix, {rs('dx', 'd_dx')}, {rs('dy', 'd_dy')}, {rs('sqrt(dx * dx + dy * dy)', 'grad_mag')}, {rs('lap', 'laplacian')} FROM d""")
def g8_spatial_derivatives(spark, sf_dir):
    out = grid.spatial_derivatives(b.obs_grid(spark, sf_dir), ["day"], "v", 3.0, 2.0)
    return out.select("day", "iy", "ix", r("d_dx"), r("d_dy"), r("grad_mag"), r("laplacian"))


@query(f"""WITH {OBS}, {_SLOPES}, p AS (SELECT day, iy, ix, dx * dx AS xx, dy * dy AS yy, dx * dy AS xy FROM d), k(k, w) AS (SELECT k, CAST(w AS DOUBLE) FROM (VALUES {_KERNEL}) t(k, w)),
s AS (SELECT day, iy + a.k AS iy, ix + e.k AS ix, sum(a.w * e.w * coalesce(xx, 0)) AS xx, sum(a.w * e.w * coalesce(yy, 0)) AS yy, sum(a.w * e.w * coalesce(xy, 0)) AS xy,
  sum(a.w * e.w * (xx IS NOT NULL)::INT) AS mxx, sum(a.w * e.w * (yy IS NOT NULL)::INT) AS myy, sum(a.w * e.w * (xy IS NOT NULL)::INT) AS mxy FROM p, k a, k e GROUP BY ALL),
ey AS (SELECT CAST(y AS INT) AS iy, sum(w) AS n FROM range({b.ROWS}) r(y), k WHERE y - k BETWEEN 0 AND {b.ROWS - 1} GROUP BY y), ex AS (SELECT CAST(x AS INT) AS ix, sum(w) AS n FROM range({b.RING}) r(x), k WHERE x - k BETWEEN 0 AND {b.RING - 1} GROUP BY x),
t AS (SELECT day, iy, ix, CASE WHEN p.xx IS NOT NULL AND mxx / (ey.n * ex.n) >= 0.8 THEN s.xx / mxx END AS xx, CASE WHEN p.yy IS NOT NULL AND myy / (ey.n * ex.n) >= 0.8 THEN s.yy / myy END AS yy, CASE WHEN p.xy IS NOT NULL AND mxy / (ey.n * ex.n) >= 0.8 THEN s.xy / mxy END AS xy
  FROM p JOIN s USING (day, iy, ix) JOIN ey USING (iy) JOIN ex USING (ix)),
h AS (SELECT *, (xx + yy) / 2 AS mid, sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS half, 0.5 * atan2(2 * xy, xx - yy) AS o FROM t)
SELECT day, iy, ix, {rs('mid + half', 'major')}, {rs('CASE WHEN mid IS NOT NULL THEN greatest(mid - half, 0.0) ELSE 0.0 END', 'minor')}, {rs('CASE WHEN mid > 1e-20 THEN half / mid END', 'coherence')}, {rs('CASE WHEN o < 0 THEN o + pi() ELSE o END', 'orientation')} FROM h""")
def g9_structure_tensor(spark, sf_dir):
    d = grid.spatial_derivatives(b.obs_grid(spark, sf_dir), ["day"], "v", 3.0, 2.0)
    return grid.structure_tensor(d, ["day"], 1.0, b.ROWS, b.RING).select("day", "iy", "ix", r("major"), r("minor"), r("coherence"), r("orientation"))


_BLOBS = f"""{OBS}, c AS (SELECT day, iy, ix, iy * 100000 + ix AS id FROM obs WHERE v > 60),
reach AS (SELECT day, id, id AS seed, iy, ix FROM c UNION SELECT c.day, c.id, reach.seed, c.iy, c.ix FROM reach JOIN c ON c.day = reach.day AND abs(c.iy - reach.iy) + abs(c.ix - reach.ix) = 1)"""


@query(f"WITH RECURSIVE {_BLOBS} SELECT day, iy, ix, CAST(min(seed) AS BIGINT) AS blob FROM reach GROUP BY day, iy, ix")
def g10_frame_components(spark, sf_dir):
    return tracks.frame_components(b.obs_grid(spark, sf_dir).where("v > 60").select("day", "iy", "ix"), ["day"])


@query(f"""WITH RECURSIVE {_BLOBS.replace('v > 60', 'abs(v) >= 60')}, bl AS (SELECT day, iy, ix, min(seed) AS blob FROM reach GROUP BY day, iy, ix), sz AS (SELECT day, blob, count(*) AS cluster FROM bl GROUP BY ALL), pk AS (SELECT day, iy, ix, v FROM obs QUALIFY row_number() OVER (PARTITION BY day ORDER BY abs(v) DESC, iy, ix) = 1)
SELECT pk.day, pk.iy, pk.ix, {rs('pk.v', 'v')}, coalesce(sz.cluster, 0) AS cluster FROM pk LEFT JOIN bl ON bl.day = pk.day AND bl.iy = pk.iy AND bl.ix = pk.ix LEFT JOIN sz ON sz.day = bl.day AND sz.blob = bl.blob""")
def g10_peak_clusters(spark, sf_dir):
    return tracks.peak_clusters(b.obs_grid(spark, sf_dir), ["day"], "v", 60.0, tile=8).select("day", "iy", "ix", r("v"), "cluster")


@query(f"""WITH RECURSIVE {_BLOBS}, bl AS (SELECT day, iy, ix, min(seed) AS blob FROM reach GROUP BY day, iy, ix), nd AS (SELECT DISTINCT day, blob, day * 10000000 + blob AS node FROM bl),
ed AS (SELECT DISTINCT p.day * 10000000 + p.blob AS a, q.day * 10000000 + q.blob AS e FROM bl p JOIN bl q ON q.day = p.day + 1 AND abs(p.iy - q.iy) + abs(p.ix - q.ix) <= 1),
bo AS (SELECT a, e FROM ed UNION SELECT e, a FROM ed), tr AS (SELECT node, node AS seed FROM nd UNION SELECT bo.e, tr.seed FROM tr JOIN bo ON bo.a = tr.node),
lb AS (SELECT node, min(seed) AS track FROM tr GROUP BY node)
SELECT count(DISTINCT node) AS regions, min(day) AS first_day, max(day) AS last_day FROM lb JOIN nd USING (node) GROUP BY track""")
def g11_track_linking(spark, sf_dir):
    blobs = tracks.frame_components(b.obs_grid(spark, sf_dir).where("v > 60").select("day", "iy", "ix"), ["day"]).withColumn("polarity", F.lit(1))
    linked = tracks.link_tracks(blobs, "day", "polarity", 1.0)
    return linked.groupBy("track").agg(F.count_distinct("day", "blob").alias("regions"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("track")


def _survey_obs(spark, sf_dir) -> DataFrame:
    return b.obs_grid(spark, sf_dir).withColumn("slot", F.col("epoch") % 86400).withColumn("rms", F.lit(1.0))


_CANDIDATES = f"""{OBS}, d AS (SELECT o.day, o.epoch, o.iy, o.ix, o.lat, o.lon, any_value(o.v) AS v, median(p.v) AS c, list(p.v) AS l, count(p.v) AS k FROM obs o LEFT JOIN obs p ON p.iy = o.iy AND p.ix = o.ix AND p.day BETWEEN o.day - 7 AND o.day - 1 GROUP BY ALL),
z AS (SELECT *, v - c AS deviation, (v - c) / greatest(2.0, 1.4826 * list_median(list_transform(l, lambda x: abs(x - c)))) AS score FROM d WHERE k >= 3 AND epoch > {(DAY0 + 7) * 86400}),
c AS (SELECT *, CAST(sign(deviation) AS INT) AS polarity, iy * 100000 + ix AS id FROM z WHERE abs(deviation) >= 5 AND abs(score) >= 3),
reach AS (SELECT day, polarity, id, id AS seed, iy, ix FROM c UNION SELECT c.day, c.polarity, c.id, reach.seed, c.iy, c.ix FROM reach JOIN c ON c.day = reach.day AND c.polarity = reach.polarity AND abs(c.iy - reach.iy) + abs(c.ix - reach.ix) = 1),
b0 AS (SELECT day, polarity, iy, ix, min(seed) AS blob FROM reach GROUP BY ALL), bl AS (SELECT * FROM b0 QUALIFY count(*) OVER (PARTITION BY day, polarity, blob) >= 2), nd AS (SELECT DISTINCT day, polarity, blob, (day * 10000000 + blob) * polarity AS node FROM bl),
ed AS (SELECT DISTINCT (p.day * 10000000 + p.blob) * p.polarity AS a, (q.day * 10000000 + q.blob) * q.polarity AS e FROM bl p JOIN bl q ON q.day = p.day + 1 AND q.polarity = p.polarity AND abs(p.iy - q.iy) + abs(p.ix - q.ix) <= 1),
bo AS (SELECT a, e FROM ed UNION SELECT e, a FROM ed), tr AS (SELECT node, node AS seed FROM nd UNION SELECT bo.e, tr.seed FROM tr JOIN bo ON bo.a = tr.node), lb AS (SELECT node, min(seed) AS track FROM tr GROUP BY node),
fu AS (SELECT track, c.* FROM lb JOIN nd USING (node) JOIN bl USING (day, polarity, blob) JOIN c USING (day, polarity, iy, ix)),
pk AS (SELECT track, epoch AS peak_epoch, lat AS peak_lat, lon AS peak_lon, deviation AS peak_deviation, score AS peak_score FROM fu QUALIFY row_number() OVER (PARTITION BY track ORDER BY abs(score) DESC, epoch, lat, lon) = 1),
gr AS (SELECT track, polarity, min(epoch) AS start_, max(epoch) AS end_, count(DISTINCT epoch) AS epochs, count(DISTINCT id) AS cells, min(lat) AS south, max(lat) AS north, sum(abs(deviation) * lat) / sum(abs(deviation)) AS centre_lat, degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) AS centre_lon, list(DISTINCT id) AS footprint FROM fu GROUP BY track, polarity),
ca AS (SELECT *, -(abs(peak_score) * sqrt(least(cells, 25)) * sqrt(epochs)) AS rank_ FROM gr JOIN pk USING (track) WHERE epochs >= 2)"""


@query(f"""WITH RECURSIVE {_CANDIDATES} SELECT polarity, start_ AS "start", end_ AS "end", end_ - start_ AS duration, epochs, cells, peak_epoch, peak_lat, peak_lon, {rs('peak_deviation', 'peak_deviation')}, {rs('peak_score', 'peak_score')}, south, north, {rs('centre_lat', 'centre_lat')}, {rs('centre_lon', 'centre_lon')},
  CASE WHEN epochs >= 3 AND cells >= 3 THEN 'moderate' ELSE 'limited' END AS strength, {rs('rank_', 'rank')} FROM ca""")
def g12_anomaly_survey(spark, sf_dir):
    dev = survey.deviations(_survey_obs(spark, sf_dir))
    found = survey.candidates(survey.flagged(dev, (DAY0 + 7) * 86400.0), 86400.0)
    rounded = ("peak_deviation", "peak_score", "centre_lat", "centre_lon", "rank")
    return found.select(*[r(c) if c in rounded else c for c in found.columns if c not in ("track", "footprint")])


@query(f"""WITH {OBS}, d AS (SELECT o.day, o.iy, o.ix, any_value(o.v) AS v, median(p.v) AS c, list(p.v) AS l, count(p.v) AS k FROM obs o LEFT JOIN obs p ON p.iy = o.iy AND p.ix = o.ix AND p.day BETWEEN o.day - 7 AND o.day - 1 GROUP BY ALL)
SELECT day, iy, ix, k AS n_prior, round(CASE WHEN k >= 3 THEN v - c END, 9) + CAST(0 AS DOUBLE) AS deviation, round(greatest(2.0, 1.0, 1.4826 * list_median(list_transform(l, lambda x: abs(x - c)))), 9) + CAST(0 AS DOUBLE) AS scale FROM d""")
def g12_deviation_map(spark, sf_dir):
    dev = survey.deviations(_survey_obs(spark, sf_dir))
    return dev.select("day", "iy", "ix", F.col("n_prior").cast("bigint").alias("n_prior"), r("deviation", digits=9), r("scale", digits=9))


@query(f"""WITH {OBS}, d AS (SELECT o.day, o.epoch, o.iy, o.ix, any_value(o.v) AS v, count(p.v) AS k FROM obs o LEFT JOIN obs p ON p.iy = o.iy AND p.ix = o.ix AND p.day BETWEEN o.day - 7 AND o.day - 1 GROUP BY ALL),
f AS (SELECT epoch, count(v) AS seen, count(*) FILTER (k >= 3) AS ok FROM d WHERE epoch > {(DAY0 + 7) * 86400} GROUP BY epoch)
SELECT CAST(coalesce(sum(seen), 0) AS BIGINT) AS scanned, CAST(coalesce(sum(ok), 0) AS BIGINT) AS supported, count(*) FILTER (ok >= 2) AS supported_epochs,
       CASE WHEN coalesce(sum(seen), 0) = 0 THEN 'no_usable_data' WHEN count(*) FILTER (ok >= 2) < 2 THEN 'insufficient_baseline' ELSE 'complete' END AS status FROM f""")
def g12_survey_status(spark, sf_dir):
    return survey.survey_status(survey.deviations(_survey_obs(spark, sf_dir)), (DAY0 + 7) * 86400.0)


_NEXT = "SELECT x.* FROM {0} x, {1} y WHERE x.i > y.i AND len(list_intersect(x.footprint, y.footprint)) <= 0.25 * least(len(x.footprint), len(y.footprint))"


@query(f"""WITH RECURSIVE {_CANDIDATES}, l1 AS (SELECT *, row_number() OVER (ORDER BY rank_, start_, peak_lat, peak_lon) AS i FROM ca), t1 AS (SELECT * FROM l1 ORDER BY i LIMIT 1), l2 AS ({_NEXT.format('l1', 't1')}), t2 AS (SELECT * FROM l2 ORDER BY i LIMIT 1), l3 AS ({_NEXT.format('l2', 't2')}), t3 AS (SELECT * FROM l3 ORDER BY i LIMIT 1)
SELECT polarity, start_ AS "start", end_ AS "end", cells, epochs, {rs('rank_', 'rank')} FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3)""")
def k4_ranked_suppression(spark, sf_dir):
    dev = survey.deviations(_survey_obs(spark, sf_dir))
    found = survey.candidates(survey.flagged(dev, (DAY0 + 7) * 86400.0), 86400.0).withColumn("scan", F.lit("scan"))
    return tracks.suppress_overlaps(found.withColumn("_order", F.struct("rank", "start", "peak_lat", "peak_lon")), "scan", "_order", "footprint").select("polarity", "start", "end", "cells", "epochs", r("rank"))


@query(f"""WITH RECURSIVE {OBS}, f AS (SELECT day, iy, ix, abs(v - 50) AS s, max(abs(v - 50)) OVER (PARTITION BY day) AS peak FROM obs), c AS (SELECT day, iy, ix, s, iy * 100000 + ix AS id FROM f WHERE s >= greatest(60.0, 0.25 * peak)),
reach AS (SELECT day, id, id AS seed, iy, ix FROM c UNION SELECT c.day, c.id, reach.seed, c.iy, c.ix FROM reach JOIN c ON c.day = reach.day AND abs(c.iy - reach.iy) + abs(c.ix - reach.ix) = 1),
bl AS (SELECT day, iy, ix, min(seed) AS blob FROM reach GROUP BY ALL), st AS (SELECT day, blob, sum(s) AS t FROM bl JOIN c USING (day, iy, ix) GROUP BY ALL), be AS (SELECT day, arg_max(blob, (t, -blob)) AS blob FROM st GROUP BY day),
gr AS (SELECT DISTINCT bl.day, iy + a AS iy, ix + e AS ix FROM bl JOIN be USING (day, blob), (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(a, e))
SELECT obs.day, count(*) FILTER (gr.iy IS NOT NULL OR be.blob IS NULL) AS focus_cells, count(*) AS cells FROM obs LEFT JOIN gr ON gr.day = obs.day AND gr.iy = obs.iy AND gr.ix = obs.ix LEFT JOIN be ON be.day = obs.day GROUP BY obs.day""")
def g13_focus_region(spark, sf_dir):
    frame = b.obs_grid(spark, sf_dir).withColumn("a", F.col("v") - 50)
    return tracks.focus_region(frame, ["day"], "a", 60.0).groupBy("day").agg(F.count_if(F.col("focus")).alias("focus_cells"), F.count("*").alias("cells"))


def _pairs(spark, sf_dir) -> DataFrame:
    return motion.frame_pairs(b.obs_grid(spark, sf_dir).select("day", "iy", "ix", "v"), [], "day", "v", 1.0)


def _kernel_sql(tag: str, sigma: float) -> str:
    rows = ", ".join(f"({k}, {w!r})" for k, w in grid.kernel(sigma))
    inside = lambda name, size: f"SELECT CAST(y AS INT) AS {name}, sum(w) AS n FROM range({size}) r(y), k{tag} WHERE y - k BETWEEN 0 AND {size - 1} GROUP BY y"
    return f"k{tag}(k, w) AS (SELECT k, CAST(w AS DOUBLE) FROM (VALUES {rows}) t(k, w)), ey{tag} AS ({inside('iy', b.ROWS)}), ex{tag} AS ({inside('ix', b.RING)})"


def _smooth_sql(source: str, values: list[str], out: str, tag: str, support: float) -> str:
    sums = ", ".join(f"sum(a.w * e.w * coalesce({v}, 0)) AS s_{v}, sum(a.w * e.w * ({v} IS NOT NULL)::INT) AS m_{v}" for v in values)
    got = ", ".join(f"CASE WHEN p.{v} IS NOT NULL AND m_{v} / (y.n * x.n) >= {support} THEN s_{v} / m_{v} END AS {v}" for v in values)
    return f"""{out} AS (SELECT p.day, p.iy, p.ix, {got} FROM {source} p JOIN (SELECT day, iy + a.k AS iy, ix + e.k AS ix, {sums} FROM {source}, k{tag} a, k{tag} e GROUP BY ALL) s ON s.day = p.day AND s.iy = p.iy AND s.ix = p.ix
  JOIN ey{tag} y ON y.iy = p.iy JOIN ex{tag} x ON x.ix = p.ix)"""


def _slopes_sql(source: str, value: str, out: str, dx: str, dy: str) -> str:
    near = lambda t, y, x: f"LEFT JOIN {source} {t} ON {t}.day = o.day AND {t}.iy = o.iy + {y} AND {t}.ix = o.ix + {x}"
    return f"""{out} AS (SELECT o.*, CASE WHEN o.ix = g.x0 THEN (e.{value} - o.{value}) / 2 WHEN o.ix = g.x1 THEN (o.{value} - w.{value}) / 2 ELSE (e.{value} - w.{value}) / 4 END AS {dx},
  CASE WHEN o.iy = g.y0 THEN (n.{value} - o.{value}) / 3 WHEN o.iy = g.y1 THEN (o.{value} - s.{value}) / 3 ELSE (n.{value} - s.{value}) / 6 END AS {dy}
  FROM {source} o JOIN (SELECT day, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM {source} GROUP BY day) g ON g.day = o.day {near('e', 0, 1)} {near('w', 0, -1)} {near('n', 1, 0)} {near('s', -1, 0)})"""


_PAIRS = """pa AS (SELECT day, iy, ix, v AS c, lag(v) OVER w AS p, day - lag(day) OVER w AS dt FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day)), pr AS (SELECT *, (p + c) / 2 AS mid, (c - p) / dt AS gt FROM pa WHERE dt <= 1.5)"""
_FLOW = f"""{_PAIRS}, {_kernel_sql('f', 1.5)}, {_slopes_sql('pr', 'mid', 'fg', 'gx', 'gy')}, fp AS (SELECT day, iy, ix, gx * gx AS xx, gx * gy AS xy, gy * gy AS yy, gx * gt AS xt, gy * gt AS yt, gt * gt AS tt FROM fg),
{_smooth_sql('fp', ['xx', 'xy', 'yy', 'xt', 'yt', 'tt'], 'fs', 'f', 0.5)},
fd AS (SELECT *, -(yy * xt - xy * yt) / (xx * yy - xy * xy) AS u, -(xx * yt - xy * xt) / (xx * yy - xy * xy) AS v, sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS half FROM fs WHERE xx * yy - xy * xy > 1e-9 * (xx + yy) * (xx + yy)),
fl AS (SELECT day, iy, ix, u, v, sqrt(greatest(((xx + yy) / 2 - half) / greatest((xx + yy) / 2 + half, 1e-30), 0.0)) * least(greatest(0.0, 1 - (tt + u * xt + v * yt) / greatest(tt, 1e-30)), 1.0) AS confidence FROM fd)"""


@query(f"WITH {OBS}, {_FLOW} SELECT day, iy, ix, {rs('u', 'u')}, {rs('v', 'v')}, {rs('confidence', 'confidence')}, confidence >= 0.4 AS accepted FROM fl")
def g14_feature_flow(spark, sf_dir):
    return motion.feature_flow(_pairs(spark, sf_dir), ["day"], 3.0, 2.0, 1.5, b.ROWS, b.RING).select("day", "iy", "ix", r("u"), r("v"), r("confidence"), "accepted")


_GATE = """gate AS (SELECT day FROM pa WHERE dt <= 1.5 GROUP BY day HAVING count(*) >= 0.8 * (SELECT count(*) FROM (SELECT DISTINCT iy, ix FROM obs)) AND least(quantile_cont(p, 0.95) - quantile_cont(p, 0.05), quantile_cont(c, 0.95) - quantile_cont(c, 0.05)) >= 1e-10)"""


@query(f"WITH {OBS}, {_FLOW.replace('), pr AS (SELECT *', f'), {_GATE}, pr AS (SELECT *', 1).replace('FROM pa WHERE dt <= 1.5)', 'FROM pa WHERE dt <= 1.5 AND day IN (SELECT day FROM gate))', 1)} SELECT day, iy, ix, {rs('u', 'u')}, {rs('v', 'v')}, {rs('confidence', 'confidence')}, confidence >= 0.4 AS accepted FROM fl")
def g14_gated_flow(spark, sf_dir):
    cells = b.obs_grid(spark, sf_dir).select("iy", "ix").distinct().count()
    pairs = motion.supported_pairs(_pairs(spark, sf_dir), ["day"], cells)
    return motion.feature_flow(pairs, ["day"], 3.0, 2.0, 1.5, b.ROWS, b.RING).select("day", "iy", "ix", r("u"), r("v"), r("confidence"), "accepted")


@query(f"""WITH {OBS}, p AS (SELECT day, v AS c, lag(v) OVER w AS p, day - lag(day) OVER w AS dt FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day)), q AS (SELECT * FROM p WHERE dt <= 1.5)
SELECT day, {rs('covar_pop(p, c) / var_pop(p)', 'gain')}, {rs('corr(p, c)', 'correlation')}, {rs('greatest(0.0, 1 - (var_pop(c) - covar_pop(p, c) ** 2 / var_pop(p)) / var_pop(c - p))', 'ambiguity')}, count(*) AS cells FROM q GROUP BY day""")
def g15_growth_ambiguity(spark, sf_dir):
    return motion.growth_ambiguity(_pairs(spark, sf_dir), ["day"]).select("day", r("gain"), r("correlation"), r("ambiguity"), "cells")


_GROWTH = f"""{_kernel_sql('g', 2.0)}, mo AS (SELECT day, iy, ix, p, c, p * p AS pp, c * c AS cc, p * c AS pc, (c - p) ** 2 AS dd FROM pr), {_smooth_sql('mo', ['p', 'c', 'pp', 'cc', 'pc', 'dd'], 'ms', 'g', 0.5)},
mv AS (SELECT *, pp - p * p AS vp, greatest(cc - c * c, 0.0) AS vc, pc - p * c AS cv FROM ms), ml AS (SELECT *, CASE WHEN vp > 1e-9 * pp AND dd > 1e-9 * pp THEN least(1.0, greatest(0.0, 1 - greatest(vc - cv * cv / vp, 0.0) / dd)) ELSE 0.0 END AS explained FROM mv)"""


@query(f"""WITH {OBS}, {_PAIRS}, {_GROWTH} SELECT day, iy, ix, {rs('CASE WHEN vp > 1e-9 * pp THEN cv / vp END', 'gain')}, {rs('explained', 'explained')}, {rs('greatest(0.0, (explained - 0.95) / (1 - 0.95))', 'ambiguity')} FROM ml""")
def g15_local_ambiguity(spark, sf_dir):
    return motion.local_ambiguity(_pairs(spark, sf_dir), ["day"], 2.0, b.ROWS, b.RING, 0.5, 0.95).select("day", "iy", "ix", r("gain"), r("explained"), r("ambiguity"))


@query(f"""WITH {OBS}, {_FLOW}, {_slopes_sql('fl', 'u', 'fu', 'ux', 'uy')}, {_slopes_sql('fu', 'v', 'fv', 'vx', 'vy')}, {_slopes_sql('pr', 'c', 'pg', 'dx', 'dy')},
j AS (SELECT fv.day, fv.iy, fv.ix, ux + vy AS divergence, vx - uy AS vorticity, sqrt((ux - vy) ** 2 + (vx + uy) ** 2) AS strain, gt + u * dx + v * dy AS raw, confidence >= 0.4 AS accepted FROM fv JOIN pg ON pg.day = fv.day AND pg.iy = fv.iy AND pg.ix = fv.ix)
SELECT day, iy, ix, {rs('divergence', 'divergence')}, {rs('vorticity', 'vorticity')}, {rs('strain', 'strain')}, {rs('raw', 'residual_raw')}, {rs('CASE WHEN accepted THEN raw END', 'residual')} FROM j""")
def g16_flow_kinematics(spark, sf_dir):
    flow = motion.feature_flow(_pairs(spark, sf_dir), ["day"], 3.0, 2.0, 1.5, b.ROWS, b.RING)
    k = motion.flow_kinematics(flow.select("day", "iy", "ix", "u", "v"), ["day"], 3.0, 2.0)
    g = grid.spatial_derivatives(_pairs(spark, sf_dir), ["day"], "current", 3.0, 2.0).withColumn("rate", (F.col("current") - F.col("previous")) / F.col("dt"))
    joined = k.join(g.select("day", "iy", "ix", "rate", "d_dx", "d_dy"), ["day", "iy", "ix"]).join(flow.select("day", "iy", "ix", "accepted"), ["day", "iy", "ix"])
    out = motion.advection_residual(joined, "rate", "d_dx", "d_dy", accepted="accepted")
    return out.select("day", "iy", "ix", r("divergence"), r("vorticity"), r("strain"), r("residual_raw"), r("residual"))


@query(f"""WITH {OBS}, f AS (SELECT iy % 3 AS region, day, count(v) AS valid, count(*) AS cells FROM obs GROUP BY ALL), s AS (SELECT *, day - lag(day) OVER (PARTITION BY region ORDER BY day) AS step FROM f),
a AS (SELECT region, count(*) AS epochs, CAST(median(step) AS DOUBLE) AS cadence, max(step) AS gap, max(day) - min(day) AS span, sum(valid) / (count(*) * 50.0::DOUBLE) AS share FROM s GROUP BY region)
SELECT region, epochs, cadence, {rs('share', 'valid_share')}, 2 * cadence AS min_period, span / 2.0::DOUBLE AS max_period, CASE WHEN epochs < 8 THEN 'insufficient_samples' WHEN share < 0.5 THEN 'invalid_support' WHEN gap > 1.5 * cadence THEN 'unsupported_resolution' ELSE 'supported' END AS status FROM a""")
def g17_capability_gate(spark, sf_dir):
    out = spectral.capabilities(b.obs_grid(spark, sf_dir).withColumn("region", F.col("iy") % 3), ["region"], "day", "v", cells=50)
    return out.select("region", "epochs", "cadence", r("valid_share"), "min_period", "max_period", "status")


_WAVES = [(kx / 40.0, ky / 40.0) for kx in (-2, -1, 0, 1, 2) for ky in (-2, -1, 0, 1, 2) if (kx, ky) != (0, 0)]
_WAVE_ROWS = ", ".join(f"({kx!r}, {ky!r})" for kx, ky in _WAVES)


@query(f"""WITH {OBS}, t AS (SELECT iy, ix, regr_slope(v, day) AS s, avg(v) AS m, avg(day) AS d FROM obs GROUP BY iy, ix), o AS (SELECT day, iy, ix, v - m - coalesce(s, 0) * (day - d) AS x FROM obs JOIN t USING (iy, ix)),
bi AS (SELECT 1.0 / p AS f, CAST(kx AS DOUBLE) AS kx, CAST(ky AS DOUBLE) AS ky FROM (VALUES (4.0::DOUBLE), (6.0), (8.0), (12.0)) a(p), (VALUES {_WAVE_ROWS}) e(kx, ky)),
w AS (SELECT f, kx, ky, x, 2 * pi() * (f * day - kx * ix * 3 - ky * iy * 2) AS ph FROM o, bi)
SELECT {rs('1 / f', 'period')}, {rs('kx', 'kx')}, {rs('ky', 'ky')}, {rs('(sum(x * cos(ph)) ** 2 + sum(x * sin(ph)) ** 2) / (count(*) * count(*)::DOUBLE)', 'power')} FROM w GROUP BY f, kx, ky""")
def g18_wave_power(spark, sf_dir):
    residual = spectral.detrended(b.obs_grid(spark, sf_dir).withColumn("region", F.lit(0)), ["region"], "day", "v")
    power = spectral.wave_power(residual, ["region"], "day", "residual", [4.0, 6.0, 8.0, 12.0], _WAVES, 2.0, 3.0)
    return power.select(r(1 / F.col("f"), "period"), r("kx"), r("ky"), r("power"))


_PEAK = f"""t AS (SELECT iy, ix, regr_slope(v, day) AS s, avg(v) AS m, avg(day) AS d FROM obs GROUP BY iy, ix), o AS (SELECT iy % 3 AS region, day, iy, ix, v - m - coalesce(s, 0) * (day - d) AS x FROM obs JOIN t USING (iy, ix)),
h AS (SELECT *, min(day) OVER w AS d0, max(day) OVER w AS d1 FROM o WINDOW w AS (PARTITION BY region)), bi AS (SELECT 1.0 / p AS f, CAST(kx AS DOUBLE) AS kx, CAST(ky AS DOUBLE) AS ky FROM (VALUES (4.0::DOUBLE), (6.0), (8.0), (12.0)) a(p), (VALUES {_WAVE_ROWS}) e(kx, ky)),
w AS (SELECT region, f, kx, ky, x, CASE WHEN d1 > d0 THEN 0.5 * (1 - cos(2 * pi() * (day - d0) / (d1 - d0))) ELSE 1.0 END AS g, 2 * pi() * (f * day - kx * ix * 3 - ky * iy * 2) AS ph FROM h, bi),
s AS (SELECT region, f, kx, ky, sum(g * x * cos(ph)) AS c, sum(g * x * sin(ph)) AS s, sum(g * cos(ph) ** 2) AS cc, sum(g * sin(ph) ** 2) AS ss, sum(g * sin(ph) * cos(ph)) AS cs, sum(g) AS n FROM w GROUP BY ALL),
q AS (SELECT *, (c * c + s * s) / (n * n) AS power, dense_rank() OVER (PARTITION BY region ORDER BY f) AS rf, dense_rank() OVER (PARTITION BY region ORDER BY kx) AS rx, dense_rank() OVER (PARTITION BY region ORDER BY ky) AS ry FROM s),
pk AS (SELECT *, sum(power) OVER (PARTITION BY region) AS total FROM q QUALIFY row_number() OVER (PARTITION BY region ORDER BY power DESC, f DESC, kx DESC, ky DESC) = 1),
co AS (SELECT q.region, max(q.power) AS other FROM q JOIN pk ON pk.region = q.region WHERE greatest(abs(q.rf - pk.rf), abs(q.rx - pk.rx), abs(q.ry - pk.ry)) > 1 GROUP BY q.region),
z AS (SELECT pk.*, other, sqrt(kx * kx + ky * ky) AS k, (ss * c - cs * s) / (cc * ss - cs * cs) AS fa, (cc * s - cs * c) / (cc * ss - cs * cs) AS fb FROM pk LEFT JOIN co USING (region))"""


@query(f"""WITH {OBS}, {_PEAK} SELECT region, {rs('1 / f', 'period')}, {rs('1 / k', 'wavelength')}, {rs('f / k', 'phase_speed')}, {rs('degrees(atan2(kx, ky)) + CASE WHEN atan2(kx, ky) < 0 THEN 360 ELSE 0 END', 'bearing')}, {rs('sqrt(fa * fa + fb * fb)', 'amplitude')}, {rs('atan2(fb, fa)', 'phase')}, {rs('power / total', 'concentration')}, {rs('1 - coalesce(other, 0) / power', 'uniqueness')} FROM z""")
def g18_wave_peak(spark, sf_dir):
    residual = spectral.hann(spectral.detrended(b.obs_grid(spark, sf_dir).withColumn("region", F.col("iy") % 3), ["region"], "day", "v"), ["region"], "day")
    peak = spectral.wave_peak(spectral.wave_power(residual, ["region"], "day", "residual", [4.0, 6.0, 8.0, 12.0], _WAVES, 2.0, 3.0, "hann"), ["region"])
    return peak.select("region", *[r(c) for c in ("period", "wavelength", "phase_speed", "bearing", "amplitude", "phase", "concentration", "uniqueness")])


def _axis_sql(c: str) -> str:
    """The peak's place on an axis, moved to the top of a parabola through the logarithms of three powers."""
    low, high, at = f"ln(l{c}.power)", f"ln(h{c}.power)", f"(h{c}.{c} - l{c}.{c}) / 2"
    bend = f"({low} - 2 * ln(pk.power) + {high})"
    return f"pk.{c} + coalesce(CASE WHEN {bend} < 0 THEN 0.5 * ({low} - {high}) / {bend} END * {at}, 0) AS {c}"


def _beside_sql(c: str, name: str, step: int) -> str:
    same = " AND ".join(f"{name}{c}.r{o[-1]} = pk.r{o[-1]}" + (f" + ({step})" if o == c else "") for o in ("f", "kx", "ky"))
    return f"LEFT JOIN q {name}{c} ON {name}{c}.region = pk.region AND {same} AND {name}{c}.power > 0"


#: Bins from the band of :func:`spectral.capabilities`, the refined peak, and the carrier's complex amplitude a day.
_CARRIER = f"""fr AS (SELECT iy % 3 AS region, day, count(v) AS valid FROM obs GROUP BY ALL), st AS (SELECT *, day - lag(day) OVER (PARTITION BY region ORDER BY day) AS step FROM fr),
ca AS (SELECT region, count(*) AS epochs, median(step) AS cadence, max(step) AS gap, max(day) - min(day) AS span, sum(valid) / (count(*) * max(valid)) AS share FROM st GROUP BY region),
ok AS (SELECT region, epochs * cadence AS len, unnest(range(CAST(ceil(epochs * cadence / (span / 2)) AS BIGINT), CAST(floor(epochs * cadence / (2 * cadence)) AS BIGINT) + 1)) AS j FROM ca WHERE epochs >= 8 AND share >= 0.5 AND gap <= 1.5 * cadence),
bi AS (SELECT region, j / len AS f, CAST(kx AS DOUBLE) AS kx, CAST(ky AS DOUBLE) AS ky FROM ok, (VALUES {_WAVE_ROWS}) e(kx, ky)),
t AS (SELECT iy, ix, regr_slope(v, day) AS s, avg(v) AS m, avg(day) AS d FROM obs GROUP BY iy, ix), o AS (SELECT iy % 3 AS region, day, iy, ix, v - m - coalesce(s, 0) * (day - d) AS x FROM obs JOIN t USING (iy, ix)),
h AS (SELECT *, min(day) OVER w AS d0, max(day) OVER w AS d1 FROM o WINDOW w AS (PARTITION BY region)),
w AS (SELECT h.region, f, kx, ky, x, CASE WHEN d1 > d0 THEN 0.5 * (1 - cos(2 * pi() * (day - d0) / (d1 - d0))) ELSE 1.0 END AS g, 2 * pi() * (f * day - kx * ix * 3 - ky * iy * 2) AS ph FROM h JOIN bi ON bi.region = h.region),
s AS (SELECT region, f, kx, ky, (sum(g * x * cos(ph)) ** 2 + sum(g * x * sin(ph)) ** 2) / (sum(g) * sum(g)) AS power FROM w GROUP BY ALL),
q AS (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY f) AS rf, dense_rank() OVER (PARTITION BY region ORDER BY kx) AS rx, dense_rank() OVER (PARTITION BY region ORDER BY ky) AS ry FROM s),
pk AS (SELECT *, sum(power) OVER (PARTITION BY region) AS total FROM q QUALIFY row_number() OVER (PARTITION BY region ORDER BY power DESC, f DESC, kx DESC, ky DESC) = 1),
co AS (SELECT q.region, max(q.power) AS other FROM q JOIN pk ON pk.region = q.region WHERE greatest(abs(q.rf - pk.rf), abs(q.rx - pk.rx), abs(q.ry - pk.ry)) > 1 GROUP BY q.region),
re AS (SELECT pk.region, {', '.join(_axis_sql(c) for c in ('f', 'kx', 'ky'))}, pk.power / pk.total AS concentration, 1 - coalesce(co.other, 0) / pk.power AS uniqueness FROM pk LEFT JOIN co ON co.region = pk.region
  {' '.join(_beside_sql(c, n, k) for c in ('f', 'kx', 'ky') for n, k in (('l', -1), ('h', 1)))}),
ex AS (SELECT region, min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM o GROUP BY region),
dm AS (SELECT o.region, o.day, re.f, o.x, CASE WHEN y1 > y0 THEN 0.5 * (1 - cos(2 * pi() * (iy - y0) / (y1 - y0))) ELSE 1.0 END * CASE WHEN x1 > x0 THEN 0.5 * (1 - cos(2 * pi() * (ix - x0) / (x1 - x0))) ELSE 1.0 END AS g, 2 * pi() * (re.f * o.day - re.kx * ix * 3 - re.ky * iy * 2) AS ph FROM o JOIN ex ON ex.region = o.region JOIN re ON re.region = o.region),
tr AS (SELECT *, sqrt(re_ * re_ + im_ * im_) AS a FROM (SELECT region, day, f, 2 * sum(g * x * cos(ph)) / sum(g) AS re_, -2 * sum(g * x * sin(ph)) / sum(g) AS im_ FROM dm GROUP BY region, day, f HAVING sum(g) > 0)),
lv AS (SELECT region, greatest(quantile_cont(a, 0.95) * 0.25, 1e-12) AS level FROM tr GROUP BY region),
ac AS (SELECT *, lead(day) OVER w - day AS nx, lead(act) OVER w AS th FROM (SELECT tr.*, CASE WHEN a >= level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS act FROM tr JOIN lv ON lv.region = tr.region) WINDOW w AS (PARTITION BY region ORDER BY day)),
ev AS (SELECT region, f, CAST(sum(act) AS BIGINT) AS active, sum(nx * (act + th) / 2) AS tm, max(day) - min(day) AS span, sqrt(sum(re_) FILTER (act > 0) ** 2 + sum(im_) FILTER (act > 0) ** 2) / sum(a) FILTER (act > 0) AS coherence FROM ac GROUP BY region, f),
z AS (SELECT re.*, active, tm / span AS occupancy, tm * abs(ev.f) AS cycles, coherence FROM re JOIN ev ON ev.region = re.region)"""


@query(f"""WITH {OBS}, {_CARRIER} SELECT region, {rs('1 / f', 'period')}, {rs('kx', 'kx')}, {rs('ky', 'ky')}, active, {rs('occupancy', 'occupancy')}, {rs('cycles', 'cycles')}, {rs('coherence', 'coherence')}, {rs('concentration * occupancy * coherence * uniqueness', 'confidence')},
CASE WHEN occupancy < 0.65 OR cycles < 3 THEN 'insufficient_persistence' WHEN coherence < 0.5 THEN 'no_carrier' WHEN concentration < 0.2 THEN 'low_confidence' ELSE 'estimated' END AS status FROM z""")
def g18_carrier(spark, sf_dir):
    region = ["region"]
    obs = b.obs_grid(spark, sf_dir).withColumn("region", F.col("iy") % 3)
    bins = spectral.admissible_bins(spectral.capabilities(obs, region, "day", "v"), region, _WAVES)
    residual = spectral.hann(spectral.detrended(obs, region, "day", "v"), region, "day")
    power = stored(spectral.wave_power(residual, region, "day", "residual", [], [], 2.0, 3.0, "hann", bins), "wave-power")
    carrier = spectral.refined_peak(power, region)
    evidence = spectral.carrier_evidence(residual, region, "day", "residual", carrier, 2.0, 3.0)
    judged = spectral.judged_waves(spectral.wave_peak(power, region).drop("period").join(carrier, region), evidence, region)
    return judged.select("region", r(1 / F.col("f"), "period"), r("kx"), r("ky"), "active", *[r(c) for c in ("occupancy", "cycles", "coherence", "confidence")], "status")


@query(f"""WITH {OBS}, t AS (SELECT unnest([{DAY0 + 10}, {DAY0 + 15}, {DAY0 + 20}, {DAY0 + 29}]) AS target), e AS (SELECT target, iy, ix, day, v FROM obs, t WHERE day <= target), m AS (SELECT *, median(v) OVER (PARTITION BY target, iy, ix) AS c FROM e),
k AS (SELECT target, iy, ix, any_value(c) AS c, greatest(1.0, 1.4826 * median(abs(v - c))) AS s FROM m GROUP BY ALL)
SELECT CAST(k.target AS BIGINT) AS target, k.iy, k.ix, {rs('(v - c) / s', 'z')} FROM k JOIN obs ON obs.day = k.target AND obs.iy = k.iy AND obs.ix = k.ix""")
def g19_epoch_series(spark, sf_dir):
    obs = b.obs_grid(spark, sf_dir)
    targets = F.broadcast(spark.createDataFrame([(DAY0 + d,) for d in (10, 15, 20, 29)], "target bigint"))
    prefix = obs.join(targets, F.col("day") <= F.col("target"))
    scale = agg.robust_scale(prefix, ["target", "iy", "ix"], "v", 1.0)
    now = obs.select(F.col("day").alias("target"), "iy", "ix", "v")
    return scale.join(now, ["target", "iy", "ix"]).select("target", "iy", "ix", r((F.col("v") - F.col("centre")) / F.col("scale"), "z"))


@query(f"""WITH {OBS}, b0 AS (SELECT *, CASE WHEN count(v) OVER w = 5 THEN quantile_cont(v, 0.5) OVER w END AS base FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b1 AS (SELECT *, v - base AS a, lag(v) OVER w AS v0, lag(day) OVER w AS t0, lead(v) OVER w AS v1, lead(day) OVER w AS t1 FROM b0 WHERE base IS NOT NULL WINDOW w AS (PARTITION BY iy, ix ORDER BY day)),
f AS (SELECT day, iy, ix, a, CASE WHEN t0 IS NULL THEN (v1 - v) / (t1 - day) WHEN t1 IS NULL THEN (v - v0) / (day - t0) ELSE ((v - v0) / (day - t0) * (t1 - day) + (v1 - v) / (t1 - day) * (day - t0)) / (t1 - t0) END AS rate FROM b1),
{_kernel_sql('b', 1.0)}, {_smooth_sql('f', ['a'], 'sm', 'b', 0.8)}, sn AS (SELECT * FROM sm WHERE a IS NOT NULL), {_slopes_sql('sn', 'a', 'sl', 'dx', 'dy')}, sp AS (SELECT day, iy, ix, dx * dx AS xx, dy * dy AS yy, dx * dy AS xy FROM sl), {_smooth_sql('sp', ['xx', 'yy', 'xy'], 'st', 'b', 0.8)},
{_FLOW}, m AS (SELECT day, tanh(avg(abs(a)) / 40) AS anomaly, tanh(avg(abs(rate)) / 40) AS temporal FROM f GROUP BY day), mg AS (SELECT day, tanh(avg(sqrt(dx * dx + dy * dy)) / 10) AS gradient FROM sl GROUP BY day),
mc AS (SELECT day, avg(CASE WHEN (xx + yy) / 2 > 1e-20 THEN sqrt(((xx - yy) / 2) ** 2 + xy * xy) / ((xx + yy) / 2) END) AS coherence FROM st GROUP BY day), mf AS (SELECT day, avg(confidence) AS flow FROM fl GROUP BY day),
e AS (SELECT day, anomaly, temporal, coalesce(gradient, 0) AS gradient, coalesce(coherence, 0) AS coherence, coalesce(flow, 0) AS flow FROM m LEFT JOIN mg USING (day) LEFT JOIN mc USING (day) LEFT JOIN mf USING (day)),
q AS (SELECT day, unnest([{{'score': (1 - anomaly) * (1 - temporal) * (1 - gradient), 'name': 'quiet'}}, {{'score': gradient * coherence, 'name': 'front'}}, {{'score': flow, 'name': 'flow'}}, {{'score': temporal * (1 - coherence), 'name': 'disturbed'}}]) AS x FROM e),
o AS (SELECT day, x.name AS name, x.score AS score, row_number() OVER (PARTITION BY day ORDER BY x.score DESC, x.name DESC) AS i FROM q),
w AS (SELECT day, max(CASE WHEN i = 1 THEN name END) AS label, max(CASE WHEN i = 1 THEN score END) AS s1, max(CASE WHEN i = 2 THEN score END) AS s2 FROM o GROUP BY day)
SELECT day, {rs('anomaly', 'anomaly')}, {rs('gradient', 'gradient')}, {rs('coherence', 'coherence')}, {rs('flow', 'flow')}, {rs('temporal', 'temporal')}, label, {rs('(s1 - s2) / greatest(s1, 1e-12)', 'margin')} FROM e JOIN w USING (day)""")
def g20_field_pipeline(spark, sf_dir):
    from skylattice.plans.fields import analyse

    return analyse(b.obs_grid(spark, sf_dir), b.ROWS, b.RING).select("day", r("anomaly"), r("gradient"), r("coherence"), r("flow"), r("temporal"), "label", r("margin"))


_ELONGATION = "sqrt(((var_pop(iy) + var_pop(ix) + 1 / 6.0::DOUBLE) / 2 + sqrt(((var_pop(iy) - var_pop(ix)) / 2) ** 2 + covar_pop(iy, ix) ** 2)) / ((var_pop(iy) + var_pop(ix) + 1 / 6.0::DOUBLE) / 2 - sqrt(((var_pop(iy) - var_pop(ix)) / 2) ** 2 + covar_pop(iy, ix) ** 2)))"
_SCORES = ("quiet", "flow", "wave", "front", "localized", "disturbed")


#: From the frames ``obs`` (day, iy, ix, v, n), their motion and growth, and ``wv``, to scores (un) and their ranking (ra).
_EVENTS = f"""{_slopes_sql('pr', 'c', 'pg', 'dx', 'dy')},
an AS (SELECT day, iy, ix, v - 50 AS a, n FROM obs), {_slopes_sql('an', 'a', 'ag', 'dx', 'dy')}, gm AS (SELECT day, iy, ix, sqrt(dx * dx + dy * dy) AS g, dx * dx AS xx, dy * dy AS yy, dx * dy AS xy FROM ag), {_kernel_sql('b', 1.0)}, {_smooth_sql('gm', ['xx', 'yy', 'xy'], 'st', 'b', 0.8)},
mk AS (SELECT q.day, q.iy, q.ix, g, CASE WHEN (t.xx + t.yy) / 2 > 1e-20 THEN sqrt(((t.xx - t.yy) / 2) ** 2 + t.xy * t.xy) / ((t.xx + t.yy) / 2) END AS co FROM (SELECT *, max(g) OVER (PARTITION BY day) AS pk FROM gm) q JOIN st t ON t.day = q.day AND t.iy = q.iy AND t.ix = q.ix WHERE g >= greatest(pk * 0.25, 1e-12)),
ob AS (SELECT day, iy, ix FROM (SELECT *, max(abs(a)) OVER (PARTITION BY day) AS pk FROM an) WHERE abs(a) >= greatest(60.0, 0.25 * pk)),
m1 AS (SELECT day, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS support, tanh(avg(abs(a)) / 40) AS anomaly, count(*) AS cells FROM an GROUP BY day), m2 AS (SELECT day, tanh(avg(abs(gt)) / 40) AS temporal FROM pr GROUP BY day),
m3 AS (SELECT day, tanh(avg(g) / 10) AS gradient, avg(co) AS coherence, {_ELONGATION} AS felong FROM mk GROUP BY day),
m4 AS (SELECT day, {_ELONGATION} AS elong, count(*) / CAST((max(iy) - min(iy) + 1) * (max(ix) - min(ix) + 1) AS DOUBLE) AS compact, min(iy) = 0 OR min(ix) = 0 OR max(iy) = {b.ROWS - 1} OR max(ix) = {b.RING - 1} AS border, count(*) AS osize FROM ob GROUP BY day),
m5 AS (SELECT fl.day, tanh(avg(sqrt(u * u + v * v)) / 5) AS speed, avg(confidence) AS conf, tanh(avg(CASE WHEN confidence >= 0.4 THEN abs(gt + u * dx + v * dy) END) / 40) AS residual FROM fl JOIN pg ON pg.day = fl.day AND pg.iy = fl.iy AND pg.ix = fl.ix GROUP BY fl.day),
m6 AS (SELECT day, avg(greatest(0.0, (explained - 0.95) / (1 - 0.95))) AS growth FROM ml GROUP BY day),
al AS (SELECT m1.day, support, anomaly, coalesce(temporal, 0) AS temporal, coalesce(gradient, 0) AS gradient, coalesce(coherence, 0) AS coherence, coalesce(felong, 1) AS felong, coalesce(elong, 1) AS elong, coalesce(compact, 0) AS compact, coalesce(border, false) AS border, coalesce(osize, 0) / cells::DOUBLE AS share, coalesce(speed, 0) AS speed, coalesce(conf, 0) AS conf, residual, coalesce(growth, 0) AS growth, wave
  FROM m1 LEFT JOIN m2 USING (day) LEFT JOIN m3 USING (day) LEFT JOIN m4 USING (day) LEFT JOIN m5 USING (day) LEFT JOIN m6 USING (day), wv),
sc AS (SELECT day, support, anomaly, support * (1 - anomaly) * (1 - temporal) * (1 - gradient) * (1 - wave) AS quiet, CASE WHEN residual IS NOT NULL THEN conf * speed * (1 - residual) * (1 - 0.5 * wave) ELSE 0 END AS flow, least(1.0, greatest(0.0, wave)) AS wave, support * gradient * coherence * least(1.0, greatest(0.0, (felong - 1) / 3)) * (1 - 0.7 * wave) AS front,
  support * anomaly * sqrt(compact / greatest(elong, 1.0)) * sqrt(1 - share) * (CASE WHEN border THEN 0.5 ELSE 1.0 END) * (1 - wave) AS localized, support * least(1.0, greatest(0.0, (temporal + gradient * (1 - coherence) + coalesce(residual, 0) + temporal * growth) / 3)) AS disturbed FROM al),
un AS (SELECT *, greatest(1 - support, anomaly * (1 - greatest({', '.join(_SCORES)}))) AS uncertain FROM sc),
lo AS (SELECT day, unnest([{', '.join(f"{{'name': '{n}', 'score': {n}}}" for n in (*_SCORES, 'uncertain'))}]) AS x FROM un),
ra AS (SELECT day, arg_max(x.name, (x.score, x.name)) AS label, max(x.score) FILTER (x.name <> 'uncertain') AS s1, list_reverse_sort(list(x.score) FILTER (x.name <> 'uncertain'))[2] AS s2 FROM lo GROUP BY day)"""


@query(f"""WITH {OBS}, {_FLOW}, {_GROWTH}, wv AS (WITH {_PEAK} SELECT coalesce(avg(power / total * (1 - coalesce(other, 0) / power)), 0) AS wave FROM z), {_EVENTS}
SELECT day, {', '.join(rs(n, n) for n in (*_SCORES, 'uncertain'))}, label, {rs('(s1 - s2) / greatest(s1, 1e-12)', 'margin')} FROM un JOIN ra USING (day)""")
def a16_seven_scores(spark, sf_dir):
    from skylattice.plans.fields import event_means, event_scores, wave_score

    obs = b.obs_grid(spark, sf_dir)
    residual = spectral.hann(spectral.detrended(obs.withColumn("region", F.col("iy") % 3), ["region"], "day", "v"), ["region"], "day")
    wave = wave_score(spectral.wave_peak(spectral.wave_power(residual, ["region"], "day", "residual", [4.0, 6.0, 8.0, 12.0], _WAVES, 2.0, 3.0, "hann"), ["region"]))
    out = event_scores(event_means(obs.withColumn("a", F.col("v") - 50), wave, b.ROWS, b.RING, 3.0, 2.0, 40.0, 60.0))
    return out.select("day", *[r(n) for n in (*_SCORES, "uncertain")], "label", r("margin"))


def _focused_events_sql() -> str:
    """The scores of ``_EVENTS`` on the strongest connected object (ob) and one cell around it (fo)."""
    moments = lambda w: f"SELECT day, sum({w}) AS m, sum({w} * ix * 2.0) / sum({w}) AS mx, sum({w} * iy * 3.0) / sum({w}) AS my"
    spread = lambda w: f"SELECT t.day, sum({w} * (ix * 2.0 - mx) ** 2) / any_value(m) + 4 / 12.0::DOUBLE AS vx, sum({w} * (iy * 3.0 - my) ** 2) / any_value(m) + 9 / 12.0::DOUBLE AS vy, sum({w} * (ix * 2.0 - mx) * (iy * 3.0 - my)) / any_value(m) AS vxy"
    lean = "sqrt(((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vxy ** 2)) / greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 1e-12))"
    start, rest = _EVENTS.split("ob AS (SELECT", 1)
    rest = rest[rest.index("m5 AS (") :]
    on_focus = "JOIN fo ON fo.day = {0}.day AND fo.iy = {0}.iy AND fo.ix = {0}.ix"
    start = start.replace("FROM gm) q JOIN", f"FROM gm {on_focus.format('gm')}) q JOIN", 1).replace("max(g) OVER (PARTITION BY day) AS pk", "max(g) OVER (PARTITION BY gm.day) AS pk", 1).replace("(SELECT *, max(g)", "(SELECT gm.*, max(g)", 1)
    rest = rest.replace("AND pg.ix = fl.ix GROUP BY", f"AND pg.ix = fl.ix {on_focus.format('fl')} GROUP BY", 1).replace("FROM ml GROUP BY day", "FROM ml JOIN fo USING (day, iy, ix) GROUP BY day", 1)
    found = f"""sg AS (SELECT day, iy, ix, a, iy * 100000 + ix AS id FROM (SELECT day, iy, ix, v - 50 AS a, max(abs(v - 50)) OVER (PARTITION BY day) AS pk FROM obs) WHERE abs(a) >= greatest(60.0, 0.25 * pk)),
reach AS (SELECT day, id, id AS seed, iy, ix FROM sg UNION SELECT sg.day, sg.id, reach.seed, sg.iy, sg.ix FROM reach JOIN sg ON sg.day = reach.day AND abs(sg.iy - reach.iy) + abs(sg.ix - reach.ix) = 1),
bb AS (SELECT day, iy, ix, min(seed) AS blob FROM reach GROUP BY ALL), bs AS (SELECT bb.day, blob, sum(abs(a)) AS s FROM bb JOIN sg ON sg.day = bb.day AND sg.iy = bb.iy AND sg.ix = bb.ix GROUP BY bb.day, blob), bw AS (SELECT day, blob FROM bs QUALIFY row_number() OVER (PARTITION BY day ORDER BY s DESC, blob) = 1),
ob AS (SELECT bb.day, iy, ix FROM bb JOIN bw ON bw.day = bb.day AND bw.blob = bb.blob), st4(y, x, side) AS (VALUES (0, 0, 0.0), (0, 1, 3.0), (0, -1, 3.0), (1, 0, 2.0), (-1, 0, 2.0)),
fo AS (SELECT DISTINCT obs.day, obs.iy, obs.ix FROM obs LEFT JOIN (SELECT day, iy + y AS iy, ix + x AS ix FROM ob, st4) g ON g.day = obs.day AND g.iy = obs.iy AND g.ix = obs.ix LEFT JOIN bw ON bw.day = obs.day WHERE g.day IS NOT NULL OR bw.day IS NULL)"""
    parts = f"""m1 AS (SELECT an.day, avg(CASE WHEN fo.day IS NOT NULL THEN CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END END) AS support, tanh(avg(CASE WHEN fo.day IS NOT NULL THEN abs(a) END) / 40) AS anomaly, count(*) AS cells FROM an LEFT {on_focus.format('an')} GROUP BY an.day),
m2 AS (SELECT day, tanh(avg(abs(gt)) / 40) AS temporal FROM pr JOIN fo USING (day, iy, ix) GROUP BY day),
fm AS ({moments('g')} FROM mk GROUP BY day), fv AS ({spread('g')} FROM mk t JOIN fm ON fm.day = t.day GROUP BY t.day), m3 AS (SELECT mk.day, tanh(avg(g) / 10) AS gradient, avg(co) AS coherence, any_value({lean}) AS felong FROM mk JOIN fv ON fv.day = mk.day GROUP BY mk.day),
om AS ({moments('1')} FROM ob GROUP BY day), ov AS ({spread('1')} FROM ob t JOIN om ON om.day = t.day GROUP BY t.day), op AS (SELECT ob.day, sum(side) AS rim FROM ob, st4 WHERE NOT EXISTS (SELECT 1 FROM ob d WHERE d.day = ob.day AND d.iy = ob.iy + y AND d.ix = ob.ix + x) GROUP BY ob.day),
m4 AS (SELECT ob.day, any_value({lean}) AS elong, least(1.0, 4 * pi() * count(*) * 6 / any_value(rim) ** 2) AS compact, min(iy) = 0 OR min(ix) = 0 OR max(iy) = {b.ROWS - 1} OR max(ix) = {b.RING - 1} AS border, count(*) AS osize FROM ob JOIN ov ON ov.day = ob.day JOIN op ON op.day = ob.day GROUP BY ob.day),
"""
    return f"{found}, {start}{parts}{rest}"


@query(f"""WITH RECURSIVE {OBS}, {_FLOW}, {_GROWTH}, wv AS (WITH {_PEAK} SELECT coalesce(avg(power / total * (1 - coalesce(other, 0) / power)), 0) AS wave FROM z), {_focused_events_sql()}
SELECT day, {', '.join(rs(n, n) for n in (*_SCORES, 'uncertain'))}, label, {rs('(s1 - s2) / greatest(s1, 1e-12)', 'margin')} FROM un JOIN ra USING (day)""")
def a16_focused_scores(spark, sf_dir):
    from skylattice.plans.fields import event_means, event_scores, wave_score

    obs = b.obs_grid(spark, sf_dir)
    residual = spectral.hann(spectral.detrended(obs.withColumn("region", F.col("iy") % 3), ["region"], "day", "v"), ["region"], "day")
    wave = wave_score(spectral.wave_peak(spectral.wave_power(residual, ["region"], "day", "residual", [4.0, 6.0, 8.0, 12.0], _WAVES, 2.0, 3.0, "hann"), ["region"]))
    out = event_scores(event_means(obs.withColumn("a", F.col("v") - 50), wave, b.ROWS, b.RING, 3.0, 2.0, 40.0, 60.0, focused=True))
    return out.select("day", *[r(n) for n in (*_SCORES, "uncertain")], "label", r("margin"))


def _keyed_sql() -> str:
    """Two regions, daily and twice a day, prepared as frames ``obs`` named region * 1000000 + place, with a wave a region."""
    half = b.obs_sql(12).replace("obs AS (", "ob12 AS (", 1)
    day = OBS.replace("obs AS (", "ob24 AS (", 1)
    prepared = f"""{day}, {half}, al2 AS (SELECT 0 AS region, epoch, iy, ix, v FROM ob24 WHERE iy < 8 UNION ALL SELECT 1, epoch, iy, ix, v FROM ob12 WHERE iy >= 8 AND day % 7 <> 3),
fr2 AS (SELECT DISTINCT region, epoch FROM al2), st2 AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY region ORDER BY epoch) AS step FROM fr2), ca2 AS (SELECT region, median(step) AS cadence, min(epoch) AS e0, max(step) <= 1.5 * median(step) AS whole FROM st2 GROUP BY region),
pl AS (SELECT al2.region, iy, ix, CAST((epoch - e0) / cadence AS BIGINT) AS slot, v FROM al2 JOIN ca2 ON ca2.region = al2.region), sp AS (SELECT region, iy, ix, unnest(r) AS slot FROM (SELECT region, iy, ix, range(min(slot), max(slot) + 1) AS r FROM pl GROUP BY region, iy, ix)),
jo AS (SELECT sp.*, pl.v, max(CASE WHEN pl.v IS NOT NULL THEN sp.slot END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, min(CASE WHEN pl.v IS NOT NULL THEN sp.slot END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
  FROM sp LEFT JOIN pl ON pl.region = sp.region AND pl.iy = sp.iy AND pl.ix = sp.ix AND pl.slot = sp.slot WINDOW w AS (PARTITION BY sp.region, sp.iy, sp.ix ORDER BY sp.slot)),
fi AS (SELECT jo.region, jo.iy, jo.ix, jo.slot, CASE WHEN jo.v IS NOT NULL THEN 2 ELSE 1 END AS n, coalesce(jo.v, CASE WHEN q - p <= 2 THEN a.v + (jo.slot - p) / CAST(q - p AS DOUBLE) * (z.v - a.v) END) AS v FROM jo LEFT JOIN pl a ON a.region = jo.region AND a.iy = jo.iy AND a.ix = jo.ix AND a.slot = p LEFT JOIN pl z ON z.region = jo.region AND z.iy = jo.iy AND z.ix = jo.ix AND z.slot = q),
ce AS (SELECT region, iy, ix, median(v) AS c FROM fi WHERE v IS NOT NULL GROUP BY ALL), obs AS (SELECT CAST(fi.region * 1000000 + fi.slot AS BIGINT) AS day, fi.iy, fi.ix, v - c + 50 AS v, n FROM fi JOIN ce ON ce.region = fi.region AND ce.iy = fi.iy AND ce.ix = fi.ix WHERE v IS NOT NULL)"""
    peak = _PEAK.replace("iy % 3 AS region", "day // 1000000 AS region").replace("kx * ix * 3 - ky * iy * 2", "kx * ix * 2 - ky * iy * 3")
    wave = f"wv AS (WITH {peak} SELECT z.region, power / total * (1 - coalesce(other, 0) / power) AS wave FROM z JOIN ca2 ON ca2.region = z.region AND ca2.whole)"
    events = _EVENTS.replace("LEFT JOIN m6 USING (day), wv),", "LEFT JOIN m6 USING (day) LEFT JOIN wv ON wv.region = m1.day // 1000000),").replace("coalesce(growth, 0) AS growth, wave\n", "coalesce(growth, 0) AS growth, coalesce(wave, 0) AS wave\n")
    return f"{prepared}, {_FLOW}, {_GROWTH}, {wave}, {events}"


@query(f"""WITH {_keyed_sql()}
SELECT CAST(ca2.region AS BIGINT) AS region, CAST(e0 + day % 1000000 * cadence AS BIGINT) AS epoch, CASE WHEN whole THEN 'supported' ELSE 'unsupported_resolution' END AS status, {', '.join(rs(n, n) for n in (*_SCORES, 'uncertain'))}, label, {rs('(s1 - s2) / greatest(s1, 1e-12)', 'margin')} FROM un JOIN ra USING (day) JOIN ca2 ON ca2.region = day // 1000000""")
def g20_keyed_pipeline(spark, sf_dir):
    from skylattice.plans.fields import keyed_pipeline

    part = lambda hours, region, where: b.obs_grid(spark, sf_dir, hours).where(where).select(F.lit(region).cast("bigint").alias("region"), "epoch", "iy", "ix", "v", "day")
    cells = part(24, 0, "iy < 8").unionByName(part(12, 1, "iy >= 8"))
    # a second frame, which says something else, for some epochs of the second region
    other = cells.where("region = 1 AND day % 7 = 3").withColumn("v", F.col("v") + 1)
    frames = cells.withColumn("frame", F.lit("a")).unionByName(other.withColumn("frame", F.lit("b"))).drop("day")
    out, _ = keyed_pipeline(frames, b.ROWS, b.RING, 3.0, 2.0, 40.0, 60.0, [4.0, 6.0, 8.0, 12.0], _WAVES)
    return out.select("region", "epoch", "status", *[r(n) for n in (*_SCORES, "uncertain")], "label", r("margin"))


@query(f"""WITH {OBS}, t AS (SELECT unnest([{DAY0 + 10}, {DAY0 + 15}, {DAY0 + 20}, {DAY0 + 29}]) AS target), e AS (SELECT target, iy, ix, day, v FROM obs, t WHERE day <= target), m AS (SELECT *, median(v) OVER (PARTITION BY target, iy, ix) AS c FROM e),
k AS (SELECT target, iy, ix, any_value(c) AS c, greatest(1.0, 1.4826 * median(abs(v - c))) AS s FROM m GROUP BY ALL), f AS (SELECT CAST(k.target AS BIGINT) AS day, k.iy, k.ix, (v - c) / s AS z FROM k JOIN obs ON obs.day = k.target AND obs.iy = k.iy AND obs.ix = k.ix),
{_kernel_sql('b', 1.0)}, {_smooth_sql('f', ['z'], 'sm', 'b', 0.8)}, sn AS (SELECT * FROM sm WHERE z IS NOT NULL), {_slopes_sql('sn', 'z', 'sl', 'dx', 'dy')}
SELECT day AS target, iy, ix, {rs('z', 'z')}, {rs('sqrt(dx * dx + dy * dy)', 'grad_mag')} FROM sl""")
def g19_prefix_chain(spark, sf_dir):
    from skylattice.plans.fields import prefix_chain

    targets = spark.createDataFrame([(DAY0 + d,) for d in (10, 15, 20, 29)], "target bigint")
    return prefix_chain(b.obs_grid(spark, sf_dir), targets, b.ROWS, b.RING, 3.0, 2.0).select("target", "iy", "ix", r("z_smooth", "z"), r("grad_mag"))


# --- forecast lifecycle ------------------------------------------------------------------------


def _history(spark, sf_dir) -> DataFrame:
    e = b.table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("user_id", F.date_trunc("minute", "t").alias("observed_at"), "t", "event_id", "value").groupBy("user_id", "observed_at").agg(
        F.max("value").alias("value"), F.lit(0.9).alias("coverage"), F.max(F.col("t") + F.expr("INTERVAL 5 MINUTES")).alias("produced_at")
    )


def _requests(spark, sf_dir) -> DataFrame:
    t = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    e = b.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select("user_id", "event_id", t.alias("origin_at"), (t + F.expr("INTERVAL 1 MINUTE")).alias("issued_at"), (t + F.expr("INTERVAL 2 HOURS")).alias("valid_at"), (F.col("event_id") % 2 == 0).alias("live"))


@query("""WITH h AS (SELECT user_id, date_trunc('minute', ts) AS at_, max(value) AS value, max(ts + INTERVAL 5 MINUTE) AS produced FROM events WHERE event_type = 'view' GROUP BY ALL),
q AS (SELECT event_id, user_id, date_trunc('hour', ts) AS origin FROM events WHERE event_type = 'purchase'),
j AS (SELECT q.*, h.at_, h.value, h.produced FROM q ASOF LEFT JOIN h ON q.user_id = h.user_id AND q.origin >= h.at_),
k AS (SELECT *, CASE WHEN at_ IS NULL THEN 'no_history' WHEN event_id % 2 = 0 AND produced > origin + INTERVAL 1 MINUTE THEN 'input_not_available' END AS reject_reason FROM j)
SELECT event_id, round(CASE WHEN reject_reason IS NULL THEN value END, 6) + CAST(0 AS DOUBLE) AS predicted, reject_reason FROM k""")
def l1_issue_forecasts(spark, sf_dir):
    return lifecycle.issue_forecasts(_requests(spark, sf_dir), _history(spark, sf_dir), ["user_id"]).select("event_id", r("predicted"), "reject_reason")


@query("""WITH h AS (SELECT user_id, date_trunc('minute', ts) AS at_, max(value) AS value, max(ts + INTERVAL 5 MINUTE) AS produced FROM events WHERE event_type = 'view' GROUP BY ALL),
q AS (SELECT event_id, user_id, date_trunc('hour', ts) AS origin FROM events WHERE event_type = 'purchase'),
j AS (SELECT q.*, h.at_, h.value, h.produced FROM q ASOF LEFT JOIN h ON q.user_id = h.user_id AND q.origin >= h.at_),
k AS (SELECT *, CASE WHEN at_ IS NULL THEN 'no_history' WHEN event_id % 7 > 5 THEN 'model_created_after_issue' WHEN event_id % 11 > 8 THEN 'region_created_after_issue' WHEN event_id % 2 = 0 AND produced > origin + INTERVAL 1 MINUTE THEN 'input_not_available' END AS reject_reason FROM j)
SELECT coalesce(reject_reason, 'issued') AS outcome, count(*) AS n, round(sum(CASE WHEN reject_reason IS NULL THEN value END), 4) + CAST(0 AS DOUBLE) AS total FROM k GROUP BY 1""")
def l1_leak_rules(spark, sf_dir):
    made = lambda m, k: F.col("issued_at") + F.make_dt_interval(hours=(F.col("event_id") % m - k).cast("int"))
    requests = _requests(spark, sf_dir).withColumn("model_created_at", made(7, 5)).withColumn("region_created_at", made(11, 8))
    issued = lifecycle.issue_forecasts(requests, _history(spark, sf_dir), ["user_id"], created=("model", "region"))
    return issued.groupBy(F.coalesce("reject_reason", F.lit("issued")).alias("outcome")).agg(F.count("*").alias("n"), r(F.sum("predicted"), "total", 4))


@query(f"""WITH {b.REV_SQL}, g AS (SELECT series, day, avg(value) AS v, count(*) FILTER (value < 150) AS cells, list(DISTINCT event_type) AS flags FROM rev GROUP BY ALL),
f AS (SELECT *, CASE WHEN cells <= 0 THEN 'no_cells' WHEN cells / 3.0::DOUBLE < 0.5 THEN 'coverage_below_minimum' WHEN list_contains(flags, 'error') THEN 'disqualifying_flag' END AS reason FROM g)
SELECT coalesce(reason, 'usable') AS outcome, count(*) AS n, {rs('sum(CASE WHEN reason IS NULL THEN abs(v - 50) END)', 'total')}, count(*) FILTER (reason IS NULL AND abs(v - 50) / 30.0::DOUBLE >= 1.0) AS candidates FROM f GROUP BY 1""")
def l3_floor_reasons(spark, sf_dir):
    days = b.obs_rev(spark, sf_dir).groupBy("series", "day").agg(F.avg("value").alias("actual"), F.count_if(F.col("value") < 150).alias("cells"), F.flatten(F.collect_set("flags")).alias("flags"))
    days = days.withColumn("actual_coverage", F.col("cells") / 3.0).withColumn("predicted", F.lit(50.0))
    floor = lifecycle.quality_floor(F.col("actual"), F.col("actual_coverage"), F.col("cells"), F.col("flags"), ["error"])
    judged = lifecycle.decide(days.withColumn("reason", floor), F.lit(0.0), F.lit(30.0), 1.0, floor=F.col("reason"))
    return judged.groupBy(F.coalesce("reason", F.lit("usable")).alias("outcome")).agg(F.count("*").alias("n"), r(F.sum(F.abs("residual")), "total"), F.count_if("is_anomaly").alias("candidates"))


def _decided(spark, sf_dir, available: str) -> DataFrame:
    forecasts = _forecasts(spark, sf_dir).select("series", F.col("valid_day").cast("timestamp").alias("valid_at"), "predicted")
    forecasts = forecasts.withColumn("forecast_id", encode.stable_id("forecast", F.col("series"), F.unix_date(F.col("valid_at").cast("date"))))
    actuals = b.obs_rev(spark, sf_dir).withColumn("observed_at", F.col("day").cast("timestamp")).withColumn("coverage", F.when(F.array_contains("flags", "error"), 0.2).otherwise(0.9))
    matched = lifecycle.match_actuals(forecasts, actuals, ["series"], F.lit(available).cast("timestamp"))
    return lifecycle.decide(matched, F.lit(0.0), F.lit(30.0), 3.0, uncertain=F.col("series") % 10 == 0)


def _decided_sql(available: str) -> str:
    return f"""{b.REV_SQL}, {_FORECASTS}, a AS (SELECT series, day AS valid_day, artifact_id AS actual_id, value AS actual, CASE WHEN event_type = 'error' THEN 0.2 ELSE 0.9 END AS cov FROM rev WHERE ingested_at <= TIMESTAMP '{available}' QUALIFY row_number() OVER (PARTITION BY series, day {_ORDER}) = 1),
d AS (SELECT f.series, f.valid_day, predicted, actual_id, coalesce(cov >= 0.5, false) AS usable, CASE WHEN cov >= 0.5 THEN actual - predicted END AS residual FROM f LEFT JOIN a ON a.series = f.series AND a.valid_day = f.valid_day),
z AS (SELECT *, abs(residual / 30.0) >= 3.0 AS is_anomaly, CASE WHEN NOT usable THEN NULL WHEN series % 10 = 0 THEN 'unknown' WHEN abs(residual / 30.0) >= 3.0 THEN 'candidate' ELSE 'normal' END AS assessment FROM d)"""


_DAY = "CAST(datediff('day', DATE '1970-01-01', valid_day) AS BIGINT) AS valid_day"


def _valid_day() -> Column:
    return F.unix_date(F.col("valid_at").cast("date")).cast("bigint").alias("valid_day")


@query(f"WITH {_decided_sql('2024-02-10 00:00:00')} SELECT series, {_DAY}, {rs('residual', 'residual')}, {rs('abs(residual / 30.0)', 'anomaly_score')}, is_anomaly, assessment FROM z")
def l2_zscore_decision(spark, sf_dir):
    return _decided(spark, sf_dir, "2024-02-10 00:00:00").select("series", _valid_day(), r("residual"), r("anomaly_score"), "is_anomaly", "assessment")


@query(f"WITH {_decided_sql('2024-02-10 00:00:00')} SELECT valid_day, usable, count(*) AS n FROM (SELECT {_DAY}, usable FROM z) GROUP BY ALL")
def l3_quality_floor(spark, sf_dir):
    return _decided(spark, sf_dir, "2024-02-10 00:00:00").groupBy(_valid_day(), "usable").agg(F.count("*").alias("n"))


_STATUS = """CASE WHEN valid_day > DATE '2024-01-20' THEN 'NOT_DUE' WHEN usable THEN 'SCORED' WHEN epoch(TIMESTAMP '2024-01-20 05:00:00') - epoch(CAST(valid_day AS TIMESTAMP)) < 21600 THEN 'PENDING' ELSE 'INSUFFICIENT_DATA' END"""


def _reconciled(spark, sf_dir) -> DataFrame:
    now = F.lit("2024-01-20 05:00:00").cast("timestamp")
    return lifecycle.reconcile(_decided(spark, sf_dir, "2024-01-20 05:00:00"), now, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query(f"WITH {_decided_sql('2024-01-20 05:00:00')} SELECT series, {_DAY}, {_STATUS} AS status FROM z")
def l4_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("series", _valid_day(), "status")


@query(f"""WITH {_decided_sql('2024-02-10 00:00:00')}, o AS (SELECT series, day AS valid_day, artifact_id AS old FROM rev WHERE ingested_at <= TIMESTAMP '2024-01-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY series, day {_ORDER}) = 1),
old AS (SELECT f.series, f.valid_day, o.old FROM f JOIN o ON o.series = f.series AND o.valid_day = f.valid_day JOIN rev ON rev.artifact_id = o.old WHERE event_type <> 'error')
SELECT z.series, {_DAY.replace('valid_day)', 'z.valid_day)')}, old.old AS old_actual, z.actual_id FROM z JOIN old ON old.series = z.series AND old.valid_day = z.valid_day WHERE usable AND z.actual_id <> old.old""")
def l5_reassess(spark, sf_dir):
    first = _decided(spark, sf_dir, "2024-01-15 12:00:00").where("usable").withColumn("decision_id", F.col("actual_id").cast("string")).withColumn("decided_at", F.lit(1))
    new = lifecycle.reassess(first.select("forecast_id", "decision_id", "decided_at", "actual_id"), _decided(spark, sf_dir, "2024-02-10 00:00:00"))
    return new.select("series", _valid_day(), F.col("supersedes_decision_id").cast("bigint").alias("old_actual"), "actual_id")


@query(f"""WITH e AS (WITH {_decided_sql('2024-01-20 05:00:00')} SELECT series, valid_day FROM z WHERE {_STATUS} = 'INSUFFICIENT_DATA'), n AS (WITH {_decided_sql('2024-02-10 00:00:00')} SELECT series, valid_day, usable FROM z)
SELECT n.series, {_DAY.replace('valid_day)', 'n.valid_day)')}, CASE WHEN usable THEN 'SCORED' ELSE 'INSUFFICIENT_DATA' END AS status FROM n JOIN e ON e.series = n.series AND e.valid_day = n.valid_day""")
def l6_retry(spark, sf_dir):
    return lifecycle.retry(_reconciled(spark, sf_dir), _decided(spark, sf_dir, "2024-02-10 00:00:00")).select("series", _valid_day(), "status")


@query(f"WITH {_decided_sql('2024-02-10 00:00:00')} SELECT series, {_DAY}, assessment FROM z WHERE valid_day >= DATE '2024-01-10' AND valid_day < DATE '2024-01-20' AND is_anomaly AND assessment = 'candidate'")
def l7_decision_search(spark, sf_dir):
    made = _decided(spark, sf_dir, "2024-02-10 00:00:00").withColumn("decision_id", F.col("forecast_id")).withColumn("supersedes_decision_id", F.lit(None).cast("string"))
    out = lifecycle.search(made, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), True, "candidate")
    return out.select("series", _valid_day(), "assessment")


@query(f"WITH {b.REV_SQL} SELECT series, CAST(datediff('day', DATE '1970-01-01', day) AS BIGINT) AS day, max(artifact_id) AS artifact_id, {rs('arg_max(value, artifact_id)', 'value')}, max(artifact_id) > (SELECT max(artifact_id) * 2 // 5 FROM rev) AS fresh FROM rev WHERE artifact_id <= (SELECT max(artifact_id) * 9 // 10 FROM rev) GROUP BY series, day")
def l8_incremental_scan(spark, sf_dir):
    rows = b.obs_rev(spark, sf_dir).select("series", F.unix_date("day").cast("bigint").alias("day"), "artifact_id", "value")
    return lifecycle.incremental_scan(rows, ["series"], "day", "artifact_id", _share_of(rows, "artifact_id", 2, 5), _share_of(rows, "artifact_id", 9, 10)).select("series", "day", "artifact_id", r("value"), "fresh")


def _scanned_sql(name: str, share: str) -> str:
    """Rows and scores of a scan over the latest publications up to a share of the numbers."""
    rows = f"SELECT series, CAST(datediff('day', DATE '1970-01-01', day) AS BIGINT) AS day, max(artifact_id) AS artifact_id, arg_max(value, artifact_id) AS x FROM rev WHERE artifact_id <= (SELECT max(artifact_id) * {share} FROM rev) GROUP BY ALL"
    fold = _fold_sql("series", "day").replace("fold", f"fold{name}").replace(" s ", f" s{name} ").replace("s.", f"s{name}.")
    return f"r{name} AS ({rows}), s{name} AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM r{name}), {fold}"


@query(f"""WITH RECURSIVE {b.REV_SQL}, {_scanned_sql('a', '2 // 5')}, {_scanned_sql('b', '9 // 10')},
al AS (SELECT 0 AS run, r.series, r.day, r.artifact_id, forecast, score FROM ra r JOIN folda f ON f.series = r.series AND f.day = r.day UNION ALL SELECT 1, r.series, r.day, r.artifact_id, forecast, score FROM rb r JOIN foldb f ON f.series = r.series AND f.day = r.day WHERE r.artifact_id > (SELECT max(artifact_id) * 2 // 5 FROM rev))
SELECT CAST(run AS BIGINT) AS run, series, day, artifact_id, {rs('forecast', 'forecast')}, {rs('score', 'score')}, score >= 4.5 AS candidate FROM al""")
def l8_resumed_scan(spark, sf_dir):
    from skylattice.plans.scans import committed_scores, scan_run

    rows = b.obs_rev(spark, sf_dir).select("series", F.unix_date("day").cast("bigint").alias("day"), "artifact_id", "value")
    path = _folder(spark, "scans")
    for share in ((2, 5), (9, 10)):
        scan_run(rows, ["series"], "day", "artifact_id", "value", path, _share_of(rows, "artifact_id", *share))
    return committed_scores(spark, path).select("run", "series", "day", "artifact_id", r("forecast"), r("score"), "candidate")


@query(f"""WITH {OBS}, l AS (SELECT *, lag(v) OVER (PARTITION BY iy, ix ORDER BY day) AS p FROM obs), x AS (SELECT day, iy, ix, v - p AS res FROM l WHERE p IS NOT NULL), c AS (SELECT *, median(res) OVER (PARTITION BY iy, ix) AS c FROM x),
s AS (SELECT iy, ix, any_value(c) AS c, greatest(1.0, 1.4826 * median(abs(res - c))) AS s FROM c GROUP BY iy, ix), z AS (SELECT day, greatest(0.0, (abs(res - s.c) - 1.0) / s.s) AS z FROM x JOIN s USING (iy, ix)), m AS (SELECT day, quantile_cont(z, 0.95) AS score, count(*) AS cells FROM z GROUP BY day)
SELECT day, {rs('score', 'score')}, cells, score >= (SELECT greatest(3.0, quantile_cont(score, 0.995)) FROM m) AS candidate FROM m""")
def l9_residual_scan(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    res = b.obs_grid(spark, sf_dir).withColumn("res", F.col("v") - F.lag("v").over(w)).where("res IS NOT NULL").withColumn("one", F.lit(1.0))
    scaled = res.join(agg.robust_scale(res, ["iy", "ix"], "res", 1.0), ["iy", "ix"]).withColumn("residual", F.col("res") - F.col("centre"))
    maps = agg.map_scores(scaled, ["day"], "residual", "one", "scale", ["iy", "ix"])
    return maps.join(F.broadcast(agg.calibrated_threshold(maps, "score"))).select("day", r("score"), "cells", (F.col("score") >= F.col("threshold")).alias("candidate"))


@query(f"""WITH {OBS}, l AS (SELECT iy, ix, day, v - lag(v) OVER w AS res FROM obs WINDOW w AS (PARTITION BY iy, ix ORDER BY day)), x AS (SELECT *, lag(res) OVER (PARTITION BY iy, ix ORDER BY day) AS prev FROM l), k AS (SELECT * FROM x WHERE prev IS NOT NULL),
g AS (SELECT iy, ix, coalesce(sum(res * prev) FILTER (day <= {DAY0 + 20}), 0) / (coalesce(sum(prev * prev) FILTER (day <= {DAY0 + 20}), 0) + 10.0) AS gain FROM k GROUP BY iy, ix), e AS (SELECT day, iy, ix, res - gain * prev AS err FROM k JOIN g USING (iy, ix)), c AS (SELECT *, median(err) OVER (PARTITION BY iy, ix) AS c FROM e),
s AS (SELECT iy, ix, any_value(c) AS c, greatest(1.0, 1.4826 * median(abs(err - c))) AS s FROM c GROUP BY iy, ix), z AS (SELECT day, greatest(0.0, (abs(err - s.c) - 1.0) / s.s) AS z FROM e JOIN s USING (iy, ix)), m AS (SELECT day, quantile_cont(z, 0.95) AS score, count(*) AS cells FROM z GROUP BY day)
SELECT day, {rs('score', 'score')}, cells, score >= (SELECT greatest(3.0, quantile_cont(score, 0.995)) FROM m) AS candidate FROM m""")
def l9_ridge_scan(spark, sf_dir):
    pairs = timeseries.next_map_residuals(b.obs_grid(spark, sf_dir), ["iy", "ix"], "day", "v", DAY0 + 20, 10.0).withColumn("one", F.lit(1.0))
    scaled = pairs.join(agg.robust_scale(pairs, ["iy", "ix"], "err", 1.0), ["iy", "ix"]).withColumn("residual", F.col("err") - F.col("centre"))
    maps = agg.map_scores(scaled, ["day"], "residual", "one", "scale", ["iy", "ix"])
    return maps.join(F.broadcast(agg.calibrated_threshold(maps, "score"))).select("day", r("score"), "cells", (F.col("score") >= F.col("threshold")).alias("candidate"))


class WindowMean:
    """A user's model: the mean of the window."""

    version = "window-mean-1"

    def predict(self, windows):
        return windows.mean(axis=1)


def _model_scan_sql(name: str, predicted: str) -> str:
    return f"""e{name} AS (SELECT day, iy, ix, v - ({predicted}) AS err FROM k, w), c{name} AS (SELECT *, median(err) OVER (PARTITION BY iy, ix) AS c FROM e{name}), s{name} AS (SELECT iy, ix, any_value(c) AS c, greatest(1.0, 1.4826 * median(abs(err - c))) AS s FROM c{name} GROUP BY iy, ix),
z{name} AS (SELECT day, greatest(0.0, (abs(err - s.c) - 1.0) / s.s) AS z FROM e{name} e JOIN s{name} s ON s.iy = e.iy AND s.ix = e.ix), m{name} AS (SELECT day, quantile_cont(z, 0.95) AS score, count(*) AS cells FROM z{name} GROUP BY day)"""


_MODEL_ROWS = lambda name, label: f"SELECT '{label}' AS model, day, {rs('score', 'score')}, cells, score >= (SELECT greatest(3.0, quantile_cont(score, 0.995)) FROM m{name}) AS candidate FROM m{name}"


@query(f"""WITH {_ISLANDS}, k AS (SELECT iy, ix, day, v, lag(v, 2) OVER p AS x0, lag(v) OVER p AS x1 FROM i WINDOW p AS (PARTITION BY iy, ix, island ORDER BY day) QUALIFY row_number() OVER p > 2),
g AS (SELECT count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(v) AS my, sum(x0 * x0) - count(*) * avg(x0) ** 2 + 10.0 AS s00, sum(x1 * x1) - count(*) * avg(x1) ** 2 + 10.0 AS s11, sum(x0 * x1) - count(*) * avg(x0) * avg(x1) AS s01, sum(x0 * v) - count(*) * avg(x0) * avg(v) AS s0y, sum(x1 * v) - count(*) * avg(x1) * avg(v) AS s1y FROM k WHERE day <= {DAY0 + 20}),
h AS (SELECT *, (s0y * s11 - s1y * s01) / (s00 * s11 - s01 * s01) AS w0, (s1y * s00 - s0y * s01) / (s00 * s11 - s01 * s01) AS w1 FROM g), w AS (SELECT w0, w1, my - w0 * m0 - w1 * m1 AS w2 FROM h),
{_model_scan_sql('a', 'w2 + w0 * x0 + w1 * x1')}, {_model_scan_sql('b', '(x0 + x1) / 2')} {_MODEL_ROWS('a', 'ridge')} UNION ALL {_MODEL_ROWS('b', 'window-mean-1')}""")
def l9_model_scan(spark, sf_dir):
    cell, obs = ["iy", "ix"], b.obs_grid(spark, sf_dir)
    ridge = models.fit_linear(timeseries.causal_windows(obs, cell, "day", "v", 1, 2), "v", 2, 10.0, F.col("day") <= DAY0 + 20)
    scans = [models.model_scan(obs, cell, "day", "v", 1, 2, version, load) for version, load in ((ridge.version, lambda: ridge), (WindowMean.version, WindowMean))]
    named = F.when(F.col("model_version").startswith("ridge-"), "ridge").otherwise(F.col("model_version"))
    return scans[0].unionByName(scans[1]).select(named.alias("model"), "day", r("score"), "cells", "candidate")


@query(f"""WITH {_decided_sql('2024-01-20 05:00:00')}, s AS (SELECT {_STATUS} AS status FROM z)
SELECT count(*) AS considered, count(*) FILTER (status = 'SCORED') AS scored, count(*) FILTER (status = 'INSUFFICIENT_DATA') AS insufficient, count(*) FILTER (status = 'PENDING') AS retryable FROM s WHERE status <> 'NOT_DUE'""")
def l10_vertical_slice(spark, sf_dir):
    return lifecycle.outcome_counts(_reconciled(spark, sf_dir))


@query(f"""WITH {OBS}, g AS (SELECT iy % 3 AS region, day, avg(v) AS value, count(v) AS cells FROM obs GROUP BY ALL), h AS (SELECT *, cells / CAST(max(cells) OVER (PARTITION BY region) AS DOUBLE) >= 0.5 AS good FROM g),
d AS (SELECT f.region, f.day + 1 AS valid_day, f.value AS predicted, coalesce(a.good, false) AS usable, CASE WHEN a.good THEN a.value - f.value END AS residual FROM h f LEFT JOIN h a ON a.region = f.region AND a.day = f.day + 1 AND a.day < {DAY0 + 25} WHERE f.good)
SELECT region, valid_day, {rs('predicted', 'predicted')}, {rs('residual', 'residual')}, {rs('abs(residual / 6.0)', 'anomaly_score')}, CASE WHEN usable THEN CASE WHEN abs(residual / 6.0) >= 1.5 THEN 'candidate' ELSE 'normal' END END AS assessment,
  CASE WHEN valid_day > {DAY0 + 26} THEN 'NOT_DUE' WHEN usable THEN 'SCORED' WHEN valid_day >= {DAY0 + 25} THEN 'PENDING' ELSE 'INSUFFICIENT_DATA' END AS status FROM d WHERE valid_day >= {DAY0 + 5} AND valid_day < {DAY0 + 29}""")
def l10_slice_run(spark, sf_dir):
    at = lambda day: F.timestamp_seconds(F.lit(day * 86400))
    cells = b.obs_grid(spark, sf_dir).withColumn("region", F.col("iy") % 3)
    out = lifecycle.vertical_slice(cells, "region", at(DAY0 + 25), at(DAY0 + 26), at(DAY0 + 5), at(DAY0 + 29), 6.0, 1.5)
    return out.select("region", _valid_day(), r("predicted"), r("residual"), r("anomaly_score"), "assessment", "status")


# --- data quality and provenance ---------------------------------------------------------------


@query("""SELECT rule, key FROM (SELECT event_id AS key, unnest(['value_in_range', 'known_type', 'positive_id', 'large_purchase']) AS rule,
unnest([value BETWEEN 0 AND 300, event_type IN ('error','view','click','signup','purchase'), event_id >= 1, event_type <> 'purchase' OR value <= 200]) AS ok FROM events) WHERE NOT ok""")
def q1_rule_check(spark, sf_dir):
    rules = {"value_in_range": F.col("value").between(0, 300), "known_type": F.col("event_type").isin(*b.EVENT_TYPES), "positive_id": F.col("event_id") >= 1, "large_purchase": (F.col("event_type") != "purchase") | (F.col("value") <= 200)}
    return joins.violations(b.table(spark, sf_dir, "events"), "event_id", rules)


_RULES = ("clocks_in_order", "counts_add_up", "parent_exists", "known_priority", "id_not_empty")


@query(f"""WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_discount <= 0.05) AS valid, count(*) FILTER (l_discount > 0.05) AS missing, max(l_linenumber) AS expected, CAST(min(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS key, trim(o_orderstatus) AS status, CAST(o_orderdate AS DATE) AS ordered, shipped, valid, missing, expected, c.c_custkey AS parent, o_orderpriority AS priority FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) c ON c.c_custkey = o_custkey),
v AS (SELECT key, unnest({list(_RULES)}) AS rule, unnest([ordered <= shipped, valid + missing = expected, parent IS NOT NULL, priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'), status <> '']) AS ok,
  unnest(['ordered=' || coalesce(CAST(ordered AS VARCHAR), 'null') || ', shipped=' || coalesce(CAST(shipped AS VARCHAR), 'null'), 'valid=' || coalesce(CAST(valid AS VARCHAR), 'null') || ', missing=' || coalesce(CAST(missing AS VARCHAR), 'null') || ', expected=' || coalesce(CAST(expected AS VARCHAR), 'null'),
    'parent=' || coalesce(CAST(parent AS VARCHAR), 'null'), 'priority=' || coalesce(priority, 'null'), 'status=' || coalesce(status, 'null')]) AS detail FROM o)
SELECT rule, key, detail FROM v WHERE NOT coalesce(ok, false)""")
def q1_rule_details(spark, sf_dir):
    low = F.col("l_discount") <= 0.05
    lines = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count_if(low).alias("valid"), F.count_if(~low).alias("missing"), F.max("l_linenumber").alias("expected"), F.to_date(F.min("l_shipdate")).alias("shipped"))
    parents = b.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("parent"))
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.trim("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("ordered"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    o = o.join(lines, "key", "left").join(parents, "o_custkey", "left")
    checks = (F.col("ordered") <= F.col("shipped"), F.col("valid") + F.col("missing") == F.col("expected"), F.col("parent").isNotNull(), F.col("priority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), F.col("status") != "")
    looked = (["ordered", "shipped"], ["valid", "missing", "expected"], ["parent"], ["priority"], ["status"])
    return joins.violations(o, "key", dict(zip(_RULES, checks, strict=True)), dict(zip(_RULES, looked, strict=True)))


@query(f"""WITH {OBS}, a AS (SELECT *, lag(day) OVER (PARTITION BY iy, ix ORDER BY day) AS before FROM obs), c AS (SELECT day, iy, ix, v <= 200 AND isfinite(v) AS finite, n <= 6 AS confidence, before IS NULL OR day - before <= 2 AS axis FROM a)
SELECT rule, count(*) AS failures FROM (SELECT unnest(['finite_value', 'count_in_range', 'axis_steps']) AS rule, unnest([finite, confidence, axis]) AS ok FROM c) WHERE NOT ok GROUP BY rule""")
def q2_field_contract(spark, sf_dir):
    w = Window.partitionBy("iy", "ix").orderBy("day")
    obs = b.obs_grid(spark, sf_dir).withColumn("step", F.col("day") - F.lag("day").over(w)).withColumn("key", F.concat_ws(":", "day", "iy", "ix"))
    rules = {"finite_value": (F.col("v") <= 200) & ~F.isnan("v"), "count_in_range": F.col("n") <= 6, "axis_steps": F.col("step").isNull() | (F.col("step") <= 2)}
    return joins.violations(obs, "key", rules).groupBy("rule").agg(F.count("*").alias("failures"))


@query()
def q3_snapshot_manifest(spark, sf_dir):
    from skylattice.operators.manifests import snapshot_manifest

    return snapshot_manifest(b.obs_grid(spark, sf_dir).select("day", "iy", "ix", "v", "n"), "day")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
p AS (SELECT day, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'validation' WHEN i < floor(n * 0.9::DOUBLE) THEN 'calibration' ELSE 'test' END AS part FROM n),
s AS (SELECT part, min(day) AS a, max(day) AS e, count(*) AS days FROM p GROUP BY part), l AS (SELECT *, lag(e) OVER (ORDER BY a) AS before FROM s)
SELECT part, days, before IS NULL OR before < a AS in_order FROM l""")
def q4_split_contract(spark, sf_dir):
    from skylattice.operators.manifests import split_contract

    days = b.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return split_contract(timeseries.chronological_split(days, "day"), "part", "day")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
p AS (SELECT day, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.8::DOUBLE) THEN 'validation' WHEN i < floor(n * 0.9::DOUBLE) THEN 'calibration' ELSE 'test' END AS part FROM n)
SELECT sha256(concat(o_custkey, '|', o_orderstatus)) AS content, count(DISTINCT part) AS parts FROM orders JOIN p ON p.day = CAST(o_orderdate AS DATE) GROUP BY 1 HAVING count(DISTINCT part) > 1""")
def q4_shared_content(spark, sf_dir):
    from skylattice.operators.manifests import shared_content

    orders = b.table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    parts = timeseries.chronological_split(orders.select("day").distinct(), "day")
    rows = orders.join(parts.hint("merge"), "day").select("part", F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256).alias("content"))
    return shared_content(rows, "part", "content")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT year(day) AS part, day, n FROM d)
SELECT CAST(part AS INT) AS part, sha256(string_agg(CAST(day AS VARCHAR) || '=' || n, ',' ORDER BY day)) AS manifest, count(*) AS days FROM y GROUP BY part""")
def q5_training_manifest(spark, sf_dir):
    from skylattice.operators.manifests import ordered_hash

    days = b.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return ordered_hash(days.withColumn("part", F.year("day")), "part", "day", F.concat(F.col("day").cast("string"), F.lit("="), F.col("n").cast("string")))


# --- sources and sinks -------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    import uuid

    from skylattice.plans.store import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _map_archive(spark, sf_dir) -> str:
    """The observations as daily map files, written by Spark to a new folder."""
    from skylattice.sources.mapfiles import map_file_texts

    obs, (lats, lons) = b.obs_grid(spark, sf_dir, 6), b.axes()
    full = grid.densify(obs, obs.select("epoch").distinct(), lats, lons, "v").join(obs.select("epoch", "iy", "ix", "n"), ["epoch", "iy", "ix"], "left")
    path = _folder(spark, "maps")
    map_file_texts(full, "epoch", "v", "n", lats, lons).repartition("product_date").write.partitionBy("product_date").text(path)
    return path


@query(f"WITH {OBS6} SELECT epoch, lat, lon, CAST(floor(round(v * 10, 6) + 0.5) / 10 AS DOUBLE) AS vtec FROM obs")
def s1_map_file_load(spark, sf_dir):
    from skylattice.sources.mapfiles import load_map_files

    return load_map_files(spark, _map_archive(spark, sf_dir))[0].select("epoch", "lat", "lon", "vtec")


@query(f"WITH {OBS6} SELECT epoch, lat, lon, CAST(n AS DOUBLE) AS rms FROM obs")
def s2_rms_map_join(spark, sf_dir):
    from skylattice.sources.mapfiles import load_map_files

    return load_map_files(spark, _map_archive(spark, sf_dir))[0].select("epoch", "lat", "lon", "rms")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS k, CAST(ts AS DATE) AS day FROM events)
SELECT a.event_id FROM e a WHERE a.event_id > (SELECT max(event_id) // 2 FROM events) AND NOT EXISTS (SELECT 1 FROM e c WHERE c.event_id <= (SELECT max(event_id) // 2 FROM events) AND c.user_id = a.user_id AND c.k IS NOT DISTINCT FROM a.k AND c.day = a.day)""")
def s3_idempotent_ingest(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("k"), F.to_date("ts").alias("day"))
    known = F.col("event_id") <= _share_of(e, "event_id", 1, 2)
    return revisions.unseen(e.where(~known), e.where(known), ["user_id", "k", "day"]).select("event_id")


@query("SELECT CASE WHEN o_orderkey > (SELECT max(o_orderkey) * 3 // 4 FROM orders) THEN 'insert' WHEN o_orderkey % 7 = 0 THEN 'conflict' ELSE 'same' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def s4_immutable_insert(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.withColumn("o_totalprice", F.when((F.col("o_orderkey") % 7 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return revisions.split_inserts(new, o.where(F.col("o_orderkey") <= _share_of(o, "o_orderkey", 3, 4)), ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {b.REV_SQL} SELECT series, day, artifact_id FROM rev WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-18' AND ingested_at <= TIMESTAMP '2024-01-16 12:00:00' AND (series % 15) * 2.5 - 17.5 BETWEEN -10 AND 10
AND round((series // 15) * 3.6 - 180, 10) BETWEEN -180 AND -165 QUALIFY row_number() OVER (PARTITION BY series, day {_ORDER}) = 1 ORDER BY series, day""")
def s5_windowed_series(spark, sf_dir):
    from skylattice.sources.tables import read_series

    rows = b.obs_rev(spark, sf_dir).withColumn("lat", (F.col("series") % 15) * 2.5 - 17.5).withColumn("lon", F.round(F.expr("series div 15") * 3.6 - 180, 10))
    start, end, instant = (F.lit(x).cast("timestamp") for x in ("2024-01-08 00:00:00", "2024-01-18 00:00:00", "2024-01-16 12:00:00"))
    return read_series(rows, ["series"], "day", start, end, instant, (-10, -180, 10, -165)).select("series", "day", "artifact_id")


@query(f"WITH {b.REV_SQL}, m AS (SELECT series, min(day) AS a, max(day) AS e FROM rev WHERE value > 150 GROUP BY series) SELECT series, count(*) AS n FROM rev JOIN m USING (series) WHERE e >= DATE '2024-01-20' AND a <= DATE '2024-01-22' GROUP BY series")
def s6_overlap_read(spark, sf_dir):
    from skylattice.sources.tables import read_overlapping

    rows = b.obs_rev(spark, sf_dir)
    manifest = rows.where("value > 150").groupBy("series").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return read_overlapping(rows, manifest, "series", F.lit("2024-01-20").cast("date"), F.lit("2024-01-22").cast("date")).groupBy("series").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS source, CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS kp FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) <= 9""")
def s7_context_series(spark, sf_dir):
    from skylattice.sources.tables import context_series

    e = b.table(spark, sf_dir, "events").where("event_type = 'error'")
    days = e.groupBy(F.col("user_id").alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("Kp"))
    tag = F.concat(F.col("day").cast("string"), F.lit("T00:00:00"))
    objects = days.where("source % 2 = 0").groupBy("source").agg(F.to_json(F.collect_list(F.struct(tag.alias("time_tag"), "Kp"))).alias("text"))
    header = F.array(F.lit("time_tag"), F.lit("Kp"))
    tables = days.where("source % 2 = 1").groupBy("source").agg(F.to_json(F.concat(F.array(header), F.collect_list(F.array(tag, F.col("Kp").cast("string"))))).alias("text"))
    good, _ = context_series(objects.unionByName(tables))
    return good.select("source", F.unix_date(F.to_date("time")).cast("bigint").alias("day"), "kp")


@query(f"WITH {OBS} SELECT day, iy, ix, {rs('v', 'v')} FROM obs")
def s8_verified_archive(spark, sf_dir):
    from skylattice.sources.tables import read_archive, write_archive

    obs, path = b.obs_grid(spark, sf_dir).select("day", "iy", "ix", "v"), _folder(spark, "archive")
    write_archive(obs, path, "day")
    return read_archive(spark, path, obs.schema, "day")[0].select("day", "iy", "ix", r("v"))


@query(f"""WITH {OBS}, a AS (SELECT day, iy, ix, CASE WHEN v <= 150 THEN v END AS v, CASE WHEN n >= 4 THEN 'dense' WHEN n >= 2 THEN 'usual' ELSE 'thin' END AS flag FROM obs)
SELECT day, count(*) AS rows, count(DISTINCT iy) || 'x' || count(DISTINCT ix) AS shape, count(v) AS valid, count(DISTINCT iy) * count(DISTINCT ix) - count(v) AS missing, array_to_string(list_sort(list(DISTINCT flag)), ',') AS flags FROM a GROUP BY day""")
def s8_archive_manifest(spark, sf_dir):
    from skylattice.operators.manifests import map_manifest
    from skylattice.sources.tables import read_archive, write_archive

    flag = F.when(F.col("n") >= 4, "dense").when(F.col("n") >= 2, "usual").otherwise("thin")
    obs, path = b.obs_grid(spark, sf_dir).select("day", "iy", "ix", F.when(F.col("v") <= 150, F.col("v")).alias("v"), F.array(flag).alias("flags")), _folder(spark, "maps")

    def describe(df: DataFrame, partition: str) -> DataFrame:
        return map_manifest(df, partition, ["iy", "ix"], "v", "flags")

    listed = write_archive(obs, path, "day", describe)
    rows, _ = read_archive(spark, path, obs.schema, "day", describe)
    kept = rows.select("day").distinct()
    return listed.join(kept.hint("merge"), "day", "left_semi").select("day", "rows", F.array_join(F.transform("shape", lambda n: n.cast("string")), "x").alias("shape"), "valid", "missing", F.array_join("flags", ",").alias("flags"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS native, o_orderkey // 3 * 3 AS parent, o_custkey AS checksum FROM orders), n AS (SELECT id, checksum FROM m WHERE native AND id % 5 <> 0)
SELECT m.id, CASE WHEN n.id IS NULL THEN 'no_native_parent' ELSE 'checksum_differs' END AS reason FROM m LEFT JOIN n ON n.id = m.parent WHERE NOT m.native AND (n.id IS NULL OR n.checksum % 10 <> m.checksum % 10)""")
def s9_catalogue_lineage(spark, sf_dir):
    from skylattice.sources.tables import catalogue_violations

    o = b.table(spark, sf_dir, "orders")
    native = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 5 != 0)
    m = o.select(F.col("o_orderkey").alias("id"), F.when(native, "native").when(F.col("o_orderkey") % 3 == 0, "native_hidden").otherwise("derived").alias("layout"), F.expr("o_orderkey div 3 * 3").alias("parent"), (F.col("o_custkey") % 10).alias("checksum"), (F.col("o_custkey") % 10).alias("parent_checksum"))
    return catalogue_violations(m.where("layout <> 'native_hidden'"))


@query(f"WITH {OBS} SELECT day, count(*) AS cells, {rs('avg(v)', 'mean_v')} FROM obs GROUP BY day")
def s10_csv_export(spark, sf_dir):
    path = _folder(spark, "csv")
    b.obs_grid(spark, sf_dir).groupBy("day").agg(F.count("*").alias("cells"), F.avg("v").alias("mean_v")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="day bigint, cells bigint, mean_v double").select("day", "cells", r("mean_v"))


@query(f"""WITH {OBS}, l AS (SELECT day, count(DISTINCT lat) AS n_lats, count(DISTINCT lon) AS n_lons, count(*) AS present FROM obs GROUP BY day) SELECT day, n_lats, n_lons, n_lats * n_lons - present AS nulls FROM l""")
def s11_map_payload(spark, sf_dir):
    from skylattice.sources.tables import map_payload

    out = map_payload(b.obs_grid(spark, sf_dir), ["day"], "v")
    nulls = F.aggregate(F.flatten("values"), F.lit(0), lambda s, x: s + F.when(x.isNull(), 1).otherwise(0))
    return out.select("day", F.size("lats").cast("bigint").alias("n_lats"), F.size("lons").cast("bigint").alias("n_lons"), nulls.cast("bigint").alias("nulls"))


@query("""WITH c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE value > 330)
SELECT day, 'COD0OPSFIN_' || year(day) || lpad(CAST(dayofyear(day) AS VARCHAR), 3, '0') || '0000_01D_01H_GIM.INX.gz' AS file, CASE WHEN day IN (SELECT day FROM d) THEN 'recheck' ELSE 'missing' END AS why FROM c WHERE day NOT IN (SELECT day FROM d) OR day > DATE '2024-02-03'""")
def s12_missing_days(spark, sf_dir):
    from skylattice.sources.tables import missing_days, product_calendar

    ledger = b.table(spark, sf_dir, "events").where("value > 330").select(F.to_date("ts").alias("day"))
    return missing_days(product_calendar(spark, "2024-01-01", "2024-02-05"), ledger).select("day", "file", "why")


# --- streaming ---------------------------------------------------------------------------------


#: Batches in which the events come as a stream.
FEEDS = 4


def _events_stream(spark, sf_dir, late: Column | None = None) -> DataFrame:
    """The events as a stream of FEEDS batches in order of time, each of two files that are written after those before.

    The rows that ``late`` names come with the last batch.
    """
    from skylattice.streaming.streams import read_stream

    e = b.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, second = _folder(spark, "stream-in"), F.unix_seconds("ts")
    first, last = e.agg(F.min(second), F.max(second)).first()
    share = F.least(F.lit(FEEDS - 1), F.floor((second - first) * FEEDS / max(1, last - first)))
    if late is not None:
        share = F.when(late, FEEDS - 1).otherwise(share)
    for feed in range(FEEDS):
        e.where(share == feed).repartition(2).write.mode("append").parquet(path)
    return read_stream(spark, path, e.schema, files=2)


def _stream_out(spark) -> tuple[str, str]:
    return _folder(spark, "stream-out"), _folder(spark, "stream-checkpoint")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) + CAST(0 AS DOUBLE) AS total FROM events GROUP BY 1")
def t1_incremental_intake(spark, sf_dir):
    from skylattice.streaming.streams import append_once

    rows = append_once(_events_stream(spark, sf_dir), *_stream_out(spark))
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), r(F.sum("value"), "total", 4))


@query("SELECT count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) AS kept FROM events")
def t2_duplicate_deliveries(spark, sf_dir):
    from skylattice.streaming.streams import deduplicate, run_to_table

    stream = _events_stream(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return run_to_table(deduplicate(stream, "ts", ["user_id", "event_type", "day"], "60 days"), *_stream_out(spark)).agg(F.count("*").alias("kept"))


@query("""WITH w AS (SELECT epoch(time_bucket(INTERVAL 2 HOURS, ts)) AS start, count(*) AS n, avg(value) AS m, median(value) AS d FROM events GROUP BY 1)
SELECT CAST(start AS BIGINT) AS start, n, round(m, 6) + CAST(0 AS DOUBLE) AS mean_v, round(d, 6) + CAST(0 AS DOUBLE) AS median_v FROM w WHERE start + 7200 <= (SELECT epoch(max(ts)) - 86400 FROM events)""")
def t3_tumbling_readout(spark, sf_dir):
    from skylattice.streaming.streams import run_to_table, tumbling_readout

    out = run_to_table(tumbling_readout(_events_stream(spark, sf_dir), "ts", "value", "2 hours", "1 day"), *_stream_out(spark))
    return out.select(F.unix_seconds("start").alias("start"), "n", r("mean_v"), r("median_v"))


@query(f"WITH {OBS}, c AS (SELECT DISTINCT day FROM obs WHERE v > 280) SELECT day, count(*) AS cells, {rs('avg(v)', 'mean_v')} FROM obs WHERE day IN (SELECT day FROM c) OR day - 1 IN (SELECT day FROM c) GROUP BY day")
def t4_late_revisions(spark, sf_dir):
    from skylattice.streaming.streams import rescore_late

    obs = b.obs_grid(spark, sf_dir)
    score = lambda days: obs.join(days, "day", "left_semi").groupBy("day").agg(F.count("*").alias("cells"), r(F.avg("v"), "mean_v"))
    return rescore_late(obs.where("v > 280").select("day"), score, obs.select("day").distinct(), "day")


@query(f"""WITH u AS (SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, user_id, avg(value) AS v FROM events GROUP BY ALL) SELECT day, count(*) AS cells, {rs('avg(v)', 'mean_v')} FROM u GROUP BY day""")
def t4_late_stream(spark, sf_dir):
    from skylattice.streaming.streams import rescore_stream

    out, mark = _stream_out(spark)
    score = lambda rows: rows.groupBy("day", "user_id").agg(F.avg("value").alias("v")).groupBy("day").agg(F.count("*").alias("cells"), F.avg("v").alias("mean_v"))
    scores, _ = rescore_stream(_events_stream(spark, sf_dir, F.col("event_type") == "error"), out, mark, "ts", score)
    return scores.select("day", "cells", r("mean_v"))


@query("""WITH f AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), a AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT event_id, round(f.value, 6) + CAST(0 AS DOUBLE) AS predicted, round(a.value, 6) + CAST(0 AS DOUBLE) AS actual FROM f LEFT JOIN a ON a.user_id = f.user_id AND a.ts BETWEEN f.ts AND f.ts + INTERVAL 6 HOURS
WHERE f.ts < (SELECT max(ts) - INTERVAL 2 DAYS FROM events)""")
def t5_grace_join(spark, sf_dir):
    from skylattice.streaming.streams import forecasts_with_grace, run_to_table

    forecasts = _events_stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("valid_at"), F.col("value").alias("predicted"))
    actuals = _events_stream(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("ts").alias("observed_at"), F.col("value").alias("actual"))
    out = run_to_table(forecasts_with_grace(forecasts, actuals, ["user_id"], "6 hours"), *_stream_out(spark))
    # the last ones still wait for their grace to pass
    closed = b.table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 2 DAYS")).alias("until"))
    return out.join(F.broadcast(closed), F.col("valid_at") < F.col("until")).select("event_id", r("predicted"), r("actual"))


@query(f"""WITH RECURSIVE s AS (SELECT user_id, ts, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), {_fold_sql('user_id', 'ts')}
SELECT user_id, epoch_us(ts) AS t, {rs('forecast', 'forecast')}, {rs('score', 'score')}, false AS late FROM fold""")
def t6_ordered_state(spark, sf_dir):
    from skylattice.streaming.streams import recurrence_stream, run_to_table

    out = run_to_table(recurrence_stream(_events_stream(spark, sf_dir), "user_id", "ts", "value", "1 day"), *_stream_out(spark))
    return out.select("user_id", F.unix_micros("ts").alias("t"), r("forecast"), r("score"), "late")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, avg(value) AS x, count(*) AS c FROM events GROUP BY ALL), closed AS (SELECT CAST(floor((epoch(max(ts)) - 86400) / 86400) AS BIGINT) AS slot FROM events),
p AS (SELECT user_id, unnest(range(min(e.slot), any_value(closed.slot))) AS slot FROM e, closed GROUP BY user_id), s AS (SELECT p.user_id, p.slot, x, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY p.user_id ORDER BY p.slot) AS i FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.slot = p.slot),
fold AS (SELECT user_id, slot, i, x, c, x AS forecast, CAST(0 AS DOUBLE) AS score, 1 AS n, x AS mean, CAST(0 AS DOUBLE) AS m2, CAST(0 AS DOUBLE) AS h FROM s WHERE i = 1
UNION ALL SELECT user_id, slot, i, x, c, mean + scale * h, CASE WHEN x IS NULL THEN NULL WHEN n > 1 THEN abs(x - mean - scale * h) / scale ELSE 0.0 END, CASE WHEN x IS NULL THEN n ELSE n + 1 END, CASE WHEN x IS NULL THEN mean ELSE mean + (x - mean) / (n + 1) END,
  CASE WHEN x IS NULL THEN m2 ELSE m2 + (x - mean) * (x - (mean + (x - mean) / (n + 1))) END, CASE WHEN x IS NULL THEN 0.9 * h ELSE a * h + (1 - a) * tanh(z) END
FROM (SELECT *, 0.9 ** (1 + 0.5 * least(abs(z), 10.0)) AS a FROM (SELECT *, (x - mean) / scale AS z FROM (SELECT s.user_id, s.slot, s.i, s.x, s.c, n, mean, m2, h, CASE WHEN n > 1 THEN greatest(sqrt(m2 / (n - 1)), 1e-6) ELSE 1.0 END AS scale FROM fold JOIN s ON s.i = fold.i + 1 AND s.user_id = fold.user_id))))
SELECT user_id, slot, {rs('x', 'value')}, c AS n, {rs('forecast', 'forecast')}, {rs('score', 'score')}, x IS NULL AS gap, false AS late FROM fold""")
def t6_slot_state(spark, sf_dir):
    from skylattice.streaming.stateful import rocksdb, slot_scores
    from skylattice.streaming.streams import run_to_table

    with rocksdb(spark):
        out = run_to_table(slot_scores(_events_stream(spark, sf_dir), "user_id", "ts", "value", 86400, "1 day"), *_stream_out(spark))
    return out.select("user_id", "slot", r("value"), "n", r("forecast"), r("score"), "gap", "late")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g),
k AS (SELECT user_id, min(ts) AS a, max(ts) AS e, count(*) AS n FROM s GROUP BY user_id, i) SELECT user_id, epoch_us(a) AS start, n FROM k WHERE e + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def t7_sessions(spark, sf_dir):
    from skylattice.streaming.streams import run_to_table, sessions

    out = run_to_table(sessions(_events_stream(spark, sf_dir), ["user_id"], "ts", "12 hours", "1 day"), *_stream_out(spark))
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT d.user_id, d.day, median(p.v) AS m FROM d LEFT JOIN d p ON p.user_id = d.user_id AND p.day BETWEEN d.day - 7 AND d.day - 1 GROUP BY ALL)
SELECT event_id, round(value - m, 6) + CAST(0 AS DOUBLE) AS deviation FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.day = CAST(e.ts AS DATE)""")
def t8_sliding_baseline(spark, sf_dir):
    from skylattice.streaming.streams import against_baseline, run_to_table

    days = b.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    days = joins.same_time_history(days.withColumn("n", F.unix_date("day")).withColumn("slot", F.lit(0)), ["user_id"], "n", "slot", "v", 7)
    baseline = days.select("user_id", "day", joins.array_median("prior").alias("baseline"))
    stream = _events_stream(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return run_to_table(against_baseline(stream, baseline, ["user_id", "day"], "value"), *_stream_out(spark)).select("event_id", r("deviation"))


@query("""WITH e AS (SELECT event_id, user_id % 15 AS iy, CAST(ts AS DATE) AS day, hour(ts) AS h, value FROM events), d AS (SELECT iy, day, h, avg(value) AS v FROM e GROUP BY ALL),
m AS (SELECT d.iy, d.day, d.h, median(p.v) AS m FROM d LEFT JOIN d p ON p.iy = d.iy AND p.h = d.h AND p.day BETWEEN d.day - 7 AND d.day - 1 GROUP BY ALL) SELECT event_id, round(value - m, 6) + CAST(0 AS DOUBLE) AS deviation FROM e JOIN m USING (iy, day, h)""")
def t8_same_hour_stream(spark, sf_dir):
    from skylattice.streaming.streams import against_same_hour

    stream = _events_stream(spark, sf_dir).withColumn("iy", b.cell_row())
    return against_same_hour(stream, *_stream_out(spark), ["iy"], "ts", "value").select("event_id", r("deviation"))


@query("""WITH b AS (SELECT epoch(min(ts)) AS a, epoch(max(ts)) AS z FROM events), e AS (SELECT *, epoch(ts) AS t, CASE WHEN event_type = 'signup' THEN 3 ELSE least(3, CAST(floor((floor(epoch(ts)) - floor(a)) * 4 / greatest(1, floor(z) - floor(a))) AS INT)) END AS feed FROM events, b),
m AS (SELECT feed, count(*) AS read, floor(max(t)) AS latest FROM e GROUP BY feed), p AS (SELECT feed, read, CAST(max(latest) OVER (ORDER BY feed) AS BIGINT) AS latest, max(latest) OVER (ORDER BY feed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m),
r AS (SELECT e.feed, coalesce(floor(t) < reached - 86400, false) AS late, coalesce(value > 200 OR event_type = 'error', false) AS bad FROM e JOIN p ON p.feed = e.feed)
SELECT CAST(r.feed AS BIGINT) AS batch, count(*) AS read, count(*) FILTER (NOT late AND NOT bad) AS kept, count(*) FILTER (late) AS late, count(*) FILTER (bad AND NOT late) AS refused, any_value(p.latest) AS latest FROM r JOIN p ON p.feed = r.feed GROUP BY r.feed""")
def t9_intake_counts(spark, sf_dir):
    from skylattice.streaming.streams import counted_intake

    rules = {"value_too_large": F.col("value") <= 200, "error_event": F.col("event_type") != "error"}
    _, _, counts = counted_intake(_events_stream(spark, sf_dir, F.col("event_type") == "signup"), rules, *_stream_out(spark), "ts", 86400)
    return counts


@query("SELECT coalesce(CASE WHEN value > 200 THEN 'value_too_large' WHEN event_type = 'error' THEN 'error_event' END, 'kept') AS outcome, count(*) AS n FROM events GROUP BY 1")
def t9_rejects(spark, sf_dir):
    from skylattice.streaming.streams import split_rejects

    rules = {"value_too_large": F.col("value") <= 200, "error_event": F.col("event_type") != "error"}
    good, bad = split_rejects(_events_stream(spark, sf_dir), rules, *_stream_out(spark))
    return good.select(F.lit("kept").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
