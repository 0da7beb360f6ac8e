"""Views of the driver's tables in the shape of the engine's tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The grid has this many rows and, around the earth, columns; every user falls into one of its cells.
ROWS, RING = 15, 100


def obs_grid(spark: SparkSession, sf_dir: str, hours: int = 24) -> DataFrame:
    """Cells (iy, ix) with latitude and longitude, epochs (seconds) of ``hours``, mean value v and number of readings n."""
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    epoch = day * 86400 + F.expr(f"hour(ts) div {hours}") * (hours * 3600)
    cells = table(spark, sf_dir, "events").select(cell_row().alias("iy"), cell_column().alias("ix"), day.alias("day"), epoch.alias("epoch"), "value")
    grouped = cells.groupBy("day", "epoch", "iy", "ix").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return grouped.select("day", "epoch", "iy", "ix", (F.col("iy") * 2.5 - 17.5).alias("lat"), F.round(F.col("ix") * 3.6 - 180, 10).alias("lon"), "v", "n")


def cell_row() -> Column:
    return (F.col("user_id") % ROWS).cast("int")


def cell_column() -> Column:
    return F.expr(f"user_id div {ROWS} % {RING}").cast("int")


def axes() -> tuple[list[float], list[float]]:
    """Latitudes and longitudes of the grid."""
    return [i * 2.5 - 17.5 for i in range(ROWS)], [round(i * 3.6 - 180, 10) for i in range(RING)]


def obs_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of a reading for each series (user) and day: priority from the event type, ingestion time, id."""
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), F.to_date("ts").alias("day"), F.array_position(kinds, F.col("event_type")).cast("int").alias("revision_priority"),
        F.col("ts").cast("timestamp").alias("ingested_at"), F.col("event_id").alias("artifact_id"), F.array("event_type").alias("flags"), "value",
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day: mean and median of the readings, coverage (readings over 1.25 times the most on a day)."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"))
    return days.agg(F.avg("value").alias("mean_v"), F.median("value").alias("median_v"), F.count("*").alias("n"))


#: Event types in order of revision priority.
EVENT_TYPES = ("error", "view", "click", "signup", "purchase")

def obs_sql(hours: int = 24) -> str:
    day = "CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)"
    return f"""obs AS (
  SELECT {day} AS day, {day} * 86400 + (hour(ts) // {hours}) * {hours * 3600} AS epoch, CAST(user_id % 15 AS INT) AS iy, CAST(user_id // 15 % {RING} AS INT) AS ix,
         CAST((user_id % 15) * 2.5 - 17.5 AS DOUBLE) AS lat, CAST(round((user_id // 15 % {RING}) * 3.6 - 180, 10) AS DOUBLE) AS lon, avg(value) AS v, count(*) AS n
  FROM events GROUP BY ALL)"""


REV_SQL = """rev AS (
  SELECT user_id AS series, CAST(ts AS DATE) AS day, CAST(list_position(['error','view','click','signup','purchase'], event_type) AS INT) AS revision_priority,
         ts AS ingested_at, event_id AS artifact_id, event_type, value FROM events)"""
SERIES_SQL = """ser AS (
  SELECT CAST(ts AS DATE) AS day, avg(value) AS mean_v, median(value) AS median_v, count(*) AS n FROM events GROUP BY 1)"""

