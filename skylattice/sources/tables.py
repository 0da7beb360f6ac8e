"""Other sources and sinks: context series, archives with manifests, catalogue, exports, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geo import in_bounds
from skylattice.operators.manifests import snapshot_manifest, verify_manifest
from skylattice.operators.revisions import as_of


def read_series(obs: DataFrame, keys: list[str], at: str, start: Column, end: Column, instant: Column, bounds: tuple[float, float, float, float] | None, available: str = "ingested_at") -> DataFrame:
    """A window of a series as known at ``instant``: rows in [start, end] not after it, best revisions, cropped, in order."""
    window = obs.where((F.col(at) >= start) & (F.col(at) <= F.least(end, instant)))
    if bounds:
        window = window.where(in_bounds(F.col("lat"), F.col("lon"), *bounds))
    return as_of(window, [*keys, at], instant, [available]).orderBy(*keys, at)


def read_overlapping(obs: DataFrame, manifest: DataFrame, source: str, start: Column, end: Column) -> DataFrame:
    """Rows of the sources whose [first, last] meets [start, end]; the manifest is filtered first, rows follow by semi-join."""
    return obs.join(manifest.where((F.col("last") >= start) & (F.col("first") <= end)).select(source), source, "left_semi")


def context_series(texts: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Context values (time, kp) of texts (source, text): a JSON array of objects, or a table with a header row.

    Rows out of 0..9, without a time, or in the future are rejects; a text that gives one time two
    values is refused as a whole.
    """
    objects = F.from_json("text", "array<struct<time_tag: string, Kp: double>>")
    table = F.from_json("text", "array<array<string>>")
    is_table = F.trim(F.col("text")).rlike(r"^\[\s*\[")
    head = F.get(F.col("_t"), 0)
    from_table = F.transform(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda row: F.struct(F.get(row, F.array_position(head, "time_tag").cast("int") - 1).alias("time_tag"), F.get(row, F.array_position(head, "Kp").cast("int") - 1).try_cast("double").alias("Kp")))
    parsed = texts.withColumn("_t", F.when(is_table, table)).withColumn("_rows", F.when(is_table, from_table).otherwise(F.when(~is_table, objects)))
    rows = parsed.select("source", F.explode_outer("_rows").alias("row")).select("source", F.expr("try_to_timestamp(row.time_tag)").alias("time"), F.col("row.Kp").alias("kp"))
    reason = F.when(F.col("time").isNull(), "no_time").when(F.col("kp").isNull() | ~F.col("kp").between(0, 9), "kp_out_of_range")
    if now is not None:
        reason = reason.when(F.col("time") > now, "in_the_future")
    judged = rows.withColumn("reason", reason)
    torn = judged.where("reason IS NULL").groupBy("source", "time").agg(F.count_distinct("kp").alias("_n")).where("_n > 1").select("source").distinct().withColumn("_torn", F.lit(True))
    judged = judged.join(torn.hint("merge"), "source", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_torn"), "conflicting_values"))).drop("_torn")
    return judged.where("reason IS NULL").select("source", "time", "kp").distinct(), judged.where("reason IS NOT NULL").select("source", "time", "kp", "reason")


def write_archive(df: DataFrame, path: str, partition: str, describe=snapshot_manifest) -> DataFrame:
    """A Parquet archive by ``partition``, one sorted run a partition; returns its manifest, written last beside it.

    ``describe`` (table, partition) makes the manifest: rows and content, or with :func:`map_manifest` also shape, counts and flags.
    """
    df.repartition(partition).sortWithinPartitions(partition).write.partitionBy(partition).parquet(f"{path}/data")
    manifest = describe(df, partition)
    manifest.write.parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def read_archive(spark: SparkSession, path: str, schema, partition: str, describe=snapshot_manifest) -> tuple[DataFrame, DataFrame]:
    """Rows of the partitions that agree with the manifest in all ``describe`` says, and the refused ones with a reason."""
    data = spark.read.schema(schema).parquet(f"{path}/data").select(*[f.name for f in schema])
    refused = verify_manifest(data, spark.read.parquet(f"{path}/manifest"), partition, describe)
    return data.join(refused.hint("merge"), partition, "left_anti"), refused


def catalogue_violations(manifests: DataFrame) -> DataFrame:
    """Derived manifests (id, layout, parent, checksum, parent_checksum) without a native parent of equal checksum."""
    native = manifests.where("layout = 'native'").select(F.col("id").alias("_id"), F.col("checksum").alias("_sum"))
    derived = manifests.where("layout <> 'native'").join(native, F.col("parent") == F.col("_id"), "left")
    reason = F.when(F.col("_id").isNull(), "no_native_parent").when(F.col("_sum") != F.col("parent_checksum"), "checksum_differs")
    return derived.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")


def map_payload(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a map: latitude axis, longitude axis, values row by row with nulls for what is missing."""
    lats = df.groupBy(*keys).agg(F.array_sort(F.collect_set("lat")).alias("lats"), F.array_sort(F.collect_set("lon")).alias("lons"))
    cells = df.select(*keys, "lat", "lon", value).join(lats, keys)
    rows = cells.groupBy(*keys, "lat", "lats", "lons").agg(F.map_from_entries(F.collect_list(F.struct("lon", value))).alias("_m"))
    rows = rows.select(*keys, "lat", "lats", "lons", F.transform("lons", lambda x: F.try_element_at("_m", x)).alias("_row"))
    out = rows.groupBy(*keys, "lats", "lons").agg(F.array_sort(F.collect_list(F.struct("lat", F.col("_row").alias("row")))).alias("_r"))
    return out.select(*keys, "lats", "lons", F.transform("_r", lambda x: x["row"]).alias("values"))


def product_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day with the file name expected for it: short names before 2022-11-26, long ones from then on."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    doy = F.lpad(F.dayofyear("day").cast("string"), 3, "0")
    short = F.concat(F.lit("CODG"), doy, F.lit("0."), F.date_format("day", "yy"), F.lit("I.Z"))
    long = F.concat(F.lit("COD0OPSFIN_"), F.year("day").cast("string"), doy, F.lit("0000_01D_01H_GIM.INX.gz"))
    return days.withColumn("file", F.when(F.col("day") < F.lit("2022-11-26").cast("date"), short).otherwise(long))


def missing_days(calendar: DataFrame, ledger: DataFrame, recheck: int = 2) -> DataFrame:
    """Days to fetch: those without a usable product, and the last ``recheck`` days at any rate."""
    last = calendar.agg(F.max("day").alias("_last"))
    gone = calendar.join(ledger.select("day").distinct().hint("merge"), "day", "left_anti").withColumn("why", F.lit("missing"))
    recent = calendar.join(F.broadcast(last)).where(F.date_diff("_last", "day") < recheck).drop("_last").join(gone.select("day").hint("merge"), "day", "left_anti").withColumn("why", F.lit("recheck"))
    return gone.unionByName(recent)
