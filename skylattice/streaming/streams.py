"""Structured Streaming forms of the incremental operators. Sources are folders of Parquet files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skylattice.operators.joins import array_median, changed_and_next, same_time_history
from skylattice.operators.timeseries import fold_rows
from skylattice.streaming.buckets import BUCKETS, bucket, grown, joined, key_text, placed


def read_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """A stream of the files in a folder, ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)


def append_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a table keyed by batch: a batch that is retried overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet sink."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def deduplicate(stream: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Drops deliveries that repeat keys within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_readout(stream: DataFrame, at: str, value: str, width: str, delay: str) -> DataFrame:
    """Count, mean and exact median of each window, given out once the watermark has passed it."""
    windows = stream.withWatermark(at, delay).groupBy(F.window(at, width))
    return windows.agg(F.count("*").alias("n"), F.avg(value).alias("mean_v"), F.median(value).alias("median_v")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean_v", "median_v")


def forecasts_with_grace(forecasts: DataFrame, actuals: DataFrame, keys: list[str], grace: str) -> DataFrame:
    """Stream-stream left join of forecasts (valid_at) with actuals (observed_at): unmatched ones come out after the grace."""
    left = forecasts.withWatermark("valid_at", grace)
    right = actuals.withWatermark("observed_at", grace).select(*[F.col(k).alias(f"_{k}") for k in keys], "observed_at", "actual")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    condition = (F.col("observed_at") >= F.col("valid_at")) & (F.col("observed_at") <= F.col("valid_at") + F.expr(f"INTERVAL {grace}"))
    for c in same:
        condition = condition & c
    return left.join(right, condition, "left").drop(*[f"_{k}" for k in keys])


_NEVER, _UNDATED = -(1 << 63), (1 << 63) - 1


def recurrence_stream(stream: DataFrame, key: str, at: str, value: str, delay: str, decay: float = 0.9, gain: float = 0.5, buckets: int = BUCKETS) -> DataFrame:
    """Scores rows before they are seen, with one small state a key; each batch's rows are taken in order of time.

    Rows that arrive after later ones of their key were scored come back with late = true and no score. A batch's rows
    without an instant are its last. The states of the keys of one of ``buckets`` buckets are kept together, and their
    rows are folded side by side (:mod:`skylattice.streaming.buckets`).
    """
    import pandas as pd

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, *before, last = state.get if state.exists else ([], [], [], [], [], [])
        frame = joined(frames)
        keys, place = placed(list(keys), frame["key"])
        held = {c: grown(v, len(keys), 0, t) for c, v, t in zip(("n", "mean", "m2", "h"), before, (np.int64, float, float, float), strict=True)}
        last = grown(last, len(keys), _NEVER, np.int64)
        order = np.lexsort((frame["us"].to_numpy(np.int64), place))
        frame, place = frame.iloc[order], place[order]
        us, x = frame["us"].to_numpy(np.int64), frame["v"].to_numpy(float)
        late = us < last[place]
        forecast, score = np.full(len(x), np.nan), np.full(len(x), np.nan)
        forecast[~late], score[~late] = fold_rows(held, place[~late], x[~late], decay, gain)
        dated = us != _UNDATED
        np.maximum.at(last, place[dated], us[dated])
        state.update((keys, *(a.tolist() for a in held.values()), last.tolist()))
        yield pd.DataFrame({"key": frame["key"].to_numpy(), "us": us, "v": x, "forecast": forecast, "score": score, "late": late})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.withWatermark(at, delay).select(bucket(key, buckets).alias("bucket"), key_text(key).alias("key"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(_UNDATED)).alias("us"), F.col(value).cast("double").alias("v"))
    state = "keys array<string>, n array<bigint>, mean array<double>, m2 array<double>, h array<double>, last array<bigint>"
    out = rows.groupBy("bucket").applyInPandasWithState(fold, "key string, us bigint, v double, forecast double, score double, late boolean", state, "append", GroupStateTimeout.NoTimeout)
    instant = F.when(F.col("us") != _UNDATED, F.timestamp_micros("us")).cast(kinds[at])
    return out.select(F.col("key").cast(kinds[key]).alias(key), instant.alias(at), F.col("v").alias(value), "forecast", "score", "late")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str) -> DataFrame:
    """Runs of rows of a key with no gap of ``gap`` or more."""
    out = stream.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def against_baseline(stream: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows beside a static baseline table of their key, refreshed between runs."""
    return stream.join(baseline, keys, "left").withColumn("deviation", F.col(value) - F.col("baseline"))


_DAY, _BATCH = "_day", "_batch"


def _day_of(at: str):
    return F.unix_date(F.to_date(at)).cast("bigint")


class Arrivals:
    """What has arrived, kept by day and batch: a batch writes and reads the folders of the days that it touches alone.

    A batch that is retried overwrites its own folders. Rows without an instant stand under no day and are
    kept apart, in :attr:`undated`.
    """

    def __init__(self, spark: SparkSession, path: str, schema, at: str):
        self.spark, self.path, self.schema, self.at = spark, f"{path}/arrived", schema, at
        self.undated = f"{path}/undated"

    def add(self, batch: DataFrame, number: int) -> list[int]:
        """Keeps a batch; returns the days that it touches, a short list whatever its rows."""
        batch.where(F.col(self.at).isNull()).write.mode("overwrite").parquet(f"{self.undated}/batch={number}")
        rows = batch.where(F.col(self.at).isNotNull()).withColumn(_DAY, _day_of(self.at)).withColumn(_BATCH, F.lit(number))
        rows.repartition(_DAY, F.pmod(F.xxhash64(*batch.columns), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_DAY, _BATCH).parquet(self.path)
        return sorted(r[0] for r in rows.select(_DAY).distinct().collect())

    def of(self, days) -> DataFrame:
        """All rows of some days that have arrived by now; no other day's folder is listed or read."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [p for d in sorted(set(days)) if files.exists(jvm.org.apache.hadoop.fs.Path(p := f"{self.path}/{_DAY}={d}"))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        kinds = StructType([*self.schema.fields, StructField(_DAY, LongType()), StructField(_BATCH, LongType())])
        rows = self.spark.read.schema(kinds).option("basePath", self.path).parquet(*paths)
        return rows.drop(_DAY, _BATCH)


def _latest_day(spark: SparkSession, path: str, number: int, days: list[int]) -> int | None:
    """The latest day up to this batch, handed on from batch to batch in one row each."""
    known = list(days)
    if number > 0:
        known += [r[0] for r in spark.read.schema("day bigint").parquet(f"{path}/latest/batch={number - 1}").collect() if r[0] is not None]
    latest = max(known, default=None)
    spark.createDataFrame([(latest,)], "day bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/latest/batch={number}")
    return latest


def _run(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> SparkSession:
    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession


def against_same_hour(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str, value: str, days: int = 7) -> DataFrame:
    """Each batch's rows beside a sliding baseline, made anew for the batch from what has arrived by then.

    The baseline is the median, over the ``days`` days before, of a key's daily means at the same hour; null
    where there is none. Only the folders of the days that a batch looks back to are read.
    """
    arrivals = Arrivals(stream.sparkSession, path, stream.schema, at)

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        touched = arrivals.add(batch, number)
        recent = arrivals.of(d - back for d in touched for back in range(days + 1))
        day, hour = F.unix_date(F.to_date(at)), F.hour(at)
        means = recent.groupBy(*keys, day.alias("_d"), hour.alias("_hour")).agg(F.avg(value).alias("_v"))
        base = same_time_history(means, keys, "_d", "_hour", "_v", days).select(*keys, "_d", "_hour", array_median("prior").alias("baseline"))
        out = batch.withColumn("_d", day).withColumn("_hour", hour).join(base.hint("merge"), [*keys, "_d", "_hour"], "left").drop("_d", "_hour")
        out.withColumn("deviation", F.col(value) - F.col("baseline")).write.mode("overwrite").parquet(f"{path}/judged/batch={number}")
        batch.unpersist()

    return _run(stream, save, checkpoint).read.option("recursiveFileLookup", "true").parquet(f"{path}/judged")


def rescore_stream(stream: DataFrame, path: str, checkpoint: str, at: str, score: Callable[[DataFrame], DataFrame], overlap: int = 30) -> tuple[DataFrame, DataFrame]:
    """Late and revised rows in a stream: the days of each batch, and the day after each, are scored again.

    ``score`` takes rows with ``day`` (days since 1970) and gives one row a day; it gets all rows of these
    days that have arrived, from the folders of these days alone. The last score of a day counts. Days more than
    ``overlap`` before the latest one are not scored again; they come back in a second table, for :func:`rescore_late`.
    """
    arrivals = Arrivals(stream.sparkSession, path, stream.schema, at)

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = arrivals.add(batch, number)
        latest = _latest_day(spark, path, number, touched)
        beyond = [d for d in touched if d < latest - overlap]
        spark.createDataFrame([(d,) for d in beyond], "day bigint").write.mode("overwrite").parquet(f"{path}/beyond/batch={number}")
        changed = {d + k for d in touched if d >= latest - overlap for k in (0, 1)}
        again = arrivals.of(changed).withColumn("day", _day_of(at))
        score(again).withColumn("run", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    spark = _run(stream, save, checkpoint)
    read = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
    scores = read("scores")
    last = scores.groupBy("day").agg(F.max_by(F.struct(*[c for c in scores.columns if c not in ("day", "run")]), "run").alias("_s")).select("day", "_s.*")
    return last, read("beyond").distinct()


def counted_intake(stream: DataFrame, rules: dict, path: str, checkpoint: str, at: str, delay_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, refused or late rows with their reason, and what became of each batch's rows.

    A row is late if it lies more than ``delay_seconds`` before the latest instant of the batches before
    its own; else the first rule that fails is its reason. Counts are observed while the batch is written, not
    counted anew, and stand beside it: batch, read, kept, late, refused, and the latest instant so far. A batch that is
    retried overwrites its rows and counts, so each row counts once.
    """
    second = F.unix_seconds(at)

    def before(spark: SparkSession, number: int) -> int | None:
        return spark.read.schema(_COUNTS).parquet(f"{path}/counts/batch={number - 1}").first()["latest"] if number else None

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        reached = before(spark, number)
        reason = F.lit(None).cast("string")
        for name, ok in reversed(rules.items()):
            reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
        late = second < F.lit(None if reached is None else reached - delay_seconds).cast("bigint")
        judged = batch.withColumn("reason", F.when(F.coalesce(late, F.lit(False)), "late").otherwise(reason))
        seen = Observation(f"intake-{number}")
        is_late = F.coalesce(F.col("reason") == "late", F.lit(False))
        counts = [F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(is_late).alias("late"), F.count_if(F.col("reason").isNotNull() & ~is_late).alias("refused"), F.max(second).alias("latest")]
        judged.observe(seen, *counts).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        got = seen.get
        latest = max((x for x in (reached, got["latest"]) if x is not None), default=None)
        spark.createDataFrame([(number, got["read"], got["kept"], got["late"], got["refused"], latest)], _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    spark = _run(stream, save, checkpoint)
    look = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
    rows = look("rows", StructType([*stream.schema.fields, StructField("reason", StringType())]))
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL"), look("counts", _COUNTS)


_COUNTS = "batch bigint, read bigint, kept bigint, late bigint, refused bigint, latest bigint"


def split_rejects(stream: DataFrame, rules: dict, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects (with the first rule that failed) in two tables; nothing is dropped silently."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    judged = append_once(stream.withColumn("reason", reason), path, checkpoint)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def rescore_late(changed_days: DataFrame, score: Callable[[DataFrame], DataFrame], days: DataFrame, day: str) -> DataFrame:
    """Revisions beyond the watermark: changed days and the day after each are scored again in batch."""
    return score(changed_and_next(days, changed_days, day))
