"""Choosing among revisions: best, as of an instant, latest, chain tips, conflicts, idempotent inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; planned with a group limit before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def best_revision(df: DataFrame, keys: list[str], priority: str = "revision_priority", ingested: str = "ingested_at", artifact: str = "artifact_id") -> DataFrame:
    """Highest priority, then latest ingestion, then largest id."""
    return best(df, keys, [F.desc(priority), F.desc(ingested), F.desc(artifact)])


def as_of(df: DataFrame, keys: list[str], instant: Column, available: list[str], **order: str) -> DataFrame:
    """Best revision among the rows that were available at ``instant``."""
    for column in available:
        df = df.where(F.col(column) <= instant)
    return best_revision(df, keys, **order)


def last_n(df: DataFrame, keys: list[str], at: str, n: int) -> DataFrame:
    """The last ``n`` rows of each series, ascending."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at))))
    return ranked.where(F.col("_rank") <= n).drop("_rank").orderBy(*keys, at)


def latest_publication(df: DataFrame, keys: list[str], number: str, cursor: int | None = None) -> DataFrame:
    """The row with the largest publication number of each key, up to a cursor if given; partial sums before the shuffle."""
    if cursor is not None:
        df = df.where(F.col(number) <= cursor)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(number)).alias("_row")).select(*keys, "_row.*")


def chain_tips(df: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = df.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_gone")).distinct()
    return df.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def frame_conflicts(df: DataFrame, key: str, frame: str, cell: list[str], value: str, available: str | None = None) -> DataFrame:
    """Frames for one instant: the latest available one wins; those equally late must agree.

    Returns key, the winning frame, its content hash, the number of rivals and ``conflict``. The hash
    is a sum over rows, so it doesn't depend on their order.
    """
    content = F.sum(F.xxhash64(*cell, value).cast("decimal(38,0)")).alias("content")
    late = F.max(available).alias("_late") if available else F.lit(0).alias("_late")
    frames = df.groupBy(key, frame).agg(content, late)
    newest = frames.groupBy(key).agg(F.max("_late").alias("_newest"))
    rivals = frames.join(newest, key).where(F.col("_late").eqNullSafe(F.col("_newest")))
    return rivals.groupBy(key).agg(F.max(frame).alias("frame"), F.count("*").alias("rivals"), (F.count_distinct("content") > 1).alias("conflict"))


def split_inserts(new: DataFrame, held: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each new row with its outcome against an immutable table: insert, same or conflict."""
    content = lambda: F.xxhash64(*values)
    old = held.select(*[F.col(k).alias(f"_{k}") for k in keys], content().alias("_old"), F.lit(True).alias("_there"))
    joined = new.withColumn("_new", content()).join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    outcome = F.when(F.col("_there").isNull(), "insert").when(F.col("_new").eqNullSafe(F.col("_old")), "same").otherwise("conflict")
    return joined.withColumn("outcome", outcome).select(*new.columns, "outcome")


def unseen(new: DataFrame, held: DataFrame, identity: list[str]) -> DataFrame:
    """New rows whose identity (nulls equal) is not held yet."""
    known = held.select(*[F.col(c).alias(f"_{c}") for c in identity]).distinct()
    return new.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity], "left_anti")
