"""Content hashes of tables and splits: independent of row order and of layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_manifest(df: DataFrame, partition: str, extra: list[Column] | None = None) -> DataFrame:
    """Rows and content hash of each partition; the hash is a sum over rows, added up before the shuffle. ``extra`` aggregates follow."""
    columns = sorted(df.columns)
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    out = df.groupBy(partition).agg(F.count("*").alias("rows"), F.sum(row).alias("_sum"), *(extra or []))
    return out.withColumn("content", F.sha2(F.concat_ws(":", F.lit(",".join(columns)), "rows", "_sum"), 256)).select(partition, "rows", "content", *out.columns[3:])


def map_manifest(df: DataFrame, partition: str, axes: list[str], value: str, flags: str | None = None) -> DataFrame:
    """Manifest of maps: rows, content, shape (steps on each axis), valid and missing cells of that shape, and all flags in order.

    A cell is valid with a finite value; the cells of the shape without one are missing, rows for them or not. Axes
    are those of a grid, so their values are few. Null flags count as none.
    """
    shape = F.array(*[F.size(F.collect_set(a)) for a in axes])
    number = F.abs(F.col(value).cast("double"))
    valid = F.count_if(number.isNotNull() & ~F.isnan(number) & (number < float("inf")))
    marks = F.array_sort(F.array_distinct(F.flatten(F.collect_set(flags)))) if flags else F.array().cast("array<string>")
    out = snapshot_manifest(df, partition, [shape.alias("shape"), valid.alias("valid"), marks.alias("flags")])
    cells = F.aggregate("shape", F.lit(1).cast("bigint"), lambda n, side: n * side)
    return out.withColumn("missing", cells - F.col("valid")).select(partition, "rows", "content", "shape", "valid", "missing", "flags")


def verify_manifest(df: DataFrame, manifest: DataFrame, partition: str, describe=snapshot_manifest) -> DataFrame:
    """Partitions whose content differs from the manifest's, is missing, or is not listed.

    ``describe`` makes the manifest anew. Of a map manifest, shape, counts and flags are compared first, so
    that the reason says what differs: shape_differs, counts_differ, flags_differ, else differs.
    """
    now = describe(df, partition)
    now = now.select(partition, *[F.col(c).alias(f"_{c}") for c in now.columns if c != partition])
    both = manifest.join(now.hint("merge"), partition, "full_outer")
    reason = F.when(F.col("_content").isNull(), "missing").when(F.col("content").isNull(), "unlisted")
    for name, parts in (("shape_differs", ["shape"]), ("counts_differ", ["rows", "valid", "missing"]), ("flags_differ", ["flags"])):
        for part in parts if "shape" in manifest.columns else []:
            reason = reason.when(~F.col(part).eqNullSafe(F.col(f"_{part}")), name)
    reason = reason.when((F.col("content") != F.col("_content")) | (F.col("rows") != F.col("_rows")), "differs")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select(partition, "reason")


def split_contract(days: DataFrame, part: str, day: str) -> DataFrame:
    """Days of each part, and whether it begins after the part before it has ended."""
    spans = days.groupBy(part).agg(F.min(day).alias("_a"), F.max(day).alias("_b"), F.count("*").alias("days"))
    before = F.lag("_b").over(Window.orderBy("_a"))  # a handful of parts
    return spans.select(part, "days", (before.isNull() | (before < F.col("_a"))).alias("in_order"))


def shared_content(rows: DataFrame, part: str, content: str) -> DataFrame:
    """Content hashes that occur in more than one part."""
    return rows.groupBy(content).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def ordered_hash(df: DataFrame, part: str, order: str, text: Column) -> DataFrame:
    """sha256 of a part's texts in order. A part lists days, so it is small."""
    listed = df.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("_t")))).alias("_l"), F.count("*").alias("days"))
    return listed.select(part, F.sha2(F.array_join(F.transform("_l", lambda x: x["_t"]), ","), 256).alias("manifest"), "days")
