"""Exact deduplication over an extendible-hash index, in DataFrame operations only.

The hash of a text is its index key. A directory over the top bits of the keys doubles, from one bucket,
until no bucket holds more than ``capacity`` index rows; its depth follows the number of rows. The index
is a table in the shared folder, sorted and dealt out by ranges of buckets. Whoever looks a key up goes
through the directory: its slot gives the bucket, and owner tasks join the rows of a bucket by key. Texts
that meet under one key are chained: their bytes are compared with those of the row that stays, and
where bytes differ the key's texts are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import SPACE_CHARS, written


#: A directory has 2**MAX_DEPTH slots at most (for 10**11 keys), and is broadcast up to 2**BROADCAST_DEPTH.
MAX_DEPTH, BROADCAST_DEPTH = 24, 14


def _normal(text_col: str):
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE_CHARS, "")


def directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """slot (top ``max_depth`` bits) -> bucket, for a table with a column ``h``.

    A bucket at depth d is split in two while it holds more than ``capacity`` rows.
    """
    slots = keys.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("slot")).agg(F.count("*").alias("n"))
    depths = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("depth"))
    depths = depths.withColumn("cell", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    full = depths.groupBy("depth", "cell").agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
    local = depths.join(full.hint("merge"), ["depth", "cell"]).groupBy("slot").agg((F.max("depth") + 1).alias("local_depth"))
    local = slots.select("slot").join(local.hint("merge"), "slot", "left").withColumn("local_depth", F.coalesce("local_depth", F.lit(0)))
    # a bucket is named by its first slot, so that ranges of buckets are ranges of keys
    return local.select("slot", "local_depth", F.expr(f"shiftleft(shiftright(slot, {max_depth} - local_depth), {max_depth} - local_depth)").alias("bucket"))


def depth_for(rows: int, capacity: int) -> int:
    """Bits that a directory needs for so many rows: sixteen times as many slots as full buckets, for uneven keys."""
    return min(MAX_DEPTH, 4 + max(0, (max(1, rows) - 1) // capacity).bit_length())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = 100_000, max_depth: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks, tabs, line feeds, vertical tabs, form feeds and
    returns. Of equal texts the row with the most code points stays, then that with the smallest id.
    A null text counts as empty, and all empty texts are equal. Rows that repeat an id share its
    fate: both are kept or neither. An empty table gives an empty result; other columns are ignored.
    ``key_bits`` under 64 shortens the index keys, to provoke collisions in tests.
    """
    key = F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits) if key_bits < 64 else F.xxhash64("norm")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _normal(text_col).alias("norm")).withColumn("h", key)
    entries = written(texts.select("doc_id", "h", F.char_length("text").alias("size"), F.sha2("norm", 256).alias("text_sha256")), "exact-entries")

    best = F.max(F.struct(F.col("size"), (-F.col("doc_id")).alias("neg_id"))).alias("best")
    found = written(entries.groupBy("h").agg(best, F.count("*").alias("group_size")), "exact-keys")
    depth = max_depth or depth_for(found.count(), capacity)
    slots = written(directory(found, capacity, depth).select("slot", "bucket"), "exact-directory")
    held = F.broadcast(slots) if depth <= BROADCAST_DEPTH else slots.hint("merge")

    def located(rows: DataFrame) -> DataFrame:
        """The rows with the bucket that the directory names for their key."""
        return rows.withColumn("slot", F.shiftrightunsigned("h", 64 - depth)).join(held, "slot").drop("slot")

    rows = located(found).select("bucket", "h", (-F.col("best.neg_id")).alias("keep_id"), "group_size")
    index = written(rows.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "exact-index")
    owner = ["bucket", "h"]

    chained = index.where("group_size > 1").select(*owner, "keep_id")
    members = located(texts.select("h", "doc_id", F.char_length("text").alias("size"), "norm")).join(chained.hint("merge"), owner)
    members = written(members, "exact-members")
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*owner).agg(F.min("norm").alias("stay_norm"))
    clashes = written(members.join(stays.hint("merge"), owner).where("norm <> stay_norm").groupBy(*owner).agg(F.count("*").alias("n")), "exact-clashes")

    looked = located(entries)
    plain = index.select(*owner, "keep_id", "group_size")
    if clashes.isEmpty():
        out = looked.join(plain.hint("merge"), owner)
    else:
        apart = members.join(clashes.select(*owner).hint("merge"), owner, "left_semi").groupBy(*owner, "norm").agg(best, F.count("*").alias("group_size"))
        apart = apart.select(*owner, F.sha2("norm", 256).alias("text_sha256"), (-F.col("best.neg_id")).alias("keep_id"), "group_size")
        clear = looked.join(clashes.select(*owner).hint("merge"), owner, "left_anti").join(plain.hint("merge"), owner)
        chain = looked.join(apart.hint("merge"), [*owner, "text_sha256"])
        out = clear.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(chain.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns as they were.

    Null and empty texts are copies of each other; a row without an id goes only if all rows of its text
    with the most code points have ids and it is none of them. An empty table stays empty.
    """
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
