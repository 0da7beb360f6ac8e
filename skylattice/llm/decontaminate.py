"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask of MASKS tells which of SPAN consecutive words a seed hashes; the others may differ. Whatever
words are substituted in an aligned window that still counts, some mask hits it. An item under SPAN
words is one seed of all its words. Seeds of the benchmark items and of the documents are joined, and
around each hit the document's words are laid beside the item's: the pair counts if enough words of some
aligned window agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import SPACE_CHARS, written

#: Positions that count, of 11 words; each mask keeps 6. A test enumerates what WINDOW and AGREE accept.
MASKS = ("11001010011", "11010001101", "00101111100", "11110100010", "00011011110", "00100101111", "00111110001")
SPAN = 11
#: A window of so many aligned words (fewer where the item or the document ends), and the part that must agree.
WINDOW, AGREE = 20, 0.8
#: Up to so many seeds are broadcast (16 bytes each and a little more); beyond, seeds are joined by a shuffle.
BROADCAST_SEEDS = 500_000
#: Up to so many ids of documents with hits are broadcast; beyond, texts are joined with them by a shuffle.
BROADCAST_IDS = 1_000_000


def _words(text: Column) -> Column:
    text = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE_CHARS))
    return F.split(text, "[\\x20\\x09-\\x0D]+")


def _seeds(df: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """The rows of ``df`` (with ``words``) for each place and mask: ``place``, ``seed``.

    A row after the explode holds the hashes of its own words alone, so work is linear in the text.
    """
    span = max(map(len, masks))
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    shifted = [F.slice("_h", i + 1, F.greatest(F.size("_h") - i, F.lit(0))).alias(f"h{i}") for i in range(span)]
    at = hashed.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("place", "w"))
    seeds = []
    for mask in masks:
        seed = F.xxhash64(F.lit(int("1" + mask, 2)), *(F.col(f"w.h{i}") for i, bit in enumerate(mask) if bit == "1"))
        seeds.append(F.when(F.col(f"w.h{len(mask) - 1}").isNotNull(), seed))  # else the text ends within the mask
    return at.select(*keep, "place", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def _best_window() -> tuple[Column, Column]:
    """Which of the aligned words ``a`` (document) and ``b`` (item) agree, and how many do in the best window."""
    flags = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("flags") - F.col("span") + 1)),
        lambda i: F.aggregate(F.slice("flags", i, F.col("span")), F.lit(0), lambda s, x: s + x),
    )
    return flags, F.array_max(sums)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, n_hits, n_agree, n_window: pairs of a document and a benchmark item that it holds.

    Words are lower-cased and split at whitespace. A pair is returned once, with its best window and the
    number of seeds hit at that alignment. Items
    under SPAN words count where all their words are found in a row; null and blank texts, and longer
    items in documents under SPAN words, give no pairs; items with the same text are each reported. Rows
    that repeat an id with one and the same text are one document; with different texts, each text is
    laid beside the items that any of them holds a seed of. Rows without an id give no pairs (nor are
    they dropped by :func:`drop_contaminated`). Other columns are ignored.
    """
    doc = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item = benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(item_text)).alias("words")).distinct()
    item = item.where("words[0] <> ''")
    short = sorted(r["n"] for r in item.select(F.size("words").alias("n")).where(F.col("n") < SPAN).distinct().collect())
    masks = (*MASKS, *("1" * n for n in short))
    sized = item.withColumn("item_size", F.size("words"))
    own = _seeds(sized.where(F.col("item_size") >= SPAN), MASKS, "item_id", "item_size")
    for n in short:
        own = own.union(_seeds(sized.where(F.col("item_size") == n), ("1" * n,), "item_id", "item_size"))
    item_seeds = written(own.select("seed", "item_id", F.col("place").alias("item_place"), "item_size"), "seeds")
    held = F.broadcast(item_seeds) if item_seeds.count() <= broadcast_seeds else item_seeds.hint("merge")
    hits = _seeds(doc.select("doc_id", _words(F.col("text")).alias("words")), masks, "doc_id").join(held, "seed")
    hits = hits.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift"), "item_size").agg(F.count("*").alias("n_hits"))
    hits = written(hits, "hits")

    # the texts with hits, once more: the part beside the item is from word max(shift, 0) on, so many words as the item has left
    ids = written(hits.select("doc_id").distinct(), "hit-ids")
    held = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    found = doc.join(held, "doc_id", "left_semi").select("doc_id", _words(F.col("text")).alias("words"))
    beside = F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("item_size") - F.greatest(-F.col("shift"), F.lit(0)))
    laid = found.join(hits.hint("merge"), "doc_id").select("doc_id", "item_id", "shift", "n_hits", beside.alias("a"))
    laid = laid.join(item.hint("merge"), "item_id")
    laid = laid.withColumn("b", F.slice("words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("a")))
    flags, best = _best_window()
    laid = laid.withColumn("flags", flags).withColumn("span", F.least(F.lit(WINDOW), F.size("flags"))).where(F.col("span") >= F.least(F.lit(SPAN), F.size("words")))
    need = F.when(F.col("span") < SPAN, F.col("span")).otherwise(F.ceil(F.col("span") * AGREE))
    laid = laid.withColumn("n_agree", best).where(F.col("n_agree") >= need)
    found = laid.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_agree", "span", "n_hits")).alias("best"))
    return found.select("doc_id", "item_id", "best.n_hits", "best.n_agree", F.col("best.span").alias("n_window"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they were.

    Rows with null or blank texts, and rows without an id, all stay; rows that repeat an id stay or go
    together. An empty table stays empty, and an empty benchmark drops nothing.
    """
    gone = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["_gone"], "left_anti")
