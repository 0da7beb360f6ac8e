"""Removal of word windows that an earlier document has too: difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two positions i and j some shift d < PERIOD puts
both i + d and j + d on cover positions. Windows of ``window - PERIOD + 1`` words are hashed at the
cover positions of each document alone; wherever two documents share ``window`` words, they share
such an anchor within the first PERIOD words. Anchors of one text only are dropped. Around the
others the match is extended: full windows are hashed and compared between documents. Documents with
the very same words are one text to all this: but for the first of them, they lose all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import Powers, Words, mix, sliced, window_hashes, written

WINDOW = 13
#: The perfect difference set modulo 7; every nonzero difference occurs once.
PERIOD, COVER = 7, (0, 1, 3)


def _anchors(words: Words, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in its text, and hash of each anchor; texts shorter than a window have none."""
    hashes = window_hashes(words.hash, size, 1)
    at = np.arange(len(hashes))
    row = words.doc[at]
    place, count = at - words.bounds[row], words.bounds[row + 1] - words.bounds[row]
    able = np.isin(place % PERIOD, COVER) & (place + size <= count) & (count >= window)
    return row[able], place[able], hashes[able]


_SEQUENCE = [Powers(b) for b in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def _sequences(words: Words, which: int) -> np.ndarray:
    """Hash of all words of each row in order."""
    count = np.diff(words.bounds)
    up, _ = _SEQUENCE[which].get(int(count.max(initial=0)) + 1)
    place = np.arange(len(words.hash)) - np.repeat(words.bounds[:-1], count)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash + np.uint64(which)) * up[place], dtype=np.uint64)])
    return mix(total[words.bounds[1:]] - total[words.bounds[:-1]] + count.astype(np.uint64))


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column(0), dtype=np.int64)


def shared_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, place: starts of windows whose words also start in a document with a smaller id.

    Of a document with the words of an earlier one, windows that cover all its words.
    """
    size = window - PERIOD + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = Words(b.column(1))
            row, _, h = _anchors(words, size, window)
            ids = _sequences(words, 0).view(np.int64)[row]
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            if len(first):
                low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(low), pa.array(high)], ["h", "low", "high"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            row, place, h = _anchors(Words(b.column(1)), size, window)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(_ids(b)[row]), pa.array(place.astype(np.int32))], ["h", "doc_id", "place"])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = Words(b.column(1))
            hashes = [pa.array(_sequences(words, i).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(words.bounds), pa.int64()), *hashes], ["doc_id", "n", "s1", "s2"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = Words(b.column(1))
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            at = words.bounds[row] + np.asarray(lists.flatten(), dtype=np.int64)
            marked = np.zeros(len(words.hash) + 1, dtype=np.int64)
            near = at[at < words.bounds[row + 1]]
            np.add.at(marked, np.maximum(near - PERIOD + 1, words.bounds[words.doc[near]]), 1)
            np.add.at(marked, near + 1, -1)
            starts = np.flatnonzero(np.cumsum(marked)[:-1] > 0)
            starts = starts[starts + window <= words.bounds[words.doc[starts] + 1]]
            h1, h2 = (window_hashes(words.hash, window, s) for s in (2, 3))
            of = words.doc[starts]
            columns = [pa.array(h1[starts].view(np.int64)), pa.array(h2[starts].view(np.int64)), pa.array(_ids(b)[of]), pa.array((starts - words.bounds[of]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "place"])

    texts = docs.where("doc_id IS NOT NULL")
    whole = written(texts.mapInArrow(sequences, "doc_id bigint, n bigint, s1 bigint, s2 bigint").where(F.col("n") >= window), "substring-texts")
    key = ["n", "s1", "s2"]
    several = whole.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*key, "low")
    copies = written(whole.join(several.hint("merge"), key).where("doc_id > low").select("doc_id", "n"), "substring-copies")

    seen = texts.mapInArrow(anchors, "h bigint, low bigint, high bigint").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    common = written(seen.where("low < high").select("h"), "substring-anchors")
    hits = texts.mapInArrow(places, "h bigint, doc_id bigint, place int").join(common.hint("shuffle_hash"), "h").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    hits = written(hits.join(copies.hint("merge"), "doc_id", "left_anti"), "substring-hits").withColumnRenamed("doc_id", "_id")
    near = texts.join(hits.hint("merge"), texts["doc_id"] == hits["_id"]).select("doc_id", "text", "places")
    windows = written(near.mapInArrow(extend, "h1 bigint, h2 bigint, doc_id bigint, place int"), "substring-windows")
    earliest = written(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2", "low"), "substring-earliest")
    late = windows.join(earliest.hint("shuffle_hash"), ["h1", "h2"]).where("doc_id > low").select("doc_id", "place")
    all_of = copies.select("doc_id", F.explode(F.array_append(F.sequence(F.lit(0), F.col("n") - window, F.lit(window)), F.col("n") - window)).alias("place"))
    return late.unionByName(all_of.withColumn("place", F.col("place").cast("int")))


def remove_shared(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Removes every word covered by a window of ``window`` words (at least PERIOD) that also starts in a
    document with a smaller id; windows are judged on the input. A null text has no words; texts
    shorter than a window lose nothing. Rows that repeat an id are one document, and share what is
    removed, clipped to their text. Rows without an id lose nothing and take nothing from others.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    gone = shared_windows(texts, window).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    gone = written(gone, "substring-gone").withColumnRenamed("doc_id", "_id")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words, lists = Words(b.column(1)), b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
            count = np.diff(words.bounds)
            change = np.zeros(len(words.hash) + 1, dtype=np.int64)
            if len(row):
                place = np.asarray(lists.flatten(), dtype=np.int64)
                np.add.at(change, words.bounds[row] + np.minimum(place, count[row]), 1)
                np.add.at(change, words.bounds[row] + np.minimum(place + window, count[row]), -1)
            removed = np.cumsum(change)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            kept_sha = []
            for i in range(b.num_rows):
                s, e = words.bounds[i], words.bounds[i + 1]
                keep = np.flatnonzero(~removed[s:e]) + s
                parts = [words.raw[a:z].tobytes() for a, z in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]
                kept_sha.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            columns = [b.column(0), pa.array(count, pa.int64()), pa.array(np.diff(total[words.bounds]), pa.int64()), pa.array(kept_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = texts.join(gone.hint("merge"), texts["doc_id"] == gone["_id"], "left").select("doc_id", "text", "places")
    return out.mapInArrow(cut_out, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
