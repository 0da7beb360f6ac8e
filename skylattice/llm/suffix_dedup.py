"""Removal of long repeated byte strings: sparse distributed prefix doubling.

Start positions that share a prefix are told apart by names of growing length, in rounds, until a
name is unique or the threshold is past. The first round names positions by the ``seed`` bytes at an
anchor: of the first ``span`` grams of so many bytes in a string of ``length`` bytes, in which they lie
wholly, the anchor is the one with the least hash, the leftmost of these. It depends on the string alone, so equal
strings have equal anchors at equal offsets, and consecutive starts with one anchor form a run. A run
is a row with the pair (name of the bytes that all its strings share, name of all bytes that any of
them covers):

* the second name occurs twice: every start of the run is repeated;
* the first name occurs once: none is;
* else the run is cut into aligned blocks of ``cut`` starts and, at last, into single starts, whose
  strings share more bytes (seed, then length - cut + 1, then length): the next, longer name.

Spark groups and counts the pairs; texts are read again only for the runs that are left. Names are
128-bit hashes of the bytes rather than positions in a sorted order, since only equality matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import _SALT, Powers, discard, mix, sliced, text_bytes, written

LENGTH, SPAN, CUT = 400, 256, 16
_ONE, _TWO = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
_SALT_TWO = mix(_SALT + np.uint64(17))
_SCHEMA = "doc_id bigint, q bigint, lo bigint, hi bigint, core bigint, c1 bigint, c2 bigint"


class Names:
    """Hashes of any byte range of a batch, by prefix sums of a polynomial in two bases."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.down, self.sums = [], []
        for powers, salt in ((_ONE, _SALT), (_TWO, _SALT_TWO)):
            up, down = powers.get(n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(salt[raw] * up[:n], out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def of(self, which: int, start: np.ndarray, end: np.ndarray, extra: np.ndarray | int = 0) -> np.ndarray:
        s, d = self.sums[which], self.down[which]
        size = (end - start).astype(np.uint64)
        return mix((s[end] - s[start]) * d[start] + mix(size * np.uint64(1 << 20) + np.asarray(extra).astype(np.uint64)))


def _batch(ids: np.ndarray, base: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, core: np.ndarray, c1: np.ndarray, c2: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    signed = [np.ascontiguousarray(x).view(np.int64) for x in (core, c1, c2)]
    columns = [pa.array(ids, pa.int64(), mask=null), *(pa.array(x - base, pa.int64()) for x in (q, lo, hi)), *(pa.array(x) for x in signed)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "q", "lo", "hi", "core", "c1", "c2"])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0), dtype=np.int64), np.asarray(column.is_null())


def _runs(length: int, span: int, seed: int):
    """mapInArrow function: documents -> first-round rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            raw, offsets = text_bytes(b.column(1))
            if len(raw) < length:
                continue
            names = Names(raw)
            at = np.arange(len(raw) - seed + 1)
            least = (names.of(0, at, at + seed) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
            step, width = 1, 1
            while width < span:
                step = min(width, span - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
            able = np.flatnonzero(np.arange(len(least)) + length <= offsets[doc + 1])
            if not len(able):
                continue
            anchor = (least[able] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[able[1:]] != doc[able[:-1]])])
            first = np.flatnonzero(new)
            lo, hi, q = able[first], able[np.append(first[1:], len(able)) - 1], anchor[first]
            ids, null = _ids(b.column(0))
            row = doc[lo]
            c = [names.of(i, lo, hi + length, q - lo) for i in (0, 1)]
            yield _batch(ids[row], offsets[row], q, lo, hi, names.of(0, q, q + seed), *c, null[row])

    return run


def _blocks(length: int, cut: int):
    """mapInArrow function: (doc_id, text, runs) -> rows of aligned blocks of ``cut`` starts of these runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            raw, offsets = text_bytes(b.column(1))
            lists = b.column(2)
            flat, row = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            q, lo, hi = (np.asarray(flat.field(k), dtype=np.int64) + offsets[row] for k in ("q", "lo", "hi"))
            fits = (lo >= offsets[row]) & (hi + length <= offsets[row + 1])  # rows that repeat an id may have other texts
            q, lo, hi, row = q[fits], lo[fits], hi[fits], row[fits]
            if not len(q):
                continue
            j0, j1 = (q - hi) // cut, (q - lo) // cut
            many = j1 - j0 + 1
            at = np.repeat(np.arange(len(q)), many)
            j = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + j0[at]
            q, row = q[at], row[at]
            lo, hi = np.maximum(lo[at], q - cut * j - cut + 1), np.minimum(hi[at], q - cut * j)
            names = Names(raw)
            core = names.of(0, q - cut * j, q - cut * j - cut + 1 + length, j)
            c = [names.of(i, lo, hi + length, q - lo) for i in (0, 1)]
            ids, null = _ids(b.column(0))
            yield _batch(ids[row], offsets[row], q, lo, hi, core, *c, null[row])

    return run


def _resolve(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Runs that share their core with another run (doc_id, lo, hi, n: runs of this very cover), and those to cut further.

    ``rows`` is a table of :func:`written`; it goes once its last reader has stored its result.
    """
    key = ["core", "c1", "c2"]
    first = [F.first(c).alias(c) for c in ("doc_id", "q", "lo", "hi")]  # of one and the same row
    groups = written(rows.groupBy(*key).agg(F.count("*").alias("n"), *first), f"{label}-groups")
    mixed = groups.groupBy("core").agg(F.count("*").alias("covers")).where("covers > 1")
    known = written(groups.join(mixed.hint("merge"), "core", "left").where("n > 1 OR covers > 1"), f"{label}-shared")
    shared = written(rows.join(known.select(*key, "n").hint("shuffle_hash"), key).select("doc_id", "lo", "hi", "n"), f"{label}-found")
    discard(rows, groups)
    return shared, known.where("covers > 1").select("doc_id", "q", "lo", "hi")


def _found(docs: DataFrame, length: int, span: int, cut: int, id_col: str, text_col: str, seed: int | None) -> DataFrame:
    """doc_id, lo, hi, seed: repeated ranges of start bytes, and with seed = 1 the runs whose anchor's seed is repeated.

    ``lo`` and ``hi`` are null for a run that is not repeated as a whole.
    """
    seed = length - span + 1 if seed is None else seed
    if span + seed - 1 > length:
        raise ValueError("an anchor and its seed must lie within the string: span + seed - 1 <= length")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(_runs(length, span, seed), _SCHEMA), "suffix-runs")
    shared, left = _resolve(rows, "suffix-runs")
    whole = F.col("n") > 1
    found = shared.select("doc_id", F.when(whole, F.col("lo")).alias("lo"), F.when(whole, F.col("hi")).alias("hi"), F.lit(1).alias("seed"))
    for size in (cut, 1):
        lists = left.groupBy("doc_id").agg(F.collect_list(F.struct("q", "lo", "hi")).alias("runs"))
        again = _with_texts(texts, lists, "inner", "runs").mapInArrow(_blocks(length, size), _SCHEMA)
        rows = written(again, f"suffix-blocks-{size}")
        shared, left = _resolve(rows, f"suffix-blocks-{size}")
        found = found.unionByName(shared.where(whole).select("doc_id", "lo", "hi", F.lit(0).alias("seed")))
    return found


def repeated_starts(docs: DataFrame, length: int = LENGTH, span: int = SPAN, cut: int = CUT, id_col: str = "doc_id", text_col: str = "text", seed: int | None = None) -> DataFrame:
    """doc_id, lo, hi: ranges of start bytes (both ends included) whose ``length`` bytes also start elsewhere."""
    return _found(docs, length, span, cut, id_col, text_col, seed).where("lo IS NOT NULL").drop("seed")


def _with_texts(texts: DataFrame, lists: DataFrame, how: str, *columns: str) -> DataFrame:
    lists = lists.withColumnRenamed("doc_id", "_id").hint("merge")
    return texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]), how).select("doc_id", "text", *columns)


def remove_repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, cut: int = CUT, id_col: str = "doc_id", text_col: str = "text", seed: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_seeds.

    Removes every byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same text included; strings are judged on the input. A null text counts as empty; shorter texts
    lose nothing. Rows that repeat an id share their spans, clipped to their text; other columns are
    ignored. ``span`` is the number of grams from which an anchor is chosen, ``seed`` their bytes (by
    default, and at most, length - span + 1). n_seeds tells of shorter repeats, which stay: the number of
    anchors whose seed also stands at an anchor elsewhere, over 0 for every repeat of span + seed - 1
    bytes that both texts follow up to ``length`` bytes (0 for texts under ``length`` bytes; rows that
    repeat an id share it).
    """

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw, offsets = text_bytes(b.column(1))
            lists = b.column(2)
            sizes = np.diff(offsets)
            flat, row = lists.flatten(), np.repeat(np.arange(b.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
            change = np.zeros(len(raw) + 1, dtype=np.int64)
            if len(row):
                lo, hi = (np.asarray(flat.field(k), dtype=np.int64) for k in ("lo", "hi"))
                np.add.at(change, offsets[row] + np.minimum(lo, sizes[row]), 1)
                np.add.at(change, offsets[row] + np.minimum(hi + length, sizes[row]), -1)
            gone = np.cumsum(change)[:-1] > 0
            starts = gone & ~np.concatenate([[False], gone[:-1]])
            inner = offsets[:-1][sizes > 0]
            starts[inner] = gone[inner]
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            shas = [hashlib.sha256(raw[s:e][~gone[s:e]].tobytes()).hexdigest() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            numbers = [pa.array(x, pa.int64()) for x in (sizes, count(gone), count(starts))]
            columns = [b.column(0), *numbers, pa.array(shas, pa.string()), pa.compute.fill_null(b.column(3), 0)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_seeds"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    span_lists = F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))  # nulls are left out
    spans = _found(docs, length, span, cut, id_col, text_col, seed).groupBy("doc_id").agg(span_lists.alias("spans"), F.sum("seed").alias("n_seeds"))
    spans = written(spans, "suffix-spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_seeds bigint"
    return _with_texts(texts, spans, "left", "spans", "n_seeds").mapInArrow(cut_out, schema)
