"""Near-duplicate detection by bottom-k sketches long enough to lose no pair, exact but for 64-bit hashes.

Texts with one and the same set of shingles form a class and need no comparison. One hash function names
the shingles, and all sets are sorted in one order: rare shingles first (by their count in a hashed table
of fixed size), then by hash. A set's sketch is its first k = n - ceil(0.8 n) + 1 shingles in this order:
two sets of similarity 0.8 share one of these, whatever the order, so pairs that meet in no inverted list
of the retained values need no comparison. With a k of fixed size some pairs at the threshold share
nothing, and an estimate from the union of two sketches drops some of the others. So bounds that drop no
similar pair stand in its place: lengths, the places of the shared shingle in both sketches, and bitmaps
of the sets. The full sets confirm what is left, and the links are followed to connected components.

In a list of up to LIST classes every pair is generated. In a longer one the pairs with a hub come first,
in turns, since they join most of a large group; then all pairs of the list whose classes are
still in different components, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import Words, discard, mix, sliced, window_hashes, written

LIST, REST = 16, 64
#: So many turns of hubs at most, before the rest of each long list is compared as a whole.
TURNS = 3
#: The table of counts has 2**BITS places and is dealt out in parts of 2**PART; a byte for each goes to the tasks.
BITS, PART = 22, 15


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, all rows in a row, and the bounds of each row."""
    words = Words(texts, lower=True)
    count = np.diff(words.bounds)
    hashes = window_hashes(words.hash, size, 11)
    at = np.arange(len(hashes))
    row = words.doc[at]
    able = at + size <= words.bounds[row + 1]
    row, hashes = row[able], hashes[able]
    for n in range(1, size):  # a shorter text is one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            whole = window_hashes(words.hash, n, 100 + n)
            row = np.concatenate([row, short])
            hashes = np.concatenate([hashes, whole[words.bounds[short]]])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]) if len(row) else np.zeros(0, bool)
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(texts) + 1))


def _counts(size: int):
    """mapInArrow function: id and text -> counts of the shingles of all its rows by the first BITS of their hash, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, dtype=np.int32)
        for b in sliced(batches):
            hashes, _ = shingle_sets(b.column(1), size)
            total += np.bincount((hashes >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.int32)
        parts = np.minimum(total, 65_535).astype(np.uint16).reshape(-1, 1 << PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["part", "counts"])

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: all counts of some parts -> a byte for each place, eight times the logarithm of one more than the sum."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts.as_buffer(), dtype=np.uint16).astype(np.int64)
    levels = [np.minimum(8 * np.log2(1.0 + t), 255).astype(np.uint8).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])


def frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How frequent the shingles at each place of the table are, in 256 steps; 8 is a single one."""
    counts = texts.mapInArrow(_counts(size), "part int, counts binary").repartition("part")
    out = np.zeros((1 << (BITS - PART), 1 << PART), dtype=np.uint8)
    for part, levels in counts.mapInArrow(_levels, "part int, levels binary").collect():
        out[part] = np.frombuffer(levels, dtype=np.uint8)
    return out.reshape(-1)


def _prefixes(size: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            hashes, bounds = shingle_sets(b.column(1), size)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
            f1, f2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            # parity of the shingles at each place of a bitmap that has at least as many places as the set has shingles
            places = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(places)])
            at = ends[row] + (hashes & (places[row] - 1).astype(np.uint64)).astype(np.int64)
            packed = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8))
            bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(packed)])
            level = levels[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]
            order = np.argsort(row << 8 | level, kind="stable")  # hashes ascend in each row
            place = np.arange(len(row)) - bounds[row]
            # what is single in its place of the table is in no other set; such shingles come first
            single = level[order] <= 8
            take = (place < (n - (percent * n + 99) // 100 + 1)[row]) & ~single
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[take], minlength=len(n)))]), pa.int32())
            prefix = pa.ListArray.from_arrays(offsets, pa.array(hashes[order][take].view(np.int64)))
            skipped = np.bincount(row[single], minlength=len(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), prefix, pa.array(skipped), bits], ["doc_id", "n", "f1", "f2", "prefix", "skipped", "bits"])

    return run


def _bounded(percent: int):
    """mapInArrow function: pairs with sizes and bitmaps of both sets -> pairs that the bitmaps allow to be similar.

    Bitmaps differ in no more places than the sets in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            size = np.asarray(b.column(2)) + np.asarray(b.column(3))
            differ = size - 2 * -(-percent * size // (100 + percent))
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y))
                while len(p) != len(q):
                    p, q = (p, q) if len(p) > len(q) else (q, p)
                    p = p[: len(p) // 2] ^ p[len(p) // 2 :]
                keep[i] = np.bitwise_count(p ^ q).sum() <= differ[i]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(size: int, percent: int):
    """mapInArrow function: pairs with both texts -> pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(sliced([whole], "ta"), "tb"):
                (x, xb), (y, yb) = shingle_sets(b.column(2), size), shingle_sets(b.column(3), size)
                keep = np.zeros(b.num_rows, dtype=bool)
                for i in range(b.num_rows):
                    p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                    if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) and len(p):
                        shared = len(np.intersect1d(p, q, assume_unique=True))
                        keep[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of links (a, b), for nodes with links."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = written(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label"), F.first("node").alias("old")), "labels")
    while True:
        now = labels.select("node", "label")
        near = edges.join(now.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = now.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = written(step.join(jump.hint("merge"), "label", "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old"), "labels")
        discard(labels)
        labels = new
        if new.where("old <> label").isEmpty():
            discard(edges)
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at whitespace; a text of fewer words than a shingle is one
    shingle; one without words has none and is linked with nothing. Links join sets with
    100 * intersection >= percent * union; component_id is the least id of the documents reachable, and
    that document is kept. A null text counts as empty; rows without an id are kept and linked with
    nothing; rows that repeat an id share its links. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    levels = frequencies(texts, shingle)
    kinds = "doc_id bigint, n bigint, f1 bigint, f2 bigint, prefix array<bigint>, skipped int, bits binary"
    sets = written(texts.mapInArrow(_prefixes(shingle, percent, levels), kinds), "near-sets")
    key = ["n", "f1", "f2"]
    whole = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first(F.struct("prefix", "skipped", "bits")).alias("s"))
    whole = written(whole.select(*key, "rep", "s.*"), "near-whole")
    members = written(sets.select("doc_id", *key), "near-members")
    discard(sets)

    # size and place in one number: a posting is shuffled once for each shingle of a sketch
    postings = whole.select("rep", "n", "skipped", F.posexplode("prefix").alias("at", "v")).select("rep", "v", F.expr("shiftleft(n, 32) + skipped + at").alias("np"))
    lists = written(postings.groupBy("v").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1"), "near-lists")
    shared = postings.join(lists.hint("shuffle_hash"), "v").select("v", "rep", F.shiftright("np", 32).alias("n"), F.expr("cast(np & 4294967295 as int)").alias("p"), "size", "hub")
    filed = written(shared, "near-postings")
    classes = written(whole.select(*key, "rep", "bits"), "near-classes")
    discard(lists, whole)
    long = filed.where(F.col("size") > LIST)
    lengths = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    # no more can be shared than what follows the first shared shingle in either set
    places = f"least(x.n - x.p, y.n - y.p) * {100 + percent} >= {percent} * (x.n + y.n)"
    pair = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    member = F.struct("rep", "n", "p")

    def confirmed(found: DataFrame, label: str) -> DataFrame:
        held = classes.select("rep", "n", "bits")
        a, b = (held.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}")) for c in "ab")
        near = found.distinct().join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "na", "nb", "sa", "sb")
        near = written(near.mapInArrow(_bounded(percent), "a bigint, b bigint"), f"near-{label}-bounded")
        ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
        full = written(texts.join(ids.hint("shuffle_hash"), texts["doc_id"] == ids["id"], "left_semi"), f"near-{label}-texts")
        ta, tb = (full.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        laid = near.join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").select("a", "b", "ta", "tb")
        links = written(laid.mapInArrow(_confirm(shingle, percent), "a bigint, b bigint"), f"near-{label}-links")
        discard(near, full)
        return links

    def torn_lists(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the long lists with their component, and the lists with more than one."""
        named = labels.select(F.col("node").alias("rep"), "label")
        placed = long.select("v", "rep", "n", "p").join(named.hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        placed = written(placed, "near-placed")
        parts = placed.groupBy("v", "label").agg(F.count("*").alias("c"))
        torn = parts.groupBy("v").agg((F.sum("c") - F.max("c")).alias("apart"), F.max_by("label", F.struct("c", "label")).alias("major"), F.count("*").alias("parts"))
        return placed, written(torn.where("parts > 1").drop("parts"), "near-torn")

    # every pair of a short list, and a hub with all of a long one
    short = filed.where(F.col("size") <= LIST).groupBy("v").agg(F.collect_list(member).alias("held"))
    pairs = short.select(F.explode("held").alias("x"), "held").select("x", F.explode("held").alias("y"))
    pairs = pairs.where(f"x.rep < y.rep AND {lengths} AND {places}").select(*pair)
    hubs = long.where("rep = hub").select("v", member.alias("x"))
    starred = long.where("rep <> hub").select("v", member.alias("y")).join(hubs.hint("shuffle_hash"), "v").where(lengths).select(*pair)
    links = confirmed(pairs.union(starred), "first")
    labels = components(links)
    placed, torn = torn_lists(labels)
    member = F.struct("rep", "n", "p", "label")
    for turn in range(1, TURNS + 1):
        wide = written(placed.join(torn.where(f"apart > {REST}").select("v").hint("shuffle_hash"), "v", "left_semi"), "near-wide")
        if wide.isEmpty():
            break
        # the same hub wherever the same classes meet
        hubs = wide.groupBy("v").agg(F.min_by(member, F.xxhash64("rep", F.lit(turn))).alias("x"))
        starred = wide.select("v", member.alias("y")).join(hubs.hint("shuffle_hash"), "v").where(f"{lengths} AND x.label <> y.label").select(*pair)
        more = confirmed(starred, f"turn-{turn}")
        discard(wide)
        if more.isEmpty():
            break
        links = links.union(more)
        discard(labels, placed, torn)
        labels = components(links)
        placed, torn = torn_lists(labels)
    discard(filed)
    if not torn.isEmpty():
        # each member outside the largest component with every member of another one; blocks share a list's work
        blocks = F.ceil(F.col("apart") / REST)
        some = placed.join(torn.withColumn("blocks", blocks).hint("shuffle_hash"), "v")
        rest = some.where("label <> major").select("v", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), member.alias("x"))
        every = some.select("v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), member.alias("y"))
        apart = every.join(rest.hint("shuffle_hash"), ["v", "block"]).where(f"x.label <> y.label AND {lengths} AND {places}").select(*pair)
        more = confirmed(apart, "rest")
        if not more.isEmpty():
            discard(labels)
            labels = components(links.union(more))
    discard(placed, torn)

    reached = classes.select(*key, "rep").join(labels.select(F.col("node").alias("rep"), "label").hint("merge"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("component_id"))
    out = members.join(written(reached, "near-reached").hint("merge"), key, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that with the least id; all columns as they were.

    Rows with null, empty or blank texts, and rows without an id, all stay; rows that repeat an id stay
    or go together. An empty table stays empty.
    """
    gone = near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["_gone"], "left_anti")
