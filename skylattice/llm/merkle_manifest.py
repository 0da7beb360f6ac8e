"""A Merkle manifest of a dataset, kept as an append log in postorder.

Rows are the leaves of one tree for each group, in order of their keys; every ``WIDTH`` consecutive nodes
become their hash until one is left, and the groups' roots are the leaves of a last tree. A node is
written when its last leaf has come, after all nodes below it, so its place in the log follows from sizes of
subtrees alone: :func:`position`. Aligned builders each take ``WIDTH ** LEVELS`` leaves, a whole subtree, and write
their stretch of the log; the subtrees' roots are the leaves of the next stage, so a stage is 4,096 times smaller
than the one before. Proofs come from the top down: whoever extracts them has the stretch of the log of one
subtree, computes the places of siblings, and puts the proof of the subtree's root behind.

No task holds more than one subtree, however large a group is.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import discard, written

#: Nodes under one parent, and levels of the tree that one builder makes.
WIDTH, LEVELS = 8, 4
#: A table with a row for each sorted part and group is broadcast up to so many rows.
BROADCAST_ROWS = 100_000

NODES = "grp string, n bigint, level int, idx bigint, pos bigint, digest string"
PATHS = "grp string, idx bigint, path array<string>"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree over ``n`` leaves; none over one leaf."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def position(n: int, level: int, idx: int) -> int:
    """Place in the log, from 0, of node ``idx`` of a level.

    When it is written, ``end`` leaves have come. Each level up to its own then has all nodes that these
    leaves begin, each level above has all but the last of them, which are still open.
    """
    end, top = min((idx + 1) * WIDTH**level, n), height(n)
    begun = sum(-(-end // WIDTH**k) for k in range(top + 1))
    return begun - (top - level) - 1


def fields_digest(columns: list[str], text: str | None = None, instead: Column | None = None) -> Column:
    """Hash of a row's fields: ``-`` for null, else size in UTF-8 bytes, colon, value; ``instead`` takes the place of ``text``."""

    def field(name: str) -> Column:
        value = (instead if name == text and instead is not None else F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with idx (from 0, in order of ``keys`` within ``grp``) and n, the number of rows of the group.

    Rows are sorted by ranges over all groups; counts of each part and group give the offsets, so a group
    of any size is spread over many tasks.
    """
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.repartitionByRange("grp", *keys).sortWithinPartitions("grp", *keys).select("*", part.alias("_part"), row.alias("_row"))
    numbered = written(numbered, "merkle-sorted")
    runs = numbered.groupBy("grp", "_part").agg(F.count("*").alias("_k"), F.min("_row").alias("_first"))
    w = Window.partitionBy("grp").orderBy("_part")  # one row for each part
    before = F.coalesce(F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(Window.partitionBy("grp")).alias("n"))
    runs = written(runs, "merkle-parts")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs.hint("merge")
    return numbered.join(runs, ["grp", "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def _build(base: int, levels: int):
    """A builder of one aligned subtree whose leaves are nodes of level ``base``."""

    def build(table: pa.Table) -> pa.Table:
        order = table.column("idx").to_numpy().argsort(kind="stable")
        grp, n = table.column("grp")[0].as_py(), table.column("n")[0].as_py()
        first, leaves = int(table.column("idx").to_numpy()[order[0]]), table.column("digest").to_pylist()
        top = min(levels, height(n) - base)
        open_nodes: list[list[str]] = [[] for _ in range(top + 1)]
        out: list[tuple[int, int, str]] = []

        def append(level: int, idx: int, digest: str, last: bool) -> None:
            """Writes a node, and every node above that it completes."""
            out.append((base + level, idx, digest))
            if level < top:
                open_nodes[level].append(digest)
                if last or len(open_nodes[level]) == WIDTH:
                    parent = digest_of("".join(open_nodes[level]))
                    open_nodes[level] = []
                    append(level + 1, idx // WIDTH, parent, last)

        for i, at in enumerate(order):
            append(0, first + i, leaves[at], i == len(order) - 1)
        depths, indexes, digests = zip(*out, strict=True)
        places = [position(n, level, idx) for level, idx, _ in out]
        columns = [pa.array([grp] * len(out), pa.string()), pa.array([n] * len(out), pa.int64()), pa.array(depths, pa.int32()), pa.array(indexes, pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns, names=["grp", "n", "level", "idx", "pos", "digest"])

    return build


def append_log(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log of the trees over ``leaves`` (grp, n, idx, digest), a table a stage.

    A stage's table holds its leaves, which but for the first stage are the roots of the subtrees below, and
    the levels over them up to the roots of its own subtrees.
    """
    most = leaves.agg(F.max("n")).first()[0]
    stages = []
    while not stages or height(most) > len(stages) * levels:
        base = len(stages) * levels
        aligned = leaves.select("grp", "n", "idx", "digest", _chunk(levels).alias("chunk")).groupBy("grp", "chunk")
        stages.append(written(aligned.applyInArrow(_build(base, levels), NODES), f"merkle-log-{len(stages)}"))
        leaves = stages[-1].where(F.col("level") == base + levels)
    return stages


def _chunk(below: int) -> Column:
    """The subtree, ``below`` levels higher, of a node."""
    return F.expr(f"idx div {WIDTH**below}")


def tops(stages: list[DataFrame], levels: int) -> DataFrame:
    """grp and the digest of its root: the only node of its level. Where a stage ends there, the next one has it again."""
    out = None
    for i, stage in enumerate(stages):
        for level in range(i * levels, (i + 1) * levels + 1):
            alone = stage.where((F.col("level") == level) & (F.col("n") <= WIDTH**level) & (F.col("n") > (WIDTH ** (level - 1) if level else 0)))
            out = alone.select("grp", "digest") if out is None else out.unionByName(alone.select("grp", "digest"))
    return out.distinct()


def _siblings(base: int, levels: int, left: pa.Table, right: pa.Table):
    """For each row of ``left``, a node of level ``base``: its path, from the log's stretch in ``right``.

    A path has the group's root and the last root in front, then two strings a level: what stands before the
    node in its run, and what stands after it.
    """
    idx, n = left.column("idx").to_pylist(), left.column("n")[0].as_py()
    log = dict(zip(right.column("pos").to_pylist(), right.column("digest").to_pylist(), strict=True))
    rest = _rest(right)
    counts = [-(-n // WIDTH**k) for k in range(base, min(base + levels, height(n)))]
    known: dict[tuple[int, int], list[str]] = {}

    def beside(k: int, node: int) -> list[str]:
        if (k, node) not in known:
            low = node - node % WIDTH
            run = [log[position(n, base + k, i)] if i != node else "" for i in range(low, min(low + WIDTH, counts[k]))]
            known[k, node] = ["".join(run[: node - low]), "".join(run[node - low + 1 :])]
        return known[k, node]

    for i in idx:
        yield [*rest[:2], *(side for k in range(len(counts)) for side in beside(k, i // WIDTH**k)), *rest[2:]]


def _rest(right: pa.Table) -> list[str]:
    """The path of the subtree's root."""
    return next(p for p in right.column("path").to_pylist() if p is not None)


def _paths(base: int, levels: int):
    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            paths, idx = list(_siblings(base, levels, left, right)), left.column("idx").to_pylist()
        else:  # the group has its root in an earlier stage
            paths, idx = [_rest(right)], [0]
        grp = [right.column("grp")[0].as_py()] * len(idx)
        return pa.Table.from_arrays([pa.array(grp, pa.string()), pa.array(idx, pa.int64()), pa.array(paths, pa.list_(pa.string()))], names=["grp", "idx", "path"])

    return extract


def _stretch(stages: list[DataFrame], levels: int, stage: int, above: DataFrame):
    """What the proofs of a stage need: its nodes but for the subtrees' roots, and the paths of these roots."""
    base = stage * levels
    chunk = _chunk(levels)
    for k in range(1, levels):
        chunk = F.when(F.col("level") == base + k, _chunk(levels - k)).otherwise(chunk)
    nodes = stages[stage].where(F.col("level") < base + levels).select("grp", chunk.alias("chunk"), "pos", "digest", F.lit(None).cast("array<string>").alias("path"))
    paths = above.select("grp", F.col("idx").alias("chunk"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("digest"), "path")
    return nodes.unionByName(paths).groupBy("grp", "chunk")


def _down(stages: list[DataFrame], levels: int, above: DataFrame, until: int) -> DataFrame:
    """Paths of the leaves of stage ``until``, from the last stage down; ``above`` has those of the groups' roots (idx 0)."""
    for stage in range(len(stages) - 1, until - 1, -1):
        left = stages[stage].where(F.col("level") == stage * levels).withColumn("chunk", _chunk(levels)).groupBy("grp", "chunk")
        above = written(left.cogroup(_stretch(stages, levels, stage, above)).applyInArrow(_paths(stage * levels, levels), PATHS), f"merkle-paths-{stage}")
    return above


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` hashes the row's fields; ``subroot`` is the root of its group's tree, ``root`` that of the tree over
    all groups (null first, then in order of UTF-8 bytes). ``proof_sha256`` hashes the siblings from the leaf
    to the root. Rows whose id has a CRC-32 divisible by 3 are tampered with (A-Z of the text in lower case):
    ``folded_root`` is recomputed from the tampered leaf and the siblings, ``verified`` says whether it is the root.

    Leaves of a group stand in order of id, nulls first, then of leaf; rows that are the same throughout are
    leaves side by side, and get the proofs of their places. A null id is not tampered with; a null field
    counts as ``-``, an empty one as ``0:``. An empty table gives an empty result; columns other than
    ``fields`` are ignored. A builder takes ``WIDTH ** levels`` leaves.
    """
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    # null sorts before every name, and a name keeps its order behind the sign
    grp = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaf = fields_digest(list(fields))
    rows = docs.select(F.col(id_col).alias("doc_id"), grp.alias("grp"), leaf.alias("digest"), F.when(tampered, fields_digest(list(fields), text_col, lower)).alias("forged"))
    rows = written(rows, "merkle-leaves")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    leaves = written(placed(rows, ["doc_id", "digest"]), "merkle-placed")
    log = append_log(leaves, levels)

    names = tops(log, levels).select(F.col("grp").alias("name"), "digest", F.lit("").alias("grp"))
    names = written(placed(names, ["name"]), "merkle-groups")
    top_log = append_log(names, levels)
    at_top = F.lit(0).cast("bigint").alias("idx")
    up = _down(top_log, levels, tops(top_log, levels).select("grp", at_top, F.array(F.lit(""), "digest").alias("path")), 0)
    roots = names.join(up.select("idx", F.col("path").alias("up")).hint("merge"), "idx")
    roots = written(roots.select(F.col("name").alias("grp"), at_top, F.concat(F.array("digest"), F.slice("up", 2, F.size("up"))).alias("path")), "merkle-subroots")
    above = _down(log, levels, roots, 1)

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            for (subroot, root, *path), leaf, forged in zip(_siblings(0, levels, left, right), left.column("digest").to_pylist(), left.column("forged").to_pylist(), strict=True):
                folded = leaf if forged is None else forged
                for i in range(0, len(path), 2):
                    folded = digest_of(path[i] + folded + path[i + 1])
                out.append((leaf, subroot, root, digest_of("".join(path)), folded, folded == root))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.string()] * 5 + [pa.bool_()]
        arrays = [left.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
        return pa.Table.from_arrays(arrays, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    discard(rows, *top_log, up, names)
    return leaves.withColumn("chunk", _chunk(levels)).groupBy("grp", "chunk").cogroup(_stretch(log, levels, 0, above)).applyInArrow(prove, schema)
