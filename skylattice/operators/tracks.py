"""Connected regions in a frame, tracks of regions over time, and the ranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.joins import neighbours
from skylattice.plans.store import sized, stored


#: Rows and columns of a tile; a graph of at most SMALL edges is finished in one task, a larger one in turns.
TILE, SMALL = 128, 100_000


def frame_components(cells: DataFrame, keys: list[str], ring: int | None = None, tile: int = TILE) -> DataFrame:
    """Four-connected components of the cells (iy, ix) of each frame: ``blob`` = least iy * 100000 + ix of the component.

    Frames are labelled by tiles, each a group of ``tile`` x ``tile`` cells at most, in parallel; labels that meet
    across the borders of tiles are united afterwards. On a full ring the last column meets the first.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "iy int, ix int, blob bigint"])
    own_ring = ring if ring and ring <= tile else None  # the ring closes within its tiles

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(frame["iy"].tolist(), frame["ix"].tolist(), strict=True))
        blob = {}
        while left:
            seed = left.pop()
            group, todo = [seed], [seed]
            while todo:
                y, x = todo.pop()
                for a, b in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                    place = (a, b % own_ring if own_ring else b)
                    if place in left:
                        left.remove(place)
                        group.append(place)
                        todo.append(place)
            name = min(y * 100_000 + x for y, x in group)
            blob.update(dict.fromkeys(group, name))
        out = frame[[*keys, "iy", "ix"]].drop_duplicates().copy()
        out["blob"] = [blob[p] for p in zip(out["iy"].tolist(), out["ix"].tolist(), strict=True)]
        return out

    tiles = [F.floor(F.col(c) / tile).alias(f"_t{c}") for c in ("iy", "ix")]
    placed = cells.select(*keys, F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), *tiles)
    local = stored(placed.groupBy(*keys, "_tiy", "_tix").applyInPandas(label, schema), "tile-labels")
    edges = stored(_border_edges(local, keys, ring if ring and ring > tile else None, tile), "tile-edges")
    if edges.isEmpty():
        return local
    node = lambda c: F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col(c).cast("string"))
    ends = edges.select(*keys, F.col("a").alias("blob")).union(edges.select(*keys, "b")).distinct().withColumn("node", node("blob"))
    labels = graph_components(edges.select(node("a").alias("a"), node("b").alias("b")), ends.select("node"))
    named = stored(ends.join(labels.hint("merge"), "node"), "tile-united")
    least = named.groupBy("label").agg(F.min("blob").alias("_least"))
    renamed = named.join(least.hint("merge"), "label").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("blob").alias("_blob"), "_least")
    same = F.col("blob") == F.col("_blob")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return local.join(renamed.hint("merge"), same, "left").select(*keys, "iy", "ix", F.coalesce("_least", "blob").alias("blob"))


def _border_edges(local: DataFrame, keys: list[str], ring: int | None, tile: int) -> DataFrame:
    """keys, a, b: labels that touch across the border of two tiles, or across the seam of the ring."""
    right = F.pmod(F.col("ix") + 1, F.lit(ring)) if ring else F.col("ix") + 1
    seam = F.col("ix") == ring - 1 if ring else F.lit(False)
    last = lambda c: F.pmod(F.col(c) + 1, F.lit(tile)) == 0
    out = local.where(last("ix") | seam).select(*keys, "iy", right.cast("int").alias("ix"), F.col("blob").alias("a"))
    out = out.unionByName(local.where(last("iy")).select(*keys, (F.col("iy") + 1).alias("iy"), "ix", F.col("blob").alias("a")))
    first = F.pmod("iy", F.lit(tile)) == 0
    other = local.where(first | (F.pmod("ix", F.lit(tile)) == 0)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("iy").alias("_iy"), F.col("ix").alias("_ix"), F.col("blob").alias("b"))
    same = (F.col("iy") == F.col("_iy")) & (F.col("ix") == F.col("_ix"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(other.hint("merge"), same).where("a <> b").select(*keys, "a", "b").distinct()


def peak_clusters(frame: DataFrame, keys: list[str], value: str, level: float, ring: int | None = None, tile: int = TILE) -> DataFrame:
    """The peak of each frame (largest |value|, then least row and column) and the size of the component that holds it.

    Components are of cells with |value| of at least ``level``; ``cluster`` is 0 where the peak does not reach it.
    """
    size = F.abs(value)
    rows = frame.where(F.col(value).isNotNull()).select(*keys, "iy", "ix", value)
    peaks = rows.groupBy(*keys).agg(F.max_by(F.struct("iy", "ix", value), F.struct(size, -F.col("iy"), -F.col("ix"))).alias("p")).select(*keys, "p.*")
    blobs = frame_components(rows.where(size >= level), keys, ring, tile)
    sizes = blobs.groupBy(*keys, "blob").agg(F.count("*").alias("cluster"))
    at_peak = peaks.join(blobs.hint("merge"), [*keys, "iy", "ix"]).join(sizes.hint("merge"), [*keys, "blob"]).select(*keys, "cluster")
    return peaks.join(at_peak.hint("merge"), keys, "left").select(*keys, "iy", "ix", value, F.coalesce("cluster", F.lit(0)).alias("cluster"))


def graph_components(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """node, label: least node of the connected component.

    A graph of at most ``small`` edges, counted first, is finished by one task; in a larger one labels are
    propagated, and jumped over, until none changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("node", "other"), "graph-edges")
    if both.count() <= 2 * small:
        return _small_components(both, nodes)
    labels = stored(nodes.select("node", F.col("node").alias("label")).distinct(), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("label").alias("_near"))
        step = labels.join(near.hint("merge"), "node", "left").select("node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("_mid"))
        jump = labels.select(F.col("node").alias("_mid"), F.col("label").alias("_far"))
        new = stored(step.join(jump.hint("merge"), "_mid").select("node", "_old", F.least("_mid", "_far").alias("label")), "graph-labels")
        labels = new.select("node", "label")
        if new.where("_old <> label").isEmpty():
            return labels


def _small_components(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels of a graph whose edges fit into a task; nodes without edges are their own."""
    import pandas as pd

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        above: dict = {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for a, b in zip(frame["node"], frame["other"], strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        return pd.DataFrame([(x, top(x)) for x in list(above)], columns=["node", "label"])

    kind = {f.name: f.dataType.simpleString() for f in both.schema}["node"]
    united = both.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(unite, f"node {kind}, label {kind}")
    return stored(nodes.select("node").distinct().join(united.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "graph-labels")


def link_tracks(cells: DataFrame, epoch: str, polarity: str, cadence: float, ring: int | None = None) -> DataFrame:
    """Adds ``track`` to cells with ``blob``: regions of equal polarity in successive epochs (gap up to 1.5 cadences)

    are one track if one of them, grown by a cell, touches the other; merges are transitive, in any order.
    """
    named = cells.withColumn("node", F.concat_ws(":", F.col(epoch).cast("string"), F.col(polarity).cast("string"), F.col("blob").cast("string")))
    # the epoch before lies within 1.5 cadences: looked for in buckets of that width, not in one window over all epochs
    width = 1.5 * cadence
    epochs = cells.select(epoch).distinct()
    earlier = epochs.select(F.col(epoch).alias("_before"), F.explode(F.array(F.floor(F.col(epoch) / width), F.floor(F.col(epoch) / width) + 1)).alias("_b"))
    near = epochs.withColumn("_b", F.floor(F.col(epoch) / width)).join(earlier.hint("merge"), "_b").where((F.col("_before") < F.col(epoch)) & (F.col(epoch) - F.col("_before") <= width))
    before = near.groupBy(epoch).agg(F.max("_before").alias("_before"))
    grown = neighbours(named.join(before.hint("merge"), epoch), [epoch, polarity], "iy", "ix", ring, itself=True).select("_before", polarity, "ny", "nx", F.col("node").alias("b"))
    earlier = named.select(F.col(epoch).alias("_before"), polarity, F.col("iy").alias("ny"), F.col("ix").alias("nx"), F.col("node").alias("a"))
    edges = earlier.join(grown.hint("merge"), ["_before", polarity, "ny", "nx"]).select("a", "b").distinct()
    labels = graph_components(edges, named.select("node"))
    return named.join(labels.withColumnRenamed("label", "track").hint("merge"), "node").drop("node")


def suppress_overlaps(footprints: DataFrame, scan: str, rank: str, cells: str, most: int = 3, share: float = 0.25) -> DataFrame:
    """The ``most`` best candidates of each scan whose footprints share at most ``share`` of the smaller with a better one.

    As many turns: each takes the best candidate left of every scan, by an aggregate, and drops those that
    overlap it, so all candidates are looked at and no scan is gathered in a task. Ranks differ within a scan.
    """
    left, kept = footprints, None
    for turn in range(most):
        best = stored(left.groupBy(scan).agg(F.min_by(F.struct(*left.columns), rank).alias("_b")).select("_b.*"), f"best-{turn}")
        kept = best if kept is None else kept.unionByName(best)
        held = best.agg(F.coalesce(F.sum(F.size(cells) + 1), F.lit(0)).alias("n")).first()["n"]  # cells of one footprint a scan
        taken = best.select(scan, F.col(cells).alias("_cells"), F.col(rank).alias("_rank"))
        shared = F.size(F.array_intersect(cells, "_cells"))
        left = left.join(sized(taken, rows=held), scan).where((shared <= share * F.least(F.size(cells), F.size("_cells"))) & (F.col(rank) > F.col("_rank"))).drop("_cells", "_rank")
    return kept


def focus_region(frame: DataFrame, keys: list[str], value: str, scale: float, ring: int | None = None) -> DataFrame:
    """Cells of the strongest connected object of each frame, grown by one cell; all cells if there is no object.

    Objects are cells with |value| of at least max(scale, a quarter of the peak); strength = sum of |value|, of equally
    strong ones the one with the least ``blob``. ``focus`` marks the grown cells, ``object`` those of the object itself.
    """
    size = F.abs(value)
    peak = frame.groupBy(*keys).agg(F.max(size).alias("_peak"))
    strong = frame.join(peak, keys).where(size >= F.greatest(F.lit(scale), 0.25 * F.col("_peak")))
    blobs = frame_components(strong, keys, ring)
    strength = blobs.join(frame.select(*keys, "iy", "ix", size.alias("_s")).hint("merge"), [*keys, "iy", "ix"]).groupBy(*keys, "blob").agg(F.sum("_s").alias("_sum"))
    best = strength.groupBy(*keys).agg(F.max_by("blob", F.struct("_sum", -F.col("blob"))).alias("blob"))
    own = blobs.join(best.hint("merge"), [*keys, "blob"], "left_semi").select(*keys, "iy", "ix")
    grown = neighbours(own, keys, "iy", "ix", ring, itself=True).select(*keys, F.col("ny").alias("iy"), F.col("nx").alias("ix"), F.lit(True).alias("_in")).distinct()
    some = best.select(*keys, F.lit(True).alias("_any"))
    marked = frame.join(grown.hint("merge"), [*keys, "iy", "ix"], "left").join(own.withColumn("_own", F.lit(True)).hint("merge"), [*keys, "iy", "ix"], "left").join(some.hint("merge"), keys, "left")
    return marked.withColumn("focus", F.col("_in").isNotNull() | F.col("_any").isNull()).withColumn("object", F.col("_own").isNotNull()).drop("_in", "_own", "_any")
