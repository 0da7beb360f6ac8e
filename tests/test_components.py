"""Components over tiles, the peak's component, and graphs finished in one task or in turns."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import tracks


def flood(cells, ring=None):
    left, out = set(cells), {}
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            y, x = todo.pop()
            for p in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                p = (p[0], p[1] % ring) if ring else p
                if p in left:
                    left.remove(p)
                    group.append(p)
                    todo.append(p)
        out |= dict.fromkeys(group, min(y * 100_000 + x for y, x in group))
    return out


@pytest.fixture(scope="module")
def frames():
    pick = random.Random(2)
    snake = {(y, x) for y in range(0, 20, 2) for x in range(30)} | {(y, 29 if y % 4 == 1 else 0) for y in range(1, 19, 2)}
    return {0: {(y, x) for y in range(20) for x in range(30) if pick.random() < 0.6}, 1: snake, 2: {(y, x) for y in range(20) for x in range(30)}, 3: {(0, 0), (0, 29), (5, 5)}}


@pytest.mark.parametrize("tile, ring", [(4, None), (4, 30), (64, 30), (7, None)])
def test_tiles_make_no_difference(spark, frames, tile, ring):
    rows = [(t, y, x) for t, cells in frames.items() for y, x in cells]
    got = {}
    for r in tracks.frame_components(spark.createDataFrame(rows, "t int, iy int, ix int").repartition(3), ["t"], ring, tile).collect():
        got.setdefault(r["t"], {})[r["iy"], r["ix"]] = r["blob"]
    assert got == {t: flood(cells, ring) for t, cells in frames.items()}


def test_peak_clusters(spark, frames):
    rows = [(t, y, x, (5.0 if (y, x) in cells else 1.0) + (1.0 if (y, x) == (0, 0) else 0.0)) for t, cells in frames.items() for y in range(20) for x in range(30)]
    rows += [(9, 1, 1, 2.0), (9, 0, 3, -2.0), (9, 0, 4, None)]
    got = {r["t"]: (r["iy"], r["ix"], r["cluster"]) for r in tracks.peak_clusters(spark.createDataFrame(rows, "t int, iy int, ix int, v double"), ["t"], "v", 4.0, ring=30, tile=8).collect()}
    for t, cells in frames.items():
        blobs = flood(cells, 30)
        best = max((((y, x) in cells) * 4 + ((y, x) == (0, 0)), -y, -x) for y in range(20) for x in range(30))
        place = (-best[1], -best[2])
        assert got[t] == (*place, sum(b == blobs[place] for b in blobs.values()) if place in blobs else 0)
    assert got[9] == (0, 3, 0)


def test_small_graphs_and_large_ones_agree(spark):
    pick = random.Random(6)
    edges = spark.createDataFrame([(pick.randrange(150), pick.randrange(150)) for _ in range(110)], "a long, b long")
    nodes = spark.range(160).toDF("node")
    small = sorted(tuple(r) for r in tracks.graph_components(edges, nodes).collect())
    assert small == sorted(tuple(r) for r in tracks.graph_components(edges, nodes, small=0).collect()) and len(small) == 160
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in tracks.graph_components(chain, spark.range(41).toDF("node")).collect()} == {0}
