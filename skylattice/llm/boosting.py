"""Gradient-boosted trees on small whole numbers, fitted on every row of a table: its tasks add up histograms, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skylattice.llm.common import sliced

#: Features are whole numbers under BINS.
BINS = 32
#: A feature is split only at quantiles of a group's rows, by so many parts, so trees make nothing of single odd values.
CUTS = 32
#: Gradients are added up as whole numbers of 1 / UNIT, so sums don't depend on how rows are dealt; scores are counted to 1 / STEPS.
UNIT, STEPS = 1 << 20, 1 << 14
#: Partial sums that come to the driver in one pass, at most.
PARTS = 64

#: Turns a batch into features (rows x features, bytes), labels, and whether a row is held out.
Rows = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def added_up(table: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | int:
    """The sum of ``count`` over a table, 8 MB of its first column at a time; tasks send what is not zero of their sums. 0 for no row."""
    first = table.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for b in sliced(batches, first, 8 << 20):
            total = total + count(b)
        if isinstance(total, np.ndarray):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"size": [total.size], "at": [at.tobytes()], "n": [total[at].tobytes()]})

    total: np.ndarray | int = 0
    for part in table.coalesce(PARTS).mapInArrow(run, "size long, at binary, n binary").collect():
        total = np.zeros(part["size"], dtype=np.int64) if isinstance(total, int) else total
        total[np.frombuffer(part["at"], dtype=np.int64)] += np.frombuffer(part["n"], dtype=np.int64)
    return total


@dataclass
class Boosted:
    """Logistic boosting; each of ``groups``, told by the first feature, has trees of its own, grown side by side.

    ``grown`` has for each round the arrays feature, threshold and value (group x node) of complete binary trees.
    """

    groups: int = 1
    trees: int = 20
    depth: int = 4
    rate: float = 0.4
    least: float = 2.0
    grown: list = field(default_factory=list)

    def fit(self, table: DataFrame, rows: Rows) -> Boosted:
        """Grows the trees on all rows of ``table`` that are not held out, in a pass for each level of each round."""
        inner, able = 2**self.depth - 1, None
        for _ in range(self.trees):
            feature, threshold = np.full((self.groups, inner), -1), np.zeros((self.groups, inner), dtype=np.uint8)
            value = np.zeros((self.groups, inner + 1))
            for level in range(self.depth):
                sums = added_up(table, self._counter(rows, feature, threshold, level))
                if isinstance(sums, int) or not sums.any():
                    return self
                g, h = (s / UNIT for s in sums.reshape(2, -1, self.groups, 2**level, BINS).transpose(0, 2, 3, 1, 4))
                able = _quantiles(h[:, 0]) if able is None else able
                first, width = 2**level - 1, 2 ** (self.depth - level)
                for group in range(self.groups):
                    for node in range(2**level):
                        feature[group, first + node], threshold[group, first + node], leaves = self._split(g[group, node], h[group, node], able[group])
                        value[group, node * width : (node + 1) * width] = np.repeat(leaves, width // 2)
            self.grown.append((feature, threshold, value))
        return self

    def _split(self, g: np.ndarray, h: np.ndarray, able: np.ndarray) -> tuple[int, int, tuple[float, float]]:
        """The best feature and threshold of a node, and the values on its two sides; -1 where no split gains."""
        gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        g_all, h_all = float(g[0].sum()), float(h[0].sum())
        gr, hr = g_all - gl, h_all - hl
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g_all**2 / (h_all + 1)
        gain[(hl < self.least) | (hr < self.least) | ~able[:, :-1]] = -1
        j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, cut] <= 1e-6:
            return -1, 0, (self.rate * g_all / (h_all + 1),) * 2
        return int(j), int(cut), (self.rate * gl[j, cut] / (hl[j, cut] + 1), self.rate * gr[j, cut] / (hr[j, cut] + 1))

    def _counter(self, rows: Rows, feature: np.ndarray, threshold: np.ndarray, level: int) -> Callable[[pa.RecordBatch], np.ndarray]:
        """Sums of gradients and of their slopes by feature, group, node of the tree so far, and bin."""

        def count(batch: pa.RecordBatch) -> np.ndarray:
            x, y, held = rows(batch)
            size = 2**level * BINS
            out = np.zeros((2, x.shape[1], self.groups, size), dtype=np.int64)
            for group in range(self.groups):
                mine = (x[:, 0] == group) & ~held
                columns = np.ascontiguousarray(x[mine].T)
                p = self._logistic(columns, group)
                slot = _ends(columns, feature[group], threshold[group], np.arange(2**level) * BINS, level)
                weights = np.rint((y[mine] - p) * UNIT), np.rint(p * (1 - p) * UNIT)
                for j, column in enumerate(columns):
                    at = slot + column
                    for out_of, w in zip(out, weights, strict=True):
                        # whole numbers, so sums in double precision are exact below 2**53
                        out_of[j, group] = np.bincount(at, w, size)
            return out.ravel()

        return count

    def _logistic(self, columns: np.ndarray, group: int) -> np.ndarray:
        raw = np.zeros(columns.shape[1])
        for feature, threshold, value in self.grown:
            raw += _ends(columns, feature[group], threshold[group], value[group], self.depth)
        return 1 / (1 + np.exp(-raw))

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for group in range(self.groups):
            mine = x[:, 0] == group
            if mine.any():
                out[mine] = self._logistic(np.ascontiguousarray(x[mine].T), group)
        return out

    def thresholds(self, table: DataFrame, rows: Rows, precision: float) -> list[float]:
        """For each group the smallest threshold at which the precision holds on all rows of ``table`` that are held out."""

        def count(batch: pa.RecordBatch) -> np.ndarray:
            x, y, held = rows(batch)
            x, y = x[held], y[held]
            step = np.minimum(self.probability(x) * STEPS, STEPS - 1).astype(np.int64)
            return np.bincount((x[:, 0].astype(np.int64) * 2 + y) * STEPS + step, minlength=self.groups * 2 * STEPS)

        found = added_up(table, count)
        if isinstance(found, int):
            return [2.0] * self.groups
        return [threshold_for(right, wrong, precision) for wrong, right in found.reshape(self.groups, 2, STEPS)]


def _quantiles(n: np.ndarray) -> np.ndarray:
    """The bins in which a quantile of all rows, by CUTS parts, lies: trees may split after these."""
    parts = CUTS * np.cumsum(n, axis=-1) / np.maximum(n.sum(axis=-1, keepdims=True), 1e-9)
    return np.ceil(parts) > np.ceil(np.concatenate([np.zeros_like(parts[..., :1]), parts[..., :-1]], axis=-1))


def _ends(columns: np.ndarray, feature: np.ndarray, threshold: np.ndarray, ends: np.ndarray, levels: int, node: int = 0) -> np.ndarray:
    """Which of ``ends``, one for each node of a level, a tree's nodes down to that level lead each row to."""
    if levels == 0:
        return ends[node - (len(ends) - 1)]
    left = _ends(columns, feature, threshold, ends, levels - 1, 2 * node + 1)
    if feature[node] < 0:
        return left
    return np.where(columns[feature[node]] > threshold[node], _ends(columns, feature, threshold, ends, levels - 1, 2 * node + 2), left)


def threshold_for(right: np.ndarray, wrong: np.ndarray, precision: float, least: int = 20) -> float:
    """The smallest threshold at which the precision holds, from counts by equal steps of the score; over 1 where none does on ``least`` rows."""
    good, n = (np.cumsum(c[::-1])[::-1] for c in (right, right + wrong))
    able = np.flatnonzero((n >= least) & (good >= precision * n) & (right + wrong > 0))
    return float(able[0] / len(right)) if len(able) else 2.0
