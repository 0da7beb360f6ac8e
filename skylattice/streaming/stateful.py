"""Keyed state with event-time timers: regular slots of a key's series, scored in order, gaps included."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skylattice.operators.timeseries import fold_many
from skylattice.streaming.buckets import BUCKETS, bucket, grown, joined, key_text, placed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "keys array<string>, n array<bigint>, mean array<double>, m2 array<double>, h array<double>, next array<bigint>, quiet array<bigint>, timer bigint, owners array<bigint>, slots array<bigint>, totals array<double>, counts array<bigint>"
_NAMES = [field.split()[0] for field in _STATE.split(", ")]
#: What is kept of each key, with the values of a new one; of each slot still open; the next slot of a key that has none yet.
_NONE_YET = -(1 << 63)
_OF_KEY = {"n": (0, np.int64), "mean": (0.0, float), "m2": (0.0, float), "h": (0.0, float), "next": (_NONE_YET, np.int64), "quiet": (0, np.int64)}
_OPEN = {"owners": np.int64, "slots": np.int64, "totals": float, "counts": np.int64}


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start in here keep their state in RocksDB, checkpointed into the stream's own folder."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


class SlotScorer(StatefulProcessor):
    """Adds the rows of a bucket's keys up by slot; scores a slot as soon as the watermark has passed its end.

    One value holds the keys' recurrences and the sums of the slots still open. A bucket has one timer, at the end of
    the next slot to be scored of any of its keys, so slots come out, as gaps, also while no row arrives.
    """

    def __init__(self, step_ms: int, decay: float, gain: float, most: int):
        self.step, self.decay, self.gain, self.most = step_ms, decay, gain, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("slots", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frame = joined(rows)
        held = self._load()
        held["keys"], owner = placed(held["keys"], frame["key"])
        for c, (fill, kind) in _OF_KEY.items():
            held[c] = grown(held[c], len(held["keys"]), fill, kind)
        slot, value = frame["ms"].to_numpy(np.int64) // self.step, frame["v"].to_numpy(float)
        late = slot < held["next"][owner]
        self._add(held, owner[~late], slot[~late], value[~late])
        out = [pd.DataFrame({"key": frame["key"].to_numpy()[late], "slot": slot[late], "value": value[late], "n": 1, "forecast": np.nan, "score": np.nan, "gap": False, "late": True})] if late.any() else []
        yield from out + self._advance(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held = self._load()
        if held["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            held["timer"] = None
        yield from self._advance(held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        held = dict(zip(_NAMES, self.state.get() if self.state.exists() else ([], *[[]] * 6, None, *[[]] * 4), strict=True))
        return held | {"keys": list(held["keys"])} | {c: np.array(held[c], kind) for c, kind in (*((c, k) for c, (_, k) in _OF_KEY.items()), *_OPEN.items())}

    @staticmethod
    def _add(held: dict, owner: np.ndarray, slot: np.ndarray, value: np.ndarray) -> None:
        """Adds rows to the open slots, which stay in order of slot and key."""
        owners, slots = np.concatenate([held["owners"], owner]), np.concatenate([held["slots"], slot])
        totals, counts = np.concatenate([held["totals"], value]), np.concatenate([held["counts"], np.ones(len(value), np.int64)])
        order = np.lexsort((owners, slots))
        owners, slots = owners[order], slots[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(slots)), bool), (slots[1:] != slots[:-1]) | (owners[1:] != owners[:-1])]))
        held["owners"], held["slots"] = owners[first], slots[first]
        held["totals"], held["counts"] = (np.add.reduceat(c[order], first) if len(first) else c for c in (totals, counts))

    def _advance(self, held: dict, watermark: int) -> list:
        """Scores the slots that end by the watermark, in order, and sets the timer for the next one."""
        import pandas as pd

        out, closed = [], watermark // self.step  # ``closed`` is the first slot still open
        following, names, awake = self._following(held), np.array(held["keys"], dtype=object), self._awake(held)
        for slot in range(int(following[awake].min(initial=closed)), closed):
            mine = slice(*np.searchsorted(held["slots"], [slot, slot + 1]))
            seen, count = held["owners"][mine], held["counts"][mine]
            value = held["totals"][mine] / count
            forecast, score = fold_many(held, seen, value, self.decay, self.gain)
            held["quiet"][seen] = 0
            missing = awake & (following <= slot) & (held["quiet"] < self.most)
            missing[seen] = False
            missing = np.flatnonzero(missing)
            held["quiet"][missing] += 1
            none = np.full(len(missing), np.nan)
            out.append(pd.DataFrame({
                "key": names[np.concatenate([seen, missing])], "slot": slot, "value": np.concatenate([value, none]), "n": np.concatenate([count, np.zeros(len(missing), np.int64)]),
                "forecast": np.concatenate([forecast, fold_gaps(held, missing, self.decay)]), "score": np.concatenate([score, none]), "gap": np.arange(len(seen) + len(missing)) >= len(seen), "late": False,
            }))
        held["next"][awake & (following < closed)] = closed
        done = int(np.searchsorted(held["slots"], closed))
        for c in _OPEN:
            held[c] = held[c][done:]
        self._set_timer(held)
        self.state.update(tuple(held[c].tolist() if isinstance(held[c], np.ndarray) else held[c] for c in _NAMES))
        return out

    @staticmethod
    def _following(held: dict) -> np.ndarray:
        """The next slot of each key to be scored; of a new key its first."""
        first = np.full(len(held["keys"]), np.iinfo(np.int64).max)
        np.minimum.at(first, held["owners"], held["slots"])
        return np.where(held["next"] == _NONE_YET, first, held["next"])

    def _awake(self, held: dict) -> np.ndarray:
        """Whether a key has slots to come; one that has been quiet for too long waits for a row instead."""
        awake = held["quiet"] < self.most
        awake[held["owners"]] = True
        return awake

    def _set_timer(self, held: dict) -> None:
        following = self._following(held)[self._awake(held)]
        wanted = (int(following.min()) + 1) * self.step if len(following) else None
        if held["timer"] != wanted:
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            if wanted is not None:
                self.handle.registerTimer(wanted)
            held["timer"] = wanted


def fold_gaps(held: dict, at: np.ndarray, decay: float) -> np.ndarray:
    """The forecasts of keys in a slot without rows; their states fade as if they had been met exactly."""
    n = held["n"][at]
    scale = np.where(n > 1, np.maximum(np.sqrt(held["m2"][at] / np.maximum(n - 1, 1)), 1e-6), 1.0)
    forecast = held["mean"][at] + scale * held["h"][at]
    held["h"][at] *= decay
    return forecast


def slot_scores(stream: DataFrame, key: str, at: str, value: str, step_seconds: int, delay: str, decay: float = 0.9, gain: float = 0.5, most_gaps: int = 1 << 40, buckets: int = BUCKETS) -> DataFrame:
    """The recurrence over regular slots: ``key``, slot, value, n, forecast, score, gap, late.

    A slot's value is the mean of its rows. From a key's first slot on there is a row for every slot that ends by the
    watermark (the latest instant less ``delay``); one without rows has ``gap`` and a forecast, but no score. A row that
    comes after its slot was scored comes back alone with ``late``; one without an instant or a value is no reading.
    After ``most_gaps`` gaps in a row a key has no rows until one arrives. Start the stream within :func:`rocksdb`.
    The states of the keys of one of ``buckets`` buckets are kept together (:mod:`skylattice.streaming.buckets`).
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, delay).select(bucket(key, buckets).alias("bucket"), key_text(key).alias("key"), F.unix_millis(at).alias("ms"), F.col(value).cast("double").alias("v")).where("ms IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    schema = "key string, slot bigint, value double, n bigint, forecast double, score double, gap boolean, late boolean"
    scorer = SlotScorer(step_seconds * 1000, decay, gain, most_gaps)
    out = rows.groupBy("bucket").transformWithStateInPandas(scorer, schema, "append", "eventTime")
    return out.select(F.col("key").cast(kind).alias(key), *[c for c in out.columns if c != "key"])
