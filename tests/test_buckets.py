"""Streams whose keys share rows of state: as many rows as buckets, whatever the keys, and each key's own result."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators.timeseries import fold_series
from skylattice.streaming import streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, v double"


def run(spark, tmp_path, feeds, make):
    """Rows that come out of a stream with a batch for each feed, and the rows of state at its end."""
    source = str(tmp_path / "in")
    for n, feed in enumerate(feeds):
        spark.createDataFrame(feed, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = make(streams.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema))
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect(), query.lastProgress.stateOperators[0].numRowsTotal


def feeds_of(keys, seed):
    """Three feeds in order of time, a key with many rows among them."""
    rng = random.Random(seed)
    rows = [(k, START + dt.timedelta(hours=h + rng.random()), rng.gauss(50, 20)) for k in keys for h in sorted(rng.sample(range(72), 8))]
    rows += [("busy", START + dt.timedelta(minutes=m), rng.gauss(0, 1)) for m in range(0, 72 * 60, 20)]
    return [[r for r in rows if i * 24 <= (r[1] - START).total_seconds() / 3600 < (i + 1) * 24] for i in range(3)]


def test_ordered_states_share_buckets(spark, tmp_path):
    feeds = feeds_of([None, "", *map(str, range(40))], 1)
    late = (None, START, 7.0)
    got, states = run(spark, tmp_path, [*feeds[:2], [*feeds[2], late, ("0", None, 3.0)]], lambda s: streams.recurrence_stream(s, "k", "ts", "v", "1 day", buckets=3))
    assert states <= 3
    assert [(r["k"], r["ts"], r["v"], r["forecast"], r["score"]) for r in got if r["late"]] == [(*late, None, None)]
    rows = [r for f in feeds for r in f]
    for key in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: r[0]) + [(None, 3.0)] * (key == "0")  # without an instant: last
        seen = sorted((r for r in got if r["k"] == key and not r["late"]), key=lambda r: (r["ts"] is None, r["ts"] or START))
        assert [(r["ts"], r["v"]) for r in seen] == mine
        forecast, score = fold_series(np.array([v for _, v in mine]), 0.9, 0.5)
        assert [r["forecast"] for r in seen] == pytest.approx(forecast) and [r["score"] for r in seen] == pytest.approx(score)


def test_whole_number_keys_come_back_as_they_were(spark, tmp_path):
    keys = [(1 << 62) + 1, -5, None]
    feed = [(None if k is None else str(k), START, 1.0) for k in keys]
    got, _ = run(spark, tmp_path, [feed], lambda s: streams.recurrence_stream(s.withColumn("k", F.col("k").cast("bigint")), "k", "ts", "v", "1 day"))
    assert {r["k"] for r in got} == set(keys)


def slots_by_hand(feeds, most):
    """Hourly slots of each key, one feed after the other: rows of (key, slot, value, n, gap, late)."""
    hour = lambda at: int((at - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
    out, held, mark = [], {}, 0
    for feed in [*feeds, []]:  # a batch without rows ends the stream
        for k, at, v in feed:
            state = held.setdefault(k, {"next": None, "quiet": 0, "open": {}})
            if state["next"] is not None and hour(at) < state["next"]:
                out.append((k, hour(at), v, 1, False, True))
            else:
                state["open"].setdefault(hour(at), []).append(v)
        for k, state in held.items():
            if state["quiet"] >= most and not state["open"]:
                continue
            first = state["next"] if state["next"] is not None else min(state["open"])
            for slot in range(first, mark):
                values = state["open"].pop(slot, None)
                if values or state["quiet"] < most:
                    state["quiet"] = 0 if values else state["quiet"] + 1
                    out.append((k, slot, sum(values) / len(values) if values else None, len(values or ()), not values, False))
            state["next"] = max(first, mark)
        mark = max([mark, *(hour(at - dt.timedelta(hours=2)) for _, at, _ in feed)])  # counts from the next batch on
    return out


@pytest.mark.parametrize("most", [1 << 40, 3])
def test_slots_share_buckets_and_timers(spark, tmp_path, most):
    from skylattice.streaming.stateful import rocksdb, slot_scores

    feeds = feeds_of([None, "", *map(str, range(12))], 2)
    feeds[2].append(("3", START, 9.0))  # late
    with rocksdb(spark):
        got, states = run(spark, tmp_path, feeds, lambda s: slot_scores(s, "k", "ts", "v", 3600, "2 hours", most_gaps=most, buckets=3))
    assert states <= 3 * 3  # a bucket's value, and its timer in two tables
    plain = lambda rows: sorted(str((k, s, None if v is None else round(v, 6), n, gap, late)) for k, s, v, n, gap, late in rows)
    assert plain((r["k"], r["slot"], r["value"], r["n"], r["gap"], r["late"]) for r in got) == plain(slots_by_hand(feeds, most))
    full = sorted((r["slot"], r["value"], r["forecast"], r["score"]) for r in got if r["k"] == "busy" and not r["gap"])
    forecast, score = fold_series(np.array([r[1] for r in full]), 0.9, 0.5)
    assert len(full) > 60 and [r[2] for r in full] == pytest.approx(forecast) and [r[3] for r in full] == pytest.approx(score)
