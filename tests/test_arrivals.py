"""Streams that keep what has arrived by day, and the counts of what became of each row."""

import datetime

import pytest
from pyspark.sql import functions as F

from skylattice.streaming import streams

SCHEMA = "k int, ts timestamp, v double"


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_counts_add_up_with_late_and_broken_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batches = [
        [(1, at(0), 1.0), (1, at(1), -5.0), (1, None, 2.0)],
        [(1, at(50), 1.0), (2, at(51), None)],
        [(1, at(2), 3.0), (1, at(3), -9.0), (2, at(60), 4.0)],  # two late rows; the late one that is broken too is late
    ]
    for rows in batches:
        feed(spark, source, rows)
        kept, refused, counts = streams.counted_intake(streams.read_stream(spark, source, SCHEMA), {"negative": F.col("v") >= 0, "undated": F.col("ts").isNotNull()}, out, mark, "ts", 86400)
    got = {r["batch"]: (r["read"], r["kept"], r["late"], r["refused"]) for r in counts.collect()}
    assert got == {0: (3, 1, 0, 2), 1: (2, 1, 0, 1), 2: (3, 1, 2, 0)}
    assert all(r[0] == sum(r[1:]) for r in got.values()) and sum(r[0] for r in got.values()) == sum(map(len, batches))
    assert (kept.count(), refused.count()) == (3, 5)
    assert {r["reason"] for r in refused.collect()} == {"late", "negative", "undated"}


def test_a_retried_batch_counts_once(spark, tmp_path):
    arrivals = streams.Arrivals(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "ts")
    first = spark.createDataFrame([(1, at(1), 1.0), (1, at(30), 2.0), (1, None, 3.0)], SCHEMA)
    for _ in range(2):
        assert arrivals.add(first, 0) == [19723, 19724]
    arrivals.add(spark.createDataFrame([(2, at(2), 5.0)], SCHEMA), 1)
    assert sorted(r["v"] for r in arrivals.of([19723]).collect()) == [1.0, 5.0]
    assert arrivals.of([1]).collect() == [] and arrivals.of([]).collect() == []
    assert spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(arrivals.undated).count() == 1


def test_files_read_do_not_grow_with_the_batches(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    read = []
    real = streams.Arrivals.of

    def watched(self, days):
        rows = real(self, days)
        read.append({f.split("_day=")[1].split("/")[0] for f in rows.inputFiles()})
        return rows

    monkeypatch.setattr(streams.Arrivals, "of", watched)
    for day in range(6):
        feed(spark, source, [(1, at(24 * day + h), float(h)) for h in range(3)])
    score = lambda rows: rows.groupBy("day").agg(F.sum("v").alias("total"))
    scores, beyond = streams.rescore_stream(streams.read_stream(spark, source, SCHEMA), out, mark, "ts", score)
    assert sorted((r["day"] - 19723, r["total"]) for r in scores.collect()) == [(d, 3.0) for d in range(6)] and beyond.count() == 0
    assert [len(days) for days in read] == [1] * 6


def test_the_plan_of_a_later_batch_names_its_days_alone(spark, tmp_path):
    arrivals = streams.Arrivals(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, "ts")
    for day in range(5):
        arrivals.add(spark.createDataFrame([(1, at(24 * day), 1.0)], SCHEMA), day)
    assert {f.split("_day=")[1].split("/")[0] for f in arrivals.of([19726, 19727]).inputFiles()} == {"19726", "19727"}


@pytest.mark.parametrize("days", [2])
def test_same_hour_baseline_reads_the_days_looked_back_to(spark, tmp_path, days):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for day, v in enumerate((10.0, 20.0, 40.0, 80.0)):
        feed(spark, source, [(1, at(24 * day), v)])
    got = streams.against_same_hour(streams.read_stream(spark, source, SCHEMA), out, mark, ["k"], "ts", "v", days).collect()
    assert sorted((r["v"], r["baseline"]) for r in got) == [(10.0, None), (20.0, 10.0), (40.0, 15.0), (80.0, 30.0)]
