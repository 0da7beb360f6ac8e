"""Rules that decide about rows at the edge: cells twice, ends of a span, odd axes, cut archives, ties of confidence."""

import pytest
from pyspark.sql import functions as F

from skylattice.functions.geo import circular_mean_longitude
from skylattice.operators import aggregates, joins, timeseries, topk
from skylattice.operators.manifests import map_manifest
from skylattice.sources import tables


def test_a_cell_twice_rejects_its_group_even_if_unusable(spark):
    rows = [("a", 1, 1.0, ["ok"]), ("a", 2, 3.0, ["ok"]), ("b", 1, 1.0, ["ok"]), ("b", 1, None, ["bad"]), ("c", 1, None, ["bad"])]
    df = spark.createDataFrame(rows, "k string, cell int, v double, flags array<string>")
    out = {r["k"]: r for r in aggregates.regional_readout(df, ["k"], "v", "flags", ["bad"], 2, cell=["cell"]).collect()}
    assert {k: r["reject_reason"] for k, r in out.items()} == {"a": None, "b": "duplicate_cell", "c": "no_usable_cell"}
    assert (out["a"]["mean_v"], out["a"]["coverage"]) == (2.0, 1.0)
    plain = {r["k"]: r["reject_reason"] for r in aggregates.regional_readout(df, ["k"], "v", "flags", ["bad"], 2).collect()}
    assert plain["b"] is None


def test_shapes_touch_the_border_and_lean_towards_their_mass(spark):
    rows = [("edge", 0, 1, 1.0), ("edge", 1, 1, 1.0), ("inside", 1, 1, 1.0), ("inside", 1, 2, 1.0), ("inside", 1, 3, 1e6), ("null", 2, 2, None)]
    df = spark.createDataFrame(rows, "k string, iy int, ix int, m double")
    out = {r["k"]: r for r in aggregates.shape_descriptors(df, ["k"], "iy", "ix", 1.0, 1.0, "m", (5, 6)).collect()}
    assert {k: r["border"] for k, r in out.items()} == {"edge": True, "inside": False, "null": False}
    assert out["inside"]["elongation"] == pytest.approx(1.0, abs=1e-4)  # nearly all mass in one cell
    even = {r["k"]: r for r in aggregates.shape_descriptors(df, ["k"], "iy", "ix", 1.0, 1.0).collect()}
    assert even["inside"]["elongation"] == pytest.approx(3.0) and "border" not in even["inside"]
    assert out["inside"]["perimeter"] == even["inside"]["perimeter"] == 8


def test_thirds_share_ties_and_wrong_rows_are_counted(spark):
    rows = [(0.1, 9.0), (0.5, 4.0), (0.5, 8.0), (0.5, 6.0), (0.9, 1.0), (0.9, 3.0), (None, 5.0), (0.3, None)]
    df = spark.createDataFrame(rows, "confidence double, error double")
    out = aggregates.confidence_report(df, "confidence", "error", F.col("confidence") >= 0.5, 5.0).first()
    assert (out["n"], out["accepted"], out["accepted_wrong"]) == (6, 5, 2)
    assert out["low_error"] == pytest.approx((9 + 6) / 2)  # one row, and one of the tie with its mean
    assert out["high_error"] == pytest.approx(2.0)
    ranks = [(1, 6), (3, 3), (3, 5), (3, 4), (5.5, 1), (5.5, 2)]
    mean = 3.5
    rho = sum((a - mean) * (b - mean) for a, b in ranks) / (sum((a - mean) ** 2 for a, _ in ranks) * sum((b - mean) ** 2 for _, b in ranks)) ** 0.5
    assert out["rho"] == pytest.approx(rho)
    nothing = aggregates.confidence_report(df.where("false"), "confidence", "error", F.lit(True), 5.0).first()
    assert nothing.asDict() == {"rho": None, "low_error": None, "high_error": None, "n": 0, "accepted": 0, "accepted_wrong": 0}


def test_a_frequent_pair_of_values_counts_as_often_as_it_stands(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 50 + [(2.0, 1.0), (3.0, 5.0), (3.0, None)], "x double, y double")
    pdf = df.toPandas().dropna()
    assert aggregates.rank_correlation(df.dropna(), "x", "y").first()["rho"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    assert aggregates.rank_correlation(df.where("x = 1"), "x", "y").first()["rho"] is None


def test_gaps_at_both_ends_count_whole_and_between_beyond_a_step(spark):
    rows = [("late", 7), ("late", 8), ("early", 0), ("early", 3), ("holes", 0), ("holes", 6), ("holes", 9), ("full", 0), ("full", 9), ("out", 12), ("out", None)]
    rows += [("full", t) for t in range(1, 9)]
    df = spark.createDataFrame(rows, "k string, t int")
    out = {r["k"]: (r["missing_gap"], r["n"]) for r in timeseries.missing_gap(df, ["k"], "t", 1, 0, 9, df).collect()}
    assert out == {"late": (7, 2), "early": (6, 2), "holes": (5, 3), "full": (0, 10), "out": (None, 0)}
    assert "out" not in {r["k"] for r in timeseries.missing_gap(df, ["k"], "t", 1, 0, 9).collect()}


def test_degraded_maps_keep_every_stride_and_the_mean_rms(spark):
    rows = [(t, y, x, float(10 * t + x), 1.0 + y) for t in (0, 1, 2, 5) for y in (0, 1) for x in range(4)]
    rows = [r for r in rows if r[:3] != (2, 0, 3)] + [(9, 0, 0, 1.0, 1.0)]
    rows = [(*r[:4], -1.0) if r[:3] == (0, 0, 0) else r for r in rows]
    df = spark.createDataFrame(rows, "t int, iy int, ix int, v double, rms double")
    out = {(r["t"], r["by"], r["bx"]): (r["v"], r["rms"]) for r in timeseries.degrade(df, [], "t", "iy", "ix", "v", "rms", 2, 2, 0.25).collect()}
    assert out == {(0, 0, 0): (0.5, None), (0, 0, 1): (2.5, 1.75), (2, 0, 0): (20.5, 1.75)}  # block (2, 0, 1) lacks a cell, 9 most of them


def test_sources_with_other_axes_are_left_out_and_the_best_revision_stays(spark):
    a = spark.createDataFrame([("a", 1, 0, 1, 1.0), ("a", 1, 1, 1, 2.0)], "source string, t int, lat int, rev int, v double")
    b = spark.createDataFrame([("b", 1, 0, 2, 3.0), ("b", 2, 1, 1, 4.0)], a.schema)
    odd = spark.createDataFrame([("c", 1, 0, 9, 5.0), ("c", 1, 2, 9, 6.0)], a.schema)
    whole, refused = topk.merge_series([a, b, odd], "source", ["lat"], ["t", "lat"], [F.desc("rev"), F.desc("source")])
    assert sorted(r["v"] for r in whole.collect()) == [2.0, 3.0, 4.0]
    assert [r["source"] for r in refused.collect()] == ["c"]
    assert topk.merge_series([a, b, odd], "source", ["lat"], ["t", "lat"])[0].count() == 4


def test_merged_series_are_not_dealt_by_their_source(spark):
    """All rows of a source share its key: a join dealt by it gives one task a whole source."""
    a = spark.range(3000).selectExpr("'a' AS source", "id AS t", "id % 5 AS lat")
    odd = spark.range(30).selectExpr("'b' AS source", "id AS t", "id % 4 AS lat")
    whole, refused = topk.merge_series([a, odd], "source", ["lat"], ["t", "lat"])
    assert whole.count() == 3000 and [r["source"] for r in refused.collect()] == ["b"]
    assert "SortMergeJoin" not in (plan := whole._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(source" not in plan


def test_violations_say_what_they_saw(spark):
    df = spark.createDataFrame([(1, 5, 3), (2, None, 3), (3, 1, 2)], "key int, a int, b int")
    out = joins.violations(df, "key", {"order": F.col("a") <= F.col("b"), "b": F.col("b") > 2}, {"order": ["a", "b"]})
    assert sorted(tuple(r) for r in out.collect()) == [("b", 3, ""), ("order", 1, "a=5, b=3"), ("order", 2, "a=null, b=3")]


def test_archives_are_refused_for_what_differs(spark, tmp_path):
    schema = "day int, iy int, ix int, v double, flags array<string>"
    cell = lambda d, y, x, v=1.0, f="ok": (d, y, x, v, [f])
    rows = [cell(d, y, x) for d in range(1, 7) for y in (0, 1) for x in (0, 1, 2)] + [(1, 1, 2, float("nan"), None), (6, 0, 0, None, ["gap", "ok"])]
    describe = lambda df, part: map_manifest(df, part, ["iy", "ix"], "v", "flags")
    path = str(tmp_path / "maps")
    df = spark.createDataFrame(rows, schema)
    listed = {r["day"]: r for r in tables.write_archive(df, path, "day", describe).collect()}
    assert (listed[1]["rows"], listed[1]["shape"], listed[1]["valid"], listed[1]["missing"], listed[1]["flags"]) == (7, [2, 3], 6, 0, ["ok"])
    assert (listed[6]["rows"], listed[6]["flags"]) == (7, ["gap", "ok"])
    good, refused = tables.read_archive(spark, path, df.schema, "day", describe)
    assert good.count() == len(rows) and refused.count() == 0

    def again(day, kept):
        spark.createDataFrame(kept, schema).drop("day").write.mode("overwrite").parquet(f"{path}/data/day={day}")

    whole = lambda d: [cell(d, y, x) for y in (0, 1) for x in (0, 1, 2)]
    again(1, whole(1)[:-3])  # a row of cells is gone
    again(2, whole(2)[:-1])  # a cell is gone
    again(3, [*whole(3)[:-1], cell(3, 1, 2, 1.0, "poor")])
    again(4, [*whole(4)[:-1], cell(4, 1, 2, 2.0)])
    again(7, whole(7))
    good, refused = tables.read_archive(spark, path, df.schema, "day", describe)
    assert {r["day"]: r["reason"] for r in refused.collect()} == {1: "shape_differs", 2: "counts_differ", 3: "flags_differ", 4: "differs", 7: "unlisted"}
    assert {r["day"] for r in good.select("day").distinct().collect()} == {5, 6}


def test_scores_look_at_the_strongest_connected_object(spark):
    import math

    from skylattice.plans.fields import event_means, event_scores

    def value(d, y, x):
        if d == 2:
            return 1.0  # a calm day
        if 3 <= y <= 5 and 4 <= x <= 6:
            return 100.0  # nine cells in the middle
        return -90.0 if y == 0 and x in (0, 1, 2, 9, 10, 11) else 2.0  # two weaker objects on the border

    frames = spark.createDataFrame([(d, y, x, value(d, y, x), 2 if x < 7 else 1) for d in (1, 2) for y in range(9) for x in range(12)], "day int, iy int, ix int, a double, n int")
    wave = spark.createDataFrame([(0.0,)], "wave double")
    means = {r["day"]: r for r in event_means(frames, wave, 9, 12, 1.0, 1.0, 40.0, 60.0, focused=True).collect()}
    whole = {r["day"]: r for r in event_means(frames, wave, 9, 12, 1.0, 1.0, 40.0, 60.0).collect()}
    one = means[1]
    assert (one["border"], whole[1]["border"]) == (False, True)
    assert one["share"] == pytest.approx(9 / 108) and whole[1]["share"] == pytest.approx(15 / 108)
    assert one["compactness"] == pytest.approx(4 * math.pi * 9 / 12**2) and one["elongation"] == pytest.approx(1.0)
    grown = [(y, x) for y in range(9) for x in range(12) if any(3 <= y + a <= 5 and 4 <= x + c <= 6 for a, c in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)))]
    assert one["anomaly"] == pytest.approx(math.tanh(sum(abs(value(1, *c)) for c in grown) / len(grown) / 40))
    assert one["support"] == pytest.approx(sum(c[1] < 7 for c in grown) / len(grown))
    calm = means[2]
    assert (calm["compactness"], calm["share"], calm["border"]) == (0.0, 0.0, False)
    assert calm["anomaly"] == pytest.approx(math.tanh(1 / 40)) and calm["support"] == whole[2]["support"]
    scores = {r["day"]: r for r in event_scores(event_means(frames, wave, 9, 12, 1.0, 1.0, 40.0, 60.0, focused=True)).collect()}
    assert scores[1]["localized"] == pytest.approx(one["support"] * one["anomaly"] * math.sqrt(one["compactness"]) * math.sqrt(1 - 9 / 108))


def test_sides_are_broadcast_only_when_small(spark, monkeypatch):
    from skylattice.operators import grid
    from skylattice.plans import store

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    many, few = spark.range(50), spark.range(5)
    assert "strategy=broadcast" in plan(many.join(store.sized(few), "id"))
    monkeypatch.setattr(store, "BROADCAST_ROWS", 3)
    assert "strategy=merge" in plan(many.join(store.sized(few), "id")) and "strategy=merge" in plan(many.join(store.sized(few, rows=4), "id"))
    with pytest.raises(ValueError):
        grid.corner_table(spark, [0.0, 1.0], [0.0, 1.0], 1.0, 1.0, [0.5] * 101, [0.5] * 100)


def test_longitudes_that_cancel_out_have_no_mean(spark):
    ring = [("ring", round(i * 3.6 - 180, 10)) for i in range(100)]
    rows = [*ring, ("pair", -90.0), ("pair", 90.0), ("date line", 170.0), ("date line", -170.0), ("most", 90.0), *[("most", x) for _, x in ring]]
    df = spark.createDataFrame(rows, "k string, lon double")
    out = {r["k"]: r["lon"] for r in df.groupBy("k").agg(circular_mean_longitude(F.col("lon")).alias("lon")).collect()}
    assert out["ring"] is None and out["pair"] is None and out["date line"] == -180.0 and out["most"] == pytest.approx(90.0)


def test_full_rings_and_the_date_line_agree_with_sql(spark, tmp_path):
    """Of each day and row: all longitudes, all but a few, and pairs about the date line."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(1000 * day + x, f"2024-01-0{day} 01:00:00", 15 * x + y, 1.0) for day in range(1, 5) for y in range(15) for x in range(100) if day == 1 or (day == 2 and x % 5) or (day == 3 and x % (y + 7)) or (day == 4 and x in (y, 100 - y))]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()["a13_circular_mean"](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()["a13_circular_mean"]).select(*got.columns).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert sum(lon is None for _, _, lon in want) >= 30 and sum(lon == -180 for _, _, lon in want) >= 14
