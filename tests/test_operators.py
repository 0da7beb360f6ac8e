"""Operators on small tables with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skylattice.functions import encode, geo
from skylattice.operators import aggregates, grid, joins, manifests, motion, revisions, spectral, timeseries, topk, tracks
from skylattice.plans import lifecycle, survey
from skylattice.sources import mapfiles, tables
from skylattice.sources.mapfiles import MapFileError, parse_map_file


def test_polygon_boundary_counts_inside(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    points = spark.createDataFrame([(5.0, 5.0), (0.0, 5.0), (10.0, 10.0), (10.1, 5.0), (-0.1, 0.0)], "lat double, lon double")
    got = [r[0] for r in points.select(geo.in_polygon(F.col("lat"), F.col("lon"), square)).collect()]
    assert got == [True, True, True, False, False]
    with pytest.raises(ValueError):
        geo.in_polygon(F.col("lat"), F.col("lon"), [(0, -100), (0, 100), (1, 0)])


def test_longitude_is_wrapped(spark):
    rows = spark.createDataFrame([(180.0,), (-180.0,), (540.0,), (190.0,), (-0.0,), (359.99999999999,)], "x double")
    got = [r[0] for r in rows.select(geo.canonical_longitude(F.col("x"))).collect()]
    assert got == [-180.0, -180.0, -180.0, -170.0, 0.0, 0.0]
    assert math.copysign(1, got[4]) == 1


def test_regional_readout_flags_and_rejects(spark):
    rows = [("a", 10.0, ["x"]), ("a", 20.0, []), ("a", 90.0, ["bad"]), ("b", None, []), ("c", 5.0, [])]
    df = spark.createDataFrame(rows, "k string, v double, flags array<string>")
    got = {r["k"]: r for r in aggregates.regional_readout(df, ["k"], "v", "flags", ["bad"], 4).collect()}
    assert (got["a"]["mean_v"], got["a"]["median_v"], got["a"]["cell_count"], got["a"]["coverage"]) == (15.0, 15.0, 2, 0.5)
    assert got["a"]["flags"] == ["excluded_cell:bad", "excluded_cells", "low_coverage", "missing_cells", "x"]
    assert got["a"]["reject_reason"] is None and got["b"]["reject_reason"] == "no_usable_cell" and got["c"]["reject_reason"] == "coverage_below_minimum"


def test_best_revision_and_as_of(spark):
    rows = [(1, 0, 1, "a", 1.0), (1, 20, 2, "b", 2.0), (1, 5, 9, "c", 3.0)]
    df = spark.createDataFrame(rows, "epoch int, revision_priority int, ingested_at int, artifact_id string, v double")
    assert revisions.best_revision(df, ["epoch"]).first()["v"] == 2.0
    assert revisions.as_of(df, ["epoch"], F.lit(1), ["ingested_at"]).first()["v"] == 1.0


def test_insert_outcomes_and_unseen(spark):
    held = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "k int, v string")
    got = sorted((r["k"], r["v"] or "", r["outcome"]) for r in revisions.split_inserts(new, held, ["k"], ["v"]).collect())
    assert got == [(1, "a", "same"), (1, "b", "conflict"), (2, "", "same"), (3, "c", "insert")]
    assert sorted(r["k"] for r in revisions.unseen(new, held, ["k", "v"]).collect()) == [1, 3]


def test_chain_tips(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None)], "id string, sup string")
    assert sorted(r["id"] for r in revisions.chain_tips(df, "id", "sup").collect()) == ["c", "x"]


def test_frame_conflicts_ignore_row_order(spark):
    rows = [(1, "f", 1, 1.0), (1, "f", 2, 2.0), (1, "g", 2, 2.0), (1, "g", 1, 1.0), (2, "f", 1, 1.0), (2, "g", 1, 5.0)]
    df = spark.createDataFrame(rows, "t int, frame string, cell int, v double")
    got = {r["t"]: r["conflict"] for r in revisions.frame_conflicts(df, "t", "frame", ["cell"], "v").collect()}
    assert got == {1: False, 2: True}


def test_as_of_join_carries_ties(spark):
    left = spark.createDataFrame([("k", 5), ("k", 0), ("z", 9)], "key string, t int")
    right = spark.createDataFrame([("k", 1, 1.0), ("k", 5, 2.0), ("k", 5, 3.0), ("k", 6, 9.0)], "key string, at int, v double")
    got = {(r["key"], r["t"]): (r["matched_v"], r["ties"]) for r in joins.as_of_join(left, right, ["key"], "t", "at", ["v"]).collect()}
    assert got == {("k", 5): (3.0, 2), ("k", 0): (None, None), ("z", 9): (None, None)}


def test_interval_overlap_is_half_open(spark):
    left = spark.createDataFrame([("a", 7200, 10800), ("b", 10800, 10800), ("c", 90000, 90001)], "id string, s long, e long")
    context = spark.createDataFrame([(0, 7.0), (10800, 2.0)], "t long, kp double")
    got = {r["id"]: (r["max_value"], r["n_matches"], r["status"]) for r in joins.overlap_join(left, context, "s", "e", "t", 10800, "kp", "id").collect()}
    assert got == {"a": (7.0, 2, "available"), "b": (2.0, 1, "available"), "c": (None, 0, "unavailable")}


def test_bilinear_centre_exact_node_and_missing_corner(spark):
    lats, lons = [0.0, 10.0], [-180.0, -90.0, 0.0, 90.0]
    obs = spark.createDataFrame([(0, i, j, 2 * lats[i] + (lons[j] + 180) / 10) for i in range(2) for j in range(4)], "epoch int, iy int, ix int, v double")
    corners = grid.corner_table(spark, lats, lons, 10.0, 90.0, [0.0, 5.0, 10.0], [-180.0, -135.0, -90.0])
    got = {(r["target_lat"], r["target_lon"]): (r["v"], r["corners"]) for r in grid.interpolate(obs, ["epoch"], corners, "v").collect()}
    assert len(got) == 9 and got[5.0, -135.0] == (14.5, 4) and got[0.0, -180.0] == (0.0, 1)
    holed = grid.interpolate(obs.where("NOT (iy = 1 AND ix = 1)"), ["epoch"], corners, "v")
    bad = {(r["target_lat"], r["target_lon"]) for r in holed.where("reject_reason = 'missing_corner'").collect()}
    assert (5.0, -135.0) in bad and (0.0, -180.0) not in bad


def test_refined_grid_keeps_native_nodes(spark):
    obs = spark.createDataFrame([(0, y, x, float(10 * y + x), 1 << y) for y in range(3) for x in range(4)], "epoch int, iy int, ix int, v double, mask long")
    got = {(r["ty"], r["tx"]): (r["v"], r["mask"]) for r in grid.refine(obs, ["epoch"], "v", "mask", 3, 4, 5, 10).collect()}
    assert len(got) == 11 * 40 and got[5, 20] == (12.0, 2) and got[0, 35][0] == pytest.approx(1.5) and got[3, 0] == (pytest.approx(6.0), 3)


def test_axis_status(spark):
    df = spark.createDataFrame([("r", x) for x in (0.0, 5.0, 10.0)] + [("c", x) for x in (0.0, 5.0, 100.0, 105.0)] + [("a", 1.0)], "k string, x double")
    assert {r["k"]: r["status"] for r in grid.axis(df, ["k"], "x").collect()} == {"r": "regular", "c": "cut", "a": "ambiguous"}


def test_smoothing_keeps_constants_and_masks(spark):
    cells = [(0, y, x, None if (y, x) == (2, 2) else 3.0) for y in range(6) for x in range(6)]
    df = spark.createDataFrame(cells, "t int, iy int, ix int, v double")
    got = {(r["iy"], r["ix"]): r["v_smooth"] for r in grid.smooth(df, ["t"], ["v"], 1.0, 6, 6, 0.5).collect()}
    assert got[2, 2] is None and all(v == pytest.approx(3.0) for k, v in got.items() if k != (2, 2))


def test_derivatives_of_a_plane(spark):
    df = spark.createDataFrame([(0, y, x, 4.0 * x + 6.0 * y) for y in range(5) for x in range(5)], "t int, iy int, ix int, v double")
    for r in grid.spatial_derivatives(df, ["t"], "v", 3.0, 2.0).collect():
        assert (r["d_dx"], r["d_dy"]) == (pytest.approx(2.0), pytest.approx(2.0))


def test_motion_recovers_a_translation(spark):
    def blob(y, x, shift):
        return math.exp(-((x - 10 - shift) ** 2 + (y - 10) ** 2) / 18) * 10

    rows = [(t, y, x, blob(y, x, 0.5 * t)) for t in (0, 1) for y in range(21) for x in range(21)]
    df = spark.createDataFrame(rows, "t int, iy int, ix int, v double")
    flow = motion.feature_flow(motion.frame_pairs(df, [], "t", "v", 1.0), ["t"], 1.0, 1.0, 2.0, 21, 21)
    near = flow.where("iy BETWEEN 7 AND 13 AND ix BETWEEN 7 AND 13").agg(F.avg("u"), F.avg("v")).first()
    assert near[0] == pytest.approx(0.5, abs=0.08) and near[1] == pytest.approx(0.0, abs=0.05)


def test_growth_is_ambiguous(spark):
    rows = [(t, y, x, (1 + 0.3 * t) * (x + 2.0 * y) + t) for t in (0, 1) for y in range(4) for x in range(4)]
    pairs = motion.frame_pairs(spark.createDataFrame(rows, "t int, iy int, ix int, v double"), [], "t", "v", 1.0)
    got = motion.growth_ambiguity(pairs, ["t"]).first()
    assert got["gain"] == pytest.approx(1.3) and got["ambiguity"] == pytest.approx(1.0)


def test_wave_is_found(spark):
    rows = [(t, y, x, math.cos(2 * math.pi * (t / 8 - x / 10))) for t in range(32) for y in range(5) for x in range(10)]
    df = spark.createDataFrame(rows, "t int, iy int, ix int, v double").withColumn("region", F.lit("a"))
    waves = [(kx / 10, ky / 10) for kx in (-2, -1, 1, 2) for ky in (-1, 0, 1)]
    power = spectral.wave_power(spectral.detrended(df, ["region"], "t", "v"), ["region"], "t", "residual", [4.0, 8.0, 16.0], waves, 1.0, 1.0)
    peak = spectral.wave_peak(power, ["region"]).first()
    assert peak["period"] == pytest.approx(8.0) and peak["wavelength"] == pytest.approx(10.0) and peak["bearing"] == pytest.approx(90.0)


def test_savgol_keeps_a_quadratic(spark):
    df = spark.createDataFrame([("a", t, 1.0 + 2 * t + 0.5 * t * t) for t in range(12)], "k string, t int, v double")
    for r in timeseries.savgol(df, ["k"], "t", "v", 5, 2).collect():
        assert r["baseline"] == pytest.approx(r["v"])
    holed = timeseries.savgol(df.withColumn("v", F.when(F.col("t") != 6, F.col("v"))), ["k"], "t", "v", 5, 2)
    assert {r["t"] for r in holed.where("baseline IS NULL").collect()} == {4, 5, 6, 7, 8}
    assert timeseries.savgol_weights(5, 2)[2] == pytest.approx(np.array([-3, 12, 17, 12, -3]) / 35)


def test_regular_slots_and_fill(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.9), ("a", 6, 4.0, 0.9)], "k string, t int, v double, c double")
    got = [(r["t"], r["v"], r["c"], r["carried"]) for r in timeseries.regular_slots(df, ["k"], "t", 2, ["v"], "c").orderBy("t").collect()]
    assert got == [(0, 1.0, 0.9, False), (2, 1.0, 1e-6, True), (4, 1.0, 1e-6, True), (6, 4.0, 0.9, False)]
    line = [r["v"] for r in timeseries.fill_axis(df, ["k"], "t", "v", 2, 6).orderBy("t").collect()]
    assert line == pytest.approx([1.0, 2.0, 3.0, 4.0])
    held = [r["v"] for r in timeseries.fill_axis(df, ["k"], "t", "v", 2, 2, causal=True).orderBy("t").collect()]
    assert held == [1.0, 1.0, None, 4.0]


def test_causal_results_ignore_the_future(spark):
    df = spark.createDataFrame([("a", t, float((7 * t) % 5)) for t in range(20)], "k string, t int, v double")
    w = Window.partitionBy("k").orderBy("t")
    for f in (
        lambda d: timeseries.recurrence(d, ["k"], "t", "v"),
        lambda d: timeseries.expanding_score(d, ["k"], "t", "v"),
        lambda d: d.withColumn("m", timeseries.rolling_median("v", w, 2, causal=True)),
    ):
        early = f(df.where("t < 12")).orderBy("t").collect()
        assert early == f(df).where("t < 12").orderBy("t").collect()


def test_spike_is_a_candidate(spark):
    values = [18 + 5 * math.sin(2 * math.pi * i / 12) for i in range(60)]
    values[50] += 75
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, v double")
    assert [r["t"] for r in timeseries.recurrence(df, ["k"], "t", "v").where("candidate").collect()] == [50]


def test_ridge_fit(spark):
    df = spark.createDataFrame([("a", float(x), 3.0 + 2.0 * x) for x in range(10)], "k string, x double, y double")
    got = aggregates.ridge_fit(df, ["k"], ["x"], "y", 0.0).first()
    assert (got["intercept"], got["x"], got["n"]) == (pytest.approx(3.0), pytest.approx(2.0), 10)


def test_components_wrap_only_on_a_ring(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 5), (0, 2, 2)], "t int, iy int, ix int")
    assert tracks.frame_components(df, ["t"]).select("blob").distinct().count() == 3
    assert tracks.frame_components(df, ["t"], ring=6).select("blob").distinct().count() == 2


def _survey_history(spark, bump):
    rows = []
    for d in range(8):
        for slot in range(4):
            for y in range(5):
                for x in range(6):
                    rows.append((d, d * 86400 + slot * 21600, slot, y, x, 20.0 + 2.5 * y, -110.0 + 5 * x, 20 + 3 * math.sin(math.pi / 2 * slot) + bump(d * 4 + slot, y, x), 1.0))
    return spark.createDataFrame(rows, "day int, epoch int, slot int, iy int, ix int, lat double, lon double, v double, rms double")


def test_survey_quiet_and_bump(spark):
    quiet = survey.deviations(_survey_history(spark, lambda i, y, x: 0.0))
    start = 7 * 86400 - 1.0
    assert survey.flagged(quiet, start).count() == 0
    assert survey.survey_status(quiet, start).first()["status"] == "complete"
    dev = survey.deviations(_survey_history(spark, lambda i, y, x: 12.0 if i >= 29 and y == 0 and x < 2 else 0.0))
    found = survey.candidates(survey.flagged(dev, start), 21600.0).collect()
    assert len(found) == 1
    c = found[0]
    assert (c["cells"], c["epochs"], c["duration"], c["peak_deviation"], c["peak_score"], c["polarity"]) == (2, 3, 43200, 12.0, 6.0, 1)


def test_track_breaks_at_a_gap(spark):
    cells = spark.createDataFrame([(t, 1, 0, x, x) for t in (0, 1, 5, 6) for x in (0, 1)], "t int, polarity int, iy int, ix int, b int").withColumn("blob", F.lit(0).cast("long")).drop("b")
    linked = tracks.link_tracks(cells, "t", "polarity", 1.0)
    assert linked.select("track").distinct().count() == 2


def test_overlap_suppression(spark):
    rows = [("s", -9.0, [1, 2, 3, 4]), ("s", -8.0, [3, 4]), ("s", -7.0, [9]), ("s", -6.0, [4, 5, 6, 7, 8])]
    got = tracks.suppress_overlaps(spark.createDataFrame(rows, "scan string, rank double, cells array<int>"), "scan", "rank", "cells")
    assert sorted(r["rank"] for r in got.collect()) == [-9.0, -7.0, -6.0]


def test_set_comparison_of_nothing(spark):
    none = spark.createDataFrame([], "t int")
    got = topk.compare_sets(none, none, ["t"]).first()
    assert (got["both"], got["only_a"], got["only_b"], got["overlap"]) == (0, 0, 0, 1.0)


def test_lifecycle(spark):
    rows = [("s", "2026-01-02 02:00:00", 10.0), ("s", "2026-01-02 04:00:00", 10.0)]
    forecasts = spark.createDataFrame(rows, "series string, valid_at string, predicted double").withColumn("valid_at", F.col("valid_at").cast("timestamp")).withColumn("forecast_id", F.col("valid_at").cast("string"))
    actual = [("s", "2026-01-02 02:00:00", 20.0, 0.9, "2026-01-02 02:05:00", 0, "a1"), ("s", "2026-01-02 02:00:00", 10.0, 0.9, "2026-01-02 09:00:00", 5, "a2")]
    actuals = spark.createDataFrame(actual, "series string, observed_at string, value double, coverage double, ingested_at string, revision_priority int, artifact_id string")
    actuals = actuals.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    at = lambda s: F.lit(s).cast("timestamp")

    def decided(now):
        return lifecycle.decide(lifecycle.match_actuals(forecasts, actuals, ["series"], at(now)), F.lit(0.0), F.lit(2.0), 3.0)

    early = lifecycle.reconcile(decided("2026-01-02 05:00:00"), at("2026-01-02 05:00:00"), at("2026-01-02 05:00:00"))
    got = {r["predicted"] and r["valid_at"].hour: (r["status"], r["residual"], r["anomaly_score"], r["assessment"]) for r in early.collect()}
    assert got == {2: ("SCORED", 10.0, 5.0, "candidate"), 4: ("PENDING", None, None, None)}
    late = lifecycle.reconcile(decided("2026-01-02 11:00:00"), at("2026-01-02 11:00:00"), at("2026-01-02 11:00:00"))
    assert {r["valid_at"].hour: r["status"] for r in late.collect()} == {2: "SCORED", 4: "INSUFFICIENT_DATA"}
    first = decided("2026-01-02 05:00:00").where("usable").withColumn("decision_id", F.lit("d1")).withColumn("decided_at", F.lit(1))
    new = lifecycle.reassess(first.select("forecast_id", "decision_id", "decided_at", "actual_id"), decided("2026-01-02 11:00:00")).collect()
    assert [(r["actual_id"], r["supersedes_decision_id"], r["assessment"]) for r in new] == [("a2", "d1", "normal")]
    assert lifecycle.reassess(first.select("forecast_id", "decision_id", "decided_at", "actual_id"), decided("2026-01-02 05:00:00")).count() == 0


def test_manifest_ignores_order_and_finds_changes(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "d int, v double")
    m = manifests.snapshot_manifest(df, "d")
    assert manifests.verify_manifest(df.orderBy(F.desc("v")), m, "d").count() == 0
    changed = spark.createDataFrame([(1, 2.0), (1, 4.0), (3, 5.0)], "d int, v double")
    assert {(r["d"], r["reason"]) for r in manifests.verify_manifest(changed, m, "d").collect()} == {(1, "differs"), (2, "missing"), (3, "unlisted")}


def test_flag_masks(spark):
    df = spark.createDataFrame([(["b", "a"],), ([],)], "f array<string>")
    got = [(r[0], r[1]) for r in df.select(encode.flag_mask(F.col("f"), ["c", "b", "a"]), encode.flags_of_mask(encode.flag_mask(F.col("f"), ["c", "b", "a"]), ["c", "b", "a"])).collect()]
    assert got == [(3, ["a", "b"]), (0, [])]


def _line(body, label):
    return f"{body:<60}{label}"


def _map_file(values, epochs=("  2024     1     1     0     0     0",)):
    head = [_line(f"{'     1.0':<20}I", "IONEX VERSION / TYPE"), _line(f"{len(epochs):6d}", "# OF MAPS IN FILE"), _line("     2", "MAP DIMENSION"), _line("   450.0 450.0   0.0", "HGT1 / HGT2 / DHGT")]
    lines = [*head, _line("    32.5  31.5  -1.0", "LAT1 / LAT2 / DLAT"), _line("  -100.0 -98.0   1.0", "LON1 / LON2 / DLON"), _line("    -1", "EXPONENT"), _line("", "END OF HEADER")]
    for n, epoch in enumerate(epochs, 1):
        lines += [_line(f"{n:6d}", "START OF TEC MAP"), _line(epoch, "EPOCH OF CURRENT MAP")]
        for lat, row in zip((32.5, 31.5), values, strict=True):
            lines += [_line(f"  {lat:6.1f}-100.0 -98.0   1.0 450.0", "LAT/LON1/LON2/DLON/H"), "".join(f"{v:5d}" for v in row)]
        lines.append(_line(f"{n:6d}", "END OF TEC MAP"))
    return "\n".join([*lines, _line("", "END OF FILE")]).encode()


def test_map_file_values_and_errors():
    got = parse_map_file(_map_file([[100, 9999, 300], [1, 2, 3]]))
    assert [(c[3], c[4], c[5]) for c in got] == [(32.5, -100.0, 10.0), (32.5, -98.0, 30.0), (31.5, -100.0, 0.1), (31.5, -99.0, 0.2), (31.5, -98.0, 0.3)]
    twice = ("  2024     1     1     2     0     0", "  2024     1     1     0     0     0")
    with pytest.raises(MapFileError, match="maps_not_in_time_order"):
        parse_map_file(_map_file([[1, 2, 3], [1, 2, 3]], twice))
    with pytest.raises(MapFileError, match="too_many_values"):
        parse_map_file(_map_file([[1, 2, 3, 4], [1, 2, 3]]))


def test_broken_map_files_become_rejects(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes(_map_file([[100, 9999, 300], [1, 2, 3]]))
    (tmp_path / "bad.txt").write_bytes(b"nothing here")
    cells, rejects = mapfiles.load_map_files(spark, str(tmp_path))
    assert cells.count() == 5 and [r["reason"] for r in rejects.collect()] == ["no_version_record"]


def test_context_series_rejects(spark):
    rows = [("a", '[{"time_tag": "2026-01-01T00:00:00", "Kp": 7}, {"time_tag": "2026-01-01T03:00:00", "Kp": 12}]'), ("b", '[["time_tag", "Kp"], ["2026-01-01T00:00:00", "2"], ["2026-01-01T00:00:00", "3"]]')]
    good, bad = tables.context_series(spark.createDataFrame(rows, "source string, text string"))
    assert [(r["source"], r["kp"]) for r in good.collect()] == [("a", 7.0)]
    assert sorted((r["source"], r["reason"]) for r in bad.collect()) == [("a", "kp_out_of_range"), ("b", "conflicting_values"), ("b", "conflicting_values")]


def test_archive_refuses_changed_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "d int, v double")
    tables.write_archive(df, str(tmp_path / "x"), "d")
    spark.createDataFrame([(9.0,)], "v double").write.mode("append").parquet(str(tmp_path / "x/data/d=2"))
    rows, refused = tables.read_archive(spark, str(tmp_path / "x"), df.schema, "d")
    assert [tuple(r) for r in rows.collect()] == [(1, 2.0)] and [r["d"] for r in refused.collect()] == [2]


def test_file_names_of_both_eras(spark):
    names = {str(r["day"]): r["file"] for r in tables.product_calendar(spark, "2022-11-25", "2022-11-26").collect()}
    assert names == {"2022-11-25": "CODG3290.22I.Z", "2022-11-26": "COD0OPSFIN_20223300000_01D_01H_GIM.INX.gz"}


def test_rank_correlation_with_ties(spark):
    df = spark.createDataFrame([(float(i % 7), float((i * i) % 11)) for i in range(200)], "x double, y double")
    pdf = df.toPandas()
    assert aggregates.rank_correlation(df, "x", "y").first()["rho"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    ordered = spark.range(1000).select(F.col("id").cast("double").alias("k"), F.lit(2).alias("n"))
    got = aggregates.running_total(ordered, "k", "n", "before", ranges=8).where("before <> 2 * k").count()
    assert got == 0


def _map_text(version="     1.0", kind="I", count="     1", dimension="     2", heights=("450.0", "450.0"), rows=(10.0, 0.0), aux=()):
    label = lambda body, name: f"{body:<60}{name}"
    head = [label(f"{version:<20}{kind}", "IONEX VERSION / TYPE"), label(count, "# OF MAPS IN FILE"), label(dimension, "MAP DIMENSION"), label(f"  {heights[0]:>6}{heights[1]:>6}   0.0", "HGT1 / HGT2 / DHGT")]
    head += [label("    10.0   0.0 -10.0", "LAT1 / LAT2 / DLAT"), label("     0.0  10.0  10.0", "LON1 / LON2 / DLON"), *aux, label("", "END OF HEADER")]
    body = [label("     1", "START OF TEC MAP"), label("  2024     1     1     0     0     0", "EPOCH OF CURRENT MAP")]
    for lat in rows:
        body += [label(f"  {lat:6.1f}   0.0  10.0  10.0 450.0", "LAT/LON1/LON2/DLON/H"), "   10   20"]
    return "\n".join([*head, *body, label("     1", "END OF TEC MAP"), label("", "END OF FILE")]).encode()


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"version": "     3.0"}, "unknown_version_or_type"), ({"kind": "X"}, "unknown_version_or_type"), ({"count": "     2"}, "other_number_of_maps"), ({"dimension": "     3"}, "not_two_dimensional"), ({"heights": ("350.0", "450.0")}, "more_than_one_height"),
        ({"rows": (10.0,)}, "latitude_rows_missing"), ({"rows": (0.0, 10.0)}, "latitude_rows_missing"), ({"aux": (f"{'BIASES':<60}START OF AUX DATA",)}, "auxiliary_block_open"), ({"aux": (f"{'BIASES':<60}START OF AUX DATA", f"{'OTHERS':<60}END OF AUX DATA")}, "auxiliary_block_ends_otherwise"),
    ],
)
def test_map_file_headers(change, reason):
    from skylattice.sources.mapfiles import MapFileError, parse_map_file

    assert len(parse_map_file(_map_text())) == 4
    assert len(parse_map_file(_map_text(aux=(f"{'BIASES':<60}START OF AUX DATA", "   G01  -1.5", f"{'BIASES':<60}END OF AUX DATA")))) == 4
    with pytest.raises(MapFileError) as e:
        parse_map_file(_map_text(**change))
    assert e.value.reason == reason


def test_streams_over_several_batches_and_a_restart(spark, tmp_path):
    """Late, repeated and revised rows in later batches; the second run goes on from the checkpoint of the first."""
    import datetime as dt

    import pandas as pd

    from skylattice.operators.timeseries import fold_series
    from skylattice.streaming import streams

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    feeds = [[(1, at(0), 1.0), (1, at(1), 2.0), (2, at(1), 5.0)], [(1, at(1), 2.0), (1, at(30), 4.0), (2, at(30), 6.0)], [(1, at(29), 9.0), (1, at(31), 3.0), (2, at(2), 7.0), (2, at(80), 8.0)]]
    schema, source = "k long, ts timestamp, v double", str(tmp_path / "in")
    runs = {
        "all": lambda s, out, mark: streams.append_once(s, out, mark), "unique": lambda s, out, mark: streams.run_to_table(streams.deduplicate(s, "ts", ["k", "ts"], "10 hours"), out, mark),
        "windows": lambda s, out, mark: streams.run_to_table(streams.tumbling_readout(s, "ts", "v", "2 hours", "10 hours"), out, mark), "folded": lambda s, out, mark: streams.run_to_table(streams.recurrence_stream(s, "k", "ts", "v", "10 hours"), out, mark),
    }
    got = {}
    for n, feed in enumerate(feeds):
        spark.createDataFrame(feed, schema).coalesce(1).write.mode("append").parquet(source)
        if n:  # the first run has two files, a batch each; the second goes on with the third
            for name, run in runs.items():
                stream = streams.read_stream(spark, source, spark.createDataFrame([], schema).schema, files=1)
                got[name] = [tuple(r) for r in run(stream, str(tmp_path / name), str(tmp_path / f"{name}-mark")).collect()]
    assert sorted(got["all"]) == sorted(r for f in feeds for r in f)
    assert sorted(got["unique"]) == sorted({r for f in feeds for r in f} - {(2, at(2), 7.0)})  # too late to be told apart
    windows = {r[0]: r[2:] for r in got["windows"]}
    assert windows[at(0)] == (4, 2.5, 2.0) and windows[at(30)] == (3, pytest.approx(13 / 3), 4.0) and windows[at(28)] == (1, 9.0, 9.0)
    assert at(2) not in windows and at(80) not in windows
    folded = pd.DataFrame(got["folded"], columns=["k", "ts", "v", "forecast", "score", "late"])
    assert sorted(folded[folded.late]["v"]) == [7.0, 9.0] or sorted(folded[folded.late]["v"]) == [9.0]
    mine = folded[(folded.k == 1) & ~folded.late].sort_values("ts", kind="stable")
    assert mine["forecast"].tolist() == pytest.approx(fold_series(mine["v"].to_numpy(), 0.9, 0.5)[0])


def test_late_rows_score_their_days_again(spark, tmp_path):
    import datetime as dt

    from skylattice.streaming import streams

    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    feeds = [[(1, at(0), 1.0), (2, at(1), 2.0)], [(3, at(12), 4.0), (4, at(13), 6.0)], [(5, at(12), 8.0), (6, at(0), 100.0)]]
    source, schema = str(tmp_path / "in"), "k long, ts timestamp, v double"
    score = lambda rows: rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    for feed in feeds:
        spark.createDataFrame(feed, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        scores, beyond = streams.rescore_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark"), "ts", score, overlap=10)
    assert {r["day"] - 19723: (r["n"], r["total"]) for r in scores.collect()} == {0: (1, 1.0), 1: (1, 2.0), 12: (2, 12.0), 13: (1, 6.0)}
    assert [r["day"] - 19723 for r in beyond.collect()] == [0]


def test_same_hour_baseline_slides(spark, tmp_path):
    import datetime as dt

    from skylattice.streaming import streams

    rows = [(1, dt.datetime(2024, 1, d, 5), float(d)) for d in range(1, 12)] + [(1, dt.datetime(2024, 1, 11, 6), 50.0), (None, dt.datetime(2024, 1, 11, 5), 3.0)]
    source, schema = str(tmp_path / "in"), "k long, ts timestamp, v double"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_stream(spark, source, spark.createDataFrame([], schema).schema)
    out = streams.against_same_hour(stream, str(tmp_path / "out"), str(tmp_path / "mark"), ["k"], "ts", "v").collect()
    got = {(r["k"], r["ts"].day, r["ts"].hour): r["deviation"] for r in out}
    assert len(out) == len(rows) and got[1, 1, 5] is None and got[1, 11, 6] is None and got[None, 11, 5] is None
    assert got[1, 3, 5] == 1.5 and got[1, 11, 5] == 4.0 and got[1, 8, 5] == 4.0


def test_growth_is_ambiguous_around_each_cell(spark):
    rows = [(t, y, x, (1 + 0.3 * t) * (x * x + 2.0 * y) + t) for t in (0, 1) for y in range(8) for x in range(8)]
    pairs = motion.frame_pairs(spark.createDataFrame(rows, "t int, iy int, ix int, v double"), [], "t", "v", 1.0)
    got = motion.local_ambiguity(pairs, ["t"], 1.0, 8, 8, 0.5, 0.95).collect()
    assert len(got) == 64 and all(r["gain"] == pytest.approx(1.3) and r["ambiguity"] == pytest.approx(1.0, abs=1e-6) for r in got)
    still = motion.local_ambiguity(pairs.withColumn("current", F.col("previous")), ["t"], 1.0, 8, 8, 0.5, 0.95)
    assert {r["explained"] for r in still.collect()} == {0.0}


def test_windowed_wave_keeps_amplitude_and_phase(spark):
    rows = [(t, y, x, 3 * math.cos(2 * math.pi * (t / 8 - x / 10) - 0.7)) for t in range(33) for y in range(5) for x in range(10)]
    df = spark.createDataFrame(rows, "t int, iy int, ix int, v double").withColumn("region", F.lit("a"))
    waves = [(kx / 10, ky / 10) for kx in (-2, -1, 1, 2) for ky in (-1, 0, 1)]
    peak = spectral.wave_peak(spectral.wave_power(spectral.hann(df, ["region"], "t"), ["region"], "t", "v", [4.0, 8.0, 16.0], waves, 1.0, 1.0, "hann"), ["region"]).first()
    assert peak["amplitude"] == pytest.approx(3.0) and peak["phase"] == pytest.approx(0.7) and peak["uniqueness"] > 0.99


def test_metric_grid_stays_near_its_centre():
    assert len(grid.metric_targets(0.0, 0.0, 1_000_000, 500_000)) == 25
    with pytest.raises(ValueError):
        grid.metric_targets(0.0, 0.0, 2_600_000, 500_000)
    with pytest.raises(ValueError):
        grid.metric_targets(0.0, 0.0, 2_000_000, 500_000, scale_error=0.02)


def test_event_scores(spark):
    from skylattice.plans.fields import event_scores

    names = "support anomaly temporal gradient coherence front_elongation elongation compactness share speed flow_confidence residual growth wave".split()
    rows = [
        (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, False), (2, 1.0, 0.9, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, False),
        (3, 1.0, 0.9, 0.1, 0.9, 0.9, 5.0, 1.0, 0.1, 0.5, 0.1, 0.1, None, 0.0, 0.0, True), (4, 0.2, 0.1, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, False),
        (5, 1.0, 0.5, 0.5, 0.1, 0.5, 1.0, 1.0, 0.1, 0.5, 0.9, 0.9, 0.0, 0.0, 0.0, True),
    ]
    df = spark.createDataFrame(rows, "day int, " + ", ".join(f"{n} double" for n in names) + ", border boolean")
    got = {r["day"]: r for r in event_scores(df).collect()}
    assert [got[d]["label"] for d in range(1, 6)] == ["quiet", "localized", "front", "uncertain", "flow"]
    assert got[1]["quiet"] == got[1]["margin"] == 1.0 and got[2]["localized"] == pytest.approx(0.9) and got[4]["uncertain"] == pytest.approx(0.8) and got[5]["flow"] == pytest.approx(0.81)
