"""Map files that are cut, headless or out of order are rejects with a line and a reason, never part of the cells."""

import gzip

import pytest

from skylattice.sources.mapfiles import MapFileError, load_map_files, map_file_texts, parse_map_file


def record(body, label):
    return f"{body:<60}{label}"


HEAD = [
    record(f"{'     1.0':<20}I", "IONEX VERSION / TYPE"), record("     2", "# OF MAPS IN FILE"), record("     2", "MAP DIMENSION"), record("   450.0 450.0   0.0", "HGT1 / HGT2 / DHGT"),
    record("    10.0   0.0 -10.0", "LAT1 / LAT2 / DLAT"), record("     0.0  20.0  10.0", "LON1 / LON2 / DLON"), record("    -1", "EXPONENT"), record("made by hand", "COMMENT"), record("", "END OF HEADER"),
]


def block(number, hour, kind="TEC", first=(1, 2, 3), extra=()):
    out = [record(f"{number:6d}", f"START OF {kind} MAP"), record(f"  2024     1     1{hour:6d}     0     0", "EPOCH OF CURRENT MAP"), *extra]
    for lat, values in ((10.0, first), (0.0, (4, 5, 9999))):
        out += [record(f"  {lat:6.1f}   0.0  20.0  10.0 450.0", "LAT/LON1/LON2/DLON/H"), "".join(f"{v:5d}" for v in values)]
    return [*out, record(f"{number:6d}", f"END OF {kind} MAP")]


WHOLE = [*HEAD, *block(1, 0), *block(2, 2), record("", "END OF FILE")]


def text(lines):
    return "\n".join(lines).encode()


def without(label):
    return [x for x in WHOLE if not x.endswith(label)]


def changed(label, body):
    return [record(body, label) if x.endswith(label) else x for x in WHOLE]


def reason(lines):
    with pytest.raises(MapFileError) as e:
        parse_map_file(text(lines))
    return e.value.reason


def test_a_whole_file():
    assert len(parse_map_file(text(WHOLE))) == 10 and len(parse_map_file(gzip.compress(text(WHOLE)))) == 10
    assert len(parse_map_file(text([*WHOLE[:-1], *block(1, 0, "RMS"), *block(1, 0, "HGT"), WHOLE[-1], ""]))) == 15


def test_every_cut_is_a_reject():
    """A download that stops anywhere: after each line, and in the middle of each line but the last."""
    for n in range(len(WHOLE)):
        reason(WHOLE[:n])
    body = text(WHOLE)
    for n in range(0, body.rindex(b"END OF FILE"), 7):
        with pytest.raises(MapFileError):
            parse_map_file(body[:n])


@pytest.mark.parametrize(
    "lines, said",
    [
        (WHOLE[:13], "file_ends_in_a_map"), (WHOLE[:12], "file_ends_in_a_row"), (WHOLE[:-1], "no_end_of_file"), (WHOLE[:5], "no_end_of_header"), ([], "empty_file"),
        (without("END OF HEADER"), "no_end_of_header"), (without("IONEX VERSION / TYPE"), "no_version_record"), (changed("IONEX VERSION / TYPE", "     1.0"), "unknown_version_or_type"),
        (without("MAP DIMENSION"), "header_record_missing"), (without("HGT1 / HGT2 / DHGT"), "header_record_missing"), (without("# OF MAPS IN FILE"), "header_record_missing"),
        (changed("# OF MAPS IN FILE", "     0"), "no_maps"), (changed("HGT1 / HGT2 / DHGT", "   450.0 450.0  50.0"), "more_than_one_height"), (changed("# OF MAPS IN FILE", "     3"), "other_number_of_maps"),
        ([*HEAD, *block(1, 0), *block(1, 2), WHOLE[-1]], "map_number_twice"), ([*HEAD, *block(1, 2), *block(2, 0), WHOLE[-1]], "maps_not_in_time_order"),
        ([*HEAD, *block(1, 0)[:-1], record("     7", "END OF TEC MAP"), *block(2, 2), WHOLE[-1]], "map_ends_otherwise"), ([*HEAD, *block(1, 0)[:-1], *block(2, 2), WHOLE[-1]], "record_not_of_a_map"),
        ([*HEAD, *block(1, 0)[:-3], block(1, 0)[-1], *block(2, 2), WHOLE[-1]], "latitude_rows_missing"), ([*WHOLE, *block(3, 4)], "records_after_the_end"), ([*HEAD[:-1], HEAD[1], *WHOLE[8:]], "header_record_twice"),
        ([*HEAD, block(1, 0)[0], *block(1, 0)[2:], *block(2, 2), WHOLE[-1]], "map_without_epoch"), ([*WHOLE[:-1], *block(5, 0, "RMS"), WHOLE[-1]], "rms_epoch_differs"), ([*WHOLE[:-1], "stray", WHOLE[-1]], "record_outside_a_map"),
        (changed("LAT1 / LAT2 / DLAT", "   100.0   0.0 -10.0"), "bad_axis"), ([*HEAD, *block(1, 0, first=(1, 2)), *block(2, 2), WHOLE[-1]], "row_incomplete"),
    ],
)
def test_reasons(lines, said):
    assert reason(lines) == said


def test_a_maps_own_exponent_ends_with_it():
    cells = parse_map_file(text([*HEAD, *block(1, 0, extra=(record("    -2", "EXPONENT"),)), *block(2, 2), WHOLE[-1]]))
    assert [c[5] for c in cells if c[3] == 10.0] == [0.01, 0.02, 0.03, 0.1, 0.2, 0.3]


def test_broken_files_are_rejects_beside_good_ones(spark, tmp_path):
    for name, lines in (("good", WHOLE), ("cut", WHOLE[:13]), ("headless", WHOLE[8:]), ("blank", ["", ""])):
        (tmp_path / name).write_bytes(text(lines))
    (tmp_path / "zipped").write_bytes(gzip.compress(text(WHOLE))[:-20])
    cells, rejects = load_map_files(spark, str(tmp_path))
    assert cells.count() == 10 and cells.select("artifact_id").distinct().count() == 1
    got = {r["path"].rsplit("/", 1)[1]: (r["line"], r["reason"]) for r in rejects.collect()}
    assert got == {"cut": (13, "file_ends_in_a_map"), "headless": (1, "no_version_record"), "blank": (1, "no_version_record"), "zipped": (0, "unreadable")}


def test_means_half_way_are_written_alike_whatever_their_last_bit(spark):
    halves = [47.449999999999996, 47.45, 47.45000000000001, -0.25, 0.05, 12.349]
    rows = [(0, lat, float(lon), v, 3.0) for lat in (0.0, 2.5) for lon, v in enumerate(halves)]
    df = spark.createDataFrame(rows, "epoch long, lat double, lon double, v double, n double")
    content = map_file_texts(df, "epoch", "v", "n", [0.0, 2.5], [float(i) for i in range(6)]).first()["content"]
    cells = [v for kind, _, _, lat, _, v in parse_map_file(content.encode()) if kind == "tec" and lat == 0.0]
    assert cells == [47.5, 47.5, 47.5, -0.2, 0.1, 12.3]
