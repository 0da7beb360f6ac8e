"""Bulk load of map exchange files (IONEX text): many files in, one row a cell out, rejects with a reason."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.plans.store import stored

#: Fixed value of the format: a missing cell.
MISSING = 9999
#: Files over this size are refused.
MAX_BYTES = 64 << 20
_ROWS = "path string, kind string, map int, epoch bigint, lat double, lon double, value double, line int, reason string"


class MapFileError(ValueError):
    def __init__(self, line: int, reason: str):
        super().__init__(reason)
        self.line, self.reason = line, reason


def _axis(body: str, line: int) -> list[float]:
    """Axis of three fixed columns of six characters after two blanks."""
    first, last, step = (float(body[2 + 6 * i : 8 + 6 * i]) for i in range(3))
    if step == 0 or (last - first) / step < 0:
        raise MapFileError(line, "bad_axis")
    return [round(first + i * step, 10) for i in range(int(round((last - first) / step)) + 1)]


#: Header records that a file must have, by what they set.
_REQUIRED = {"# OF MAPS IN FILE": "maps", "MAP DIMENSION": "dimension", "HGT1 / HGT2 / DHGT": "height", "LAT1 / LAT2 / DLAT": "lats", "LON1 / LON2 / DLON": "lons"}
_KINDS = {"TEC": "tec", "RMS": "rms", "HGT": "height"}
#: What a file that ends in a state lacks.
_UNFINISHED = {"version": "empty_file", "header": "no_end_of_header", "auxiliary": "auxiliary_block_open", "maps": "no_end_of_file", "map": "file_ends_in_a_map", "row": "file_ends_in_a_row"}


class _Reader:
    """One file, line by line. ``state`` names the method that takes the next line; only ``finished`` may be the last."""

    def __init__(self) -> None:
        self.state, self.line, self.cells = "version", 0, []
        self.header: dict = {}
        self.exponent = -1
        self.epochs: dict[str, dict[int, int]] = {k: {} for k in _KINDS.values()}
        self.auxiliary = ""

    def refuse(self, reason: str):
        raise MapFileError(self.line, reason)

    def take(self, raw: str) -> None:
        self.line += 1
        label = raw[60:].strip()
        if self.state != "row" and (label == "COMMENT" or not raw.strip()) and self.line > 1:
            return
        getattr(self, f"_in_{self.state}")(raw, raw[:60], label)

    def close(self) -> list[tuple]:
        if self.state != "finished":
            self.refuse(_UNFINISHED[self.state])
        return self.cells

    def _number(self, text: str, kind=int):
        try:
            return kind(text)
        except ValueError:
            self.refuse("bad_number")

    def _in_version(self, raw: str, body: str, label: str) -> None:
        if label != "IONEX VERSION / TYPE":
            self.refuse("no_version_record")
        if not 1.0 <= self._number(body[:20], float) < 2.0 or body[20:21] != "I":
            self.refuse("unknown_version_or_type")
        self.state = "header"

    def _in_header(self, raw: str, body: str, label: str) -> None:
        if label in _REQUIRED:
            if _REQUIRED[label] in self.header:
                self.refuse("header_record_twice")
            self.header[_REQUIRED[label]] = getattr(self, f"_{_REQUIRED[label]}")(body)
        elif label == "EXPONENT":
            self.exponent = self._number(body)
        elif label == "START OF AUX DATA":
            self.auxiliary, self.state = body.strip(), "auxiliary"
        elif label == "END OF AUX DATA":
            self.refuse("auxiliary_block_ends_otherwise")
        elif label == "END OF HEADER":
            if len(self.header) < len(_REQUIRED):
                self.refuse("header_record_missing")
            self.state = "maps"
        elif label.startswith("START OF ") or label in ("EPOCH OF CURRENT MAP", "LAT/LON1/LON2/DLON/H", "END OF FILE"):
            self.refuse("no_end_of_header")

    def _maps(self, body: str) -> int:
        count = self._number(body)
        return count if count > 0 else self.refuse("no_maps")

    def _dimension(self, body: str) -> int:
        return 2 if self._number(body) == 2 else self.refuse("not_two_dimensional")

    def _height(self, body: str) -> float:
        first, last, step = (self._number(body[2 + 6 * i : 8 + 6 * i], float) for i in range(3))
        return first if first == last and step == 0 else self.refuse("more_than_one_height")

    def _lats(self, body: str) -> list[float]:
        axis = _axis(body, self.line)
        return axis if all(-90 <= v <= 90 for v in axis) else self.refuse("bad_axis")

    def _lons(self, body: str) -> list[float]:
        return _axis(body, self.line)

    def _in_auxiliary(self, raw: str, body: str, label: str) -> None:
        """Station biases and the like: skipped as one block, which must end under its own name."""
        if label == "START OF AUX DATA":
            self.refuse("auxiliary_blocks_nested")
        elif label == "END OF AUX DATA":
            if body.strip() != self.auxiliary:
                self.refuse("auxiliary_block_ends_otherwise")
            self.state = "header"
        elif label == "END OF HEADER":
            self.refuse("auxiliary_block_open")

    def _in_maps(self, raw: str, body: str, label: str) -> None:
        if label == "END OF FILE":
            if len(self.epochs["tec"]) != self.header["maps"]:
                self.refuse("other_number_of_maps")
            self.state = "finished"
            return
        start, _, kind = label.removesuffix(" MAP").rpartition(" ")
        if start != "START OF" or kind not in _KINDS or not label.endswith(" MAP"):
            self.refuse("record_outside_a_map")
        self.kind, self.number = _KINDS[kind], self._number(body)
        if self.number in self.epochs[self.kind]:
            self.refuse("map_number_twice")
        self.epoch, self.scale, self.found, self.state = None, self.exponent, [], "map"

    def _in_map(self, raw: str, body: str, label: str) -> None:
        if label == "EPOCH OF CURRENT MAP":
            self._set_epoch(body)
        elif label == "EXPONENT":
            self.scale = self._number(body)  # of this map alone
        elif label == "LAT/LON1/LON2/DLON/H":
            if self.epoch is None:
                self.refuse("map_without_epoch")
            lat, mine = self._number(body[2:8], float), _axis("  " + body[8:26], self.line)
            if lat not in self.header["lats"] or mine != self.header["lons"]:
                self.refuse("row_off_grid")
            self.found.append(lat)
            self.values, self.state = [], "row"
        elif label.startswith("END OF "):
            if label != f"END OF {next(k for k, v in _KINDS.items() if v == self.kind)} MAP" or self._number(body) != self.number:
                self.refuse("map_ends_otherwise")
            if self.found != self.header["lats"]:
                self.refuse("latitude_rows_missing")
            self.epochs[self.kind][self.number] = self.epoch
            self.state = "maps"
        else:
            self.refuse("record_not_of_a_map")

    def _set_epoch(self, body: str) -> None:
        if self.epoch is not None:
            self.refuse("map_with_two_epochs")
        try:
            self.epoch = int(datetime(*[int(p) for p in body.split()[:6]], tzinfo=UTC).timestamp())
        except (TypeError, ValueError):
            self.refuse("bad_epoch")
        before = self.epochs["tec"]
        if self.kind == "tec" and before and self.epoch <= max(before.values()):
            self.refuse("maps_not_in_time_order")
        if self.kind != "tec" and before.get(self.number) != self.epoch:
            self.refuse("rms_epoch_differs")

    def _in_row(self, raw: str, body: str, label: str) -> None:
        if label.startswith(("END OF", "START OF", "LAT/LON1", "EPOCH OF")):
            self.refuse("row_incomplete")
        self.values += [self._number(raw[i : i + 5]) for i in range(0, len(raw.rstrip()), 5)]
        lons = self.header["lons"]
        if len(self.values) > len(lons):
            self.refuse("too_many_values")
        if len(self.values) == len(lons):
            self._keep(lons)
            self.state = "map"

    def _keep(self, lons: list[float]) -> None:
        seen: dict[float, float | None] = {}
        for lon, v in zip(lons, self.values, strict=True):
            value = None if v == MISSING else round(v * 10.0**self.scale, max(0, -self.scale))
            if self.kind == "rms" and value is not None and value < 0:
                self.refuse("negative_rms")
            lon = round((lon + 180) % 360 - 180, 10) + 0.0
            if lon in seen:
                if seen[lon] != value:
                    self.refuse("wrap_columns_differ")
                continue
            seen[lon] = value
            if value is not None and self.kind != "height":
                self.cells.append((self.kind, self.number, self.epoch, self.found[-1], lon, value))

    def _in_finished(self, raw: str, body: str, label: str) -> None:
        self.refuse("records_after_the_end")


def parse_map_file(content: bytes) -> list[tuple]:
    """(kind, map number, epoch, lat, lon, value) of every present cell of the TEC and RMS maps of one file.

    Nothing of a file counts unless all of it is there: the version record first, every header record once, each map
    with its epoch, all latitude rows of the grid in order, and its end under its own number, as many TEC maps as
    the header says, each number once, and the end of the file. Maps must be in time order, values are scaled by the
    exponent (of the map, else of the header) and rounded to its digits, longitudes are wrapped; a repeated wrap
    column must agree with its twin. Height maps are checked and left out.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    reader = _Reader()
    for raw in content.decode("ascii", "replace").splitlines():
        reader.take(raw)
    return reader.close()


def load_map_files(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells (artifact_id, epoch, lat, lon, vtec, rms) of all files below ``path``, and rejects (path, line, reason).

    One file is one task row; a broken file is a reject, not a failed job (a file of no bytes at all is not
    seen: the reader skips it). RMS maps are joined to the
    TEC maps of the same number; a missing RMS stays null.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "kind", "map", "epoch", "lat", "lon", "value", "line", "reason"]
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    if len(content) > MAX_BYTES:
                        raise MapFileError(0, "file_too_large")
                    rows = [(file, *cell, None, None) for cell in parse_map_file(bytes(content))]
                except (MapFileError, ValueError, OSError, EOFError) as e:
                    rows = [(file, "reject", None, None, None, None, None, getattr(e, "line", 0), getattr(e, "reason", "unreadable"))]
                yield pd.DataFrame(rows, columns=columns).astype({"map": "Int32", "epoch": "Int64", "line": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = stored(files.mapInPandas(parse, _ROWS), "map-rows")  # each file is parsed once for cells and rejects
    artifacts = F.concat(F.lit("artifact-"), F.substring(F.sha2("path", 256), 1, 24))
    cells = rows.where("kind <> 'reject'").withColumn("artifact_id", artifacts)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    both = cells.groupBy("artifact_id", "map", "epoch", "lat", "lon").agg(of("tec").alias("vtec"), of("rms").alias("rms"))
    return both.where("vtec IS NOT NULL").drop("map"), rows.where("kind = 'reject'").select("path", "line", "reason")


def map_file_texts(grid: DataFrame, epoch: str, value: str, rms: str, lats: list[float], lons: list[float]) -> DataFrame:
    """One text a day (column ``product_date``) in the exchange format, from rows (epoch, lat, lon): a sink for archives."""
    label = lambda body, name: F.concat(F.rpad(body, 60, " "), F.lit(name))
    # tenths, halves up; six decimals first, so that a mean half way is one in whatever order it was added up
    tenths = lambda c: F.floor(F.round(F.col(c) * 10, 6) + 0.5)
    cell = lambda c: F.lpad(F.when(F.col(c).isNull(), str(MISSING)).otherwise(tenths(c).cast("int").cast("string")), 5, " ")
    rows = grid.groupBy(epoch, "lat").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lon", cell(c).alias("t")))), lambda x: x["t"]), "").alias(c) for c in (value, rms)])
    head = label(F.concat(F.lit("  "), F.format_string("%6.1f%6.1f%6.1f%6.1f%6.1f", F.col("lat"), F.lit(lons[0]), F.lit(lons[-1]), F.lit(round(lons[1] - lons[0], 10)), F.lit(450.0))), "LAT/LON1/LON2/DLON/H")
    rows = rows.select(epoch, "lat", *[F.concat_ws("\n", head, F.regexp_replace(F.col(c), "(.{80})(?=.)", "$1\n")).alias(c) for c in (value, rms)])
    maps = rows.groupBy(epoch).agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lat", F.col(c).alias("t")))), lambda x: x["t"]), "\n").alias(c) for c in (value, rms)])
    when = label(F.date_format(F.timestamp_seconds(epoch), "  yyyy     M     d     H     m     s"), "EPOCH OF CURRENT MAP")

    def block(kind: str, c: str):
        number = F.format_string("%6d", F.col("_map"))
        return F.concat_ws("\n", label(number, f"START OF {kind} MAP"), when, F.col(c), label(number, f"END OF {kind} MAP"))

    day = F.to_date(F.timestamp_seconds(epoch))
    maps = maps.withColumn("product_date", day).withColumn("_map", F.row_number().over(Window.partitionBy("product_date").orderBy(epoch)))
    joined = maps.groupBy("product_date").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_map").alias("m"), block(k, c).alias("t")))), lambda x: x["t"]), "\n").alias(c) for k, c in (("TEC", value), ("RMS", rms))], F.max("_map").alias("_maps"))
    axis = lambda v: F.format_string("  %6.1f%6.1f%6.1f", F.lit(v[0]), F.lit(v[-1]), F.lit(round(v[1] - v[0], 10)))
    count = label(F.format_string("%6d", F.col("_maps")), "# OF MAPS IN FILE")
    height = label(F.format_string("  %6.1f%6.1f%6.1f", F.lit(450.0), F.lit(450.0), F.lit(0.0)), "HGT1 / HGT2 / DHGT")
    kind = label(F.concat(F.rpad(F.lit("     1.0"), 20, " "), F.lit("I")), "IONEX VERSION / TYPE")
    header = F.concat_ws("\n", kind, count, label(F.lit("     2"), "MAP DIMENSION"), height, label(axis(lats), "LAT1 / LAT2 / DLAT"), label(axis(lons), "LON1 / LON2 / DLON"), label(F.lit("    -1"), "EXPONENT"), label(F.lit(""), "END OF HEADER"))
    return joined.select("product_date", F.concat_ws("\n", header, F.col(value), F.col(rms), label(F.lit(""), "END OF FILE")).alias("content"))
