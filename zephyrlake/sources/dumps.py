"""Binary concentration dumps: length-framed big-endian records become rows of points, and points become surfaces.

A dump says its model, its places of release, its grid, its levels and its species; then, for each sampling period,
start and stop time and one record for every level and species with the cells that hold something.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.operators import grid

#: Fields of the grid record and of one cell, as they lie in a dump.
GRID = np.dtype([("nlat", ">i4"), ("nlon", ">i4"), ("dlat", ">f4"), ("dlon", ">f4"), ("south", ">f4"), ("west", ">f4")])
CELL = np.dtype([("i", ">i2"), ("j", ">i2"), ("value", ">f4")])
POINTS = "path string, record int, time timestamp_ntz, hours double, level int, species string, i int, j int, lat double, lon double, value double"


class NotADump(ValueError):
    """A file whose head is not that of a dump."""


def framed(payload: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place, body) of each record up to the first that is torn."""
    while at + 8 <= len(payload):
        size = int.from_bytes(payload[at : at + 4], "big", signed=True)
        if size < 0 or at + 8 + size > len(payload) or int.from_bytes(payload[at + 4 + size : at + 8 + size], "big", signed=True) != size:
            return
        yield at, payload[at + 4 : at + 4 + size]
        at += 8 + size


def numbers(body: bytes) -> list[int]:
    """Big-endian whole numbers."""
    return np.frombuffer(body[: len(body) // 4 * 4], ">i4").tolist()


def moment(body: bytes) -> dt.datetime:
    """A record's time; years below 50 are of this century."""
    year, month, day, hour, minute = numbers(body)[:5]
    return dt.datetime((2000 if year < 50 else 1900) + year, month, day, hour, minute)


def periods(payload: bytes) -> Iterator[tuple[dt.datetime, float, int, str, np.ndarray, np.void]]:
    """(start, hours, level, species, cells, grid) of each whole concentration record; a torn file ends at its last whole one.

    A head that isn't a dump's raises NotADump; so does a concentration record whose count disagrees with its size.
    """
    records = framed(payload)

    def head(what: str) -> bytes:
        found = next(records, None)
        if found is None:
            raise NotADump(f"no {what} record")
        return found[1]

    first = numbers(head("model"))
    releases = first[6] if len(first) >= 8 else 1
    if not 1 <= releases <= 50:
        raise NotADump(f"{releases} places of release")
    for _ in range(releases):
        head("release")
    body = head("grid")
    if len(body) < GRID.itemsize:
        raise NotADump("short grid record")
    cells = np.frombuffer(body[: GRID.itemsize], GRID)[0]
    levels = numbers(head("level"))
    if not levels or not 1 <= levels[0] <= 100 or len(levels) != levels[0] + 1:
        raise NotADump("levels disagree with their count")
    body = head("species")
    kinds = numbers(body)[0] if len(body) >= 4 else 0
    if not 1 <= kinds <= 20 or len(body) != 4 * (kinds + 1):
        raise NotADump("species disagree with their count")
    hours = 1.0
    while (start := next(records, None)) and (stop := next(records, None)):
        began, ended = moment(start[1]), moment(stop[1])
        hours = (ended - began).total_seconds() / 3600 if ended > began else hours
        for _ in range(levels[0] * kinds):
            found = next(records, None)
            if found is None:
                return
            at, body = found
            count = numbers(body[8:12])[0] if len(body) >= 12 else -1
            if count < 0 or len(body) != 12 + CELL.itemsize * count:
                raise NotADump(f"record at byte {at} says {count} cells in {len(body)} bytes")
            yield began, hours, numbers(body[4:8])[0], body[:4].decode("ascii", "replace").strip(), np.frombuffer(body[12:], CELL), cells


def dump_points(files: DataFrame, malformed: str = "refuse") -> DataFrame:
    """path, record (number of the concentration record), time, hours, level, species, i, j, lat, lon, value of every cell in dumps.

    files: (path, content). One file is parsed by one task, record by record; what a task holds beside the file is one
    record. Empty and null contents give no rows. malformed: ``refuse`` stops at a file that is no dump, ``skip`` leaves it out.
    """
    kinds = [pa.string(), pa.int32(), pa.timestamp("us"), pa.float64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in POINTS.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for n, (time, hours, level, species, cells, g) in enumerate(periods(content) if content else ()):
                        m = len(cells)
                        lat = float(g["south"]) + (cells["j"].astype(float) - 1) * float(g["dlat"])
                        lon = float(g["west"]) + (cells["i"].astype(float) - 1) * float(g["dlon"])
                        columns = ([path] * m, [n] * m, [time] * m, [hours] * m, [level] * m, [species] * m, cells["i"].astype(np.int32), cells["j"].astype(np.int32), lat, lon, cells["value"].astype(float))
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)
                except NotADump as e:
                    if malformed != "skip":
                        raise NotADump(f"{path}: {e}") from None

    return files.select("path", "content").mapInArrow(parse, POINTS)


def read_dumps(spark: SparkSession, path: str, malformed: str = "refuse") -> DataFrame:
    """The points of all dumps of a path, wherever Spark can read it."""
    return dump_points(spark.read.format("binaryFile").load(path), malformed)


def dump_surfaces(points: DataFrame, cells: DataFrame, radius: float = 0.25) -> DataFrame:
    """time, i, j, lat, lon, value: for each time the inverse-square-distance mean of its points within a radius in degrees, over all levels and species; 0 where there are none.

    cells: (i, j, lat, lon), one grid for all times. A point that lies on a cell gives its own value, the first record's
    if there are several. Times and nine squares of a radius about each point meet cells by equal keys.
    """
    times = points.select("time").distinct()
    every = times.join(F.broadcast(cells))  # one grid beside each time: these are the rows of the result
    found = grid.within(cells, points.select("time", "record", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "value"), radius, ["time"])
    return every.join(found, ["time", "i", "j"], "left").fillna({"value": 0.0})


def framed_bytes(*bodies: bytes) -> bytes:
    """Records with their lengths, as a dump holds them."""
    return b"".join(len(b).to_bytes(4, "big") + b + len(b).to_bytes(4, "big") for b in bodies)


def written_dump(places: tuple[int, int, float, float, float, float], levels: list[int], species: list[str], periods_of: list[tuple[dt.datetime, dt.datetime, list[list[tuple[int, int, float]]]]]) -> bytes:
    """A dump of one place of release: nlat, nlon, dlat, dlon, south, west; for each period start, stop, and the cells of each level and species in turn."""
    ints = lambda *x: np.array(x, ">i4").tobytes()
    clock = lambda t: ints(t.year % 100, t.month, t.day, t.hour, t.minute, 0)
    out = [b"MODL" + ints(24, 1, 1, 0, 0, 1, 1), ints(24, 1, 1, 0) + np.array([28.6, 77.2, 10.0], ">f4").tobytes(), np.array([places], GRID).tobytes(), ints(len(levels), *levels), ints(len(species)) + b"".join(s.ljust(4)[:4].encode() for s in species)]
    for start, stop, blocks in periods_of:
        out += [clock(start), clock(stop)]
        for (level, kind), cells in zip([(a, s) for a in levels for s in species], blocks, strict=True):
            out.append(kind.ljust(4)[:4].encode() + ints(level, len(cells)) + np.array(cells, CELL).tobytes())
    return framed_bytes(*out)
