"""Readers of station files: dialects found by header, string schemas, aliases, parsed times and numbers, latest row per key."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.functions.basic import number
from zephyrlake.operators import clean, series
from zephyrlake.operators.nearest import nearest_in_degrees

#: Header names of feeds and what they are called here.
POLLUTION_ALIASES = {"from_date": "timestamp", "to_date": "timestamp", "date": "timestamp", "time": "timestamp", "datetime": "timestamp", "pm2.5_(ug/m3)": "pm25", "pm2.5": "pm25", "pm10_(ug/m3)": "pm10", "no2_(ug/m3)": "no2", "so2_(ug/m3)": "so2", "co_(mg/m3)": "co", "ozone_(ug/m3)": "o3", "ozone": "o3", "nh3_(ug/m3)": "nh3"}
WEATHER_ALIASES = {"time": "timestamp", "datetime": "timestamp", "date": "timestamp", "temperature_2m": "temperature", "relative_humidity_2m": "humidity", "wind_speed_10m": "wind_speed", "wind_direction_10m": "wind_direction", "boundary_layer_height": "pbl_height"}
ATMOSPHERE_ALIASES = {"time": "timestamp", "datetime": "timestamp", "date": "timestamp", "boundary_layer_height": "pbl_height", "latitude": "lat", "longitude": "lon"}
FIRE_ALIASES = {"latitude": "lat", "longitude": "lon"}
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm[:ss]", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm[:ss]", "yyyy-MM-dd")
PBL_RANGE = (0, 5000)


def timestamp(text, zone: str = "UTC"):
    """UTC wall time of a string: its offset if it has one, else read in ``zone``; unreadable ones are null."""
    naive = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS])
    aware = F.trim(text).rlike(r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(aware, F.trim(text).try_cast("timestamp")).otherwise(F.to_utc_timestamp(naive, zone)).cast("timestamp_ntz")


def headers(spark: SparkSession, path: str, comment: str = "#") -> dict[tuple[str, ...], list[str]]:
    """The files of each header line, which is a file's first line that is neither empty nor a comment; files without one are left out.

    Only the first split of a file can hold its header. The driver gets one line per file, as it lists them anyway.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.where((F.col("at") == 0) & (F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit(comment))).withColumn("n", F.monotonically_increasing_id())
    first = lines.groupBy("file").agg(F.min_by("value", "n").alias("line"))
    out: dict[tuple[str, ...], list[str]] = {}
    for x in first.orderBy("file").collect():
        out.setdefault(tuple(next(csv.reader([x.line.removeprefix("\ufeff")]))), []).append(x.file)
    return out


def known_as(column: str, aliases: dict[str, str]) -> str:
    """What a header's column is called here."""
    name = re.sub(r"\s+", "_", column.strip().lower())
    return aliases.get(name, name)


def read(spark: SparkSession, path: str, aliases: dict[str, str], needs: tuple[tuple[str, ...], ...] = (), text: tuple[str, ...] = (), comment: str = "#", zone: str = "UTC", unknown: str = "refuse") -> DataFrame:
    """CSV files of any mix of headers: normal names, UTC times without unreadable ones, numbers but for the named text columns.

    Files are grouped by header and each group is one scan with its own columns, so files may differ in names, order and
    number of columns; what a file lacks is null. Of columns that come to the same name the first stays. needs: of each
    of these groups of names a header must have one; files whose header hasn't are refused, or left out with
    ``unknown="skip"``. Adds file, the path that a row came from.
    """
    parts, refused = [], []
    for header, files in headers(spark, path, comment).items():
        names = {known_as(c, aliases) for c in header}
        if not all(names & set(own) for own in needs):
            refused.append((header, files))
            continue
        schema = ", ".join(f"`c{i}` string" for i in range(len(header)))
        raw = spark.read.schema(schema).option("header", True).option("comment", comment).option("mode", "PERMISSIVE").csv(files)
        first: dict[str, Column] = {}
        for i, c in enumerate(header):
            first.setdefault(known_as(c, aliases), F.col(f"c{i}"))
        columns = [(timestamp(x, zone) if c == "timestamp" else x if c in ("station", *text) else number(x)).alias(c) for c, x in first.items() if c]
        parts.append(raw.select(*columns, F.col("_metadata.file_path").alias("file")))
    if refused and unknown != "skip":
        raise ValueError("unknown headers: " + "; ".join(f"{files[0]} (of {len(files)}): {','.join(header)}" for header, files in refused))
    if not parts:
        raise ValueError(f"no file with a known header in {path}")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.where("timestamp is not null") if "timestamp" in out.columns else out


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the largest by its other columns in order of their names, so that reruns agree."""
    return clean.latest_by(df, keys, [F.desc_nulls_last(c) for c in sorted(df.columns) if c not in keys])


def pollution(spark: SparkSession, path: str, zone: str = "UTC", unknown: str = "refuse") -> DataFrame:
    """Pollution readings, one per station and time, clamped with flags."""
    needs = (("timestamp",), ("station",), tuple(clean.POLLUTANT_RANGES))
    df = read(spark, path, POLLUTION_ALIASES, needs, zone=zone, unknown=unknown)
    return latest(clean.clamped(df.drop("file"), clean.POLLUTANT_RANGES), ["station", "timestamp"])


def weather(spark: SparkSession, path: str, zone: str = "UTC", unknown: str = "refuse") -> DataFrame:
    """Weather readings, one per station and time, speeds in m/s (each file by its own median), clamped with flags."""
    df = read(spark, path, WEATHER_ALIASES, (("timestamp",), ("station",), tuple(clean.WEATHER_RANGES)), zone=zone, unknown=unknown)
    df = clean.speed_in_mps(df, by=["file"]) if "wind_speed" in df.columns else df
    return latest(clean.clamped(df.drop("file"), clean.WEATHER_RANGES), ["station", "timestamp"])


def atmosphere(spark: SparkSession, path: str, stations: DataFrame, zone: str = "UTC", unknown: str = "refuse") -> DataFrame:
    """Boundary-layer heights, one per station and time, with the station's place.

    stations: (station, slat, slon). Rows that name a station take its place, others go to the station nearest
    in degrees. Heights outside 0 to 5000 m are gaps; gaps of up to six rows of a station are interpolated.
    """
    df = read(spark, path, ATMOSPHERE_ALIASES, (("timestamp",), ("pbl_height",), ("station", "lat")), zone=zone, unknown=unknown).drop("file")
    for c in ("station", "lat", "lon"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string" if c == "station" else "double"))
    places = stations.select(F.col("station").cast("string").alias("station"), "slat", "slon")
    named = df.where("station is not null").drop("lat", "lon").join(places.withColumnsRenamed({"slat": "lat", "slon": "lon"}), "station", "left")
    gridded = nearest_in_degrees(df.where("station is null").drop("station"), places).drop("distance")
    rows = clean.nulled(named.unionByName(gridded), {"pbl_height": PBL_RANGE})
    return series.interpolated(latest(rows, ["station", "timestamp"]), ["station"], "timestamp", "pbl_height", 6)


def fires(spark: SparkSession, path: str, least: str = "nominal", unknown: str = "refuse") -> DataFrame:
    """Hotspots with acquisition time, at least so confident, one per place and time."""
    df = read(spark, path, FIRE_ALIASES, (("lat",), ("lon",), ("acq_date",)), text=("acq_date", "confidence", "satellite", "instrument", "daynight", "source"), unknown=unknown).drop("file")
    df = df.withColumn("acq", clean.acquired_at(F.col("acq_date"), F.col("acq_time").cast("int")))
    df = clean.confident(df, least).where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return latest(df, ["lat", "lon", "acq"])


def wide_hours(spark: SparkSession, path: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """station, timestamp, aqi from files with a column per hour; nulls and negatives go, local times become UTC."""
    raw = clean.normalized_names(spark.read.option("header", True).csv(path))
    hours = [c for c in raw.columns if len(c) == 8 and c[2] == ":" and c[5] == ":"]
    long = raw.select(F.col("station_name").alias("station"), "date", *[number(F.col(f"`{c}`")).alias(c) for c in hours]).unpivot(["station", "date"], [F.col(f"`{c}`") for c in hours], "hour", "aqi").where("aqi >= 0")
    return long.select("station", timestamp(F.concat_ws(" ", "date", "hour"), zone).alias("timestamp"), "aqi").where("timestamp is not null")
