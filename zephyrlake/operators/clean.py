"""Cleaning: names, ranges, flags, confidence filters and de-duplication."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.functions.basic import clip

#: Accepted ranges of pollutants and weather variables.
POLLUTANT_RANGES = {"pm25": (0, 1000), "pm10": (0, 1000), "o3": (0, 1200), "no2": (0, 1000), "so2": (0, 2000), "co": (0, 50)}
WEATHER_RANGES = {"temperature": (-60, 60), "humidity": (0, 100), "pressure_msl": (870, 1084), "surface_pressure": (870, 1084), "wind_speed": (0, 100), "wind_direction": (0, 360), "precipitation": (0, 500), "cloud_cover": (0, 100), "pbl_height": (0, 5000)}
CONFIDENCE = {"low": 1, "nominal": 2, "high": 3}


def normalized_names(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Snake-case column names, then aliases; of columns that come to the same name the first stays."""
    seen, columns = set(), []
    for c in df.columns:
        name = re.sub(r"\s+", "_", c.strip().lower())
        name = (aliases or {}).get(name, name)
        if name not in seen:
            seen.add(name)
            columns.append(F.col(f"`{c}`").alias(name))
    return df.select(columns)


def clamped(df: DataFrame, ranges: dict[str, tuple[float, float]], flags: str = "range_flags") -> DataFrame:
    """Values clamped to their ranges, and the names of those that were outside, comma-joined with _oor."""
    here = {c: r for c, r in ranges.items() if c in df.columns}
    outside = [F.when((F.col(c) < low) | (F.col(c) > high), F.lit(f"{c}_oor")) for c, (low, high) in here.items()]
    return df.withColumns({flags: F.concat_ws(",", *outside)} | {c: clip(F.col(c).cast("double"), *r) for c, r in here.items()})


def nulled(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their ranges become null."""
    return df.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items() if c in df.columns})


def zscore_flags(df: DataFrame, columns: list[str], limit: float = 4.0) -> DataFrame:
    """<column>_outlier: beyond so many sample deviations of the column's mean. One small aggregate row joins all rows."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    flags = {f"{c}_outlier": F.coalesce(F.abs(F.col(c) - F.col(f"__m_{c}")) > limit * F.col(f"__s_{c}"), F.lit(False)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(flags).select(*df.columns, *flags)  # one row


def iqr_flags(df: DataFrame, columns: list[str], width: float = 3.0) -> DataFrame:
    """<column>_iqr_outlier: outside the quartiles by more than ``width`` times their distance; values stay."""
    stats = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__q_{c}") for c in columns])
    out = {}
    for c in columns:
        low, high = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        out[f"{c}_iqr_outlier"] = F.coalesce((F.col(c) < low - width * (high - low)) | (F.col(c) > high + width * (high - low)), F.lit(False))
    return df.crossJoin(F.broadcast(stats)).withColumns(out).select(*df.columns, *out)  # one row


def speed_in_mps(df: DataFrame, column: str = "wind_speed", limit: float = 30.0, by: list[str] | None = None) -> DataFrame:
    """Speeds divided by 3.6 if their median, or that of their key, says that they are in km/h."""
    kmh = (F.percentile(column, 0.5) > limit).alias("__kmh")
    rows = df.join(df.groupBy(*by).agg(kmh), by, "left") if by else df.crossJoin(F.broadcast(df.agg(kmh)))  # one row
    return rows.withColumn(column, F.when(F.col("__kmh"), F.col(column) / 3.6).otherwise(F.col(column))).select(df.columns)


def confident(df: DataFrame, least: str = "nominal", column: str = "confidence") -> DataFrame:
    """Rows of at least this confidence; unknown labels are below all."""
    rank = F.lit(0)
    for label, n in CONFIDENCE.items():
        rank = F.when(F.lower(F.trim(F.col(column))) == label, n).otherwise(rank)
    return df.where(rank >= CONFIDENCE[least])


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hour_deduped(df: DataFrame, keys: list[str], ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """The latest row of each key and hour, with the hour; ties by the given columns, largest first."""
    df = df.withColumn("hour", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    return latest_by(df, [*keys, "hour"], [F.desc(ts), *[F.desc(c) for c in tie or []]])


def without_gappy(df: DataFrame, columns: list[str], share: float = 0.5) -> DataFrame:
    """Rows of which at most this share of the columns is null."""
    missing = sum(F.col(c).isNull().cast("int") for c in columns)
    return df.where(missing <= share * len(columns))


def with_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a schema in its order; missing ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def acquired_at(date: Column, hhmm: Column) -> Column:
    """Acquisition time from a date and HHMM: 2400 is the next midnight, unreadable times are midnight, bad dates null."""
    day = F.try_to_timestamp(date.cast("string"), F.lit("yyyy-MM-dd"))
    text = F.lpad(F.coalesce(hhmm.cast("string"), F.lit("0")), 4, "0")
    hours, minutes = text.substr(1, 2).try_cast("int"), text.substr(3, 2).try_cast("int")
    good = (hours.between(0, 23) & minutes.between(0, 59)) | ((hours == 24) & (minutes == 0))
    seconds = F.when(good, hours * 3600 + minutes * 60).otherwise(0)
    return F.timestamp_seconds(F.unix_timestamp(day) + F.coalesce(seconds, F.lit(0))).cast("timestamp_ntz")


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_null, null_pct of each column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = counts.select("n", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))).alias("column_name", "n_null"))
    return rows.select("column_name", F.col("n").alias("n_rows"), "n_null", F.coalesce(F.bround(100.0 * F.col("n_null") / F.when(F.col("n") > 0, F.col("n")), 4), F.lit(0.0)).alias("null_pct"))
