"""Station and network aggregates: window means with coverage gates, current index, coverage, winds and audits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions import aqi, geo
from zephyrlake.operators.series import seconds


def least_readings(hours: int) -> int:
    """Readings that a window mean needs: a quarter of its hours, two at least."""
    return max(2, math.ceil(0.25 * hours))


def window_means(obs: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """Per station, at the edge (station, edge_ts; None: its newest reading): trailing mean of each pollutant over its window, both ends included, null below coverage; for ozone also the latest reading (o3_last); readings used, edge_ts.

    obs: (station, ts, pollutant, v). Unusable values don't count. One scan; the edge is joined by station.
    """
    good = F.when((F.col("v") >= 0) & ~F.isnan("v") & (F.col("v") < float("inf")), F.col("v"))
    rows = obs.withColumn("v", good)
    edge = rows.groupBy("station").agg(F.max("ts").alias("edge_ts")) if edge is None else edge
    rows = rows.where("v is not null").join(edge, "station").where("ts <= edge_ts")
    age = (seconds("edge_ts") - seconds("ts")) / 3600.0
    means, counts = [], []
    for p in aqi.ORDER:
        within = F.when((F.col("pollutant") == p) & (age <= aqi.WINDOWS[p]), F.col("v"))
        means.append(F.when(F.count(within) >= least_readings(aqi.WINDOWS[p]), F.avg(within)).alias(p))
        counts.append(F.count(within).alias(f"n_{p}"))
    last = [F.max_by(F.when(F.col("pollutant") == p, F.col("v")), F.when(F.col("pollutant") == p, F.struct("ts", "v"))).alias(f"{p}_last") for p in aqi.ORDER]
    return rows.groupBy("station", "edge_ts").agg(*means, *counts, *last)


def current_index(obs: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """station, edge_ts, basis, the six concentrations used, aqi, category, dominant.

    Window means where any is covered, else the latest readings (basis instantaneous). Ozone's mean gives way
    to its latest reading once it passes the limit after truncation.
    """
    rows = window_means(obs, edge)
    covered = F.coalesce(*[F.col(p) for p in aqi.ORDER]).isNotNull()
    o3 = F.when(aqi.truncated(F.col("o3"), 0) > aqi.O3_LIMIT, F.coalesce("o3_last", "o3")).otherwise(F.col("o3"))
    used = {p: F.when(covered, o3 if p == "o3" else F.col(p)).otherwise(F.col(f"{p}_last")) for p in aqi.ORDER}
    rows = rows.select("station", "edge_ts", F.when(covered, "window_mean").otherwise("instantaneous").alias("basis"), *[c.alias(p) for p, c in used.items()])
    return aqi.with_overall(rows, {p: p for p in aqi.ORDER})


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest row per key in one aggregation, without a self-join; equal times by the largest remaining columns."""
    rest = [c for c in df.columns if c not in keys and c != ts]
    return df.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("x")).select(*keys, "x.*")


def hourly_pivot(obs: DataFrame, names: list[str]) -> DataFrame:
    """One row per station and hour with a mean per pollutant; the pollutants are given, so no pass discovers them."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return obs.groupBy("station", hour).agg(*[F.avg(F.when(F.col("pollutant") == p, F.col("v"))).alias(p) for p in names])


def unpivoted(wide: DataFrame, keys: list[str], columns: list[str], name: str = "pollutant", value: str = "v") -> DataFrame:
    """One row per key and column, without nulls and negatives."""
    return wide.unpivot(keys, columns, name, value).where(F.col(value) >= 0)


def composite(panel: DataFrame, stations: list, hour: str, columns: list[str]) -> DataFrame:
    """Hourly means over the given stations, and how many there were."""
    return panel.where(F.col("station").isin(stations)).groupBy(hour).agg(*[F.avg(c).alias(c) for c in columns], F.count_distinct("station").alias("n_stations"))


def coverage(obs: DataFrame, recent_hours: int = 48) -> DataFrame:
    """Per station: rows, rows of the last hours before the newest of all, sources, span in hours, sufficiency band."""
    edge = obs.agg(F.max("ts").alias("edge"))
    rows = obs.crossJoin(F.broadcast(edge))  # one row
    recent = seconds("ts") >= seconds("edge") - 3600 * recent_hours
    out = rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("n_recent"), F.array_join(F.sort_array(F.collect_set("pollutant")), "+").alias("sources"), ((F.max(seconds("ts")) - F.min(seconds("ts"))) / 3600.0).alias("span_h"))
    return out.withColumn("sufficiency", F.when(F.col("n_recent") == 0, "stale").when(F.col("n_recent") < 8, "limited").when(F.col("n") < 96, "insufficient_history").otherwise("adequate"))


def mean_wind(df: DataFrame, keys: list[str]) -> DataFrame:
    """Circular mean direction and scalar mean speed per key, the compass point it comes from, and how many winds were used."""
    known = df.where(F.col("wind_speed").isNotNull() & F.col("wind_direction").isNotNull())
    out = known.groupBy(*keys).agg(F.sum(F.sin(F.radians("wind_direction"))).alias("s"), F.sum(F.cos(F.radians("wind_direction"))).alias("c"), F.avg("wind_speed").alias("speed"), F.count(F.lit(1)).alias("n"))
    direction = F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0))
    return out.select(*keys, F.bround("speed", 2).alias("wind_speed"), F.bround(direction, 1).alias("wind_direction"), geo.compass(direction).alias("compass_from"), F.col("n").alias("stations_used"))


def repeats(df: DataFrame, keys: list[str], values: list[str], ts: str, least: int, top: int | None = None) -> DataFrame:
    """Value tuples that recur at least so often per key, with first and last time; null is a value of its own."""
    out = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).where(F.col("n") >= least)
    return out if top is None else out.orderBy(F.desc("n"), *keys, *values).limit(top)


def provenance(obs: DataFrame, now, stale_hours: float = 6.0) -> DataFrame:
    """Per station: rows, window, age in hours at ``now`` (never negative), stale flag."""
    age = F.greatest(F.lit(0.0), (seconds(now) - F.max(seconds("ts"))) / 3600.0)
    out = obs.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bround(age, 2).alias("age_h"))
    return out.withColumn("stale", F.col("age_h") > stale_hours)
