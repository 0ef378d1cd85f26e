"""Fires around stations: range joins in time and distance, and their transport measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions import geo
from zephyrlake.operators.nearest import nearest_in_km
from zephyrlake.operators.series import seconds

MAX_KM = 500.0
#: Parts of a cell's fires, where these are many and stations few.
SHARES = 256


def cell_of(lat: Column, lon: Column) -> Column:
    """The cell of five degrees that holds a place."""
    return F.concat_ws(":", F.floor(lat / 5).cast("string"), F.floor(lon / 5).cast("string"))


def with_cells(stations: DataFrame, max_km: float) -> DataFrame:
    """Rows (slat, slon) once for every cell that their reach can touch."""
    dlat = max_km / 111.0
    dlon = F.least(F.lit(180.0), dlat / F.greatest(F.lit(0.05), F.cos(F.radians(F.abs(F.col("slat")) + dlat))))
    span = lambda x, d: F.sequence(F.floor((x - d) / 5), F.floor((x + d) / 5))
    rows = stations.withColumn("__i", F.explode(span(F.col("slat"), F.lit(dlat)))).withColumn("__j", F.explode(span(F.col("slon"), dlon)))
    return rows.withColumn("__cell", F.concat_ws(":", F.col("__i").cast("string"), F.col("__j").cast("string"))).drop("__i", "__j")


def near_fires(fires: DataFrame, stations: DataFrame, max_km: float = MAX_KM, keys: tuple[str, ...] = (), carried: tuple[str, ...] = (), parts: int = 1) -> DataFrame:
    """(station, carried columns, fire columns, km, bearing) for fires within reach of a station.

    stations: (station, slat, slon). Both sides are dealt to cells of five degrees, stations to all cells that
    their reach can touch, so that only neighbours meet. keys: columns of both sides that have to be equal as well, such
    as a bucket of time; distances are worked out for what meets. carried: further columns of stations to go along.
    parts: the fires of a cell are dealt to so many, each of which meets the cell's stations, for where fires are many
    and stations few.
    """
    homes = with_cells(stations.select("station", "slat", "slon", *keys, *carried), max_km)
    fires = fires.withColumn("__cell", cell_of(F.col("lat"), F.col("lon")))
    if parts > 1:
        homes = homes.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        fires = fires.withColumn("__share", F.pmod(F.xxhash64(*[c for c in fires.columns if c != "__cell"]), F.lit(parts)).cast("int"))
        # Exploded sides count as their source in Spark's sizes: without the hints one may be broadcast.
        homes, fires = homes.hint("merge"), fires.hint("merge")
    rows = fires.join(homes, ["__cell", *(["__share"] if parts > 1 else []), *keys]).drop("__cell", "__share")
    rows = rows.withColumn("km", geo.haversine(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon"))).where(F.col("km") <= max_km)
    return rows.withColumn("bearing", geo.bearing(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon"))).drop("slat", "slon")


def measures(found: DataFrame, keys: list[str], max_km: float = MAX_KM) -> DataFrame:
    """Fire measures per key from rows with km, bearing, frp, wind_direction, wind_speed.

    fire_count, fire_impact_score, nearest_fire_distance, wind_aligned_fire_count, wind_alignment_pct,
    transport_time_hours, transport_risk, transport_risk_level, stubble_impact_score. A missing or non-positive
    power counts as 1, a missing direction as north.
    """
    angle = geo.angle_between(F.col("bearing"), F.coalesce("wind_direction", F.lit(0.0)))
    power = F.when(F.col("frp") > 0, F.col("frp")).otherwise(1.0)
    weight = power * F.greatest(F.cos(F.radians(angle)), F.lit(0.0)) / (F.col("km") + 1.0)
    out = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("km").alias("near"), F.sum(weight).alias("raw"), F.count_if(angle <= 90).alias("aligned"), F.max("wind_speed").alias("speed"))
    share, score = F.col("aligned") / F.col("n"), geo.impact(F.col("raw"))
    time = F.when(F.col("speed") > 0.5, F.col("near") / (F.col("speed") * 3.6))
    risk = F.least(F.lit(1.0), 0.4 * score + 0.3 * (1 - F.least(F.lit(1.0), F.col("near") / max_km)) + 0.2 * share + 0.1 * F.coalesce(1 - F.least(F.lit(1.0), time / 24.0), F.lit(0.0)))
    named = F.when(risk >= 0.7, "severe").when(risk >= 0.4, "high").when(risk >= 0.15, "moderate").otherwise("low")
    return out.select(
        *keys, F.col("n").alias("fire_count"), F.bround(score, 4).alias("fire_impact_score"), F.bround("near", 2).alias("nearest_fire_distance"), F.col("aligned").alias("wind_aligned_fire_count"), F.bround(share * 100.0, 1).alias("wind_alignment_pct"),
        F.bround(time, 2).alias("transport_time_hours"), F.bround(risk, 3).alias("transport_risk"), named.alias("transport_risk_level"), F.bround(F.least(F.lit(1.0), score * (0.5 + 0.5 * share)), 3).alias("stubble_impact_score"),
    )


def without_fires(df: DataFrame, max_km: float = MAX_KM) -> DataFrame:
    """The measures of rows that met no fire."""
    return df.fillna({"fire_count": 0, "fire_impact_score": 0.0, "nearest_fire_distance": max_km + 1, "wind_aligned_fire_count": 0, "wind_alignment_pct": 0.0, "transport_risk": 0.0, "transport_risk_level": "none", "stubble_impact_score": 0.0})


def trailing_fires(panel: DataFrame, fires: DataFrame, stations: DataFrame, hours: float = 24.0, max_km: float = MAX_KM, after_hours: float = 0.0) -> DataFrame:
    """Panel rows (station, ts, wind_speed, wind_direction) with the measures of fires in [ts - hours, ts + after] within reach.

    Time goes in buckets as wide as the window, each panel row in the two or three it touches. Fires meet stations by
    cell and bucket, only in buckets that the station has rows for; each such pair gets its distance once, and what is
    within reach meets the rows by station and bucket. All joins are on equal keys.
    """
    width = 3600.0 * (hours + after_hours)
    at = seconds("ts")
    touched = F.sequence(F.floor((at - 3600 * hours) / width), F.floor((at + 3600 * after_hours) / width))
    rows = panel.select("station", "ts", "wind_speed", "wind_direction").withColumn("__at", at).withColumn("__bucket", F.explode(touched))
    awake = rows.select("station", "__bucket").distinct().join(stations, "station")
    timed = fires.withColumn("__t", seconds("acq")).withColumn("__bucket", F.floor(F.col("__t") / width))
    near = near_fires(timed, awake, max_km, ("__bucket",))
    hit = rows.join(near.select("station", "__bucket", "__t", "km", "bearing", "frp"), ["station", "__bucket"]).where((F.col("__t") >= F.col("__at") - 3600 * hours) & (F.col("__t") <= F.col("__at") + 3600 * after_hours))
    return without_fires(panel.join(measures(hit, ["station", "ts"], max_km), ["station", "ts"], "left"), max_km)


def same_hour_fires(panel: DataFrame, fires: DataFrame, stations: DataFrame, max_km: float = MAX_KM) -> DataFrame:
    """Panel rows (station, hour) with count and power of the same hour's fires within reach, and the distance of the nearest at any.

    Fires within reach meet by cell and hour; the nearest is found by cells that widen where an hour has none near.
    """
    hourly = fires.withColumn("hour", F.date_trunc("hour", "acq").cast("timestamp_ntz")).select("hour", "lat", "lon", "frp")
    rows = panel.select("station", "hour").distinct().join(stations, "station")
    # Rows of all cells in reach count as their source in Spark's sizes: without the hints they, or all fires, may be broadcast.
    homes = with_cells(rows, max_km).hint("merge").join(hourly.withColumn("__cell", cell_of(F.col("lat"), F.col("lon"))).hint("merge"), ["hour", "__cell"])
    inside = homes.where(geo.haversine(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon")) <= max_km)
    counts = inside.groupBy("station", "hour").agg(F.count(F.lit(1)).alias("fire_count"), F.sum("frp").alias("total_frp"))
    near = nearest_in_km(rows, hourly.select("hour", "lat", "lon"), [], "slat", "slon", "lat", "lon", ["hour"]).select("station", "hour", F.col("distance").alias("nearest_fire_distance"))
    out = panel.join(counts, ["station", "hour"], "left").join(near, ["station", "hour"], "left")
    return out.fillna({"fire_count": 0, "total_frp": 0.0})
