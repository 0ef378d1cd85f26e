"""Domain inputs as views over the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.operators import network

STATIONS = [(0, 28.6492, 77.2918), (1, 28.5601, 77.1835), (2, 28.6290, 77.2410), (3, 28.5921, 77.0460), (4, 28.6692, 77.1285)]
KINDS = {"error": "pm25", "click": "pm10", "view": "o3", "signup": "no2", "purchase": "so2"}
POLLUTANTS = list(KINDS.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, ts, pollutant, v from events."""
    kind = F.lit(None).cast("string")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("station"), "ts", kind.alias("pollutant"), F.col("value").alias("v"))


def stations(spark: SparkSession) -> DataFrame:
    """station, slat, slon: five rows."""
    return spark.createDataFrame(STATIONS, "station int, slat double, slon double")


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fire_id, lat, lon, frp, acq from orders."""
    k = F.col("o_orderkey")
    acq = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((o_orderkey * 37) % 43200 as int))")
    return table(spark, sf_dir, "orders").select(k.alias("fire_id"), (27.5 + (k * 7919 % 550) / F.lit(100.0)).alias("lat"), (73.5 + (k * 104729 % 500) / F.lit(100.0)).alias("lon"), (F.col("o_totalprice") / 1000.0).alias("frp"), acq.alias("acq"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, ts, wind_speed, wind_direction, pbl_height, temperature, humidity by hour from lineitem."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 5).cast("int").alias("station"), (F.col("l_orderkey") % 720).cast("int").alias("hr"))
    out = rows.agg(F.round(F.avg("l_quantity") / 8, 6).alias("wind_speed"), F.round(F.avg("l_extendedprice") % 360, 6).alias("wind_direction"), F.round(50 + F.avg("l_extendedprice") % 1950, 6).alias("pbl_height"), F.round(10 + 300 * F.avg("l_discount"), 6).alias("temperature"), F.round(100 * F.least(F.lit(1.0), 12 * F.avg("l_tax")), 6).alias("humidity"))
    return out.select("station", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, hr, 0)").alias("ts"), "wind_speed", "wind_direction", "pbl_height", "temperature", "humidity")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, hour and the hourly mean of each pollutant."""
    return network.hourly_pivot(obs(spark, sf_dir), POLLUTANTS).withColumns({p: F.round(p, 6) for p in POLLUTANTS})


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, hour, y (pm25), p (pm25 of the row before): a pseudo-forecast."""
    from zephyrlake.operators.series import lags

    rows = panel(spark, sf_dir).where("pm25 is not null").select("station", "hour", F.col("pm25").alias("y"))
    return lags(rows, ["station"], "hour", "y", [1]).withColumnRenamed("y_lag1", "p").where("p is not null")


SQL = {
    "obs": "obs AS (SELECT CAST(user_id % 5 AS INT) AS station, ts, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in KINDS.items()) + " END AS pollutant, value AS v FROM events)",
    "stations5": "stations5(station, slat, slon) AS (VALUES " + ", ".join(f"({s}, CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for s, a, o in STATIONS) + ")",
    "fires": "fires AS (SELECT o_orderkey AS fire_id, 27.5 + (o_orderkey * 7919 % 550) / CAST(100.0 AS DOUBLE) AS lat, 73.5 + (o_orderkey * 104729 % 500) / CAST(100.0 AS DOUBLE) AS lon, o_totalprice / CAST(1000.0 AS DOUBLE) AS frp, TIMESTAMP '2024-01-01' + to_minutes(CAST((o_orderkey * 37) % 43200 AS INT)) AS acq FROM orders)",
    "weather": "weather AS (SELECT station, TIMESTAMP '2024-01-01' + to_hours(hr) AS ts, wind_speed, wind_direction, pbl_height, temperature, humidity FROM (SELECT CAST(l_linenumber % 5 AS INT) AS station, CAST(l_orderkey % 720 AS INT) AS hr, round(avg(l_quantity) / 8, 6) AS wind_speed, round(avg(l_extendedprice) % 360, 6) AS wind_direction, round(50 + avg(l_extendedprice) % 1950, 6) AS pbl_height, round(10 + 300 * avg(l_discount), 6) AS temperature, round(100 * least(1.0, 12 * avg(l_tax)), 6) AS humidity FROM lineitem GROUP BY 1, 2))",
    "panel": "panel AS (SELECT station, date_trunc('hour', ts) AS hour, " + ", ".join(f"round(avg(CASE WHEN pollutant = '{p}' THEN v END), 6) AS {p}" for p in POLLUTANTS) + " FROM obs GROUP BY 1, 2)",
    "forecasts": "forecasts AS (SELECT * FROM (SELECT station, hour, pm25 AS y, lag(pm25) OVER (PARTITION BY station ORDER BY hour) AS p FROM panel WHERE pm25 IS NOT NULL) WHERE p IS NOT NULL)",
}
NEEDS = {"panel": ("obs",), "forecasts": ("obs", "panel")}


def with_views(*names: str, more: str = "") -> str:
    """A WITH clause of the named views and what they need, then further ones."""
    order = list(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return "WITH " + ", ".join([SQL[n] for n in order] + ([more] if more else [])) + " "
