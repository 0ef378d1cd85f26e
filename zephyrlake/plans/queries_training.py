"""Queries: training tables, forecast runs and small normalisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrlake.operators import training
from zephyrlake.plans import views as v

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def panel_weather(spark, sf):
    """The hourly panel beside the weather of the same hour."""
    return v.panel(spark, sf).join(v.weather(spark, sf).withColumnRenamed("ts", "hour"), ["station", "hour"])


PW = "pw AS (SELECT p.*, w.wind_speed, w.pbl_height, w.temperature, w.humidity FROM panel p JOIN weather w ON p.station = w.station AND p.hour = w.ts)"
SPLIT = "s AS (SELECT *, CASE WHEN epoch_us(hour) - a <= floor((b - a) * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN epoch_us(hour) - a <= floor((b - a) * CAST(0.75 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM panel, (SELECT min(epoch_us(hour)) AS a, max(epoch_us(hour)) AS b FROM panel))"


@query(v.with_views("panel", "weather", more=PW) + "SELECT station, hour, temperature * humidity / 100 AS temp_humidity_index, wind_speed * pbl_height AS ventilation_index, pm25 / nullif(pm10, 0) AS pm_ratio, wind_speed * pbl_height / (temperature + 273.15) AS dispersion_potential FROM pw")
def composite_features(spark, sf):
    return training.composite_features(panel_weather(spark, sf)).select("station", "hour", "temp_humidity_index", "ventilation_index", "pm_ratio", "dispersion_potential")


@query(v.with_views("panel", more=SPLIT) + "SELECT station, hour, pm25, split FROM s")
def split_by_span(spark, sf):
    return training.split_by_span(v.panel(spark, sf), "hour").select("station", "hour", "pm25", "split")


FILLED = "f AS (SELECT last_value(pm25 IGNORE NULLS) OVER w AS pm25, last_value(no2 IGNORE NULLS) OVER w AS no2 FROM s WHERE split = 'train' WINDOW w AS (PARTITION BY station ORDER BY hour ROWS UNBOUNDED PRECEDING))"
ONE = "SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 4) AS deviation FROM f"


@query(v.with_views("panel", more=f"{SPLIT}, {FILLED}") + " UNION ALL ".join(ONE.format(c=c) for c in ("pm25", "no2")))
def train_stats(spark, sf):
    rows = training.train_stats(training.split_by_span(v.panel(spark, sf), "hour"), ["station"], "hour", ["pm25", "no2"])
    return rows.select("feature", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


#: Forecast rows of three horizons, written in runs of a day.
RUNS = "fr AS (SELECT station, date_trunc('day', hour) AS created_at, CAST(hour(hour) AS INT) + 1 AS horizon, pm25 AS predicted FROM panel WHERE hour(hour) % 8 = 0)"


def forecast_rows(spark, sf):
    rows = v.panel(spark, sf).where(F.hour("hour") % 8 == 0)
    return rows.select("station", F.date_trunc("day", "hour").cast("timestamp_ntz").alias("created_at"), (F.hour("hour") + 1).cast("int").alias("horizon"), F.col("pm25").alias("predicted"))


@query(v.with_views("panel", more=f"{RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY created_at DESC, horizon) AS k FROM fr), n AS (SELECT *, max(created_at) OVER (PARTITION BY station) AS newest FROM r WHERE k <= 24), k AS (SELECT *, count(*) FILTER (WHERE created_at = newest) OVER (PARTITION BY station) AS size FROM n)") + "SELECT station, created_at, horizon, predicted FROM k WHERE created_at = newest OR size = 1")
def newest_run(spark, sf):
    return training.newest_run(forecast_rows(spark, sf), ["station"], "created_at", ["horizon"])


@query(v.with_views("panel", more=f"{RUNS}, fresh AS (SELECT station, created_at, horizon, predicted + 1 AS predicted FROM fr WHERE horizon = 9 AND station < 3)") + "SELECT * FROM fr WHERE (station, horizon) NOT IN (SELECT station, horizon FROM fresh) UNION ALL SELECT * FROM fresh")
def replaced_horizons(spark, sf):
    rows = forecast_rows(spark, sf)
    fresh = rows.where("horizon = 9 and station < 3").withColumn("predicted", F.col("predicted") + 1)
    return training.replaced(rows, fresh, ["station", "horizon"])


@query(v.with_views("panel", more=f"{RUNS}, sp AS (SELECT *, greatest(abs(predicted - lag(predicted) OVER w), abs(predicted - lead(predicted) OVER w)) AS spread FROM fr WINDOW w AS (PARTITION BY station, created_at ORDER BY horizon))") + "SELECT station, created_at, horizon, round(CASE WHEN predicted IS NULL THEN 0 ELSE greatest(0.1, least(1.0, greatest(0.3, 1 - horizon / 100.0) - coalesce(least(0.3, spread / 500.0), 0))) END, 5) AS confidence FROM sp")
def run_confidence(spark, sf):
    rows = training.run_confidence(forecast_rows(spark, sf), ["station", "created_at"], "horizon", "predicted")
    return rows.select("station", "created_at", "horizon", F.round("confidence", 5).alias("confidence"))


@query(v.with_views("panel", "stations5", more=RUNS) + "SELECT s.station, count(f.station) AS n_forecasts FROM stations5 s LEFT JOIN fr f ON s.station = f.station GROUP BY 1")
def forecast_counts(spark, sf):
    counts = forecast_rows(spark, sf).groupBy("station").agg(F.count(F.lit(1)).alias("n"))
    return v.stations(spark).join(counts, "station", "left").select("station", F.coalesce("n", F.lit(0)).cast("long").alias("n_forecasts"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Sector ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'Vihar ' || s_suppkey ELSE 'Gate - ' || s_suppkey END AS station_name FROM supplier")
def short_names(spark, sf):
    key = F.col("s_suppkey")
    full = F.when(key % 3 == 0, F.concat(F.lit("Sector "), key, F.lit(", Noida - UPPCB"))).when(key % 3 == 1, F.concat(F.lit(" Vihar "), key, F.lit(", Noida "))).otherwise(F.concat(F.lit("Gate - "), key, F.lit(" - DPCC")))
    return v.table(spark, sf, "supplier").select("s_suppkey", training.short_name(full, "Noida").alias("station_name"))


@query("SELECT o_orderkey AS fire_id, CASE o_orderkey % 4 WHEN 0 THEN 'MODIS' WHEN 1 THEN 'VIIRS' WHEN 2 THEN 'stated' ELSE '' END AS instrument, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE o_totalprice / 2 END AS brightness, month(o_orderdate) IN (10, 11, 12, 1, 2) AS winter FROM orders")
def hotspot_columns(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    satellite = F.when(key % 4 == 0, "Terra").when(key % 4 == 1, "N20")
    made = training.instrument(F.when(key % 4 == 2, " stated "), satellite)
    value = training.brightness(F.when(key % 3 == 1, price).when(key % 3 == 2, F.lit(float("nan"))), F.when(key % 3 == 2, price / 2))
    return v.table(spark, sf, "orders").select(key.alias("fire_id"), made.alias("instrument"), value.alias("brightness"), training.winter(F.col("o_orderdate")).alias("winter"))
