"""Queries: landed files, nested profiles, nearest neighbours and look-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrlake.operators import grid, guarded, nearest, profile, training
from zephyrlake.plans import sqlparts as q
from zephyrlake.plans import views as v
from zephyrlake.sources import dumps, files
from zephyrlake.sources.shared import shared_dir

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- look-back


#: Readings that thin out from station to station.
THIN = "th AS (SELECT station, hour AS ts, pm25 FROM panel WHERE pm25 > 45 * station), rl AS (SELECT station, max(ts) AS release FROM th GROUP BY 1), sp AS (SELECT t.station, release, " + ", ".join(f"count(*) FILTER (WHERE ts >= release - INTERVAL {d} DAY) AS rows_{d}" for d in (2, 10, 30)) + " FROM th t JOIN rl ON rl.station = t.station GROUP BY 1, 2), ss AS (SELECT *, CASE WHEN rows_2 >= 12 THEN 2 WHEN rows_10 >= 12 THEN 10 WHEN rows_30 >= 12 THEN 30 END AS span_days FROM sp), lb AS (SELECT t.* FROM th t JOIN ss ON ss.station = t.station WHERE ts >= release - to_days(span_days))"
SPANS, LEAST = (2, 10, 30), 12


def thin(spark, sf):
    return v.panel(spark, sf).where("pm25 > 45 * station").select("station", F.col("hour").alias("ts"), "pm25")


@query(v.with_views("panel", more=THIN) + "SELECT * FROM ss")
def lookback_spans(spark, sf):
    return training.lookback_spans(thin(spark, sf), ["station"], "ts", SPANS, LEAST)


@query(v.with_views("panel", more=THIN) + "SELECT * FROM lb")
def lookback_rows(spark, sf):
    rows = thin(spark, sf)
    return training.lookback_rows(rows, training.lookback_spans(rows, ["station"], "ts", SPANS, LEAST), ["station"], "ts")


VALUES = "temperature, humidity, wind_speed, pbl_height"
SERVING = "f AS (SELECT *, lag(pm25, 1) OVER w AS pm25_lag1, lag(pm25, 3) OVER w AS pm25_lag3, lag(pm25, 6) OVER w AS pm25_lag6, avg(pm25) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS pm25_mean6, avg(pm25) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS pm25_mean24, count(*) OVER (PARTITION BY station) AS n, row_number() OVER (PARTITION BY station ORDER BY ts DESC) AS k FROM lb WINDOW w AS (PARTITION BY station ORDER BY ts)), wc AS (SELECT w.station, count(*) AS n FROM weather w JOIN ss ON ss.station = w.station WHERE ts BETWEEN release - INTERVAL 5 DAY AND release GROUP BY 1)"


@query(v.with_views("panel", "weather", more=f"{THIN}, {SERVING}") + f"SELECT f.station, f.ts AS hour, pm25, pm25_lag1, pm25_lag3, pm25_lag6, round(pm25_mean6, 6) AS pm25_mean6, round(pm25_mean24, 6) AS pm25_mean24, {VALUES}, f.n AS pollution_rows_in_window, coalesce(wc.n, 0) AS weather_rows_in_window, span_days FROM f JOIN ss ON ss.station = f.station LEFT JOIN weather w ON w.station = f.station AND w.ts = f.ts LEFT JOIN wc ON wc.station = f.station WHERE k = 1")
def serving_rows(spark, sf):
    rows = training.serving_rows(thin(spark, sf), v.weather(spark, sf), SPANS, LEAST)
    return rows.withColumns({c: F.round(c, 6) for c in ("pm25_mean6", "pm25_mean24")})


# ---- vertical profiles


def payloads(spark, sf):
    """A payload per station and day, as a feed of pressure levels gives it, and the mixing heights by hour."""
    t, u, h = F.col("temperature"), F.col("humidity"), F.hour("ts")
    rows = v.weather(spark, sf).select(
        "station", "ts", F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), t.alias("temperature_1000hPa"), (t - 4 + u / 20.0).alias("temperature_925hPa"), F.when(u > 20, t - 6 + u / 25.0).alias("temperature_850hPa"), (t - 18).alias("temperature_700hPa"),
        F.when(h % 3 == 0, 760 + u).alias("geopotential_height_925hPa"), F.when(h % 4 == 1, 1480 + u).alias("geopotential_height_850hPa"),
    )
    names = rows.columns[3:]
    days = rows.groupBy("station", "day").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("x"))  # at most 24
    return days.select("station", F.to_json(F.struct(F.struct(*[F.col(f"x.{c}").alias(c) for c in names]).alias("hourly"))).alias("payload"))


def rise(a: str, b: str, base: int, top: int) -> str:
    """Thickness of a layer in SQL."""
    return f"(287.05 * (({a} + {b}) / 2.0 + 273.15) / CAST(9.80665 AS DOUBLE) * ln({base} / CAST({top} AS DOUBLE)))"


LEVELS = (
    "t AS (SELECT station, ts, pbl_height, temperature AS t1, temperature - 4 + humidity / CAST(20 AS DOUBLE) AS t2, CASE WHEN humidity > 20 THEN temperature - 6 + humidity / CAST(25 AS DOUBLE) END AS t3, temperature - 18 AS t4, CASE WHEN hour(ts) % 3 = 0 THEN 760 + humidity END AS h2, CASE WHEN hour(ts) % 4 = 1 THEN 1480 + humidity END AS h3 FROM weather), "
    f"z2 AS (SELECT *, coalesce(h2, {rise('t1', 't2', 1000, 925)}) AS z2 FROM t), z3 AS (SELECT *, coalesce(h3, z2 + {rise('t2', 't3', 925, 850)}) AS z3 FROM z2), z AS (SELECT *, CASE WHEN t3 IS NULL THEN z2 + {rise('t2', 't4', 925, 700)} ELSE z3 + {rise('t3', 't4', 850, 700)} END AS z4 FROM z3)"
)


@query(v.with_views("weather", more=LEVELS) + "SELECT station, ts, p, round(z, 4) AS z FROM (" + " UNION ALL ".join(f"SELECT station, ts, CAST({p} AS DOUBLE) AS p, {z} AS z FROM z" for p, z in ((1000, "0.0"), (925, "z2"), (850, "z3"), (700, "z4"))) + ") WHERE z IS NOT NULL")
def profile_heights(spark, sf):
    rows = profile.from_payload(payloads(spark, sf), "payload")
    each = rows.select("station", "ts", F.explode(profile.layer_heights(F.col("levels"))).alias("x"))
    return each.select("station", "ts", "x.p", F.round("x.z", 4).alias("z"))


LAYERS = "ly AS (SELECT station, ts, list_reverse_sort(list_filter([{'g': (t2 - t1) / 75.0 * 100.0, 'base': 1000, 'top': 925, 'zb': 0.0, 'zt': z2}, CASE WHEN t3 IS NOT NULL THEN {'g': (t3 - t2) / 75.0 * 100.0, 'base': 925, 'top': 850, 'zb': z2, 'zt': z3} END, CASE WHEN t3 IS NOT NULL THEN {'g': (t4 - t3) / 150.0 * 100.0, 'base': 850, 'top': 700, 'zb': z3, 'zt': z4} ELSE {'g': (t4 - t2) / 225.0 * 100.0, 'base': 925, 'top': 700, 'zb': z2, 'zt': z4} END], lambda x: x IS NOT NULL))[1] AS b FROM z)"


@query(v.with_views("weather", more=f"{LEVELS}, {LAYERS}") + "SELECT station, ts, b.g > 0 AS detected, CASE WHEN b.g > 1.5 THEN 'strong' WHEN b.g > 0.6 THEN 'moderate' WHEN b.g > 0 THEN 'weak' ELSE 'none' END AS category, CAST(b.base AS DOUBLE) AS base_pressure, CAST(b.top AS DOUBLE) AS top_pressure, b.zb AS base_height, b.zt AS top_height, 'lapse_rate' AS source FROM ly")
def profile_inversions(spark, sf):
    rows = profile.from_payload(payloads(spark, sf), "payload").withColumn("z", profile.layer_heights(F.col("levels")))
    rows = rows.join(v.weather(spark, sf).select("station", "ts", "pbl_height"), ["station", "ts"], "left").withColumn("x", profile.layer_inversion(F.col("levels"), F.col("z"), F.col("pbl_height")))
    height = lambda p: F.try_element_at(F.filter("z", lambda e: e["p"] == F.col(p)), F.lit(1))["z"]
    return rows.select("station", "ts", "x.detected", "x.category", "x.base_pressure", "x.top_pressure", height("x.base_pressure").alias("base_height"), height("x.top_pressure").alias("top_height"), "x.source")


# ---- nearest neighbours


CUSTOMERS = "cs AS (SELECT c_custkey, 27.5 + (c_custkey * 37 % 551) / CAST(100.0 AS DOUBLE) AS slat, 73.5 + (c_custkey * 91 % 501) / CAST(100.0 AS DOUBLE) AS slon FROM customer)"


def customer_places(spark, sf):
    k = F.col("c_custkey")
    return v.table(spark, sf, "customer").select(k, (27.5 + (k * 37 % 551) / F.lit(100.0)).alias("slat"), (73.5 + (k * 91 % 501) / F.lit(100.0)).alias("slon"))


@query(v.with_views("fires", more=f"{CUSTOMERS}, d AS (SELECT fire_id, c_custkey, (lat - slat) * (lat - slat) + (lon - slon) * (lon - slon) AS d FROM fires, cs), m AS (SELECT fire_id, min(d) AS d FROM d GROUP BY 1)") + "SELECT d.fire_id, min(c_custkey) AS c_custkey, round(sqrt(min(d.d)), 6) AS degrees FROM d JOIN m ON m.fire_id = d.fire_id AND m.d = d.d GROUP BY 1")
def fire_nearest_customer(spark, sf):
    places = customer_places(spark, sf).withColumnRenamed("c_custkey", "station")
    out = nearest.nearest_in_degrees(v.fires(spark, sf), places)
    return out.select("fire_id", F.col("station").alias("c_custkey"), F.round(F.sqrt("distance"), 6).alias("degrees"))


FILLED = f"u AS (SELECT max(hour) AS u FROM panel), hs AS (SELECT DISTINCT station FROM panel, u WHERE hour >= u - INTERVAL 24 HOUR), lt AS (SELECT station, arg_max(pm25, hour) AS pm25, max(hour) AS hour FROM (SELECT station, hour, pm25 FROM panel) GROUP BY 1), km AS (SELECT c_custkey, s.station, {q.haversine('cs.slat', 'cs.slon', 's.slat', 's.slon')} AS km, row_number() OVER (PARTITION BY c_custkey ORDER BY {q.haversine('cs.slat', 'cs.slon', 's.slat', 's.slon')}, s.station) AS k FROM cs, stations5 s JOIN hs ON hs.station = s.station)"


@query(v.with_views("panel", "stations5", more=f"{CUSTOMERS}, {FILLED}") + "SELECT 100 + c_custkey AS station, u - to_hours(h) AS ts, p.pm25, CAST(km.station AS BIGINT) AS copied_from, 'demo_proxy' AS data_source FROM km JOIN lt ON lt.station = km.station JOIN panel p ON p.station = lt.station AND p.hour = lt.hour, u, (SELECT CAST(unnest(range(24)) AS INT) AS h) WHERE k = 1")
def filled_from_neighbours(spark, sf):
    """Places of all customers count as stations without readings."""
    readings = v.panel(spark, sf).select(F.col("station").cast("long").alias("station"), F.col("hour").alias("ts"), "pm25")
    known = v.stations(spark).select(F.col("station").cast("long").alias("station"), "slat", "slon")
    places = known.unionByName(customer_places(spark, sf).select((100 + F.col("c_custkey")).alias("station"), "slat", "slon"))
    until = readings.agg(F.max("ts")).first()[0]
    return nearest.filled_from_neighbours(readings, places, "ts", F.lit(until).cast("timestamp_ntz"))


# ---- landed files


def landed(df, base: str, name: str) -> None:
    """Writes CSV files of one dialect, as a feed would leave them."""
    df.write.option("header", True).csv(f"{base}/{name}")


@query(v.with_views("panel") + "SELECT CAST(station AS VARCHAR) AS station, hour AS timestamp, pm25, CASE WHEN station % 3 < 2 THEN no2 END AS no2, concat_ws(',', CASE WHEN pm25 > 1000 THEN 'pm25_oor' END, CASE WHEN station % 3 < 2 AND no2 > 1000 THEN 'no2_oor' END) AS range_flags FROM (SELECT station, hour, pm25, no2 FROM panel)")
def mixed_headers(spark, sf):
    """Files of three dialects: names and an order of their own, comments, three ways to write a time, and one pollutant less."""
    base, rows = shared_dir(spark, "feed"), v.panel(spark, sf).select("station", "hour", "pm25", "no2")
    stamp = F.date_format("hour", "yyyy-MM-dd HH:mm:ss")
    landed(rows.where("station % 3 = 0").select(stamp.alias("From Date"), F.col("pm25").alias("PM2.5"), F.col("no2").alias("NO2"), F.col("station").alias("Station")), base, "a")
    commented = rows.where("station % 3 = 1").select(F.col("no2").cast("string").alias("no2"), "station", F.date_format("hour", "dd-MM-yyyy HH:mm").alias("timestamp"), "pm25")
    landed(commented.unionByName(spark.createDataFrame([("# placeholder",)], "no2 string"), allowMissingColumns=True), base, "b")
    landed(rows.where("station % 3 = 2").select("station", F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("pm25").alias("PM2.5 (ug/m3)")), base, "c")
    return files.pollution(spark, f"{base}/*/*.csv").select("station", "timestamp", "pm25", "no2", "range_flags")


PBL = "pb AS (SELECT station, ts, slat AS lat, slon AS lon, CASE WHEN hour(ts) % 7 <> 3 THEN pbl_height END AS x, row_number() OVER (PARTITION BY station ORDER BY ts) AS k FROM weather JOIN stations5 USING (station)), g AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS x0, last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER a AS n0, first_value(x IGNORE NULLS) OVER b AS x1, first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER b AS n1 FROM pb WINDOW a AS (PARTITION BY station ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(v.with_views("weather", "stations5", more=PBL) + "SELECT CAST(station AS VARCHAR) AS station, ts AS timestamp, lat, lon, CASE WHEN x IS NOT NULL THEN x WHEN k - n0 <= 6 THEN CASE WHEN n1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (k - n0) / (n1 - n0) END END AS pbl_height FROM g")
def boundary_layer_files(spark, sf):
    """Files by station and files by grid place, with heights that are out of range."""
    base, places = shared_dir(spark, "feed"), v.stations(spark)
    rows = v.weather(spark, sf).select("station", F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), F.when(F.hour("ts") % 7 == 3, F.lit(-5.0) * 1000).otherwise(F.col("pbl_height")).alias("boundary_layer_height"))
    landed(rows.where("station < 3"), base, "a")
    gridded = rows.where("station >= 3").join(places, "station").select(F.col("time").alias("datetime"), (F.col("slat") + 0.004).alias("Latitude"), (F.col("slon") - 0.003).alias("Longitude"), F.col("boundary_layer_height").alias("PBL Height"))
    landed(gridded, base, "b")
    out = files.atmosphere(spark, f"{base}/*/*.csv", places)
    back = places.select(F.col("station").cast("string").alias("station"), "slat", "slon")
    return out.drop("lat", "lon").join(back, "station").select("station", "timestamp", F.col("slat").alias("lat"), F.col("slon").alias("lon"), "pbl_height")


# ---- binary dumps


CELLS = "pt AS (SELECT date_trunc('hour', acq) AS time, CAST(CASE WHEN fire_id % 2 = 0 THEN 10 ELSE 100 END AS INT) AS level, CAST(floor((lon - 73.5) / CAST(0.125 AS DOUBLE)) + 1 AS INT) AS i, CAST(floor((lat - 27.5) / CAST(0.125 AS DOUBLE)) + 1 AS INT) AS j, CAST(CAST(frp AS FLOAT) AS DOUBLE) AS value FROM fires), pp AS (SELECT *, 27.5 + (j - 1) * CAST(0.125 AS DOUBLE) AS lat, 73.5 + (i - 1) * CAST(0.125 AS DOUBLE) AS lon FROM pt)"


def dumped(spark, sf):
    """path, content: a dump for each hour that has fires, their power by cell on two levels."""
    import datetime as dt

    import pandas as pd

    rows = v.fires(spark, sf).select(F.date_trunc("hour", "acq").cast("timestamp_ntz").alias("time"), F.when(F.col("fire_id") % 2 == 0, 10).otherwise(100).alias("level"), F.floor((F.col("lon") - 73.5) / 0.125).alias("i"), F.floor((F.col("lat") - 27.5) / 0.125).alias("j"), "frp")

    def written(key, own):
        start = key[0].to_pydatetime()
        blocks = [[(int(x.i) + 1, int(x.j) + 1, x.frp) for x in own[own["level"] == level].itertuples()] for level in (10, 100)]
        content = dumps.written_dump((48, 48, 0.125, 0.125, 27.5, 73.5), [10, 100], ["PM25"], [(start, start + dt.timedelta(hours=1), blocks)])
        return pd.DataFrame({"path": [start.isoformat()], "content": [content]})

    return rows.groupBy("time").applyInPandas(written, "path string, content binary")


@query(v.with_views("fires", more=CELLS) + "SELECT time, CAST(1.0 AS DOUBLE) AS hours, level, 'PM25' AS species, i, j, lat, lon, value FROM pp")
def dump_points(spark, sf):
    return dumps.dump_points(dumped(spark, sf)).drop("path", "record")


NODES = "cl AS (SELECT a AS i, b AS j, 27.5 + a * CAST(0.5 AS DOUBLE) AS clat, 73.5 + b * CAST(0.5 AS DOUBLE) AS clon FROM range(12) x(a), range(10) y(b))"


@query(v.with_views("fires", more=f"{CELLS}, {NODES}, m AS (SELECT time, cl.i, cl.j, level, value, pow(clat - lat, 2) + pow(clon - lon, 2) AS d2 FROM cl, pp WHERE pow(clat - lat, 2) + pow(clon - lon, 2) <= 0.0625), w AS (SELECT time, i, j, (list_sort(list({{'l': level, 'v': value}}) FILTER (WHERE d2 = 0))[1]).v AS hit, sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0)) AS mean FROM m GROUP BY 1, 2, 3)") + "SELECT t.time, cl.i, cl.j, round(coalesce(hit, mean, 0.0), 5) AS value FROM (SELECT DISTINCT time FROM pp) t CROSS JOIN cl LEFT JOIN w ON w.time = t.time AND w.i = cl.i AND w.j = cl.j")
def dump_surfaces(spark, sf):
    cells = grid.grid(spark, 12, 10, 27.5, 73.5, 0.5)
    return dumps.dump_surfaces(dumps.dump_points(dumped(spark, sf)), cells).select("time", "i", "j", F.round("value", 5).alias("value"))


# ---- writes held by their counts


SEEN = "se AS (SELECT fire_id, CASE fire_id % 3 WHEN 0 THEN 'N20 ' WHEN 1 THEN 'N' END AS satellite, lat, lon, acq, fire_id % 2 = 0 AS synthetic, CASE fire_id % 5 WHEN 0 THEN 'firms_live' WHEN 1 THEN NULL WHEN 2 THEN 'archive' ELSE 'unknown' END AS source, fire_id % 4 <> 3 AS known FROM fires), ac AS (SELECT *, CASE WHEN NOT known THEN 'unmatched' WHEN source = 'firms_live' THEN 'protected' WHEN NOT synthetic AND source IS NOT DISTINCT FROM 'archive' THEN 'unchanged' ELSE 'changed' END AS action FROM se)"


def detections(spark, sf):
    """Stored detections, and the signatures of those that are known."""
    k = F.col("fire_id")
    rows = v.fires(spark, sf).select(k, F.when(k % 3 == 0, "N20 ").when(k % 3 == 1, "N").alias("satellite"), "lat", "lon", "acq", (k % 2 == 0).alias("synthetic"), F.when(k % 5 == 0, "firms_live").when(k % 5 == 1, None).when(k % 5 == 2, "archive").otherwise("unknown").alias("source"))
    known = rows.where(k % 4 != 3).select(F.trim("satellite").alias("satellite"), (F.col("lat") + 0.00001).alias("lat"), (F.col("lon") - 0.00001).alias("lon"), "acq", F.lit(False).alias("synthetic"), F.lit("archive").alias("source"))
    return rows, known


@query(v.with_views("fires", more=SEEN) + "SELECT fire_id, satellite, CASE WHEN action = 'changed' THEN false ELSE synthetic END AS synthetic, CASE WHEN action = 'changed' THEN 'archive' ELSE source END AS source FROM ac")
def guarded_backfill(spark, sf):
    path = f"{shared_dir(spark, 'guarded')}/table"
    rows, known = detections(spark, sf)
    rows.write.parquet(path)
    guarded.guarded_update(spark, path, known)
    return spark.read.parquet(path).select("fire_id", "satellite", "synthetic", "source")


@query(v.with_views("fires", more=SEEN) + "SELECT action, count(*) AS n, count(*) FILTER (WHERE action = 'changed' AND source IS NULL) AS n_filled FROM ac GROUP BY 1")
def guarded_actions(spark, sf):
    out = guarded.reclassified(*detections(spark, sf))
    return out.groupBy(F.col("__action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_if("__filled").alias("n_filled"))
