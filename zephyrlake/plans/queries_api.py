"""Queries: the read side of the service, one per served view, and its reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from zephyrlake.functions import aqi, geo, met
from zephyrlake.operators import clean, network, rules, series
from zephyrlake.plans import sqlparts as q
from zephyrlake.plans import views as v
from zephyrlake.plans.queries_series import SPLIT, split_forecasts
from zephyrlake.plans.queries_table import r6

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(v.with_views("obs") + "SELECT station, ts, pollutant, v FROM obs WHERE station = 3 ORDER BY ts DESC, v DESC LIMIT 168")
def pollution_history(spark, sf):
    return v.obs(spark, sf).where("station = 3").orderBy(F.desc("ts"), F.desc("v")).limit(168)


@query(v.with_views("weather") + "SELECT * FROM weather WHERE station = 2 ORDER BY ts DESC LIMIT 24")
def weather_history(spark, sf):
    return v.weather(spark, sf).where("station = 2").orderBy(F.desc("ts")).limit(24)


@query(v.with_views("weather") + "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC) AS k FROM weather) WHERE k = 1")
def weather_latest(spark, sf):
    return network.latest(v.weather(spark, sf), ["station"], "ts")


@query(v.with_views("fires") + "SELECT fire_id, acq, frp FROM fires WHERE acq >= TIMESTAMP '2024-01-28' ORDER BY acq DESC, frp DESC, fire_id LIMIT 200")
def fires_recent(spark, sf):
    return v.fires(spark, sf).where("acq >= timestamp_ntz'2024-01-28 00:00:00'").select("fire_id", "acq", "frp").orderBy(F.desc("acq"), F.desc("frp"), "fire_id").limit(200)


@query(v.with_views("fires") + "SELECT fire_id, lat, lon FROM (SELECT * FROM (SELECT * FROM fires ORDER BY acq DESC, fire_id LIMIT 1000) WHERE lat BETWEEN 28.2 AND 28.9 AND lon BETWEEN 76.6 AND 77.5 ORDER BY acq DESC, fire_id LIMIT 60)")
def fires_in_domain(spark, sf):
    newest = v.fires(spark, sf).orderBy(F.desc("acq"), "fire_id").limit(1000)
    return newest.where("lat between 28.2 and 28.9 and lon between 76.6 and 77.5").orderBy(F.desc("acq"), "fire_id").limit(60).select("fire_id", "lat", "lon")


@query(v.with_views("fires") + "SELECT round(avg(frp), 6) AS mean_frp, count(*) AS n, min(km) AS nearest FROM (SELECT frp, round(" + q.haversine("28.6139", "77.2090", "lat", "lon") + ", 6) AS km FROM fires ORDER BY acq DESC, fire_id LIMIT 500)")
def fire_context(spark, sf):
    rows = v.fires(spark, sf).orderBy(F.desc("acq"), "fire_id").limit(500)
    km = F.round(geo.haversine(F.lit(28.6139), F.lit(77.2090), F.col("lat"), F.col("lon")), 6)
    return rows.agg(F.round(F.avg("frp"), 6).alias("mean_frp"), F.count(F.lit(1)).alias("n"), F.min(km).alias("nearest"))


@query("WITH s AS (SELECT o_custkey AS k, o_orderdate AS d, 'real' AS source FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_custkey AS k, o_orderdate AS d, 'synthetic' AS source FROM orders WHERE o_orderkey % 3 = 0) SELECT k, d, max(source) AS source FROM (SELECT * FROM s UNION ALL SELECT * FROM t) GROUP BY 1, 2")
def union_deduped(spark, sf):
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"))
    real, made = rows.where("o_orderkey % 2 = 0").select("k", "d", F.lit("real").alias("source")), rows.where("o_orderkey % 3 = 0").select("k", "d", F.lit("synthetic").alias("source"))
    return clean.latest_by(real.unionByName(made), ["k", "d"], [F.desc("source")])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_keys(spark, sf):
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(v.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query(v.with_views("obs") + "SELECT station, date_trunc('hour', ts) AS hour, pollutant, count(*) AS n FROM obs GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return v.obs(spark, sf).groupBy("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "pollutant").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(v.with_views("forecasts", more=SPLIT) + "SELECT split, count(*) AS n, min(hour) AS first_hour, max(hour) AS last_hour FROM sp GROUP BY 1")
def split_ranges(spark, sf):
    return split_forecasts(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


@query(v.with_views("panel") + "SELECT round(avg(pm25), 6) AS pm25, count(*) AS n_stations FROM (SELECT station, arg_max(pm25, hour) AS pm25 FROM panel WHERE pm25 IS NOT NULL GROUP BY 1)")
def network_pm25(spark, sf):
    last = v.panel(spark, sf).where("pm25 is not null").groupBy("station").agg(F.max_by("pm25", "hour").alias("pm25"))
    return last.agg(F.round(F.avg("pm25"), 6).alias("pm25"), F.count(F.lit(1)).alias("n_stations"))


@query(v.with_views("obs") + "SELECT station, round(avg(v), 6) AS baseline FROM obs WHERE pollutant = 'pm25' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts > TIMESTAMP '2024-01-19 12:00:00' GROUP BY 1")
def observed_24h_mean(spark, sf):
    release = v.stations(spark).select("station", F.expr("timestamp_ntz'2024-01-20 12:00:00'").alias("release"))
    rows = v.obs(spark, sf).where("pollutant = 'pm25'")
    within = rows.join(release, "station").where("ts <= release and ts > release - interval 24 hours")
    return within.groupBy("station").agg(F.round(F.avg("v"), 6).alias("baseline"))


@query(v.with_views("panel", more="h AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY hour) - 1 AS horizon, pm10 FROM panel)") + "SELECT station, CASE WHEN horizon < 24 THEN '0-24' WHEN horizon < 48 THEN '24-48' ELSE '48-72' END AS bucket, max(pm10) AS peak FROM h WHERE horizon < 72 GROUP BY 1, 2")
def horizon_buckets(spark, sf):
    h = F.row_number().over(Window.partitionBy("station").orderBy("hour")) - 1
    rows = v.panel(spark, sf).select("station", "pm10", h.alias("horizon")).where("horizon < 72")
    bucket = F.when(F.col("horizon") < 24, "0-24").when(F.col("horizon") < 48, "24-48").otherwise("48-72")
    return rows.groupBy("station", bucket.alias("bucket")).agg(F.max("pm10").alias("peak"))


@query(v.with_views("weather") + "SELECT ts, round(avg(wind_speed * pbl_height), 4) AS mean_ventilation, arg_min(station, (wind_speed * pbl_height, station)) AS worst_station, min(pbl_height) AS min_pbl, count(*) AS n_stations FROM weather GROUP BY 1")
def atmosphere_network(spark, sf):
    c = F.col("wind_speed") * F.col("pbl_height")
    return v.weather(spark, sf).groupBy("ts").agg(F.round(F.avg(c), 4).alias("mean_ventilation"), F.min_by("station", F.struct(c, F.col("station"))).alias("worst_station"), F.min("pbl_height").alias("min_pbl"), F.count(F.lit(1)).alias("n_stations"))


@query(v.with_views("obs", "fires", more="l AS (SELECT station, arg_max(v, (ts, v)) AS v FROM obs WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1), m AS (SELECT round_even(avg(v), 0) AS aqi FROM l), f AS (SELECT avg(frp) AS frp FROM fires)") + "SELECT CAST(aqi AS INT) AS aqi, CASE WHEN aqi <= 200 THEN 0 WHEN aqi <= 300 THEN 1 WHEN aqi <= 400 THEN 2 WHEN aqi <= 450 THEN 3 ELSE 4 END AS stage, CASE WHEN frp >= 80 THEN 'elevated' WHEN frp >= 40 THEN 'moderate' END AS fire_note FROM m, f")
def grap_current(spark, sf):
    last = v.obs(spark, sf).where("ts >= timestamp_ntz'2024-01-29 00:00:00'").groupBy("station").agg(F.max_by("v", F.struct("ts", "v")).alias("v"))
    mean = last.agg(F.bround(F.avg("v"), 0).cast("int").alias("aqi"))
    frp = v.fires(spark, sf).agg(F.avg("frp").alias("frp"))
    note = F.when(F.col("frp") >= 80, "elevated").when(F.col("frp") >= 40, "moderate")
    return mean.crossJoin(frp).select("aqi", aqi.stage(F.col("aqi")).alias("stage"), note.alias("fire_note"))  # one row each


@query(v.with_views("weather") + "SELECT station, ts, round(" + "287.05 / 9.80665 * ((temperature + temperature - 6) / 2 + 273.15) * ln(1000.0 / 925.0), 4) AS thickness_m, round((-6.0) / 75.0 * 100.0, 6) AS lapse FROM weather")
def layer_thickness(spark, sf):
    t = F.col("temperature")
    return v.weather(spark, sf).select("station", "ts", F.round(met.thickness(t, t - 6, 1000.0, 925.0), 4).alias("thickness_m"), F.round(met.lapse(1000.0, F.lit(0.0), 925.0, F.lit(-6.0)), 6).alias("lapse"))


@query(v.with_views("obs") + "SELECT station, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS n_recent, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') < 24 AS pooled FROM obs WHERE pollutant = 'pm25' GROUP BY 1")
def data_sufficiency(spark, sf):
    recent = F.count_if(F.col("ts") >= F.expr("timestamp_ntz'2024-01-25 00:00:00'"))
    out = v.obs(spark, sf).where("pollutant = 'pm25'").groupBy("station").agg(recent.alias("n_recent"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("pooled", F.col("n_recent") < 24)


@query(v.with_views("panel", more="d AS (SELECT station, hour, 'SEVERE' AS level, 4 AS severity FROM panel WHERE pm10 >= 350 UNION ALL SELECT station, hour, 'WARNING', 3 FROM panel WHERE pm10 >= 250 AND pm10 < 350)") + "SELECT * FROM d ORDER BY severity DESC, station, hour LIMIT 50")
def alerts_by_severity(spark, sf):
    level = F.when(F.col("pm10") >= 350, "SEVERE").when(F.col("pm10") >= 250, "WARNING")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in rules.SEVERITY.items() for x in kv]), F.col("level"))
    rows = v.panel(spark, sf).select("station", "hour", level.alias("level")).where("level is not null").withColumn("severity", rank)
    return rows.orderBy(F.desc("severity"), "station", "hour").limit(50)


@query(v.with_views("panel") + "SELECT station, hour, round(avg(pm25) OVER w, 6) + 0.0 AS m, count(pm25) OVER w AS n FROM panel WINDOW w AS (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 8 HOURS PRECEDING AND CURRENT ROW)")
def rolling_8h_range(spark, sf):
    w = Window.partitionBy("station").orderBy("s").rangeBetween(-8 * 3600, 0)
    rows = v.panel(spark, sf).withColumn("s", series.seconds("hour"))
    return r6(rows.select("station", "hour", F.avg("pm25").over(w).alias("m"), F.count("pm25").over(w).alias("n")), "m")
