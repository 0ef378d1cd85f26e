"""Queries: cleaning, joins, aggregates, top-k and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrlake.functions import geo
from zephyrlake.operators import align, clean, fire, network, upsert
from zephyrlake.plans import sqlparts as q
from zephyrlake.plans import views as v

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df, *names):
    """Doubles rounded to six places, so that the order of sums doesn't show."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- projections, filters, cleaning


@query(v.with_views("obs") + "SELECT station, ts, pollutant, v, concat_ws(',', CASE WHEN v < 5 OR v > 200 THEN 'v_oor' END) AS range_flags, greatest(5.0, least(200.0, v)) AS clamped FROM obs")
def range_clamp_flags(spark, sf):
    rows = v.obs(spark, sf)
    return clean.clamped(rows.withColumn("raw", F.col("v")), {"v": (5, 200)}).select("station", "ts", "pollutant", F.col("raw").alias("v"), "range_flags", F.col("v").alias("clamped"))


@query(v.with_views("obs", more="s AS (SELECT avg(v) AS m, stddev_samp(v) AS d FROM obs)") + "SELECT station, ts, pollutant, v, abs(v - m) > 2 * d AS v_outlier FROM obs, s")
def zscore_flags(spark, sf):
    return clean.zscore_flags(v.obs(spark, sf), ["v"], 2.0)


@query(v.with_views("obs", more="s AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM obs)") + "SELECT station, ts, pollutant, v, (v < a - 1.0 * (b - a) OR v > b + 1.0 * (b - a)) AS v_iqr_outlier FROM obs, s")
def iqr_flags(spark, sf):
    return clean.iqr_flags(v.obs(spark, sf), ["v"], 1.0)


@query(v.with_views("obs") + "SELECT station, pollutant, hour, ts, v FROM (SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY station, pollutant, date_trunc('hour', ts) ORDER BY ts DESC, v DESC) AS k FROM obs) WHERE k = 1")
def hour_dedupe(spark, sf):
    return clean.hour_deduped(v.obs(spark, sf), ["station", "pollutant"], "ts", ["v"]).select("station", "pollutant", "hour", "ts", "v")


@query(v.with_views("panel") + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, CAST(round_even(100.0 * (count(*) - count({c})) / count(*), 4) AS DOUBLE) AS null_pct FROM panel" for c in v.POLLUTANTS))
def null_audit(spark, sf):
    return clean.null_audit(v.panel(spark, sf), v.POLLUTANTS)


@query(v.with_views("panel") + "SELECT station, hour, pm25, pm10, o3, no2, so2 FROM panel WHERE (pm25 IS NULL)::INT + (pm10 IS NULL)::INT + (o3 IS NULL)::INT + (no2 IS NULL)::INT + (so2 IS NULL)::INT <= 2.5")
def heavy_null_filter(spark, sf):
    return clean.without_gappy(v.panel(spark, sf), v.POLLUTANTS)


@query(v.with_views("fires") + f"SELECT fire_id, {q.region('lat', 'lon')} AS region FROM fires")
def region_assign(spark, sf):
    return v.fires(spark, sf).select("fire_id", geo.region(F.col("lat"), F.col("lon")).alias("region"))


@query(v.with_views("fires", more="c AS (SELECT *, CASE fire_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'nominal' WHEN 2 THEN 'high' ELSE 'odd' END AS confidence FROM fires)") + "SELECT fire_id, confidence FROM c WHERE confidence IN ('nominal', 'high')")
def confidence_filter(spark, sf):
    c = F.element_at(F.array(*[F.lit(x) for x in ("low", "nominal", "high", "odd")]), (F.col("fire_id") % 4 + 1).cast("int"))
    return clean.confident(v.fires(spark, sf).withColumn("confidence", c)).select("fire_id", "confidence")


@query("SELECT o_orderkey AS fire_id, date_trunc('day', o_orderdate) + CASE WHEN (o_orderkey * 13) % 2500 = 2400 THEN to_minutes(1440) WHEN ((o_orderkey * 13) % 2500) // 100 <= 23 AND ((o_orderkey * 13) % 2500) % 100 <= 59 THEN to_minutes(CAST(((o_orderkey * 13) % 2500) // 100 * 60 + ((o_orderkey * 13) % 2500) % 100 AS INT)) ELSE to_minutes(0) END AS acq FROM orders")
def acquisition_time(spark, sf):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("fire_id"), clean.acquired_at(date, (F.col("o_orderkey") * 13 % 2500).cast("int")).alias("acq"))


@query(v.with_views("weather", more="m AS (SELECT quantile_cont(wind_speed, 0.5) > 3 AS kmh FROM weather)") + "SELECT station, ts, CASE WHEN kmh THEN wind_speed / CAST(3.6 AS DOUBLE) ELSE wind_speed END AS wind_speed FROM weather, m")
def speed_units(spark, sf):
    return clean.speed_in_mps(v.weather(spark, sf).select("station", "ts", "wind_speed"), limit=3.0)


# ---- joins


@query(v.with_views("panel", "weather") + "SELECT p.station, p.hour, p.pm25, p.pm10, w.wind_speed, w.pbl_height FROM panel p LEFT JOIN weather w ON p.station = w.station AND p.hour = w.ts")
def align_panel(spark, sf):
    w = v.weather(spark, sf).withColumnRenamed("ts", "hour")
    return align.aligned(v.panel(spark, sf), w, ["station", "hour"]).select("station", "hour", "pm25", "pm10", "wind_speed", "pbl_height")


@query(v.with_views("panel", "weather") + "SELECT coalesce(p.station, w.station) AS station, coalesce(p.hour, w.ts) AS hour, p.pm25, w.temperature FROM panel p FULL JOIN weather w ON p.station = w.station AND p.hour = w.ts")
def full_outer_history(spark, sf):
    w = v.weather(spark, sf).withColumnRenamed("ts", "hour")
    return align.full_history(v.panel(spark, sf), w, ["station", "hour"]).select("station", "hour", "pm25", "temperature")


@query(v.with_views("obs", "weather") + "SELECT o.station, o.ts, o.v, w.ts AS matched_ts, w.wind_speed FROM (SELECT * FROM obs WHERE pollutant = 'pm25') o ASOF LEFT JOIN weather w ON o.station = w.station AND o.ts >= w.ts")
def asof_backward(spark, sf):
    o = v.obs(spark, sf).where("pollutant = 'pm25'").select("station", "ts", "v")
    return align.asof_backward(o, v.weather(spark, sf), ["station"], "ts", ["wind_speed"])


@query(v.with_views("obs", "weather", more="x AS (SELECT o.station, o.ts, o.v, w.ts AS matched_ts, w.pbl_height, row_number() OVER (PARTITION BY o.station, o.ts, o.v ORDER BY abs(epoch_us(o.ts) - epoch_us(w.ts)), w.ts) AS k FROM (SELECT station, ts, v FROM obs WHERE pollutant = 'pm25') o LEFT JOIN weather w ON o.station = w.station AND w.ts BETWEEN o.ts - INTERVAL 2 HOURS AND o.ts + INTERVAL 2 HOURS)") + "SELECT station, ts, v, matched_ts, pbl_height FROM x WHERE k = 1")
def asof_nearest_2h(spark, sf):
    o = v.obs(spark, sf).where("pollutant = 'pm25'").select("station", "ts", "v")
    return align.asof_nearest(o, v.weather(spark, sf), ["station"], "ts", ["pbl_height"], 2.0)


MEASURES = """SELECT {keys}, count(*) AS n, min(km) AS near, sum(frp * greatest(cos(radians(ang)), 0.0) / (km + 1.0)) AS raw, count(*) FILTER (WHERE ang <= 90) AS aligned, max(wind_speed) AS speed"""
BEARING = q.bearing("slat", "slon", "lat", "lon")
NEAR = f"near AS (SELECT station, fire_id, lat, lon, frp, acq, {q.haversine('slat', 'slon', 'lat', 'lon')} AS km, {BEARING} AS bearing FROM fires, stations5)"
FIRE_OUT = """SELECT {keys}, coalesce(n, 0) AS fire_count, coalesce(CAST(round_even(near, 2) AS DOUBLE), 501.0) AS nearest_fire_distance, coalesce(aligned, 0) AS wind_aligned_fire_count, coalesce(round(100.0 * aligned / n, 3), 0.0) AS alignment FROM {source}"""


def fire_frame(df):
    return df.select("station", "ts", "fire_count", "nearest_fire_distance", "wind_aligned_fire_count", F.round(F.when(F.col("fire_count") > 0, 100.0 * F.col("wind_aligned_fire_count") / F.col("fire_count")).otherwise(0.0), 3).alias("alignment"))


def fire_sql(before: int, after: int) -> str:
    near = v.with_views("fires", "stations5", "weather", more=NEAR)
    met = f"SELECT w.station, w.ts, w.wind_speed, n.frp, n.km, CASE WHEN abs(bearing - wind_direction) > 180 THEN 360 - abs(bearing - wind_direction) ELSE abs(bearing - wind_direction) END AS ang FROM weather w JOIN near n ON n.station = w.station AND n.km <= 500 AND n.acq BETWEEN w.ts - INTERVAL {before} HOURS AND w.ts + INTERVAL {after} HOURS"
    return near + f", met AS ({met}), m AS ({MEASURES.format(keys='station, ts')} FROM met GROUP BY 1, 2), j AS (SELECT w.station, w.ts, n, near, aligned FROM weather w LEFT JOIN m ON m.station = w.station AND m.ts = w.ts) " + FIRE_OUT.format(keys="station, ts", source="j")


@query(fire_sql(24, 0))
def fire_trailing_24h(spark, sf):
    return fire_frame(fire.trailing_fires(v.weather(spark, sf), v.fires(spark, sf), v.stations(spark), 24.0))


@query(fire_sql(1, 1))
def fire_pm1h(spark, sf):
    return fire_frame(fire.trailing_fires(v.weather(spark, sf), v.fires(spark, sf), v.stations(spark), 1.0, after_hours=1.0))


@query(v.with_views("fires", "stations5", "panel", more=NEAR) + "SELECT p.station, p.hour, count(n.fire_id) FILTER (WHERE km <= 500) AS fire_count, round(coalesce(sum(n.frp) FILTER (WHERE km <= 500), 0.0), 6) AS total_frp, round(min(km), 3) AS nearest_fire_distance FROM panel p LEFT JOIN near n ON n.station = p.station AND date_trunc('hour', n.acq) = p.hour GROUP BY 1, 2")
def fire_same_hour(spark, sf):
    out = fire.same_hour_fires(v.panel(spark, sf), v.fires(spark, sf), v.stations(spark))
    return out.select("station", "hour", "fire_count", F.round("total_frp", 6).alias("total_frp"), F.round("nearest_fire_distance", 3).alias("nearest_fire_distance"))


@query(v.with_views("fires", "stations5", more="d AS (SELECT fire_id, date_trunc('hour', acq) AS hour, frp, station, row_number() OVER (PARTITION BY fire_id ORDER BY (lat - slat) * (lat - slat) + (lon - slon) * (lon - slon), station) AS k FROM fires, stations5)") + "SELECT station, hour, count(*) AS fire_count, round(avg(frp), 6) AS mean_frp, round(max(frp), 6) AS max_frp FROM d WHERE k = 1 GROUP BY 1, 2")
def fire_nearest_station(spark, sf):
    rows = align.nearest_of(v.fires(spark, sf), v.stations(spark)).groupBy("station", F.date_trunc("hour", "acq").cast("timestamp_ntz").alias("hour"))
    return r6(rows.agg(F.count(F.lit(1)).alias("fire_count"), F.avg("frp").alias("mean_frp"), F.max("frp").alias("max_frp")), "mean_frp", "max_frp")


@query(v.with_views("panel", "forecasts") + "SELECT f.station, f.hour, f.p, q.pm10 AS actual, round(q.pm10 - f.p, 6) AS delta FROM forecasts f LEFT JOIN panel q ON q.station = f.station AND q.hour = f.hour")
def forecast_vs_observed(spark, sf):
    seen = v.panel(spark, sf).select("station", "hour", F.col("pm10").alias("actual"))
    return r6(align.forecast_outcomes(v.forecasts(spark, sf).select("station", "hour", "p"), seen, ["station"], "hour", "p", "actual"), "delta")


OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t FROM orders WHERE o_orderkey % 3 <> 0)"
NEW = "new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS t FROM orders WHERE o_orderkey % 2 = 0)"


def old_new(spark, sf):
    k = F.col("o_orderkey")
    rows = v.table(spark, sf, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("t"))
    return rows.where("k % 3 <> 0"), rows.where("k % 2 = 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")))


@query(f"WITH {OLD}, {NEW} SELECT new.k, new.s, new.t, CASE WHEN old.k IS NULL THEN 'insert' WHEN old.s IS NOT DISTINCT FROM new.s AND old.t IS NOT DISTINCT FROM new.t THEN 'unchanged' ELSE 'update' END AS action FROM new LEFT JOIN old ON old.k = new.k")
def merge_actions(spark, sf):
    return upsert.actions(*old_new(spark, sf), ["k"], ["s", "t"])


@query(f"WITH {OLD}, {NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)")
def merged_table(spark, sf):
    return upsert.merged(*old_new(spark, sf), ["k"])


@query(f"WITH {OLD}, {NEW} SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def anti_join_upsert(spark, sf):
    return upsert.unseen(*old_new(spark, sf), ["k"])


@query(v.with_views("panel", more="f AS (SELECT p.station, p.hour, coalesce(p.pm25, p.pm10) AS pm25, p.pm10 FROM panel p)") + "SELECT * FROM f")
def null_backfill(spark, sf):
    rows = v.panel(spark, sf).select("station", "hour", "pm25", "pm10")
    return upsert.backfilled(rows, rows.select("station", "hour", F.col("pm10").alias("pm25")), ["station", "hour"], ["pm25"])


@query(v.with_views("panel", more="e AS (SELECT station, max(hour) AS m FROM panel WHERE pm25 IS NOT NULL GROUP BY 1), s AS (SELECT e.station, e.m - to_hours(CAST(i AS INT)) AS hour, p.pm25 FROM e JOIN panel p ON p.station = e.station AND p.hour = e.m, range(0, 24) t(i))") + "SELECT s.station, s.hour, s.pm25, TRUE AS re_stamped FROM s LEFT JOIN panel p ON p.station = s.station AND p.hour = s.hour AND p.pm25 IS NOT NULL WHERE p.station IS NULL")
def missing_slots(spark, sf):
    rows = v.panel(spark, sf).where("pm25 is not null").select("station", "hour", "pm25")
    return upsert.missing_slots(network.latest(rows, ["station"], "hour"), rows, ["station"], "hour")


# ---- aggregates and top-k


@query(v.with_views("obs") + "SELECT station, pollutant, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY station, pollutant ORDER BY ts DESC, v DESC) AS k FROM obs) WHERE k = 1")
def latest_per_station(spark, sf):
    return network.latest(v.obs(spark, sf), ["station", "pollutant"], "ts").select("station", "pollutant", "ts", "v")


@query(v.with_views("panel") + "SELECT * FROM panel")
def hourly_pivot(spark, sf):
    return v.panel(spark, sf)


@query(v.with_views("panel") + "SELECT station, hour, pollutant, v FROM (UNPIVOT panel ON pm25, pm10, o3, no2, so2 INTO NAME pollutant VALUE v) WHERE v >= 0")
def hourly_unpivot(spark, sf):
    return network.unpivoted(v.panel(spark, sf), ["station", "hour"], v.POLLUTANTS)


@query(v.with_views("panel") + "SELECT hour, round(avg(pm25), 6) AS pm25, round(avg(pm10), 6) AS pm10, count(DISTINCT station) AS n_stations FROM panel WHERE station IN (0, 2, 4) GROUP BY 1")
def regional_composite(spark, sf):
    return r6(network.composite(v.panel(spark, sf), [0, 2, 4], "hour", ["pm25", "pm10"]), "pm25", "pm10")


@query(v.with_views("obs", more="e AS (SELECT max(ts) AS edge FROM obs), c AS (SELECT station, count(*) AS n, count(*) FILTER (WHERE date_diff('second', ts, edge) <= 172800) AS n_recent, string_agg(DISTINCT pollutant, '+' ORDER BY pollutant) AS sources, round((max(epoch(date_trunc('second', ts))) - min(epoch(date_trunc('second', ts)))) / 3600.0, 4) AS span_h FROM obs, e GROUP BY 1)") + "SELECT *, CASE WHEN n_recent = 0 THEN 'stale' WHEN n_recent < 8 THEN 'limited' WHEN n < 96 THEN 'insufficient_history' ELSE 'adequate' END AS sufficiency FROM c")
def coverage_report(spark, sf):
    return network.coverage(v.obs(spark, sf)).withColumn("span_h", F.round("span_h", 4))


@query(v.with_views("weather", more="w AS (SELECT station, avg(wind_speed) AS s, (degrees(atan2(sum(sin(radians(wind_direction))), sum(cos(radians(wind_direction))))) + 360.0) % 360.0 AS d, count(*) AS n FROM weather GROUP BY 1)") + f"SELECT station, CAST(round_even(s, 2) AS DOUBLE) AS wind_speed, CAST(round_even(d, 1) AS DOUBLE) AS wind_direction, {q.compass('d')} AS compass_from, n AS stations_used FROM w")
def circular_wind(spark, sf):
    return network.mean_wind(v.weather(spark, sf), ["station"])


@query("SELECT l_suppkey, l_quantity, l_discount, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def repeat_audit(spark, sf):
    return network.repeats(v.table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"], "l_shipdate", 3)


@query(v.with_views("obs") + "SELECT station, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(round_even(greatest(0.0, (epoch(TIMESTAMP '2024-01-31') - max(epoch(date_trunc('second', ts)))) / 3600.0), 2) AS DOUBLE) AS age_h, greatest(0.0, (epoch(TIMESTAMP '2024-01-31') - max(epoch(date_trunc('second', ts)))) / 3600.0) > 6 AS stale FROM obs GROUP BY 1")
def provenance(spark, sf):
    return network.provenance(v.obs(spark, sf), F.lit("2024-01-31").cast("timestamp"))


@query(v.with_views("obs") + "SELECT pollutant, count(*) AS n, count(DISTINCT station) AS n_stations, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY 1")
def summary_stats(spark, sf):
    p = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = v.obs(spark, sf).groupBy("pollutant").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station").alias("n_stations"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), p.alias("q"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return r6(out.select("pollutant", "n", "n_stations", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "first_ts", "last_ts"), "mean", "std", "q25", "q50", "q75")


@query(v.with_views("fires", more=f"n AS (SELECT fire_id, frp, {q.haversine('28.6139', '77.2090', 'lat', 'lon')} AS km, {q.bearing('28.6139', '77.2090', 'lat', 'lon')} AS b FROM fires), s AS (SELECT fire_id, km, frp * greatest(0.0, cos(radians(CASE WHEN abs(b - 315) > 180 THEN 360 - abs(b - 315) ELSE abs(b - 315) END))) * greatest(0.0, 1 - km / 500.0) AS score FROM n)") + "SELECT fire_id, round(km, 3) AS km, round(score, 6) AS score FROM s ORDER BY score DESC, fire_id LIMIT 6")
def transport_pathways_top6(spark, sf):
    lat, lon = F.lit(28.6139), F.lit(77.2090)
    rows = v.fires(spark, sf).withColumn("km", geo.haversine(lat, lon, F.col("lat"), F.col("lon"))).withColumn("b", geo.bearing(lat, lon, F.col("lat"), F.col("lon")))
    score = F.col("frp") * F.greatest(F.lit(0.0), F.cos(F.radians(geo.angle_between(F.col("b"), F.lit(315.0))))) * F.greatest(F.lit(0.0), 1 - F.col("km") / 500.0)
    return rows.select("fire_id", F.round("km", 3).alias("km"), F.round(score, 6).alias("score"), score.alias("o")).orderBy(F.desc("o"), "fire_id").limit(6).drop("o")


@query(v.with_views("fires") + "SELECT fire_id, acq, frp FROM fires WHERE frp >= 100 ORDER BY acq DESC, frp DESC, fire_id LIMIT 500")
def latest_fires_500(spark, sf):
    return v.fires(spark, sf).where("frp >= 100").select("fire_id", "acq", "frp").orderBy(F.desc("acq"), F.desc("frp"), "fire_id").limit(500)


@query(v.with_views("fires", "stations5") + "SELECT CAST(count(*) AS BIGINT) AS n_fires, count(*) FILTER (WHERE frp > 300) AS n_strong, round(avg(frp), 6) AS mean_frp, max(acq) AS last_acq, (SELECT count(*) FROM stations5) AS n_stations FROM fires")
def fire_activity(spark, sf):
    f = v.fires(spark, sf).agg(F.count(F.lit(1)).alias("n_fires"), F.count_if(F.col("frp") > 300).alias("n_strong"), F.round(F.avg("frp"), 6).alias("mean_frp"), F.max("acq").alias("last_acq"))
    return f.crossJoin(v.stations(spark).agg(F.count(F.lit(1)).alias("n_stations")))  # one row each


@query(v.with_views("weather") + "SELECT concat_ws(',', CAST(station AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S'), regexp_replace(printf('%.4f', temperature), '\\.?0+$', '')) AS line FROM weather WHERE ts >= TIMESTAMP '2024-01-20' AND station = 1")
def export_lines(spark, sf):
    rows = v.weather(spark, sf).where("ts >= timestamp_ntz'2024-01-20 00:00:00' and station = 1").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return upsert.csv_lines(rows, ["station", "ts", "temperature"])
