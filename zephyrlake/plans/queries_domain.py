"""Queries: index, meteorology, coupling, rules, grids and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrlake.functions import aqi, geo, met
from zephyrlake.functions.basic import bands
from zephyrlake.operators import clean, evaluate, fire, grid, network, rules, series
from zephyrlake.plans import sqlparts as q
from zephyrlake.plans import views as v
from zephyrlake.plans.queries_table import MEASURES, NEAR, r6

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


P5 = v.POLLUTANTS
MEANS = ", ".join(
    f"CASE WHEN count(CASE WHEN pollutant = '{p}' AND age <= {aqi.WINDOWS[p]} THEN 1 END) >= {network.least_readings(aqi.WINDOWS[p])} THEN avg(CASE WHEN pollutant = '{p}' AND age <= {aqi.WINDOWS[p]} THEN v END) END AS {p}, arg_max(v, (ts, v)) FILTER (WHERE pollutant = '{p}') AS {p}_last" for p in P5
)
CURRENT = f"e AS (SELECT station, max(ts) AS edge_ts FROM obs GROUP BY 1), a AS (SELECT obs.station, pollutant, ts, v, edge_ts, (epoch(date_trunc('second', edge_ts)) - epoch(date_trunc('second', ts))) / 3600.0 AS age FROM obs JOIN e USING (station) WHERE v >= 0), m AS (SELECT station, edge_ts, {MEANS} FROM a GROUP BY 1, 2), b AS (SELECT *, coalesce({', '.join(P5)}) IS NOT NULL AS covered FROM m), u AS (SELECT station, edge_ts, CASE WHEN covered THEN 'window_mean' ELSE 'instantaneous' END AS basis, " + ", ".join(f"CASE WHEN covered THEN {'CASE WHEN floor(o3 + 1e-9) > 208 THEN coalesce(o3_last, o3) ELSE o3 END' if p == 'o3' else p} ELSE {p}_last END AS {p}" for p in P5) + " FROM b), i AS (SELECT *, " + ", ".join(f"{q.subindex(p, p)} AS i_{p}" for p in P5) + " FROM u), g AS (SELECT *, greatest(" + ", ".join(f"i_{p}" for p in P5) + ") AS top FROM i)"
DOMINANT = "CASE " + " ".join(f"WHEN i_{p} = top THEN '{p}'" for p in ("pm25", "pm10", "o3", "no2", "so2")) + " END"
INDEX = "CAST(coalesce(round_even(top, 0), 0) AS INT)"


@query(v.with_views("obs", more=CURRENT) + "SELECT station, edge_ts, basis, " + ", ".join(f"round({p}, 6) AS {p}" for p in P5) + f", {INDEX} AS aqi, CASE WHEN top IS NULL THEN 'Unknown' ELSE {q.category(INDEX)} END AS category, {DOMINANT} AS dominant FROM g")
def aqi_current(spark, sf):
    return r6(network.current_index(v.obs(spark, sf)).select("station", "edge_ts", "basis", *P5, "aqi", "category", "dominant"), *P5)


@query(v.with_views("panel") + "SELECT station, hour, " + ", ".join(f"round({q.subindex(p, p)}, 6) AS i_{p}" for p in P5) + " FROM panel")
def aqi_subindex(spark, sf):
    return v.panel(spark, sf).select("station", "hour", *[F.round(aqi.subindex(p, F.col(p)), 6).alias(f"i_{p}") for p in P5])


@query(v.with_views("obs") + f"SELECT station, ts, v, {q.category('v')} AS category, {q.gap_category('v')} AS strict_category FROM obs")
def aqi_category(spark, sf):
    return v.obs(spark, sf).select("station", "ts", "v", aqi.category(F.col("v")).alias("category"), aqi.gap_category(F.col("v")).alias("strict_category"))


HOURLY = "i AS (SELECT *, " + ", ".join(f"{q.subindex(p, p)} AS i_{p}" for p in P5) + " FROM panel), g AS (SELECT *, greatest(" + ", ".join(f"i_{p}" for p in P5) + ") AS top FROM i)"


@query(v.with_views("panel", more=HOURLY) + f"SELECT station, hour, {INDEX} AS aqi, CASE WHEN top IS NULL THEN 'Unknown' ELSE {q.category(INDEX)} END AS category, {DOMINANT} AS dominant FROM g")
def aqi_hourly(spark, sf):
    return aqi.with_overall(v.panel(spark, sf), {p: p for p in P5}).select("station", "hour", "aqi", "category", "dominant")


@query(v.with_views("obs") + "SELECT station, ts, v, CASE WHEN round_even(least(500.0, v), 0) <= 200 THEN 0 WHEN round_even(least(500.0, v), 0) <= 300 THEN 1 WHEN round_even(least(500.0, v), 0) <= 400 THEN 2 WHEN round_even(least(500.0, v), 0) <= 450 THEN 3 ELSE 4 END AS stage FROM obs")
def grap_stage(spark, sf):
    return v.obs(spark, sf).select("station", "ts", "v", aqi.stage(F.col("v")).alias("stage"))


LINES = list(zip(aqi.SOLVER_PM25, aqi.SOLVER_PM25[1:], aqi.SOLVER_AQI, aqi.SOLVER_AQI[1:], strict=False))


@query(v.with_views("obs") + "SELECT station, ts, v, CAST(floor(CASE " + " ".join(f"WHEN least(v, 350.0) <= {b} THEN (least(v, 350.0) - {a}) * CAST({(d - c) / (b - a)!r} AS DOUBLE) + {c}" for a, b, c, d in LINES) + " END + 1e-9) AS INT) AS solver_aqi FROM obs")
def solver_index(spark, sf):
    return v.obs(spark, sf).select("station", "ts", "v", aqi.solver_aqi(F.col("v")).alias("solver_aqi"))


@query(v.with_views("fires", "stations5") + f"SELECT fire_id, station, round({q.haversine('slat', 'slon', 'lat', 'lon')}, 6) AS km, round({q.bearing('slat', 'slon', 'lat', 'lon')}, 6) AS bearing FROM fires, stations5 WHERE {q.haversine('slat', 'slon', 'lat', 'lon')} <= 500")
def haversine_bearing(spark, sf):
    return r6(fire.near_fires(v.fires(spark, sf), v.stations(spark), parts=fire.SHARES).select("fire_id", "station", "km", "bearing"), "km", "bearing")


@query(v.with_views("weather") + f"SELECT station, ts, round(-wind_speed * sin(radians(wind_direction)), 6) AS wind_u, round(-wind_speed * cos(radians(wind_direction)), 6) AS wind_v, {q.compass('wind_direction')} AS compass_from FROM weather")
def wind_components(spark, sf):
    s, d = F.col("wind_speed"), F.col("wind_direction")
    return v.weather(spark, sf).select("station", "ts", F.round(geo.wind_u(s, d), 6).alias("wind_u"), F.round(geo.wind_v(s, d), 6).alias("wind_v"), geo.compass(d).alias("compass_from"))


@query(v.with_views("weather") + "SELECT station, ts, CAST(hour(ts) AS INT) AS hour, CAST((dayofweek(ts) + 6) % 7 AS INT) AS dow, CAST(month(ts) AS INT) AS month, CAST(dayofyear(ts) AS INT) AS doy, dayofweek(ts) IN (0, 6) AS weekend, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, round(sin(2 * pi() * hour(ts) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) AS hour_cos FROM weather")
def calendar_features(spark, sf):
    import math

    h, m = F.hour("ts"), F.month("ts")
    season = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    return v.weather(spark, sf).select("station", "ts", h.alias("hour"), F.weekday("ts").alias("dow"), m.alias("month"), F.dayofyear("ts").alias("doy"), F.weekday("ts").isin(5, 6).alias("weekend"), season.alias("season"), F.round(F.sin(2 * math.pi * h / 24.0), 6).alias("hour_sin"), F.round(F.cos(2 * math.pi * h / 24.0), 6).alias("hour_cos"))


PROFILE = "t AS (SELECT station, ts, temperature AS t1000, temperature - 4 + (humidity / 20.0) AS t925, CASE WHEN humidity > 20 THEN temperature - 6 + (humidity / 25.0) END AS t850, temperature - 18 AS t700 FROM weather), l AS (SELECT station, ts, (t925 - t1000) / 75.0 * 100.0 AS g1, CASE WHEN t850 IS NOT NULL THEN (t850 - t925) / 75.0 * 100.0 END AS g2, CASE WHEN t850 IS NOT NULL THEN (t700 - t850) / 150.0 * 100.0 ELSE (t700 - t925) / 225.0 * 100.0 END AS g3 FROM t), b AS (SELECT station, ts, greatest(g1, g2, g3) AS g, g1, g2 FROM l)"


@query(v.with_views("weather", more=PROFILE) + "SELECT station, ts, round(g, 6) AS gradient, CASE WHEN g > 1.5 THEN 'strong' WHEN g > 0.6 THEN 'moderate' WHEN g > 0 THEN 'weak' ELSE 'none' END AS category, round(greatest(0.0, least(1.0, g / 4.0)), 6) AS strength FROM b")
def inversion_profile(spark, sf):
    t = F.col("temperature")
    levels = {1000: t, 925: t - 4 + F.col("humidity") / 20.0, 850: F.when(F.col("humidity") > 20, t - 6 + F.col("humidity") / 25.0), 700: t - 18}
    rows = v.weather(spark, sf).select("station", "ts", met.profile_inversion(levels).alias("x"))
    return rows.select("station", "ts", F.round("x.gradient", 6).alias("gradient"), "x.category", F.round("x.strength", 6).alias("strength"))


FACTOR = "(CASE " + " ".join(f"WHEN hour(ts) <= {last} THEN {f}" for last, f in met.DIURNAL) + " END)"


@query(v.with_views("weather") + f"SELECT station, ts, CASE WHEN pbl_height < 150 THEN 'strong' WHEN pbl_height < 300 THEN 'moderate' WHEN pbl_height < 500 THEN 'weak' ELSE 'none' END AS category, round(least(1.0, greatest(0.0, least(1.0, (500.0 - pbl_height) / 500.0)) * {FACTOR}), 6) AS strength FROM weather")
def inversion_proxy(spark, sf):
    p = F.col("pbl_height")
    return v.weather(spark, sf).select("station", "ts", met.proxy_category(p).alias("category"), F.round(met.proxy_strength(p, F.hour("ts")), 6).alias("strength"))


@query(v.with_views("weather") + "SELECT station, ts, CASE WHEN pbl_height < 150 THEN 'strong_trapping' WHEN pbl_height < 300 THEN 'moderate_trapping' WHEN pbl_height < 500 THEN 'weak_trapping' ELSE 'good_dispersion' END AS pbl_category, CASE WHEN pbl_height < 150 THEN 'TRAPPED' WHEN pbl_height < 300 THEN 'LIMITED' WHEN pbl_height < 500 THEN 'MODERATE' ELSE 'GOOD' END AS condition, CASE WHEN wind_speed < 0.5 THEN 'calm' WHEN wind_speed < 2 THEN 'light' WHEN wind_speed < 4 THEN 'moderate' WHEN wind_speed < 7 THEN 'brisk' ELSE 'strong' END AS wind_category FROM weather")
def pbl_class(spark, sf):
    p = F.col("pbl_height")
    return v.weather(spark, sf).select("station", "ts", met.mixing_category(p).alias("pbl_category"), met.dispersion_condition(p).alias("condition"), met.wind_category(F.col("wind_speed")).alias("wind_category"))


@query(v.with_views("weather") + "SELECT station, ts, wind_speed * pbl_height AS coefficient, CASE WHEN wind_speed * pbl_height < 3000 THEN 'poor' WHEN wind_speed * pbl_height < 6000 THEN 'moderate' ELSE 'good' END AS category FROM weather")
def ventilation(spark, sf):
    c = F.col("wind_speed") * F.col("pbl_height")
    return v.weather(spark, sf).select("station", "ts", c.alias("coefficient"), met.ventilation_category(c).alias("category"))


WP = "wp AS (SELECT w.station, w.ts, wind_speed, wind_direction, pbl_height, temperature, humidity, pm25, no2, least(1.0, greatest(0.0, least(1.0, (500.0 - pbl_height) / 500.0)) * " + FACTOR + ") AS inv FROM weather w LEFT JOIN panel p ON p.station = w.station AND p.hour = w.ts)"
VENT, PBLN, WINDN = q.clip("wind_speed * pbl_height / 6000.0", 0, 1), q.clip("pbl_height / 1500.0", 0, 1), q.clip("wind_speed / 7.0", 0, 1)
LOAD = q.clip("(pm25 - 35.0) / 265.0", 0, 1)


def weather_pollution(spark, sf):
    p = v.panel(spark, sf).select("station", F.col("hour").alias("ts"), "pm25", "no2")
    return v.weather(spark, sf).join(p, ["station", "ts"], "left").withColumn("inv", met.proxy_strength(F.col("pbl_height"), F.hour("ts")))


TRAP = f"t AS (SELECT station, ts, pm25, {q.clip(f'1 - (0.5 * {VENT} + 0.2 * {PBLN} + 0.3 * (1 - inv))', 0, 1)} AS held, {LOAD} AS load FROM wp), z AS (SELECT station, ts, CASE WHEN pm25 > 0 THEN {q.clip('0.7 * held + 0.3 * load', 0, 1)} ELSE held END AS s FROM t)"


@query(v.with_views("panel", "weather", more=f"{WP}, {TRAP}") + "SELECT station, ts, round(s, 6) AS score, CASE WHEN s < 0.33 THEN 'low' WHEN s < 0.55 THEN 'moderate' WHEN s < 0.75 THEN 'high' ELSE 'severe' END AS category FROM z")
def trapping(spark, sf):
    s = met.trapping(F.col("wind_speed"), F.col("pbl_height"), F.col("inv"), F.col("pm25"))
    return weather_pollution(spark, sf).withColumn("s", s).select("station", "ts", F.round("s", 6).alias("score"), met.trapping_category(F.col("s")).alias("category"))


DAY = q.daytime("hour(ts)")
FEEDBACK = f"f AS (SELECT station, ts, wind_speed, pbl_height, {DAY} AS day, {q.clip('coalesce(pm25, 0.0) * 0.00025', 0, 2.5)} AS aod FROM wp), g AS (SELECT *, exp(-aod) AS tr, {q.clip('1 - 0.35 * aod * exp(-aod) * day', 0.8, 1)} AS supp FROM f), h AS (SELECT *, pbl_height * supp AS corrected, {q.clip(f'0.5 * ' + q.clip('1 - pbl_height * supp / 600.0', 0, 1) + ' + 0.3 * ' + q.clip('1 - wind_speed / 8.0', 0, 1) + ' + 0.2 * (1 - day)', 0, 1)} AS stab FROM g)"


@query(v.with_views("panel", "weather", more=f"{WP}, {FEEDBACK}") + "SELECT station, ts, aod, tr AS transmittance, supp AS suppression, corrected AS corrected_pbl, stab AS stability, 1 + 0.4 * stab AS feedback, CASE WHEN stab >= 0.6 THEN 'strong' WHEN stab >= 0.35 THEN 'moderate' ELSE 'weak' END AS strength FROM h")
def coupling_feedback(spark, sf):
    pm, pbl, wind, hour = F.col("pm25"), F.col("pbl_height"), F.col("wind_speed"), F.hour("ts")
    rows = weather_pollution(spark, sf).withColumn("stab", met.stability(pm, pbl, wind, hour))
    return rows.select("station", "ts", met.optical_depth(pm).alias("aod"), met.transmittance(pm).alias("transmittance"), met.suppression(pm, hour).alias("suppression"), met.corrected_pbl(pm, pbl, hour).alias("corrected_pbl"), F.col("stab").alias("stability"), (1 + 0.4 * F.col("stab")).alias("feedback"), met.coupling_strength(F.col("stab")).alias("strength"))


NINE = f"c AS (SELECT station, ts, inv, temperature, no2, pm25, {VENT} AS vent, {PBLN} AS pbln, {WINDN} AS windn, {LOAD} AS load, {q.clip('(temperature - 25.0) / 15.0', 0, 1)} AS warm, {q.clip('no2 / 120.0', 0, 1)} AS no2n FROM wp), d AS (SELECT *, {q.clip('0.5 * vent + 0.2 * pbln + 0.3 * (1 - inv)', 0, 1)} AS dispersion FROM c), e AS (SELECT *, 1 - dispersion AS accumulation, {q.clip('0.5 * inv + 0.5 * (1 - pbln)', 0, 1)} AS held, {q.clip('0.4 * (1 - windn) + 0.4 * (1 - pbln) + 0.2 * inv', 0, 1)} AS stagnation, {q.clip('0.25 * (1 - vent) + 0.15 * (1 - windn)', 0, 1)} AS regional, {q.clip('0.5 * warm + 0.3 * (1 - windn) + 0.2 * coalesce(no2n, 0.0)', 0, 1)} AS ozone FROM d)"


@query(v.with_views("panel", "weather", more=f"{WP}, {NINE}") + f"SELECT station, ts, round(dispersion, 6) AS dispersion_potential, round(accumulation, 6) AS accumulation_potential, round(held, 6) AS inversion_trapping_potential, round(stagnation, 6) AS pollution_stagnation_index, round({q.clip('0.5 * load + 0.5 * accumulation', 0, 1)}, 6) AS aerosol_accumulation_potential, CAST(NULL AS DOUBLE) AS fire_transport_influence, round(regional, 6) AS regional_transport_potential, round(ozone, 6) AS ozone_photochemical_potential, round((accumulation + stagnation + ozone) / 3, 6) AS meteorology_pollution_interaction FROM e")
def coupling_nine(spark, sf):
    nine = met.coupling_potentials(F.col("wind_speed"), F.col("pbl_height"), F.col("inv"), F.col("pm25"), F.col("temperature"), F.col("no2"))
    return weather_pollution(spark, sf).select("station", "ts", *[F.round(c, 6).alias(n) for n, c in nine.items()])


RISK_MET = f"near AS (SELECT * FROM nn WHERE km <= 500), w1 AS (SELECT station, ts, wind_speed, wind_direction, pbl_height, inv, pm25 FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC) AS k FROM wp) WHERE k = 1), met AS (SELECT w1.station, w1.wind_speed, frp, km, CASE WHEN abs(bearing - wind_direction) > 180 THEN 360 - abs(bearing - wind_direction) ELSE abs(bearing - wind_direction) END AS ang FROM w1 JOIN near USING (station)), fm AS ({MEASURES.format(keys='station')} FROM met GROUP BY 1), ff AS (SELECT w1.*, round_even(CASE WHEN raw > 0 THEN 1 / (1 + exp(-(raw - 1.0))) ELSE 0.0 END, 4) AS impact, round_even(near, 2) AS near, aligned, round_even(100.0 * aligned / n, 1) AS pct FROM w1 LEFT JOIN fm USING (station)), k AS (SELECT *, round_even({q.clip('0.5 * coalesce(impact, 0.0) + 0.25 * (1 - least(1.0, coalesce(near, 501.0) / 500.0)) + 0.15 * least(1.0, coalesce(aligned, 0) / 50.0) + 0.1 * coalesce(pct, 0.0) / 100.0', 0, 1)}, 4) AS fire_c, round_even({q.clip(f'0.45 * (1 - {VENT}) + 0.3 * inv + 0.25 * (1 - {PBLN})', 0, 1)}, 4) AS atmo_c, CASE WHEN pm25 > 0 THEN {LOAD} END AS poll_c FROM ff), s AS (SELECT *, CAST(round_even(100 * (0.45 * fire_c + 0.35 * atmo_c + coalesce(0.2 * poll_c, 0.0)) / (0.8 + CASE WHEN poll_c IS NULL THEN 0.0 ELSE 0.2 END), 0) AS INT) AS risk_score FROM k)"


@query(v.with_views("fires", "stations5", "panel", "weather", more=f"{WP}, " + NEAR.replace("near AS", "nn AS", 1) + f", {RISK_MET}") + "SELECT station, CAST(fire_c AS DOUBLE) AS fire_component, CAST(atmo_c AS DOUBLE) AS atmo_component, round(poll_c, 6) AS pollution_component, risk_score, CASE WHEN risk_score <= 20 THEN 'LOW' WHEN risk_score <= 40 THEN 'MODERATE' WHEN risk_score <= 60 THEN 'ELEVATED' WHEN risk_score <= 80 THEN 'HIGH' ELSE 'VERY HIGH' END AS risk_level FROM s")
def transport_risk(spark, sf):
    now = clean.latest_by(weather_pollution(spark, sf), ["station"], [F.desc("ts")])
    # The winds go along with the stations, so that fires are summed where they meet them and no task gets all of a station's.
    windy = v.stations(spark).join(now.select("station", "wind_speed", "wind_direction"), "station")
    near = fire.near_fires(v.fires(spark, sf), windy, carried=("wind_speed", "wind_direction"), parts=fire.SHARES)
    measured = fire.measures(near, ["station"])
    rows = rules.transport_risk(now.join(measured, "station", "left").withColumn("inversion", F.col("inv")))
    return rows.select("station", "fire_component", "atmo_component", F.round("pollution_component", 6).alias("pollution_component"), "risk_score", "risk_level")


RULES = [
    ("aqi >= 401", "severe_aqi", "SEVERE"), ("aqi BETWEEN 301 AND 400", "very_poor_aqi", "WARNING"), ("aqi BETWEEN 201 AND 300", "poor_aqi", "ADVISORY"), ("dominant = 'pm25' AND aqi >= 201", "fine_particles", "WATCH"),
    ("wind_speed < 2", "stagnant_wind", "WATCH"), ("wind_speed > 15", "strong_wind", "WATCH"), ("pbl_height < 150", "strong_inversion", "WARNING"), ("pbl_height >= 150 AND pbl_height < 300", "inversion", "WATCH"), ("humidity > 80", "high_humidity", "ADVISORY"), ("aqi >= 201", "no_washout", "WATCH"),
]
ALERTS = f"ix AS (SELECT station, hour, {INDEX} AS aqi, {DOMINANT} AS dominant FROM g), j AS (SELECT w.station, w.ts, wind_speed, pbl_height, humidity, coalesce(aqi, 0) AS aqi, dominant FROM weather w LEFT JOIN ix ON ix.station = w.station AND ix.hour = w.ts)"


@query(v.with_views("panel", "weather", more=f"{HOURLY}, {ALERTS}") + "SELECT rule, level, severity, count(*) AS n, count(DISTINCT station) AS n_stations FROM (" + " UNION ALL ".join(f"SELECT station, '{name}' AS rule, '{level}' AS level, {rules.SEVERITY[level]} AS severity FROM j WHERE {holds}" for holds, name, level in RULES) + ") GROUP BY 1, 2, 3")
def alerts(spark, sf):
    index = aqi_hourly(spark, sf).select("station", F.col("hour").alias("ts"), "aqi", "dominant")
    rows = v.weather(spark, sf).join(index, ["station", "ts"], "left").withColumns({"trend": F.lit("stable"), "precipitation": F.lit(0.0), "fire_count": F.lit(0), "nearest_fire_distance": F.lit(None).cast("double")})
    return rules.alerts(rows).groupBy("rule", "level", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station").alias("n_stations"))


@query(v.with_views("panel", more=HOURLY + f", ix AS (SELECT station, hour, {INDEX} AS aqi FROM g WHERE top IS NOT NULL), t AS (SELECT station, arg_min(aqi, hour) AS a, arg_max(aqi, hour) AS b FROM ix GROUP BY 1)") + "SELECT station, CASE WHEN b > a * 1.05 THEN 'rising' WHEN b < a * 0.95 THEN 'falling' ELSE 'stable' END AS trend FROM t")
def forecast_trend(spark, sf):
    return rules.trend(aqi_hourly(spark, sf), ["station"], "hour", "aqi")


def event_inputs(spark, sf):
    rows = v.panel(spark, sf).where("pm25 is not null").select("station", F.col("hour").alias("ts"), F.col("pm25"))
    release = rows.groupBy("station").agg(F.percentile(series.seconds("ts"), 0.5).alias("s")).select("station", F.timestamp_seconds(F.floor("s")).cast("timestamp_ntz").alias("release"))
    baseline = rules.baseline_24h(rows.withColumnRenamed("pm25", "v"), release)
    air = clean.latest_by(v.weather(spark, sf), ["station"], [F.desc("ts")]).select("station", "wind_speed", "pbl_height", (F.col("pbl_height") < 500).alias("inversion"))
    return rows.join(release, "station").where("ts > release").drop("release"), baseline, air


EVENTS = """r0 AS (SELECT station, hour AS ts, pm25 FROM panel WHERE pm25 IS NOT NULL), rel AS (SELECT station, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(quantile_cont(epoch(ts), 0.5)) AS BIGINT)) AS release FROM r0 GROUP BY 1), base AS (SELECT r0.station, avg(pm25) AS baseline FROM r0 JOIN rel USING (station) WHERE ts <= release AND ts > release - INTERVAL 24 HOURS GROUP BY 1), pts AS (SELECT r0.station, ts, pm25, baseline, lead(ts) OVER (PARTITION BY r0.station ORDER BY ts) IS NULL AS last_, lag(ts) OVER (PARTITION BY r0.station ORDER BY ts) AS before FROM r0 JOIN rel USING (station) LEFT JOIN base USING (station) WHERE ts > release),
flag AS (SELECT *, coalesce(baseline > 0 AND pm25 >= greatest(baseline * 1.3, 60.0), FALSE) AS f, 'pollution_surge' AS kind FROM pts UNION ALL SELECT *, coalesce(baseline > 0 AND pm25 <= baseline * 0.75, FALSE), 'pollution_relief' FROM pts),
brk AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY kind, station ORDER BY ts) AND date_diff('hour', before, ts) <= 1 THEN 0 ELSE 1 END AS b FROM flag), rid AS (SELECT *, sum(CASE WHEN f THEN b ELSE 0 END) OVER (PARTITION BY kind, station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM brk),
runs AS (SELECT kind, station, run, min(ts) AS s, max(ts) AS e, max(pm25) AS peak, min(pm25) AS trough, arg_min(ts, (-pm25, ts)) AS peak_ts, arg_min(ts, (pm25, ts)) AS trough_ts, bool_or(last_) AS open, max(baseline) AS baseline FROM rid WHERE f GROUP BY 1, 2, 3), best AS (SELECT *, row_number() OVER (PARTITION BY kind, station ORDER BY CASE WHEN kind = 'pollution_surge' THEN -peak ELSE trough END, s) AS k FROM runs),
air AS (SELECT station, wind_speed, pbl_height, (wind_speed * pbl_height < 3000)::INT + (pbl_height < 300)::INT + (pbl_height < 500)::INT + (wind_speed < 2)::INT AS active_factors, wind_speed * pbl_height >= 6000 OR (pbl_height >= 300 AND wind_speed >= 2) AS disperses FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC) AS k FROM weather) WHERE k = 1)"""


@query(v.with_views("panel", "weather", more=EVENTS) + "SELECT b.station, kind AS event_type, s AS start_ts, CASE WHEN NOT open THEN e END AS end_ts, CASE WHEN kind = 'pollution_surge' THEN peak END AS peak, CASE WHEN kind = 'pollution_surge' THEN peak_ts END AS peak_ts, CASE WHEN kind <> 'pollution_surge' THEN trough END AS trough, CASE WHEN kind <> 'pollution_surge' THEN trough_ts END AS trough_ts, CASE WHEN kind = 'pollution_surge' THEN CASE WHEN peak >= 250 THEN 'severe' WHEN peak >= 121 THEN 'moderate' ELSE 'mild' END WHEN (baseline - trough) / baseline * 100 >= 45 OR trough < 60 THEN 'significant' ELSE 'minor' END AS severity, active_factors FROM best b JOIN air USING (station) WHERE k = 1 AND (kind = 'pollution_surge' OR disperses OR (baseline - trough) / baseline * 100 >= 45)")
def events_surge_relief(spark, sf):
    return rules.events(*event_inputs(spark, sf)).where("event_type <> 'high_risk_episode'")


@query(v.with_views("obs", "fires", more=CURRENT) + f"SELECT round(avg({INDEX}), 6) AS mean_aqi, arg_max(station, ({INDEX}, -station)) AS worst_station, arg_max(station, (-{INDEX}, -station)) AS best_station, count(*) AS n_stations, (SELECT count(*) FROM fires WHERE acq >= TIMESTAMP '2024-01-30') AS fires_24h FROM g")
def summary_kpis(spark, sf):
    now = network.current_index(v.obs(spark, sf))
    out = now.agg(F.round(F.avg("aqi"), 6).alias("mean_aqi"), F.max_by("station", F.struct("aqi", -F.col("station"))).alias("worst_station"), F.max_by("station", F.struct(-F.col("aqi"), -F.col("station"))).alias("best_station"), F.count(F.lit(1)).alias("n_stations"))
    return out.crossJoin(v.fires(spark, sf).where("acq >= timestamp_ntz'2024-01-30 00:00:00'").agg(F.count(F.lit(1)).alias("fires_24h")))  # one row each


@query(v.with_views("obs") + "SELECT station, CAST(floor(date_diff('hour', TIMESTAMP '2024-01-01', ts) / 24) AS BIGINT) AS day, max(v) AS peak, CASE WHEN max(v) < 201 THEN 'ok' WHEN max(v) < 301 THEN 'poor' WHEN max(v) < 401 THEN 'very_poor' ELSE 'severe' END AS band FROM obs GROUP BY 1, 2")
def risk_bands(spark, sf):
    day = F.floor((series.seconds("ts") - F.lit(1704067200)) / 86400).cast("bigint")
    out = v.obs(spark, sf).groupBy("station", day.alias("day")).agg(F.max("v").alias("peak"))
    return out.withColumn("band", bands(F.col("peak"), [(201, "ok"), (301, "poor"), (401, "very_poor")], "severe"))


# ---- grids

GRID = "grid AS (SELECT i, j, 28.2 + i * CAST(0.02 AS DOUBLE) AS lat, 76.6 + j * CAST(0.02 AS DOUBLE) AS lon FROM range(0, 36) a(i), range(0, 46) b(j))"
POINTS = "pts AS (SELECT slat AS plat, slon AS plon, avg(v) AS value FROM obs JOIN stations5 USING (station) WHERE pollutant = 'pm25' GROUP BY 1, 2)"
IDW = "d AS (SELECT i, j, lat, lon, value, pow((plat - lat) * 110.0, 2) + pow((plon - lon) * 100.0 * cos(radians(lat)), 2) AS d2 FROM grid, pts), f AS (SELECT i, j, lat, lon, CASE WHEN min(sqrt(d2)) < 0.0001 THEN arg_min(value, d2) ELSE sum(value / (d2 + 1e-6)) / sum(1 / (d2 + 1e-6)) END AS value FROM d GROUP BY 1, 2, 3, 4)"


def station_points(spark, sf):
    rows = v.obs(spark, sf).where("pollutant = 'pm25'").groupBy("station").agg(F.avg("v").alias("value"))
    return rows.join(v.stations(spark), "station").select(F.col("slat").alias("lat"), F.col("slon").alias("lon"), "value")


@query(f"WITH {GRID} SELECT i, j, round(lat, 6) AS lat, round(lon, 6) AS lon FROM grid")
def grid_build(spark, sf):
    return r6(grid.grid(spark), "lat", "lon")


@query(v.with_views("obs", "stations5", more=f"{GRID}, {POINTS}, {IDW}") + "SELECT i, j, round(value, 5) AS value FROM f")
def idw_surface(spark, sf):
    return grid.idw(grid.grid(spark), station_points(spark, sf)).select("i", "j", F.round("value", 5).alias("value"))


SHIFT = "c AS (SELECT -5.0 * sin(radians(300.0)) * 3600 * 3.0 / (0.02 * 100000.0) AS dj, -5.0 * cos(radians(300.0)) * 3600 * 3.0 / (0.02 * 111000.0) AS di), mv AS (SELECT greatest(0, least(35, CAST(floor(i + di) AS BIGINT))) AS i, greatest(0, least(45, CAST(floor(j + dj) AS BIGINT))) AS j, arg_max(value, i * 46 + j) AS moved FROM f, c GROUP BY 1, 2)"


@query(v.with_views("obs", "stations5", more=f"{GRID}, {POINTS}, {IDW}, {SHIFT}") + "SELECT f.i, f.j, round(coalesce(0.75 * value + 0.25 * moved, value), 5) AS value FROM f LEFT JOIN mv ON mv.i = f.i AND mv.j = f.j")
def advective_blend(spark, sf):
    field = grid.idw(grid.grid(spark), station_points(spark, sf))
    return grid.advected(field, 5.0, 300.0).select("i", "j", F.round("value", 5).alias("value"))


@query(v.with_views("obs", "stations5", more=f"{GRID}, {POINTS}") + ", x AS (SELECT i, j, sum(value / (pow(lat - plat, 2) + pow(lon - plon, 2) + 1e-12)) / sum(1 / (pow(lat - plat, 2) + pow(lon - plon, 2) + 1e-12)) AS value FROM grid, pts WHERE pow(lat - plat, 2) + pow(lon - plon, 2) <= 0.0625 GROUP BY 1, 2) SELECT g.i, g.j, round(coalesce(x.value, 0.0), 5) AS value FROM grid g LEFT JOIN x ON x.i = g.i AND x.j = g.j")
def idw_radius(spark, sf):
    return grid.idw_within(grid.grid(spark), station_points(spark, sf)).select("i", "j", F.round("value", 5).alias("value"))
