"""Queries: scoring by horizon, contracts, the look-ahead of coupling, and the last steps before training."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrlake.functions import aqi
from zephyrlake.operators import scoring, training
from zephyrlake.plans import sqlparts as q
from zephyrlake.plans import views as v
from zephyrlake.plans.queries_domain import FACTOR
from zephyrlake.plans.queries_table import NEAR
from zephyrlake.plans.queries_training import PW, SPLIT, panel_weather

QUERIES, SQL = {}, {}
HORIZONS = [1, 6, 24, 72]


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- scoring by horizon


#: Rows of features with gaps, and answers of models for pm25 at two horizons and for o3 at all.
FEATURES = "fe AS (SELECT station, hour, h AS horizon, pm25 AS pm25_lag1, pm10 AS pm10_lag1, so2 AS so2_lag1, CASE WHEN hour(hour) % 5 <> 0 THEN wind_speed END AS wind_speed, pbl_height, CASE WHEN hour(hour) % 7 <> 0 THEN temperature END AS temperature, CASE WHEN hour(hour) % 3 = 0 THEN humidity / 100 END AS fire_impact_score, CASE WHEN hour(hour) % 4 = 0 THEN 0.0 ELSE humidity / 50 END AS precipitation, CASE WHEN station <> 4 THEN 28.6 + station END AS latitude, 77.0 AS longitude, CASE WHEN hour(hour) % 2 = 0 THEN 1.5 END AS mean_frp FROM pw, (SELECT unnest([1, 6, 24, 72]) AS h)), mo AS (SELECT *, CASE WHEN latitude IS NOT NULL AND horizon IN (1, 6) AND pm25_lag1 IS NOT NULL THEN greatest(0.0, pm25_lag1 * CAST(0.9 AS DOUBLE) - 1) END AS m_pm25, CASE WHEN latitude IS NOT NULL AND temperature IS NOT NULL THEN greatest(0.0, temperature * 2) END AS m_o3 FROM fe)"
PREDICTED = (
    "p1 AS (SELECT *, coalesce(m_pm25, coalesce(pm25_lag1, 50.0) * greatest(CAST(0.55 AS DOUBLE), 1.0 - CAST(0.006 AS DOUBLE) * horizon) * (1.0 + greatest(0.0, 2.0 - coalesce(wind_speed, 5.0)) * CAST(0.04 AS DOUBLE)) * (1.0 + greatest(0.0, (400.0 - coalesce(pbl_height, 500.0)) / CAST(400.0 AS DOUBLE)) * CAST(0.35 AS DOUBLE)) * (1.0 + coalesce(fire_impact_score, 0.0) * CAST(0.15 AS DOUBLE))) AS pm25_pred FROM mo), "
    "p2 AS (SELECT *, greatest(coalesce(pm10_lag1, pm25_pred * CAST(1.9 AS DOUBLE)) * (1.0 - CAST(0.004 AS DOUBLE) * horizon), pm25_pred * CAST(1.5 AS DOUBLE)) AS pm10_pred, coalesce(m_o3, greatest(CAST(10.0 AS DOUBLE), 45.0 * (1.0 + greatest(0.0, (coalesce(temperature, 25.0) - 20.0) / CAST(20.0 AS DOUBLE)) * CAST(0.3 AS DOUBLE)) * (1.0 - CAST(0.002 AS DOUBLE) * horizon))) AS o3_pred, greatest(CAST(5.0 AS DOUBLE), CAST(48.0 AS DOUBLE) / (1.0 + coalesce(wind_speed, 5.0) * CAST(0.05 AS DOUBLE))) AS no2_pred, greatest(CAST(2.0 AS DOUBLE), coalesce(so2_lag1, 15.0) * greatest(CAST(0.6 AS DOUBLE), 1.0 - precipitation * CAST(0.15 AS DOUBLE)) / (1.0 + greatest(0.0, coalesce(wind_speed, 5.0) - 3.0) * CAST(0.03 AS DOUBLE))) AS so2_pred, greatest(CAST(0.2 AS DOUBLE), CAST(1.4 AS DOUBLE) / (1.0 + coalesce(wind_speed, 5.0) * CAST(0.04 AS DOUBLE))) AS co_pred FROM p1), "
    "p3 AS (SELECT *, " + ", ".join(f"{q.subindex(p, f'{p}_pred')} AS i_{p}" for p in aqi.ORDER) + " FROM p2), p4 AS (SELECT *, greatest(" + ", ".join(f"i_{p}" for p in aqi.ORDER) + ") AS top FROM p3), p5 AS (SELECT *, CAST(round_even(top, 0) AS INT) AS aqi FROM p4)"
)
INVENTED = "concat_ws(',', CASE WHEN wind_speed IS NULL THEN 'wind_speed' END, CASE WHEN temperature IS NULL THEN 'temperature' END, CASE WHEN pm25_lag1 IS NULL THEN 'pm25_lag1' END, CASE WHEN pm10_lag1 IS NULL THEN 'pm10_lag1' END, CASE WHEN so2_lag1 IS NULL THEN 'so2_lag1' END, 'co_lag1', CASE WHEN fire_impact_score IS NULL THEN 'fire_impact_score' END)"
DECLARED = ["latitude", "longitude", "mean_frp", "max_bright", "wind_speed", "pm25_lag1"]


def features(spark, sf):
    h, rows = F.hour("hour"), panel_weather(spark, sf)
    return rows.select(
        "station", "hour", F.col("pm25").alias("pm25_lag1"), F.col("pm10").alias("pm10_lag1"), F.col("so2").alias("so2_lag1"), F.when(h % 5 != 0, F.col("wind_speed")).alias("wind_speed"), "pbl_height", F.when(h % 7 != 0, F.col("temperature")).alias("temperature"),
        F.when(h % 3 == 0, F.col("humidity") / 100).alias("fire_impact_score"), F.when(h % 4 == 0, 0.0).otherwise(F.col("humidity") / 50).alias("precipitation"), F.when(F.col("station") != 4, 28.6 + F.col("station")).alias("latitude"), F.lit(77.0).alias("longitude"), F.when(h % 2 == 0, 1.5).alias("mean_frp"),
    )


@query(v.with_views("panel", "weather", more=f"{PW}, {FEATURES}, {PREDICTED}") + "SELECT station, hour, CAST(horizon AS INT) AS horizon, " + ", ".join(f"{p}_pred" for p in aqi.ORDER) + f", aqi, {q.category('aqi')} AS category, CASE " + " ".join(f"WHEN i_{p} = top THEN '{p}'" for p in aqi.ORDER) + f" END AS dominant, concat_ws(',', CASE WHEN m_pm25 IS NULL THEN 'pm25' END, 'pm10', CASE WHEN m_o3 IS NULL THEN 'o3' END, 'no2', 'so2', 'co') AS heuristic_pollutants, {INVENTED} AS invented_inputs FROM p5")
def horizon_predictions(spark, sf):
    rows = scoring.by_horizon(scoring.with_contract(features(spark, sf), DECLARED), HORIZONS)
    models = {"pm25": F.when(F.col("horizon").isin(1, 6), F.col("pm25_lag1") * 0.9 - 1), "o3": F.col("temperature") * 2}
    out = scoring.predicted(rows, models, satisfied=F.col("contract.satisfied"))
    named = [F.array_join(c, ",").alias(c) for c in ("heuristic_pollutants", "invented_inputs")]
    return out.select("station", "hour", "horizon", *[f"{p}_pred" for p in aqi.ORDER], "aqi", "category", "dominant", *named)


@query(v.with_views("panel", "weather", more=f"{PW}, {FEATURES}") + "SELECT station, hour, CAST(6 AS INT) AS declared_features, CASE WHEN latitude IS NULL THEN 'latitude' ELSE '' END AS missing_required, concat_ws(',', 'max_bright', CASE WHEN mean_frp IS NULL THEN 'mean_frp' END) AS imputed, latitude IS NOT NULL AS satisfied, CASE WHEN latitude IS NULL THEN 'required measured features unavailable: latitude' END AS reason FROM fe WHERE horizon = 1")
def contract_audit(spark, sf):
    c = "contract"
    rows = scoring.with_contract(features(spark, sf), DECLARED)
    return rows.select("station", "hour", f"{c}.declared_features", F.array_join(f"{c}.missing_required", ",").alias("missing_required"), F.array_join(f"{c}.imputed", ",").alias("imputed"), f"{c}.satisfied", f"{c}.reason")


# ---- look-ahead


z = lambda x: f"coalesce({x}, 0.0)"
NOW = "nw AS (SELECT station, max(hour) - INTERVAL 40 HOUR + INTERVAL 25 MINUTE AS now, arg_max(pm25, hour) AS pm25, arg_max(no2, hour) AS no2 FROM (SELECT station, hour, pm25, no2 FROM panel) WHERE no2 IS NOT NULL AND pm25 IS NOT NULL GROUP BY 1), hz AS (SELECT *, now + to_hours(CAST(k AS INT)) AS target_ts FROM nw, generate_series(1, 72) g(k)), nr AS (SELECT hz.*, w.ts, w.wind_speed, w.wind_direction, w.pbl_height, w.temperature, w.humidity, row_number() OVER (PARTITION BY hz.station, k ORDER BY abs(epoch_us(w.ts) - epoch_us(target_ts)), w.ts) AS n FROM hz LEFT JOIN weather w ON w.station = hz.station AND w.ts BETWEEN target_ts - INTERVAL 2 HOUR AND target_ts + INTERVAL 2 HOUR), "
NOW += f"c0 AS (SELECT *, CASE WHEN ts IS NOT NULL THEN least(1.0, greatest(0.0, least(1.0, (500.0 - pbl_height) / 500.0)) * {FACTOR}) END AS inv, {q.clip('wind_speed * pbl_height / 6000.0', 0, 1)} AS vent, {q.clip('pbl_height / 1500.0', 0, 1)} AS pbln, {q.clip('wind_speed / 7.0', 0, 1)} AS windn, {q.clip('(temperature - 25.0) / 15.0', 0, 1)} AS warm, {q.clip('no2 / 120.0', 0, 1)} AS no2n FROM nr WHERE n = 1), "
NOW += f"c1 AS (SELECT *, CASE WHEN vent IS NOT NULL THEN {q.clip(f'0.5 * vent + 0.2 * {z("pbln")} + 0.3 * (1 - {z("inv")})', 0, 1)} END AS disp, CASE WHEN windn IS NOT NULL THEN {q.clip(f'0.4 * (1 - {z("windn")}) + 0.4 * (1 - {z("pbln")}) + 0.2 * {z("inv")}', 0, 1)} END AS stag, CASE WHEN warm IS NOT NULL OR no2n IS NOT NULL OR windn IS NOT NULL THEN {q.clip(f'0.5 * {z("warm")} + 0.3 * (1 - {z("windn")}) + 0.2 * {z("no2n")}', 0, 1)} END AS ozone FROM c0), "
NOW += f"c2 AS (SELECT *, CASE WHEN disp IS NOT NULL THEN (1 - disp + stag + ozone) / 3 ELSE ozone END AS whole FROM c1)"


@query(v.with_views("panel", "weather", more=NOW) + "SELECT station, CAST(k AS INT) AS horizon, target_ts, ts AS weather_ts, wind_speed, temperature, inv AS inversion, CASE WHEN ts IS NULL THEN NULL WHEN pbl_height < 150 THEN 'strong' WHEN pbl_height < 300 THEN 'moderate' WHEN pbl_height < 500 THEN 'weak' ELSE 'none' END AS inversion_category, disp AS dispersion_potential, stag AS pollution_stagnation_index, ozone AS ozone_photochemical_potential, whole AS meteorology_pollution_interaction, CASE WHEN whole >= 0.66 THEN 'HIGH' WHEN whole >= 0.33 THEN 'MODERATE' ELSE 'LOW' END AS coupling_state, CASE WHEN ts IS NULL THEN 'feedback+ozone' ELSE 'aerosol+atmospheric+feedback+fire+ozone' END AS coupling_domains, CASE WHEN ts IS NULL THEN 'SPARSE' ELSE 'PARTIAL' END AS data_quality FROM c2")
def look_ahead(spark, sf):
    rows = v.panel(spark, sf).where("no2 is not null and pm25 is not null")
    last = rows.groupBy("station").agg(F.max(F.struct("hour", "pm25", "no2")).alias("x"))
    now = last.select("station", (F.col("x.hour") - F.expr("INTERVAL 40 HOURS") + F.expr("INTERVAL 25 MINUTES")).alias("now"), "x.pm25", "x.no2", F.lit(90.0).alias("wind_direction"))
    out = scoring.look_ahead(now, v.weather(spark, sf))
    six = ("inversion", "dispersion_potential", "pollution_stagnation_index", "ozone_photochemical_potential", "meteorology_pollution_interaction")
    return out.select("station", "horizon", "target_ts", "weather_ts", "wind_speed", "temperature", "inversion_category", *six, "coupling_state", "coupling_domains", "data_quality")


# ---- before training


FILL = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in training.WEATHER)
TABLE = (
    "rd AS (SELECT station, hour, v AS pm25 FROM (SELECT station, date_trunc('hour', ts) AS hour, v, row_number() OVER (PARTITION BY station, date_trunc('hour', ts) ORDER BY ts DESC, v DESC) AS k FROM obs WHERE pollutant = 'pm25') WHERE k = 1), wx AS (SELECT * FROM weather WHERE hour(ts) % 8 < 3), "
    f"jo AS (SELECT rd.*, {', '.join(training.WEATHER)} FROM rd LEFT JOIN wx ON wx.station = rd.station AND wx.ts = rd.hour), fl AS (SELECT station, hour, pm25, {FILL} FROM jo), tt AS (SELECT * FROM fl WHERE pm25 > 0 AND pm25 <= 200), "
    "fc AS (SELECT t.station, t.hour, count(n.fire_id) AS fire_count, CAST(round_even(min(n.km), 2) AS DOUBLE) AS near FROM tt t LEFT JOIN near n ON n.station = t.station AND n.km <= 500 AND n.acq BETWEEN t.hour - INTERVAL 24 HOUR AND t.hour GROUP BY 1, 2), qu AS (SELECT quantile_cont(pm25, 0.25) AS a, quantile_cont(pm25, 0.75) AS b FROM tt), nn AS (SELECT *, row_number() OVER (ORDER BY hour, station) AS k, count(*) OVER () AS n FROM tt)"
)


@query(v.with_views("obs", "weather", "fires", "stations5", more=f"{NEAR}, {TABLE}") + "SELECT t.station, t.hour, t.pm25, t.wind_speed, t.pbl_height, round(CASE WHEN t.wind_speed IS NULL OR t.pbl_height IS NULL THEN NULL ELSE greatest(0.0, least(1.0, t.wind_speed * t.pbl_height / 6000.0)) END, 6) AS ventilation_norm, coalesce(t.pbl_height < 500, false) AS inversion_detected, round(CASE WHEN t.pbl_height IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (500.0 - t.pbl_height) / 500.0)) END, 6) AS inversion_strength, round(cos(radians(coalesce(t.wind_direction, 0.0))), 6) AS wind_dir_cos, dayofweek(t.hour) IN (0, 6) AS is_weekend, fc.fire_count, coalesce(fc.near, 501.0) AS nearest_fire, lag(t.pm25, 1) OVER s AS pm25_lag1, lag(t.pm25, 24) OVER s AS pm25_lag24, round(avg(t.pm25) OVER (PARTITION BY t.station ORDER BY t.hour ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS pm25_mean6, round(stddev_samp(t.pm25) OVER (PARTITION BY t.station ORDER BY t.hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 4) AS pm25_std24, (t.pm25 < a - 3 * (b - a) OR t.pm25 > b + 3 * (b - a)) AS outlier, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * CAST(0.85 AS DOUBLE), 0) THEN 'validation' ELSE 'test' END AS split FROM nn t JOIN fc ON fc.station = t.station AND fc.hour = t.hour, qu WINDOW s AS (PARTITION BY t.station ORDER BY t.hour)")
def training_table(spark, sf):
    readings = v.obs(spark, sf).where("pollutant = 'pm25'").select("station", "ts", F.col("v").alias("pm25"))
    rows = training.training_table(readings, v.weather(spark, sf).where("hour(ts) % 8 < 3"), v.stations(spark), v.fires(spark, sf), plausible=(0, 200))
    six = ("ventilation_norm", "inversion_strength", "wind_dir_cos", "pm25_mean6")
    return rows.select(
        "station", "hour", "pm25", "wind_speed", "pbl_height", "inversion_detected", "is_weekend", "fire_count", F.col("nearest_fire_distance").alias("nearest_fire"), "pm25_lag1", "pm25_lag24",
        *[F.round(c, 6).alias(c) for c in six], F.round("pm25_std24", 4).alias("pm25_std24"), F.col("pm25_iqr_outlier").alias("outlier"), "split",
    )


@query(v.with_views("panel", more=f"{SPLIT}, f AS (SELECT station, hour, split, last_value(pm25 IGNORE NULLS) OVER w AS pm25, last_value(no2 IGNORE NULLS) OVER w AS no2 FROM s WINDOW w AS (PARTITION BY station ORDER BY hour ROWS UNBOUNDED PRECEDING)), t AS (SELECT median(pm25) AS mp, avg(pm25) AS ap, stddev_pop(pm25) AS dp, median(no2) AS mn, avg(no2) AS an, stddev_pop(no2) AS dn FROM f WHERE split = 'train')") + "SELECT station, hour, split, round((coalesce(pm25, mp) - ap) / dp, 6) AS pm25, round((coalesce(no2, mn) - an) / dn, 6) AS no2 FROM f, t")
def standardised_rows(spark, sf):
    rows = training.split_by_span(v.panel(spark, sf), "hour").select("station", "hour", "split", "pm25", "no2")
    stats = training.train_stats(rows, ["station"], "hour", ["pm25", "no2"])
    return training.standardised(rows, stats, ["station"], "hour", ["pm25", "no2"]).withColumns({c: F.round(c, 6) for c in ("pm25", "no2")})


CANDIDATES = ["pm25", "o3", "nothing", "always", "absent", "station"]


@query(v.with_views("panel", more="c AS (SELECT *, CAST(NULL AS DOUBLE) AS nothing, 5 AS always FROM panel), a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS d FROM c" for c in ("pm25", "o3", "nothing", "always")) + ")") + "SELECT column_name, CASE WHEN n = 0 THEN 'all NaN' WHEN d <= 1 THEN 'constant (nunique=' || d || ')' ELSE 'kept' END AS reason FROM a UNION ALL SELECT 'absent', 'not in dataset' UNION ALL SELECT 'station', 'in drop set'")
def selected_columns(spark, sf):
    rows = v.panel(spark, sf).withColumns({"nothing": F.lit(None).cast("double"), "always": F.lit(5)})
    kept, reasons = training.selected_columns(rows, CANDIDATES, ("station",))
    return spark.createDataFrame([*[(c, "kept") for c in kept], *reasons.items()], "column_name string, reason string")


NAMES = list(training.STATION_NAMES)[:12]


@query("WITH n AS (SELECT s_suppkey, CASE s_suppkey % 14 " + " ".join(f"WHEN {i} THEN ' {n.upper()} '" for i, n in enumerate(NAMES)) + " WHEN 12 THEN ' Sector 62, Noida - UPPCB' ELSE 'Gate ' || s_suppkey || '- IMD, Delhi' END AS name FROM supplier), m(short, station) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in training.STATION_NAMES.items()) + "), f(short, station) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in training.FILE_NAMES.items()) + "), c AS (SELECT *, trim(split_part(regexp_replace(name, ' ?- (DPCC|CPCB|HSPCB|UPPCB|IMD).*$', '', 's'), ',', 1)) AS cut FROM n) SELECT s_suppkey, coalesce(m.station, name) AS by_monitor, coalesce(f.station, cut) AS by_file FROM c LEFT JOIN m ON m.short = lower(trim(name)) LEFT JOIN f ON f.short = lower(cut)")
def station_names(spark, sf):
    key = F.col("s_suppkey")
    name = F.when(key % 14 == 12, " Sector 62, Noida - UPPCB").otherwise(F.concat(F.lit("Gate "), key, F.lit("- IMD, Delhi")))
    for i, n in enumerate(NAMES):
        name = F.when(key % 14 == i, f" {n.upper()} ").otherwise(name)
    return v.table(spark, sf, "supplier").select(key, training.canonical_station(name).alias("by_monitor"), training.station_of_file(name).alias("by_file"))


@query("SELECT c_custkey, coalesce(c_custkey % 7 = 0, false) OR c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS demo FROM customer")
def demo_rows(spark, sf):
    """Segments stand in for sources: two of them carry a prefix of made-up rows, in capitals."""
    source = F.when(F.col("c_mktsegment") == "BUILDING", "Demo_hydration").when(F.col("c_mktsegment") == "HOUSEHOLD", "BUNDLED-csv").when(F.col("c_mktsegment") == "MACHINERY", "a demo")
    return v.table(spark, sf, "customer").select("c_custkey", training.demo_row(F.when(F.col("c_custkey") % 7 == 0, F.lit(True)), source).alias("demo"))


@query("WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS priority FROM orders WHERE o_orderdate < DATE '1995-01-01' UNION ALL SELECT o_custkey, o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderdate >= DATE '1995-01-01') SELECT k, max(id) AS id, arg_max({'p': price}, id).p AS price, arg_max({'p': priority}, id).p AS priority FROM a GROUP BY k")
def evolved_table(spark, sf):
    """Orders of two times, as if the later ones came with another column and without the price."""
    rows, early = v.table(spark, sf, "orders"), F.col("o_orderdate") < F.lit("1995-01-01").cast("date")
    base = [F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id")]
    stored = rows.where(early).select(*base, F.col("o_totalprice").cast("double").alias("price"))
    return training.evolved(stored, rows.where(~early).select(*base, F.col("o_orderpriority").alias("priority")), ["k"], "id")
