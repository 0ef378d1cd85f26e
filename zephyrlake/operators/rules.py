"""Rules: alerts, pollution events, response stages and transport risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.functions import met
from zephyrlake.functions.basic import clip
from zephyrlake.operators.series import runs_of_kinds, seconds

#: Alert levels by severity, and limits of the event rules.
SEVERITY = {"SEVERE": 4, "WARNING": 3, "ADVISORY": 2, "WATCH": 1}
STANDARD_24H, VERY_POOR, SEVERE = 60.0, 121.0, 250.0
SURGE_PCT, RELIEF_PCT, WASHOUT_PCT, SUSTAINED_H = 30.0, 25.0, 45.0, 24


def alerts(df: DataFrame) -> DataFrame:
    """One row per station and rule that holds: station, rule, level, severity.

    df: station, aqi, dominant, trend, wind_speed, pbl_height, humidity, precipitation, fire_count,
    nearest_fire_distance; what is null breaks no rule, a missing index counts as 0.
    """
    a = F.coalesce("aqi", F.lit(0))
    rules = [
        (a >= 401, "severe_aqi", "SEVERE"),
        (a.between(301, 400), "very_poor_aqi", "WARNING"),
        (a.between(201, 300), "poor_aqi", "ADVISORY"),
        (F.col("trend") == "rising", "rising_trend", "WATCH"),
        (F.col("trend") == "falling", "falling_trend", "WATCH"),
        ((F.col("dominant") == "pm25") & (a >= 201), "fine_particles", "WATCH"),
        (F.col("wind_speed") < 2, "stagnant_wind", "WATCH"),
        (F.col("wind_speed") > 15, "strong_wind", "WATCH"),
        (F.col("pbl_height") < 150, "strong_inversion", "WARNING"),
        ((F.col("pbl_height") >= 150) & (F.col("pbl_height") < 300), "inversion", "WATCH"),
        (F.col("humidity") > 80, "high_humidity", "ADVISORY"),
        ((F.col("precipitation") <= 0.5) & (a >= 201), "no_washout", "WATCH"),
        ((F.col("fire_count") > 50) & (F.col("nearest_fire_distance") < 300), "fires_near", "WARNING"),
        ((F.col("fire_count") > 20) & ~F.coalesce((F.col("fire_count") > 50) & (F.col("nearest_fire_distance") < 300), F.lit(False)), "fires", "WATCH"),
    ]
    held = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"), F.lit(SEVERITY[level]).alias("severity"))) for holds, name, level in rules]))
    return df.select("station", F.explode(held).alias("x")).select("station", "x.*")


def trend(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rising, falling or stable per key: the last value against the first, by more than 5 per cent."""
    out = df.groupBy(*keys).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"))
    return out.select(*keys, F.when(F.col("b") > F.col("a") * 1.05, "rising").when(F.col("b") < F.col("a") * 0.95, "falling").otherwise("stable").alias("trend"))


def surge_severity(peak: Column) -> Column:
    """Severity of a surge by its peak."""
    return F.when(peak >= SEVERE, "severe").when(peak >= VERY_POOR, "moderate").otherwise("mild")


def confidence(margin: Column, half: Column) -> Column:
    """high, medium or low by the margin against half the interval; medium without an interval."""
    return F.when(margin.isNull(), "unknown").when(half.isNull(), "medium").when(margin >= half, "high").when(margin >= 0.5 * half, "medium").otherwise("low")


def events(series: DataFrame, baseline: DataFrame, atmosphere: DataFrame) -> DataFrame:
    """Surges, reliefs and sustained episodes of each station's forecast.

    series: (station, ts, pm25); baseline: (station, baseline); atmosphere: (station, wind_speed, pbl_height,
    inversion (bool)). Out: station, event_type, start_ts, end_ts (null if it runs to the last point), peak,
    peak_ts, trough, trough_ts, severity, active_factors. Of several runs that of the highest peak (for relief
    the lowest trough) counts, the earliest of equals.
    """
    points = series.where("pm25 is not null").join(baseline, "station", "left")
    limit = F.greatest(F.col("baseline") * (1 + SURGE_PCT / 100), F.lit(STANDARD_24H))
    known = F.col("baseline") > 0
    vent = F.col("wind_speed") * F.col("pbl_height")
    air = atmosphere.select(
        "station",
        (F.coalesce((vent < 3000).cast("int"), F.lit(0)) + F.coalesce((F.col("pbl_height") < 300).cast("int"), F.lit(0)) + F.coalesce(F.col("inversion").cast("int"), F.lit(0)) + F.coalesce((F.col("wind_speed") < 2).cast("int"), F.lit(0))).alias("active_factors"),
        (F.coalesce(vent >= 6000, F.lit(False)) | F.coalesce((F.col("pbl_height") >= 300) & (F.col("wind_speed") >= 2), F.lit(False))).alias("disperses"),
    )

    holds = {"pollution_surge": known & (F.col("pm25") >= limit), "pollution_relief": known & (F.col("pm25") <= F.col("baseline") * (1 - RELIEF_PCT / 100)), "high_risk_episode": F.col("pm25") >= VERY_POOR}
    found = runs_of_kinds(points, ["station"], "ts", holds, "pm25").withColumnRenamed("kind", "event_type")
    found = found.where((F.col("event_type") != "high_risk_episode") | (F.col("n") >= SUSTAINED_H))
    w = Window.partitionBy("station", "event_type").orderBy(F.when(F.col("event_type") == "pollution_relief", F.col("trough")).otherwise(-F.col("peak")), "start_ts")
    rows = found.withColumn("__k", F.row_number().over(w)).where("__k = 1").join(baseline, "station", "left").join(air, "station", "left")
    drop = (F.col("baseline") - F.col("trough")) / F.col("baseline") * 100
    kind = F.col("event_type")
    rows = rows.where((kind == "pollution_surge") | ((kind == "pollution_relief") & (F.col("disperses") | (drop >= WASHOUT_PCT))) | ((kind == "high_risk_episode") & (F.col("active_factors") > 0)))
    severity = F.when(kind == "pollution_surge", surge_severity(F.col("peak"))).when(kind == "pollution_relief", F.when((drop >= WASHOUT_PCT) | (F.col("trough") < STANDARD_24H), "significant").otherwise("minor")).otherwise(F.when((F.col("peak") >= SEVERE) | (F.col("active_factors") >= 2), "emergency").otherwise("high"))
    end = F.when(~F.col("open"), F.col("end_ts"))
    up = kind != "pollution_relief"
    return rows.select("station", "event_type", "start_ts", end.alias("end_ts"), F.when(up, F.col("peak")).alias("peak"), F.when(up, F.col("peak_ts")).alias("peak_ts"), F.when(~up, F.col("trough")).alias("trough"), F.when(~up, F.col("trough_ts")).alias("trough_ts"), severity.alias("severity"), F.coalesce("active_factors", F.lit(0)).alias("active_factors"))


def baseline_24h(obs: DataFrame, release: DataFrame) -> DataFrame:
    """station, baseline: mean of v over (release - 24 h, release]."""
    rows = obs.join(release, "station")
    age = seconds("release") - seconds("ts")
    return rows.where((age >= 0) & (age < 86400)).groupBy("station").agg(F.avg("v").alias("baseline"))


def transport_risk(df: DataFrame) -> DataFrame:
    """Regional risk per row from fire_impact_score, nearest_fire_distance, wind_aligned_fire_count, wind_alignment_pct, wind_speed, pbl_height, inversion, pm25.

    Adds fire_component, atmo_component, pollution_component, risk_score (0 to 100) and risk_level. Components
    without inputs are left out and the other weights rescaled.
    """
    vent, pbl_n = clip(F.col("wind_speed") * F.col("pbl_height") / 6000.0, 0, 1), clip(F.col("pbl_height") / 1500.0, 0, 1)
    near = 1 - F.least(F.lit(1.0), F.coalesce("nearest_fire_distance", F.lit(501.0)) / 500.0)
    # Four places, half to even by the scaled double: bround goes by the shortest decimal that names it, which a sum's last bit may put beside a tie.
    four = lambda x: F.rint(x * 10_000) / 10_000
    fire = four(clip(0.5 * F.coalesce("fire_impact_score", F.lit(0.0)) + 0.25 * near + 0.15 * clip(F.coalesce("wind_aligned_fire_count", F.lit(0)) / 50.0, 0, 1) + 0.1 * F.coalesce("wind_alignment_pct", F.lit(0.0)) / 100.0, 0, 1))
    air = F.when(vent.isNotNull() | pbl_n.isNotNull() | F.col("inversion").isNotNull(), four(clip(0.45 * (1 - F.coalesce(vent, F.lit(0.5))) + 0.3 * F.coalesce("inversion", F.lit(0.0)) + 0.25 * (1 - F.coalesce(pbl_n, F.lit(0.5))), 0, 1)))
    loaded = F.when(F.col("pm25") > 0, met.loading(F.col("pm25")))
    rows = df.withColumns({"fire_component": fire, "atmo_component": air, "pollution_component": loaded})
    parts = [(0.45, "fire_component"), (0.35, "atmo_component"), (0.2, "pollution_component")]
    total = sum(F.coalesce(w * F.col(c), F.lit(0.0)) for w, c in parts) / sum(F.when(F.col(c).isNotNull(), w).otherwise(0.0) for w, c in parts)
    rows = rows.withColumn("risk_score", F.bround(100 * clip(total, 0, 1), 0).cast("int"))
    score = F.col("risk_score")
    named = F.when(score.isNull(), "UNAVAILABLE").when(score <= 20, "LOW").when(score <= 40, "MODERATE").when(score <= 60, "ELEVATED").when(score <= 80, "HIGH").otherwise("VERY HIGH")
    return rows.withColumn("risk_level", named)
