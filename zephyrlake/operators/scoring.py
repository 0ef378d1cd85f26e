"""Scoring per horizon: a model's answer where its contract holds, else a stated heuristic, with the provenance of both; and the look-ahead of coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions import aqi, met
from zephyrlake.operators.align import asof_nearest

POLLUTANTS = ("pm25", "pm10", "o3", "no2", "so2", "co")
#: Inputs that heuristics replace by constants, measurements that a model can't do without, and features that are truly 0 where nothing was detected.
HEURISTIC_INPUTS = {"wind_speed": 5.0, "pbl_height": 500.0, "temperature": 25.0, "pm25_lag1": 50.0, "pm10_lag1": None, "so2_lag1": 15.0, "co_lag1": 1.4, "fire_impact_score": 0.0, "precipitation": 0.0}
REQUIRED, IMPUTABLE = ("latitude", "longitude"), ("mean_frp", "max_bright")
#: Which domain a coupling potential speaks for, in the order in which domains are named.
DOMAINS = (
    ("aerosol_accumulation_potential", "aerosol"), ("dispersion_potential", "atmospheric"), ("accumulation_potential", "atmospheric"), ("inversion_trapping_potential", "atmospheric"), ("pollution_stagnation_index", "atmospheric"),
    ("meteorology_pollution_interaction", "feedback"), ("fire_transport_influence", "fire"), ("regional_transport_potential", "fire"), ("ozone_photochemical_potential", "ozone"),
)


def measured(df: DataFrame, name: str) -> Column:
    """A feature as a number; null where the table lacks it, or it is null or not a number."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    x = F.col(f"`{name}`").try_cast("double")
    return F.when(~F.isnan(x), x)


def missing_of(df: DataFrame, names: list[str]) -> Column:
    """The names whose feature can't be had, in their order."""
    return F.filter(F.array(*[F.when(measured(df, n).isNull(), F.lit(n)) for n in names]).cast("array<string>"), lambda x: x.isNotNull())


def heuristics(df: DataFrame, horizon: str) -> dict[str, Column]:
    """What each pollutant is taken for without a model; missing inputs take their constants, a real 0 stays. pm10 leans on the column pm25_pred."""
    f = {n: F.coalesce(measured(df, n), F.lit(default)) if default is not None else measured(df, n) for n, default in HEURISTIC_INPUTS.items()}
    h, zero = F.col(horizon).cast("double"), F.lit(0.0)
    calm = 1.0 + F.greatest(zero, 2.0 - f["wind_speed"]) * 0.04
    shallow = 1.0 + F.greatest(zero, (400.0 - f["pbl_height"]) / 400.0) * 0.35
    solar = 1.0 + F.greatest(zero, (f["temperature"] - 20.0) / 20.0) * 0.3
    pm25 = F.col("pm25_pred")
    return {
        "pm25": f["pm25_lag1"] * F.greatest(F.lit(0.55), 1.0 - 0.006 * h) * calm * shallow * (1.0 + f["fire_impact_score"] * 0.15),
        "pm10": F.greatest(F.coalesce(f["pm10_lag1"], pm25 * 1.9) * (1.0 - 0.004 * h), pm25 * 1.5),
        "o3": F.greatest(F.lit(10.0), 45.0 * solar * (1.0 - 0.002 * h)),
        "no2": F.greatest(F.lit(5.0), 48.0 / (1.0 + f["wind_speed"] * 0.05)),
        "so2": F.greatest(F.lit(2.0), f["so2_lag1"] * F.greatest(F.lit(0.6), 1.0 - f["precipitation"] * 0.15) / (1.0 + F.greatest(zero, f["wind_speed"] - 3.0) * 0.03)),
        "co": F.greatest(F.lit(0.2), f["co_lag1"] / (1.0 + f["wind_speed"] * 0.04)),
    }


def with_contract(df: DataFrame, declared: list[str] | None) -> DataFrame:
    """Adds contract: declared_features, missing_required, imputed, satisfied, reason of each row against the features a model was trained on.

    declared: None if the model says nothing of its features, which no row satisfies. A missing feature blocks the
    model only if it has to be measured; one that may be imputed is named, others are neither.
    """
    if not declared:
        none = F.array().cast("array<string>")
        return df.withColumn("contract", F.struct(F.lit(None).cast("int").alias("declared_features"), none.alias("missing_required"), none.alias("imputed"), F.lit(False).alias("satisfied"), F.lit("the model declares no features").alias("reason")))
    absent = missing_of(df, declared)
    blocking, filled = (F.array_sort(F.array_intersect(absent, F.array(*[F.lit(n) for n in own]))) for own in (REQUIRED, IMPUTABLE))
    ok = F.size(blocking) == 0
    reason = F.when(~ok, F.concat(F.lit("required measured features unavailable: "), F.array_join(blocking, ", ")))
    return df.withColumn("contract", F.struct(F.lit(len(declared)).alias("declared_features"), blocking.alias("missing_required"), filled.alias("imputed"), ok.alias("satisfied"), reason.alias("reason")))


def by_horizon(df: DataFrame, horizons: list[int]) -> DataFrame:
    """Every row once for each horizon."""
    return df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))


def predicted(df: DataFrame, models: dict[str, Column], horizon: str = "horizon", satisfied: Column | None = None) -> DataFrame:
    """Adds <pollutant>_pred, aqi, category, dominant, heuristic_pollutants and invented_inputs to rows by horizon.

    models: each pollutant's model answer, null where there is no model of that horizon; it counts, from 0 up, where it is
    a finite number and the row satisfies the contract. All else is the heuristic's, which is named, and so are the
    inputs that it had to invent.
    """
    ok = F.lit(True) if satisfied is None else satisfied
    answer = lambda p: F.when(ok & ~F.isnan(models[p]) & (F.abs(models[p]) < float("inf")), F.greatest(F.lit(0.0), models[p])) if p in models else F.lit(None).cast("double")
    rows = df.withColumns({f"__m_{p}": answer(p) for p in POLLUTANTS})
    first = heuristics(df, horizon)["pm25"]
    rows = rows.withColumn("pm25_pred", F.coalesce("__m_pm25", first))
    rest = heuristics(df, horizon)
    rows = rows.withColumns({f"{p}_pred": F.coalesce(f"__m_{p}", rest[p]) for p in POLLUTANTS[1:]})
    rows = aqi.with_overall(rows, {p: f"{p}_pred" for p in POLLUTANTS})
    stood_in = F.filter(F.array(*[F.when(F.col(f"__m_{p}").isNull(), F.lit(p)) for p in POLLUTANTS]), lambda x: x.isNotNull())
    rows = rows.withColumn("heuristic_pollutants", stood_in)
    invented = F.when(F.size("heuristic_pollutants") > 0, missing_of(df, list(HEURISTIC_INPUTS))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("invented_inputs", invented).drop(*[f"__m_{p}" for p in POLLUTANTS])


def coupling_state(potentials: dict[str, Column]) -> Column:
    """Band of the composite potential."""
    x = potentials["meteorology_pollution_interaction"]
    return F.when(x.isNull(), "NONE").when(x >= 0.66, "HIGH").when(x >= 0.33, "MODERATE").otherwise("LOW")


def coupling_domains(potentials: dict[str, Column]) -> Column:
    """The domains that contributed data, joined by +; ``none`` without any."""
    named = F.array_distinct(F.filter(F.array(*[F.when(potentials[n].isNotNull(), F.lit(d)) for n, d in DOMAINS]), lambda x: x.isNotNull()))
    return F.when(F.size(named) > 0, F.array_join(named, "+")).otherwise("none")


def data_quality(potentials: dict[str, Column]) -> Column:
    """How many of the potentials could be had: all, six or more, some, or none."""
    n = sum(x.isNotNull().cast("int") for x in potentials.values())
    return F.when(n == len(potentials), "GOOD").when(n >= 6, "PARTIAL").when(n >= 1, "SPARSE").otherwise("UNAVAILABLE")


def look_ahead(now: DataFrame, weather: DataFrame, window_hours: int = 72, tolerance_hours: float = 2.0) -> DataFrame:
    """station, horizon, target_ts, weather_ts, weather of that time, inversion and the coupling potentials for each hour ahead.

    now: (station, now, pm25, no2, wind_direction), one row each, whose values hold for all hours, as does their fire
    struct if they have one (impact, nearest_km, upwind_count, alignment_pct). weather: (station, ts, wind_speed,
    wind_direction, pbl_height, temperature, humidity); the row nearest in time within the tolerance counts, the earlier of
    two. Hours without one have null weather. A missing or zero direction is that of ``now``.
    """
    fields = ["wind_speed", "wind_direction", "pbl_height", "temperature", "humidity"]
    hours = now.withColumnRenamed("wind_direction", "__direction").withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(window_hours))))
    hours = hours.withColumn("ts", F.col("now") + F.make_dt_interval(F.lit(0), F.col("horizon")))
    rows = asof_nearest(hours, weather.select("station", "ts", *fields), ["station"], "ts", fields, tolerance_hours, "weather_ts")
    strength = F.when(F.col("weather_ts").isNotNull(), met.proxy_strength(F.col("pbl_height"), F.hour("weather_ts")))
    rows = rows.withColumns({"wind_direction": F.coalesce(F.when(F.col("wind_direction") != 0, F.col("wind_direction")), F.col("__direction")), "inversion": strength, "inversion_category": F.when(F.col("weather_ts").isNotNull(), met.proxy_category(F.col("pbl_height")))})
    fires = {n: F.col(f"fire.{n}") for n in ("impact", "nearest_km", "upwind_count", "alignment_pct")} if "fire" in now.columns else None
    nine = met.coupling_potentials(F.col("wind_speed"), F.col("pbl_height"), F.col("inversion"), F.col("pm25"), F.col("temperature"), F.col("no2"), fires)
    rows = rows.withColumns(nine)
    seen = {n: F.col(n) for n in nine}
    rows = rows.withColumns({"coupling_state": coupling_state(seen), "coupling_domains": coupling_domains(seen), "data_quality": data_quality(seen)})
    return rows.select("station", "horizon", F.col("ts").alias("target_ts"), "weather_ts", *fields, "inversion", "inversion_category", *nine, "coupling_state", "coupling_domains", "data_quality")
