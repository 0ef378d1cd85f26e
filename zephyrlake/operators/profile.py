"""Vertical profiles from nested arrays: a payload of series by pressure level becomes rows of levels, heights and inversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions import met
from zephyrlake.functions.basic import clip

#: Pressure levels in hPa, gas constant of dry air, gravity.
LEVELS, R_DRY, GRAVITY = (1000, 925, 850, 700), 287.05, 9.80665
HEIGHTS = (925, 850)


def from_payload(df: DataFrame, payload: str, levels: tuple[int, ...] = LEVELS, heights: tuple[int, ...] = HEIGHTS) -> DataFrame:
    """One row per time of a payload's hourly series: other columns, ts, and levels, an array of (p, t, h) from the highest pressure down.

    payload: JSON with hourly.time (UTC), hourly.temperature_<p>hPa and hourly.geopotential_height_<p>hPa. Payloads
    that can't be read, or with fewer than two series of temperature, give no rows; values missing from a series
    are null.
    """
    kinds = ["time array<string>", *[f"temperature_{p}hPa array<double>" for p in levels], *[f"geopotential_height_{p}hPa array<double>" for p in heights]]
    rows = df.withColumn("__h", F.from_json(payload, f"hourly struct<{', '.join(k.replace(' ', ':', 1) for k in kinds)}>")["hourly"])
    names = [f"temperature_{p}hPa" for p in levels]
    rows = rows.where(sum((F.col(f"__h.{c}").isNotNull()).cast("int") for c in names) >= 2)
    series = F.arrays_zip(*[F.coalesce(F.col(f"__h.{k.split()[0]}"), F.array().cast(k.split()[1])).alias(k.split()[0]) for k in kinds])
    rows = rows.withColumn("__x", F.explode(F.slice(series, F.lit(1), F.size("__h.time"))))
    h = lambda p: F.col(f"__x.geopotential_height_{p}hPa") if p in heights else F.lit(None).cast("double")
    shaped = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"__x.temperature_{p}hPa").alias("t"), h(p).alias("h")) for p in sorted(levels, reverse=True)])
    return rows.select(*[c for c in df.columns if c != payload], F.to_timestamp_ntz(F.col("__x.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"), shaped.alias("levels"))


def layer_heights(levels: Column) -> Column:
    """array<struct<p, z>> from the highest pressure down: given heights stand, others are walked up from the level below by the hypsometric equation.

    levels: array of (p, t, h), sorted by falling pressure. The lowest level with a temperature is at 0 unless its
    height is given; a given height anchors what lies above it. With fewer than two temperatures only given
    heights are told; so are those of levels without a temperature.
    """
    warm = F.filter(levels, lambda x: x["t"].isNotNull())
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("p"), none.alias("t"), none.alias("z"), F.array().cast("array<struct<p:double,z:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        rise = R_DRY * ((a["t"] + x["t"]) / 2.0 + 273.15) / GRAVITY * F.ln(a["p"] / x["p"])
        z = F.coalesce(x["h"], F.when(a["p"].isNull(), 0.0).otherwise(a["z"] + rise))
        return F.struct(x["p"].alias("p"), x["t"].alias("t"), z.alias("z"), F.concat(a["out"], F.array(F.struct(x["p"].alias("p"), z.alias("z")))).alias("out"))

    walked = F.aggregate(warm, start, step, lambda a: a["out"])
    given = lambda holds: F.transform(F.filter(levels, lambda x: x["h"].isNotNull() & holds(x)), lambda x: F.struct(x["p"].alias("p"), x["h"].alias("z")))
    every = F.concat(walked, given(lambda x: x["t"].isNull()))
    down = lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0)
    return F.when(F.size(warm) >= 2, F.array_sort(every, down)).otherwise(given(lambda x: F.lit(True)))


def layer_inversion(levels: Column, heights: Column, pbl: Column) -> Column:
    """The strongest layer of adjacent levels with its place and thickness, or the mixing height's proxy where there are fewer than two temperatures.

    struct: detected, strength, category, base_pressure, top_pressure, base_height_m, top_height_m, thickness_m,
    thickness_hpa, gradient, source (lapse_rate or pbl_proxy).
    """
    warm = F.filter(levels, lambda x: x["t"].isNotNull())
    n = F.greatest(F.size(warm) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(warm, F.lit(1), n), F.slice(warm, F.lit(2), n), lambda a, b: F.struct(((b["t"] - a["t"]) / (a["p"] - b["p"]) * 100.0).alias("g"), a["p"].alias("base"), b["p"].alias("top")))
    best = F.array_max(pairs)
    height = lambda p: F.try_element_at(F.filter(heights, lambda x: x["p"] == p), F.lit(1))["z"]
    g, base, top = best["g"], best["base"], best["top"]
    named = F.when(g > 1.5, "strong").when(g > 0.6, "moderate").when(g > 0, "weak").otherwise("none")
    null = F.lit(None).cast("double")
    fields = ("detected", "strength", "category", "base_pressure", "top_pressure", "base_height_m", "top_height_m", "thickness_m", "thickness_hpa", "gradient", "source")
    lapse = (named != "none", F.bround(clip(g / 4.0, 0, 1), 4), named, base, top, F.bround(height(base), 1), F.bround(height(top), 1), F.bround(height(top) - height(base), 1), F.bround(base - top, 1), F.bround(g, 4), F.lit("lapse_rate"))
    proxy = (F.coalesce(pbl < 500, F.lit(False)), F.coalesce(F.bround(clip((500.0 - pbl) / 500.0, 0, 1), 4), F.lit(0.0)), met.proxy_category(pbl), null, null, null, null, null, null, null, F.lit("pbl_proxy"))
    named_struct = lambda values: F.struct(*[x.alias(f) for x, f in zip(values, fields, strict=True)])
    return F.when(best.isNotNull(), named_struct(lapse)).otherwise(named_struct(proxy))
