"""Meteorology: stability, mixing, inversions and the two-way coupling as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrlake.functions.basic import bands, clip

#: Hours to which each diurnal factor of the mixing-height proxy applies, the last hour included.
DIURNAL = [(5, 1.3), (8, 1.2), (10, 1.05), (15, 0.75), (17, 0.9), (20, 1.05), (23, 1.2)]


def diurnal_factor(hour: Column) -> Column:
    """Multiplier of the inversion proxy by hour of day; 1 outside 0 to 23."""
    out = F.when(~hour.between(0, 23), 1.0)
    for last, factor in DIURNAL:
        out = out.when(hour <= last, factor)
    return out.otherwise(1.0)


def proxy_category(pbl: Column) -> Column:
    """Inversion category by mixing height."""
    return bands(pbl, [(150, "strong"), (300, "moderate"), (500, "weak")], "none", "unknown")


def proxy_strength(pbl: Column, hour: Column) -> Column:
    """Inversion strength, 0 to 1, by mixing height and hour; 0 where the height is missing."""
    return F.coalesce(clip(clip((500.0 - pbl) / 500.0, 0, 1) * diurnal_factor(hour), 0, 1), F.lit(0.0))


def lapse(base_p: float, base_t: Column, top_p: float, top_t: Column) -> Column:
    """Temperature gradient of a layer in K per 100 hPa, positive where it warms with height."""
    return (top_t - base_t) / (base_p - top_p) * 100.0


def profile_inversion(levels: dict[int, Column]) -> Column:
    """struct<gradient, base, top, category, strength>: the strongest layer of adjacent levels at hand; null with fewer than two."""
    present = F.filter(F.array(*[F.struct(F.lit(float(p)).alias("p"), t.alias("t")) for p, t in sorted(levels.items(), reverse=True)]), lambda x: x["t"].isNotNull())
    layers = F.zip_with(F.slice(present, F.lit(1), F.greatest(F.size(present) - 1, F.lit(0))), F.slice(present, F.lit(2), F.greatest(F.size(present) - 1, F.lit(0))), lambda a, b: F.struct(((b["t"] - a["t"]) / (a["p"] - b["p"]) * 100.0).alias("gradient"), a["p"].alias("base"), b["p"].alias("top")))
    best = F.array_max(layers)
    g = best["gradient"]
    named = F.when(g > 1.5, "strong").when(g > 0.6, "moderate").when(g > 0, "weak").otherwise("none")
    return F.when(best.isNotNull(), F.struct(g.alias("gradient"), best["base"].alias("base"), best["top"].alias("top"), named.alias("category"), clip(g / 4.0, 0, 1).alias("strength")))


def thickness(t_base: Column, t_top: Column, p_base: float, p_top: float) -> Column:
    """Hypsometric layer thickness in m from temperatures in degrees C."""
    return 287.05 / 9.80665 * ((t_base + t_top) / 2 + 273.15) * math.log(p_base / p_top)


def dispersion_condition(pbl: Column) -> Column:
    """Mixing condition; heights outside 0 to 5000 m are unknown."""
    known = F.when(pbl.between(0, 5000), pbl)
    return bands(known, [(150, "TRAPPED"), (300, "LIMITED"), (500, "MODERATE")], "GOOD", "UNKNOWN")


def mixing_category(pbl: Column) -> Column:
    """Trapping category of a mixing height."""
    return bands(pbl, [(150, "strong_trapping"), (300, "moderate_trapping"), (500, "weak_trapping")], "good_dispersion", "unavailable")


def wind_category(speed: Column) -> Column:
    """Wind band."""
    return bands(speed, [(0.5, "calm"), (2, "light"), (4, "moderate"), (7, "brisk")], "strong", "unavailable")


def ventilation_category(coefficient: Column) -> Column:
    """Ventilation band of wind times mixing height."""
    return bands(coefficient, [(3000, "poor"), (6000, "moderate")], "good", "unavailable")


def loading(pm25: Column) -> Column:
    """Observed PM2.5 between 35 and 300, as 0 to 1."""
    return clip((pm25 - 35.0) / 265.0, 0, 1)


def trapping(wind: Column, pbl: Column, inversion: Column, pm25: Column) -> Column:
    """Trapping index, 0 to 1: dispersion quality turned round, and observed loading where there is any."""
    vent = clip(wind * pbl / 6000.0, 0, 1)
    quality = 0.5 * vent + 0.2 * F.coalesce(clip(pbl / 1500.0, 0, 1), F.lit(0.5)) + 0.3 * (1 - F.coalesce(inversion, F.lit(0.0)))
    held = clip(1 - quality, 0, 1)
    return F.when(pm25 > 0, clip(0.7 * held + 0.3 * loading(pm25), 0, 1)).otherwise(held)


def trapping_category(score: Column) -> Column:
    """Trapping band."""
    return bands(score, [(0.33, "low"), (0.55, "moderate"), (0.75, "high")], "severe", "unavailable")


def daytime(hour: Column) -> Column:
    """Daytime weight: a cosine about 13 h from 7 to 18 h; hour 0 and a missing hour count as 12."""
    h = F.when(F.coalesce(hour, F.lit(0)) == 0, 12).otherwise(F.pmod(hour, F.lit(24)))
    return F.when(h.between(7, 18), clip(F.cos(2 * math.pi * (h - 13) / 22.0), 0, 1)).otherwise(0.0)


def optical_depth(pm25: Column) -> Column:
    """Aerosol optical depth from PM2.5."""
    return clip(F.coalesce(pm25, F.lit(0.0)) * 0.00025, 0, 2.5)


def transmittance(pm25: Column) -> Column:
    """Share of sunlight that reaches the ground."""
    return F.exp(-optical_depth(pm25))


def suppression(pm25: Column, hour: Column) -> Column:
    """Factor on the mixing height by aerosol."""
    return clip(1 - 0.35 * optical_depth(pm25) * transmittance(pm25) * daytime(hour), 0.8, 1)


def damping(pm25: Column, hour: Column) -> Column:
    """Factor on the daily swing of temperature by aerosol."""
    return clip(1 - (1 - transmittance(pm25)) * 0.4 * daytime(hour), 0.85, 1)


def corrected_pbl(pm25: Column, pbl: Column, hour: Column) -> Column:
    """Mixing height after suppression; 0 and null count as 600 m."""
    return F.when(F.coalesce(pbl, F.lit(0.0)) == 0, 600.0).otherwise(pbl) * suppression(pm25, hour)


def stability(pm25: Column, pbl: Column, wind: Column, hour: Column) -> Column:
    """Stability index, 0 to 1; a wind of 0 or null counts as 4 m/s."""
    speed = F.when(F.coalesce(wind, F.lit(0.0)) == 0, 4.0).otherwise(wind)
    mixed = clip(1 - corrected_pbl(pm25, pbl, hour) / 600.0, 0, 1)
    return clip(0.5 * mixed + 0.3 * clip(1 - speed / 8.0, 0, 1) + 0.2 * (1 - daytime(hour)), 0, 1)


def coupling_strength(index: Column) -> Column:
    """Label of a stability index."""
    return F.when(index >= 0.6, "strong").when(index >= 0.35, "moderate").otherwise("weak")


def coupling_potentials(wind: Column, pbl: Column, inversion: Column, pm25: Column, temperature: Column, no2: Column, fires: dict[str, Column] | None = None) -> dict[str, Column]:
    """The nine coupling potentials, 0 to 1, each null where its inputs are missing.

    fires: impact, nearest_km, upwind_count, alignment_pct of the fires around, if known.
    """
    wind_n, pbl_n, vent = clip(wind / 7.0, 0, 1), clip(pbl / 1500.0, 0, 1), clip(wind * pbl / 6000.0, 0, 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    none = F.lit(None).cast("double")
    dispersion = clip(0.5 * vent + 0.2 * zero(pbl_n) + 0.3 * (1 - zero(inversion)), 0, 1)
    accumulation = clip(1 - dispersion, 0, 1)
    held = F.when(inversion.isNotNull() | pbl_n.isNotNull(), clip(0.5 * zero(inversion) + 0.5 * (1 - zero(pbl_n)), 0, 1))
    stagnation = F.when(wind_n.isNotNull() | pbl_n.isNotNull() | inversion.isNotNull(), clip(0.4 * (1 - zero(wind_n)) + 0.4 * (1 - zero(pbl_n)) + 0.2 * zero(inversion), 0, 1))
    aerosol = clip(0.5 * loading(pm25) + 0.5 * accumulation, 0, 1)
    if fires:
        near = clip(1 - F.least(F.lit(1.0), fires["nearest_km"] / 500.0), 0, 1)
        burning = clip(0.5 * zero(fires["impact"]) + 0.25 * zero(near) + 0.15 * clip(zero(fires["upwind_count"].cast("double")) / 50.0, 0, 1) + 0.1 * clip(zero(fires["alignment_pct"]) / 100.0, 0, 1), 0, 1)
        burning = F.when(fires["impact"].isNotNull() | fires["nearest_km"].isNotNull() | fires["upwind_count"].isNotNull(), burning)
    else:
        burning = none
    regional = F.when(burning.isNotNull() | wind_n.isNotNull() | vent.isNotNull(), clip(0.6 * zero(burning) + 0.25 * F.coalesce(1 - vent, F.lit(0.5)) + 0.15 * (1 - zero(wind_n)), 0, 1))
    warm, no2_n = clip((temperature - 25.0) / 15.0, 0, 1), clip(no2 / 120.0, 0, 1)
    ozone = F.when(warm.isNotNull() | no2_n.isNotNull() | wind_n.isNotNull(), clip(0.5 * zero(warm) + 0.3 * (1 - zero(wind_n)) + 0.2 * zero(no2_n), 0, 1))
    parts = [accumulation, stagnation, ozone, burning]
    count = sum(F.when(p.isNotNull(), 1).otherwise(0) for p in parts)
    together = F.when(count > 0, clip(sum(zero(p) for p in parts) / count, 0, 1))
    return {
        "dispersion_potential": dispersion, "accumulation_potential": accumulation, "inversion_trapping_potential": held, "pollution_stagnation_index": stagnation, "aerosol_accumulation_potential": aerosol,
        "fire_transport_influence": burning, "regional_transport_potential": regional, "ozone_photochemical_potential": ozone, "meteorology_pollution_interaction": together,
    }


def band_label(x: Column) -> Column:
    """Low, Moderate or High."""
    return bands(x, [(0.33, "Low"), (0.66, "Moderate")], "High")
