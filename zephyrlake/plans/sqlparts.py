"""SQL expressions from the same fixed tables as the Column functions."""

from __future__ import annotations

from zephyrlake.functions import aqi, geo


def subindex(p: str, x: str) -> str:
    """Sub-index of an SQL expression."""
    s = 10 ** aqi.DECIMALS[p]
    t = f"(floor(({x}) * {s}.0 + 1e-9) / {s}.0)"
    bands = " ".join(f"WHEN {t} BETWEEN {a} AND {b} THEN CAST({(d - c) / (b - a)!r} AS DOUBLE) * ({t} - {a}) + {c}" for a, b, c, d in aqi.BREAKPOINTS[p])
    return f"CASE WHEN ({x}) IS NULL OR ({x}) < 0 THEN NULL WHEN {t} >= {aqi.BREAKPOINTS[p][-1][1]} THEN 500.0 {bands} END"


def category(x: str) -> str:
    """Index category of an SQL expression."""
    return f"CASE WHEN {x} IS NULL OR {x} < 0 THEN 'Unknown' WHEN {x} < 51 THEN 'Good' WHEN {x} < 101 THEN 'Satisfactory' WHEN {x} < 201 THEN 'Moderate' WHEN {x} < 301 THEN 'Poor' WHEN {x} < 401 THEN 'Very Poor' ELSE 'Severe' END"


def gap_category(x: str) -> str:
    """Evaluation-side category of an SQL expression."""
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN greatest(0.0, {x}) BETWEEN 0 AND 50 THEN 'Good' WHEN {x} BETWEEN 51 AND 100 THEN 'Satisfactory' WHEN {x} BETWEEN 101 AND 200 THEN 'Moderate' WHEN {x} BETWEEN 201 AND 300 THEN 'Poor' WHEN {x} BETWEEN 301 AND 400 THEN 'Very Poor' ELSE 'Severe' END"


def clip(x: str, low: float, high: float) -> str:
    """An SQL expression within bounds, null staying null."""
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({low}, least({high}, {x})) END)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    """Distance in km."""
    return f"(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    """Bearing from the first to the second point."""
    return f"((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0) % 360.0)"


def compass(x: str) -> str:
    """Compass point."""
    return "list_value(" + ", ".join(f"'{p}'" for p in geo.COMPASS) + f")[1 + CAST(floor((({x}) % 360.0 + 11.25) / 22.5) AS INT) % 16]"


def region(lat: str, lon: str) -> str:
    """Fire region."""
    return "CASE " + " ".join(f"WHEN {lat} BETWEEN {s} AND {n} AND {lon} BETWEEN {w} AND {e} THEN '{name}'" for name, (s, n, w, e) in geo.REGIONS.items()) + " ELSE 'Other' END"


def daytime(h: str) -> str:
    """Daytime weight by hour."""
    x = f"(CASE WHEN {h} = 0 THEN 12 ELSE {h} END)"
    return f"(CASE WHEN {x} BETWEEN 7 AND 18 THEN greatest(0.0, least(1.0, cos(2 * pi() * ({x} - 13) / 22.0))) ELSE 0.0 END)"
