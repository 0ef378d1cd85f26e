"""Distances, bearings, compass points and wind components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Compass points, and the regions of fire attribution (south, north, west, east), first match wins.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
REGIONS = {"Punjab": (29.5, 32.5, 73.5, 77.0), "Haryana": (27.5, 30.5, 74.5, 77.5), "Rajasthan": (23.0, 30.5, 69.5, 76.5), "UP": (24.0, 30.5, 77.0, 84.5), "Delhi_NCR": (28.0, 29.0, 76.5, 77.5)}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first to the second point, 0 to 360 degrees."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smaller angle between two directions in degrees."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def compass(degrees: Column) -> Column:
    """16-point compass name of a direction."""
    at = F.floor((F.pmod(degrees, F.lit(360.0)) + 11.25) / 22.5).cast("int") % 16
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), at + 1)


def wind_u(speed: Column, degrees: Column) -> Column:
    """Eastward component of a wind that blows from a direction; null counts as calm."""
    return F.coalesce(-speed * F.sin(F.radians(degrees)), F.lit(0.0))


def wind_v(speed: Column, degrees: Column) -> Column:
    """Northward component of a wind that blows from a direction; null counts as calm."""
    return F.coalesce(-speed * F.cos(F.radians(degrees)), F.lit(0.0))


def region(lat: Column, lon: Column) -> Column:
    """First region whose box holds the point, else Other."""
    out = None
    for name, (south, north, west, east) in REGIONS.items():
        inside = lat.between(south, north) & lon.between(west, east)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("Other")


def impact(raw: Column) -> Column:
    """Logistic share of a raw transport weight; 0 for none."""
    return F.when(raw > 0, 1 / (1 + F.exp(-(raw - 1.0)))).otherwise(0.0)
