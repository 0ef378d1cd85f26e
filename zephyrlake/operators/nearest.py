"""Exact nearest neighbours by cells that widen only where nothing is near.

Both sides lie on grids of cells whose width doubles from level to level. A place meets only the sites of the block
of cells around its own, and the level is chosen so that this block is sure to hold the nearest one: if the block of
some level has a site at all, that site is at most two cell diagonals away, and two levels up a block reaches that
far on every side. Levels are found on distinct cells, not on rows, and both steps are joins on equal cells; no pair
of a place and a site beyond its block is ever made. Sites of one place count once, and where many places share a
cell the finest cells are made finer, so that a block holds a bounded number of sites however dense they lie.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions import geo
from zephyrlake.functions.basic import slots

#: Every second level is probed.
STEP = 2
#: How often the finest cells may be halved, and how many places may share one on average, as a place sees it.
HALVINGS, CROWD = (0, 2, 4, 6, 8), 8


def on_sphere(lat: str, lon: str) -> list[Column]:
    """A place on the unit sphere; the straight distance grows with that along the surface."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def blocks(cell: Column, dims: int) -> Column:
    """The cells of the block around a cell."""
    return F.array(*[F.array(*[cell[i] + d for i, d in enumerate(shift)]) for shift in product((-1, 0, 1), repeat=dims)])


def halvings(sites: DataFrame, keys: list[str], at: list[Column], cell: float) -> int:
    """How often cells are to be halved until few sites share one: one pass over the sites, of which a row for each width is read."""
    cells = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.floor(x.cast("double") * 2.0**n / cell) for x in at]).alias("c")) for n in HALVINGS])
    held = sites.select(*keys, F.explode(cells).alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).cast("double").alias("k"))
    shared = held.groupBy("x.n").agg((F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("crowd")).collect()
    return min((x.n for x in shared if x.crowd <= CROWD), default=HALVINGS[-1] if shared else 0)


def nearest(points: DataFrame, sites: DataFrame, place: list[str], site: list[str], place_at: list[Column], site_at: list[Column], distance: Column, found: list[str], keys: list[str] | None = None, cell: float = 0.25, levels: int = 12) -> DataFrame:
    """Points with the columns ``found`` of their nearest site and distance; ties go to the least values of ``found``.

    place and site: the columns that a position of either side depends on, each of which is worked out once; place_at and
    site_at: coordinates of both sides, in which straight distances order sites as ``distance`` (an expression over
    these columns) does. keys: columns that have to be equal, such as the hour. cell: width of the finest cells, which are
    halved where sites lie dense; the widest, 2**levels of it, must span all coordinates. Points without a position, or without any site of
    their keys, get nulls; so do positions that aren't finite. Sites without a position take no part.
    """
    keys, dims = keys or [], len(place_at)
    usable = lambda at: [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in at]
    wider = lambda level: F.transform("__cell", lambda x: F.floor(x / F.pow(F.lit(2.0), F.col(level))))

    def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
        for c in conditions:
            df = df.where(c)
        return df

    there = where_all(sites, usable(site_at)).groupBy(*keys, *site).agg(F.min(F.struct(F.lit(0).alias("__x"), *[F.col(c) for c in found])).alias("__found"))
    finer = halvings(there, keys, site_at, cell)
    levels += finer
    whole = lambda at: F.array(*[F.floor(x.cast("double") * 2.0**finer / cell) for x in at])
    at = where_all(points, usable(place_at)).select(*keys, *place, whole(place_at).alias("__cell")).distinct()
    there = there.withColumn("__cell", whole(site_at))
    probed = range(0, levels + 1, STEP)
    at_levels = lambda df, ks: df.withColumn("level", F.explode(F.array(*[F.lit(k) for k in ks])))
    held = at_levels(there.select(*keys, "__cell").distinct(), probed).select(*keys, "level", wider("level").alias("near")).distinct()
    homes = at_levels(at.select(*keys, "__cell").distinct(), probed).withColumn("near", wider("level"))
    asked = homes.select(*keys, "__cell", "level", F.explode(blocks(F.col("near"), dims)).alias("near"))
    # Exploded sides count as their source in Spark's sizes: without the hints they may be broadcast.
    level = asked.hint("merge").join(held.hint("merge"), [*keys, "level", "near"]).groupBy(*keys, "__cell").agg(F.least(F.min("level") + STEP, F.lit(levels)).alias("__level"))
    searching = at.join(level, [*keys, "__cell"]).withColumn("__own", wider("__level"))
    searching = searching.withColumn("__near", F.explode(blocks(F.col("__own"), dims))).drop("__own", "__cell")
    reached = sorted({min(k + STEP, levels) for k in probed})
    offered = there.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in reached])))
    offered = offered.withColumn("__near", wider("__level")).drop("__cell")
    met = searching.hint("merge").join(offered.hint("merge"), [*keys, "__level", "__near"])
    best = met.groupBy(*keys, *place).agg(F.min(F.struct(distance.alias("distance"), *[F.col(f"__found.{c}").alias(c) for c in found])).alias("__best"))
    out = points.join(best, [*keys, *place], "left")
    return out.select(*points.columns, *[F.col(f"__best.{c}").alias(c) for c in found], F.col("__best.distance").alias("distance"))


def nearest_in_degrees(points: DataFrame, stations: DataFrame, lat: str = "lat", lon: str = "lon", keys: list[str] | None = None) -> DataFrame:
    """Points with station and distance (squared degrees) of the nearest of stations (station, slat, slon), ties to the least station."""
    d = (F.col(lat) - F.col("slat")) * (F.col(lat) - F.col("slat")) + (F.col(lon) - F.col("slon")) * (F.col(lon) - F.col("slon"))
    return nearest(points, stations, [lat, lon], ["slat", "slon"], [F.col(lat), F.col(lon)], [F.col("slat"), F.col("slon")], d, ["station"], keys)


def nearest_in_km(points: DataFrame, sites: DataFrame, found: list[str], lat: str = "lat", lon: str = "lon", site_lat: str = "slat", site_lon: str = "slon", keys: list[str] | None = None) -> DataFrame:
    """Points with the columns ``found`` of the nearest site on the earth, and distance in km."""
    km = geo.haversine(F.col(lat), F.col(lon), F.col(site_lat), F.col(site_lon))
    return nearest(points, sites, [lat, lon], [site_lat, site_lon], on_sphere(lat, lon), on_sphere(site_lat, site_lon), km, found, keys, cell=0.001)


def filled_from_neighbours(readings: DataFrame, stations: DataFrame, ts: str, until: Column, hours: int = 24, source: str = "demo_proxy") -> DataFrame:
    """Readings for the hourly slots up to ``until`` of stations that have none within these hours: copies of the latest reading of the nearest station that has some.

    stations: (station, slat, slon). Rows say data_source and copied_from; slots that a station has already stay as
    they are, and stations with recent readings get none.
    """
    hour = lambda x: F.date_trunc("hour", x).cast("timestamp_ntz")
    recent = readings.where(F.col(ts) >= until - F.expr(f"INTERVAL {hours} HOURS"))
    has = recent.select("station").distinct()
    values = [c for c in readings.columns if c not in ("station", ts)]
    latest = readings.join(has, "station", "left_semi").groupBy("station").agg(F.max(F.struct(ts, *values)).alias("__r"))
    sources = stations.join(has, "station").select(F.col("station").alias("copied_from"), "slat", "slon")
    lacking = stations.join(has, "station", "left_anti").select("station", F.col("slat").alias("lat"), F.col("slon").alias("lon"))
    near = nearest_in_km(lacking, sources, ["copied_from"]).where("copied_from is not null")
    rows = near.join(latest.withColumnRenamed("station", "copied_from"), "copied_from").select("station", "copied_from", F.explode(slots(hour(until), hours)).alias(ts), *[F.col(f"__r.{c}").alias(c) for c in values])
    taken = readings.select("station", hour(F.col(ts)).alias(ts))
    return rows.join(taken, ["station", ts], "left_anti").withColumn("data_source", F.lit(source)).select("station", ts, *values, "copied_from", "data_source")
