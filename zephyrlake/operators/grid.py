"""Surfaces: regular grids, inverse-distance fields, advective blends and regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.functions import aqi
from zephyrlake.functions.basic import clip

#: The served domain (south, west), its cells and step in degrees.
SOUTH, WEST, ROWS, COLS, STEP = 28.2, 76.6, 36, 46, 0.02
BLEND, HOURS = 0.25, 3.0


def grid(spark: SparkSession, rows: int = ROWS, cols: int = COLS, south: float = SOUTH, west: float = WEST, step: float = STEP) -> DataFrame:
    """(i, j, lat, lon) of every cell; the columns of a row are made where the row is."""
    out = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))).alias("j"))
    return out.select("i", "j", (south + F.col("i") * step).alias("lat"), (west + F.col("j") * step).alias("lon"))


def packed(points: DataFrame, most: int = 10_000) -> DataFrame:
    """One row with all points (lat, lon, value) as an array, to lie beside each cell; more than ``most`` are refused."""
    out = points.where("value is not null").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("lat", "lon", "value"))).alias("p"))
    return out.select(F.when(F.col("n") <= most, F.col("p")).otherwise(F.raise_error(F.lit("too many points to hold beside each cell"))).alias("__p"))


def weighted(points: Column, d2: object) -> Column:
    """Sum of values over d2 + 1e-6, by the sum of the same weights."""
    acc = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    step = lambda s, p: F.struct((s["a"] + p["value"] / (d2(p) + 1e-6)).alias("a"), (s["b"] + 1 / (d2(p) + 1e-6)).alias("b"))
    return F.aggregate(points, acc, step, lambda s: s["a"] / F.when(s["b"] > 0, s["b"]))


def idw(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Cells with the inverse-square-distance mean of the points (lat, lon, value); a point within 0.1 m gives its own value."""
    d2 = lambda p: F.pow((p["lat"] - F.col("lat")) * 110.0, 2) + F.pow((p["lon"] - F.col("lon")) * 100.0 * F.cos(F.radians("lat")), 2)
    rows = cells.crossJoin(F.broadcast(packed(points)))  # one row of bounded size
    hit = F.get(F.filter("__p", lambda p: F.sqrt(d2(p)) < 0.0001), F.lit(0))["value"]
    return rows.withColumn("value", F.coalesce(hit, weighted(F.col("__p"), d2))).select(*cells.columns, "value")


def within(cells: DataFrame, points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """keys, i, j, value: the inverse-square-distance mean of the points (keys, record, plat, plon, value) within a radius in degrees of a cell, for cells that have some.

    Points go to the nine squares of that size about their own, so cells meet only points near by; a point that lies
    on a cell gives its own value, the first by record and value if there are several. Points without a value take no part.
    """
    box = lambda x: F.floor(x / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    p = points.where("value is not null").withColumn("__r", F.explode(F.transform(near, lambda d: box(F.col("plat")) + d)))
    p = p.withColumn("__c", F.explode(F.transform(near, lambda d: box(F.col("plon")) + d)))
    d2 = F.pow(F.col("lat") - F.col("plat"), 2) + F.pow(F.col("lon") - F.col("plon"), 2)
    met = cells.withColumns({"__r": box(F.col("lat")), "__c": box(F.col("lon"))}).join(p, ["__r", "__c"]).withColumn("__d2", d2).where(F.col("__d2") <= radius * radius)
    on = F.min(F.when(F.col("__d2") == 0, F.struct("record", "value")))["value"]
    w = 1 / F.when(F.col("__d2") > 0, F.col("__d2"))
    return met.groupBy(*keys, "i", "j").agg(F.coalesce(on, F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def idw_within(cells: DataFrame, points: DataFrame, radius: float = 0.25) -> DataFrame:
    """Cells with the inverse-square-distance mean of the points within a radius in degrees, 0 where there are none.

    Points go to the nine squares of that size about their own, so cells meet only points near by.
    """
    box = lambda x: F.floor(x / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    p = points.where("value is not null").select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "value", F.explode(F.transform(near, lambda d: box(F.col("lat")) + d)).alias("__r"), box(F.col("lon")).alias("__c0"))
    p = p.withColumn("__c", F.explode(F.transform(near, lambda d: F.col("__c0") + d))).drop("__c0")
    d2 = F.pow(F.col("lat") - F.col("plat"), 2) + F.pow(F.col("lon") - F.col("plon"), 2)
    met = cells.withColumns({"__r": box(F.col("lat")), "__c": box(F.col("lon"))}).join(p, ["__r", "__c"]).where(d2 <= radius * radius)
    w = 1 / (d2 + 1e-12)
    out = met.groupBy("i", "j").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))
    return cells.join(out, ["i", "j"], "left").fillna({"value": 0.0})


def advected(field: DataFrame, wind_speed: float, wind_direction: float, rows: int = ROWS, cols: int = COLS, step: float = STEP) -> DataFrame:
    """A field (i, j, lat, lon, value) blended with itself moved downwind; a cell that nothing moves to keeps its value.

    Of several cells that land on one, the last in row order counts.
    """
    if wind_speed <= 1.0:
        return field
    rad = F.radians(F.lit(float(wind_direction)))
    dj = -wind_speed * F.sin(rad) * 3600 * HOURS / (step * 100000.0)
    di = -wind_speed * F.cos(rad) * 3600 * HOURS / (step * 111000.0)
    ti = clip(F.floor(F.col("i") + di).cast("double"), 0, rows - 1).cast("bigint")
    tj = clip(F.floor(F.col("j") + dj).cast("double"), 0, cols - 1).cast("bigint")
    moved = field.groupBy(ti.alias("i"), tj.alias("j")).agg(F.max_by("value", F.col("i") * cols + F.col("j")).alias("moved"))
    out = field.join(moved, ["i", "j"], "left")
    return out.select("i", "j", "lat", "lon", F.coalesce((1 - BLEND) * F.col("value") + BLEND * F.col("moved"), F.col("value")).alias("value"))


def cells_out(field: DataFrame) -> DataFrame:
    """lat, lon, aqi and category of every cell with a value."""
    value = F.bround("value", 0).cast("int")
    return field.where("value is not null").select(F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"), value.alias("aqi"), aqi.category(value).alias("category"))
