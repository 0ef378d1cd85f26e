"""Joins in time: equal hours, full history, as-of before and nearest, and outcomes against forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.operators.nearest import nearest_in_degrees
from zephyrlake.operators.series import micros


def aligned(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_wx") -> DataFrame:
    """Left equi join; right columns of a name that the left has get the suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), keys, "left")


def full_history(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer equi join: every instant of either side."""
    return left.join(right, keys, "full")


def sides(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Both sides as one series: __held is a right row's time and columns, __side 1 for left rows, and __month cuts a key's history into parts."""
    held = F.struct(F.col(ts).alias("t"), *[F.col(c) for c in columns])
    a = left.withColumn("__held", F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType)).withColumn("__side", F.lit(1))
    b = right.select(*keys, F.col(ts), held.alias("__held"), F.lit(0).alias("__side"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("__month", F.year(ts) * 12 + F.month(ts))


def whole(keys: list[str]) -> Column:
    """Whether no key is null: a null key matches nothing."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def carried(rows: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], later: bool = False) -> DataFrame:
    """keys, __month, __from: the last right row of all months before each month of the series (later: the first one of all behind it).

    One row per key and month goes into the window, whatever the rows.
    """
    held = F.struct(F.col(ts).alias("t"), *[F.col(c) for c in columns])
    edge = (F.min_by if later else F.max_by)(held, F.col(ts))
    months = right.where(F.col(ts).isNotNull()).groupBy(*keys, (F.year(ts) * 12 + F.month(ts)).alias("__month")).agg(edge.alias("__edge"))
    parts = rows.select(*keys, "__month").distinct().join(months, [*keys, "__month"], "left")
    order = F.desc("__month") if later else F.asc("__month")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "__month", F.last("__edge", True).over(w).alias("__from"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], right_ts: str = "matched_ts") -> DataFrame:
    """Each left row with the columns of the latest right row at or before it, and that row's time.

    Both sides are one series in which the last right row is carried on: no range join. A key's history is cut by
    month, so that no task holds a whole one; what the months before a month end with is joined to it, one row each.
    """
    rows = sides(left, right, keys, ts, columns)
    before = carried(rows, right, keys, ts, columns)
    w = Window.partitionBy(*keys, "__month").orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__last", F.last("__held", True).over(w)).where("__side = 1").join(before, [*keys, "__month"], "left")
    rows = rows.withColumn("__m", F.when(whole(keys), F.coalesce("__last", "__from")))
    return rows.select(*left.columns, F.col("__m.t").alias(right_ts), *[F.col(f"__m.{c}").alias(c) for c in columns])


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], tolerance_hours: float = 2.0, right_ts: str = "matched_ts") -> DataFrame:
    """Each left row with the nearest right row in time within a tolerance, the earlier one of two as near; null if there is none.

    Cut by month as ``asof_backward`` is, in both directions.
    """
    rows = sides(left, right, keys, ts, columns)
    before = carried(rows, right, keys, ts, columns)
    after = carried(rows, right, keys, ts, columns, True).withColumnRenamed("__from", "__to")
    # The next right row is the last one in the descending order: frames up to the end would be worked out anew for each row.
    up, down = (Window.partitionBy(*keys, "__month").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in ([F.asc(ts), F.asc("__side")], [F.desc(ts), F.desc("__side")]))
    rows = rows.withColumns({"__a": F.last("__held", True).over(up), "__b": F.last("__held", True).over(down)}).where("__side = 1")
    rows = rows.join(before, [*keys, "__month"], "left").join(after, [*keys, "__month"], "left")
    rows = rows.withColumns({"__a": F.coalesce("__a", "__from"), "__b": F.coalesce("__b", "__to")})
    da, db = micros(ts) - micros(F.col("__a.t")), micros(F.col("__b.t")) - micros(ts)
    best = F.when(F.coalesce(da <= db, db.isNull()), F.col("__a")).otherwise(F.col("__b"))
    gap = F.abs(micros(best["t"]) - micros(ts))
    rows = rows.withColumn("__m", F.when(whole(keys) & (gap <= tolerance_hours * 3_600_000_000), best))
    return rows.select(*left.columns, F.col("__m.t").alias(right_ts), *[F.col(f"__m.{c}").alias(c) for c in columns])


def forecast_outcomes(forecasts: DataFrame, observed: DataFrame, keys: list[str], hour: str, predicted: str, actual: str) -> DataFrame:
    """Forecasts beside what was observed at their hour, and the difference."""
    return forecasts.join(observed.select(*keys, hour, actual), [*keys, hour], "left").withColumn("delta", F.col(actual) - F.col(predicted))


def nearest_of(points: DataFrame, stations: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point with its nearest station in squared degrees (ties: least station); any number of either."""
    return nearest_in_degrees(points, stations, lat, lon).select(*points.columns, "station")
