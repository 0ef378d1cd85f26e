"""Joins of exploded tables, whose sizes Spark doesn't know, are not broadcast."""

from pyspark.sql import functions as F

from zephyrlake.operators import fire


def test_exploded_sides_are_not_broadcast(spark):
    """Sizes of exploded tables are unknown to Spark; the joins that take them may not broadcast."""
    panel = spark.range(40).select((F.col("id") % 5).cast("int").alias("station"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 8 as int))").alias("hour"))
    fires = spark.range(300).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 37 % 480 as int))").alias("acq"), (27.5 + F.col("id") % 50 / 10.0).alias("lat"), (73.5 + F.col("id") % 40 / 10.0).alias("lon"), F.lit(1.0).alias("frp"))
    stations = spark.createDataFrame([(k, 28.5 + k / 10, 77.0) for k in range(5)], "station int, slat double, slon double")
    out = fire.same_hour_fires(panel, fires, stations)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Join Inner" in line and "__near" in line and "strategy=merge" in line]) == 1
    assert len([line for line in plan.splitlines() if "Join Inner" in line and "strategy=merge" in line]) >= 3
    got = {(x.station, x.hour): (x.fire_count, x.total_frp) for x in out.collect()}
    assert len(got) == 40 and sum(n for n, _ in got.values()) == sum(t for _, t in got.values()) > 0
