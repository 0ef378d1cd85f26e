"""Fires of one crowded cell are dealt to parts, and are summed where they meet the stations."""

import decimal

from pyspark.sql import functions as F

from zephyrlake.operators import fire, rules
from zephyrlake.plans import registry


def test_parts_change_no_result(spark):
    fires = spark.range(500).select(F.col("id").alias("fire_id"), (27.5 + F.col("id") % 50 / 10.0).alias("lat"), (73.5 + F.col("id") % 40 / 10.0).alias("lon"), (F.col("id") % 9).cast("double").alias("frp"))
    fires = fires.union(fires.where("fire_id = 7"))
    stations = spark.createDataFrame([(k, 28.5 + k / 10, 77.0, float(k)) for k in range(3)], "station int, slat double, slon double, wind_speed double")
    whole = fire.near_fires(fires, stations, 200.0).withColumn("wind_speed", F.col("station").cast("double"))
    dealt = fire.near_fires(fires, stations, 200.0, carried=("wind_speed",), parts=16)
    key = lambda df: sorted(map(tuple, df.select("station", "wind_speed", "fire_id", "lat", "lon", "frp", "km", "bearing").collect()))
    assert key(whole) == key(dealt) and dealt.count() > 300


def test_no_fire_is_shuffled_by_station(spark):
    """After fires have met the stations nothing joins them again: the next step is their sum by station."""
    plan = registry.queries()["transport_risk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deep = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-"))
    met = next(i for i, line in enumerate(plan) if "Join Inner" in line and "__share" in line)
    above = [plan[i] for i in range(met) if deep(i) < deep(met) and not any(deep(j) <= deep(i) for j in range(i + 1, met))]
    assert "Aggregate [station" in next(line for line in reversed(above) if "Join" in line or "Aggregate" in line)


def test_components_round_by_the_scaled_double(spark):
    """Sums beside a tie: their shortest decimal is above or below it, the scaled double is on it."""
    total = lambda i: 0.5 * (i / 10_000) + 0.25 * (1 - 37.0 / 500.0) + 0.15 * 0.5 + 0.1 * 33.3 / 100.0
    named = lambda x: float(decimal.Decimal(repr(x)).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_EVEN))
    odd = [i for i in range(10_000) if named(total(i)) != round(total(i) * 10_000) / 10_000][:20]
    assert odd
    rows = [(i / 10_000, 37.0, 25, 33.3, 5.0, 500.0, 0.0, None) for i in odd]
    df = spark.createDataFrame(rows, "fire_impact_score double, nearest_fire_distance double, wind_aligned_fire_count long, wind_alignment_pct double, wind_speed double, pbl_height double, inversion double, pm25 double")
    got = {x.fire_impact_score: x.fire_component for x in rules.transport_risk(df).collect()}
    assert got == {i / 10_000: round(total(i) * 10_000) / 10_000 for i in odd}
