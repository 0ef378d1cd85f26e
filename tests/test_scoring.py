"""Heuristics, contracts, names and the last steps before training, against worked values."""

import math

import pytest
from pyspark.sql import functions as F

from zephyrlake.operators import scoring, training


def test_heuristics_take_constants_only_for_gaps(spark):
    rows = [(1, 24, None, None, None, None, None), (2, 100, 100.0, 1.0, 200.0, 30.0, 0.0), (3, 1, float("nan"), 0.0, 500.0, 20.0, 80.0)]
    df = spark.createDataFrame(rows, "id int, horizon int, pm25_lag1 double, wind_speed double, pbl_height double, temperature double, pm10_lag1 double")
    got = {x.id: x for x in scoring.predicted(df, {}).collect()}
    assert got[1].pm25_pred == pytest.approx(50 * (1 - 0.006 * 24)) and got[1].pm10_pred == pytest.approx(got[1].pm25_pred * 1.9 * (1 - 0.096))
    assert got[1].o3_pred == pytest.approx(45 * 1.075 * 0.952) and got[1].no2_pred == pytest.approx(48 / 1.25) and got[1].so2_pred == pytest.approx(15 / 1.06) and got[1].co_pred == pytest.approx(1.4 / 1.2)
    assert got[1].invented_inputs == list(scoring.HEURISTIC_INPUTS) and got[1].heuristic_pollutants == list(scoring.POLLUTANTS)
    assert got[2].pm25_pred == pytest.approx(100 * 0.55 * 1.04 * 1.175) and got[2].pm10_pred == pytest.approx(got[2].pm25_pred * 1.5)
    assert got[3].pm25_pred == pytest.approx(50 * 0.994 * 1.08) and "wind_speed" not in got[3].invented_inputs and "pm25_lag1" in got[3].invented_inputs
    assert got[2].dominant == "pm25" and got[2].category == "Moderate"  # 67 lies between 61 and 90


def test_models_answer_where_they_can(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -3.0), (3, float("nan")), (4, float("inf")), (5, None)], "id int, m double").withColumn("horizon", F.lit(1))
    got = {x.id: x for x in scoring.predicted(df, {p: F.col("m") for p in scoring.POLLUTANTS}).collect()}
    assert got[1].pm25_pred == 5 and got[1].heuristic_pollutants == [] and got[1].invented_inputs == []
    assert got[2].co_pred == 0 and all(len(got[i].heuristic_pollutants) == 6 for i in (3, 4, 5))
    held = scoring.predicted(df, {"pm25": F.col("m")}, satisfied=F.col("id") > 1).where("id = 1").first()
    assert held.heuristic_pollutants[0] == "pm25" and held.pm25_pred != 5


def test_contracts(spark):
    df = spark.createDataFrame([(1, 28.6, 0.0, None), (2, None, None, 1.0), (3, float("nan"), 1.0, 1.0)], "id int, latitude double, mean_frp double, wind double")
    got = {x.id: x.contract for x in scoring.with_contract(df, ["wind", "mean_frp", "latitude", "max_bright", "longitude"]).collect()}
    assert (got[1].declared_features, got[1].missing_required, got[1].imputed, got[1].satisfied) == (5, ["longitude"], ["max_bright"], False)
    assert got[2].missing_required == ["latitude", "longitude"] and got[2].imputed == ["max_bright", "mean_frp"] and got[3].reason.endswith("latitude, longitude")
    assert scoring.with_contract(df, ["latitude"]).where("contract.satisfied").count() == 1
    none = scoring.with_contract(df, None).first().contract
    assert not none.satisfied and none.declared_features is None


def test_look_ahead_keeps_to_its_tolerance(spark):
    at = lambda h: f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, {h}, 0)"
    weather = spark.range(1, 4).select(F.lit("A").alias("station"), F.expr(at("cast(id as int)")).alias("ts"), F.lit(1.0).alias("wind_speed"), F.when(F.col("id") == 2, 0.0).otherwise(45.0).alias("wind_direction"), F.lit(100.0).alias("pbl_height"), F.lit(30.0).alias("temperature"), F.lit(50.0).alias("humidity"))
    now = spark.range(1).select(F.lit("A").alias("station"), F.expr(at(0)).alias("now"), F.lit(200.0).alias("pm25"), F.lit(None).cast("double").alias("no2"), F.lit(270.0).alias("wind_direction"))
    got = {x.horizon: x for x in scoring.look_ahead(now, weather).collect()}
    assert sorted(got) == list(range(1, 73)) and sorted(h for h in got if got[h].weather_ts) == [1, 2, 3, 4, 5]
    assert got[2].wind_direction == 270.0 and got[1].wind_direction == 45.0 and got[9].wind_direction == 270.0
    assert (got[1].inversion_category, got[1].data_quality, got[1].coupling_domains) == ("strong", "PARTIAL", "aerosol+atmospheric+feedback+fire+ozone")
    assert (got[9].coupling_state, got[9].coupling_domains, got[9].data_quality, got[9].dispersion_potential) == ("NONE", "none", "UNAVAILABLE", None)


def test_columns_names_and_demo_rows(spark):
    df = spark.createDataFrame([(1.0, None, 7, "a", float("nan")), (2.0, None, 7, "b", float("nan"))], "x double, none double, same int, station string, nan double")
    assert training.selected_columns(df, ["x", "none", "same", "station", "gone", "nan"], ("station",)) == (["x"], {"station": "in drop set", "gone": "not in dataset", "none": "all NaN", "same": "constant (nunique=1)", "nan": "all NaN"})
    assert training.numeric_columns(df) == ["x", "none", "same", "nan"] and training.selected_columns(df, []) == ([], {})
    names = spark.createDataFrame([(" R K Puram ",), ("Sector 62, Noida - UPPCB",), ("Anand Vihar, Delhi - DPCC",), ("A - IMD, B - CPCB",), (None,)], "n string")
    got = [tuple(x) for x in names.select(training.canonical_station(F.col("n")), training.station_of_file(F.col("n"))).collect()]
    assert got == [("RK Puram", "R K Puram"), ("Sector 62, Noida - UPPCB", "Noida Sector-62"), ("Anand Vihar, Delhi - DPCC", "Anand Vihar"), ("A - IMD, B - CPCB", "A"), (None, None)]
    rows = spark.createDataFrame([(True, "cpcb"), (None, "Demo_proxy"), (False, None), (None, "a demo"), (False, "SYNTHETIC")], "r boolean, s string")
    assert [x[0] for x in rows.select(training.demo_row(F.col("r"), F.col("s"))).collect()] == [True, True, False, False, True]


def test_standardised_and_evolved(spark):
    df = spark.createDataFrame([("A", 1, "train", None), ("A", 2, "train", 2.0), ("A", 3, "train", None), ("B", 1, "train", 8.0), ("B", 2, "test", None), ("C", 1, "test", None)], "k string, t int, split string, x double")
    stats = training.train_stats(df, ["k"], "t", ["x"])
    assert tuple(stats.first())[1:] == (3, 4.0, math.sqrt(8), 2.0)
    got = {(x.k, x.t): x.x * math.sqrt(8) + 4 for x in training.standardised(df, stats, ["k"], "t", ["x"]).collect()}
    assert got == pytest.approx({("A", 1): 2, ("A", 2): 2, ("A", 3): 2, ("B", 1): 8, ("B", 2): 8, ("C", 1): 2})
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n"), (None, 1, "n")], "k int, id int, v string")
    new = spark.createDataFrame([(1, 2, 9.5), (2, 4, 1.5)], "k int, id int, w double")
    rows = sorted(map(tuple, training.evolved(old, new, ["k"], "id").collect()), key=repr)
    assert rows == sorted([(1, 2, None, 9.5), (2, 5, "b", None), (None, 1, "n", None), (None, 1, "n", None)], key=repr)
    with pytest.raises(ValueError, match="column v"):
        training.evolved(old, old.withColumn("v", F.lit(1)), ["k"], "id")


def test_newest_run_looks_at_few_rows(spark):
    rows = [("A", 10, h) for h in range(30)] + [("B", 9, 1)] + [("B", d, h) for d in range(1, 9) for h in range(4)]
    got = training.newest_run(spark.createDataFrame(rows, "k string, created int, h int"), ["k"], "created", ["h"]).collect()
    assert sorted(x.h for x in got if x.k == "A") == list(range(24))
    assert len([x for x in got if x.k == "B"]) == 24 and min(x.created for x in got if x.k == "B") == 3
