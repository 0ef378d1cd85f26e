"""Mixed headers, nearest neighbours against all pairs, profiles and look-backs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from zephyrlake.operators import fire, nearest, profile, training
from zephyrlake.sources import files


def put(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


# ---- files


def test_two_dialects_and_a_reordered_file(spark, tmp_path):
    put(tmp_path / "in", "a_pollution.csv", "# placeholder\n\ntimestamp,station,pm25,no2\n2024-01-01 00:00:00,A,10,1\n2024-01-01 01:00:00,A,1200,2\n")
    put(tmp_path / "in", "b_pollution.csv", "From Date,To Date,PM2.5,station,AQI\n01-01-2024 00:00,01-01-2024 01:00,20,B,7\nbad,01-01-2024 01:00,20,B,7\n")
    put(tmp_path / "in", "c_pollution.csv", "no2,pm25,station,timestamp\n5,30,C,2024-01-01T00:00:00+05:30\n# 9,9,C,2024-01-01T00:00:00\n5,31,C,2024-01-01T00:00:00+05:30\n")
    put(tmp_path / "in", "d_pollution.csv", "# nothing but a comment\n")
    got = {(x.station, str(x.timestamp)): x for x in files.pollution(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {("A", "2024-01-01 00:00:00"), ("A", "2024-01-01 01:00:00"), ("B", "2024-01-01 00:00:00"), ("C", "2023-12-31 18:30:00")}
    assert [(got[k].pm25, got[k].no2) for k in sorted(got)] == [(10.0, 1.0), (1000.0, 2.0), (20.0, None), (31.0, 5.0)]
    assert got["A", "2024-01-01 01:00:00"].range_flags == "pm25_oor" and got["B", "2024-01-01 00:00:00"].aqi == 7.0
    assert len(files.headers(spark, str(tmp_path / "in"))) == 3


def test_unknown_headers_are_refused(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "timestamp,station,pm25\n2024-01-01 00:00:00,A,10\n")
    put(tmp_path / "in", "b.csv", "when,where,what\n2024-01-01 00:00:00,A,10\n")
    with pytest.raises(ValueError, match="b.csv.*when,where,what"):
        files.pollution(spark, str(tmp_path / "in"))
    assert files.pollution(spark, str(tmp_path / "in"), unknown="skip").count() == 1
    put(tmp_path / "other", "b.csv", "when,where,what\n1,2,3\n")
    with pytest.raises(ValueError, match="no file with a known header"):
        files.pollution(spark, str(tmp_path / "other"), unknown="skip")


def test_speeds_go_by_the_median_of_their_file(spark, tmp_path):
    put(tmp_path / "in", "a_weather.csv", "time,station,wind_speed_10m,temperature_2m\n" + "".join(f"2024-01-01 {h:02}:00:00,A,{36 + h % 2 * 36},5\n" for h in range(10)))
    put(tmp_path / "in", "b_weather.csv", "temperature_2m,time,station,wind_speed_10m\n" + "".join(f"61,2024-01-01 {h:02}:00:00,B,{h}\n" for h in range(10)))
    got = {(x.station, x.timestamp.hour): x for x in files.weather(spark, str(tmp_path / "in")).collect()}
    assert got["A", 0].wind_speed == 10 and got["A", 1].wind_speed == 20 and got["B", 9].wind_speed == 9
    assert got["B", 0].temperature == 60 and got["B", 0].range_flags == "temperature_oor"


def test_boundary_layers_by_station_and_by_grid(spark, tmp_path):
    places = spark.createDataFrame([("A", 28.0, 77.0), ("B", 29.0, 78.0)], "station string, slat double, slon double")
    put(tmp_path / "in", "a_atmosphere.csv", "time,station,boundary_layer_height\n" + "".join(f"2024-01-01 {h:02}:00:00,A,{v}\n" for h, v in enumerate([100, 9000, 300, "", -1])) + "2024-01-01 00:00:00,X,5\n")
    put(tmp_path / "in", "b_atmosphere.csv", "latitude,longitude,datetime,pbl_height\n28.9,77.9,2024-01-01 00:00:00,500\n28.9,77.9,2024-01-01 00:00:00,600\n")
    rows = sorted(files.atmosphere(spark, str(tmp_path / "in"), places).collect(), key=lambda x: (x.station, x.timestamp))
    assert [(x.station, x.pbl_height) for x in rows] == [("A", 100.0), ("A", 200.0), ("A", 300.0), ("A", 300.0), ("A", 300.0), ("B", 600.0), ("X", 5.0)]
    assert (rows[0].lat, rows[-2].lat, rows[-1].lat) == (28.0, 28.9, None)


# ---- nearest


def test_nearest_equals_all_pairs(spark):
    r = random.Random(3)
    spots = [(r.choice([0, 40, -75]) + r.random() ** 4 * 30, r.choice([-170, 10, 10.5]) + r.random() ** 4 * 60) for _ in range(60)]
    sites = [(i, *spots[i]) for i in range(60)] + [(100, *spots[7]), (101, None, 3.0), (102, float("nan"), 3.0)]
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(1000 + i, *spots[i]) for i in range(20)] + [(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, 1.0, 1.0), (2002, 1.0, 1.0)]
    p = spark.createDataFrame(points, "id int, lat double, lon double")
    s = spark.createDataFrame(sites, "station int, slat double, slon double")
    good = [x for x in sites if x[1] is not None and x[1] == x[1]]
    got = nearest.nearest_in_degrees(p, s).collect()
    assert len(got) == len(points)
    for x in got:
        if x.lat is None or x.lat != x.lat:
            assert x.station is None and x.distance is None
        else:
            assert (x.distance, x.station) == min(((x.lat - a) * (x.lat - a) + (x.lon - o) * (x.lon - o), i) for i, a, o in good)

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    for x in nearest.nearest_in_km(p, s, ["station"]).where("lat is not null and not isnan(lat)").collect():
        best = min(km(x.lat, x.lon, a, o) for _, a, o in good)
        assert abs(x.distance - best) < 1e-6 and abs(km(x.lat, x.lon, *next(y[1:] for y in good if y[0] == x.station)) - best) < 1e-6
    assert nearest.nearest_in_degrees(p, s.limit(0)).where("station is null").count() == len(points)
    assert nearest.nearest_in_degrees(p.limit(0), s).count() == 0


def test_nearest_within_keys_and_its_plan(spark):
    r = random.Random(5)
    fires = [(h, r.uniform(20, 35), r.uniform(70, 85), 1.0) for h in range(12) for _ in range(r.randrange(4))]
    f = spark.createDataFrame(fires, "h int, lat double, lon double, frp double").withColumn("acq", F.expr("TIMESTAMP_NTZ '2024-01-01 00:10:00' + make_dt_interval(0, h, 0)"))
    stations = spark.createDataFrame([(0, 28.6, 77.2), (1, 60.0, 10.0)], "station int, slat double, slon double")
    panel = stations.select("station").crossJoin(spark.range(12).select(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int), 0)").alias("hour")))
    out = fire.same_hour_fires(panel, f, stations)
    assert out.count() == 24
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "hour" in line and "station" not in line and "cell" not in line and "near" not in line and "slat" not in line]
    for x in out.collect():
        own = [y for y in fires if y[0] == x.hour.hour]
        assert (x.nearest_fire_distance is None) == (not own)
        assert x.station == 0 or x.fire_count == 0


def test_stations_without_readings_take_their_neighbours(spark):
    ts = "TIMESTAMP_NTZ '2024-01-03 00:00:00' - make_dt_interval(0, cast(id as int), 0)"
    readings = spark.range(30).select(F.lit("A").alias("station"), F.expr(ts).alias("ts"), F.col("id").cast("double").alias("pm25")).unionByName(spark.range(1).select(F.lit("C").alias("station"), F.expr("TIMESTAMP_NTZ '2023-01-01 00:00:00'").alias("ts"), F.lit(9.0).alias("pm25")))
    places = spark.createDataFrame([("A", 28.0, 77.0), ("B", 28.1, 77.0), ("C", 60.0, 10.0), ("D", None, None)], "station string, slat double, slon double")
    got = nearest.filled_from_neighbours(readings, places, "ts", F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'")).collect()
    assert {x.station for x in got} == {"B", "C"} and len(got) == 48
    assert {(x.pm25, x.copied_from, x.data_source) for x in got} == {(0.0, "A", "demo_proxy")}


# ---- profiles


def heights(spark, levels):
    df = spark.createDataFrame([(levels,)], "levels array<struct<p:double,t:double,h:double>>")
    return {x.p: x.z for x in df.select(profile.layer_heights(F.col("levels")).alias("z")).first().z}


def test_heights_walk_up_and_are_anchored(spark):
    rise = lambda a, b, p, q: 287.05 / 9.80665 * ((a + b) / 2 + 273.15) * math.log(p / q)
    got = heights(spark, [(1000.0, 20.0, None), (925.0, 15.0, None), (850.0, 10.0, None), (700.0, 0.0, None)])
    assert got[1000.0] == 0 and abs(got[925.0] - rise(20, 15, 1000, 925)) < 1e-9 and abs(got[700.0] - got[850.0] - rise(10, 0, 850, 700)) < 1e-9
    got = heights(spark, [(1000.0, 20.0, None), (925.0, 15.0, 800.0), (850.0, None, 1500.0), (700.0, 0.0, None)])
    assert got[925.0] == 800 and got[850.0] == 1500 and abs(got[700.0] - 800 - rise(15, 0, 925, 700)) < 1e-9
    assert list(got) == [1000.0, 925.0, 850.0, 700.0]
    assert heights(spark, [(1000.0, None, None), (925.0, 15.0, None), (850.0, None, 1500.0), (700.0, None, None)]) == {850.0: 1500.0}
    assert heights(spark, []) == {}


def test_payloads_and_inversions(spark):
    hourly = {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_1000hPa": [12.0, 20.0], "temperature_925hPa": [10.0, None], "temperature_850hPa": [14.0], "temperature_700hPa": [8.0, None]}
    rows = [(1, json.dumps({"hourly": hourly})), (2, json.dumps({"hourly": {"time": ["2024-01-01T00:00"], "temperature_1000hPa": [1.0]}})), (3, "not json"), (4, None)]
    df = profile.from_payload(spark.createDataFrame(rows, "id int, payload string"), "payload")
    x, y = (r.x for r in df.orderBy("ts").select(profile.layer_inversion(F.col("levels"), profile.layer_heights(F.col("levels")), F.lit(250.0)).alias("x")).collect())
    assert df.count() == 2 and str(df.agg(F.max("ts")).first()[0]) == "2024-01-01 01:00:00"
    assert (x.detected, x.category, x.base_pressure, x.top_pressure, x.gradient, x.source, x.thickness_hpa) == (True, "strong", 925.0, 850.0, 5.3333, "lapse_rate", 75.0)
    assert abs(x.thickness_m - (x.top_height_m - x.base_height_m)) < 0.11 and x.strength == 1.0
    assert (y.detected, y.category, y.strength, y.source, y.base_height_m) == (True, "moderate", 0.5, "pbl_proxy", None)


# ---- look-back


def test_each_station_looks_back_as_far_as_it_must(spark):
    days = {"dense": range(20), "sparse": [0, 15, 20, 25, 29], "thin": [0, 50, 100, 119], "poor": [0, 1], "edge": [0, 10, 10, 10]}
    rows = [(s, d) for s, own in days.items() for d in own]
    df = spark.createDataFrame(rows, "station string, d int").select("station", F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00' - make_dt_interval(d)").alias("ts"), "d")
    spans = training.lookback_spans(df, ["station"], "ts")
    got = {x.station: (x.rows_10, x.rows_30, x.rows_120, x.span_days) for x in spans.collect()}
    assert got == {"dense": (11, 20, 20, 10), "sparse": (1, 5, 5, 30), "thin": (1, 1, 4, 120), "poor": (2, 2, 2, None), "edge": (4, 4, 4, 10)}
    kept = {x.station: x["count"] for x in training.lookback_rows(df, spans, ["station"], "ts").groupBy("station").count().collect()}
    assert kept == {"dense": 11, "sparse": 5, "thin": 4, "edge": 4}
