"""Operators on small hand-made series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrlake.operators import align, clean, evaluate, fire, grid, network, rules, series, upsert
from zephyrlake.sources import files

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_window_means_gate_and_edges(spark):
    rows = [(1, hours(24 - i), "pm25", 10.0) for i in range(5)] + [(1, hours(0), "pm25", 70.0), (1, hours(-1), "pm25", 9999.0), (1, hours(24), "o3", 300.0), (1, hours(20), "o3", 200.0), (2, hours(24), "pm25", 5.0), (1, hours(3), "pm25", -5.0)]
    got = {r.station: r for r in network.window_means(frame(spark, rows, "station int, ts timestamp_ntz, pollutant string, v double")).collect()}
    assert got[1].pm25 == pytest.approx(20.0) and got[1].n_pm25 == 6  # both ends of the window count, the future and negatives don't
    assert got[1].o3 == 250.0 and got[1].o3_last == 300.0
    assert got[2].pm25 is None
    now = {r.station: r for r in network.current_index(frame(spark, rows, "station int, ts timestamp_ntz, pollutant string, v double")).collect()}
    assert now[1].o3 == 300.0 and now[1].basis == "window_mean"  # above the limit the latest reading counts
    assert (now[2].basis, now[2].aqi) == ("instantaneous", 8)


def test_least_readings():
    assert [network.least_readings(h) for h in (24, 8, 1)] == [6, 2, 2]


def test_filling_and_interpolation(spark):
    rows = [(1, hours(i), x) for i, x in enumerate([None, 1.0, None, None, None, None, 6.0, None])] + [(2, hours(0), None)]
    df = frame(spark, rows, "k int, ts timestamp_ntz, v double")
    filled = series.forward_filled(df, ["k"], "ts", ["v"], 3).orderBy("k", "ts").collect()
    assert [r.v for r in filled] == [None, 1, 1, 1, 1, None, 6, 6, None]
    between = series.interpolated(df, ["k"], "ts", "v", 2).orderBy("k", "ts").collect()
    assert [r.v for r in between] == [None, 1, 2, 3, None, None, 6, 6, None]


def test_lags_stay_within_a_key(spark):
    df = frame(spark, [(1, hours(0), 1.0), (1, hours(1), 2.0), (2, hours(0), 9.0)], "k int, ts timestamp_ntz, v double")
    got = {(r.k, r.ts): (r.v_lag1, r.v_mean3) for r in series.trailing_stats(series.lags(df, ["k"], "ts", "v", [1]), ["k"], "ts", "v", [3]).collect()}
    assert got[2, hours(0)] == (None, None) and got[1, hours(1)] == (1.0, 1.0)


def test_runs_break_on_gaps_and_stay_open_at_the_end(spark):
    at = [0, 1, 2, 4, 5, 6]
    df = frame(spark, [(1, hours(h), v) for h, v in zip(at, [9.0, 9.0, 1.0, 9.0, 8.0, 9.0], strict=True)], "k int, ts timestamp_ntz, v double")
    got = series.predicate_runs(df, ["k"], "ts", F.col("v") >= 8, "v").orderBy("start_ts").collect()
    assert [(r.start_ts, r.end_ts, r.n, r.open) for r in got] == [(hours(0), hours(1), 2, False), (hours(4), hours(6), 3, True)]
    assert got[1].peak_ts == hours(4)
    assert [r.run_id for r in series.runs(df, ["k"], "ts", 1.0).orderBy("ts").collect()] == [1, 1, 1, 2, 2, 2]


def test_current_episode(spark):
    rows = [(1, hours(0), True), (1, hours(5), True), (1, hours(6), True), (2, hours(0), True), (2, hours(1), False)]
    got = {r.k: r for r in series.current_episode(frame(spark, rows, "k int, ts timestamp_ntz, d boolean"), ["k"], "ts", "d").collect()}
    assert (got[1].active, got[1].duration_h, got[1].onset_ts) == (True, 1.0, hours(5))
    assert (got[2].active, got[2].duration_h, got[2].onset_ts) == (False, 0.0, None)


def test_split_has_no_overlap(spark):
    df = frame(spark, [(k, hours(h)) for h in range(50) for k in (1, 2)], "k int, ts timestamp_ntz")
    got = series.chronological_split(df, "ts", ["k"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    by = {r.split: r for r in got}
    assert [by[s].n for s in ("train", "validation", "test")] == [60, 20, 20] and by["train"].b < by["validation"].a < by["test"].a


def test_asof_joins(spark):
    left = frame(spark, [(1, hours(0)), (1, hours(5)), (2, hours(1))], "k int, ts timestamp_ntz")
    right = frame(spark, [(1, hours(1), "a"), (1, hours(4), "b"), (1, hours(6), "c")], "k int, ts timestamp_ntz, x string")
    back = {(r.k, r.ts): r.x for r in align.asof_backward(left, right, ["k"], "ts", ["x"]).collect()}
    assert back == {(1, hours(0)): None, (1, hours(5)): "b", (2, hours(1)): None}
    near = {(r.k, r.ts): r.x for r in align.asof_nearest(left, right, ["k"], "ts", ["x"], 1.0).collect()}
    assert near == {(1, hours(0)): "a", (1, hours(5)): "b", (2, hours(1)): None}  # the earlier of two as near


def test_trailing_fires_match_brute_force(spark):
    r = np.random.default_rng(1)
    fires = [(i, float(a), float(b), float(p), hours(float(h))) for i, (a, b, p, h) in enumerate(zip(r.uniform(24, 34, 300), r.uniform(70, 84, 300), r.uniform(-5, 90, 300), r.uniform(-30, 60, 300), strict=True))]
    stations = [(1, 28.6, 77.2), (2, 30.0, 75.0)]
    panel = [(s, hours(h), 3.0, 300.0) for s, _, _ in stations for h in range(0, 48, 7)]
    got = fire.trailing_fires(frame(spark, panel, "station int, ts timestamp_ntz, wind_speed double, wind_direction double"), frame(spark, fires, "fire_id int, lat double, lon double, frp double, acq timestamp_ntz"), frame(spark, stations, "station int, slat double, slon double")).collect()

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(x))

    place = {s: (a, b) for s, a, b in stations}
    assert len(got) == len(panel)
    for row in got:
        near = [km(*place[row.station], f[1], f[2]) for f in fires if row.ts - dt.timedelta(hours=24) <= f[4] <= row.ts]
        near = [d for d in near if d <= 500]
        assert row.fire_count == len(near)
        assert row.nearest_fire_distance == pytest.approx(min(near, default=501), abs=0.006)


def test_clean(spark):
    df = frame(spark, [("s", " 1200.0", "low"), ("t", "5", "HIGH"), ("u", "NA", "odd")], "`Station ` string, `PM2.5` string, confidence string")
    df = clean.normalized_names(df, {"pm2.5": "pm25"})
    assert df.columns == ["station", "pm25", "confidence"]
    assert [r.station for r in clean.confident(df).collect()] == ["t"]
    got = clean.clamped(df.withColumn("pm25", F.col("pm25").try_cast("double")), clean.POLLUTANT_RANGES).collect()
    assert [(r.pm25, r.range_flags) for r in got] == [(1000.0, "pm25_oor"), (5.0, ""), (None, "")]
    times = frame(spark, [("2024-01-05", 1231), ("2024-01-05", 2400), ("2024-01-05", 9999), ("2024-01-05", None), ("x", 10)], "d string, t int").select(clean.acquired_at(F.col("d"), F.col("t")).alias("x")).collect()
    assert [r.x for r in times] == [dt.datetime(2024, 1, 5, 12, 31), dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5), None]


def test_upserts_are_idempotent(spark):
    old = frame(spark, [(1, "a"), (2, "b"), (3, None)], "k int, x string")
    new = frame(spark, [(2, "c"), (3, None), (4, "d")], "k int, x string")
    assert {(r.k, r.action) for r in upsert.actions(old, new, ["k"], ["x"]).collect()} == {(2, "update"), (3, "unchanged"), (4, "insert")}
    once = upsert.merged(old, new, ["k"])
    assert sorted(map(str, once.collect())) == sorted(map(str, upsert.merged(once, new, ["k"]).collect()))
    assert {r.k for r in upsert.unseen(old, new.union(new), ["k"]).collect()} == {4}


def test_events(spark):
    points = [(1, hours(h), 50.0 if h < 3 or h > 40 else 200.0) for h in range(48)] + [(2, hours(h), 20.0) for h in range(5)]
    got = rules.events(frame(spark, points, "station int, ts timestamp_ntz, pm25 double"), frame(spark, [(1, 80.0), (2, 100.0)], "station int, baseline double"), frame(spark, [(1, 1.0, 200.0, True), (2, 1.0, 200.0, False)], "station int, wind_speed double, pbl_height double, inversion boolean")).collect()
    found = {(r.station, r.event_type): r for r in got}
    assert set(found) == {(1, "pollution_surge"), (1, "high_risk_episode"), (2, "pollution_relief")}  # a drop of 80 per cent counts in any air
    assert found[1, "pollution_surge"].severity == "moderate" and found[1, "pollution_surge"].end_ts == hours(40)
    assert found[1, "high_risk_episode"].severity == "emergency"
    assert found[2, "pollution_relief"].end_ts is None and found[2, "pollution_relief"].severity == "significant"


def test_grid(spark):
    cells = grid.grid(spark, 3, 4)
    flat = grid.idw(cells, frame(spark, [(28.21, 76.61, 42.0)], "lat double, lon double, value double")).collect()
    assert len(flat) == 12 and all(r.value == pytest.approx(42.0) for r in flat)
    exact = grid.idw(cells, frame(spark, [(28.2, 76.6, 1.0), (28.24, 76.66, 9.0)], "lat double, lon double, value double"))
    assert {(r.i, r.j): r.value for r in exact.collect()}[0, 0] == 1.0
    far = grid.idw_within(cells, frame(spark, [(40.0, 90.0, 1.0)], "lat double, lon double, value double")).collect()
    assert {r.value for r in far} == {0.0}


def test_errors_and_intervals(spark):
    df = frame(spark, [("a", 10.0, 12.0), ("a", 20.0, 18.0), ("a", None, 1.0), ("b", 5.0, 5.0)], "k string, y double, p double")
    got = {r.k: r for r in evaluate.errors(df, ["k"]).collect()}
    assert (got["a"].n, got["a"].mae, got["a"].rmse, got["a"].r2) == (2, 2.0, 2.0, pytest.approx(0.84)) and got["b"].r2 == 0
    r = np.random.default_rng(2).normal(size=57)
    q = evaluate.conformal_higher(frame(spark, [("a", float(x)) for x in r], "k string, r double"), ["k"]).first()
    assert q.quantile == pytest.approx(np.quantile(np.abs(r), min(1, 58 * 0.85 / 57), method="higher"))


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# note\nStation,Date,PM2.5,CO (mg/m3)\nA,2024-01-01 11:30:00,12,NA\nA,2024-01-01T11:30:00+05:30,2000,1\nA,bad,1,1\nA,2024-01-01 11:30:00,12,NA\n")
    got = {r.timestamp: (r.pm25, r.range_flags) for r in files.pollution(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {dt.datetime(2024, 1, 1, 11, 30): (12.0, ""), dt.datetime(2024, 1, 1, 6, 0): (1000.0, "pm25_oor")}


def test_streams(spark, tmp_path):
    from zephyrlake.streaming import streams

    rows = [(1, "pm25", hours(0), 1.0), (1, "pm25", hours(0), 3.0), (1, "pm25", hours(5), 9.0)]
    df = frame(spark, rows, "station int, pollutant string, ts timestamp_ntz, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.readings(spark, str(tmp_path / "in"), df.schema)
    got = {r.hour.hour: (r.n, r.v) for r in streams.finished(streams.hourly(stream, "1 hour")).collect()}
    assert got == {0: (2, 2.0)}  # the hour of the last row is still open
