"""Writes held by their counts, dumps read back, and the latest state of a stream."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from zephyrlake.operators import guarded
from zephyrlake.sources import dumps
from zephyrlake.streaming import streams

KIND = "id int, satellite string, lat double, lon double, acq timestamp_ntz, synthetic boolean, source string"
T = dt.datetime(2024, 1, 1, 5)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(1, " N20", 28.12341, 77.0, T, True, None), (2, "N", 28.0, 77.0, T, True, "firms_live"), (3, "N", 29.0, 77.0, T, False, "archive"), (4, None, 30.0, 77.0, T, True, "old"), (5, "N", 31.0, 77.0, T, True, "old"), (5, "N", 31.0, 77.0, T, True, "old")]
    path = str(tmp_path / "table")
    spark.createDataFrame(rows, KIND).write.parquet(path)
    return path


@pytest.fixture
def known(spark):
    rows = [(0, "N20", 28.12342, 77.00001, T, False, "archive"), (0, "N", 28.0, 77.0, T, False, "archive"), (0, "N", 29.0, 77.0, T, False, "archive"), (0, "N", 31.0, 77.0, T, True, "b"), (0, "N", 31.0, 77.0, T, False, "z"), (0, "Z", 1.0, 1.0, T, False, "a")]
    return spark.createDataFrame(rows, KIND).drop("id")


def content(spark, path):
    return sorted((x.id, x.synthetic, x.source or "") for x in spark.read.parquet(path).collect())


COUNTS = {"scanned": 6, "matched": 5, "protected": 1, "unchanged": 1, "changed": 3, "filled": 1}


def test_counts_hold_and_the_table_changes(spark, table, known, tmp_path):
    said = guarded.guarded_update(spark, table, known, guarded.Expected(scanned=6, matched=5, changed=3, protected=1))
    assert said == {**COUNTS, "anomalies": [], "replaced": True}
    assert content(spark, table) == [(1, False, "archive"), (2, True, "firms_live"), (3, False, "archive"), (4, True, "old"), (5, False, "z"), (5, False, "z")]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


@pytest.mark.parametrize("expected", [guarded.Expected(scanned=7), guarded.Expected(matched=4), guarded.Expected(min_matched=6), guarded.Expected(changed=2), guarded.Expected(protected=0)])
def test_a_violated_count_leaves_the_table(spark, table, known, tmp_path, expected):
    before = content(spark, table)
    files = sorted(p.name for p in (tmp_path / "table").iterdir())
    said = guarded.guarded_update(spark, table, known, expected)
    assert said["anomalies"] and not said["replaced"] and {k: said[k] for k in COUNTS} == COUNTS
    assert content(spark, table) == before and sorted(p.name for p in (tmp_path / "table").iterdir()) == files
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_dry_runs_and_runs_that_change_nothing(spark, table, known, tmp_path):
    before = content(spark, table)
    assert guarded.guarded_update(spark, table, known, dry_run=True) == {**COUNTS, "anomalies": [], "replaced": False} and content(spark, table) == before
    none = guarded.guarded_update(spark, table, known.where("satellite = 'Z'"))
    assert none["anomalies"] == ["matched 0 rows, at least 1 expected"] and not none["replaced"]
    assert guarded.guarded_update(spark, table, known.where("lat = 29"))["anomalies"] == ["nothing would change"]
    assert guarded.guarded_update(spark, table, known.where("lat = 28"))["anomalies"] == []  # all of them protected
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "none"))
    assert "the table is empty" in guarded.guarded_update(spark, str(tmp_path / "none"), known)["anomalies"]


# ---- dumps


def dump(hours=2, cells=((1, 2, 5.5), (3, 4, 0.25))):
    parts = [(T + dt.timedelta(hours=h), T + dt.timedelta(hours=h + 1), [list(cells), [], [(2, 2, 1.0 + h)], []]) for h in range(hours)]
    return dumps.written_dump((10, 10, 0.5, 0.25, 28.0, 77.0), [10, 100], ["PM25", "DUST"], parts)


def test_dumps_read_back(spark):
    files = spark.createDataFrame([("a", dump()), ("b", b""), ("c", None)], "path string, content binary")
    rows = sorted(tuple(x) for x in dumps.dump_points(files).collect())
    one = [("a", 0, T, 1.0, 10, "PM25", 1, 2, 28.5, 77.0, 5.5), ("a", 0, T, 1.0, 10, "PM25", 3, 4, 29.5, 77.5, 0.25), ("a", 2, T, 1.0, 100, "PM25", 2, 2, 28.5, 77.25, 1.0)]
    assert rows[:3] == one and len(rows) == 6 and rows[5][:6] == ("a", 6, T + dt.timedelta(hours=1), 1.0, 100, "PM25") and rows[5][10] == 2.0


def test_torn_files_end_at_their_last_whole_record(spark, tmp_path):
    whole = dump()
    places = [at for at, _ in dumps.framed(whole)]
    counts = []
    for n, size in enumerate([len(whole) - 1, places[-3] + 5, places[-4], places[7] + 3]):
        (tmp_path / f"{n}.bin").write_bytes(whole[:size])
    for x in dumps.read_dumps(spark, str(tmp_path)).groupBy("path").count().orderBy("path").collect():
        counts.append(x["count"])
    assert counts == [6, 5, 3]  # the last file is torn in its first concentration record
    assert list(dumps.framed(b"\x00\x00\x00\x05hello\x00\x00\x00\x05\x00")) == [(0, b"hello")]


def test_what_is_no_dump_is_refused(spark):
    bad = spark.createDataFrame([("x", b"hello world, this is text"), ("y", dump()[:60]), ("z", dump())], "path string, content binary")
    with pytest.raises(Exception, match="NotADump"):
        dumps.dump_points(bad).collect()
    assert {x.path for x in dumps.dump_points(bad, malformed="skip").collect()} == {"z"}


def test_surfaces_by_time(spark):
    points = spark.createDataFrame([(T, 0, 28.0, 77.0, 4.0), (T, 1, 28.0, 77.0, 9.0), (T, 2, 28.1, 77.0, 1.0), (T + dt.timedelta(hours=1), 0, 40.0, 77.0, 1.0)], "time timestamp_ntz, record int, lat double, lon double, value double")
    cells = spark.createDataFrame([(0, 0, 28.0, 77.0), (0, 1, 28.05, 77.0), (9, 9, 10.0, 10.0)], "i int, j int, lat double, lon double")
    got = {(x.time.hour, x.i, x.j): x.value for x in dumps.dump_surfaces(points, cells).collect()}
    a, b = 1 / 0.05**2, 1 / 0.05**2
    assert got[5, 0, 0] == 4.0 and math.isclose(got[5, 0, 1], (4 * a + 9 * a + b) / (2 * a + b), rel_tol=1e-6)
    assert [v for k, v in got.items() if k[0] == 6] == [0.0] * 3 and got[5, 9, 9] == 0.0


# ---- latest state


def test_replays_and_late_rows_leave_one_newest_row(spark, tmp_path):
    kind = "station int, ts timestamp_ntz, v double, n string"
    at = lambda h: T + dt.timedelta(hours=h)
    batches = [[(1, at(0), 1.0, "a"), (1, at(2), 3.0, None), (2, at(0), 5.0, "x"), (None, at(0), 1.0, "y"), (3, None, 1.0, "z"), (4, at(1), -1.0, "w")], [(1, at(2), 3.0, None), (1, at(1), 9.0, "late")], [(1, at(40), 7.0, "c")], [(5, at(41), 1.0, "d")]]
    state, log = str(tmp_path / "ck"), str(tmp_path / "log")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
        stream = streams.readings(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], kind).schema)
        out = streams.latest_state(streams.accepted(stream, ["station"], {"v is negative": F.col("v") >= 0}), ["station"], ["v", "n"], "2 days", 6)
        streams.logged(out, log, state).start().awaitTermination()
        now = {x.station: (x.ts, x.v, x.n, x.status) for x in streams.current(spark, log, out.schema, ["station"]).collect()}
        if n < 2:
            assert now == {1: (at(2), 3.0, None, "fresh"), 2: (at(0), 5.0, "x", "fresh")}
    assert now[1] == (at(40), 7.0, "c", "fresh") and now[5][3] == "fresh" and set(now) == {1, 2, 5}
    replayed = [x for x in (tmp_path / "log").iterdir() if x.name.startswith("batch=")]
    sizes = sorted(spark.read.parquet(str(x)).count() for x in replayed)
    assert max(sizes) == 2  # a batch writes its own keys
    bad = streams.rejected(streams.readings(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], kind).schema), ["station"], {"v is negative": F.col("v") >= 0})
    assert sorted(x.error for x in streams.finished(bad).collect()) == ["station is missing", "ts is missing", "v is negative"]


def test_stale_keys_are_told_by_their_timer(spark, tmp_path):
    kind = "station int, ts timestamp_ntz, v double"
    rows = [(1, T, 1.0), (2, T + dt.timedelta(hours=12), 2.0)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    stream = streams.readings(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)
    got = streams.finished_state(streams.latest_state(stream, ["station"], ["v"], "1 hour", 6), ["station"]).collect()
    assert {(x.station, x.v, x.status) for x in got} == {(1, 1.0, "stale"), (2, 2.0, "fresh")}
