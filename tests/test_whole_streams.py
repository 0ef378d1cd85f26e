"""Streams that run to the end of their input tell all of it, open hours and sessions too."""

import datetime as dt
import os

import pytest

from zephyrlake.plans import registry
from zephyrlake.streaming import streams

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)
KIND = "station int, pollutant string, ts timestamp_ntz, v double"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["stream_hourly", "stream_sessions"])
def test_every_event_is_counted(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert sum(x.n for x in registry.queries()[name](spark, SF).collect()) == events
    assert "HAVING" not in registry.oracle_sql()[name]


def test_hours_over_several_batches(spark, tmp_path):
    """An hour that several batches add to is told once, as the last of them leaves it."""
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    parts = [[(1, "pm25", at(0), 1.0), (2, None, at(0), 4.0)], [(1, "pm25", at(0, 30), 3.0), (1, "pm25", at(5), 9.0)], [(1, "pm25", at(5, 1), 1.0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = streams.readings(spark, str(tmp_path / "in/*"), spark.createDataFrame([], KIND).schema, per_trigger=1)
    got = sorted((x.station, x.pollutant, x.hour.hour, x.n, x.v) for x in streams.finished(streams.hourly(stream, "1 day"), "update", ["station", "pollutant", "hour"]).collect())
    assert got == [(1, "pm25", 0, 2, 2.0), (1, "pm25", 5, 2, 5.0), (2, None, 0, 1, 4.0)]
