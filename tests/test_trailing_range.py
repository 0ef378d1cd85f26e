"""Trailing means over spans of time by running sums, against range frames."""

import datetime as dt
import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from zephyrlake.operators import series
from zephyrlake.plans import registry


def test_equals_range_frames(spark):
    r = random.Random(8)
    start = dt.datetime(1969, 12, 30)
    rows = [(r.choice([1, 2, None]), start + dt.timedelta(seconds=r.choice([r.randrange(500_000), 86400 * r.randrange(6)]), microseconds=r.randrange(10**6)), r.choice([None, r.random() * 100])) for _ in range(900)]
    rows += [(1, None, 5.0), (1, None, 7.0), (3, start, None), rows[0]]
    df = spark.createDataFrame(rows, "station int, ts timestamp_ntz, v double").withColumn("id", F.monotonically_increasing_id()).persist()
    for width in (86400, 7200, 1):
        w = Window.partitionBy("station").orderBy("s").rangeBetween(-width, 0)
        want = {x.id: (x.n, x.m) for x in df.withColumn("s", series.seconds("ts")).select("id", F.count(F.lit(1)).over(w).alias("n"), F.avg("v").over(w).alias("m")).collect()}
        got = series.trailing_range(df, ["station"], "ts", "v", width).collect()
        assert len(got) == len(want)
        for x in got:
            n, m = want[x.id]
            assert x["__n"] == n and (x["__mean"] is None) == (m is None) and (m is None or math.isclose(x["__mean"], m, rel_tol=1e-12)), x


def test_no_frame_is_worked_out_anew(spark):
    plan = registry.queries()["rolling_24h_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "-86400" not in plan and plan.count("unboundedpreceding") + plan.count("UnboundedPreceding") > 0 and "__part" in plan
