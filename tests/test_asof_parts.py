"""As-of joins over histories that are cut by month, against a search of all rows."""

import datetime as dt
import random

from zephyrlake.operators import align

START = dt.datetime(2023, 11, 1)


def test_matches_reach_over_months(spark):
    r = random.Random(4)
    at = lambda: START + dt.timedelta(hours=r.randrange(24 * 300))
    right = [(k, t, i) for k in "ab" for i, t in enumerate(sorted({at() for _ in range(12)}))] + [("c", START, 0), (None, START, 1)]
    left = [(r.choice(["a", "b", "c", "d", None]), at()) for _ in range(300)] + [("a", None), ("b", right[14][1])]
    a = spark.createDataFrame(left, "k string, ts timestamp_ntz")
    b = spark.createDataFrame([*right, ("a", None, 99)], "k string, ts timestamp_ntz, x int")
    back = align.asof_backward(a, b, ["k"], "ts", ["x"]).where("ts is not null").collect()
    assert len(back) == len(left) - 1
    for row in back:
        own = [(t, x) for k, t, x in right if k == row.k and row.k is not None and t <= row.ts]
        assert (row.matched_ts, row.x) == (max(own) if own else (None, None))
    for hours in (5.0, 24.0 * 40):
        for row in align.asof_nearest(a, b, ["k"], "ts", ["x"], hours).where("ts is not null").collect():
            own = [(abs((t - row.ts).total_seconds()), t, x) for k, t, x in right if k == row.k and row.k is not None and abs((t - row.ts).total_seconds()) <= hours * 3600]
            assert (row.matched_ts, row.x) == (min(own)[1:] if own else (None, None))


def test_no_window_holds_a_whole_history(spark):
    df = spark.createDataFrame([("a", START, 1)], "k string, ts timestamp_ntz, x int")
    for out in (align.asof_backward(df, df, ["k"], "ts", ["x"]), align.asof_nearest(df, df, ["k"], "ts", ["x"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        held = [line for line in plan.splitlines() if "Window [" in line and "__held" in line]
        assert held and all("__month" in line for line in held)
