"""Nearest neighbours among sites that lie dense: the same results from few pairs."""

import random

from pyspark.sql import functions as F

from zephyrlake.operators import nearest


def dense(spark, n):
    r = random.Random(3)
    places = [(27.5 + r.randrange(40) / 100, 73.5 + r.randrange(40) / 100) for _ in range(n)]
    points = [(i, 27.5 + r.randrange(400) / 1000, 73.5 + r.randrange(400) / 1000) for i in range(150)] + [(900, 29.0, 80.0)]
    return points, [(i, *x) for i, x in enumerate(places)]


def test_dense_sites_meet_few(spark):
    points, sites = dense(spark, 3000)
    p, s = spark.createDataFrame(points, "fire_id long, lat double, lon double"), spark.createDataFrame(sites, "station long, slat double, slon double")
    for x in nearest.nearest_in_degrees(p, s).collect():
        assert (x.distance, x.station) == min(((x.lat - a) * (x.lat - a) + (x.lon - o) * (x.lon - o), k) for k, a, o in sites)
    # At the width of before, all these sites share a few cells: a block of level 2 would hold all of them.
    crowd = s.groupBy("slat", "slon").count()
    assert nearest.halvings(crowd, [], [F.col("slat"), F.col("slon")], 0.25) >= 4
    assert nearest.halvings(crowd.limit(5), [], [F.col("slat"), F.col("slon")], 0.25) == 0
    assert nearest.halvings(crowd.limit(0), [], [F.col("slat"), F.col("slon")], 0.25) == 0
