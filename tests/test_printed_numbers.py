"""Numbers as text against Python's own, at places where the last digit is in doubt."""

import random

from pyspark.sql import functions as F

from zephyrlake.functions import basic


def printed(x, digits):
    text = f"{x:.{digits}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def test_last_digit_goes_by_the_binary_value(spark):
    r = random.Random(7)
    values = [24.89255, 25.13205, 0.03125, 0.09375, -0.00001, 1e10 + 0.125, 123456789.00005, 0.0, 7.0, -12.34565]
    values += [r.randrange(10**6) / 10**5 for _ in range(400)] + [10 + 3 * r.randrange(2000) / 160 for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 2, 4):
        for row in df.select("x", basic.trimmed(F.col("x"), digits).alias("t")).collect():
            assert row.t == printed(row.x, digits), row
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [x.t for x in odd.select(basic.trimmed(F.col("x")).alias("t")).collect()] == ["", "NaN", "Infinity", "-Infinity"]
