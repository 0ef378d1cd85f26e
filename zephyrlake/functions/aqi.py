"""Air-quality index: sub-indices, categories and the overall index as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions.basic import clip, usable

#: Published bands (concentration from, to, sub-index from, to); CO in mg/m3, all others in ug/m3.
BREAKPOINTS: dict[str, list[tuple[float, float, float, float]]] = {
    "pm25": [(0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200), (91, 120, 201, 300), (121, 250, 301, 400), (251, 380, 401, 500)],
    "pm10": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 250, 101, 200), (251, 350, 201, 300), (351, 430, 301, 400), (431, 510, 401, 500)],
    "o3": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 168, 101, 200), (169, 208, 201, 300), (209, 748, 301, 400), (749, 1000, 401, 500)],
    "no2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 180, 101, 200), (181, 280, 201, 300), (281, 400, 301, 400), (401, 520, 401, 500)],
    "so2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 380, 101, 200), (381, 800, 201, 300), (801, 1600, 301, 400), (1601, 2620, 401, 500)],
    "co": [(0, 1.0, 0, 50), (1.1, 2.0, 51, 100), (2.1, 10, 101, 200), (10.1, 17, 201, 300), (17.1, 34, 301, 400), (34.1, 50, 401, 500)],
}
#: Upper index of each category, then the decimals to which a concentration is truncated.
CATEGORIES = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor"), (500, "Severe")]
DECIMALS = {"pm25": 0, "pm10": 0, "o3": 0, "no2": 0, "so2": 0, "co": 1}
#: Averaging window in hours, and the order in which ties are settled.
WINDOWS = {"pm25": 24, "pm10": 24, "o3": 8, "no2": 24, "so2": 24, "co": 8}
ORDER = ("pm25", "pm10", "o3", "no2", "so2", "co")
O3_LIMIT = 208


def truncated(x: Column, decimals: int) -> Column:
    """x cut to so many decimals, with a guard against representation just below a step."""
    scale = 10.0**decimals
    return F.floor(x * scale + 1e-9).cast("double") / scale


def subindex(pollutant: str, concentration: Column) -> Column:
    """Piecewise-linear sub-index; 500 from the top on, null where it can't be scored."""
    x = truncated(usable(concentration), DECIMALS[pollutant])
    top = BREAKPOINTS[pollutant][-1][1]
    out = F.when(x >= top, F.lit(500.0))
    for low, high, ilow, ihigh in BREAKPOINTS[pollutant]:
        out = out.when((x >= low) & (x <= high), F.lit((ihigh - ilow) / (high - low)) * (x - low) + ilow)
    return out


def category(aqi: Column) -> Column:
    """Category label; a value between two bands is of the lower one, above 500 Severe, unusable Unknown."""
    x = usable(aqi)
    out = F.when(x.isNull(), F.lit("Unknown"))
    for (_, label), (_, above) in zip(CATEGORIES, [*CATEGORIES[1:], (0, "")], strict=True):
        edge = {"Good": 51, "Satisfactory": 101, "Moderate": 201, "Poor": 301, "Very Poor": 401}.get(label)
        out = out.when(x < edge, F.lit(label)) if edge else out
    return out.otherwise(F.lit("Severe"))


def level(aqi: Column) -> Column:
    """Category number, 1 to 6; 0 for unusable values."""
    x = usable(aqi)
    out = F.when(x.isNull(), 0)
    for n, edge in enumerate((51, 101, 201, 301, 401), 1):
        out = out.when(x < edge, n)
    return out.otherwise(6)


def gap_category(aqi: Column) -> Column:
    """The evaluation-side category, in which a value between two bands is Severe; negatives count as 0."""
    x = F.when(~F.isnan(aqi.cast("double")), F.greatest(F.lit(0.0), aqi.cast("double")))
    out = F.when(x.isNull(), F.lit("Unknown"))
    low = 0
    for high, label in CATEGORIES:
        out = out.when((x >= low) & (x <= high), F.lit(label))
        low = high + 1
    return out.otherwise(F.lit("Severe"))


def with_overall(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds aqi, category, dominant from concentration columns (pollutant: column).

    The largest sub-index rounded half to even, ties to the first pollutant in ORDER; 0, Unknown and null if none
    can be scored. Each step is a column of its own, so that none is repeated inside the next.
    """
    df = df.withColumns({f"__i_{p}": subindex(p, F.col(c)) for p, c in columns.items()})
    subs = F.array(*[F.struct(F.col(f"__i_{p}").alias("s"), F.lit(-ORDER.index(p)).alias("o"), F.lit(p).alias("p")) for p in columns])
    df = df.withColumn("__best", F.array_max(F.filter(subs, lambda x: x["s"].isNotNull())))
    df = df.withColumn("aqi", F.coalesce(F.bround("__best.s", 0), F.lit(0.0)).cast("int"))
    df = df.withColumn("category", F.when(F.col("__best").isNull(), "Unknown").otherwise(category(F.col("aqi"))))
    return df.withColumn("dominant", F.col("__best.p")).drop("__best", *[f"__i_{p}" for p in columns])


#: The solver's own table of index against PM2.5.
SOLVER_PM25, SOLVER_AQI = (0.0, 30.0, 60.0, 90.0, 120.0, 250.0, 350.0), (0, 50, 100, 200, 300, 400, 500)


def interpolated(x: Column, xs: tuple[float, ...], ys: tuple[float, ...]) -> Column:
    """Linear interpolation in a table, ends held."""
    x = clip(x.cast("double"), xs[0], xs[-1])
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, (x - x0) * ((y1 - y0) / (x1 - x0)) + y0)
    return out


def solver_aqi(pm25: Column) -> Column:
    """The solver's index of a concentration, cut to an integer."""
    return F.floor(interpolated(pm25, SOLVER_PM25, SOLVER_AQI) + 1e-9).cast("int")


def solver_pm25(aqi: Column) -> Column:
    """The concentration of a solver index."""
    return interpolated(aqi, SOLVER_AQI, SOLVER_PM25)


def stage(aqi: Column) -> Column:
    """Response stage 0 to 4 by index: from 201, 301, 401 and 451."""
    x = F.bround(clip(usable(aqi), 0, 500), 0)
    return F.when(x.isNull() | (x <= 200), 0).when(x <= 300, 1).when(x <= 400, 2).when(x <= 450, 3).otherwise(4)
