"""Training tables: composite features, splits by time span, train-only statistics, forecast runs and their confidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.functions import met
from zephyrlake.functions.basic import clip
from zephyrlake.operators import fire, series
from zephyrlake.operators.clean import hour_deduped, iqr_flags
from zephyrlake.operators.series import micros


def composite_features(df: DataFrame) -> DataFrame:
    """temp_humidity_index, ventilation_index, pm_ratio, dispersion_potential from columns of a panel row; a zero pm10 gives no ratio."""
    return df.withColumns({
        "temp_humidity_index": F.col("temperature") * F.col("humidity") / 100.0,
        "ventilation_index": F.col("wind_speed") * F.col("pbl_height"),
        "pm_ratio": F.col("pm25") / F.when(F.col("pm10") != 0, F.col("pm10")),
        "dispersion_potential": F.col("wind_speed") * F.col("pbl_height") / (F.col("temperature") + 273.15),
    })


def split_by_span(df: DataFrame, ts: str, shares: tuple[float, float] = (0.6, 0.15), names: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """split by where a row's time lies between the first and the last of all, cut at these shares of the span; an edge belongs to the earlier part."""
    edges = df.agg(F.min(micros(ts)).alias("__a"), F.max(micros(ts)).alias("__b"))
    at, span = micros(ts) - F.col("__a"), F.col("__b") - F.col("__a")
    first, second = F.floor(span * shares[0]), F.floor(span * (shares[0] + shares[1]))
    rows = df.crossJoin(F.broadcast(edges))  # one row
    return rows.withColumn("split", F.when(at <= first, names[0]).when(at <= second, names[1]).otherwise(names[2])).select(*df.columns, "split")


def train_stats(df: DataFrame, keys: list[str], ts: str, columns: list[str], split: str = "train") -> DataFrame:
    """feature, n, mean, deviation, median of the rows of one split, gaps filled from the past of their key; a constant feature has the deviation 1."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col("split") == split).withColumns({c: F.last(c, True).over(w) for c in columns})
    stats = rows.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"), F.median(c).alias("median")).alias(c) for c in columns])
    each = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])).alias("x"))
    deviation = F.col("x.s.deviation")
    return each.select("x.feature", "x.s.n", "x.s.mean", F.when(deviation == 0, 1.0).otherwise(deviation).alias("deviation"), "x.s.median")


WEATHER = ("temperature", "humidity", "wind_speed", "wind_direction", "pbl_height")


def training_table(readings: DataFrame, weather: DataFrame, stations: DataFrame, fires: DataFrame, target: str = "pm25", plausible: tuple[float, float] = (0, 1000), lags: tuple[int, ...] = (1, 3, 6, 12, 24), widths: tuple[int, ...] = (3, 6, 12, 24), fill_hours: int = 3, fire_hours: float = 24.0, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """The whole table that a model of ``target`` is trained on, from raw readings to the split: one row per station and hour with a plausible target.

    readings: (station, ts, target), weather: (station, ts, and those of WEATHER that it has), stations: (station, slat,
    slon), fires: (lat, lon, frp, acq). Of several rows of a station and hour the latest counts. Weather joins the hours of
    readings and is carried on for up to ``fill_hours`` rows; then rows whose target lies outside (low, high] go. Lags and
    trailing statistics never see the current target. Outliers beyond three quartile distances are flagged, not removed.
    The split is in time, without gaps, rows of an hour ordered by station.
    """
    values = [c for c in WEATHER if c in weather.columns]
    hourly = lambda df, columns: hour_deduped(df.select("station", "ts", *columns), ["station"], "ts", columns).drop("ts")
    rows = hourly(readings, [target]).join(hourly(weather, values), ["station", "hour"], "left")
    rows = series.forward_filled(rows, ["station"], "hour", values, fill_hours)
    rows = rows.where((F.col(target) > plausible[0]) & (F.col(target) <= plausible[1]))
    rows = rows.select("station", "hour", target, *[F.col(c) if c in values else F.lit(None).cast("double").alias(c) for c in WEATHER])
    h, pbl = F.hour("hour"), F.col("pbl_height")
    rows = rows.withColumns({
        "ventilation_norm": clip(F.col("wind_speed") * pbl / 6000.0, 0, 1), "inversion_detected": F.coalesce(pbl < 500, F.lit(False)), "inversion_strength": F.coalesce(clip((500.0 - pbl) / 500.0, 0, 1), F.lit(0.0)), "inversion_category": met.proxy_category(pbl),
        "wind_dir_sin": F.sin(F.radians(F.coalesce("wind_direction", F.lit(0.0)))), "wind_dir_cos": F.cos(F.radians(F.coalesce("wind_direction", F.lit(0.0)))), "hour_sin": F.sin(2 * math.pi * h / 24.0), "hour_cos": F.cos(2 * math.pi * h / 24.0), "day_of_week": F.weekday("hour"), "is_weekend": F.weekday("hour").isin(5, 6),
    })
    rows = fire.trailing_fires(rows.withColumnRenamed("hour", "ts"), fires, stations, fire_hours).withColumnRenamed("ts", "hour")
    rows = series.trailing_stats(series.lags(rows, ["station"], "hour", target, list(lags)), ["station"], "hour", target, list(widths))
    rows = iqr_flags(rows, [target], 3.0)
    return series.chronological_split(rows, "hour", ["station"], shares)


def standardised(df: DataFrame, stats: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Columns filled from the past of their key, else with the training median (0 where there is none), then as deviations from the training mean."""
    one = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "deviation", "median")))).alias("__s"))  # one row per feature
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({c: F.last(c, True).over(w) for c in columns}).crossJoin(F.broadcast(one))  # one row
    s = lambda c, name: F.col("__s")[c][name]
    return rows.withColumns({c: (F.coalesce(F.col(c), s(c, "median"), F.lit(0.0)) - s(c, "mean")) / s(c, "deviation") for c in columns}).select(df.columns)


def selected_columns(df: DataFrame, candidates: list[str], drop: tuple[str, ...] = ()) -> tuple[list[str], dict[str, str]]:
    """(columns that can teach a model, why each other one can't): dropped by name, not there, without a value, or constant. One aggregation looks at all."""
    reasons = {c: "in drop set" if c in drop else "not in dataset" for c in candidates if c in drop or c not in df.columns}
    rest = [c for c in candidates if c not in reasons]
    if not rest:
        return [], reasons
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
    seen = df.agg(*[F.struct(F.count(value(c)).alias("n"), (F.min(value(c)) == F.max(value(c))).alias("same")).alias(f"c{i}") for i, c in enumerate(rest)]).first()
    for c, x in zip(rest, seen, strict=True):
        if not x.n:
            reasons[c] = "all NaN"
        elif x.same:
            reasons[c] = "constant (nunique=1)"
    return [c for c in rest if c not in reasons], reasons


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("pm25", "pm10", "o3", "no2", "so2", "co", "aqi", "timestamp", "station", "outlier_flags", "weather_outlier_flags")) -> list[str]:
    """Numeric columns that are no targets and no metadata."""
    return [f.name for f in df.schema if f.name not in exclude and f.dataType.typeName() in ("double", "float", "long", "integer")]


def lookback_spans(df: DataFrame, keys: list[str], ts: str, spans_days: tuple[int, ...] = (10, 30, 120), least: int = 4) -> DataFrame:
    """keys, release (a key's latest time), rows_<span> within each span before it, and span_days: the first span with at least ``least`` rows, null if none has.

    All spans are counted in one aggregation.
    """
    release = df.groupBy(*keys).agg(F.max(ts).alias("release"))
    within = {d: F.col(ts) >= F.col("release") - F.expr(f"INTERVAL {d} DAYS") for d in spans_days}
    counts = df.join(release, keys).groupBy(*keys, "release").agg(*[F.count_if(x).alias(f"rows_{d}") for d, x in within.items()])
    span = F.coalesce(*[F.when(F.col(f"rows_{d}") >= least, F.lit(d)) for d in sorted(spans_days)])
    return counts.withColumn("span_days", span)


def lookback_rows(df: DataFrame, spans: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The rows of each key within its own span; keys whose longest span holds too few have none."""
    chosen = spans.where("span_days is not null").select(*keys, F.col("release").alias("__release"), F.col("span_days").alias("__span"))
    rows = df.join(chosen, keys)
    since = F.col("__release") - F.make_dt_interval(F.col("__span"))
    return rows.where((F.col(ts) >= since) & (F.col(ts) <= F.col("__release"))).select(df.columns)


def serving_rows(readings: DataFrame, weather: DataFrame, spans_days: tuple[int, ...] = (10, 30, 120), least: int = 4, weather_days: int = 5, target: str = "pm25", value_columns: tuple[str, ...] = ("temperature", "humidity", "wind_speed", "pbl_height")) -> DataFrame:
    """The newest model row of each station: its last hour with lags and trailing means over its own look-back, the weather of that hour, and what the row rests on.

    readings: (station, ts, target), hourly, with nulls where nothing was measured; weather: (station, ts, ...). Rows
    counted as context: pollution_rows_in_window, weather_rows_in_window and span_days.
    """
    spans = lookback_spans(readings, ["station"], "ts", spans_days, least)
    rows = lookback_rows(readings, spans, ["station"], "ts")
    w = Window.partitionBy("station").orderBy("ts")
    rows = rows.withColumns({f"{target}_lag{k}": F.lag(target, k).over(w) for k in (1, 3, 6)} | {f"{target}_mean{k}": F.avg(target).over(w.rowsBetween(-k, -1)) for k in (6, 24)})
    rows = rows.withColumns({"hour": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "__n": F.count(F.lit(1)).over(Window.partitionBy("station")), "__last": F.row_number().over(Window.partitionBy("station").orderBy(F.desc("ts")))}).where("__last = 1")
    near = weather.join(spans.select("station", "release"), "station").where((F.col("ts") >= F.col("release") - F.expr(f"INTERVAL {weather_days} DAYS")) & (F.col("ts") <= F.col("release")))
    counted = near.groupBy("station").agg(F.count(F.lit(1)).alias("weather_rows_in_window"))
    at = near.select("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), *value_columns)
    out = rows.join(at, ["station", "hour"], "left").join(counted, "station", "left").join(spans.select("station", "span_days"), "station")
    return out.select("station", "hour", target, *[f"{target}_lag{k}" for k in (1, 3, 6)], *[f"{target}_mean{k}" for k in (6, 24)], *value_columns, F.col("__n").alias("pollution_rows_in_window"), F.coalesce("weather_rows_in_window", F.lit(0)).cast("long").alias("weather_rows_in_window"), "span_days")


def newest_run(forecasts: DataFrame, keys: list[str], created: str, order: list[str] | None = None, most: int = 24) -> DataFrame:
    """The rows of each key's newest run among its ``most`` newest rows (by creation, then ``order``); if that run has a single row, all of these."""
    w = Window.partitionBy(*keys).orderBy(F.desc(created), *(order or []))
    rows = forecasts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    # The window of a key's kept rows: at most ``most``.
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("__newest", F.max(created).over(own))
    rows = rows.withColumn("__n", F.count_if(F.col(created) == F.col("__newest")).over(own))
    return rows.where((F.col(created) == F.col("__newest")) | (F.col("__n") == 1)).select(forecasts.columns)


def replaced(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those whose keys come anew, and the fresh ones: replacement by (station, horizon)."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def run_confidence(forecasts: DataFrame, keys: list[str], horizon: str, predicted: str) -> DataFrame:
    """confidence of each horizon, 0.1 to 1: it falls with the horizon and with the distance to the nearest horizons' predictions; 0 without one."""
    w = Window.partitionBy(*keys).orderBy(horizon)
    p = F.col(predicted)
    spread = F.greatest(F.abs(p - F.lag(p).over(w)), F.abs(p - F.lead(p).over(w)))
    base = F.greatest(F.lit(0.3), 1.0 - F.col(horizon) / 100.0) - F.coalesce(F.least(F.lit(0.3), spread / 500.0), F.lit(0.0))
    return forecasts.withColumn("confidence", F.when(p.isNull(), 0.0).otherwise(clip(base, 0.1, 1.0)))


def short_name(name: Column, city: str = "") -> Column:
    """A station's name without the agency after the last ' - ' and without ', <city>' at its end; never empty."""
    short = F.trim(F.regexp_replace(name, r"(?s)^(.*) - .*$", "$1"))
    if city.strip():
        suffix = f", {city.strip()}"
        short = F.when(F.endswith(short, F.lit(suffix)), F.trim(F.substring(short, F.lit(1), F.length(short) - len(suffix)))).otherwise(short)
    return F.when(short == "", F.trim(name)).otherwise(short)


def instrument(stated: Column, satellite: Column) -> Column:
    """The stated instrument, else the one that the satellite carries; empty if neither is known."""
    stated, satellite = (F.trim(F.coalesce(x, F.lit(""))) for x in (stated, satellite))
    return F.when(stated != "", stated).when(satellite.isin("Terra", "Aqua", "MODIS"), "MODIS").when(satellite != "", "VIIRS").otherwise("")


def brightness(i4: Column, t31: Column) -> Column:
    """Brightness temperature: the first band that has a number."""
    return F.coalesce(F.when(~F.isnan(i4), i4), F.when(~F.isnan(t31), t31))


def winter(ts: Column) -> Column:
    """Whether a time lies in the winter season, October to February."""
    return F.month(ts).isin(10, 11, 12, 1, 2)


#: Short names of monitors, in small letters, and what their stations are called.
STATION_NAMES = {
    "imd lodhi road": "Lodhi Road", "lodhi road": "Lodhi Road", "r k puram": "RK Puram", "rk puram": "RK Puram", "dwarka-sector 8": "Dwarka", "dwarka": "Dwarka", "punjabi bagh": "Punjabi Bagh", "anand vihar": "Anand Vihar", "ito": "ITO", "sirifort": "Sirifort",
    "shadipur": "Shadipur", "okhla phase-2": "Okhla Phase-2", "ashok vihar": "Ashok Vihar", "mundka": "Mundka", "jahangirpuri": "Jahangirpuri", "aya nagar": "Aya Nagar", "vivek vihar": "Vivek Vihar", "teri gram": "Teri Gram", "vikas sadan": "Teri Gram", "sector - 62": "Noida Sector-62",
    "sector-62": "Noida Sector-62", "sector 62": "Noida Sector-62", "noida sector-62": "Noida Sector-62", "sector 11": "Faridabad", "faridabad": "Faridabad",
}
#: Names of the yearly files that differ from the stations', agencies behind a name, and what marks rows that no feed measured.
FILE_NAMES = {"sector 11": "Faridabad", "sector 62": "Noida Sector-62", "sector - 62": "Noida Sector-62", "teri gram": "Teri Gram"}
AGENCIES = ("DPCC", "CPCB", "HSPCB", "UPPCB", "IMD")
DEMO_SOURCES = ("demo", "bundled", "synthetic", "bootstrap")


def looked_up(name: Column, names: dict[str, str]) -> Column:
    """A name's entry by its small letters without outer spaces, else the name as it is."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), name)


def canonical_station(short: Column) -> Column:
    """The station of a monitor's short name; unknown ones stay."""
    return looked_up(short, STATION_NAMES)


def station_of_file(name: Column) -> Column:
    """The station of a name with city and agency: what stands before the first agency and the first comma."""
    agencies = "|".join(AGENCIES)
    short = F.regexp_replace(name, f"(?s) ?- ({agencies}).*$", "")
    return looked_up(F.trim(F.substring_index(short, ",", 1)), FILE_NAMES)


def demo_row(re_stamped: Column, source: Column) -> Column:
    """Whether a row is no measurement of its own: stamped anew, or from a source of made-up rows."""
    return F.coalesce(re_stamped, F.lit(False)) | F.coalesce(F.lower(source).rlike(f"^({'|'.join(DEMO_SOURCES)})"), F.lit(False))


def evolved(stored: DataFrame, fresh: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Stored and fresh rows with the columns of both, one row per key: that of the largest ``newest``.

    Columns that only one side has are null in the other's rows; a column that both have with different types is
    refused, as that is no addition. Rows whose key has a null stay, each.
    """
    for c in stored.columns:
        if c in fresh.columns and stored.schema[c].dataType != fresh.schema[c].dataType:
            raise ValueError(f"column {c} is {stored.schema[c].dataType.simpleString()} in the table and {fresh.schema[c].dataType.simpleString()} in the new rows")
    rows = stored.unionByName(fresh, allowMissingColumns=True)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in rows.columns if c not in (*keys, newest)]
    last = rows.where(whole).groupBy(*keys).agg(F.max(F.struct(newest, *rest)).alias("x")).select(*keys, "x.*")
    return last.select(rows.columns).unionByName(rows.where(~whole))
