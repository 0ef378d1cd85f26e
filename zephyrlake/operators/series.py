"""Time series: lags, trailing windows, gap filling, runs, splits and resampling, always within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], ts: str):
    """The window of a series."""
    return Window.partitionBy(*keys).orderBy(ts)


def lags(df: DataFrame, keys: list[str], ts: str, column: str, steps: list[int]) -> DataFrame:
    """<column>_lag<n> by rows of the series."""
    w = ordered(keys, ts)
    return df.withColumns({f"{column}_lag{n}": F.lag(column, n).over(w) for n in steps})


def trailing_stats(df: DataFrame, keys: list[str], ts: str, column: str, widths: list[int], causal: bool = True) -> DataFrame:
    """<column>_mean<w>, <column>_std<w> of the last w rows, without the current one if causal; deviations need two values."""
    last = -1 if causal else 0
    out = {}
    for n in widths:
        w = ordered(keys, ts).rowsBetween(last - n + 1, last)
        out |= {f"{column}_mean{n}": F.avg(column).over(w), f"{column}_std{n}": F.stddev_samp(column).over(w)}
    return df.withColumns(out)


def trailing_range(df: DataFrame, keys: list[str], ts: str, column: str, width: int) -> DataFrame:
    """__n, __mean: rows and mean of the column in [ts - width, ts] of each row, in whole seconds, by key; a null time has the rows of null time.

    A range frame is worked out anew for each row. Here time goes in parts as wide as the frame, so that a frame is the
    start of a row's own part up to it and the end of the part before from its like place on: two running sums, one
    row per key and second, and no task holds more than a part.
    """
    sums = ["__k", "__m", "__s"]
    rows = df.withColumn("__at", seconds(ts))
    per = rows.groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__k"), F.count(column).alias("__m"), F.sum(F.col(column).cast("double")).alias("__s"))
    own = per.select(*keys, "__at", F.col("__at").alias("__place"), F.lit(True).alias("__own"), *sums)
    asked = per.where("__at is not null").select(*keys, "__at", (F.col("__at") - width).alias("__place"), F.lit(False).alias("__own"), F.lit(0).cast("long").alias("__k"), F.lit(0).cast("long").alias("__m"), F.lit(None).cast("double").alias("__s"))
    both = own.unionByName(asked).withColumn("__part", F.floor(F.col("__place") / width))
    up, down = (Window.partitionBy(*keys, "__part").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow) for order in (F.asc("__place"), F.desc("__place")))
    both = both.select(*keys, "__at", *[F.when(F.col("__own"), F.sum(c).over(up)).otherwise(F.sum(c).over(down)).alias(c) for c in sums])
    found = both.groupBy(*keys, "__at").agg(*[F.sum(c).alias(c) for c in sums]).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__at").alias("__when"), F.col("__k").alias("__n"), F.when(F.col("__m") > 0, F.col("__s") / F.col("__m")).alias("__mean"))
    same = F.col("__at").eqNullSafe(F.col("__when"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(found, same, "left").select(*df.columns, "__n", "__mean")


def targets(df: DataFrame, keys: list[str], ts: str, column: str, horizons: list[int]) -> DataFrame:
    """<column>_t<h>: the value so many rows ahead."""
    w = ordered(keys, ts)
    return df.withColumns({f"{column}_t{h}": F.lead(column, h).over(w) for h in horizons})


def rate_of_change(df: DataFrame, keys: list[str], ts: str, column: str) -> DataFrame:
    """<column>_diff: the change from the row before."""
    return df.withColumn(f"{column}_diff", F.col(column) - F.lag(column).over(ordered(keys, ts)))


def spine(df: DataFrame, keys: list[str], hour: str = "hour") -> DataFrame:
    """Every hour of each key from its first to its last."""
    edges = df.groupBy(*keys).agg(F.min(hour).alias("__a"), F.max(hour).alias("__b"))
    return edges.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("INTERVAL 1 HOUR"))).alias(hour))


def forward_filled(df: DataFrame, keys: list[str], ts: str, columns: list[str], limit: int | None = 3) -> DataFrame:
    """Nulls filled by the last value within so many rows (None: any)."""
    w = ordered(keys, ts).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def interpolated(df: DataFrame, keys: list[str], ts: str, column: str, limit: int = 6) -> DataFrame:
    """Linear interpolation by row within a gap, its first ``limit`` rows only; after the last value it is repeated, before the first nothing is filled."""
    n = F.col("__n")
    at = F.when(F.col(column).isNotNull(), n)
    rows = df.withColumn("__n", F.row_number().over(ordered(keys, ts)))
    # The next value is the last one in the descending order: frames up to the end would be worked out anew for each row.
    behind, ahead = (Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("__n"), F.desc("__n")))
    rows = rows.withColumns({"__x0": F.last(column, True).over(behind), "__n0": F.last(at, True).over(behind), "__x1": F.last(column, True).over(ahead), "__n1": F.last(at, True).over(ahead)})
    step = (n - F.col("__n0")).cast("double")
    made = F.when(F.col("__n1").isNull(), F.col("__x0")).otherwise(F.col("__x0") + (F.col("__x1") - F.col("__x0")) * step / (F.col("__n1") - F.col("__n0")))
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(step <= limit, made)
    return rows.withColumn(column, value).select(df.columns)


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def runs(df: DataFrame, keys: list[str], ts: str, gap_hours: float) -> DataFrame:
    """run_id: from 1 per key, a new one after each gap of more than so many hours."""
    w = ordered(keys, ts)
    gap = (seconds(ts) - F.lag(seconds(ts)).over(w)) / 3600.0
    return df.withColumn("__new", F.coalesce((gap > gap_hours).cast("int"), F.lit(1))).withColumn("run_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs_of_kinds(df: DataFrame, keys: list[str], ts: str, holds: dict[str, Column], value: str, gap_hours: float = 1.0) -> DataFrame:
    """One row per kind and run of rows for which the kind's predicate holds, broken by other rows and by gaps: kind, start, end, n, peak, peak_ts, trough, trough_ts, open (it reaches the series' last row).

    All predicates are followed over one sorted series; only rows for which one holds go on from there.
    """
    w = ordered(keys, ts)
    on = {k: f"__on{i}" for i, k in enumerate(holds)}
    rows = df.withColumns({on[k]: F.coalesce(x, F.lit(False)) for k, x in holds.items()})
    gap = (seconds(ts) - F.lag(seconds(ts)).over(w)) / 3600.0
    breaks = {f"__break{i}": F.coalesce(~F.lag(c).over(w) | (gap > gap_hours), F.lit(True)).cast("int") for i, c in enumerate(on.values())}
    rows = rows.withColumns({**breaks, "__last": F.lead(ts).over(w).isNull()})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__run{i}": F.sum(F.when(F.col(c), F.col(f"__break{i}")).otherwise(0)).over(upto) for i, c in enumerate(on.values())})
    each = F.array(*[F.when(F.col(c), F.struct(F.lit(k).alias("kind"), F.col(f"__run{i}").alias("run_id"))) for i, (k, c) in enumerate(on.items())])
    rows = rows.select(*keys, ts, value, "__last", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("__x"))
    return rows.groupBy(*keys, F.col("__x.kind").alias("kind"), F.col("__x.run_id").alias("run_id")).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"), F.min(value).alias("trough"),
        F.min_by(ts, F.struct(-F.col(value), F.col(ts))).alias("peak_ts"), F.min_by(ts, F.struct(F.col(value), F.col(ts))).alias("trough_ts"), F.bool_or("__last").alias("open"),
    )


def predicate_runs(df: DataFrame, keys: list[str], ts: str, holds: Column, value: str, gap_hours: float = 1.0) -> DataFrame:
    """The runs of one predicate."""
    return runs_of_kinds(df, keys, ts, {"": holds}, value, gap_hours).drop("kind")


def current_episode(df: DataFrame, keys: list[str], ts: str, detected: str, gap_hours: float = 3.0, window_hours: int = 24) -> DataFrame:
    """Per key, at its newest row: whether detected, length in hours and onset of the run that ends there, and the share of detected rows of the last hours."""
    w = ordered(keys, ts)
    newest = Window.partitionBy(*keys)
    rows = df.withColumn("__s", seconds(ts)).withColumn("__end", F.max("__s").over(newest))
    gap = F.coalesce((F.col("__s") - F.lag("__s").over(w)) / 3600.0 > gap_hours, F.lit(False))
    rows = rows.withColumn("__break", (gap | ~F.col(detected)).cast("int"))
    # A row belongs to the run at the end if it is detected and nothing breaks after it: as many breaks up to it as in all.
    upto, every = F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("__break").over(newest)
    rows = rows.withColumn("__held", F.col(detected) & (upto == every))
    recent = F.col("__s") >= F.col("__end") - 3600 * window_hours
    return rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("__held")), F.lit(False)).alias("active"),
        F.coalesce((F.max("__end") - F.min(F.when(F.col("__held"), F.col("__s")))) / 3600.0, F.lit(0.0)).alias("duration_h"),
        F.min(F.when(F.col("__held"), F.col(ts))).alias("onset_ts"),
        F.avg(F.when(recent, F.col(detected).cast("double"))).alias("persistence"),
    )


def chronological_split(df: DataFrame, ts: str, order: list[str], shares: tuple[float, float] = (0.6, 0.2), names: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """split by position in time, cut at round(n * share) of the rows ordered by ts and ``order``.

    Rows are counted by hour first, so that only hours at a cut need their rows numbered: no task sorts all rows.
    """
    hour = F.date_trunc("hour", ts)
    counts = df.groupBy(hour.alias("__h")).agg(F.count(F.lit(1)).alias("__c"))
    # One row per hour of the data.
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__c").over(Window.partitionBy())).drop("__c")
    own = Window.partitionBy("__h").orderBy(ts, *order)
    rows = df.withColumn("__h", hour).withColumn("__k", F.row_number().over(own)).join(before, "__h")
    at = F.col("__b") + F.col("__k")
    a, b = F.bround(F.col("__n") * shares[0]), F.bround(F.col("__n") * (shares[0] + shares[1]))
    return rows.withColumn("split", F.when(at <= a, names[0]).when(at <= b, names[1]).otherwise(names[2])).select(*df.columns, "split")


def resampled(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Hourly means with the hours between, null where there was nothing."""
    hourly = df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(*[F.avg(c).alias(c) for c in columns])
    return spine(hourly, keys).join(hourly, [*keys, "hour"], "left")


def windows_of(df: DataFrame, keys: list[str], ts: str, feature: str, length: int = 48) -> DataFrame:
    """Every row with the array of the last ``length`` values of its run (column run_id), for rows that have as many."""
    w = Window.partitionBy(*keys, "run_id").orderBy(ts).rowsBetween(-length + 1, 0)
    return df.withColumn("window", F.collect_list(feature).over(w)).where(F.size("window") == length)
