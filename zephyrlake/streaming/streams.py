"""Streams of readings: hourly means, gap sessions, de-duplication, rejected rows, and the latest state of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from zephyrlake.sources.shared import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def readings(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A file stream with event time as TIMESTAMP, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, late: str = "3 hours") -> DataFrame:
    """Count and mean per station, pollutant and hour; in append mode told once the watermark has passed the hour. Rows later than the watermark are dropped."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "station", "pollutant").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"))
    return out.select("station", "pollutant", F.col("w.start").alias("hour"), "n", "v")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "3 hours") -> DataFrame:
    """Start, end and count of each station's sessions, which end after a gap; in append mode told once the watermark has passed their end."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "station").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("peak"))
    return out.select("station", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "peak")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def not_future(stream: DataFrame) -> DataFrame:
    """Rows that aren't ahead of the clock."""
    return stream.where(F.col("ts") <= F.current_timestamp())


def failing(keys: list[str], checks: dict[str, Column] | None = None) -> Column:
    """What is wrong with a row: a key or the time is missing, or a check doesn't hold (or can't be told); null if nothing is."""
    bad = [F.when(F.col(k).isNull(), F.lit(f"{k} is missing")) for k in [*keys, "ts"]]
    bad += [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in (checks or {}).items()]
    return F.nullif(F.concat_ws("; ", *bad), F.lit(""))


def accepted(stream: DataFrame, keys: list[str], checks: dict[str, Column] | None = None) -> DataFrame:
    """Rows with nothing wrong."""
    return stream.where(failing(keys, checks).isNull())


def rejected(stream: DataFrame, keys: list[str], checks: dict[str, Column] | None = None) -> DataFrame:
    """The other rows, with the error, to be written beside the state rather than stop it."""
    return stream.withColumn("error", failing(keys, checks)).where(F.col("error").isNotNull())


class Latest(StatefulProcessor):
    """The newest row of a key as a value state, and a timer that tells when it has gone stale."""

    def __init__(self, keys: list[str], values: list[str], kept: StructType, stale_ms: int):
        self.keys, self.values, self.kept, self.stale_ms = keys, values, kept, stale_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", self.kept)

    def told(self, key: tuple, row: tuple, status: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row, status)], columns=[*self.keys, "ts", *self.values, "status"])

    @staticmethod
    def order(row: tuple) -> tuple:
        return tuple((x is not None, x) if x is not None else (False,) for x in row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        best = held
        for batch in rows:
            for row in batch[["ts", *self.values]].astype(object).itertuples(index=False, name=None):
                row = tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)
                best = row if best is None or self.order(row) > self.order(best) else best
        if best != held:
            self.state.update(best)
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(pd.Timestamp(best[0]).tz_localize("UTC").timestamp() * 1000) + self.stale_ms)
            yield self.told(key, best, "fresh")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self.told(key, tuple(self.state.get()), "stale")

    def close(self) -> None:
        pass


def latest_state(stream: DataFrame, keys: list[str], values: list[str], late: str = "30 days", stale_hours: float = 6.0) -> DataFrame:
    """Changes of the latest state: keys, ts, values, status, whenever a key's newest row changes (fresh) or has been overtaken by the watermark for so long (stale).

    Newest is the largest ts, then the largest values in their order, so replays and late rows change nothing; rows that are
    later than the watermark are dropped. What a batch costs goes with its keys. The session has to be in UTC; its state
    store is set to the one that timers need.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withWatermark("ts", late).select(*keys, "ts", *values)
    kept = StructType([rows.schema["ts"], *[rows.schema[c] for c in values]])
    shape = StructType([*[rows.schema[k] for k in keys], *kept.fields]).add("status", "string")
    return rows.groupBy(*keys).transformWithStateInPandas(Latest(keys, values, kept, int(stale_hours * 3_600_000)), outputStructType=shape, outputMode="Update", timeMode="EventTime")


def logged(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """A query that writes each batch's rows as a folder of its own; a batch that runs again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def current(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The state that a log of changes amounts to: the last change of each key."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", "ts", "status")).alias("x"))
    return last.select(*keys, "x.*").select(schema.names)


def finished(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there, its results written as Parquet in the shared folder, and reads them: all batches, the last one if complete, or what the last batch that told it says of each of ``keys`` if update.

    Append leaves out what the watermark hasn't passed when the input ends; update and complete tell it too. Update
    writes only what a batch changes; session windows can't be told so and take complete.
    """
    spark, base = stream.sparkSession, shared_dir(stream.sparkSession, "streams")
    logged(stream, f"{base}/out", f"{base}/state", mode).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields]).add("batch", "long")).parquet(f"{base}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("__last"))
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("__last"))  # one row
    elif mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
    return rows.select(stream.columns)


def finished_state(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of state changes over what is there and reads the state it leaves."""
    base = shared_dir(stream.sparkSession, "streams")
    logged(stream, f"{base}/out", f"{base}/state").start().awaitTermination()
    return current(stream.sparkSession, f"{base}/out", stream.schema, keys)
