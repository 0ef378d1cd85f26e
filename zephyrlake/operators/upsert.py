"""Idempotent ingest on plain files: action classification, merged tables, provenance and slot filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions.basic import slots, trimmed


def actions(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Incoming rows with action insert, update (some value differs, null counts) or unchanged."""
    old = existing.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__there"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    action = F.when(F.col("__there").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return incoming.join(old, keys, "left").select(*keys, *values, action.alias("action"))


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: incoming rows, and existing ones of other keys."""
    return incoming.select(existing.columns).unionByName(existing.join(incoming.select(*keys), keys, "left_anti"))


def unseen(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, one per key, whose key is not there yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def backfilled(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Existing rows whose nulls in the given columns are filled from incoming ones."""
    new = incoming.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = existing.join(new, keys, "left")
    return rows.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in existing.columns])


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes the touched partitions of a Parquet table, replacing only these; rows of a partition lie together."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_slots(latest: DataFrame, existing: DataFrame, keys: list[str], ts: str, hours: int = 24) -> DataFrame:
    """The newest row of each key copied to those of its last hourly slots that have none, marked re_stamped."""
    rows = latest.withColumn("__slot", F.explode(slots(F.date_trunc("hour", ts).cast("timestamp_ntz"), hours)))
    rows = rows.withColumn(ts, F.col("__slot")).drop("__slot").withColumn("re_stamped", F.lit(True))
    there = existing.select(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias(ts))
    return rows.join(there, [*keys, ts], "left_anti")


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column line: the values comma-joined, numbers with at most four decimals, null empty."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(F.concat_ws(",", *[trimmed(F.col(c)) if c in numeric else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
