"""Writes that hold to their counts: a table changes only if what was matched, changed and protected is what was expected."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTS = ("scanned", "matched", "protected", "unchanged", "changed", "filled")


@dataclass(frozen=True)
class Expected:
    """What a pass must find for its write to stand; None is not asked."""

    min_matched: int = 1
    scanned: int | None = None
    matched: int | None = None
    changed: int | None = None
    protected: int | None = None

    def anomalies(self, counts: dict[str, int]) -> list[str]:
        """What doesn't hold, in words."""
        out = []
        if not counts["scanned"]:
            out.append("the table is empty")
        if counts["matched"] < self.min_matched:
            out.append(f"matched {counts['matched']} rows, at least {self.min_matched} expected")
        out += [f"{name} {counts[name]} rows, {want} expected" for name in ("scanned", "matched", "changed", "protected") if (want := getattr(self, name)) is not None and counts[name] != want]
        if counts["scanned"] and counts["matched"] >= self.min_matched and not counts["changed"] and not counts["protected"]:
            out.append("nothing would change")
        return out


def signature(satellite: Column, lat: Column, lon: Column, acquired: Column) -> list[Column]:
    """What makes two detections the same: trimmed satellite, place to four decimals, time in UTC without a zone; a missing name is empty, a missing coordinate 0."""
    place = lambda x: F.bround(F.coalesce(x.cast("double"), F.lit(0.0)), 4) + F.lit(0.0)
    return [F.trim(F.coalesce(satellite, F.lit(""))).alias("__sat"), place(lat).alias("__lat"), place(lon).alias("__lon"), acquired.cast("timestamp_ntz").alias("__at")]


def reclassified(existing: DataFrame, known: DataFrame, live: str = "firms_live") -> DataFrame:
    """Existing rows with synthetic and source of the known row of their signature, and __action: unmatched, protected, unchanged or changed.

    Both sides: (satellite, lat, lon, acq, synthetic, source). Of known rows of one signature the least (synthetic,
    source) counts. Rows whose source is the live feed's stay as they are; a missing source is never equal to a
    known one. __filled marks changed rows that had no source.
    """
    key = signature(F.col("satellite"), F.col("lat"), F.col("lon"), F.col("acq"))
    names = ["__sat", "__lat", "__lon", "__at"]
    right = known.select(*key, F.struct("synthetic", "source").alias("x")).groupBy(*names).agg(F.min("x").alias("__new"))
    rows = existing.select("*", *key)
    same = F.lit(True)
    for n in names:
        same = same & rows[n].eqNullSafe(right[n])
    rows = rows.join(right, same, "left").drop(*names)
    source = F.nullif(F.trim(F.coalesce("source", F.lit(""))), F.lit(""))
    equal = F.coalesce(F.col("synthetic"), F.lit(False)).eqNullSafe(F.col("__new.synthetic")) & source.eqNullSafe(F.col("__new.source"))
    action = F.when(F.col("__new").isNull(), "unmatched").when(source.eqNullSafe(F.lit(live)), "protected").when(equal, "unchanged").otherwise("changed")
    rows = rows.withColumn("__action", action)
    changed = F.col("__action") == "changed"
    made = {"synthetic": F.when(changed, F.col("__new.synthetic")).otherwise(F.col("synthetic")), "source": F.when(changed, F.col("__new.source")).otherwise(F.col("source"))}
    return rows.withColumn("__filled", changed & source.isNull()).select(*[made.get(c, F.col(c)).alias(c) for c in existing.columns], "__action", "__filled")


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows that count their actions while they are written."""
    seen = Observation(name)
    is_ = lambda *a: F.count_if(F.col("__action").isin(*a))
    counts = [F.count(F.lit(1)).alias("scanned"), is_("protected", "unchanged", "changed").alias("matched"), is_("protected").alias("protected"), is_("unchanged").alias("unchanged"), is_("changed").alias("changed"), F.count_if("__filled").alias("filled")]
    return rows.observe(seen, *counts).drop("__action", "__filled"), seen


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """The staged table under the table's name; the old one goes only once the new one stands."""
    fs, at = files_of(spark, path)
    _, new = files_of(spark, staged)
    _, aside = files_of(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    if not fs.rename(at, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, at):
        fs.rename(aside, at)
        raise OSError(f"can't put the staged table in place of {path}")
    fs.delete(aside, True)


def guarded_update(spark: SparkSession, path: str, known: DataFrame, expected: Expected | None = None, dry_run: bool = False, live: str = "firms_live") -> dict:
    """Rewrites the Parquet table of detections at ``path`` by known signatures if the counts of the pass are as expected; says what it did.

    One pass reads the table, writes it to a folder beside it and counts as it writes. If an expectation is violated,
    the folder goes and the table stays as it was; so it does on a dry run, which writes nothing at all.
    Returned: the counts, anomalies, and replaced.
    """
    expected = expected or Expected()
    rows, seen = observed(reclassified(spark.read.parquet(path), known, live), f"guarded-{uuid.uuid4().hex}")
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    if dry_run:
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.write.parquet(staged)
    counts = {name: int(seen.get.get(name) or 0) for name in COUNTS}
    anomalies = expected.anomalies(counts)
    replaced = False
    if not dry_run:
        if anomalies or not counts["changed"]:
            fs, new = files_of(spark, staged)
            fs.delete(new, True)
        else:
            put_in_place(spark, staged, path)
            replaced = True
    return {**counts, "anomalies": anomalies, "replaced": replaced}
