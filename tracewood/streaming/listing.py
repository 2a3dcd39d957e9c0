"""Changes of a listing, and how they are taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, stored, current) of what was added, removed or changed between two listings (key, stamp)."""
    a, b = stored.select(key, F.col("stamp").alias("stored")), current.select(key, F.col("stamp").alias("current"))
    return a.join(b, key, "full_outer").filter(~F.col("stored").eqNullSafe(F.col("current")))


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, deleted) between two listings (path, mtime, size)."""
    a, b = previous.select("path", F.struct("mtime", "size").alias("was")), current.select("path", F.struct("mtime", "size").alias("now"))
    return a.join(b, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select("path", F.col("now").isNull().alias("deleted"))


def batches(events: DataFrame, key: str, ts: str, uid: str, gap_seconds: float) -> DataFrame:
    """(key, started, ended, changes): runs of changes that follow each other within the gap."""
    order = Window.partitionBy(key).orderBy(ts, uid)
    apart = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(order).cast("timestamp").cast("double")
    fresh = F.when(apart <= gap_seconds, 0).otherwise(1)
    numbered = events.select(key, ts, uid).withColumn("fresh", fresh).withColumn("batch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "batch").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("changes")).drop("batch")
