"""Taking in changed files: the same graph whether they come one by one or in one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewood.extract.scanner import extract, facts
from tracewood.operators.graph import union_view
from tracewood.sources.store import Store

COMPACT_AFTER = 1000  # fixed value: changes at which the delta is folded into the base


def newest(changes: DataFrame) -> DataFrame:
    """Last change of each path (path, ord, text or null for a deletion) in a batch."""
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ord")))).filter("_n = 1").drop("_n")


def apply(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """New fact tables (definitions, calls): the rows of changed and deleted files go, those of the new texts come."""
    new, gone = read_changes(changes)
    return {n: t.join(gone, "file", "left_anti").select(new[n].columns).unionByName(new[n]) for n, t in tables.items()}


def read_changes(changes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Facts of the changed files' new texts, and (file) of all changed and deleted ones."""
    last = newest(changes)
    fresh = extract(last.filter("text is not null"), "path", "text", "path")
    return {"definitions": facts(fresh, "defines"), "calls": facts(fresh, "calls")}, last.select(F.col("path").alias("file"))


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "definitions": spark.createDataFrame([], "file string, seq int, name string, start int, end int, doc string"),
        "calls": spark.createDataFrame([], "file string, seq int, caller string, callee string, has_receiver boolean"),
    }


def watch(changes: DataFrame, store: Store, checkpoint: str, interval: str = "250 milliseconds", notify: Callable[[int], None] | None = None) -> StreamingQuery:
    """Streams changes (path, ord, text) into snapshots: each micro-batch publishes a version and writes only the parts of the
    tables that hold its files. A batch that is repeated after a failure replaces the same files by the same facts, so publishing it
    twice changes nothing."""

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        version = store.replace_files(*read_changes(batch))
        batch.unpersist()
        if notify:
            notify(version)

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def compact(base: DataFrame, added: DataFrame, tombstones: DataFrame, least: int = COMPACT_AFTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds the delta into the base once it holds ``least`` changes; else gives all three back."""
    if added.count() + tombstones.count() < least:
        return base, added, tombstones
    return union_view(base, added, tombstones), added.limit(0), tombstones.limit(0)


def reread(changed: DataFrame, bases: DataFrame) -> DataFrame:
    """(file): files that name a class (file, base) which a change defines (name), to be read again."""
    return bases.join(changed.select(F.col("name").alias("base")).distinct(), "base").select("file").distinct()


def walk_pause(walk_seconds: float, idle_rounds: int, least: float = 0.25, most: float = 2.0) -> float:
    """Seconds until the next listing: doubling while nothing changes, never below ten times the last walk."""
    return max(min(most, least * 2**idle_rounds), 10 * walk_seconds)
