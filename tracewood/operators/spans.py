"""Intervals: innermost ranges, overlaps, enclosing definitions and change hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def innermost(points: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, at, node): the shortest range (file, node, start, end) around each point (file, at), ties to the lower node.

    Ranges are laid into blocks, so a point meets only ranges of its own block instead of all of its file.
    """
    laid = ranges.filter("start < end").select("file", "node", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    met = points.select("file", "at", F.floor(F.col("at") / block).alias("block")).join(laid, ["file", "block"]).filter("start <= at and at < end")
    return met.groupBy("file", "at").agg(F.min(F.struct(F.col("end") - F.col("start"), "node")).alias("best")).select("file", "at", F.col("best.node").alias("node"))


def parents(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, parent): the shortest other range that holds a range and is longer."""
    laid = ranges.filter("start < end").select("file", F.col("node").alias("parent"), F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    met = ranges.filter("start < end").withColumn("block", F.floor(F.col("start") / block)).join(laid, ["file", "block"]).filter("a <= start and b >= end and (b - a) > (end - start)")
    return met.groupBy("node").agg(F.min(F.struct(F.col("b") - F.col("a"), "parent")).alias("best")).select("node", F.col("best.parent").alias("parent"))


def partial_overlaps(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of ranges of a file that overlap though neither holds the other. A pair is found in the block where the
    later one begins, so once."""
    laid = ranges.filter("start < end").select("file", F.col("node").alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    later = ranges.filter("start < end").select("file", F.col("node").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.floor(F.col("start") / block).alias("block"))
    return laid.join(later, ["file", "block"]).filter("s1 < s2 and s2 < e1 and e1 < e2").select("a", "b")


def enclosing(scopes: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """points with ``scope``: the last scope (key, line, scope) that begins at or above a point (key, line, ...) of its group.

    An as-of join without a join: both are put in one order and the last scope is carried down.
    """
    extra = [c for c in points.columns if c not in (*key, "line")]
    a = scopes.select(*key, "line", F.lit(0).alias("_kind"), "scope", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra])
    b = points.select(*key, "line", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("scope"), *extra)
    order = Window.partitionBy(*key).orderBy("line", "_kind", "scope").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("scope", F.last("scope", ignorenulls=True).over(order)).filter("_kind = 1").drop("_kind")


def hunk_lines(header: Column) -> Column:
    """(first, last) new lines of a unified-diff hunk header; a pure deletion gives first > last; no header gives null."""
    start = F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 1)
    size = F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 2)
    first = F.when(start != "", start.cast("int"))
    count = F.when(size == "", 1).otherwise(F.when(size != "", size.cast("int")))
    begin = F.when(count == 0, first + 1).otherwise(first)
    return F.when(first.isNotNull(), F.struct(begin.alias("first"), (begin + count - 1).alias("last")))


def touched(hunks: DataFrame, ranges: DataFrame, key: list[str] | None = None, block: int = 256) -> DataFrame:
    """(*key, node): ranges (*key, node, first, last in lines) hit by a hunk (*key, first, last) that hold no other hit range of
    it. A pure deletion (first above last) is a point and must lie strictly inside.

    Hunks and ranges meet in blocks of lines; a pair counts in the first block both lie in. Of a hunk's ranges in order of
    falling start, one holds another if an earlier one ends no later, so hits are never paired with each other.
    """
    key = key or ["file"]
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(F.greatest(a, b) / block)))
    h = hunks.select(*key, F.col("first").alias("h1"), F.col("last").alias("h2")).withColumn("block", spread(F.col("h1"), F.col("h2")))
    r = ranges.select(*key, "node", "first", "last").filter("first <= last").withColumn("block", spread(F.col("first"), F.col("last")))
    met = h.join(r, [*key, "block"]).filter(F.col("block") == F.floor(F.greatest("h1", "first") / block))
    met = met.filter("(h1 <= h2 and first <= h2 and h1 <= last) or (h1 > h2 and first < h1 and h1 <= last)").select(*key, "h1", "h2", "node", "first", "last")
    shapes = met.select(*key, "h1", "h2", "first", "last").distinct()
    inner = F.min("last").over(Window.partitionBy(*key, "h1", "h2").orderBy(F.desc("first"), "last").rowsBetween(Window.unboundedPreceding, -1))
    least = shapes.withColumn("inner", inner).filter("inner is null or inner > last").drop("inner")
    return met.join(least, [*key, "h1", "h2", "first", "last"], "left_semi").select(*key, "node").distinct()


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes start..end of a text's UTF-8."""
    raw = F.encode(text, "utf-8")
    return F.decode(F.substring(raw, start + 1, end - start), "utf-8")
