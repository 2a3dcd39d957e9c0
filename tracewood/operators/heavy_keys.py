"""Per-key results where a few keys hold most rows.

Map-side combining: rows meet once on something evenly spread (their id, or key and group together), where repeated rows fall
away; each of those partitions then combines what it holds into one compact, mergeable state per key, in hash tables that
spill, and only these states are shuffled on the skewed key. The work of a heavy key is bounded by the number of partitions and
not by its rows. All aggregates are native algebraic ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.functions.text import fingerprint, global_symbol, trimmed
from tracewood.session import Workspace


def key_figures(rows: DataFrame, key: Column, uid: str, group: list[str], flag: Column) -> DataFrame:
    """uses (distinct ``uid``), groups (distinct ``group``) and flagged uses of each non-null key.

    Repeated rows with one uid count once; a uid seen under two keys counts for each. A row without uid can't be told
    from its copies and counts not at all; null parts of ``group`` are values. No rows give no rows.
    """
    a, b = fingerprint(*group)
    told = rows.select(F.col(uid).alias("_uid"), key.alias("_key"), a.alias("_g1"), b.alias("_g2"), F.coalesce(flag, F.lit(False)).alias("_flag")).filter(F.col("_key").isNotNull() & F.col("_uid").isNotNull())
    # the one shuffle of rows; both groupings below find theirs together
    once = told.repartition("_key", "_g1", "_g2").groupBy("_key", "_g1", "_g2", "_uid").agg(F.max("_flag").alias("_flag"))
    spread = once.groupBy("_key", "_g1", "_g2").agg(F.count("*").alias("_uses"), F.sum(F.col("_flag").cast("long")).alias("_flagged"))
    return spread.groupBy("_key").agg(F.sum("_uses").alias("uses"), F.count("*").alias("groups"), F.sum("_flagged").alias("flagged"))


PLACES = 4096  # places that uids are spread over; each has its own counts


def keys_above_share(rows: DataFrame, key: Column, uid: str, share: tuple[int, int], work: Workspace | None = None) -> DataFrame:
    """Keys that hold at least ``share`` (numerator, denominator) of all distinct uids, those without a key included.

    One scan and one shuffle of rows, by the place of the evenly spread uid: repeated rows fall away there, and every place
    counts its keys for itself. These counts are written once. A key with the share of all uids has it in some place at least, so
    only the counts of such keys are added up; counts of rare keys never travel. A place has at most 1 / ``share`` of them, which
    bounds what is broadcast: for a hundredth, 100 keys of each of ``PLACES``, and far fewer distinct ones. No rows give no rows.
    """
    work = work or Workspace(rows.sparkSession, "heavy-keys")
    top, bottom = share
    placed = rows.select(F.pmod(F.xxhash64(uid), F.lit(PLACES)).cast("short").alias("_place"), F.col(uid).alias("_uid"), key.alias("_key")).filter(F.col("_uid").isNotNull()).repartition("_place")
    local = work.cut(placed.distinct().groupBy("_place", "_key").agg(F.count("*").alias("_n")))
    sums = local.groupBy("_place").agg(F.sum("_n").alias("_all"))
    large = local.filter(F.col("_key").isNotNull()).join(F.broadcast(sums), "_place").filter(F.col("_n") * bottom >= F.col("_all") * top).select("_key").distinct()
    counts = local.join(F.broadcast(large), "_key").groupBy("_key").agg(F.sum("_n").alias("_n"))
    total = local.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") * bottom >= F.col("_total") * top).select(F.col("_key").alias("key"), F.col("_n").alias("uses"), F.col("_total").alias("total"))


def symbol_figures(occurrences: DataFrame) -> DataFrame:
    """Uses, files and definitions of every symbol of the occurrence table."""
    figures = key_figures(occurrences, global_symbol("symbol"), "occ_id", ["repo", "relative_path"], F.col("symbol_roles").bitwiseAND(1) == 1)
    return figures.select(F.col("_key").alias("symbol"), "uses", F.col("groups").alias("files"), F.col("flagged").alias("definitions"))


def heavy_symbols(occurrences: DataFrame, share: tuple[int, int] = (1, 100)) -> DataFrame:
    """Symbols with at least ``share`` of all occurrences."""
    return keys_above_share(occurrences, global_symbol("symbol"), "occ_id", share).select(F.col("key").alias("symbol"), "uses", "total")


__all__ = ["heavy_symbols", "key_figures", "keys_above_share", "symbol_figures", "trimmed"]
