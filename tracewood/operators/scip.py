"""Compiler indexes as graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.functions.text import trimmed
from tracewood.operators.spans import enclosing
from tracewood.session import Workspace


def symbol_name(symbol: Column) -> Column:
    """Bare name of a symbol's last descriptor; null for file-local symbols and namespaces."""
    last = F.regexp_extract(symbol, r"(\S+)$", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.regexp_replace(last, r"[.#/!:)(]+$", ""), r"([^/#.!:]*)$", 1), r"\(.*$", ""), r"^.*\]", "")
    return F.when(~symbol.startswith("local ") & ~last.endswith("/") & (bare != ""), bare)


def occurrences(table: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per occurrence with a name: occ_id, repo, file, line, symbol, name, is_def. Exact repeats count once, null ranges
    are line 0. The rows are written once, as everything below reads them several times and names cost regexes."""
    work = work or Workspace(table.sparkSession, "index")
    one = table.filter("occ_id is not null").select("occ_id", "repo", F.col("relative_path").alias("file"), F.coalesce(F.try_element_at("occ_range", F.lit(1)), F.lit(0)).alias("line"), trimmed("symbol").alias("symbol"), (F.coalesce(F.col("symbol_roles").bitwiseAND(1), F.lit(0)) == 1).alias("is_def"))
    useful = one.filter("symbol is not null and symbol <> '' and not symbol like 'local %'").distinct()
    return work.cut(useful.withColumn("name", symbol_name(F.col("symbol")))).filter("name is not null")


def edges(rows: DataFrame) -> DataFrame:
    """(caller, callee, uses) of occurrence rows: references to symbols that the index defines, from the last definition above
    them in the same file. References above all definitions belong to none, and nothing refers to itself."""
    defs = rows.filter("is_def")
    known = defs.select("symbol").distinct()
    scopes = defs.select("repo", "file", "line", F.col("symbol").alias("scope"))
    refs = rows.filter("not is_def").join(known, "symbol", "left_semi").select("repo", "file", "line", "symbol")
    placed = enclosing(scopes, refs, ["repo", "file"])
    return placed.filter("scope is not null and scope <> symbol").groupBy(F.col("scope").alias("caller"), F.col("symbol").alias("callee")).agg(F.count("*").alias("uses"))


def external(rows: DataFrame) -> DataFrame:
    """(symbol, uses): references to what no definition of the index holds."""
    known = rows.filter("is_def").select("symbol").distinct()
    return rows.filter("not is_def").join(known, "symbol", "left_anti").groupBy("symbol").agg(F.count("*").alias("uses"))


def upgrade(links: DataFrame, compiled: DataFrame) -> DataFrame:
    """Edges (src, dst, confidence) at the compiler's confidence where it confirms them, and those it adds."""
    sure = compiled.select("src", "dst", F.lit(2).alias("sure")).distinct()
    return links.join(sure, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("sure", "confidence").alias("confidence"))
