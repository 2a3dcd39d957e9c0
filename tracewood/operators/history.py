"""What changes together, and what a change puts at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewood.operators import spans

MOST_FILES = 30  # fixed value: a commit of more files says nothing about what belongs together


def usable(commits: DataFrame) -> DataFrame:
    """(commit, file) without repeats and without commits of more than ``MOST_FILES`` files."""
    one = commits.filter("commit is not null and file is not null").select("commit", "file").distinct()
    small = one.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_FILES).select("commit")
    return one.join(small, "commit")


def co_changes(commits: DataFrame, least: int = 2) -> DataFrame:
    """(file, partner, together, own, share) of files in at least ``least`` common commits; both directions."""
    one = usable(commits)
    own = one.groupBy("file").agg(F.count("*").alias("own"))
    pairs = one.join(one.withColumnRenamed("file", "partner"), "commit").filter("file < partner").groupBy("file", "partner").agg(F.count("*").alias("together")).filter(F.col("together") >= least)
    both = pairs.unionByName(pairs.select(F.col("partner").alias("file"), F.col("file").alias("partner"), "together"))
    return both.join(own, "file").select("file", "partner", "together", "own", F.round(F.col("together") / F.col("own"), 2).alias("share"))


def missed_partners(commits: DataFrame, diff: DataFrame) -> DataFrame:
    """(file, partner): files of a diff (file) whose partner changed with them at least three times and in half of their
    commits, and isn't in the diff."""
    near = co_changes(commits, 3).join(diff.select("file").distinct(), "file").filter(F.col("together") * 2 >= F.col("own"))
    return near.join(diff.select(F.col("file").alias("partner")).distinct(), "partner", "left_anti").select("file", "partner", "together", "own")


def risk(symbols: DataFrame) -> DataFrame:
    """symbols with ``level``: high for an untested symbol with callers or one with dangling callers, medium for a missed
    partner or dependents, else low. Columns: tested, callers, dangling, missed, dependents."""
    level = F.when((~F.col("tested") & (F.col("callers") > 0)) | (F.col("dangling") > 0), "high").when((F.col("missed") > 0) | (F.col("dependents") > 0), "medium").otherwise("low")
    return symbols.withColumn("level", level)


def without_trailers(body):
    """A commit body without its last paragraph if that holds trailers only."""
    return F.regexp_replace(body, r"(?s)(^|\n\n)([A-Za-z][A-Za-z-]*: [^\n]*\n?)+\s*$", "")


def change_history(commits: DataFrame, hunks: DataFrame, ranges: DataFrame, wanted: DataFrame, limit: int = 10, body_lines: int = 6) -> DataFrame:
    """(file, name, rank, sha, date, subject, body, body_lines_left_out): the latest commits that changed a definition.

    ``commits``: sha, ord (0 is the newest), date, subject, body; ``hunks``: sha, file, first, last; ``ranges``: sha, file, node
    (the name), first, last of the definitions *as the file was after that commit*; ``wanted``: file, name. A hunk counts for the
    innermost definitions it touches. Commits meet their own ranges only, so nothing grows with the length of the history.
    """
    asked = wanted.select("file", "name").distinct()
    near = hunks.join(asked.select("file").distinct(), "file", "left_semi").select("sha", "file", "first", "last").distinct()
    hit = spans.touched(near, ranges.join(asked.select("file").distinct(), "file", "left_semi"), key=["sha", "file"])
    mine = hit.withColumnRenamed("node", "name").join(asked, ["file", "name"]).join(commits, "sha")
    rank = F.row_number().over(Window.partitionBy("file", "name").orderBy("ord", "sha"))
    lines = F.split(F.coalesce(without_trailers(F.col("body")), F.lit("")), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)  # a last line end opens no line
    return mine.withColumn("rank", rank).filter(F.col("rank") <= limit).select(
        "file", "name", "rank", "sha", "date", "subject", F.array_join(F.slice(lines, 1, body_lines), "\n").alias("body"), F.greatest(F.size(lines) - body_lines, F.lit(0)).alias("body_lines_left_out")
    )
