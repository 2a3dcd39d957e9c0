"""Definitions that nothing uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.operators.retrieval import mention_counts

# Files whose definitions are data or entry points.
DATA_EXTENSIONS = "json yaml yml xml svg css scss sass less html htm ini properties env cfg conf md markdown rst bib tex txt mk tf tfvars hcl proto graphql gql sql prisma toml mod h hh hpp hxx".split()
BUILD_FILES = "Makefile Justfile Dockerfile Rakefile Gemfile".split()


def is_test_symbol(file: Column, name: Column) -> Column:
    """By directory, by file name, or by the symbol's name."""
    lower, base = F.lower(file), F.regexp_extract(file, r"([^/\\]*)$", 1)
    by_dir = lower.rlike(r"(^|[/\\])(test|tests|spec|specs|__tests__|testing)[/\\]")
    by_file = F.lower(base).rlike(r"^test_|_test\.|\.test\.|\.spec\.|_spec\.|-test\.|-spec\.") | F.regexp_extract(base, r"^([^.]*)", 1).rlike(r"Tests?$")
    return by_dir | by_file | name.rlike(r"^test_|^Test[A-Z_]|^test[A-Z]")


def is_test_path(file: Column) -> Column:
    """The resolver's own, different rule: by path parts, also testdata but not specs."""
    return file.rlike(r"(^|[/\\])(test|tests|testing|testdata|__tests__|spec)[/\\]") | F.regexp_extract(file, r"([^/\\]*)$", 1).rlike(r"^test_|_test\.|\.test\.|\.spec\.")


def is_callback(file: Column, name: Column) -> Column:
    """Names a framework builds: accessors of beans, visitors and handlers."""
    return (name.rlike(r"^(get|set|is)[A-Z]") & file.rlike(r"\.(java|kt|groovy)$")) | name.rlike(r"^(visit_|depart_|on_)|^On[A-Z]")


def find_unused(defs: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """(node, file, name): definitions (node, file, name) without another node's link (caller, callee), of a kind that calls could
    reach, whose name the texts (file, text) don't write more often than it is defined. With ``start`` (byte offset) definitions that
    are annotated, implement a trait or are called by an engine are left out as well."""
    called = links.filter("caller <> callee").select(F.col("callee").alias("node")).distinct()
    base, ext = F.regexp_extract("file", r"([^/\\]*)$", 1), F.lower(F.regexp_extract("file", r"\.([^./\\]*)$", 1))
    named = F.col("name")
    skip = ext.isin(DATA_EXTENSIONS) | base.isin(BUILD_FILES) | named.isin("main", "<module>") | named.contains(".") | named.rlike("^__.*__$") | F.lower("file").rlike(r"testdata/|fixtures/") | is_test_symbol(F.col("file"), named) | is_callback(F.col("file"), named)
    loose = defs.filter(~skip).join(called, "node", "left_anti")
    wanted = loose.groupBy("name").agg(F.count("*").alias("defined"))
    seen = mention_counts(files, wanted)
    rare = wanted.join(seen, "name", "left").filter(F.coalesce("mentions", F.lit(0)) <= F.col("defined")).select("name")
    found = loose.join(rare, "name")
    if "start" in defs.columns:  # texts are looked into for the few that are left
        from tracewood.operators.marks import exempt

        found = found.join(exempt(found, files), "node", "left_anti")
    return found.select("node", "file", "name")


def repeated_directories(defs: DataFrame, least: int = 500, share: float = 0.8) -> DataFrame:
    """(dir, definitions, repeated): directories of at most two levels most of whose definitions, by name and extension, also
    occur in another directory."""
    placed = defs.select("name", F.lower(F.regexp_extract("file", r"\.([^./\\]*)$", 1)).alias("ext"), F.regexp_extract(F.regexp_replace("file", r"\\", "/"), r"^((?:[^/]+/){1,2})", 1).alias("dir"))
    by = placed.groupBy("name", "ext", "dir").agg(F.count("*").alias("n"))
    spread = by.groupBy("name", "ext").agg(F.count("*").alias("dirs"))
    told = by.join(spread, ["name", "ext"]).groupBy("dir").agg(F.sum("n").alias("definitions"), F.sum(F.when(F.col("dirs") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    return told.filter((F.col("definitions") >= least) & (F.col("repeated") >= share * F.col("definitions")))
