"""Trees of files: what to read, how to decode it, and which language it is in."""

from __future__ import annotations

import fnmatch
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.extract.rules import load

MOST_BYTES = 1 << 20
# Directories that hold no source of their own, and files of instructions for tools.
NEVER = {"target", "node_modules", "__pycache__"}
AT_ROOT = {"tmp", "vendor"}
HIDDEN_KEPT = {".github": {"workflows", "actions", "scripts"}}
INSTRUCTIONS = {"AGENTS.md", "CLAUDE.md", "GEMINI.md", "copilot-instructions.md", ".cursorrules"}
IGNORE_FILES = (".gitignore", ".treeignore")


class Ignore:
    """Patterns of ignore files: last match wins, '!' takes back, a slash anchors, a trailing slash means directories."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str, bool, bool]] = []

    def add(self, folder: str, text: str) -> None:
        for raw in text.splitlines():
            line = raw.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            self.rules.append((folder, line if anchored else f"**/{line}", keep, only_dirs))

    def ignored(self, path: str, is_dir: bool) -> bool:
        out = False
        for folder, pattern, keep, only_dirs in self.rules:
            if only_dirs and not is_dir or folder and not path.startswith(folder + "/"):
                continue
            if _glob(pattern).fullmatch(path[len(folder) + 1 :] if folder else path):
                out = not keep
        return out


def _glob(pattern: str) -> re.Pattern:
    parts = []
    for part in pattern.split("/"):
        parts.append(".*" if part == "**" else fnmatch.translate(part).replace("(?s:", "", 1).replace(r")\Z", "").replace(r")\z", "").replace(".*", "[^/]*"))
    text = "/".join(parts).replace(".*/", "(?:.*/)?")
    return re.compile(text)


def listing(root: str, instructions: bool = False) -> list[tuple[str, int, int]]:
    """(path, size, mtime in ns) of every file below root in order of path; links aren't followed."""
    out, ignore = [], Ignore()
    for folder, dirs, names in os.walk(root, followlinks=False):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        for name in IGNORE_FILES:
            if name in names:
                ignore.add(rel, (Path(folder) / name).read_text(errors="replace"))
        top = rel.split("/")[0]
        kept = []
        for d in sorted(dirs):
            path = f"{rel}/{d}" if rel else d
            if d in NEVER or (not rel and d in AT_ROOT) or (d == "dist" and "package.json" in names) or os.path.islink(os.path.join(folder, d)):
                continue
            if d.startswith(".") and d not in HIDDEN_KEPT or rel in HIDDEN_KEPT and d not in HIDDEN_KEPT[rel]:
                continue
            if not ignore.ignored(path, True):
                kept.append(d)
        dirs[:] = kept
        for name in names:
            path = f"{rel}/{name}" if rel else name
            full = os.path.join(folder, name)
            if os.path.islink(full) or not os.path.isfile(full) or ignore.ignored(path, False) or (name in INSTRUCTIONS and not instructions) or (top in HIDDEN_KEPT and rel == top):
                continue
            info = os.stat(full)
            out.append((path, info.st_size, info.st_mtime_ns))
    return sorted(out)


def listing_frame(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(listing(root), "path string, size long, mtime long")


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-8 without mark, else Latin-1; null above a mebibyte."""
    utf8 = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else F.decode(content, "utf-8")
    text = F.coalesce(utf8, F.decode(content, "ISO-8859-1"))
    return F.when(F.length(content) <= MOST_BYTES, F.regexp_replace(text, "^﻿", ""))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, lang, size, mtime_ns, text) of a tree; contents are read by the executors, only paths by the driver."""
    rows = listing(root)
    if not rows:
        return spark.createDataFrame([], "file string, lang string, size long, mtime_ns long, text string")
    names = spark.createDataFrame([(f"{Path(root).resolve().as_uri()}/{p}", p, s, m) for p, s, m in rows], "path string, file string, size long, mtime_ns long")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "content")
    told = names.join(raw, "path").withColumn("text", decoded(F.col("content"))).filter("text is not null")
    return told.select("file", language(F.col("file"), F.col("text")).alias("lang"), "size", "mtime_ns", "text")


BY_NAME = {"Makefile": "make", "Dockerfile": "dockerfile", "Rakefile": "ruby", "Gemfile": "ruby", "Justfile": "just", "CMakeLists.txt": "cmake", "BUILD": "starlark", "WORKSPACE": "starlark"}
NEVER_CODE = ("toml", "csv", "tsv", "lock")


def language(path: Column, text: Column) -> Column:
    """By file name, then extension, then the first 4 KiB: an ``.m`` is Objective-C only if it looks like it, an ``.h`` may be
    C++; tables and lock files are never code. Null if unknown."""
    head = F.substring(text, 1, 4096)
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    out = F.lit(None).cast("string")
    for e, rules in load().items():
        out = F.when(ext == e, rules.language).otherwise(out)
    out = F.when(ext == ".m", F.when(head.rlike(r"@(interface|implementation|import|protocol)\b|#import\b"), "objc").otherwise("matlab")).otherwise(out)
    out = F.when((ext == ".h") & head.rlike(r"(?m)^\s*(class|namespace|template)\b"), "cpp").otherwise(out)
    out = F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".yml", ".yaml"), "yaml").when(ext == ".json", "json").when(ext == ".sql", "sql").when(ext.isin(".sh", ".bash"), "bash").otherwise(out)
    for key, value in BY_NAME.items():
        out = F.when(name == key, value).otherwise(out)
    shebang = F.regexp_extract(head, r"^#!.*?(python|ruby|node|bash|sh|perl|lua)", 1)
    out = F.coalesce(out, F.when(shebang != "", F.when(shebang == "node", "javascript").when(shebang == "sh", "bash").otherwise(shebang)))
    return F.when(~ext.isin([f".{e}" for e in NEVER_CODE]), out)
