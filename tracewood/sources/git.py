"""History of git repositories as rows. Git runs on the driver; what it prints becomes a DataFrame."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

TIMEOUT, MOST_OUTPUT = 120, 64 << 20


def run(root: str, *args: str) -> str:
    """Output of a git command, without the repository's own hooks, pagers or helpers; too slow or too long is an error."""
    env = {**os.environ, "GIT_CONFIG_NOSYSTEM": "1", "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0"}
    command = ["git", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-c", "diff.external=", "-C", root, *args]
    with tempfile.TemporaryFile() as said, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said, env=env) as git:
        clock = threading.Timer(TIMEOUT, git.kill)
        clock.start()
        try:
            out = git.stdout.read(MOST_OUTPUT + 1)  # no more than this is ever held
            if len(out) > MOST_OUTPUT:
                git.kill()
                raise RuntimeError("git printed too much")
            code = git.wait()
        finally:
            late = not clock.is_alive()
            clock.cancel()
        if late:
            raise subprocess.TimeoutExpired(command, TIMEOUT)
        if code:
            said.seek(0)
            raise RuntimeError(said.read(10_000).decode(errors="replace").strip())
    return out.decode(errors="replace")


def revision(text: str) -> str:
    if text.startswith("-") or not text:
        raise ValueError("a revision must not begin with '-'")
    return text


def repositories(root: str, depth: int = 2) -> list[str]:
    """Repositories at root or at most two levels below; those whose config would run commands are refused."""
    out = []
    for folder, dirs, _ in os.walk(root):
        level = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        if ".git" in dirs and not _runs_commands(folder):
            out.append(folder)
        dirs[:] = [d for d in sorted(dirs) if not d.startswith(".")] if level < depth else []
    return out


def _runs_commands(folder: str) -> bool:
    try:
        with open(os.path.join(folder, ".git", "config"), errors="replace") as f:
            return re.search(r"(?im)^\s*(fsmonitor|sshcommand|hookspath|textconv|command|external|clean|smudge|process)\s*=", f.read()) is not None
    except OSError:
        return False


def parse_names(log: str) -> list[list[str]]:
    """Sorted distinct files per record of a name-only log (records begin with \\x1e); records above 30 files are dropped."""
    out = []
    for record in log.split("\x1e"):
        names = sorted({x.strip() for x in record.split("\n") if x.strip()})
        if 0 < len(names) <= 30:
            out.append(names)
    return out


def commits(spark: SparkSession, root: str, count: int = 500) -> DataFrame:
    """(repo, commit, ord, file) of the latest commits of every repository below root; paths begin with the repository."""
    rows = []
    for repo in repositories(root):
        prefix = os.path.relpath(repo, root)
        prefix = "" if prefix == "." else prefix + "/"
        log = run(repo, "log", "--no-merges", "--relative", "--name-only", f"-n{int(count)}", "--format=%x1e%H")
        for n, record in enumerate(x for x in log.split("\x1e") if x.strip()):
            sha, *names = [x.strip() for x in record.split("\n") if x.strip()]
            if 0 < len(set(names)) <= 30:
                rows.extend((prefix.rstrip("/"), sha, n, prefix + f) for f in sorted(set(names)))
    return spark.createDataFrame(rows, "repo string, commit string, ord int, file string")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(file, first, last) new-side lines of each hunk of a -U0 diff; a pure deletion has first > last. Content lines that look
    like headers don't count, as hunks say how many lines they hold."""
    out, file, old, new = [], None, 0, 0
    for line in text.split("\n"):
        if old > 0 or new > 0:
            if line.startswith("-"):
                old -= 1
                continue
            if line.startswith("+"):
                new -= 1
                continue
            if line.startswith("\\"):
                continue
        if m := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            old, new = int(m[1] or 1), int(m[3] or 1)
            first = int(m[2]) + (new == 0)
            if file:
                out.append((file, first, first + new - 1))
        elif line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            file = None if name == "/dev/null" else name.removeprefix("b/")
    return out


def diff_hunks(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """(file, first, last) of the working tree against a revision, untracked files as whole."""
    rows = parse_diff(run(root, "diff", "-U0", "--no-ext-diff", "--no-color", revision(rev)))
    rows += [(f, 1, 1 << 30) for f in run(root, "ls-files", "--others", "--exclude-standard").split("\n") if f]
    return spark.createDataFrame(rows, "file string, first int, last int")


def history(spark: SparkSession, root: str, count: int = 200) -> DataFrame:
    """(sha, date, subject, body, file, first, last) of the hunks of the latest commits."""
    log = run(root, "log", "--no-merges", "-p", "-U0", "--no-ext-diff", "--no-color", f"-n{int(count)}", "--date=short", "--format=%x1e%H%x1f%ad%x1f%s%x1f%b%x1f")
    rows = []
    for record in log.split("\x1e"):
        parts = record.split("\x1f", 4)
        if len(parts) == 5:
            rows.extend((*parts[:3], parts[3].strip(), f, a, b) for f, a, b in parse_diff(parts[4]))
    return spark.createDataFrame(rows, "sha string, date string, subject string, body string, file string, first int, last int")


def blobs(spark: SparkSession, root: str, wanted: list[tuple[str, str]], most: int = 8 << 20) -> DataFrame:
    """(sha, file, text) of files as they were after a commit, by one ``cat-file --batch``; missing ones, folders and those above
    ``most`` bytes are left out."""
    names = "".join(f"{revision(sha)}:./{file}\n" for sha, file in wanted if "\n" not in file)
    rows = []
    with tempfile.TemporaryFile() as ask:
        ask.write(names.encode())
        ask.seek(0)
        with subprocess.Popen(["git", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-C", root, "cat-file", "--batch"], stdin=ask, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={**os.environ, "GIT_CONFIG_NOSYSTEM": "1"}) as git:
            for sha, file in wanted:
                if "\n" in file:
                    continue
                head = git.stdout.readline().decode(errors="replace").split()
                if len(head) != 3 or not head[2].isdigit():
                    continue
                left, kept, size = int(head[2]) + 1, [], int(head[2])
                while left > 0:  # large ones are passed over in pieces
                    piece = git.stdout.read(min(left, 1 << 20))
                    if not piece:
                        break
                    left -= len(piece)
                    if size <= most:
                        kept.append(piece)
                if head[1] == "blob" and size <= most:
                    rows.append((sha, file, b"".join(kept)[:size].decode(errors="replace")))
    return spark.createDataFrame(rows, "sha string, file string, text string")


def change_history(spark: SparkSession, root: str, file: str, name: str, count: int = 200, limit: int = 10, body_lines: int = 6) -> DataFrame:
    """The latest commits of a file that changed one of its definitions, newest first; see ``operators.history.change_history``."""
    from pyspark.sql import functions as F

    from tracewood.extract.scanner import extract, facts
    from tracewood.operators import history as H
    from tracewood.operators.tools import line_ranges

    log = run(root, "log", "--no-merges", "--no-renames", "--relative", "-p", "-U0", "--no-ext-diff", "--no-textconv", "--no-color", f"-n{int(count)}", "--date=short", "--format=%x1e%H%x1f%ad%x1f%s%x1f%b%x1f", "--", file)
    told, hunks = [], []
    for n, record in enumerate(r for r in log.split("\x1e") if r.strip()):
        parts = record.split("\x1f", 4)
        if len(parts) == 5:
            told.append((parts[0].strip(), n, parts[1].strip(), parts[2].strip(), parts[3]))
            hunks.extend((parts[0].strip(), file, a, b) for f, a, b in parse_diff(parts[4]) if f == file)
    commits = spark.createDataFrame(told, "sha string, ord int, date string, subject string, body string")
    texts = blobs(spark, root, [(t[0], file) for t in told]).select(F.concat_ws(":", "sha", "file").alias("file"), "text")
    defines = facts(extract(texts), "defines").select("file", F.col("name").alias("node"), "start", "end")
    ranges = line_ranges(defines, texts).select(F.regexp_extract("file", r"^([^:]*):", 1).alias("sha"), F.lit(file).alias("file"), "node", "first", "last")
    return H.change_history(commits, spark.createDataFrame(hunks, "sha string, file string, first int, last int"), ranges, spark.createDataFrame([(file, name)], "file string, name string"), limit, body_lines)
