"""Markdown sections, workflow files and API descriptions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_WORDS = 250
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^[ \t]*(```|~~~)")
_MENTION = re.compile(r"`([^`\n]{3,})`")


def sections(text: str) -> list[tuple[str, str, list[str], int, int]]:
    """(title, prose, mentions, first_line, last_line) of a Markdown text. Headings in fences don't count; a section goes on in a
    numbered one at the first blank line behind 250 words; a repeated title gets its number."""
    out: list[list] = []
    fence, title, lines, first, words, part = "", "", [], 1, 0, 1

    def close(last: int) -> None:
        prose = "\n".join(lines).strip()
        if title or prose:
            out.append([title if part == 1 else f"{title} ({part})", prose, sorted(set(_MENTION.findall(prose))), first, last])

    rows = text.split("\n")
    for n, raw in enumerate(rows, 1):
        line = raw.rstrip("\r")
        m = _FENCE.match(line)
        if m and (not fence or m[1] == fence):
            fence = "" if fence else m[1]
        head = None if fence or m else _HEADING.match(line)
        if head:
            close(n - 1)
            title, lines, first, words, part = head[2], [], n, 0, 1
            continue
        if not fence:
            words += len(line.split())
        lines.append(line)
        if not line.strip() and words > MOST_WORDS and not fence:
            close(n)
            lines, first, words, part = [], n + 1, 0, part + 1
    close(len(rows))
    count: dict[str, int] = {}
    for row in out:
        count[row[0]] = count.get(row[0], 0) + 1
        if count[row[0]] > 1:
            row[0] = f"{row[0]} [{count[row[0]]}]"
    return [tuple(r) for r in out]


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(file, ord, title, prose, mentions, first_line, last_line) of every document (file, text)."""
    kind = docs.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for k, row in enumerate(sections(text) if text else ()):
                    take.append(i)
                    rows.append((k, *row))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["file", "ord", "title", "prose", "mentions", "first_line", "last_line"])

    return docs.select("file", "text").mapInArrow(run, f"file {kind}, ord int, title string, prose string, mentions array<string>, first_line int, last_line int")


def workflow(text: str) -> tuple[list[tuple[str, int]], list[tuple[str, str]], list[tuple[str, str]]]:
    """Jobs (name, line), needs (job, other) and file references (job, path) of a CI workflow, read by indentation."""
    jobs, needs, refs = [], [], []
    inside, indent, job, listing = False, 0, "", False
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip():
            continue
        lead = len(line) - len(line.lstrip())
        if lead == 0:
            inside, indent, job = line.startswith("jobs:"), 0, ""
            continue
        if not inside:
            continue
        key = re.match(r"\s*([\w-]+):\s*(.*)$", line)
        if key and (not indent or lead == indent) and not line.lstrip().startswith("- "):
            indent, job = lead, key[1]
            jobs.append((job, n))
            continue
        if listing and (m := re.match(r"\s*-\s*([\w-]+)\s*$", line)):
            needs.append((job, m[1]))
            continue
        listing = False
        if key and key[1] == "needs":
            listed = re.findall(r"[\w-]+", key[2])
            needs.extend((job, x) for x in listed)
            listing = not listed
        for path in re.findall(r"uses:\s*['\"]?(\./[^\s'\"@]+)", line):
            refs.append((job, path[2:]))
        if re.search(r"\brun:|^\s{4,}\S", line):
            refs.extend((job, p.removeprefix("./")) for p in re.findall(r"(?:^|[\s'\"])((?:\./)?[\w.-]+(?:/[\w.-]+)+\.(?:sh|py|js|rb|pl|ps1|ts))\b", line))
    return jobs, needs, sorted(set(refs))


def openapi(text: str) -> list[tuple[str, str, str]]:
    """(operation, verb, path) of an API description in YAML or JSON, read by indentation and keys."""
    out, path, verb = [], "", ""
    for raw in text.split("\n"):
        if m := re.match(r"\s*[\"']?(/[^\s\"':]*)[\"']?\s*:\s*\{?\s*$", raw):
            path, verb = m[1], ""
        elif m := re.match(r"\s*[\"']?(get|post|put|patch|delete|head|options)[\"']?\s*:\s*\{?\s*$", raw):
            verb = m[1].upper()
            if path:
                out.append(["", verb, path])
        elif (m := re.match(r"\s*[\"']?operationId[\"']?\s*:\s*[\"']?([\w.-]+)", raw)) and out and verb:
            out[-1][0] = m[1]
    return [tuple(x) for x in out]


__all__ = ["markdown_sections", "openapi", "sections", "workflow"]
