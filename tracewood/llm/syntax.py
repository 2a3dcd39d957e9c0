"""Source files that don't parse: one packrat grammar per language, over whole texts.

The language is that of the file's extension by the rule files; the whole input must be consumed. Files that fail are
parsed once more with bookkeeping for the furthest refused token, which gives the place and the likely cause.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.functions.text import latest
from tracewood.llm.grammars import LANGUAGES, grammar

RULES = 10_000  # the most rows of rule files and extensions; both are small fixed tables
DEPTH = 1_000_000
_MARKER = re.compile(r"^(?:<{7}|\|{7}|>{7}) \S|^={7}\r?$", re.M)


def extensions(rules: DataFrame) -> dict[str, str]:
    """Extension to language by the highest revision of each language; of two languages that claim one the first by name."""
    rows = rules.select("language", "revision", "extensions").filter("language is not null").limit(RULES + 1).collect()
    if len(rows) > RULES:
        raise ValueError(f"more than {RULES} rule files")
    newest: dict[str, tuple[int, list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r["revision"] if r["revision"] is not None else -1, sorted(e for e in r["extensions"] or [] if e))):
        newest[r["language"]] = (r["revision"], r["extensions"] or [])
    out: dict[str, str] = {}
    for language in sorted(newest, reverse=True):
        out.update({e.lower(): language for e in newest[language][1] if e})
    return out


def language_of(path: Column, by_extension: dict[str, str]) -> Column:
    """The language of a path, the longest extension first; null if no rule names its extension."""
    out = F.lit(None).cast("string")
    for ext in sorted(by_extension, key=lambda e: (len(e), e)):
        out = F.when(F.lower(path).endswith(ext), by_extension[ext]).otherwise(out)
    return out


def well_formed(language: str, text: str) -> bool:
    tokens = LANGUAGES[language][0](text)
    end, _ = grammar(language).build()(tokens.types, tokens.breaks, tokens.gaps)
    return end >= 0


def failure(language: str, text: str) -> tuple[int, str]:
    """Furthest refused place (characters) and cause of a text that isn't well-formed."""
    tokens = LANGUAGES[language][0](text)
    _, far = grammar(language).build(True)(tokens.types, tokens.breaks, tokens.gaps)
    far = min(far, len(tokens.types) - 1)
    at, kind = tokens.starts[far], tokens.types[far]
    if "\0" in text or "�" in text:
        cause = "binary"
    elif _MARKER.search(text):
        cause = "merge conflict"
    elif kind == "EOF" or (kind == "BAD" and not text[tokens.ends[far] :].strip("\n\r \t")) or (kind in ("NL", "DEDENT") and not text[at:].strip()):
        cause = "truncated"
    elif kind == "BAD":
        cause = "open or stray token"
    else:
        cause = "unexpected token"
    return at, cause


def parse_files(files: DataFrame, rules: DataFrame, explain: bool = False) -> DataFrame:
    """file_id, repo, language, well_formed (and with ``explain`` position and cause) of every file's present state.

    Files are parsed where they are read and only verdicts are shuffled to find each file's latest state. Files whose
    extension is in no rule, or in one of a language without grammar, and rows without file_id or path are left out. A
    null, empty or blank text is well-formed. Rows repeated or of equal indexed_at give one verdict. No files give no rows.
    """
    known = {e: lang for e, lang in extensions(rules).items() if lang in LANGUAGES}
    schema = "file_id bigint, repo string, language string, indexed_at timestamp, well_formed boolean, position int, cause string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        for batch in batches:
            good, places, causes = [], [], []
            known: dict[tuple[str, str], tuple[bool, int | None, str | None]] = {}  # repeated texts of a batch are parsed once
            for language, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if (language, text) not in known:
                    ok = not text or not text.strip() or well_formed(language, text)
                    known[language, text] = (ok, *(failure(language, text) if explain and not ok else (None, None)))
                ok, at, cause = known[language, text]
                good.append(ok)
                places.append(at)
                causes.append(cause)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(good, pa.bool_()), pa.array(places, pa.int32()), pa.array(causes, pa.string())], names=["file_id", "repo", "language", "indexed_at", "well_formed", "position", "cause"])

    chosen = files.select("file_id", "repo", language_of(F.col("relative_path"), known).alias("language"), F.col("indexed_at").cast("timestamp").alias("indexed_at"), "text").filter("file_id is not null and language is not null")
    verdicts = chosen.mapInArrow(run, schema)
    return latest(verdicts if explain else verdicts.drop("position", "cause"), "file_id", "indexed_at").drop("indexed_at")


def malformed_rates(verdicts: DataFrame) -> DataFrame:
    """Files, malformed files and their rate per repo and language."""
    return verdicts.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum((~F.col("well_formed")).cast("long")).alias("malformed")).withColumn("rate", F.round(F.col("malformed") / F.col("files"), 6))
