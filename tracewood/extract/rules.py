"""Rule files: what a language's definitions look like. Read from TOML, checked strictly, hashed into the snapshot."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass
from pathlib import Path

MOST_BYTES, MOST_ENTRIES = 64 * 1024, 128  # fixed values of the schema
KEYS = {"schema_version", "language", "lexer", "family", "extensions", "definitions", "classes", "methods", "constants", "self"}
FAMILIES = {"brace", "indent", "end"}
FOLDER = Path(__file__).resolve().parent.parent / "rules"


@dataclass(frozen=True)
class Rules:
    language: str
    lexer: str
    family: str
    extensions: tuple[str, ...]
    definitions: frozenset[str]
    classes: frozenset[str]
    methods: bool = False
    constants: bool = True
    receivers: frozenset[str] = frozenset({"self", "this", "super", "cls"})


def parse(raw: bytes) -> Rules:
    """Rules of one file; anything unknown, repeated, blank or too large is an error."""
    if len(raw) > MOST_BYTES:
        raise ValueError("rule file too large")
    data = tomllib.loads(raw.decode("utf-8"))
    if extra := set(data) - KEYS:
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    if data.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    if data.get("family") not in FAMILIES:
        raise ValueError(f"family must be one of {', '.join(sorted(FAMILIES))}")
    for key in ("extensions", "definitions", "classes", "self"):
        words = data.get(key, [])
        if not isinstance(words, list) or len(words) > MOST_ENTRIES or len(set(words)) != len(words) or any(not isinstance(w, str) or not w or w != w.strip() or " " in w for w in words):
            raise ValueError(f"{key}: at most {MOST_ENTRIES} distinct words without blanks")
    if not data.get("language") or not data.get("extensions"):
        raise ValueError("language and extensions are needed")
    return Rules(
        data["language"], data.get("lexer", "c"), data["family"], tuple(data["extensions"]), frozenset(data.get("definitions", ())), frozenset(data.get("classes", ())), bool(data.get("methods", False)), bool(data.get("constants", True)), frozenset(data.get("self", ["self", "this", "super", "cls"]))
    )


def load(folder: Path = FOLDER) -> dict[str, Rules]:
    """Rules by extension; two files must not claim one."""
    out: dict[str, Rules] = {}
    for path in sorted(folder.glob("*.toml")):
        rules = parse(path.read_bytes())
        for ext in rules.extensions:
            if ext in out:
                raise ValueError(f"{ext} is claimed by {out[ext].language} and {rules.language}")
            out[ext] = rules
    return out


def identity(folder: Path = FOLDER) -> str:
    """Hash of the whole rule set; a snapshot made with another one is stale."""
    h = hashlib.sha256()
    for path in sorted(folder.glob("*.toml")):
        h.update(path.name.encode() + b"\0" + path.read_bytes() + b"\0")
    return h.hexdigest()
