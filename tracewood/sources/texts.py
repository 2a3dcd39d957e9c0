"""Small written inputs: architecture rules, contract manifests and question files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewood.model import INFERRED, confidence_floor


def architecture_rules(text: str) -> list[tuple[str, str, str, int | None]]:
    """(kind, from, to, floor) of ``deny a -> b [confidence]`` and ``no-cycles [confidence]`` lines; '#' begins a comment and any
    other line is an error."""
    out = []
    for n, raw in enumerate(text.splitlines(), 1):
        words = raw.split("#")[0].split()
        if not words:
            continue
        if words[0] == "deny" and len(words) in (4, 5) and words[2] == "->":
            out.append(("deny", words[1], words[3], confidence_floor(words[4]) if len(words) == 5 else INFERRED))
        elif words[0] == "no-cycles" and len(words) <= 2:
            out.append(("no-cycles", "", "", confidence_floor(words[1]) if len(words) == 2 else None))
        else:
            raise ValueError(f"line {n} is no rule: {raw.strip()}")
    return out


def contract_manifest(text: str, repo: str) -> tuple[list[tuple[str, str, str, str, int]], list[tuple[str, str, str, str]]]:
    """Exports (repo, package, version, contract, ord) and imports (repo, package, version, contract) of a manifest."""
    data = json.loads(text)
    if data.get("schema") not in ("contracts.v1", 1):
        raise ValueError("unknown schema of contracts")
    package = data["package"]
    exports = [(repo, package["name"], package["version"], c if isinstance(c, str) else c["contract"], n) for n, c in enumerate(data.get("exports", []))]
    imports = [(repo, i["package"], i["version"], i["contract"]) for i in data.get("imports", [])]
    return exports, imports


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """(set, question, expected): a line at the margin is a question, indented lines below it are what it should find."""
    lines = spark.read.text(path).select(F.input_file_name().alias("set"), "value", F.monotonically_increasing_id().alias("line")).filter("trim(value) <> '' and not ltrim(value) like '#%'")
    order = Window.partitionBy("set").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    asked = lines.withColumn("question", F.last(F.when(~F.col("value").rlike(r"^\s"), F.trim("value")), ignorenulls=True).over(order))
    return asked.filter(F.col("value").rlike(r"^\s") & F.col("question").isNotNull()).select("set", "question", F.trim("value").alias("expected"))
