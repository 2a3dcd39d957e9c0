"""Queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.llm.handwritten import not_handwritten
from tracewood.llm.packing import fill_report, mixture_report, pack
from tracewood.llm.pairs import code_pairs, documented_functions
from tracewood.llm.syntax import malformed_rates, parse_files
from tracewood.llm.terms import all_terms
from tracewood.llm.tokens import encode_texts
from tracewood.llm.topics import composition, subjects_of
from tracewood.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).filter("mark is not null").select("field", "term", "mark")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return all_terms(table(spark, folder, "scip_occurrence"), table(spark, folder, "scip_document"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_reasons(spark, folder).select("file_id")


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(table(spark, folder, "scip_document"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(table(spark, folder, "symbol_registry"), table(spark, folder, "scip_document")).select("node")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return code_pairs(table(spark, folder, "symbol_registry"), table(spark, folder, "scip_document"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse_files(table(spark, folder, "scip_document"), table(spark, folder, "rule_file")).filter(~F.col("well_formed")).select("file_id")


def p6_causes(spark: SparkSession, folder: str) -> DataFrame:
    return parse_files(table(spark, folder, "scip_document"), table(spark, folder, "rule_file"), explain=True).filter(~F.col("well_formed")).drop("well_formed")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return malformed_rates(parse_files(table(spark, folder, "scip_document"), table(spark, folder, "rule_file")))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), table(spark, folder, "container_kind"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_containers(spark, folder), table(spark, folder, "container_kind"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_report(p8_containers(spark, folder), table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects_of(table(spark, folder, "documents"), table(spark, folder, "subject_label"), table(spark, folder, "subject_area"))


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    return composition(p9_found(spark, folder), table(spark, folder, "documents"))


_ALL = (p1_found, p1_terms, p2_found, p2_reasons, p5_found, p5_pairs, p6_found, p6_causes, p6_rates, p7_ids, p8_containers, p8_fill, p8_mixture, p9_found, p9_composition)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_SYMBOL = r"CASE WHEN trim(symbol, E' \t') <> '' AND NOT starts_with(trim(symbol, E' \t'), 'local ') THEN trim(symbol, E' \t') END"
_TERMS = rf"""
sym AS (SELECT {_SYMBOL} AS term, occ_id AS uid, (repo, relative_path) AS record FROM scip_occurrence),
prt AS (SELECT DISTINCT unnest(string_split_regex(relative_path, '[/\\]')) AS term, file_id AS record FROM scip_document WHERE file_id IS NOT NULL),
both_ AS (
  SELECT 'symbol' AS field, term, count(DISTINCT uid) AS uses, count(DISTINCT record) AS records, (SELECT count(DISTINCT record) FROM sym) AS total FROM sym WHERE term IS NOT NULL GROUP BY term
  UNION ALL
  SELECT 'relative_path', term, count(*), count(*), (SELECT count(DISTINCT file_id) FROM scip_document) FROM prt WHERE term NOT IN ('', '.') GROUP BY term),
marked AS (SELECT field, term, uses, records, CASE WHEN records = 1 THEN 'rare' WHEN records * 20 > total THEN 'common' END AS mark FROM both_)"""

ORACLE_SQL: dict[str, str] = {
    "p1_terms": f"WITH {_TERMS} SELECT field, term, uses, records, mark FROM marked",
    "p1_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
}
