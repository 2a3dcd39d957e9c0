"""Queries of the general data problems, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.operators.heavy_keys import heavy_symbols, symbol_figures
from tracewood.operators.hierarchy import class_parents, hierarchy
from tracewood.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(class_parents(table(spark, folder, "class_facts"))).select("node", "root", "depth")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(class_parents(table(spark, folder, "class_facts")))
    return tree.select("node", "parent", "root", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "descendants")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """(node, descendant, distance) of every class and each class derived from it, near or far."""
    tree = hierarchy(class_parents(table(spark, folder, "class_facts"))).filter("depth > 0")
    return tree.select("node", "depth", F.posexplode("path").alias("pos", "up")).filter("up <> node").select(F.col("up").alias("node"), F.col("node").alias("descendant"), (F.col("depth") - F.col("pos")).cast("long").alias("distance"))


def p3_circles(spark: SparkSession, folder: str) -> DataFrame:
    """(node, parent) of the link that closes each circle of bases."""
    return hierarchy(class_parents(table(spark, folder, "class_facts"))).filter("back_edge").select("node", "parent")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_symbols(table(spark, folder, "scip_occurrence")).select("symbol")


def p4_symbol_figures(spark: SparkSession, folder: str) -> DataFrame:
    return symbol_figures(table(spark, folder, "scip_occurrence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p3_circles, p4_found, p4_symbol_figures)}

_PLAIN = r"""
  nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
    '<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)', '', 'g'), '<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)', '', 'g'), '<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)', '', 'g'),
    '<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)', '', 'g'), '<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)', '', 'g'), '[<\[(].*$', ''), '([^\s.:/\\#]+)\s*$', 1), '')"""
_PARENTS = f"""
cur AS (SELECT * FROM (SELECT node, repo, class_symbol, class_bases, row_number() OVER (PARTITION BY node ORDER BY read_at DESC NULLS LAST) rn
        FROM class_facts WHERE node IS NOT NULL) WHERE rn = 1),
named AS (SELECT min(node) AS node, repo, {_PLAIN.format("substr(class_symbol, instr(class_symbol, '#') + 1)")} AS name FROM cur WHERE repo IS NOT NULL GROUP BY 2, 3),
entries AS (SELECT node, repo, unnest(class_bases) AS entry, generate_subscripts(class_bases, 1) AS pos FROM cur),
firsts AS (SELECT e.node, arg_min(n.node, e.pos) AS parent FROM entries e JOIN named n ON n.repo = e.repo AND n.name = {_PLAIN.format("e.entry")} GROUP BY 1),
links AS (SELECT c.node, f.parent FROM cur c LEFT JOIN firsts f USING (node)),
tree AS (SELECT node, parent, node AS root, 0::BIGINT AS depth, node::VARCHAR AS path FROM links WHERE parent IS NULL
         UNION ALL SELECT l.node, l.parent, t.root, t.depth + 1, t.path || '/' || l.node FROM links l JOIN tree t ON l.parent = t.node),
below AS (SELECT up AS node, count(*) AS descendants FROM (SELECT node, unnest(string_split(path, '/'))::BIGINT AS up FROM tree) WHERE up <> node GROUP BY 1)"""
_SYMBOL = r"CASE WHEN trim(symbol, E' \t') <> '' AND NOT starts_with(trim(symbol, E' \t'), 'local ') THEN trim(symbol, E' \t') END"

ORACLE_SQL: dict[str, str] = {
    "p3_found": f"WITH RECURSIVE {_PARENTS} SELECT l.node, coalesce(t.root, -1) AS root, coalesce(t.depth, -1) AS depth FROM links l LEFT JOIN tree t USING (node)",
    "p3_hierarchy": f"""WITH RECURSIVE {_PARENTS} SELECT l.node, l.parent, coalesce(t.root, -1) AS root, coalesce(t.depth, -1) AS depth, coalesce(t.path, '') AS path,
        CASE WHEN t.node IS NULL THEN -1 ELSE coalesce(b.descendants, 0) END AS descendants FROM links l LEFT JOIN tree t USING (node) LEFT JOIN below b USING (node)""",
    "p3_descendants": f"""WITH RECURSIVE {_PARENTS}, ups AS (SELECT node, depth, unnest(string_split(path, '/'))::BIGINT AS up, generate_subscripts(string_split(path, '/'), 1) AS pos FROM tree)
        SELECT up AS node, node AS descendant, depth - pos + 1 AS distance FROM ups WHERE up <> node""",
    "p3_circles": f"""WITH RECURSIVE {_PARENTS}, rest AS (SELECT l.node, l.parent FROM links l WHERE NOT EXISTS (FROM tree t WHERE t.node = l.node)),
        far AS (SELECT node, parent AS up FROM rest UNION SELECT f.node, r.parent FROM far f JOIN rest r ON r.node = f.up),
        rings AS (SELECT f.node, min(f.up) AS least FROM far f WHERE EXISTS (FROM far o WHERE o.node = f.node AND o.up = f.node) GROUP BY f.node)
        SELECT r.node, r.parent FROM rest r JOIN rings g USING (node) WHERE r.parent = g.least""",
    "p4_found": f"""WITH once AS (SELECT DISTINCT occ_id, {_SYMBOL} AS symbol FROM scip_occurrence WHERE occ_id IS NOT NULL)
        SELECT symbol FROM once WHERE symbol IS NOT NULL GROUP BY symbol HAVING count(*) * 100 >= (SELECT count(*) FROM once)""",
    "p4_symbol_figures": f"""WITH once AS (SELECT occ_id, {_SYMBOL} AS symbol, repo, relative_path, bool_or(coalesce(symbol_roles & 1, 0) = 1) AS def FROM scip_occurrence
        WHERE occ_id IS NOT NULL GROUP BY ALL)
        SELECT symbol, count(*) AS uses, count(DISTINCT (repo, relative_path)) AS files, sum(def::INT)::BIGINT AS definitions FROM once WHERE symbol IS NOT NULL GROUP BY symbol""",
}
