"""Graph, corpus and history views over the star-schema tables, in Spark and in SQL.

Customers and suppliers are definitions (file: nation, directory: region), parts are placeholders, order lines are calls, and
a part resolves to a supplier if exactly one supplied it within a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.session import table

WINDOW = ("1997-01-01", "1997-03-01")


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("R"), "n_regionkey", F.lit("/N"), "n_nationkey").alias("file"))

    def people(name: str, key: str, home: str, letter: str, shift: int) -> DataFrame:
        who = table(spark, folder, name).select((F.col(key) * 3 + shift).alias("node"), F.concat(F.lit(letter), F.col(key)).alias("name"), F.col(home).alias("n_nationkey"))
        return who.join(nation, "n_nationkey").select("node", F.concat("file", F.lit("#"), "name").alias("symbol"), "file", "name", F.lit(True).alias("is_defined"))

    parts = table(spark, folder, "part").select((F.col("p_partkey") * 3 + 2).alias("node"), F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.lit(None).cast("string").alias("file"), F.concat(F.lit("P"), "p_partkey").alias("name"), F.lit(False).alias("is_defined"))
    return people("customer", "c_custkey", "c_nationkey", "C", 0).unionByName(people("supplier", "s_suppkey", "s_nationkey", "S", 1)).unionByName(parts)


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    confidence = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    facts = [F.unix_timestamp("l_shipdate").alias("ts"), F.round(1 - F.col("l_discount"), 2).alias("authority"), F.lit(0).alias("edge_kind"), confidence.alias("confidence"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")]
    into = (F.col("l_partkey") * 3 + 2).alias("dst")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    by_customer = lines.join(orders, "l_orderkey").select((F.col("o_custkey") * 3).alias("src"), into, *facts)
    within = lambda a, b: (F.col("l_shipdate") >= F.lit(a).cast("timestamp")) & (F.col("l_shipdate") < F.lit(b).cast("timestamp"))
    by_supplier = lines.filter(within("1996-01-01", "1996-07-01")).select((F.col("l_suppkey") * 3 + 1).alias("src"), into, *facts)
    one = lines.filter(within(*WINDOW)).groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"), F.max("l_suppkey").alias("other"), F.max(F.unix_timestamp("l_shipdate")).alias("ts")).filter("s = other")
    links = one.select((F.col("l_partkey") * 3 + 2).alias("src"), (F.col("s") * 3 + 1).alias("dst"), "ts", F.lit(1.0).alias("authority"), F.lit(1).alias("edge_kind"), F.when(F.col("s") % 2 == 0, 1).otherwise(0).alias("confidence"), F.lit(0).cast("long").alias("seq"))
    return by_customer.unionByName(by_supplier).unionByName(links)


SQL_NODES = """nodes AS (
  SELECT c_custkey * 3 AS node, 'R' || n_regionkey || '/N' || n_nationkey || '#C' || c_custkey AS symbol, 'R' || n_regionkey || '/N' || n_nationkey AS file, 'C' || c_custkey AS name, TRUE AS is_defined FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey * 3 + 1, 'R' || n_regionkey || '/N' || n_nationkey || '#S' || s_suppkey, 'R' || n_regionkey || '/N' || n_nationkey, 'S' || s_suppkey, TRUE FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT p_partkey * 3 + 2, 'P' || p_partkey, NULL, 'P' || p_partkey, FALSE FROM part)"""
_FACTS = "epoch(l_shipdate)::BIGINT AS ts, round(1 - l_discount, 2) AS authority, 0 AS edge_kind, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS confidence, l_orderkey * 8 + l_linenumber AS seq"
SQL_EDGES = f"""edges AS (
  SELECT o_custkey * 3 AS src, l_partkey * 3 + 2 AS dst, {_FACTS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_suppkey * 3 + 1, l_partkey * 3 + 2, {_FACTS} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'
  UNION ALL SELECT l_partkey * 3 + 2, min(l_suppkey) * 3 + 1, max(epoch(l_shipdate))::BIGINT, 1.0, 1, CASE WHEN min(l_suppkey) % 2 = 0 THEN 1 ELSE 0 END, 0 FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '{WINDOW[0]}' AND l_shipdate < TIMESTAMP '{WINDOW[1]}' GROUP BY l_partkey HAVING min(l_suppkey) = max(l_suppkey))"""
SQL_GRAPH = f"{SQL_NODES}, {SQL_EDGES}"


def sql_calls(floor: int = 0, name: str = "calls") -> str:
    return f"""{name} AS (
  SELECT e.src AS caller, e.dst AS callee, e.confidence, -1::BIGINT AS via, e.seq FROM edges e JOIN nodes a ON a.node = e.src AND a.is_defined JOIN nodes b ON b.node = e.dst AND b.is_defined WHERE e.confidence >= {floor}
  UNION ALL SELECT e.src, l.dst, least(e.confidence, l.confidence), l.src, e.seq FROM edges e JOIN nodes a ON a.node = e.src AND a.is_defined JOIN edges l ON l.src = e.dst JOIN nodes p ON p.node = l.src AND NOT p.is_defined
    WHERE e.src <> l.dst AND e.confidence >= {floor} AND l.confidence >= {floor})"""


SQL_FILES = """stands AS (SELECT e.src AS node, min(n.file) AS file FROM edges e JOIN nodes p ON p.node = e.src AND NOT p.is_defined JOIN nodes n ON n.node = e.dst AND n.is_defined GROUP BY 1 HAVING min(n.file) = max(n.file)),
places AS (SELECT node, file FROM nodes WHERE is_defined UNION ALL SELECT node, file FROM stands),
file_edges AS (SELECT a.file AS from_file, b.file AS to_file, max(e.confidence) AS confidence FROM edges e JOIN nodes a ON a.node = e.src AND a.is_defined JOIN places b ON b.node = e.dst WHERE a.file <> b.file GROUP BY 1, 2)"""
