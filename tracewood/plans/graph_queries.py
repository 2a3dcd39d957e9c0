"""Queries of the graph operators over the star-schema view, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.operators import graph as G
from tracewood.plans.views import SQL_EDGES, SQL_FILES, SQL_GRAPH, SQL_NODES, graph_edges, graph_nodes, sql_calls
from tracewood.session import table

CUT = "2000-01-01"
SEED_FILE = "R0/N0"
RULES = [("regions", "R0", "R1", 1), ("nation", "R2/N2", "R3", 2), ("all", "R4", "R2/N8", 0)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return graph_edges(spark, folder), graph_nodes(spark, folder)


_CUT_EPOCH = f"epoch(TIMESTAMP '{CUT}')::BIGINT"


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, delta and tombstones: late calls are the delta, returned and finished lines of the base are withdrawn."""
    edges = graph_edges(spark, folder)
    late = F.col("ts") >= F.unix_timestamp(F.lit(CUT).cast("timestamp"))
    gone = edges.filter(~late & (F.col("authority") < 0.93) & (F.col("confidence") == 2)).select("src", "dst")
    return edges.filter(~late), edges.filter(late), gone


@query(
    f"WITH {SQL_EDGES}, gone AS (SELECT DISTINCT src, dst FROM edges WHERE ts < {_CUT_EPOCH} AND authority < 0.93 AND confidence = 2) "
    f"SELECT * FROM edges e WHERE ts >= {_CUT_EPOCH} OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = e.src AND g.dst = e.dst)"
)
def union_view(spark: SparkSession, folder: str) -> DataFrame:
    return G.union_view(*_split(spark, folder))


@query(
    f"WITH {SQL_GRAPH}, mine AS (SELECT node FROM nodes WHERE is_defined AND file = '{SEED_FILE}') "
    "SELECT src, dst, confidence, seq FROM edges WHERE src NOT IN (SELECT node FROM mine) UNION ALL SELECT src, dst, 2 AS confidence, seq FROM edges WHERE src IN (SELECT node FROM mine)"
)
def file_replace(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    mine = nodes.filter(f"is_defined and file = '{SEED_FILE}'").select("node")
    fresh = edges.join(mine.withColumnRenamed("node", "src"), "src").withColumn("confidence", F.lit(2))
    return G.replace_file(edges, mine, fresh).select("src", "dst", "confidence", "seq")


@query(f"WITH {SQL_EDGES} SELECT src, dst, edge_kind, confidence FROM edges WHERE edge_kind <> 1 UNION ALL SELECT src, dst, edge_kind, 2 AS confidence FROM edges WHERE edge_kind = 1")
def kind_replace(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph_edges(spark, folder)
    return G.replace_kind(edges, 1, edges.filter("edge_kind = 1").withColumn("confidence", F.lit(2))).select("src", "dst", "edge_kind", "confidence")


@query(f"WITH {SQL_GRAPH}, late AS (SELECT * FROM edges WHERE ts >= {_CUT_EPOCH}) SELECT node, symbol FROM nodes WHERE NOT is_defined AND node NOT IN (SELECT src FROM late UNION SELECT dst FROM late)")
def orphan_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    _, late, _ = _split(spark, folder)
    return G.orphans(graph_nodes(spark, folder), late).select("node", "symbol")


@query(f"WITH {SQL_EDGES} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node")
def in_out_degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(graph_edges(spark, folder))


@query(f"WITH {SQL_EDGES} SELECT edge_kind, confidence, count(*) AS edges, round(avg(authority), 6) AS authority FROM edges GROUP BY 1, 2")
def edge_confidence_hist(spark: SparkSession, folder: str) -> DataFrame:
    return graph_edges(spark, folder).groupBy("edge_kind", "confidence").agg(F.count("*").alias("edges"), F.round(F.avg("authority"), 6).alias("authority"))


@query(f"WITH {SQL_EDGES} SELECT src, dst, max(confidence) AS confidence FROM edges GROUP BY 1, 2")
def strongest_edge_per_pair(spark: SparkSession, folder: str) -> DataFrame:
    return G.strongest(graph_edges(spark, folder))


@query(f"WITH {SQL_EDGES}, now AS (SELECT max(ts) AS t FROM edges) SELECT src, dst, seq, round(exp(-ln(2) * greatest(t - ts, 0) / 1209600.0), 9) AS weight FROM edges, now")
def temporal_weight(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.expand import temporal_weight as weight

    edges = graph_edges(spark, folder)
    now = edges.agg(F.max("ts").alias("now"))
    return edges.join(F.broadcast(now)).select("src", "dst", "seq", F.round(weight(F.col("now") - F.col("ts")), 9).alias("weight"))


@query(f"WITH {SQL_GRAPH}, {SQL_FILES} SELECT * FROM file_edges")
def file_graph_fold(spark: SparkSession, folder: str) -> DataFrame:
    return G.file_graph(*both(spark, folder))


@query(f"WITH {SQL_GRAPH}, {sql_calls()} SELECT caller AS src, callee AS dst, max(confidence) AS confidence FROM calls GROUP BY 1, 2")
def placeholder_contraction(spark: SparkSession, folder: str) -> DataFrame:
    return G.contracted(*both(spark, folder))


@query(f"WITH {SQL_GRAPH}, {sql_calls()} SELECT callee AS node, caller, max(confidence) AS confidence FROM calls GROUP BY 1, 2")
def direct_callers(spark: SparkSession, folder: str) -> DataFrame:
    return G.direct_callers(*both(spark, folder))


@query(f"WITH {SQL_GRAPH}, {sql_calls(1)} SELECT callee AS node, caller, max(confidence) AS confidence FROM calls GROUP BY 1, 2")
def direct_callers_floor(spark: SparkSession, folder: str) -> DataFrame:
    return G.direct_callers(*both(spark, folder), floor=1)


@query(
    f"WITH {SQL_GRAPH}, {sql_calls()}, one AS (SELECT DISTINCT caller, max(confidence) OVER (PARTITION BY caller) AS confidence FROM calls WHERE callee = 1) "
    "SELECT row_number() OVER (ORDER BY caller)::INT AS rank, caller, symbol, confidence FROM one JOIN nodes ON node = caller ORDER BY caller LIMIT 200 OFFSET 20"
)
def find_callers_paged(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    mine = G.direct_callers(edges, nodes).filter("node = 1").join(nodes.select(F.col("node").alias("caller"), "symbol"), "caller").select("caller", "symbol", "confidence")
    return G.page(mine, ["caller"], 200, 20)


@query(f"WITH {SQL_GRAPH} SELECT DISTINCT p.name, e.src AS caller FROM edges e JOIN nodes p ON p.node = e.dst AND NOT p.is_defined JOIN nodes a ON a.node = e.src AND a.is_defined WHERE p.node NOT IN (SELECT src FROM edges)")
def undecided_callers(spark: SparkSession, folder: str) -> DataFrame:
    return G.undecided_callers(*both(spark, folder))


_LEVELS = f"""WITH RECURSIVE {SQL_GRAPH}, {sql_calls()}, seeds AS (SELECT node FROM nodes WHERE is_defined AND name LIKE 'S%' AND file = '{SEED_FILE}'),
pairs AS (SELECT DISTINCT caller, callee FROM calls),
walk AS (SELECT node, 0 AS hop FROM seeds UNION SELECT p.caller, w.hop + 1 FROM walk w JOIN pairs p ON p.callee = w.node WHERE w.hop < 3),
near AS (SELECT node, min(hop) AS hop FROM walk GROUP BY 1),
found AS (SELECT n.node, n.hop, arg_min(c.confidence, (c.callee, c.via, c.seq)) AS confidence FROM near n JOIN calls c ON c.caller = n.node JOIN near m ON m.node = c.callee AND m.hop = n.hop - 1 GROUP BY 1, 2)"""


def _seeds(nodes: DataFrame) -> DataFrame:
    return nodes.filter(f"is_defined and name like 'S%' and file = '{SEED_FILE}'")


@query(f"{_LEVELS} SELECT node, hop, confidence FROM found UNION ALL SELECT node, 0, NULL FROM seeds")
def reverse_levels(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    return G.reverse_levels(edges, nodes, _seeds(nodes), 3)


@query(f"{_LEVELS} SELECT f.hop, f.node, symbol, confidence, (row_number() OVER (ORDER BY f.hop, f.node))::INT AS rank FROM found f JOIN nodes USING (node) ORDER BY f.hop, f.node LIMIT 200 OFFSET 50")
def impact_paged(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    return G.impact(edges, nodes, _seeds(nodes), 3, 0, 200, 50)


@query(
    f"{_LEVELS}, tests AS (SELECT DISTINCT o_custkey * 3 AS node FROM orders WHERE o_orderpriority LIKE '1-%') "
    "SELECT f.hop, symbol FROM (SELECT node, hop FROM found UNION ALL SELECT node, 0 FROM seeds) f JOIN tests USING (node) JOIN nodes USING (node)"
)
def affected_tests(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    tests = table(spark, folder, "orders").filter("o_orderpriority like '1-%'").select((F.col("o_custkey") * 3).alias("node")).distinct()
    return G.reverse_levels(edges, nodes, _seeds(nodes), 3).join(tests, "node", "left_semi").join(nodes.select("node", "symbol"), "node").select("hop", "symbol")


@query(
    f"""WITH RECURSIVE {SQL_GRAPH}, {sql_calls()}, pairs AS (SELECT DISTINCT caller, callee FROM calls), walk AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT p.callee, w.hops + 1 FROM walk w JOIN pairs p ON p.caller = w.node WHERE w.hops < 6)
    SELECT node, min(hops) AS hops FROM walk GROUP BY 1"""
)
def shortest_path_hops(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    return G.distances(edges, nodes, nodes.filter("node = 1"), 6).select("node", "hops")


@query()
def shortest_path_steps(spark: SparkSession, folder: str) -> DataFrame:
    return G.shortest_path(*both(spark, folder), 1, 13)


def _cycle_sql(length: int) -> str:
    joins = " ".join(f"JOIN fe e{i} ON e{i}.a = e{i - 1}.b AND e{i}.b > e1.a" + "".join(f" AND e{i}.b <> e{j}.b" for j in range(1, i)) for i in range(2, length))
    return f"WITH {SQL_GRAPH}, {SQL_FILES}, fe AS (SELECT from_file AS a, to_file AS b FROM file_edges WHERE confidence >= 2) SELECT concat_ws(' ', e1.a, {', '.join(f'e{i}.b' for i in range(1, length))}) AS files FROM fe e1 {joins} JOIN fe z ON z.a = e{length - 1}.b AND z.b = e1.a WHERE e1.b > e1.a"


def _cycles(length: int):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pairs = G.file_graph(*both(spark, folder)).filter("confidence >= 2")
        return G.cycles(pairs, length).filter(F.col("length") == length).select(F.array_join("files", " ").alias("files"))

    run.__name__ = f"cycles_len{length}"
    return query(_cycle_sql(length))(run)


for _n in (2, 3, 4):
    _cycles(_n)


_RULE_ROWS = ", ".join(f"('{r}', '{a}', '{b}', {f})" for r, a, b, f in RULES)


@query(
    f"WITH {SQL_GRAPH}, {SQL_FILES}, rules(rule, a, b, floor) AS (VALUES {_RULE_ROWS}) SELECT rule, from_file, to_file, confidence FROM file_edges JOIN rules ON confidence >= floor "
    "AND (from_file = a OR starts_with(from_file, a || '/') OR starts_with(from_file, a || '.')) AND (to_file = b OR starts_with(to_file, b || '/') OR starts_with(to_file, b || '.'))"
)
def deny_rule(spark: SparkSession, folder: str) -> DataFrame:
    return G.denied(G.file_graph(*both(spark, folder)), spark.createDataFrame(RULES, "rule string, from_path string, to_path string, floor int"))


_RING_SQL = " UNION ALL ".join(f"SELECT 'rings' AS rule, 'no-cycles' AS kind, files FROM ({_cycle_sql(n)})" for n in (2, 3))


@query(
    f"WITH {SQL_GRAPH}, {SQL_FILES}, rules(rule, a, b, floor) AS (VALUES {_RULE_ROWS}) SELECT rule, 'deny' AS kind, from_file || ' ' || to_file AS files FROM file_edges JOIN rules ON confidence >= floor "
    f"AND (from_file = a OR starts_with(from_file, a || '/') OR starts_with(from_file, a || '.')) AND (to_file = b OR starts_with(to_file, b || '/') OR starts_with(to_file, b || '.')) UNION ALL {_RING_SQL}"
)
def check_architecture(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(r, "deny", a, b, f) for r, a, b, f in RULES] + [("rings", "no-cycles", None, None, 2)]
    rules = spark.createDataFrame(rows, "rule string, kind string, from_path string, to_path string, floor int")
    return G.check_architecture(G.file_graph(*both(spark, folder)), rules, 3, None).select("rule", "kind", F.array_join("files", " ").alias("files"))


_ADJ = "pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM links WHERE src <> dst GROUP BY 1, 2), adj AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)"
_LINKS = f"{SQL_GRAPH}, {sql_calls()}, links AS (SELECT DISTINCT caller AS src, callee AS dst FROM calls)"


def _adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return G.undirected(G.contracted(*both(spark, folder)))


@query(f"WITH {_LINKS}, {_ADJ} SELECT * FROM adj")
def undirected_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _adjacency(spark, folder)


@query(
    f"""WITH {_LINKS}, {_ADJ}, d AS (SELECT a AS node, count(*) AS peers FROM adj GROUP BY 1),
    l AS (SELECT x.a AS node, count(*) AS linked FROM adj x JOIN adj y ON y.a = x.a AND x.b < y.b JOIN adj z ON z.a = x.b AND z.b = y.b GROUP BY 1)
    SELECT node, peers, coalesce(linked, 0) AS linked, round(CASE WHEN peers < 2 THEN 1.0 ELSE coalesce(linked, 0) / (peers * (peers - 1) / 2.0) END, 6)::DOUBLE AS cohesion FROM d LEFT JOIN l USING (node)"""
)
def neighbour_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    return G.cohesion(_adjacency(spark, folder))


@query(
    f"""WITH {_LINKS}, {_ADJ}, d AS (SELECT a AS node, sum(weight)::BIGINT AS degree, count(*) AS peers FROM adj GROUP BY 1),
    r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM d WHERE degree > 1), m AS (SELECT degree AS median FROM r WHERE i = n // 2),
    inc AS (SELECT dst AS node, count(*) AS incoming FROM links WHERE src <> dst GROUP BY 1), sp AS (SELECT a AS node, count(DISTINCT file) AS files FROM adj JOIN nodes ON nodes.node = b GROUP BY 1),
    l AS (SELECT x.a AS node, count(*) AS linked FROM adj x JOIN adj y ON y.a = x.a AND x.b < y.b JOIN adj z ON z.a = x.b AND z.b = y.b GROUP BY 1)
    SELECT node, degree, incoming, files, round(CASE WHEN peers < 2 THEN 1.0 ELSE coalesce(linked, 0) / (peers * (peers - 1) / 2.0) END, 6)::DOUBLE AS cohesion FROM d JOIN m ON degree >= 2 * median JOIN inc USING (node) JOIN sp USING (node) LEFT JOIN l USING (node)
    WHERE files >= 2 AND (peers < 2 OR coalesce(linked, 0) / (peers * (peers - 1) / 2.0) <= 0.5000005) AND peers >= 2"""
)
def hub_candidates(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    return G.hub_candidates(G.contracted(edges, nodes), nodes)


@query(f"WITH {SQL_NODES} SELECT node, symbol FROM nodes WHERE NOT is_defined")
def pendant_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph_nodes(spark, folder).filter("not is_defined").select("node", "symbol")


@query(
    f"""WITH {_LINKS}, {_ADJ}, t AS (SELECT x.file AS ca, y.file AS cb, weight FROM adj JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b), s AS (SELECT ca, sum(weight) AS degree, sum(CASE WHEN ca = cb THEN weight ELSE 0 END) AS inside FROM t GROUP BY 1)
    SELECT round(sum(inside / w - pow(degree / w, 2)), 6) AS modularity FROM s, (SELECT sum(degree) AS w FROM s)"""
)
def modularity_by_file(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = both(spark, folder)
    return G.modularity(G.undirected(G.contracted(edges, nodes)), nodes.filter("is_defined").select("node", F.col("file").alias("community")))


_NAMED = """named AS (SELECT l_partkey AS name, s_suppkey AS def FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-03-01')"""


@query(f"WITH {_NAMED} SELECT 'P' || name AS name, min(def) AS target FROM named GROUP BY name HAVING count(DISTINCT def) = 1")
def unique_name_link(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.resolve import link_unique

    return link_unique(*_named(spark, folder))


@query(f"WITH {_NAMED} SELECT 'P' || name AS name, count(DISTINCT def) AS candidates FROM named GROUP BY name HAVING count(DISTINCT def) > 1")
def unlinked_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.resolve import ambiguous

    return ambiguous(*_named(spark, folder))


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1997-03-01").cast("timestamp")))
    name = F.concat(F.lit("P"), "l_partkey").alias("name")
    return lines.select(name).distinct(), lines.select(name, F.col("l_suppkey").alias("node"))


@query()
def expand_topk(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.expand import expand

    edges, nodes = both(spark, folder)
    return expand(edges, nodes, _seeds(nodes).select("node", F.lit(1.0).alias("weight")), max_hops=3, max_nodes=40)


@query()
def leiden_partition(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.community import leiden

    edges, nodes = both(spark, folder)
    return leiden(G.contracted(edges, nodes), nodes)


@query()
def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.community import propagate_labels

    return propagate_labels(_adjacency(spark, folder), 5)
