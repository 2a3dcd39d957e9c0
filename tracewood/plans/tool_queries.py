"""Queries of the tools' predicates, histories and benchmarks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.operators import history, marks, overview, quality, resolve
from tracewood.plans.code_queries import _DOCS, _REG, files, symbols
from tracewood.plans.views import SQL_NODES, graph_nodes
from tracewood.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(
    rf"""WITH {_DOCS}, {_REG}, p AS (SELECT node, string_split(decode(encode(text)[1:s]), chr(10)) AS l, string_split(decode(encode(text)[s + 1:]), chr(10))[1] AS rest FROM reg r JOIN docs_now d USING (file_id) WHERE s >= 0 AND s < e AND e <= strlen(text)),
    q AS (SELECT node, l[len(l)] AS inl, rest, list_reverse(l[1:len(l) - 1]) AS above FROM p),
    t AS (SELECT *, above[1:coalesce(nullif(list_position(list_transform(above, lambda x: regexp_matches(x, '^\s*(#\[|@|\[)')), false), 0), len(above) + 1) - 1] AS lead, list_filter(above, lambda x: regexp_matches(x, '\S'))[1] AS near,
      list_filter(above, lambda x: regexp_matches(x, '\S') AND strlen(regexp_extract(x, '^(\s*)', 1)) < strlen(regexp_extract(inl || rest, '^(\s*)', 1)))[1] AS opener FROM q)
    SELECT node, (regexp_matches(inl, '@|\[') AND regexp_matches(lower(inl), 'test|\[fact|\[theory') AND NOT contains(lower(inl), 'cfg(')) OR len(list_filter(lead, lambda x: regexp_matches(lower(x), 'test|\[fact|\[theory') AND NOT contains(lower(x), 'cfg('))) > 0 AS tested,
      regexp_matches(inl, '@|#\[') OR regexp_matches(inl || rest, '(^|\s)override(\s|$)') OR coalesce(regexp_matches(near, '^\s*(#\[|@|\[)'), false) AS annotated, coalesce(regexp_matches(opener, '^\s*(unsafe )?impl.* for '), false) AS in_trait FROM t"""
)
def marked_definitions(spark: SparkSession, folder: str) -> DataFrame:
    met = symbols(spark, folder).join(files(spark, folder).select("file_id", "text"), "file_id").filter("start >= 0 and start < end").filter(F.col("end") <= F.octet_length("text"))
    text, start = F.col("text"), F.col("start")
    return met.select("node", marks.has_test_attribute(text, start).alias("tested"), marks.is_annotated(text, start).alias("annotated"), marks.in_trait_impl(text, start).alias("in_trait"))


@query(
    r"""SELECT DISTINCT relative_path AS path, CASE WHEN starts_with(relative_path, '/') THEN '/' ELSE '' END || array_to_string(list_filter(string_split(replace(relative_path, '\', '/'), '/'), lambda p: p NOT IN ('', '.'))[1:-2] || ['x.py'], '/') AS normalized FROM scip_document WHERE relative_path IS NOT NULL AND NOT contains(relative_path, '..')"""
)
def normalized_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "scip_document").select(F.col("relative_path").alias("path")).filter("path is not null and not contains(path, '..')").distinct()
    return paths.select("path", marks.normalized(F.concat("path", F.lit("/.././/x.py"))).alias("normalized"))


@query(
    """SELECT DISTINCT s AS written, v AS value FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN '$' || to_hex(l_partkey) WHEN 1 THEN '%' || to_binary(l_partkey) WHEN 2 THEN l_partkey::VARCHAR ELSE 'x' || l_partkey END AS t, l_partkey, l_linenumber FROM lineitem),
    LATERAL (SELECT CASE WHEN l_linenumber > 4 THEN '-' ELSE '' END || t AS s, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_partkey * CASE WHEN l_linenumber > 4 THEN -1 ELSE 1 END END AS v)"""
)
def asm_numbers(spark: SparkSession, folder: str) -> DataFrame:
    kind, n = F.col("l_linenumber") % 4, F.col("l_partkey")
    written = F.when(kind == 0, F.concat(F.lit("$"), F.hex(n))).when(kind == 1, F.concat(F.lit("%"), F.bin(n))).when(kind == 2, n.cast("string")).otherwise(F.concat(F.lit("x"), n))
    rows = table(spark, folder, "lineitem").select(F.concat(F.when(F.col("l_linenumber") > 4, "-").otherwise(""), written).alias("written")).distinct()
    return rows.select("written", marks.asm_number(F.col("written")).alias("value"))


@query(
    f"""WITH {SQL_NODES}, s AS (SELECT node % 40 AS c, regexp_extract(file, '([^/]*)$', 1) AS label, count(*) AS n FROM nodes WHERE is_defined GROUP BY 1, 2), b AS (SELECT c, sum(n)::BIGINT AS size, arg_min(label, (-n, label)) AS label FROM s GROUP BY 1 HAVING sum(n) >= 2)
    SELECT label, max(size) AS size FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""
)
def subsystem_names(spark: SparkSession, folder: str) -> DataFrame:
    return overview.subsystem_names(graph_nodes(spark, folder).filter("is_defined").select("node", (F.col("node") % 40).alias("community"), "file"))


_ROUTED = "rt AS (SELECT file, CASE WHEN node % 10 = 0 THEN name ELSE symbol END AS handler FROM reg WHERE node % 5 = 0)"


@query(
    f"""WITH {_REG}, {_ROUTED}, sv AS (SELECT DISTINCT file, TRUE AS serves FROM rt), b AS (SELECT name, count(DISTINCT node) AS n, min(node) AS one, count(DISTINCT CASE WHEN serves THEN node END) AS m, min(CASE WHEN serves THEN node END) AS served FROM reg LEFT JOIN sv USING (file) GROUP BY 1),
    x AS (SELECT file || '#' || name AS handler, min(node) AS node FROM reg GROUP BY 1)
    SELECT DISTINCT rt.file, rt.handler, CASE WHEN contains(rt.handler, '#') THEN x.node WHEN n = 1 THEN one WHEN m = 1 THEN served END AS node FROM rt LEFT JOIN x USING (handler) LEFT JOIN b ON b.name = rt.handler"""
)
def route_handlers(spark: SparkSession, folder: str) -> DataFrame:
    rows = symbols(spark, folder)
    routes = rows.filter("node % 5 = 0").select("file", F.when(F.col("node") % 10 == 0, F.col("name")).otherwise(F.col("symbol")).alias("handler"), F.lit("GET").alias("verb"), F.lit("/").alias("path"))
    return resolve.handlers(routes, rows.select("node", "file", "name")).select("file", "handler", "node").distinct()


_DEFS = "SELECT 'D' || k AS name, k * 10 AS f, k * 10 + 9 AS l FROM range(1, 8) t(k) UNION ALL SELECT 'E' || k, k * 10 + 3, k * 10 + 6 FROM range(1, 8) t(k)"


@query(
    f"""WITH h AS (SELECT DISTINCT l_orderkey AS o, 'F' || (l_suppkey % 20) AS file, l_linenumber * 7 + l_partkey % 11 AS a, l_linenumber * 7 + l_partkey % 11 + l_partkey % 5 - 1 AS b FROM lineitem), d AS ({_DEFS}),
    m AS (SELECT o, file, a, b, name, f, l FROM h JOIN d ON (a <= b AND f <= b AND a <= l) OR (a > b AND f < a AND a <= l)),
    t AS (SELECT DISTINCT m.o, m.file, m.name FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.o = m.o AND x.file = m.file AND x.a = m.a AND x.b = m.b AND m.f <= x.f AND x.l <= m.l AND m.l - m.f > x.l - x.f)),
    r AS (SELECT *, (row_number() OVER (PARTITION BY file, name ORDER BY o))::INT AS rank FROM t)
    SELECT file, name, rank, o::VARCHAR AS sha, o_orderdate::DATE::VARCHAR AS date, o_orderpriority AS subject, 'why' || chr(10) || '2' || chr(10) || '3' || chr(10) || '4' || chr(10) || '5' || chr(10) || o_orderstatus AS body, 2 AS body_lines_left_out FROM r JOIN orders ON o_orderkey = o WHERE rank <= 10"""
)
def change_history(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits, their lines as hunks; every file holds seven definitions with one inside each."""
    orders = table(spark, folder, "orders")
    body = F.concat(F.lit("why\n2\n3\n4\n5\n"), "o_orderstatus", F.lit("\n7\n8\n\nSigned-off-by: a <b>\n"))
    commits = orders.select(F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderpriority").alias("subject"), body.alias("body"))
    first = (F.col("l_linenumber") * 7 + F.col("l_partkey") % 11).cast("int")
    hunks = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("F"), F.col("l_suppkey") % 20).alias("file"), first.alias("first"), (first + F.col("l_partkey") % 5 - 1).cast("int").alias("last"))
    held = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(a).alias("first"), F.lit(b).alias("last")) for k in range(1, 8) for n, a, b in ((f"D{k}", k * 10, k * 10 + 9), (f"E{k}", k * 10 + 3, k * 10 + 6))]))
    ranges = hunks.select("sha", "file").distinct().withColumn("d", held).select("sha", "file", "d.*")
    wanted = ranges.select("file", F.col("node").alias("name")).distinct()
    return history.change_history(commits, hunks, ranges, wanted)


_ANSWER = "'callers' || chr(10) || coalesce(string_agg(symbol, chr(10) ORDER BY symbol) FILTER (node % 2 = 0), '') || chr(10) || chr(10) || 'callees of it' || chr(10) || coalesce(string_agg(symbol, chr(10) ORDER BY symbol) FILTER (node % 2 = 1), '')"


@query(
    f"""WITH {SQL_NODES}, a AS (SELECT file AS question, {_ANSWER} AS answer FROM nodes WHERE is_defined GROUP BY 1), x AS (SELECT file AS question, symbol, node % 3 AS k FROM nodes WHERE is_defined),
    s AS (SELECT question, string_split(answer, chr(10) || chr(10)) AS p, answer, symbol, k FROM a JOIN x USING (question))
    SELECT question, count(*) AS asked, sum(CASE k WHEN 0 THEN contains(answer, symbol) WHEN 1 THEN contains(p[1], symbol) ELSE contains(p[2], symbol) END::INT)::BIGINT AS found,
      max(len(list_filter(string_split(answer, chr(10)), lambda l: contains(l, '#'))))::INT AS returned, max(length(answer) // 4) AS tokens FROM s GROUP BY 1"""
)
def structural_recall(spark: SparkSession, folder: str) -> DataFrame:
    nodes = graph_nodes(spark, folder).filter("is_defined")
    part = lambda odd: F.array_join(F.array_sort(F.collect_list(F.when(F.col("node") % 2 == odd, F.col("symbol")))), "\n")
    answers = nodes.groupBy(F.col("file").alias("question")).agg(F.concat(F.lit("callers\n"), part(0), F.lit("\n\ncallees of it\n"), part(1)).alias("answer"))
    wanted = F.concat(F.when(F.col("node") % 3 == 0, "").when(F.col("node") % 3 == 1, "in: callers ").otherwise("in: callees_of_it "), "symbol")
    return quality.structural_recall(answers, nodes.select(F.col("file").alias("question"), wanted.alias("expected")))


@query(
    """WITH c AS (SELECT 'svc/n' || n_nationkey || '.py' AS file, n_nationkey AS k FROM nation)
    SELECT 'route' AS kind, file || '#show_' || k AS symbol, 'GET' AS verb, '/nations/*/n' || k AS path FROM c UNION ALL SELECT 'request', file || '#ask_' || k, 'POST', '/orders/o' || k || '/*' FROM c"""
)
def http_surface(spark: SparkSession, folder: str) -> DataFrame:
    """Routes and requests read from source text: a service and a client per nation."""
    from tracewood.extract.scanner import extract, facts

    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('@app.get("/nations/{id}/n'), key, F.lit('")\ndef show_'), key, F.lit('(id):\n    return id\n\n\ndef ask_'), key, F.lit('(n):\n    return requests.post(f"http://api.local/orders/o'), key, F.lit('/{n}")\n'))
    rows = extract(table(spark, folder, "nation").select(F.concat(F.lit("svc/n"), key, F.lit(".py")).alias("file"), text.alias("text")))
    told = lambda kind, who: facts(rows, kind + "s").select(F.lit(kind).alias("kind"), F.concat_ws("#", "file", who).alias("symbol"), "verb", "path")
    return told("route", "handler").unionByName(told("request", "sender"))
