"""Queries over the code tables (files, symbols, occurrences, classes) and the history view, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewood.functions.text import latest
from tracewood.operators import embed, history, overview, resolve, retrieval, scip, spans, unused
from tracewood.operators.hierarchy import class_bases, class_parents, hierarchy
from tracewood.plans import problem_queries
from tracewood.plans.views import SQL_GRAPH, graph_edges, graph_nodes, sql_calls
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


def files(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "scip_document").select("file_id", "repo", "relative_path", "language", "text", "n_bytes", "indexed_at").filter("file_id is not null"), "file_id", "indexed_at")


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    now = latest(table(spark, folder, "symbol_registry").filter("node is not null"), "node", "read_at")
    return now.select("node", "file_id", "repo", "symbol", "docs", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"), F.expr("substr(symbol, 1, instr(symbol, '#') - 1)").alias("file"), F.expr("substr(symbol, instr(symbol, '#') + 1)").alias("name"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every document whose id is divisible by 50."""
    return table(spark, folder, "documents").filter("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("query"), "text")


_STOP = "[" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + "]"


def _tok(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(coalesce({x}, ''), '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) > 1 AND NOT list_contains({_STOP}, w))"


_DOCS = "docs_now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST) rn FROM scip_document WHERE file_id IS NOT NULL) WHERE rn = 1)"
_REG = """reg AS (SELECT node, file_id, repo, symbol, docs, spans.start AS s, spans."end" AS e, substr(symbol, 1, instr(symbol, '#') - 1) AS file, substr(symbol, instr(symbol, '#') + 1) AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY read_at DESC NULLS LAST) rn FROM symbol_registry WHERE node IS NOT NULL) WHERE rn = 1)"""
_POST = f"""{_REG}, tk AS (SELECT node, symbol, {_tok("symbol")} AS a, {_tok("docs")} AS b FROM reg),
w AS (SELECT node, unnest(a) AS term, 1 AS nm, 0 AS dc FROM tk UNION ALL SELECT node, unnest(b), 0, 1 FROM tk),
cnt AS (SELECT node, term, sum(nm) AS nm, sum(dc) AS dc FROM w GROUP BY 1, 2),
post AS (SELECT term, node, CASE WHEN nm > 0 THEN (nm * 100)::INT ELSE trunc(dc::FLOAT * 0.03::FLOAT * 100::FLOAT)::INT END AS freq FROM cnt),
lens AS (SELECT node, trunc((len(a)::FLOAT + len(b)::FLOAT * 0.03::FLOAT) * 100::FLOAT)::INT AS length FROM tk WHERE len(a) > 0),
voc AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
prose AS (SELECT term FROM (SELECT DISTINCT node, term FROM w) x JOIN tk USING (node) GROUP BY 1 HAVING bool_and(regexp_matches(lower(symbol), '\\.(md|markdown)#')))"""
_ASK = f"ask AS (SELECT DISTINCT doc_id AS query, unnest({_tok('text')}) AS term FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL)"


def _search_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbols(spark, folder).select("node", "symbol", "docs")


@query(f"WITH {_REG} SELECT node, term, count(*) AS uses FROM (SELECT node, unnest({_tok('symbol')}) AS term FROM reg) GROUP BY 1, 2")
def tokenize_terms(spark: SparkSession, folder: str) -> DataFrame:
    return symbols(spark, folder).select("node", F.explode(retrieval.tokens(F.col("symbol"))).alias("term")).groupBy("node", "term").agg(F.count("*").alias("uses"))


@query(f"WITH {_POST} SELECT * FROM post")
def posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.postings(_search_symbols(spark, folder))


@query(f"WITH {_POST} SELECT * FROM lens")
def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.lengths(_search_symbols(spark, folder))


@query(f"WITH {_POST} SELECT * FROM voc")
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.document_frequency(retrieval.postings(_search_symbols(spark, folder)))


@query(f"WITH {_POST} SELECT * FROM prose")
def prose_only_terms(spark: SparkSession, folder: str) -> DataFrame:
    known = _search_symbols(spark, folder)
    return retrieval.prose_only(known, retrieval.postings(known))


@query(
    f"""WITH {_POST}, {_ASK}, sc AS (SELECT query, node, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * freq * 2.2 / (freq + 1.2)) * count(*), 6) AS score, count(*) AS coverage FROM ask JOIN voc USING (term) JOIN post USING (term), (SELECT count(*) AS n FROM lens) GROUP BY 1, 2)
    SELECT query, node, score, coverage, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM sc) WHERE rank <= 24"""
)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    known = _search_symbols(spark, folder)
    return retrieval.bm25(questions(spark, folder), retrieval.postings(known), retrieval.lengths(known))


@query(
    f"""WITH {_POST}, {_ASK}, thin AS (SELECT DISTINCT term, substr(term, 1, 5) AS stem FROM ask LEFT JOIN voc USING (term) WHERE length(term) >= 5 AND (df IS NULL OR df <= 3 OR term IN (SELECT term FROM prose))),
    hd AS (SELECT term AS related, df, substr(term, 1, 5) AS stem FROM voc WHERE length(term) >= 5), plain AS (SELECT t.term, related, df FROM thin t JOIN hd USING (stem))
    SELECT * FROM plain WHERE term <> related UNION ALL SELECT t.term, h.related, h.df FROM thin t JOIN hd h ON translate(t.stem, 'kz', 'cc') = translate(h.stem, 'kz', 'cc') WHERE t.term NOT IN (SELECT term FROM plain) AND t.term <> h.related"""
)
def stem_fallback(spark: SparkSession, folder: str) -> DataFrame:
    known = _search_symbols(spark, folder)
    terms = questions(spark, folder).select(F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term")).distinct()
    return retrieval.stem_relatives(terms, retrieval.document_frequency(retrieval.postings(known)), retrieval.prose_only(known, retrieval.postings(known)))


@query(
    f"""WITH {_POST}, {_ASK}, ws AS (SELECT {_tok('text')} AS t FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL), al AS (SELECT term FROM ask UNION SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1])) FROM ws),
    un AS (SELECT DISTINCT term FROM al WHERE term NOT IN (SELECT term FROM voc) AND strlen(term) >= 8), ct AS (SELECT term, unnest(range(1, length(term))) AS pos FROM un),
    ok AS (SELECT term, pos, substr(term, 1, pos) AS head, substr(term, pos + 1) AS tail FROM ct WHERE strlen(substr(term, 1, pos)) >= 4 AND strlen(substr(term, pos + 1)) >= 4)
    SELECT term, arg_max(head, pos) AS head, arg_max(tail, pos) AS tail FROM ok WHERE head IN (SELECT term FROM voc) AND tail IN (SELECT term FROM voc) GROUP BY 1"""
)
def compound_split(spark: SparkSession, folder: str) -> DataFrame:
    """Of the questions' words and of what becomes of two neighbours written as one."""
    words = questions(spark, folder).select(retrieval.tokens(F.col("text")).alias("t"))
    joined = F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda w, i: F.concat(F.get("t", i), w))
    terms = words.select(F.explode(F.array_union("t", joined)).alias("term")).distinct()
    return retrieval.compound_parts(terms, retrieval.document_frequency(retrieval.postings(_search_symbols(spark, folder))))


@query()
def search_full(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.search(questions(spark, folder), _search_symbols(spark, folder))


@query()
def vocabulary_suggestion(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.suggest(questions(spark, folder), _search_symbols(spark, folder))


_WORDS = r"words AS (SELECT file_id AS file, unnest(string_split_regex(text, '[^\p{L}\p{N}_]+')) AS name FROM docs_now WHERE text IS NOT NULL)"


@query(f"WITH {_DOCS}, {_REG}, {_WORDS} SELECT name, count(*) AS mentions, count(DISTINCT file) AS files FROM words WHERE length(name) > 2 AND name IN (SELECT regexp_extract(name, '([^.]*)$', 1) FROM reg) GROUP BY 1")
def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = symbols(spark, folder).select(F.regexp_extract("name", r"([^.]*)$", 1).alias("name"))
    return retrieval.mention_counts(files(spark, folder).select(F.col("file_id").alias("file"), "text"), names)


@query(
    f"""WITH {_DOCS}, {_REG}, {_WORDS}, one AS (SELECT regexp_extract(name, '([^.]*)$', 1) AS name, min(file_id) AS home FROM reg GROUP BY 1 HAVING count(*) = 1 AND length(regexp_extract(name, '([^.]*)$', 1)) > 2)
    SELECT DISTINCT name, file FROM words JOIN one USING (name) WHERE file <> home"""
)
def named_elsewhere(spark: SparkSession, folder: str) -> DataFrame:
    defs = symbols(spark, folder).select(F.regexp_extract("name", r"([^.]*)$", 1).alias("name"), F.col("file_id").alias("file"))
    return retrieval.named_elsewhere(files(spark, folder).select(F.col("file_id").alias("file"), "text").filter("text is not null"), defs)


_NAME = r"""CASE WHEN NOT starts_with(symbol, 'local ') AND NOT suffix(regexp_extract(symbol, '(\S+)$', 1), '/') THEN
  nullif(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_extract(symbol, '(\S+)$', 1), '[.#/!:)(]+$', ''), '([^/#.!:]*)$', 1), '\(.*$', ''), '^.*\]', ''), '') END"""
_OCC = rf"""occ AS (SELECT *, {_NAME} AS name FROM (SELECT DISTINCT occ_id, repo, relative_path AS file, coalesce(occ_range[1], 0) AS line, trim(symbol, E' \t') AS symbol, coalesce(symbol_roles & 1, 0) = 1 AS is_def FROM scip_occurrence WHERE occ_id IS NOT NULL) WHERE ({_NAME}) IS NOT NULL),
defs AS (SELECT * FROM occ WHERE is_def), known AS (SELECT DISTINCT symbol FROM defs),
links AS (SELECT scope AS caller, symbol AS callee, count(*) AS uses FROM (
  SELECT k, symbol, last_value(scope IGNORE NULLS) OVER (PARTITION BY repo, file ORDER BY line, k, scope ROWS UNBOUNDED PRECEDING) AS scope FROM (
    SELECT repo, file, line, 0 AS k, symbol AS scope, NULL AS symbol FROM defs UNION ALL SELECT repo, file, line, 1, NULL, symbol FROM occ WHERE NOT is_def AND symbol IN (SELECT symbol FROM known)))
  WHERE k = 1 AND scope IS NOT NULL AND scope <> symbol GROUP BY 1, 2)"""


@query(f"WITH {_OCC} SELECT * FROM links")
def scip_edges(spark: SparkSession, folder: str) -> DataFrame:
    return scip.edges(scip.occurrences(table(spark, folder, "scip_occurrence")))


@query(f"WITH {_OCC} SELECT symbol, count(*) AS uses FROM occ WHERE NOT is_def AND symbol NOT IN (SELECT symbol FROM known) GROUP BY 1")
def scip_external(spark: SparkSession, folder: str) -> DataFrame:
    return scip.external(scip.occurrences(table(spark, folder, "scip_occurrence")))


@query(f"WITH {_OCC} SELECT symbol, min(name) AS name, count(DISTINCT (repo, file)) AS files FROM defs GROUP BY 1")
def scip_definitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = scip.occurrences(table(spark, folder, "scip_occurrence")).filter("is_def")
    return rows.groupBy("symbol").agg(F.min("name").alias("name"), F.count_distinct(F.struct("repo", "file")).alias("files"))


_TEST = r"(regexp_matches(lower(file), '(^|[/\\])(test|tests|spec|specs|__tests__|testing)[/\\]') OR regexp_matches(lower(regexp_extract(file, '([^/\\]*)$', 1)), '^test_|_test\.|\.test\.|\.spec\.|_spec\.|-test\.|-spec\.') OR regexp_matches(regexp_extract(regexp_extract(file, '([^/\\]*)$', 1), '^([^.]*)', 1), 'Tests?$') OR regexp_matches(name, '^test_|^Test[A-Z_]|^test[A-Z]'))"


@query(
    rf"""WITH {_OCC}, {_DOCS}, words AS (SELECT unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+')) AS name FROM docs_now WHERE text IS NOT NULL), seen AS (SELECT name, count(*) AS n FROM words WHERE length(name) > 2 GROUP BY 1),
    d AS (SELECT symbol AS node, min(file) AS file, min(name) AS name FROM defs GROUP BY 1),
    loose AS (SELECT * FROM d WHERE node NOT IN (SELECT callee FROM links WHERE caller <> callee) AND NOT lower(regexp_extract(file, '\.([^./\\]*)$', 1)) IN ({", ".join(f"'{x}'" for x in unused.DATA_EXTENSIONS)})
      AND name NOT IN ('main', '<module>') AND NOT contains(name, '.') AND NOT regexp_full_match(name, '__.*__') AND NOT regexp_matches(lower(file), 'testdata/|fixtures/') AND NOT {_TEST}
      AND NOT ((regexp_matches(name, '^(get|set|is)[A-Z]') AND regexp_matches(file, '\.(java|kt|groovy)$')) OR regexp_matches(name, '^(visit_|depart_|on_)|^On[A-Z]')))
    SELECT node, file, name FROM loose JOIN (SELECT name, count(*) AS defined FROM loose GROUP BY 1) USING (name) LEFT JOIN seen USING (name) WHERE coalesce(n, 0) <= defined"""
)
def find_unused(spark: SparkSession, folder: str) -> DataFrame:
    rows = scip.occurrences(table(spark, folder, "scip_occurrence"))
    defs = rows.filter("is_def").groupBy(F.col("symbol").alias("node")).agg(F.min("file").alias("file"), F.min("name").alias("name"))
    return unused.find_unused(defs, scip.edges(rows), files(spark, folder).select(F.col("file_id").alias("file"), "text"))


_DIR = r"regexp_extract(replace(file, '\', '/'), '^((?:[^/]+/){1,2})', 1)"


@query(
    rf"""WITH {_REG}, p AS (SELECT name, lower(regexp_extract(file, '\.([^./\\]*)$', 1)) AS ext, {_DIR} AS dir, count(*) AS n FROM reg GROUP BY 1, 2, 3), s AS (SELECT name, ext, count(*) AS dirs FROM p GROUP BY 1, 2)
    SELECT dir, sum(n)::BIGINT AS definitions, sum(CASE WHEN dirs > 1 THEN n ELSE 0 END)::BIGINT AS repeated FROM p JOIN s USING (name, ext) GROUP BY 1 HAVING sum(n) >= 20 AND sum(CASE WHEN dirs > 1 THEN n ELSE 0 END) >= 0.05 * sum(n)"""
)
def repeated_directories(spark: SparkSession, folder: str) -> DataFrame:
    return unused.repeated_directories(symbols(spark, folder), 20, 0.05)


_SPANS = f"WITH {_REG}, r AS (SELECT file_id AS file, node, s, e FROM reg WHERE s < e)"


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    return symbols(spark, folder).select(F.col("file_id").alias("file"), "node", "start", "end").filter("start < end")


@query(f"{_SPANS}, p AS (SELECT DISTINCT file, (s + e) // 2 AS pos FROM r) SELECT p.file, p.pos AS \"at\", arg_min(r.node, (e - s, r.node)) AS node FROM p JOIN r ON r.file = p.file AND s <= pos AND pos < e GROUP BY 1, 2")
def innermost_range_join(spark: SparkSession, folder: str) -> DataFrame:
    ranges = _ranges(spark, folder)
    return spans.innermost(ranges.select("file", F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("at")).distinct(), ranges)


@query(f"{_SPANS} SELECT a.node, arg_min(b.node, (b.e - b.s, b.node)) AS parent FROM r a JOIN r b ON a.file = b.file AND b.s <= a.s AND b.e >= a.e AND (b.e - b.s) > (a.e - a.s) GROUP BY 1")
def range_parents(spark: SparkSession, folder: str) -> DataFrame:
    return spans.parents(_ranges(spark, folder))


@query(f"{_SPANS} SELECT a.node AS a, b.node AS b FROM r a JOIN r b ON a.file = b.file AND a.s < b.s AND b.s < a.e AND a.e < b.e")
def partial_overlap_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return spans.partial_overlaps(_ranges(spark, folder))


@query(rf"WITH {_REG} SELECT repo, regexp_extract(name, '([^.]*)$', 1) AS name, count(*) AS n FROM reg GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Bare names that a repo defines more than once, so a call by name alone is undecided."""
    return symbols(spark, folder).groupBy("repo", F.regexp_extract("name", r"([^.]*)$", 1).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query(f"WITH {_DOCS}, {_REG} SELECT r.node, decode(encode(text)[s + 1:e]) AS code FROM reg r JOIN docs_now d USING (file_id) WHERE s >= 0 AND s < e AND e <= strlen(text)")
def snippet_slice(spark: SparkSession, folder: str) -> DataFrame:
    met = symbols(spark, folder).select("node", "file_id", "start", "end").join(files(spark, folder).select("file_id", "text"), "file_id").filter((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.octet_length("text")))
    return met.select("node", spans.byte_slice(F.col("text"), F.col("start"), F.col("end")).alias("code"))


@query(
    rf"""WITH {_DOCS}, {_REG}, f AS (SELECT file_id, lower(regexp_extract(relative_path, '\.([^./\\]*)$', 1)) AS lang, len(string_split(text, chr(10))) AS n FROM docs_now WHERE text IS NOT NULL), d AS (SELECT file_id, count(*) AS k FROM reg GROUP BY 1)
    SELECT lang, count(*) AS files, sum(n)::BIGINT AS lines, sum(coalesce(k, 0))::BIGINT AS defs, sum((k IS NULL)::INT)::BIGINT AS empty_files, round(1000.0 * sum(coalesce(k, 0)) / sum(n), 6)::DOUBLE AS defs_per_kloc FROM f LEFT JOIN d USING (file_id) GROUP BY 1"""
)
def yield_per_language(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.quality import extraction_yield

    listed = files(spark, folder).filter("text is not null").select("file_id", F.lower(F.regexp_extract("relative_path", r"\.([^./\\]*)$", 1)).alias("lang"), F.size(F.split("text", "\n")).alias("lines"))
    return extraction_yield(listed, symbols(spark, folder).select("file_id"))


@query("SELECT file_id, min(indexed_at) AS stored, max(indexed_at) AS current FROM scip_document WHERE file_id IS NOT NULL GROUP BY 1 HAVING min(indexed_at) <> max(indexed_at)")
def stale_sources(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.streaming.listing import stale

    rows = table(spark, folder, "scip_document").filter("file_id is not null")
    stored = rows.groupBy("file_id").agg(F.min("indexed_at").alias("stamp"))
    current = rows.groupBy("file_id").agg(F.max("indexed_at").alias("stamp"))
    return stale(stored, current, "file_id").select("file_id", "stored", "current")


_HUNK = "'@@ -' || l_linenumber || ',' || l_quantity::INT % 5 || ' +' || (l_partkey % 400) || CASE WHEN l_quantity::INT % 4 = 3 THEN '' ELSE ',' || l_quantity::INT % 4 END || ' @@'"


@query(f"SELECT DISTINCT header, CASE WHEN n = 0 THEN b + 1 ELSE b END AS first, CASE WHEN n = 0 THEN b ELSE b + n - 1 END AS last FROM (SELECT {_HUNK} AS header, (l_partkey % 400)::INT AS b, CASE WHEN l_quantity::INT % 4 = 3 THEN 1 ELSE l_quantity::INT % 4 END AS n FROM lineitem)")
def hunk_parse(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    header = F.concat(F.lit("@@ -"), "l_linenumber", F.lit(","), q % 5, F.lit(" +"), F.col("l_partkey") % 400, F.when(q % 4 == 3, "").otherwise(F.concat(F.lit(","), q % 4)), F.lit(" @@"))
    rows = table(spark, folder, "lineitem").select(header.alias("header")).distinct().withColumn("lines", spans.hunk_lines(F.col("header")))
    return rows.select("header", "lines.first", "lines.last")


_EXP = "ex AS (SELECT 'v' || s_suppkey % 3 AS version, 'pkg' || s_nationkey AS package, 'c' || s_suppkey % 7 AS contract, s_suppkey AS ord, 'S' || s_suppkey AS repo FROM supplier), im AS (SELECT 'C' || c_custkey AS repo, 'pkg' || c_nationkey AS package, 'v' || c_custkey % 4 AS version, 'c' || c_custkey % 9 AS contract FROM customer), fx AS (SELECT package, version, contract, arg_min(repo, ord) AS provider FROM ex GROUP BY 1, 2, 3)"


def _contracts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s, c = table(spark, folder, "supplier"), table(spark, folder, "customer")
    exports = s.select(F.concat(F.lit("S"), "s_suppkey").alias("repo"), F.concat(F.lit("pkg"), "s_nationkey").alias("package"), F.concat(F.lit("v"), F.col("s_suppkey") % 3).alias("version"), F.concat(F.lit("c"), F.col("s_suppkey") % 7).alias("contract"), F.col("s_suppkey").alias("ord"))
    imports = c.select(F.concat(F.lit("C"), "c_custkey").alias("repo"), F.concat(F.lit("pkg"), "c_nationkey").alias("package"), F.concat(F.lit("v"), F.col("c_custkey") % 4).alias("version"), F.concat(F.lit("c"), F.col("c_custkey") % 9).alias("contract"))
    return resolve.contracts(imports, exports)


@query(f"WITH {_EXP} SELECT repo, package, version, contract, provider FROM im JOIN fx USING (package, version, contract)")
def contract_join(spark: SparkSession, folder: str) -> DataFrame:
    return _contracts(spark, folder)[0]


@query(f"WITH {_EXP} SELECT repo, package, version, contract FROM im WHERE NOT EXISTS (SELECT 1 FROM fx WHERE fx.package = im.package AND fx.version = im.version AND fx.contract = im.contract)")
def contract_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    return _contracts(spark, folder)[1]


_ROUTES = r"""rt AS (SELECT DISTINCT lower(replace(regexp_replace(relative_path, '[^/\\]+$', '{file}'), '\', '/')) AS path FROM scip_document WHERE file_id IS NOT NULL),
rq AS (SELECT file_id AS sender, lower(replace(min(relative_path), '\', '/')) AS path FROM scip_document WHERE file_id IS NOT NULL GROUP BY 1)"""
_SEG = r"list_transform(list_filter(string_split(path, '/'), lambda p: p <> ''), lambda p: CASE WHEN regexp_full_match(p, '\{.*\}|:.+|<.+>|\*') THEN '*' ELSE p END)"


def _routes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "scip_document").filter("file_id is not null")
    routes = rows.select(F.lower(F.regexp_replace(F.regexp_replace("relative_path", r"[^/\\]+$", "{file}"), r"\\", "/")).alias("path")).distinct().select(F.col("path").alias("handler"), F.lit("GET").alias("verb"), "path")
    requests = rows.groupBy("file_id").agg(F.min("relative_path").alias("path")).select(F.col("file_id").cast("string").alias("sender"), F.lit("ANY").alias("verb"), F.lower(F.regexp_replace("path", r"\\", "/")).alias("path"))
    return routes, requests


@query(f"WITH {_ROUTES} SELECT path, array_to_string({_SEG}, '/') AS segments FROM rt")
def path_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _routes(spark, folder)[0].select("path", F.array_join(resolve.segments(F.col("path")), "/").alias("segments"))


@query(
    f"""WITH {_ROUTES}, a AS (SELECT sender::VARCHAR AS sender, {_SEG} AS s FROM rq), b AS (SELECT path AS handler, {_SEG} AS t FROM rt),
    m AS (SELECT sender, handler, len(list_filter(t, lambda x: x <> '*')) AS literals FROM a JOIN b ON len(s) = len(t) AND s[1:len(s) - 1] = t[1:len(t) - 1] AND (t[len(t)] = '*' OR t[len(t)] = s[len(s)]))
    SELECT DISTINCT sender, handler, literals::INT AS literals FROM m QUALIFY rank() OVER (PARTITION BY sender ORDER BY literals DESC) = 1"""
)
def request_route_match(spark: SparkSession, folder: str) -> DataFrame:
    routes, requests = _routes(spark, folder)
    return resolve.match_routes(requests, routes)


_COS = "q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_KNN = f"{_COS}, s AS (SELECT a.vec_id AS query, b.vec_id AS node, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM s QUALIFY rank <= 5)"


def _knn(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec"))
    return embed.nearest(rows.filter("node % 50 = 0").select(F.col("node").alias("query"), "vec"), rows, 5)


@query(f"WITH {_KNN} SELECT query, node, score, rank::INT AS rank FROM k")
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder)


@query(f"WITH {_KNN} SELECT k.query, sum((a.label = b.label)::INT)::BIGINT AS agree FROM k JOIN embeddings a ON a.vec_id = k.query JOIN embeddings b ON b.vec_id = k.node GROUP BY 1")
def knn_label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    label = table(spark, folder, "embeddings").select("vec_id", "label")
    near = _knn(spark, folder).join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(label.select(F.col("vec_id").alias("node"), F.col("label").alias("b")), "node")
    return near.groupBy("query").agg(F.sum((F.col("a") == F.col("b")).cast("long")).alias("agree"))


@query(
    f"""WITH {_COS}, l AS (SELECT vec_id AS src, (vec_id * 7 + k) % 500 AS dst FROM embeddings, range(1, 4) t(k) WHERE vec_id % 5 <> 0), mv AS (SELECT DISTINCT src FROM l), x AS (SELECT vec_id AS node, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM q),
    m AS (SELECT l.src AS node, dim, sum(CASE WHEN l.dst IN (SELECT src FROM mv) THEN 1.0 ELSE 0.3 END * x) / count(*) AS m FROM l JOIN x ON x.node = l.dst GROUP BY 1, 2), y AS (SELECT x.node, x.dim, CASE WHEN m.m IS NULL THEN x ELSE 0.35 * x + 0.65 * m.m END AS y FROM x LEFT JOIN m USING (node, dim))
    SELECT node, (dim - 1)::INT AS dim, round(y / sqrt(sum(y * y) OVER (PARTITION BY node)), 6) AS value FROM y"""
)
def embed_propagate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec"))
    links = rows.filter("node % 5 <> 0").select(F.col("node").alias("src"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")).select("src", ((F.col("src") * 7 + F.col("k")) % 500).alias("dst"))
    return embed.propagate(rows, links).select("node", F.posexplode("vec").alias("dim", "value")).select("node", "dim", F.round("value", 6).alias("value"))


@query()
def splitmix_signature(spark: SparkSession, folder: str) -> DataFrame:
    return embed.signatures(symbols(spark, folder).select("node"))


_COM = "one AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), ok AS (SELECT c FROM one GROUP BY 1 HAVING count(*) <= 30), u AS (SELECT one.* FROM one JOIN ok USING (c)), own AS (SELECT f, count(*) AS own FROM u GROUP BY 1), pr AS (SELECT a.f AS file, b.f AS partner, count(*) AS together FROM u a JOIN u b ON a.c = b.c AND a.f <> b.f GROUP BY 1, 2)"


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


@query(f"WITH {_COM} SELECT file, partner, together, own, round(together / own, 2) AS share FROM pr JOIN own ON f = file WHERE together >= 2")
def co_change_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return history.co_changes(_commits(spark, folder))


@query(f"WITH {_COM} SELECT partner, together, own, round(together / own, 2) AS share FROM pr JOIN own ON f = file WHERE together >= 2 AND file = 7")
def co_change_for_target(spark: SparkSession, folder: str) -> DataFrame:
    return history.co_changes(_commits(spark, folder)).filter("file = 7").select("partner", "together", "own", "share")


_LINK = "cc AS (SELECT l_orderkey // 8 AS c, l_partkey % 40 AS f FROM lineitem)"
_COM2 = _COM.replace("SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem", "SELECT DISTINCT l_orderkey // 2 AS c, l_partkey % 12 AS f FROM lineitem")


def _broad(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("commit"), (F.col("l_partkey") % 12).alias("file"))


@query(f"WITH {_COM2} SELECT file, partner, together, own FROM pr JOIN own ON f = file WHERE together >= 3 AND together * 2 >= own AND file IN (1, 2, 3) AND partner NOT IN (1, 2, 3)")
def missed_partners(spark: SparkSession, folder: str) -> DataFrame:
    return history.missed_partners(_broad(spark, folder), spark.createDataFrame([(1,), (2,), (3,)], "file long"))


@query(
    f"""WITH {SQL_GRAPH}, c AS (SELECT e2.dst AS node, count(DISTINCT e1.src) AS callers, bool_or(o.node IS NOT NULL) AS tested FROM edges e1 JOIN edges e2 ON e2.src = e1.dst AND e2.edge_kind = 1
      LEFT JOIN (SELECT DISTINCT o_custkey * 3 AS node FROM orders WHERE o_orderpriority LIKE '1-%') o ON o.node = e1.src WHERE e1.edge_kind = 0 GROUP BY 1)
    SELECT n.node, coalesce(callers, 0) AS callers, CASE WHEN NOT coalesce(tested, FALSE) AND coalesce(callers, 0) > 0 THEN 'high' WHEN coalesce(callers, 0) > 0 THEN 'medium' ELSE 'low' END AS level FROM nodes n LEFT JOIN c USING (node) WHERE n.name LIKE 'S%'"""
)
def risk_level(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = graph_edges(spark, folder), graph_nodes(spark, folder)
    tests = table(spark, folder, "orders").filter("o_orderpriority like '1-%'").select((F.col("o_custkey") * 3).alias("caller")).distinct().withColumn("test", F.lit(True))
    hops = edges.filter("edge_kind = 0").select(F.col("src").alias("caller"), F.col("dst").alias("via")).join(edges.filter("edge_kind = 1").select(F.col("src").alias("via"), F.col("dst").alias("node")), "via").select("caller", "node").distinct()
    by = hops.join(tests, "caller", "left").groupBy("node").agg(F.count("*").alias("callers"), F.max(F.coalesce("test", F.lit(False))).alias("tested"))
    told = nodes.filter("name like 'S%'").select("node").join(by, "node", "left").select("node", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("tested", F.lit(False)).alias("tested"), F.lit(0).alias("dangling"), F.lit(0).alias("missed"))
    return history.risk(told.withColumn("dependents", F.col("callers"))).select("node", "callers", "level")


_PARTS = f"{_REG}, parts AS (SELECT node, repo AS community, file FROM reg)"


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return symbols(spark, folder).select("node", F.col("repo").alias("community"), "file")


_STEM = r"regexp_extract(regexp_extract(file, '([^/\\]*)$', 1), '^(.[^.]*)', 1)"
_LABEL = rf"sz AS (SELECT community, count(*) AS size FROM parts GROUP BY 1 HAVING count(*) >= 2), fc AS (SELECT community, file, count(*) AS n FROM parts WHERE NOT regexp_matches(lower(file), '\.(md|markdown)$') GROUP BY 1, 2), lb AS (SELECT community, arg_min(file, (-n, file)) AS file FROM fc GROUP BY 1)"


@query(f"WITH {_PARTS}, {_LABEL} SELECT community, {_STEM} AS label, file, size FROM sz JOIN lb USING (community)")
def majority_label(spark: SparkSession, folder: str) -> DataFrame:
    return overview.labels(_parts(spark, folder))


@query(
    f"""WITH {SQL_GRAPH}, parts AS (SELECT node, split_part(file, '/', 1) AS community, file FROM nodes WHERE is_defined), {_LABEL}, cl AS (SELECT dst AS node, count(*) AS callers FROM edges GROUP BY 1)
    SELECT label, node, callers, rank::INT AS rank FROM (SELECT l.label, p.node, callers, row_number() OVER (PARTITION BY l.label ORDER BY callers DESC, p.node) AS rank FROM parts p JOIN (SELECT community, {_STEM} AS label FROM sz JOIN lb USING (community)) l USING (community) JOIN cl USING (node) WHERE {_STEM.replace("file", "p.file")} = l.label) WHERE rank <= 3"""
)
def overview_entry_points(spark: SparkSession, folder: str) -> DataFrame:
    parts = graph_nodes(spark, folder).filter("is_defined").select("node", F.split_part("file", F.lit("/"), F.lit(1)).alias("community"), "file")
    return overview.entry_points(parts, graph_edges(spark, folder))


@query(
    f"WITH {SQL_GRAPH}, c AS (SELECT n.file AS x, m.file AS y FROM edges e JOIN edges l ON l.src = e.dst AND l.edge_kind = 1 JOIN nodes n ON n.node = e.src JOIN nodes m ON m.node = l.dst WHERE e.edge_kind = 0) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS weight FROM c WHERE x <> y GROUP BY 1, 2"
)
def community_links(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = graph_edges(spark, folder), graph_nodes(spark, folder)
    joined = edges.filter("edge_kind = 0").select("src", F.col("dst").alias("via")).join(edges.filter("edge_kind = 1").select(F.col("src").alias("via"), "dst"), "via")
    return overview.links(nodes.filter("is_defined").select("node", F.col("file").alias("community")), joined)


_ANGLE = 2.399963229728653


@query(
    f"""WITH {SQL_GRAPH}, pt AS (SELECT node, file AS c FROM nodes WHERE is_defined), sz AS (SELECT c, count(*) AS size FROM pt GROUP BY 1),
    pl AS (SELECT c, coalesce(sum(size) OVER (ORDER BY size DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY size DESC, c) - 1 AS o FROM sz),
    sp AS (SELECT node, sqrt(before) * 24 * cos(o * {_ANGLE}) AS x0, sqrt(before) * 24 * sin(o * {_ANGLE}) AS y0, row_number() OVER (PARTITION BY c ORDER BY node) - 1 AS k FROM pt JOIN pl USING (c)),
    xy AS (SELECT node, round(x0 + sqrt(k) * 8 * cos(k * {_ANGLE}), 4) AS x, round(y0 + sqrt(k) * 8 * sin(k * {_ANGLE}), 4) AS y FROM sp), dg AS (SELECT src AS node, count(*) AS degree FROM edges GROUP BY 1)
    SELECT node, x, y, coalesce(degree, 0) AS degree FROM xy LEFT JOIN dg USING (node) WHERE x BETWEEN -400 AND 400 AND y BETWEEN -400 AND 400 ORDER BY 4 DESC, 1 LIMIT 3000"""
)
def viewport_topk(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = graph_edges(spark, folder), graph_nodes(spark, folder)
    degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return overview.viewport(overview.discs(nodes.filter("is_defined").select("node", F.col("file").alias("community"))), degrees, (-400.0, -400.0, 400.0, 400.0))


@query(
    f"""WITH RECURSIVE {problem_queries._PARENTS}, mem AS (SELECT node, unnest(CASE WHEN node % 2 = 0 THEN ['run', 'stop'] ELSE ['run'] END) AS member FROM cur WHERE node % 3 <> 0),
    ups AS (SELECT node, unnest(string_split(path, '/'))::BIGINT AS owner, depth - generate_subscripts(string_split(path, '/'), 1) + 1 AS distance FROM tree)
    SELECT u.node, member, arg_min(owner, distance) AS owner, min(distance)::INT AS distance FROM ups u JOIN mem m ON m.node = u.owner GROUP BY 1, 2"""
)
def inherited_members(spark: SparkSession, folder: str) -> DataFrame:
    links = class_parents(table(spark, folder, "class_facts"))
    members = links.filter("node % 3 <> 0").select("node", F.explode(F.when(F.col("node") % 2 == 0, F.array(F.lit("run"), F.lit("stop"))).otherwise(F.array(F.lit("run")))).alias("member"))
    return resolve.inherited(hierarchy(links), members)


_BASES = f"""bs AS (SELECT e.node, e.pos - 1 AS pos, n.node AS base FROM entries e LEFT JOIN named n ON n.repo = e.repo AND n.name = {problem_queries._PLAIN.format("e.entry")} WHERE {problem_queries._PLAIN.format("e.entry")} IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {problem_queries._PARENTS}, {_BASES}, mem AS (SELECT node, unnest(CASE WHEN node % 2 = 0 THEN ['run', 'stop'] ELSE ['run'] END) AS member FROM cur WHERE node % 3 <> 0),
    ups AS (SELECT node, node AS owner, 0 AS distance, []::BIGINT[] AS way FROM cur UNION SELECT u.node, b.base, u.distance + 1, list_append(u.way, b.pos) FROM ups u JOIN bs b ON b.node = u.owner WHERE b.base IS NOT NULL AND u.distance < 12),
    gap AS (SELECT u.node, min(u.distance + 1) AS gap FROM ups u JOIN bs b ON b.node = u.owner WHERE b.base IS NULL GROUP BY 1), nr AS (SELECT u.node, member, min((distance, way, owner)) AS near FROM ups u JOIN mem m ON m.node = u.owner GROUP BY 1, 2)
    SELECT node, member, near[3] AS owner, near[1]::INT AS distance, coalesce(gap > near[1], TRUE) AS known FROM nr LEFT JOIN gap USING (node)"""
)
def inherited_over_bases(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "class_facts")
    members = facts.filter("node is not null and node % 3 <> 0").select("node").distinct().select("node", F.explode(F.when(F.col("node") % 2 == 0, F.array(F.lit("run"), F.lit("stop"))).otherwise(F.array(F.lit("run")))).alias("member"))
    return resolve.inherited_over(class_bases(facts), members)


@query(
    rf"""WITH {_REG}, nm AS (SELECT node, symbol, regexp_extract(name, '([^.]*)$', 1) AS name FROM reg), wd AS (SELECT DISTINCT doc_id AS doc, regexp_replace(unnest(regexp_extract_all(text, '`([^`\n]{{3,}})`', 1)), '\(.*$', '') AS word FROM documents WHERE text IS NOT NULL),
    tl AS (SELECT name AS word, min(node) AS node FROM nm GROUP BY 1 HAVING min(node) = max(node)) SELECT doc, node FROM wd JOIN nm ON symbol = word UNION SELECT doc, node FROM wd JOIN tl USING (word)"""
)
def doc_mentions(spark: SparkSession, folder: str) -> DataFrame:
    known = symbols(spark, folder).select("node", "symbol", F.regexp_extract("name", r"([^.]*)$", 1).alias("name"))
    return resolve.mentions(table(spark, folder, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), "text"), known)


@query(
    f"""WITH {_OCC}, u AS (SELECT name, min(symbol) AS target FROM defs WHERE NOT regexp_matches(lower(file), '\\.(md|markdown)$') GROUP BY 1 HAVING count(DISTINCT symbol) = 1),
    us AS (SELECT DISTINCT caller, d.name FROM links JOIN defs d ON d.symbol = callee) SELECT DISTINCT caller AS source, target FROM us JOIN u USING (name) WHERE caller <> target"""
)
def uses_by_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = scip.occurrences(table(spark, folder, "scip_occurrence"))
    defs = rows.filter("is_def").select(F.col("symbol").alias("node"), "file", "name")
    used = scip.edges(rows).select(F.col("caller").alias("node"), scip.symbol_name(F.col("callee")).alias("name")).distinct()
    return resolve.uses_by_name(used, defs)


@query(
    f"WITH {_REG}, d AS (SELECT repo || '/' || file AS file, name, min(coalesce(s, -1)) AS o FROM reg GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY substr(file, 1, 2), file, o, name) - 1 AS node, file, name, file || '#' || name AS symbol FROM d"
)
def mint_ids(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.mint(symbols(spark, folder).select(F.concat("repo", F.lit("/"), "file").alias("file"), "name", F.coalesce("start", F.lit(-1)).alias("ordinal")))


@query(
    f"""WITH {_KNN}, e AS (SELECT DISTINCT a.vec_id AS query, b.vec_id AS node FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)
    SELECT query, round(count(k.node) / count(*), 6) AS recall, round(count(k.node) / 5, 6) AS precision FROM e LEFT JOIN k USING (query, node) GROUP BY 1"""
)
def recall_precision(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.quality import recall_precision as measure

    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    expected = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label").join(rows.select(F.col("vec_id").alias("node"), "label"), "label").filter("query <> node").select("query", "node")
    return measure(expected, _knn(spark, folder).select("query", "node"), 5)


@query(
    f"WITH {_DOCS}, {_ASK}, t AS (SELECT DISTINCT query, substr(term, 1, 5) AS stem FROM ask WHERE length(term) > 3), h AS (SELECT query, file_id, count(*) AS hits FROM t JOIN docs_now ON contains(lower(text), stem) GROUP BY 1, 2) SELECT query, file_id, hits, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, file_id) AS rank FROM h) WHERE rank <= 5"
)
def grep_baseline(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.quality import grep

    return grep(questions(spark, folder), files(spark, folder).select("file_id", "text"))


@query(
    rf"""WITH {_DOCS}, {_REG}, f AS (SELECT file_id, lower(regexp_extract(relative_path, '\.([^./\\]*)$', 1)) AS lang, len(string_split(text, chr(10))) AS n FROM docs_now WHERE text IS NOT NULL), d AS (SELECT file_id, count(*) AS k FROM reg GROUP BY 1),
    y AS (SELECT lang, round(1000.0 * sum(coalesce(k, 0)) / sum(n), 6)::DOUBLE AS defs_per_kloc FROM f LEFT JOIN d USING (file_id) GROUP BY 1), g(lang, least) AS (VALUES ('py', 1000.0), ('go', 10.0), ('rs', 2000.0), ('cobol', 5.0)) SELECT lang, defs_per_kloc, least::DOUBLE AS least FROM y JOIN g USING (lang) WHERE defs_per_kloc < least"""
)
def floors_gate(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.quality import below_floor

    floors = spark.createDataFrame([("py", 1000.0), ("go", 10.0), ("rs", 2000.0), ("cobol", 5.0)], "lang string, least double")
    return below_floor(yield_per_language(spark, folder), floors)


@query(
    """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM o) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS changes FROM s GROUP BY user_id, batch"""
)
def debounce_batches(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.streaming.listing import batches

    return batches(table(spark, folder, "events"), "user_id", "ts", "event_id", 7200)


@query(
    """WITH links AS (SELECT 'C' || o_custkey AS source, 'P' || l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'EXTRACTED' WHEN 'A' THEN 'inferred' ELSE 'odd' END AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey), nodes AS (SELECT 'C' || c_custkey AS id FROM customer UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_partkey % 10 <> 0)
    SELECT source, target, CASE lower(confidence) WHEN 'extracted' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS confidence, CASE lower(confidence) WHEN 'extracted' THEN 1.0 WHEN 'inferred' THEN 0.7 ELSE 0.3 END::DOUBLE AS weight, count(*) AS n FROM links WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY 1, 2, 3, 4"""
)
def json_import(spark: SparkSession, folder: str) -> DataFrame:
    kept, _ = _linked(spark, folder)
    return kept.groupBy("source", "target", "confidence", "weight").agg(F.count("*").alias("n"))


@query(
    "WITH links AS (SELECT 'P' || l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey), nodes AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_partkey % 10 <> 0) SELECT count(*) AS skipped FROM links WHERE target NOT IN (SELECT id FROM nodes)"
)
def json_import_dangling(spark: SparkSession, folder: str) -> DataFrame:
    return _linked(spark, folder)[1].agg(F.count("*").alias("skipped"))


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from tracewood.sources.jsonlink import link

    nodes = table(spark, folder, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id")).union(table(spark, folder, "part").filter("p_partkey % 10 <> 0").select(F.concat(F.lit("P"), "p_partkey")))
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("l_returnflag") == "R", "EXTRACTED").when(F.col("l_returnflag") == "A", "inferred").otherwise("odd")
    return link(nodes, rows.select(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target"), F.lit("calls").alias("relation"), label.alias("confidence"), F.lit(None).cast("double").alias("weight")))


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import extract

    return extract(files(spark, folder).select("file_id", "text", "relative_path"), "file_id", "text", "relative_path")


@query()
def scanner_definitions(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import facts

    return facts(_extracted(spark, folder), "defines")


@query()
def scanner_calls(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import facts

    return facts(_extracted(spark, folder), "calls").groupBy("file", "caller", "callee", "has_receiver").agg(F.count("*").alias("n"))


@query()
def scanner_imports(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import facts

    return facts(_extracted(spark, folder), "imports").select("file", "kind", "name", "target")


@query()
def name_uses(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import facts

    return facts(_extracted(spark, folder), "refs").select("file", "owner", "name")


@query()
def call_binding(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import facts

    rows = _extracted(spark, folder)
    minted = resolve.mint(facts(rows, "defines").select("file", "name", F.col("seq").alias("ordinal")))
    own = minted.join(facts(rows, "members").distinct().withColumn("receiver_only", F.lit(True)), ["file", "name"], "left")
    return resolve.bind_same_file(facts(rows, "calls"), own).groupBy("file", "caller", "callee", "target").agg(F.count("*").alias("calls"))


@query()
def extraction_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import facts
    from tracewood.operators.quality import anomalies

    rows = _extracted(spark, folder)
    return anomalies(facts(rows, "defines"), facts(rows, "calls"))


@query()
def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.documents import markdown_sections as split

    pages = files(spark, folder).filter("lower(relative_path) like '%.md'").select(F.col("file_id").alias("file"), "text")
    notes = table(spark, folder, "documents").filter("kind = 'markdown'").select((-F.col("doc_id")).alias("file"), "text")
    return split(pages.unionByName(notes)).select("file", "ord", "title", "first_line", "last_line", F.size("mentions").alias("mentions"))


def code_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the compiler index: every defined symbol is a node, named file#name."""
    found = scip.occurrences(table(spark, folder, "scip_occurrence"))
    rows = found.filter("is_def").groupBy("symbol").agg(F.min("file").alias("file"), F.min("name").alias("name"))
    ids = resolve.mint(rows.select("file", F.col("symbol").alias("name"), F.lit(0).alias("ordinal"))).select("node", F.col("name").alias("key"))
    nodes = rows.join(ids, rows["symbol"] == ids["key"]).select("node", F.concat("file", F.lit("#"), "name").alias("symbol"), "file", "name", F.lit(True).alias("is_defined"), "key")
    made = scip.edges(found).join(nodes.select(F.col("key").alias("caller"), F.col("node").alias("src")), "caller").join(nodes.select(F.col("key").alias("callee"), F.col("node").alias("dst")), "callee")
    edges = made.select("src", "dst", F.lit(0).cast("long").alias("ts"), F.lit(1.0).alias("authority"), F.lit(0).alias("edge_kind"), F.lit(2).alias("confidence"), F.lit(0).cast("long").alias("seq"))
    return edges, nodes.drop("key")


@query()
def query_graph(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.tools import query_graph as ask
    from tracewood.session import Workspace

    work = Workspace(spark, "question")
    edges, nodes = (work.cut(df) for df in code_graph(spark, folder))
    told = symbols(spark, folder).groupBy("file", F.regexp_extract("name", r"([^.]*)$", 1).alias("name")).agg(F.max("docs").alias("docs"))
    return ask(edges, nodes, nodes.join(told, ["file", "name"], "left").select("node", "symbol", "docs"), "how are orchard rows archived")


_HUNKS = """st AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM (SELECT DISTINCT file_id, text, indexed_at FROM scip_document WHERE file_id IS NOT NULL)),
nw AS (SELECT file_id AS file, text FROM st WHERE rn = 1 AND text IS NOT NULL AND file_id IN (SELECT file_id FROM st WHERE rn = 2 AND text IS NOT NULL)), od AS (SELECT file_id AS file, text FROM st WHERE rn = 2 AND text IS NOT NULL),
nl AS (SELECT file, n, rtrim(regexp_replace(line, chr(13) || '$', ''), ' ') AS line FROM (SELECT file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM nw)),
ol AS (SELECT DISTINCT file, rtrim(regexp_replace(line, chr(13) || '$', ''), ' ') AS line FROM (SELECT file, unnest(string_split(text, chr(10))) AS line FROM od)),
fr AS (SELECT file, n, n - row_number() OVER (PARTITION BY file ORDER BY n) AS island FROM nl WHERE NOT EXISTS (SELECT 1 FROM ol WHERE ol.file = nl.file AND ol.line = nl.line)), hk AS (SELECT file, min(n) AS h1, max(n) AS h2 FROM fr GROUP BY file, island)"""


def _states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    rows = table(spark, folder, "scip_document").filter("file_id is not null").select("file_id", "text", "indexed_at").distinct()
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc_nulls_last("indexed_at")))).filter("text is not null")
    old = ranked.filter("rn = 2").select(F.col("file_id").alias("file"), "text")
    return old, ranked.filter("rn = 1").select(F.col("file_id").alias("file"), "text").join(old.select("file"), "file", "left_semi")


@query(f"WITH {_HUNKS} SELECT file, h1::INT AS first, h2::INT AS last FROM hk")
def changed_hunks(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.tools import changed_hunks as hunks

    return hunks(*_states(spark, folder)).select("file", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query(
    f"""WITH {_HUNKS}, {_REG}, rg AS (SELECT r.file_id AS file, node, len(string_split(decode(encode(text)[1:s]), chr(10))) AS f, len(string_split(decode(encode(text)[1:e - 1]), chr(10))) AS l FROM reg r JOIN nw ON nw.file = r.file_id WHERE s >= 0 AND s < e AND e <= strlen(text)),
    hit AS (SELECT hk.file, h1, h2, node, f, l FROM hk JOIN rg ON rg.file = hk.file AND f <= h2 AND h1 <= l) SELECT DISTINCT a.file, a.node FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.file = a.file AND b.h1 = a.h1 AND b.h2 = a.h2 AND b.node <> a.node AND a.f <= b.f AND b.l <= a.l AND (a.l - a.f) > (b.l - b.f))"""
)
def detect_changes(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.tools import detect_changes as changes

    known = symbols(spark, folder).select(F.col("file_id").alias("file"), "node", "start", "end")
    return changes(known, *_states(spark, folder))


@query(
    rf"""WITH {_DOCS}, {_REG}, p AS (SELECT DISTINCT repo || '/' || regexp_replace(replace(relative_path, '\', '/'), '/?[^/]*$', '') AS path FROM docs_now), a AS (SELECT DISTINCT replace(regexp_replace(replace(file, '\', '/'), '/?[^/]*$', ''), '/', '.') AS asked FROM reg),
    w AS (SELECT asked, list_filter(string_split_regex(asked, '[./\\:]+'), lambda x: x <> '') AS x FROM a), h AS (SELECT path, list_filter(string_split_regex(path, '[/\\]+'), lambda x: x <> '') AS y FROM p),
    m AS (SELECT asked, path, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[len(x) - k + 1:] = y[len(y) - k + 1:])) AS same FROM w JOIN h ON len(x) > 0 AND len(y) > 0 AND x[-1] = y[-1]), b AS (SELECT *, max(same) OVER (PARTITION BY asked) AS best FROM m)
    SELECT asked, min(path) AS path, min(same)::INT AS parts FROM b WHERE same = best GROUP BY asked HAVING count(*) = 1"""
)
def package_suffix_match(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.tools import package_suffix

    folder_of = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "(^|/)[^/]+$", "")
    paths = files(spark, folder).select(F.concat("repo", F.lit("/"), folder_of("relative_path")).alias("path")).distinct()
    asked = symbols(spark, folder).select(F.translate(folder_of("file"), "/", ".").alias("asked")).distinct()
    return package_suffix(asked, paths)


@query(f"WITH {_PARTS}, {_LABEL}, nm AS (SELECT community, {_STEM} AS label FROM sz JOIN lb USING (community)) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN nm.label = {_STEM.replace('file', 'p.file')} THEN 'placed' WHEN {_STEM.replace('file', 'p.file')} IN (SELECT label FROM nm) THEN 'wrong' ELSE 'absent' END AS verdict FROM parts p LEFT JOIN nm USING (community)) GROUP BY 1")
def partition_scale(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.tools import partition_scale as scale

    parts = _parts(spark, folder)
    return scale(parts, overview.labels(parts))


@query(
    f"""WITH {SQL_GRAPH}, {sql_calls()}, o AS (SELECT callee AS node, max(confidence) AS confidence FROM calls WHERE caller = 1 GROUP BY 1), i AS (SELECT caller AS node, max(confidence) AS confidence FROM calls WHERE callee = 1 GROUP BY 1),
    b AS (SELECT node FROM nodes WHERE is_defined AND node <> 1 AND file = (SELECT file FROM nodes WHERE node = 1) ORDER BY node LIMIT 8)
    SELECT relation, symbol, confidence FROM (SELECT 'calls' AS relation, * FROM o UNION ALL SELECT 'callers', * FROM i UNION ALL SELECT 'siblings', node, NULL FROM b) JOIN nodes USING (node)"""
)
def explain_node(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.operators.tools import explain

    edges, nodes = graph_edges(spark, folder), graph_nodes(spark, folder)
    return explain(edges, nodes, nodes.filter("is_defined").select("node", F.col("file").alias("community")), 1)


@query()
def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    from tracewood.extract.scanner import extract, facts

    texts = files(spark, folder).select(F.concat("repo", F.lit("/"), F.regexp_replace("relative_path", r"\\", "/")).alias("file"), "text")
    rows = extract(texts)
    lang = rows.select("file", "lang")
    defs = facts(rows, "defines")
    minted = resolve.mint(defs.select("file", "name", F.col("seq").alias("ordinal"))).select("node", "file", "name").join(lang, "file")
    return resolve.cascade(facts(rows, "calls").join(lang, "file"), minted, facts(rows, "imports").select("file", "name", "target"))
