import random

import pytest

from tracewood.operators import history, resolve, retrieval, scip, spans, unused


def test_spans_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for n in range(80):
        a = rng.randrange(0, 9000)
        rows.append(("f" if n % 3 else "g", n, a, a + rng.choice([0, 1, 40, 3000, 6000])))
    ranges = spark.createDataFrame(rows, "file string, node long, start int, end int")
    points = [("f", k) for k in range(0, 12000, 271)]
    got = {(r["file"], r["at"]): r["node"] for r in spans.innermost(spark.createDataFrame(points, "file string, at int"), ranges).collect()}
    for f, p in points:
        hits = [(e - s, n) for g, n, s, e in rows if g == f and s <= p < e]
        assert got.get((f, p)) == (min(hits)[1] if hits else None)
    pairs = {(r["a"], r["b"]) for r in spans.partial_overlaps(ranges).collect()}
    assert pairs == {(a, b) for f, a, s1, e1 in rows for g, b, s2, e2 in rows if f == g and s1 < s2 < e1 < e2}


def test_hunks(spark):
    heads = ["@@ -1,2 +3,4 @@ def f", "@@ -1 +7 @@", "@@ -5,2 +9,0 @@", "no hunk"]
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select("h", spans.hunk_lines(__import__("pyspark.sql.functions", fromlist=["col"]).col("h")).alias("x")).collect()
    assert {r["h"]: (r["x"] and tuple(r["x"])) for r in rows} == {heads[0]: (3, 6), heads[1]: (7, 7), heads[2]: (10, 9), heads[3]: None}


def test_touched_keeps_the_inner_hit_and_deletions_inside(spark):
    ranges = spark.createDataFrame([("f", "outer", 1, 20), ("f", "inner", 5, 9), ("f", "next", 10, 12)], "file string, node string, first int, last int")
    hit = lambda a, b: {r["node"] for r in spans.touched(spark.createDataFrame([("f", a, b)], "file string, first int, last int"), ranges).collect()}
    assert hit(6, 6) == {"inner"} and hit(15, 15) == {"outer"} and hit(6, 5) == {"inner"} and hit(10, 9) == {"outer"} and hit(30, 30) == set()


def test_enclosing_is_the_last_scope_above(spark):
    scopes = spark.createDataFrame([("f", 3, "a"), ("f", 8, "b")], "k string, line int, scope string")
    points = spark.createDataFrame([("f", 1, 10), ("f", 3, 11), ("f", 7, 12), ("f", 9, 13), ("g", 9, 14)], "k string, line int, id int")
    assert {r["id"]: r["scope"] for r in spans.enclosing(scopes, points, ["k"]).collect()} == {10: None, 11: "a", 12: "a", 13: "b", 14: None}


def test_routes_prefer_literals(spark):
    routes = spark.createDataFrame([("h1", "get", "/Users/{id}"), ("h2", "GET", "/users/me"), ("h3", "any", "/:a/:b"), ("s", "get", "/users/9")], "handler string, verb string, path string")
    asks = spark.createDataFrame([("s", "GET", "/users/9"), ("t", "GET", "users/me/"), ("u", "POST", "/x/y"), ("v", "GET", "/a/b/c")], "sender string, verb string, path string")
    got = {(r["sender"], r["handler"]) for r in resolve.match_routes(asks, routes).collect()}
    assert got == {("s", "h1"), ("t", "h2"), ("u", "h3")}


def test_names_resolve_only_if_unique(spark):
    defs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("a", 1)], "name string, node long")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert [tuple(r) for r in resolve.link_unique(names, defs).collect()] == [("a", 1)]
    assert [tuple(r) for r in resolve.ambiguous(names, defs).collect()] == [("b", 2)]


def test_search(spark):
    symbols = spark.createDataFrame([(1, "app/tokens.py#parseToken", "reads one token at a time"), (2, "app/graph.py#Graph.add", "puts a node in"), (3, "docs/basis.md#Basis", "was der Graph ist"), (4, "app/base.py#compaction", None)], "node long, symbol string, docs string")
    ask = spark.createDataFrame([(1, "How are tokens parsed?"), (2, "Basisgraph"), (3, "compacted"), (4, ""), (5, None)], "query long, text string")
    got = {}
    for r in retrieval.search(ask, symbols).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["node"])
    assert got[1][0] == 1 and set(got[2]) >= {2, 3} and got[3][0] == 4 and 4 not in got and 5 not in got


def test_tokens(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("parseHTTPServer2Go größer_als the a ä x9",), (None,)], "t string").select(retrieval.tokens(F.col("t")).alias("w")).collect()
    assert row[0]["w"] == ["parse", "httpserver2", "go", "größer", "als", "ä", "x9"] and row[1]["w"] == []


def test_scip_names_and_edges(spark):
    rows = [
        (1, "r", "f", [1, 0, 3], "s p a/one().", 1), (2, "r", "f", [9, 0, 3], "s p a/two().", 1), (3, "r", "f", [3, 0, 3], "s p a/two().", 0), (3, "r", "f", [3, 0, 3], "s p a/two().", 0), (4, "r", "f", None, "s p a/one().", 0),
        (5, "r", "f", [9, 4, 6], "s p a/two().", 0), (6, "r", "f", [4, 0], "s p ext/[R]lib().", 0), (7, "r", "f", [5, 0], "local 1", 0), (8, "r", "f", [5, 0], "s p mod/", 0), (9, None, None, [5, 0], None, None),
    ]
    df = spark.createDataFrame(rows, "occ_id long, repo string, relative_path string, occ_range array<int>, symbol string, symbol_roles int")
    assert [tuple(r) for r in scip.edges(scip.occurrences(df)).collect()] == [("s p a/one().", "s p a/two().", 1)]
    assert [tuple(r) for r in scip.external(scip.occurrences(df)).collect()] == [("s p ext/[R]lib().", 1)]
    from pyspark.sql import functions as F

    assert df.filter("occ_id = 6").select(scip.symbol_name(F.col("symbol"))).first()[0] == "lib"


def test_co_changes_drop_big_commits(spark):
    rows = [(c, f) for c in range(3) for f in "ab"] + [(9, f"x{k}") for k in range(31)] + [(9, "a")]
    got = history.co_changes(spark.createDataFrame(rows, "commit long, file string")).collect()
    assert {(r["file"], r["partner"], r["together"], r["share"]) for r in got} == {("a", "b", 3, 1.0), ("b", "a", 3, 1.0)}


def test_unused(spark):
    defs = spark.createDataFrame([(1, "src/a.py", "used"), (2, "src/a.py", "dead"), (3, "tests/test_a.py", "dead2"), (4, "src/a.json", "key"), (5, "src/B.java", "getX"), (6, "src/a.py", "written")], "node long, file string, name string")
    links = spark.createDataFrame([(2, 1), (2, 2)], "caller long, callee long")
    texts = spark.createDataFrame([("src/a.py", "def used(): pass\ndef dead(): pass\ndef written(): pass\nx = written")], "file string, text string")
    assert [r["name"] for r in unused.find_unused(defs, links, texts).collect()] == ["dead"]


def test_calls_resolve_nearest_first(spark):
    defs = spark.createDataFrame([(1, "a/x.py", "f", "python"), (2, "a/y.py", "f", "python"), (3, "b/m.py", "g", "python"), (4, "c/m2.py", "g", "python"), (5, "d/z.kt", "only", "kotlin"), (6, "e/q.py", "only", "python")], "node long, file string, name string, lang string")
    calls = spark.createDataFrame([("a/x.py", "k", "f", False, "python"), ("a/x.py", "k", "f", True, "python"), ("a/x.py", "k", "h", False, "python"), ("J.java", "k", "only", False, "java"), ("a/x.py", "k", "h", False, "python")], "file string, caller string, callee string, has_receiver boolean, lang string")
    imports = spark.createDataFrame([("a/x.py", "h", "b.m.g")], "file string, name string, target string")
    rows = resolve.cascade(calls, defs, imports).collect()
    got = {(r["file"], r["callee"], r["has_receiver"]): (r["target"], r["how"], r["confidence"], r["uses"]) for r in rows}
    assert got == {("a/x.py", "f", False): (1, "file", 1, 1), ("a/x.py", "f", True): (None, None, 0, 1), ("a/x.py", "h", False): (3, "import", 1, 2), ("J.java", "only", False): (5, "name", 0, 1)}
    loose = spark.createDataFrame([("a/b/c.py", "k", "x", None), ("a/z.py", "k", "y", None), ("q.py", "k", "z", None), ("a/b/d.py", "k", "w", 3)], "file string, caller string, callee string, target long")
    assert [(r["callee"], r["common"]) for r in resolve.untraced(loose, "a/b/e.py").collect()] == [("x", 2), ("y", 1), ("z", 0)]
    refs = spark.createDataFrame([("ci.yml", "build", "t/a.sh"), ("ci.yml", "build", "t/a.sh"), ("ci.yml", "build", "gone.sh")], "file string, job string, path string")
    assert [tuple(r) for r in resolve.file_references(refs, spark.createDataFrame([("t/a.sh",)], "file string")).collect()] == [("ci.yml", "build", "t/a.sh")]


@pytest.mark.parametrize("block", [256, 3])
def test_touched_equals_brute_force(spark, block):

    rng = random.Random(6)
    ranges = [(f"f{n % 2}", n, a, a + rng.randrange(9)) for n in range(40) for a in [rng.randrange(1, 25)]]
    hunks = [(f"f{n % 2}", a, a + rng.randrange(-1, 6)) for n in range(14) for a in [rng.randrange(1, 30)]]
    want = set()
    for f, a, b in hunks:
        hit = [(n, s, e) for g, n, s, e in ranges if g == f and (s <= b and a <= e if a <= b else s < a <= e)]
        want |= {(f, n) for n, s, e in hit if not any(s <= s2 and e2 <= e and e2 - s2 < e - s for _, s2, e2 in hit)}
    got = spans.touched(spark.createDataFrame(hunks, "file string, first int, last int"), spark.createDataFrame(ranges, "file string, node int, first int, last int"), block=block)
    assert {(r["file"], r["node"]) for r in got.collect()} == want and want


def test_running_totals(spark):
    from pyspark.sql import functions as F

    from tracewood.session import Workspace, running

    rows = [(n * 37 % 101, n % 5 + 1) for n in range(101)]
    got = running(spark.createDataFrame(rows, "k int, w int").repartition(7), [F.desc("k")], "w", Workspace(spark, "test")).collect()
    before, want = 0, {}
    for place, (k, w) in enumerate(sorted(rows, reverse=True)):
        want[k] = (place, before)
        before += w
    assert {r["k"]: (r["place"], r["before"]) for r in got} == want
