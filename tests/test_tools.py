import pytest
from pyspark.sql import functions as F

from tracewood.model import EDGES, NODES
from tracewood.operators import overview, tools
from tracewood.operators.quality import anomalies


@pytest.fixture(scope="module")
def world(spark):
    nodes = spark.createDataFrame([(1, "a/orchard.py#plant", "a/orchard.py", "plant", True), (2, "a/orchard.py#harvest", "a/orchard.py", "harvest", True), (3, "b/tests/t.py#test_plant", "b/tests/t.py", "test_plant", True), (4, "grow", None, "grow", False)], NODES)
    edges = spark.createDataFrame([(1, 2, 0, 1.0, 0, 2, 0), (3, 1, 0, 1.0, 0, 2, 1), (2, 4, 0, 1.0, 0, 1, 2)], EDGES)
    return edges, nodes


def test_resolve_one(world):
    _, nodes = world
    assert tools.resolve_one(nodes, "a/orchard.py#plant")[0] == 1 and tools.resolve_one(nodes, "harvest")[0] == 2 and tools.resolve_one(nodes, "grow")[0] == 4
    for text in ("orchard", "nothing"):
        with pytest.raises(ValueError):
            tools.resolve_one(nodes, text)


def test_seeds_fall_back_to_search(world):
    _, nodes = world
    docs = nodes.select("node", "symbol", F.lit(None).cast("string").alias("docs"))
    weight = lambda t: {r["node"]: r["weight"] for r in tools.seeds(nodes, docs, t).collect()}
    assert weight("a/orchard.py#plant") == {1: 1.0} and weight("a/orchard.py") == {1: 1.0, 2: 1.0} and weight("harv") == {2: 0.8}
    got = weight("where do we plant things")
    assert got[1] == 1.0 and got[3] < 1.0


def test_question_and_explanation(spark, world):
    edges, nodes = world
    docs = nodes.select("node", "symbol", F.lit(None).cast("string").alias("docs"))
    rows = tools.query_graph(edges, nodes, docs, "plant").collect()
    assert [r["symbol"] for r in rows][:2] == ["a/orchard.py#plant", "a/orchard.py#harvest"]
    parts = nodes.filter("is_defined").select("node", F.col("file").alias("community"))
    assert {(r["relation"], r["symbol"]) for r in tools.explain(edges, nodes, parts, 1).collect()} == {("calls", "a/orchard.py#harvest"), ("callers", "b/tests/t.py#test_plant"), ("siblings", "a/orchard.py#harvest")}


def test_changes_touch_the_inner_definition(spark):
    old = "class A:\n    def f(self):\n        a\n\n    def g(self):\n        b\n"
    new = old.replace("        b", "        c")
    at = lambda t, s: t.encode().index(s.encode())
    spans = [(1, "A", 0, len(new)), (1, "f", at(new, "def f"), at(new, "a\n") + 1), (1, "g", at(new, "def g"), len(new) - 1)]
    frame = lambda t: spark.createDataFrame([(1, t)], "file long, text string")
    got = tools.detect_changes(spark.createDataFrame(spans, "file long, node string, start int, end int"), frame(old), frame(new)).collect()
    assert [r["node"] for r in got] == ["g"]


def test_snippet_takes_the_comment_above(spark):
    text = "x = 1\n\n# Ümlaut\n@deco\ndef f():\n    pass\n"
    raw = text.encode()
    a, b = raw.index(b"def f"), len(raw) - 1
    got = spark.createDataFrame([(text, a, b)], "t string, a int, b int").select(tools.snippet(F.col("t"), F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert got == "# Ümlaut\n@deco\ndef f():\n    pass"


def test_tails(spark):
    asked = spark.createDataFrame([("app.core.jobs",), ("jobs",), ("zzz",)], "asked string")
    paths = spark.createDataFrame([("r/app/core/jobs",), ("q/core/jobs",)], "path string")
    assert [(r["asked"], r["path"], r["parts"]) for r in tools.package_suffix(asked, paths).collect()] == [("app.core.jobs", "r/app/core/jobs", 3)]
    made = tools.defining_macros(spark.createDataFrame([("f", "PROC", "go"), ("f", "X", "no"), ("g", "PROC", None)], "file string, macro string, first string"), spark.createDataFrame([("PROC",)], "macro string"))
    assert [(r["file"], r["name"]) for r in made.collect()] == [("f", "go")]
    const = spark.createDataFrame([("A", "B"), ("B", "8"), ("H", "handler")], "name string, value string")
    got = tools.dispatch(spark.createDataFrame([("A", "H")], "slot string, value string"), spark.createDataFrame([("main", "8"), ("other", "9")], "caller string, slot string"), const).collect()
    assert [(r["caller"], r["target"]) for r in got] == [("main", "handler")]
    files = spark.createDataFrame([("m",), ("a",), ("b",), ("c",)], "file string")
    mods = spark.createDataFrame([("m", "a"), ("a", "b"), ("b", "a"), ("c", "c")], "file string, child string")
    assert [r["file"] for r in tools.outside_modules(files, mods, files.filter("file = 'm'")).collect()] == ["c"]


def test_overview_and_layout(spark):
    parts = spark.createDataFrame([(k, 0 if k < 6 else 1, "x/core.py" if k < 4 else "y/api.py" if k < 9 else "z.md") for k in range(10)], "node long, community long, file string")
    assert {(r["community"], r["label"], r["size"]) for r in overview.labels(parts).collect()} == {(0, "core", 6), (1, "api", 4)}
    spots = overview.discs(parts)
    assert spots.count() == 10 and spots.select("x", "y").distinct().count() == 10
    box = overview.viewport(spots, spark.createDataFrame([(3, 9)], "node long, degree long"), (-1000.0, -1000.0, 1000.0, 1000.0), most=3)
    assert [r["node"] for r in box.collect()][0] == 3 and box.count() == 3
    assert len(overview.force_layout([1, 2, 3], [(1, 2)], passes=5)) == 3


def test_anomalies(spark):
    d = spark.createDataFrame([("f", "if", 0, 5), ("f", "ok", 6, 9), ("f", "ok", 6, 9), ("f", "a b", 10, 10)], "file string, name string, start int, end int")
    c = spark.createDataFrame([("f", "<module>", "for", False)], "file string, caller string, callee string, has_receiver boolean")
    assert {r["kind"]: r["n"] for r in anomalies(d, c).collect()} == {"keyword-def": 1, "odd-name": 1, "duplicate": 1, "keyword-call": 1}
