import subprocess

import pytest
from pyspark.sql import functions as F

from tracewood.operators import marks, resolve, unused
from tracewood.sources import git, jsonlink

CASES = [
    ("#[test]\nfn a() {}", "fn a", True, True, False), ("    #[tokio::test]\n    async fn a() {}", "async fn", True, True, False), ("#[cfg(test)]\nfn a() {}", "fn a", False, True, False), ("@Test\n@Slow\npublic void a() {}", "public void", True, True, False),
    ("@Slow\n\npublic void a() {}", "public void", False, True, False), ("// a test\nvoid a() {}", "void a", False, False, False), ("[Fact] void a() {}", "void a", True, False, False), ("é @Test void a() {}", "void a", True, True, False), ("  override fun a() {}", "fun a", False, True, False), ("void overrides() {}", "void", False, False, False),
    ("impl Show for Dot {\n    fn a() {}\n}", "fn a", False, False, True), ("impl Dot {\n    fn a() {}\n}", "fn a", False, False, False), ("unsafe impl<T> Show for Dot<T> {\n\n  // x\n    fn a() {}\n}", "fn a", False, False, False), ("fn a() {}", "fn a", False, False, False), ("", "", False, False, False),
]


def test_marks_around_definitions(spark):
    rows = [(n, t, len(t[: t.index(at)].encode())) for n, (t, at, *_) in enumerate(CASES)] + [(99, None, 3), (98, "x", None)]
    df = spark.createDataFrame(rows, "n int, text string, start int")
    got = {r[0]: r[1:] for r in df.select("n", marks.has_test_attribute(F.col("text"), F.col("start")), marks.is_annotated(F.col("text"), F.col("start")), marks.in_trait_impl(F.col("text"), F.col("start"))).collect()}
    for n, (text, at, *want) in enumerate(CASES):
        assert list(got[n]) == want, (text, at)
    assert list(got[99]) == list(got[98]) == [False] * 3


def test_exempt_definitions_are_not_unused(spark):
    files = spark.createDataFrame([("a.rs", "impl Show for Dot {\n    fn shown() {}\n}\nfn loose() {}\n"), ("b.gd", "func _ready():\n  pass\n"), ("c.py", "@app.route\ndef page():\n    pass\n")], "file string, text string")
    defs = spark.createDataFrame([(1, "a.rs", "shown", 24), (2, "a.rs", "loose", 40), (3, "b.gd", "_ready", 0), (4, "c.py", "page", 11)], "node long, file string, name string, start int")
    links = spark.createDataFrame([], "caller long, callee long")
    assert {r["node"] for r in unused.find_unused(defs, links, files).collect()} == {2}
    assert {r["node"] for r in unused.find_unused(defs.drop("start"), links, files).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize(
    ("path", "normal", "inside"),
    [("a/./b/../c", "a/c", "a/c"), ("./a//b/", "a/b", "a/b"), ("../a", "a", None), ("a/../../b", "b", None), ("/a/../b", "/b", None), ("", "", ""), ("a\\b\\..\\c", "a/c", "a/c"), ("C:\\a", "C:/a", None), (None, None, None)],
)
def test_paths(spark, path, normal, inside):
    got = spark.createDataFrame([(path,)], "p string").select(marks.normalized(F.col("p")), marks.within(F.col("p"))).first()
    assert tuple(got) == (normal, inside)


def test_asm_numbers(spark):
    want = {" 12 ": 12, "-7": -7, "$ff": 255, "-$10": -16, "%101": 5, "$": None, "0x1f": None, "x": None, "": None, None: None, "$7fffffffffffffff": 2**63 - 1, "$ffffffffffffffff": None, "9" * 30: None}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r[0]: r[1] for r in df.select("s", marks.asm_number(F.col("s"))).collect()} == want


def test_handlers(spark):
    defs = spark.createDataFrame([(1, "a.ts", "list"), (2, "b.ts", "list"), (3, "c.ts", "one"), (4, "b.ts", "two"), (5, "a.ts", "two")], "node long, file string, name string")
    routes = spark.createDataFrame([("b.ts", "list", "GET", "/"), ("r.ts", "one", "GET", "/"), ("r.ts", "a.ts#list", "GET", "/"), ("a.ts", "two", "GET", "/"), ("r.ts", "none", "GET", "/"), ("r.ts", None, "GET", "/")], "file string, handler string, verb string, path string")
    assert {(r["file"], r["handler"]): r["node"] for r in resolve.handlers(routes, defs).collect()} == {("b.ts", "list"): None, ("r.ts", "one"): 3, ("r.ts", "a.ts#list"): 1, ("a.ts", "two"): None, ("r.ts", "none"): None, ("r.ts", None): None}
    only_b = routes.filter("file <> 'a.ts'")
    assert {r["handler"]: r["node"] for r in resolve.handlers(only_b, defs).collect()}["list"] == 2


def test_change_history_of_a_repository(spark, tmp_path):
    def commit(text, message):
        (tmp_path / "m.py").write_text(text)
        for args in (["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", message]):
            subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True)

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    first = "def a():\n    return 1\n\n\ndef b():\n    return 2\n"
    commit(first, "begin")
    commit(first.replace("return 2", "return 3"), "b only\n\nwhy\nnot\n\nSigned-off-by: a <a@b>")
    commit("X = 1\n\n\n" + first.replace("return 1", "return 4").replace("return 2", "return 3"), "a moves")
    got = git.change_history(spark, str(tmp_path), "m.py", "b").orderBy("rank").collect()
    assert [(r["subject"], r["body"]) for r in got] == [("b only", "why\nnot"), ("begin", "")]
    assert [r["subject"] for r in git.change_history(spark, str(tmp_path), "m.py", "a").orderBy("rank").collect()] == ["a moves", "begin"]
    assert git.blobs(spark, str(tmp_path), [("HEAD", "m.py"), ("HEAD", "none"), ("HEAD~1", "m.py")], most=50).count() == 1


def test_bounded_git_output(tmp_path, monkeypatch):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    monkeypatch.setattr(git, "MOST_OUTPUT", 3)
    with pytest.raises(RuntimeError, match="too much"):
        git.run(str(tmp_path), "--version")
    monkeypatch.setattr(git, "MOST_OUTPUT", 1000)
    with pytest.raises(RuntimeError):
        git.run(str(tmp_path), "log")


def test_node_link_lines_come_back(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "f"), ("b", "B", None)], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls", 2, 0.5, "f"), ("b", "a", "calls", 0, 0.25, None)], "source string, target string, relation string, confidence int, weight double, source_file string")
    jsonlink.write(nodes, edges, str(tmp_path / "out"))
    n, e, loose = jsonlink.read_lines(spark, str(tmp_path / "out"))
    assert sorted(n.collect()) == sorted(nodes.collect()) and loose.collect() == []
    assert sorted(map(tuple, e.select(*edges.columns).collect()), key=repr) == sorted(map(tuple, edges.collect()), key=repr)
