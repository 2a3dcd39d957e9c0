import os
import subprocess

import pytest

from tracewood.extract import documents, rules, scanner
from tracewood.sources import git, jsonlink, scip_wire, store, texts, walk
from tracewood.streaming import incremental, listing

PROGRAMS = {
    "a.py": ('import os.path as p\nfrom m.n import x as y, z\nLIMIT_ONE = 3\n\n# Adds one.\n@deco\ndef add(a):\n    """And more."""\n    return helper(a) + self.go(a)\n\nclass Box(Base):\n    def take(self):\n        self.add(1)\n        other.put(2)\n', ["LIMIT_ONE", "add", "Box", "take"], [("add", "helper", False), ("add", "go", False), ("take", "add", False), ("take", "put", True)]),
    "a.go": ('package m\n\nimport "fmt"\n\n// Add adds.\nfunc (b *Box) Add(x int) int {\n\tfmt.Println(x)\n\treturn one(x)\n}\n\ntype Box struct {\n\tn int\n}\n', ["Add", "Box"], [("Add", "Println", True), ("Add", "one", False)]),
    "a.rs": ("use std::io;\n/// Adds.\npub fn add<'a>(x: &'a str) -> usize { x.len() + one() }\nstruct Box { n: i64 }\nconst MOST_OF: i64 = 3;\n", ["add", "Box", "MOST_OF"], [("add", "len", True), ("add", "one", False)]),
    "A.java": ("import java.util.List;\nclass A extends B {\n  /** Adds. */\n  @Override public int add(int x) {\n    return this.one(x) + other.two(x);\n  }\n}\n", ["A", "add"], [("add", "one", False), ("add", "two", True)]),
    "a.ts": ("import { a as b, c } from './m';\nexport const run = async (x: number): Promise<void> => {\n  await go(x);\n};\nexport class K {\n  private take(x: number): number { return this.put(x); }\n}\nfunction plain() { return `${one(1)}`; }\n", ["run", "K", "take", "plain"], [("run", "go", False), ("take", "put", False), ("plain", "one", False)]),
    "a.c": ("#include <a.h>\n#define TOP_LIMIT 4\n/* Adds. */\nstatic int add(int x) {\n  return one(x);\n}\nstruct box { int n; };\n", ["TOP_LIMIT", "add", "box"], [("add", "one", False)]),
    "a.rb": ("require 'set'\n# Adds.\ndef add(x)\n  return 1 if x\n  items.each do |i|\n    put(i)\n  end\nend\n\nclass Box\n  include Other\n  def take\n    go(1)\n  end\nend\n", ["add", "Box", "take"], [("add", "put", False), ("take", "go", False)]),
    "a.kt": ("import a.b\n/** Adds. */\nfun add(x: Int): Int {\n  return one(x)\n}\nclass Box { fun take() { go() } }\n", ["add", "Box", "take"], [("add", "one", False), ("take", "go", False)]),
    "a.lua": ("local m = require 'mod'\n-- Adds.\nlocal function add(x)\n  if x then return one(x) end\nend\nfunction m.take(y)\n  for i = 1, y do go(i) end\nend\n", ["add", "take"], [("add", "one", False), ("take", "go", False)]),
    "a.swift": ("/// Adds.\nfunc add(x: Int) -> Int {\n  return one(x)\n}\nstruct Box { }\n", ["add", "Box"], [("add", "one", False)]),
    "a.zig": ("fn add(x: i32) i32 {\n  return one(x);\n}\n", ["add"], [("add", "one", False)]),
    "a.ex": ("defmodule Box do\n  def add(x) do\n    one(x)\n  end\nend\n", ["Box", "add"], [("add", "one", False)]),
}


@pytest.mark.parametrize("path", PROGRAMS)
def test_scanner(path):
    text, names, calls = PROGRAMS[path]
    f = scanner.scan(path, text)
    assert [d[0] for d in f.defines] == names
    assert [c for c in f.calls if c[0] != scanner.MODULE] == calls
    raw = text.encode()
    for name, a, b, _ in f.defines:
        assert name.encode() in raw[a:b]
    if "dds" in text:
        assert any("Adds" in d[3] or "adds" in d[3] for d in f.defines)


def test_imports_routes_and_requests():
    text = "from a.b import c as d\nimport e\n\n@app.route('/users/<id>')\ndef show(id):\n    return requests.get(f'https://x.y/items/{id}?q=1')\n"
    f = scanner.scan("w.py", text)
    assert ("name", "d", "a.b.c") in f.imports and ("module", "e", "e") in f.imports
    assert f.routes == [("show", "ANY", "/users/<id>")] and f.requests == [("show", "GET", "/items/*")]


@pytest.mark.parametrize("path", PROGRAMS)
def test_scanner_survives_cuts(path):
    text = PROGRAMS[path][0]
    for n in range(0, len(text), 7):
        scanner.scan(path, text[:n])
        scanner.scan(path, text[n:])


def test_rules_are_strict():
    good = b'schema_version = 1\nlanguage = "x"\nfamily = "brace"\nextensions = [".x"]\ndefinitions = ["fn"]\n'
    assert rules.parse(good).language == "x" and len(rules.load()) > 40 and len(rules.identity()) == 64
    for bad in (good + b"odd = 1\n", good.replace(b"brace", b"none"), good.replace(b'["fn"]', b'["fn", "fn"]'), good.replace(b'["fn"]', b'[" fn"]'), good + b"#" * (64 * 1024)):
        with pytest.raises(ValueError):
            rules.parse(bad)


def test_sections():
    text = "intro\n\n# One\ntext `abc`\n```\n# not a heading\n```\n#tag\n# One\n" + "word " * 260 + "\n\nmore\n"
    got = documents.sections(text)
    assert [g[0] for g in got] == ["", "One", "One [2]", "One (2)"] and got[1][2] == ["abc"] and documents.sections("") == []


def test_workflow_and_openapi():
    jobs, needs, refs = documents.workflow("name: x\njobs:\n  build:\n    steps:\n      - run: sh tools/a.sh\n  test:\n    needs: [build]\n    steps:\n      - uses: ./actions/go\n")
    assert [j for j, _ in jobs] == ["build", "test"] and needs == [("test", "build")] and refs == [("build", "tools/a.sh"), ("test", "actions/go")]
    assert documents.openapi("paths:\n  /pets/{id}:\n    get:\n      operationId: showPet\n    delete:\n") == [("showPet", "GET", "/pets/{id}"), ("", "DELETE", "/pets/{id}")]


def test_walk(spark, tmp_path):
    for p, t in {"a.py": "x = 1", "node_modules/b.js": "", "vendor/c.py": "", "sub/vendor/d.py": "y", "skip/e.py": "", "skip/keep.py": "k", ".hidden/f.py": "", ".github/workflows/ci.yml": "on: x", "dist/g.js": "", "package.json": "{}", "AGENTS.md": "", "h.log": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / ".gitignore").write_text("*.log\nskip/*\n!skip/keep.py\n.gitignore\n")
    (tmp_path / "latin.py").write_bytes(b"# gr\xfc\xdfe\n")
    names = [p for p, _, _ in walk.listing(str(tmp_path))]
    assert names == [".github/workflows/ci.yml", "a.py", "latin.py", "package.json", "skip/keep.py", "sub/vendor/d.py"]
    rows = {r["file"]: (r["lang"], r["text"]) for r in walk.read_tree(spark, str(tmp_path)).collect()}
    assert rows["a.py"] == ("python", "x = 1") and rows["latin.py"][1] == "# grüße\n" and rows["package.json"][0] == "json"


def test_git(spark, tmp_path):
    go = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    go("init", "-q")
    for k in range(3):
        (tmp_path / "a.txt").write_text("".join(f"line {i} {k}\n" for i in range(5)))
        (tmp_path / "b.txt").write_text(f"{k}\n@@ -1 +1 @@\n")
        go("add", ".")
        go("commit", "-qm", f"change {k}")
    assert {(r["ord"], r["file"]) for r in git.commits(spark, str(tmp_path)).collect()} == {(n, f) for n in range(3) for f in ("a.txt", "b.txt")}
    (tmp_path / "a.txt").write_text("new\n")
    (tmp_path / "c.txt").write_text("c")
    got = {(r["file"], r["first"]) for r in git.diff_hunks(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1), ("c.txt", 1)}
    assert git.history(spark, str(tmp_path)).filter("file = 'b.txt'").count() == 3
    with pytest.raises(ValueError):
        git.revision("--output=x")
    assert git.parse_names("\x1eb\na\na\n\x1e\n\x1e" + "\n".join(map(str, range(31)))) == [["a", "b"]]


def test_index_round_trip(spark, tmp_path):
    docs = {"src/a.py": [([1, 2, 300], "s p a/one().", 1), ([], "local 1", 0)], "b.py": []}
    (tmp_path / "x.scip").write_bytes(scip_wire.encode(docs))
    got = [(r["relative_path"], r["occ_range"], r["symbol"], r["symbol_roles"]) for r in scip_wire.read(spark, str(tmp_path / "x.scip")).collect()]
    assert got == [("src/a.py", [1, 2, 300], "s p a/one().", 1), ("src/a.py", [], "local 1", 0)]
    with pytest.raises(ValueError):
        list(scip_wire.decode(scip_wire.encode(docs)[:-3]))


def test_node_link(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "confidence": "EXTRACTED"}, {"source": "a", "target": "b", "confidence": "?", "weight": 0.5}, {"source": "a", "target": "z"}]}')
    nodes, edges, loose = jsonlink.read(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and {(r["confidence"], r["weight"]) for r in edges.collect()} == {(2, 1.0), (0, 0.5)} and loose.count() == 1
    jsonlink.write(nodes, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("kind").count().count() == 2


def test_written_inputs(spark, tmp_path):
    assert texts.architecture_rules("# c\ndeny a -> b extracted\nno-cycles\n") == [("deny", "a", "b", 2), ("no-cycles", "", "", None)]
    with pytest.raises(ValueError):
        texts.architecture_rules("allow a -> b")
    exports, imports = texts.contract_manifest('{"schema": "contracts.v1", "package": {"name": "p", "version": "1"}, "exports": ["c"], "imports": [{"package": "q", "version": "2", "contract": "d"}]}', "r")
    assert exports == [("r", "p", "1", "c", 0)] and imports == [("r", "q", "2", "d")]
    (tmp_path / "q.txt").write_text("# head\nhow is it done\n  a.py#one\n  a.py#two\nother\n  b.py#x\n")
    assert {(r["question"], r["expected"]) for r in texts.question_files(spark, str(tmp_path / "q.txt")).collect()} == {("how is it done", "a.py#one"), ("how is it done", "a.py#two"), ("other", "b.py#x")}


def test_store_refuses_other_rules(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", "r1")
    assert s.version() == 0 and s.publish({"t": spark.range(3)}) == 1 and s.publish({"t": spark.range(5)}) == 2
    assert s.load()["t"].count() == 5 and s.load(1)["t"].count() == 3
    with pytest.raises(ValueError):
        store.Store(spark, f"file://{tmp_path}/s", "r2").load()
    with pytest.raises(RuntimeError):
        s.publish({"t": spark.range(1)}, expected=1)


CHANGES = [("a.py", 1, "def one():\n    two()\n"), ("b.py", 2, "def two():\n    pass\n"), ("a.py", 3, "def one():\n    three()\n"), ("b.py", 4, None)]


def test_one_by_one_equals_one_batch(spark, tmp_path):
    schema = "path string, ord int, text string"
    whole = incremental.apply(incremental.empty(spark), spark.createDataFrame(CHANGES, schema))
    step = incremental.empty(spark)
    for c in CHANGES:
        step = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in incremental.apply(step, spark.createDataFrame([c], schema)).items()}
    for n in whole:
        assert sorted(map(tuple, whole[n].collect())) == sorted(map(tuple, step[n].collect()))
    assert [r["callee"] for r in whole["calls"].collect()] == ["three"]


def test_watch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    s = store.Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("path string, ord int, text string").json(str(src))
    query = incremental.watch(stream, s, str(tmp_path / "ckpt"))
    try:
        for k in (CHANGES[:2], CHANGES[2:]):
            spark.createDataFrame(k, "path string, ord int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "stage"))
            for f in (tmp_path / "stage").glob("*.json"):
                os.replace(f, src / f.name)
            query.processAllAvailable()
    finally:
        query.stop()
    assert s.version() == 2 and [r["name"] for r in s.load()["definitions"].collect()] == ["one"]


def test_listing_changes(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime long, size long")
    b = spark.createDataFrame([("x", 2, 1), ("y", 1, 1), ("w", 1, 1)], "path string, mtime long, size long")
    assert {(r["path"], r["deleted"]) for r in listing.changes(a, b).collect()} == {("x", False), ("z", True), ("w", False)}
    assert incremental.walk_pause(0.01, 0) == 0.25 and incremental.walk_pause(0.01, 9) == 2.0 and incremental.walk_pause(1, 0) == 10


def test_parts_hold_only_what_changed(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/p", "r1")
    frame = lambda rows: spark.createDataFrame(rows, "file string, n int")
    gone = lambda *names: spark.createDataFrame([(f,) for f in names], "file string")
    files = [f"f{k}" for k in range(40)]
    assert s.replace_files({"t": frame([(f, k) for k, f in enumerate(files)]), "u": frame([("f0", 7)])}, gone()) == 1
    assert s.replace_files({"t": frame([("f3", 99)]), "u": frame([])}, gone("f3", "f5", "f0")) == 2
    now = s.load()
    assert sorted(map(tuple, now["t"].collect())) == sorted([(f, k) for k, f in enumerate(files) if f not in ("f0", "f3", "f5")] + [("f3", 99)]) and now["u"].collect() == []
    assert s.load(1)["t"].count() == 40 and len(list((tmp_path / "p" / "v=2" / "t").glob("_part=*"))) <= 3
    assert s.replace_files({"t": frame([]), "u": frame([])}, gone()) == 3 and s.load()["t"].count() == 38
    with pytest.raises(RuntimeError):
        s.replace_files({"t": frame([])}, gone(), expected=1)
    with pytest.raises(ValueError):
        store.Store(spark, f"file://{tmp_path}/p", "r2").load()


def test_long_heads_and_far_handlers():
    from tracewood.extract.scanner import scan

    kinds = " | ".join(f"Kind{k}" for k in range(60))
    facts = scan("a.ts", f"class A {{\n  go(x: T): {kinds} {{\n    return x;\n  }}\n}}\nconst far = (x: T): {kinds} => {{\n  near(x);\n}};\n")
    assert {"far"} <= {d[0] for d in facts.defines} and any(d[0].endswith("go") for d in facts.defines)
