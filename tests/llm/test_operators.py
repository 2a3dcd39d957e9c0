import base64
import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewood.llm import handwritten, packing, pairs, terms, tokens, topics

OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, path string, written_at timestamp"
FILES = "file_id long, repo string, relative_path string, language string, text string, n_bytes long, indexed_at timestamp"


# ------------------------------------------------------------------ terms

OCC = "occ_id long, repo string, relative_path string, occ_range array<int>, symbol string, symbol_roles int, indexed_at timestamp, received_at timestamp"


@pytest.mark.parametrize("limit", [256, 1])
def test_term_frequency_equals_counting(spark, limit):
    rng = random.Random(4)
    rows = [(n, rng.choice(["r", "q", None]), f"f{rng.randrange(40)}" if n % 17 else None, [1], rng.choice([" hot\t", "hot", "warm", f"s{n % 90}", None, "", "local 3", "\t "]), 0, NEW, NEW) for n in range(600)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, OCC).selectExpr("*", "1 as term", "2 as _uid", "3 as n", "4 as records")
    from pyspark.sql import functions as F

    got = {r["term"]: (r["uses"], r["records"], r["mark"]) for r in terms.term_frequency(df, terms.global_symbol("symbol"), ["repo", "relative_path"], "occ_id", limit).collect()}
    seen, records, every = {}, {}, {(r[1], r[2]) for r in rows}
    for r in rows:
        t = (r[4] or "").strip(" \t")
        if t and not t.startswith("local "):
            seen.setdefault(t, set()).add(r[0])
            records.setdefault(t, set()).add((r[1], r[2]))
    mark = lambda n: "rare" if n == 1 else "common" if n * 20 > len(every) else None
    assert got == {t: (len(seen[t]), len(records[t]), mark(len(records[t]))) for t in seen}
    assert terms.term_frequency(df.limit(0), F.col("symbol"), ["repo"], "occ_id").collect() == []


def test_path_terms(spark):
    rows = [(1, "r", "./src//a.py"), (1, "r", "./src//a.py"), (2, "r", "src\\b.py"), (3, None, None), (None, "r", "src/x"), (4, "r", "")]
    got = {r["term"]: (r["uses"], r["records"], r["mark"]) for r in terms.path_terms(spark.createDataFrame(rows, "file_id long, repo string, relative_path string")).collect()}
    assert got == {"src": (2, 2, "common"), "a.py": (1, 1, "rare"), "b.py": (1, 1, "rare")}


# ------------------------------------------------------------------ tokens

PIECES = st.sampled_from(["don't", "'s", " 're", "\n\n", "  ", "\t", "é", "日本", "a" * 40, "<|endoftext|>", "12345", "()", "“x”", "\r\n", "🙂", "ab cd", ".", "'", "﻿", " "])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_fragments_encode_as_the_whole(text):
    with_vocabulary = tokens.coder()
    parts = with_vocabulary.fragments(text)
    assert "".join(parts) == text
    ids, offsets = with_vocabulary.encode([text, None, "", text])
    want = with_vocabulary.coding.encode_ordinary(text)
    assert list(ids[: offsets[1]]) == want == list(ids[offsets[3] :]) and offsets[1] == offsets[3]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_whole(text):
    ids, _ = tokens.coder().encode([text])
    assert list(ids) == tokens.coder().coding.encode_ordinary(text)


def test_every_certain_place_is_cut():
    with_vocabulary = tokens.coder()
    text = "every word, of (this) long text is cut " * 3
    inside = {t[k : k + 2] for t in with_vocabulary.coding.token_byte_values() for k in range(len(t) - 1)}
    certain = [k for k in range(1, len(text)) if not text[k - 1].isspace() and text[k] != "'" and text[k - 1 : k + 1].encode() not in inside]
    places = np.cumsum([len(p) for p in with_vocabulary.fragments(text)])[:-1]
    assert list(places) == certain and len(certain) > 20
    for wide in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)):
        assert all(p[-1] != wide for p in with_vocabulary.fragments(f"a{wide}b{wide}c"))  # it looks ahead


def test_windows_of_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 50)
    texts = ["", None, "a" * 500, "b c " * 20, None, "d", ""] * 5
    ids, offsets = tokens.coder().encode(pa.array(texts).slice(2))
    for k, t in enumerate(texts[2:]):
        assert list(ids[offsets[k] : offsets[k + 1]]) == tokens.coder().coding.encode_ordinary(t or "")


def test_encoding_decodes_to_the_text(spark):
    with open(tokens.VOCABULARY, "rb") as f:
        words = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    rows = [(1, None), (2, ""), (3, "plain text, it's"), (4, "<|endoftext|>\n" + "x" * 30_000 + " é日本"), (None, "no id"), (6, "plain text, it's")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as ids", "1 as n_tokens")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df).collect()}
    assert len(got) == 6 and got[1] == [] and got[2] == [] and got[3] == got[6]
    for i, t in rows:
        assert b"".join(words[x] for x in got[i]).decode() == (t or "")
    assert tokens.encode_texts(df.limit(0)).collect() == []


# ------------------------------------------------------------------ packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 3)), min_size=1, max_size=80))
def test_fill_never_overflows_and_places_all(items):
    sizes, queue = np.array([s for s, _ in items]), np.array([q for _, q in items])
    share = np.array([sizes[queue == q].sum() for q in range(4)]) / sizes.sum()
    where = packing.fill(sizes, queue, share, np.zeros(4), 60)
    used = np.bincount(where, weights=sizes)
    assert (where >= 0).all() and used.max() <= 60
    assert len(used) <= 2 * -(-sizes.sum() // 60)  # two neighbours are more than one container together


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 3)), min_size=1, max_size=80), st.lists(st.integers(-50, 50), min_size=4, max_size=4))
def test_rounds_keep_every_source_within_half_a_text(items, owed):
    sizes, queue = np.array([s for s, _ in items]), np.array([q for _, q in items])
    share = np.array([sizes[queue == q].sum() for q in range(4)]) / sizes.sum()
    order, turn = packing.rounds(sizes, queue, share, np.array(owed, dtype=float), 120)
    assert sorted(order) == list(range(len(items)))
    last = turn.max()
    for q in range(4):
        mine = [i for i in order if queue[i] == q]
        assert mine == sorted(mine)  # a queue is served in its order
        for w in range(last):
            given_, due = sum(sizes[i] for i in mine if turn[i] <= w), share[q] * 120 * (w + 1) + owed[q]
            half = max((sizes[i] for i in mine), default=0) / 2
            if 0 < given_ < sizes[queue == q].sum():
                assert abs(given_ - due) <= half + 1e-6


def test_best_fit_equals_searching_all():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 50) for _ in range(40)]
        where, used = packing.best_fit(sizes, 50)
        rooms: list[int] = []
        for i in sorted(range(40), key=lambda i: -sizes[i]):
            fits = [r for r in rooms if r >= sizes[i]]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 50) - sizes[i])
        assert sorted(50 - u for u in used) == sorted(rooms) and [sum(s for s, c in zip(sizes, where, strict=True) if c == k) for k in range(len(used))] == used


def test_containers_follow_the_mixture():
    rng = np.random.default_rng(0)
    sizes, queue = rng.integers(5, 40, 4000), rng.integers(0, 3, 4000)
    share = np.array([sizes[queue == q].sum() for q in range(3)]) / sizes.sum()
    where = packing.fill(sizes, queue, share, np.zeros(3), 500, window=16)
    used = np.bincount(where, weights=sizes)
    assert used.max() <= 500 and (used[:-1] >= packing.FULL * 500).mean() > 0.95
    for w in range(int(where.max()) // 16):
        mine = where // 16 == w
        got = np.array([sizes[mine & (queue == q)].sum() for q in range(3)]) / sizes[mine].sum()
        assert np.abs(got - share).max() < 0.05, (w, got, share)


@pytest.mark.parametrize(("bucket", "most"), [(50_000, 0.03), (700, 0.12)])  # a small bucket's own mixture differs
def test_windows_follow_the_mixture_from_the_first_to_the_last(spark, bucket, most):
    # most tokens of 'long' are full pieces; ids are sorted by source
    rows = [(n, "word " * (700 + n * 37 % 400 if n < 200 else 10 + n * 7 % 40), None, "long" if n < 200 else ("b", "c")[n % 2], 0, None, None, None) for n in range(2200)]
    kinds, docs = spark.createDataFrame([("s", 256)], "container string, capacity int"), spark.createDataFrame(rows, DOCS)
    packed = packing.pack(docs, kinds, bucket_rows=bucket)
    got = packing.mixture_report(packed, docs).collect()
    whole = [r for r in got if r["tokens"] > 100 * 256]
    assert sum(r["tokens"] for r in whole) > 0.8 * sum(r["tokens"] for r in got)
    assert all(r["distance"] < most for r in whole), got
    by = {(r["container"], r["window"]): r for r in got}
    source = {r[0]: r[3] for r in rows}
    sums: dict = {}
    for r in packed.collect():
        w = sums.setdefault(("s", r["container_no"] // packing.WINDOW), {})
        w[source[r["doc_id"]]] = w.get(source[r["doc_id"]], 0) + r["tokens"]
    every = {q: sum(w.get(q, 0) for w in sums.values()) for q in ("long", "b", "c")}
    for key, w in sums.items():
        tokens_, goal = sum(w.values()), {q: n / sum(every.values()) for q, n in every.items()}
        assert by[key]["tokens"] == tokens_ and abs(by[key]["distance"] - sum(abs(w.get(q, 0) - goal[q] * tokens_) for q in goal) / 2 / tokens_) < 1e-5


def test_second_round_follows_the_mixture_of_many_sources(spark):
    # more sources than any fixed number of them; no container of the first round is full enough
    rows = [(n, "word " * (199 if n < 100 else 133), None, "hot" if n < 100 else f"s{n}", 0, None, None, None) for n in range(300)]
    rows += [(n, "", None, f"s{n}", 0, None, None, None) for n in range(1000, 101_200)]
    kinds = spark.createDataFrame([("s", 700)], "container string, capacity int")
    got = [r for r in packing.pack(spark.createDataFrame(rows, DOCS), kinds, bucket_rows=1_000_000).collect() if r["tokens"]]
    assert len(got) == 300 and len({r["container_no"] for r in got}) < 75
    used = {}
    for r in got:
        used[r["container_no"]] = used.get(r["container_no"], 0) + r["tokens"]
    assert max(used.values()) <= 700


@pytest.mark.parametrize("bucket", [50_000, 7])
def test_pack(spark, bucket):
    rows = [(n, "word " * (n * 7 % 90), None, ["a", "b", None][n % 3], 0, None, None, None) for n in range(60)]
    rows += [(100, None, None, "a", None, None, None, None), (101, "", None, None, 0, None, None, None), (102, "long " * 900, None, "b", 0, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as bucket", "2 as queue", "3 as container", "4 as tokens")
    kinds = spark.createDataFrame([("s", 64), ("s", 50), ("m", 300), (None, 5), ("zero", 0), ("none", None)], "container string, capacity int")
    got = packing.pack(docs, kinds, bucket_rows=bucket).collect()
    n_tokens = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, ["doc_id"]).collect()}
    for kind, capacity in (("s", 64), ("m", 300)):
        mine = [r for r in got if r["container"] == kind]
        used = {}
        for r in mine:
            used[r["container_no"]] = used.get(r["container_no"], 0) + r["tokens"]
        used.pop(None)
        assert max(used.values()) <= capacity
        for d, n in n_tokens.items():
            parts = sorted((r["piece"], r["token_start"], r["tokens"]) for r in mine if r["doc_id"] == d)
            assert sum(p[2] for p in parts) == n and (len(parts) == 1) == (n <= capacity)
            assert [p[1] for p in parts] == [k * capacity for k in range(len(parts))]
        assert all((r["container_no"] is None) == (r["tokens"] == 0) for r in mine)
        assert len(used) <= -(-sum(n_tokens.values()) // capacity) * 1.15 + 2
    assert {r["container"] for r in got} == {"s", "m"}
    assert packing.pack(docs.limit(0), kinds).collect() == [] and packing.pack(docs, kinds.limit(0)).collect() == []
    report = {r["container"]: r["used"] for r in packing.fill_report(packing.pack(docs, kinds), kinds).collect()}
    assert set(report) == {"s", "m"} and all(0 < u <= 1 for u in report.values())


# ------------------------------------------------------------------ files not written by hand

BODY = "".join(f"def step_{w}(a):\n    return a + {len(w)}\n\n" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())


def test_not_handwritten(spark):
    plain = "import os\n\n" + BODY
    cases = {
        1: ("r", "src/a.py", plain, None),
        2: ("r", "vendor/lib/a.py", "x = 1\n", "vendored"),
        3: ("r", "src/vendor_portal/a.py", plain.replace("alpha", "one"), None),
        4: ("r", "src/x_pb2.py", None, "generated"),
        5: ("r", "src\\gen.go", "// Licence\n// Code generated by tool. DO NOT EDIT.\npackage a\n", "generated"),
        6: ("r", "src/b.py", "# The generated reports are read from here; nothing in this file is generated.\n" + plain.replace("beta", "two"), None),
        7: ("r", "src/c.js", "const HEADER = '// @generated, do not edit';\n" + "function write(out) {\n  out.push(HEADER);\n}\n" * 3, None),
        8: ("r", "src/d.js", "!function(e){" + "".join(f"var a{k}=e[{k}];" for k in range(200)) + "}(this);", "minified"),
        9: ("r", "src/e.py", "T = [\n" + "".join("  " + ", ".join(str(k * j % 997) for j in range(12)) + ",\n" for k in range(20)) + "]\n", "data"),
        10: ("r", "src/f.py", "".join(f"def get_{k}(r):\n    return r.f[{k}]\n\n" for k in range(40)), "generated"),
        11: ("r", "src/g.c", "/** Auto-generated method stub */\n" + "int f(int a) { return a; }\n", None),
        12: ("tool", "src/h.py", "# Copyright 2020 The Tool Project Contributors\n" + plain.replace("gamma", "three"), None),
        13: ("r", "src/i.py", "# lib, version 2\n# Copyright 2020 The Lib Project Contributors\n" + plain.replace("gamma", "four"), "vendored"),
        14: ("q", "copied/lib/one.py", BODY + "# one\n", "vendored"),
        15: ("q", "copied/lib/two.py", BODY + "# two\n", "vendored"),
        16: ("p", "lib/one.py", BODY + "# one\r\n", None),
        17: ("p", "lib/two.py", BODY + "# two\n", None),
        **{k: (("p", "q")[k % 2], f"own/{k}.py", BODY.replace("alpha", f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}"), None) for k in range(30, 50)},
        18: ("r", "src/j.py", plain.replace("delta", "five") + "\n\n# Diese Datei wird von x erzeugt und bei jedem Lauf überschrieben.\n\n", "generated"),
        19: ("r", "src/k.py", plain.replace("delta", "six") + "HEADER = '# Code generated by %s. DO NOT EDIT.'\n", None),
        60: (None, None, None, None),
        61: ("r", "src/empty.py", "", None),
    }
    rows = [(k, r, p, None, t, None, NEW) for k, (r, p, t, _) in cases.items()] + [(1, "r", "src/a.py", None, "// @generated by x\n", 1, OLD), (1, "r", "src/a.py", None, plain, 1, NEW), (None, "r", "vendor/x.py", None, "x", 1, NEW)]
    df = spark.createDataFrame(rows, FILES).selectExpr("*", "1 as h", "'a' as reason", "2 as parts", "3 as bytes")
    got = {r["file_id"]: r["reason"].split(":")[0] for r in handwritten.not_handwritten(df).collect()}
    assert got == {k: want for k, (_, _, _, want) in cases.items() if want}
    assert handwritten.not_handwritten(df.limit(0)).collect() == []


def _texts(repo, *words):
    return {f"{repo}/{w}.js": f"// {repo} {w}\n" + "".join(f"export function {w}_{v}(a) {{\n  return a + '{repo} {v}';\n}}\n\n" for v in "alpha beta gamma delta epsilon zeta eta theta".split()) for w in words}


def _copied(spark, repos):
    rows = [(None, repo, path, None, text, None, NEW) for repo, files in repos.items() for path, text in files.items()]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], FILES)
    got = {r["file_id"] for r in handwritten.not_handwritten(df).collect()}
    return {(r[1], r[2]) for n, r in enumerate(rows) if n in got}


def test_shared_subtrees_of_repos_that_are_no_forks(spark):
    own = {r: _texts(r, *"abcdefghijklmn") for r in ("p", "q")}
    nested = {f"pkgs/{w}/src/{w}.js": t for w, t in zip("xyz", _texts("lib", *"xyz").values(), strict=True)}
    # 3 files of 17 in nested directories of one file each
    got = _copied(spark, {"p": own["p"] | nested, "q": own["q"] | {f"more/{k}": t for k, t in nested.items()}})
    assert got == {("q", f"more/{k}") for k in nested}
    # most of q's files are copies of another repo's, below a directory of its own
    lib = _texts("lib", *"abcdef")
    got = _copied(spark, {"lib": lib | _texts("lib", *"uvwxyz"), "q": _texts("q", "a", "b") | {f"ext_src/{k}": t for k, t in lib.items()}})
    assert got == {("q", f"ext_src/{k}") for k in lib}


def test_forks_are_one_witness(spark):
    base, lib = _texts("base", *"abcdefgh"), _texts("lib", *"xyz")
    # a chain of forks alone shares nothing with unrelated repos
    chain = {"o": base | _texts("o", *"ij"), "f": base | _texts("f", "i"), "g": {k: t for k, t in base.items() if k[5] in "abcdef"}}
    assert _copied(spark, chain) == set()
    # what a fork and its origin took from an unrelated repo is found in both
    took = {f"inner/{k}": t for k, t in lib.items()}
    got = _copied(spark, {"o": base | took, "f": base | took, "z": lib | _texts("z", *"abcdefgh")})
    assert got == {(r, k) for r in "of" for k in took}


def test_shared_projects_and_small_shared_files(spark):
    own = {r: _texts(r, *"abcdefgh") for r in ("p", "q", "o")}
    small = "module.exports = {\n  pad: (s) => s,\n};\n"
    got = _copied(
        spark,
        {
            "p": own["p"] | {"extern/padder/x.js": "// p\n" + small, "src/tiny.js": small, "lib/html.js": "<html>\n404\n</html>", "src/old.js": "// padder 1.2\nlet a = 1;\n", "src/own.js": "// p 1.2\nlet a = 4;\n"},
            "q": own["q"] | {"Deps/Padder/y.js": "// q\n" + small, "web/tiny.js": small, "lib/page.js": "<html>\n404\n</html>", "src/new.js": "// we tried padder and left it\nlet a = 2;\n", "deps/alone/z.js": "let z = 1;\n"},
            "o": own["o"] | {"src/banner.js": "/*! Padder v3.0.1 | MIT */\nlet a = 3;\n", "src/none.js": "// alone 2.0\nlet a = 5;\n"},
        },
    )
    # one home of tiny.js is left; a name that one repo alone keeps is no project, though its place is a vendoring one
    assert got - {("p", "src/tiny.js"), ("q", "web/tiny.js")} == {("p", "extern/padder/x.js"), ("q", "Deps/Padder/y.js"), ("q", "deps/alone/z.js"), ("p", "src/old.js"), ("o", "src/banner.js")}
    assert len(got & {("p", "src/tiny.js"), ("q", "web/tiny.js")}) == 1


def test_merkle_nodes_equal_walking_the_trees(spark, tmp_path):
    from tracewood.session import Workspace

    rng = random.Random(2)
    rows = [(n, f"r{rng.randrange(3)}", [*rng.choices("abc", k=rng.randrange(4)), f"f{n % 5}"], rng.randrange(3), 0, 5, False) for n in range(90)]
    rows = list({(r[1], *r[2]): r for r in rows}.values())
    rows = [r for r in rows if not any(o[1] == r[1] and len(o[2]) > len(r[2]) and o[2][: len(r[2])] == r[2] for o in rows)]
    df = spark.createDataFrame(rows, "file_id int, repo string, parts array<string>, h long, g long, lines long, vendored boolean")
    nodes = handwritten.merkle_nodes(df, Workspace(spark, "test")).filter("n > 1 or path not like '%f_'").collect()
    trees: dict = {}
    for r in rows:
        for k in range(1, len(r[2])):
            trees.setdefault((r[1], "/".join(r[2][:k])), set()).add(("/".join(r[2][k:]), r[3]))
    assert {(n["repo"], n["path"]): n["n"] for n in nodes} == {k: len(v) for k, v in trees.items()}
    same = {}
    for n in nodes:
        same.setdefault((n["h"], n["g"]), set()).add(frozenset(trees[n["repo"], n["path"]]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({frozenset(v) for v in trees.values()})


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ("// Code generated by stringer; DO NOT EDIT.", "generated"), ("# This file was automatically generated from api.yaml", "generated"), ("/* Auto-generated file. Changes will be lost. */", "generated"), ("// Diese Datei wurde aus schema.xml generiert.", "generated"), ("// Ce fichier est généré par swagger", "generated"), ("# Este archivo fue generado por protoc", "generated"),
        ("// Do not edit without asking.", None), ("# None of this file is generated by a tool.", None), ("// Auto-generated method stub", None), ("# This file was written by Jo.", None), ("// reads the generated index", None), ("// Rien dans ce fichier n'est généré par un outil", None),
        ("// Bundled copy of zlib 1.2", "vendored"), ("# unveränderte Kopie von xyz 2.0", "vendored"), ("// (c) 2019 the foo authors", "vendored"), ("// (c) the r authors", None), ("// copy the rows first", None), ("// version 1.2 of the layout", None),
    ],
)
def test_header_rules(spark, head, want):
    rows = [(1, "r", "src/a.x", None, head + "\n\nlet a = 1\n", 1, NEW)]
    df = spark.createDataFrame(rows, FILES).withColumn("parts", handwritten.F.split("relative_path", "/"))
    assert (handwritten.with_evidence(df).first()["rule"] or ":").split(":")[0] == (want or "")


# ------------------------------------------------------------------ functions and documentation


@pytest.mark.parametrize(
    ("doc", "signature", "want"),
    [
        ("Blocks.", "fn x()", True), ("Linear time.", "def a", True), ("restore spare route\n\n@param rows the rows\n@param right the right", "def restore_spare_route(rows, right)", False), ("This is the function that lifts the ward; it lifts the ward.", "lift_ward(a)", False),
        ("TODO", "f", False), ("todo: document this", "f", False), ("n/a", "f", False), ("—", "f", False), ("# ------", "f", False), ("noqa: D103", "f", False), ("eslint-disable-next-line", "f", False), ("{@inheritDoc}", "f", False), ("return left + old(left)", "f(left)", False), ("Zu dokumentieren.", "f", False), ("siehe oben", "f", False),
        (":param a:\n:return:", "f(a)", False), ("@param a must not be null", "f(a)", True), ("Cancel a late orchard and return it.", "def cancel_late_orchard(a)", False), ("Ignore les lignes sans date.", "f", True), ("/** Units: seconds since midnight. */", "f", True), ("   ", "f", False), (None, "f", False), ("Deprecated: the token does the same.", "f()", True), ("Auto-generated method stub", "f", False), ("x: Idempotent.", "x()", True),
    ],
)
def test_says_something(doc, signature, want):
    assert pairs.says_something(doc, signature) is want


REG = "node long, file_id long, repo string, symbol string, docs string, spans struct<start:int,end:int>, read_at timestamp"


def _span(text, start, end):
    a = text.index(start)
    return (len(text[:a].encode()), len(text[: text.index(end, a) + len(end)].encode()))


def test_documented_functions(spark):
    py = "# Ö head\nLIMIT = 3\n\n# Waits for the pump.\n@deco\ndef wait(a):\n    return a\n\ndef bare(a):\n    # Not above.\n    return a\n\n\ndef quoted(a):\n    '''Fails when empty.'''\n\nclass Box:\n    '''Holds rows.'''\n    def take(self):\n        '''take'''\n        s = '''\ndef fake(): pass\n'''\n"
    js = "/** Rounds half up. */\r\nexport const round = async (x) => {\r\n  return `a ${x}\n// Never.\nfunction no() {}`;\r\n};\r\n\r\n// Far.\r\n\r\nfunction far(x) {\r\n  return x;\r\n}\r\nclass K {\r\n  // Only once.\r\n  go(x) {\r\n    if (x) { return 1; }\r\n  }\r\n}\r\n"
    d, far = NEW, _span(js, "function far", "x;\r\n}")
    rows = [
        (1, 1, "r", "a.py#wait", None, _span(py, "def wait", "return a"), d), (2, 1, "r", "a.py#bare", None, _span(py, "def bare", "return a"), d), (3, 1, "r", "a.py#quoted", None, _span(py, "def quoted", "empty.'''"), d), (4, 1, "r", "a.py#Box", "Holds rows.", _span(py, "class Box", "fake(): pass\n'''"), d), (5, 1, "r", "a.py#Box.take", None, _span(py, "def take", "fake(): pass\n'''"), d),
        (6, 1, "r", "a.py#LIMIT", "Upper bound.", _span(py, "LIMIT", "3"), d), (7, 2, "r", "b.js#round", None, _span(js, "export const round", "};"), d), (8, 2, "r", "b.js#far", None, far, d), (9, 2, "r", "b.js#K.go", None, _span(js, "go(x)", "}\r\n  }"), d), (10, 2, "r", "b.js#far", "Linear time.", far, d),
        (11, 2, "r", "b.js#far", " ", far, d), (12, 2, "r", "b.js#far", "Linear time.", (5, 99_999), d), (13, 2, "r", "b.js#far", "Linear time.", None, d), (14, None, "r", None, "Linear time.", (0, 4), d), (15, 9, "r", "z.py#x", "Linear time.", (0, 4), d), (None, 1, "r", "a.py#wait", "Linear time.", _span(py, "def wait", "return a"), d),
        (16, 1, "r", "a.py#wait", "Old words.", _span(py, "def wait", "return a"), OLD), (16, 1, "r", "a.py#wait", "TODO", _span(py, "def wait", "return a"), d), (16, 1, "r", "a.py#wait", "TODO", _span(py, "def wait", "return a"), d), (17, 2, "r", "b.js#no", None, _span(js, "function no", "{}"), d), (18, 1, "r", "a.py#fake", "Linear time.", _span(py, "def fake", "pass"), d), (19, 2, "r", "b.js#far", "Linear time.", (-1, 3), None),
        (20, 2, "r", "b.js#far", "Linear time.", (far[0], far[1] - 3), d), (21, 2, "r", "b.js#far", "Linear time.", (far[0], far[1] + 9), d), (22, 2, "r", "b.js#K.go", "Linear time.", _span(js, "go(x)", "return 1; }"), d), (23, 1, "r", "a.py#wait", "Linear time.", _span(py, "# Waits", "return a"), d), (24, 1, "r", "a.py#wait", "Linear time.", _span(py, "def wait", "return"), d),
    ]
    files = [(1, "r", "a.py", None, "gone", 1, OLD), (1, "r", "a.py", None, py, 1, NEW), (1, "r", "a.py", None, py, 1, NEW), (2, "r", "b.js", None, js, 1, NEW), (9, "r", "z.py", None, None, 0, NEW), (9, "r", "z.py", None, "def x(): pass", 0, OLD), (8, "r", "y.py", None, "", 0, NEW), (None, "r", "y.py", None, "def x(): pass", 0, NEW)]
    reg = spark.createDataFrame(rows, REG).selectExpr("*", "1 as start", "2 as place", "'q' as name", "4 as ends")
    docs = spark.createDataFrame(files, FILES).selectExpr("*", "1 as uid", "2 as line", "3 as kind", "4 as at")
    got = {r["node"]: r["description"] for r in pairs.documented_functions(reg, docs).collect()}
    assert sorted(got) == [1, 3, 7, 9, 10, 23] and got[1] == "# Waits for the pump." and got[3] == "Fails when empty."
    code = {r["node"]: r["code"] for r in pairs.code_pairs(reg, docs).collect()}
    assert code[1] == "def wait(a):\n    return a" and code[7].startswith("export const round") and code[7].endswith("};")
    assert pairs.documented_functions(reg.limit(0), docs).collect() == [] and pairs.documented_functions(reg, docs.limit(0)).collect() == []


CASES = {
    "several on a line": ("js", "function a(x) { return {k: x}; } function b(y) { if (y) { z(); } }\n", {"a": "function a(x) { return {k: x}; }", "b": "function b(y) { if (y) { z(); } }"}),
    "behind a statement": ("js", "var q = 1; function c(x) {\n  return x;\n}\n", {"c": "function c(x) {\n  return x;\n}"}),
    "unclosed": ("js", "function a() {\n  if (x) {\n    y('}');\n  }\n}\nfunction b() {\n", {"a": "function a() {\n  if (x) {\n    y('}');\n  }\n}", "b": None}),
    "braces in the signature": ("ts", "export function f({ a, b }: { a: T }, c = {}): { r: U } {\n  return g(c);\n}\n", {"f": "export function f({ a, b }: { a: T }, c = {}): { r: U } {\n  return g(c);\n}"}),
    "arrows": ("js", "const a = (x) => x + 1;\nconst b = x => ({ y: x });\nlet c = async (x) => {\n  return x;\n};\nfoo.bar = function (q) { return q; };\n", {"a": "const a = (x) => x + 1;", "b": "const b = x => ({ y: x });", "c": "let c = async (x) => {\n  return x;\n}", "foo.bar": "foo.bar = function (q) { return q; }"}),
    "declarations": ("ts", "declare function later(a: string): void;\nfunction now(a: string) { return 1; }\n", {"later": "declare function later(a: string): void;", "now": "function now(a: string) { return 1; }"}),
    "go": ("go", "func (s *T) M(a interface{}) map[string]struct{} {\n\tx := []int{1}\n\treturn nil\n}\n\nfunc N() {}\n", {"M": "func (s *T) M(a interface{}) map[string]struct{} {\n\tx := []int{1}\n\treturn nil\n}", "N": "func N() {}"}),
    "rust": ("rs", "impl<'a> A<'a> {\n    pub fn f(&'a self, c: char) -> bool {\n        c == '{' || c == '\\''\n    }\n    fn g(&self);\n}\n", {"f": "pub fn f(&'a self, c: char) -> bool {\n        c == '{' || c == '\\''\n    }", "g": "fn g(&self);"}),
    "python": ("py", "class K:\n    def a(self):\n        if x:\n            y\n        # inside\n\n    async def b(\n        self,\n        c=[1],\n    ) -> int:\n        return 1\ndef c(): return 2\ndef d(x):\n    s = '''\nq\n'''\n", {"a": "def a(self):\n        if x:\n            y", "b": "async def b(\n        self,\n        c=[1],\n    ) -> int:\n        return 1", "c": "def c(): return 2", "d": "def d(x):\n    s = '''\nq\n'''"}),
    "ruby": ("rb", "class K\n  def a(x)\n    if x\n      1\n    end\n  end\n\n  def self.b\n    2\n  end\nend\n", {"a": "def a(x)\n    if x\n      1\n    end\n  end", "self.b": "def self.b\n    2\n  end"}),
    "braces and def": ("md", "def a():\n    return {1: 2}\n\nfunction b() {\n  return 1;\n}\n", {"a": "def a():\n    return {1: 2}", "b": "function b() {\n  return 1;\n}"}),
}


def test_depth_windows_end_functions(spark):
    names = list(CASES)
    rows = spark.createDataFrame([(n, "r", f"é{n}.{CASES[k][0]}", None, "// ünï\n\n" + CASES[k][1], 1, NEW) for n, k in enumerate(names)], FILES)
    got = {}
    for r in pairs.function_units(rows).collect():
        raw = ("// ünï\n\n" + CASES[names[r["file_id"]]][1]).encode()
        got.setdefault(names[r["file_id"]], {})[r["name"]] = None if r["ends"] is None else raw[r["start"] : r["ends"]].decode()
    for k in names:
        assert got[k] == CASES[k][2], k


def test_the_plan_holds_the_depth_window(spark):
    files, reg = spark.createDataFrame([], FILES), spark.createDataFrame([], REG)
    plan = pairs.documented_functions(reg, files)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(delta" in plan and "lag(" in plan and "closed" in plan


@pytest.mark.parametrize(
    ("head", "doc"),
    [('def f(a="it\\"s (", b=1):', "Waits."), ("def f(\n    a,  # not (closed\n    b,\n) -> Dict[str, int]:", "Waits."), ("def f(a: 'x:y' = {1: 2}, *b):  # note", "Waits."), ("def f(a" + ", b" * 300 + "):", "Waits.")],
)
def test_docstring_is_the_first_string_of_the_body(head, doc):
    for quote in ('"""', "'''", '"', "'"):
        for body in (f"\n    {quote}{doc}{quote}\n    return 1\n", f"\n    # why\n\n    r{quote}{doc}{quote}\n", f"\n    u{quote}{doc}{quote} ; x\n"):
            found = [r for r in pairs.scan(head + body) if r[3] == pairs.HEAD]
            assert len(found) == 1 and found[0][9] == doc, (head, body)
    assert [r[9] for r in pairs.scan(head + "\n    x = \"no\"\n") if r[3] == pairs.HEAD] == [None]


# ------------------------------------------------------------------ subjects

AREA = "subject string, about string"
LABEL = "doc_id long, annotator string, subject string, labelled_at timestamp"
WORDS = {"law": "verdict judge statute appeal witness".split(), "music": "sonata violin melody drum chord".split(), "farming": "barley silo tractor pasture herd".split()}


def _corpus(n, seed):
    rng = random.Random(seed)
    docs, gold = [], {}
    shapes = ["When the {} meets the {}, the {} is shown first.", "Each {} keeps its own {} beside the {}.", "A {} without a {} is listed under the {}."]
    fill = ["This part is still a draft.", "Nothing else changes.", "Keep the order of the list."]
    for i in range(n):
        mine = set(rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2])))
        lines = [rng.choice(shapes).format(*rng.sample(WORDS[s], 3)) for s in mine for _ in range(3)] + rng.sample(fill, 2)
        if rng.random() < 0.3:
            other = rng.choice(sorted(set(WORDS) - mine))
            lines.append(f"Not to be mixed up with the {rng.choice(WORDS[other])} of the same name.")
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), "en", "r" if i % 5 else None, 1, ["markdown", None][i % 2], None, NEW))
        gold[i] = mine
    return docs, gold


def test_held_out_subjects(spark):
    docs, gold = _corpus(600, 1)
    labels = [(i, f"a{k}", s.title() if i % 7 == 0 else s, NEW) for i in range(200) for k in range(1 + i % 2) for s in (gold[i] or {"none"})] + [(3, "a9", None, NEW), (None, "a1", "law", NEW), (4, None, "no such subject", NEW)]
    docs += [(900, None, None, None, None, None, None, None), (901, "", None, None, 0, None, None, None), (902, " \n\t ", None, None, 3, None, None, None), (903, "verdict " * 40_000, None, None, 9, None, None, None), (None, docs[0][1], None, None, 0, None, None, None)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as subject", "2 as word", "3 as n")
    area = spark.createDataFrame([("law", "courts and statutes"), ("music", None), ("farming", "crops"), (None, "x")], AREA)
    found = topics.subjects_of(df, spark.createDataFrame(labels, LABEL), area).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == gold[i] for i in range(200, 600))
    assert right >= 0.95 * 400
    assert not {None, 900, 901, 902} & set(got) and len(found) == len(set(found))


def test_subjects_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    labels, area = spark.createDataFrame([], LABEL), spark.createDataFrame([("law", "courts"), ("music", "singing")], AREA)
    assert topics.subjects_of(empty, labels, area).collect() == []
    some = spark.createDataFrame([(1, "courts courts everywhere", None, None, 0, None, None, None)], DOCS)
    topics.subjects_of(some, labels, area).collect()
    assert topics.subjects_of(some, labels, area.limit(0)).collect() == []


def test_beam_search_finds_the_best_set():
    rng = np.random.default_rng(3)
    model = topics.Model(list("abcde"), together=np.round(rng.normal(size=(5, 5)) * 0.5, 2), order=[2, 0, 4, 1, 3])
    logits, chain = rng.normal(size=(20, 5)) * 2, np.array([-0.5, -2.0, 0.7])
    got = model.decode(logits, np.tile(chain, (5, 1)))

    def score(row, chosen):
        total, before = 0.0, np.zeros(5, dtype=bool)
        for s in model.order:
            z = row[s] + chain[0] * (before.sum() == 1) + chain[1] * (before.sum() > 1) + chain[2] * (before @ model.together[s])
            total += -np.logaddexp(0, -z) if chosen[s] else -np.logaddexp(0, z)
            before[s] = chosen[s]
        return total

    every = [np.array([b >> k & 1 for k in range(5)], dtype=bool) for b in range(32)]
    best = [max(score(row, c) for c in every) for row in logits]
    assert sum(np.isclose(score(row, c), b) for row, c, b in zip(logits, got, best, strict=True)) >= 19
