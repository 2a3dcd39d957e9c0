"""Rankings against brute force, and what they shuffle."""

import math
import random

from tracewood.operators import ranking, retrieval
from tracewood.session import Workspace


def shuffled(spark, act) -> int:
    """Rows that stages write for others while ``act`` runs."""

    def total() -> int:
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    act()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def brute(asked: dict[int, list[str]], names: dict[int, list[str]], top: int) -> list[tuple]:
    df = {t: sum(t in ws for ws in names.values()) for ws in names.values() for t in ws}
    rows = []
    for q, terms in asked.items():
        scored = []
        for node, ws in names.items():
            met = [(math.log((len(names) - df[t] + 0.5) / (df[t] + 0.5) + 1), 100 * ws.count(t)) for t in sorted(set(terms)) if t in ws]
            if met:
                scored.append((-round(sum(i * f * 2.2 / (f + 1.2) for i, f in met) * len(met), 6), node, len(met)))
        rows += [(q, node, -s, n, k) for k, (s, node, n) in enumerate(sorted(scored)[:top], 1)]
    return rows


def bm25_rows(spark, asked, names, top):
    known = spark.createDataFrame([(v, " ".join(ws), None) for v, ws in names.items()], "node long, symbol string, docs string")
    ask = spark.createDataFrame([(q, " ".join(ws)) for q, ws in asked.items()], "query long, text string")
    return retrieval.bm25(ask, retrieval.postings(known), retrieval.lengths(known), top)


def test_bm25_equals_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERIES", 7)
    monkeypatch.setattr(ranking, "NODES", 50)
    r = random.Random(4)
    words = [f"w{k:02}" for k in range(25)]
    names = {v: r.choices(words, k=r.randint(1, 5)) for v in r.sample(range(-300, 300), 240)}
    asked = {q: r.choices(words + ["zz"], k=r.randint(0, 6)) for q in range(20)}
    got = [(r["query"], r["node"], round(r["score"], 5), r["coverage"], r["rank"]) for r in bm25_rows(spark, asked, names, 9).orderBy("query", "rank").collect()]
    assert got == [(q, v, round(s, 5), n, k) for q, v, s, n, k in brute(asked, names, 9)]


def test_bm25_shuffles_no_row_per_query_and_node(spark):
    names = {v: ["common", f"n{v % 7}"] for v in range(2000)}
    asked = {q: ["common", f"n{q % 9}"] for q in range(200)}
    assert shuffled(spark, lambda: bm25_rows(spark, asked, names, 3).count()) < 40_000  # 400,000 share a word


def test_search_shuffles_no_row_per_query_and_node(spark):
    known = spark.createDataFrame([(v, f"common n{v % 7}", None) for v in range(2000)], "node long, symbol string, docs string")
    ask = spark.createDataFrame([(q, f"common n{q % 9}") for q in range(200)], "query long, text string")
    assert shuffled(spark, lambda: retrieval.search(ask, known, 3).count()) < 40_000


def test_grep_ranks_files_where_they_lie(spark):
    from tracewood.operators import quality

    files = {f: f"prefix common number{f % 7:02} {'query ' * (f % 3)}" for f in range(3000)}
    asked = {q: f"Common quer{q % 9} number{q % 8:02} numberless" for q in range(200)}
    ask = spark.createDataFrame(list(asked.items()), "query long, text string")
    have = spark.createDataFrame(list(files.items()), "file_id long, text string")
    got: dict[int, list] = {}

    def act():
        for r in quality.grep(ask, have, 4, block=2).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["file_id"], r["hits"]))

    moved = shuffled(spark, act)
    for q, text in asked.items():
        stems = {w[:5] for w in text.lower().split()}
        counts = [(-sum(s in t for s in stems), f) for f, t in files.items()]
        assert got[q] == [(f, -n) for n, f in sorted(counts)[:4]]
    assert moved < 60_000  # 600,000 pairs share a stem


def test_vocabulary_suggestion_shuffles_no_row_per_query_and_node(spark):
    known = spark.createDataFrame([(v, f"f{v % 7}.py#commonName{v % 7:02}Extra", None) for v in range(2000)], "node long, symbol string, docs string")
    ask = spark.createDataFrame([(q, f"common name{q % 9:02}") for q in range(200)], "query long, text string")
    index, rows = retrieval.postings(known), []
    moved = shuffled(spark, lambda: rows.extend(retrieval.vocabulary_suggestion(retrieval.bm25(ask, index, retrieval.lengths(known), 10), known, index, ask).collect()))
    assert {r["query"] for r in rows} == set(range(200)) and moved < 80_000


def suggested_by_hand(asked: dict[int, list[str]], symbols: dict[int, tuple[list[str], list[str], list[str]]]) -> list[tuple]:
    """symbols: of each node the words of its file stem, of its name and of its documentation; every stem lies in a ``.py`` file."""
    freq = {}
    for v, (stem, name, doc) in symbols.items():
        said = [*stem, "py", *name] if name else []
        freq[v] = {w: 100 * said.count(w) if w in said else 3 * doc.count(w) for w in [*said, *doc]}
    df = {w: sum(w in ws for ws in freq.values()) for ws in freq.values() for w in ws}
    n, rows = sum(bool(name) for _, name, _ in symbols.values()), []
    for q, terms in asked.items():
        scored = []
        for v, ws in freq.items():
            met = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * ws[t] * 2.2 / (ws[t] + 1.2) for t in sorted(set(terms)) if t in ws]
            if met:
                scored.append((-round(sum(met) * len(met), 6), v))
        told = {}
        for _, v in sorted(scored)[:10]:
            for w, k in [(w, 2) for w in symbols[v][1]] + [(w, 1) for w in symbols[v][0]]:
                if len(w) > 2 and w not in terms:
                    told[w] = told.get(w, 0) + k
        ranked = sorted((-round(k / math.sqrt(df[w]), 6), w) for w, k in told.items())[:6]
        rows += [(q, w, -x, k) for k, (x, w) in enumerate(ranked, 1)]
    return rows


def test_vocabulary_suggestion_splits_texts_once(spark, tmp_path):
    from tracewood.plans import code_queries

    r = random.Random(6)
    words = [f"word{k:02}" for k in range(30)]
    symbols = {v: ([r.choice(words)], ["common", *r.choices(words, k=2)], r.choices(words, k=v % 2)) for v in range(3000)}
    symbols |= {v: ([], [], ["common", r.choice(words)]) for v in range(3000, 3020)}  # no name, so not counted among the symbols
    rows = [(v, f"src/{''.join(s)}.py#{n[0]}{''.join(w.title() for w in n[1:])}" if n else "#", " ".join(d) or None, 2) for v, (s, n, d) in symbols.items()]
    rows += [(v, "src/stale.py#staleName", "stale", 1) for v in range(0, 3000, 5)]
    spark.createDataFrame(rows, "node long, symbol string, docs string, at int").selectExpr("node", "node file_id", "'r' repo", "symbol", "docs", "struct(0 start, 1 end) spans", "timestamp_seconds(at) read_at").write.parquet(f"{tmp_path}/symbol_registry.parquet")
    asked = {50 * q: ["common", *r.choices(words, k=3)] for q in range(1, 61)}
    spark.createDataFrame([(q, " ".join(ws)) for q, ws in asked.items()] + [(51, "common word01"), (100_000, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    moved = shuffled(spark, lambda: got.extend(code_queries.vocabulary_suggestion(spark, str(tmp_path)).orderBy("query", "rank").collect()))
    assert [(x["query"], x["word"], round(x["weight"], 6), x["rank"]) for x in got] == suggested_by_hand(asked, symbols)
    assert moved < 12_000  # 180,000 pairs share a word; the registry's 3,620 rows are gathered twice
