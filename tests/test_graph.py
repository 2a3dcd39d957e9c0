import heapq
import math
import random

import numpy as np
import pytest

from tracewood.model import EDGES, NODES, confidence_floor
from tracewood.operators import community, embed, graph
from tracewood.operators.expand import AUTHORITY, FOREIGN, HALF_LIFE, HOP_DECAY, THRESHOLD, expand


def nodes_of(spark, defined, loose=()):
    return spark.createDataFrame([(n, f"f{n % 3}.py#n{n}", f"f{n % 3}.py", f"n{n}", True) for n in defined] + [(n, f"p{n}", None, f"p{n}", False) for n in loose], NODES)


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, 0, 1.0, k, c, n) for n, (a, b, k, c) in enumerate(rows)], EDGES)


def heap(edges, defined, seeds, hops, width):
    best, queue = {}, []
    for n, w in seeds:
        best[n] = (w if n in defined else w * FOREIGN, 0)
        heapq.heappush(queue, (-w, n, 0))
    near = {}
    for a, b, f in edges:
        near.setdefault(a, []).append((b, f))
    while queue:
        w, n, h = heapq.heappop(queue)
        if best[n][0] > -w or h >= hops:
            continue
        for m, f in near.get(n, ()):
            path = -w * f
            if path < THRESHOLD:
                continue
            rank = path if m in defined else path * FOREIGN
            if m not in best or rank > best[m][0]:
                best[m] = (rank, h + 1)
                heapq.heappush(queue, (-path, m, h + 1))
    return sorted(((n, round(s, 3)) for n, (s, _) in best.items()), key=lambda x: (-x[1], x[0]))[:width]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expansion_equals_a_priority_queue(spark, seed):
    rng = random.Random(seed)
    defined, loose = set(range(20)), set(range(20, 28))
    raw = [(rng.randrange(28), rng.randrange(28), rng.randrange(0, 3) * HALF_LIFE // 3, round(rng.uniform(0.6, 1), 2), rng.randrange(3)) for _ in range(120)]
    df = spark.createDataFrame([(a, b, -age, w, 0, c, n) for n, (a, b, age, w, c) in enumerate(raw)], EDGES)
    factors = [(a, b, AUTHORITY[c] * w * math.exp(-math.log(2) * age / HALF_LIFE) * HOP_DECAY) for a, b, age, w, c in raw]
    seeds = [(0, 1.0), (21, 0.8)]
    got = expand(df, nodes_of(spark, defined, loose), spark.createDataFrame(seeds, "node long, weight double"), 4, 40, now=0)
    assert sorted(((r["node"], r["score"]) for r in got.collect()), key=lambda x: (-x[1], x[0])) == heap(factors, defined, seeds, 4, 40)


def test_callers_levels_and_files(spark):
    nodes = nodes_of(spark, [1, 2, 3, 4], [9])
    edges = edges_of(spark, [(1, 9, 0, 2), (9, 2, 1, 1), (2, 3, 0, 2), (4, 1, 0, 0), (3, 9, 0, 1), (2, 9, 0, 2)])
    assert {(r["node"], r["caller"], r["confidence"]) for r in graph.direct_callers(edges, nodes).collect()} == {(2, 1, 1), (2, 3, 1), (3, 2, 2), (1, 4, 0)}
    levels = graph.reverse_levels(edges, nodes, nodes.filter("node = 3"), 5)
    assert {(r["node"], r["hop"]) for r in levels.collect()} == {(3, 0), (2, 1), (1, 2), (4, 3)}
    assert [r["node"] for r in graph.shortest_path(edges, nodes, 4, 3).orderBy("step").collect()] == [4, 1, 2, 3]
    assert graph.shortest_path(edges, nodes, 3, 4).collect() == []
    assert {(r["from_file"], r["to_file"]) for r in graph.file_graph(edges, nodes).collect()} == {("f1.py", "f2.py"), ("f2.py", "f0.py"), ("f0.py", "f2.py")}
    assert [r["files"] for r in graph.cycles(graph.file_graph(edges, nodes), 3).collect()] == [["f0.py", "f2.py"]]


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert graph.file_graph(edges, nodes).collect() == [] and graph.cohesion(graph.undirected(edges)).collect() == []
    assert graph.reverse_levels(edges, nodes, nodes, 3).collect() == [] and graph.cycles(graph.file_graph(edges, nodes), 3).collect() == []


def test_tombstones_mask_parallel_edges(spark):
    base, added = edges_of(spark, [(1, 2, 0, 0), (1, 2, 0, 2), (2, 3, 0, 1)]), edges_of(spark, [(1, 2, 0, 1)])
    got = graph.union_view(base, added, spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert sorted((r["src"], r["dst"], r["confidence"]) for r in got.collect()) == [(1, 2, 1), (2, 3, 1)]


def test_every_deny_rule_counts(spark):
    pairs = spark.createDataFrame([("a/b.py", "c/d.py", 2), ("a/b.py", "c/d.py.x", 0), ("ab/b.py", "c", 2), ("/r", "c", 2), (None, "c", 2)], "from_file string, to_file string, confidence int")
    many = spark.range(10_500).selectExpr("'many' as rule", "'a' as from_path", "'c' as to_path", "1 as floor")
    assert graph.denied(pairs, many).count() == 10_500
    rules = [(p, p, q, f) for p in ("a", "a/b", "a/b.py", "a/", "b.py", "", "ab", "a/b.p") for q, f in (("c", 0), ("c/d", 1), ("d", 0))]
    got = graph.denied(pairs, spark.createDataFrame(rules, "rule string, from_path string, to_path string, floor int")).collect()
    covers = lambda p, f: f == p or f.startswith((p + "/", p + "."))
    want = [(r, a, b, c) for r, p, q, f in rules for a, b, c in [tuple(x) for x in pairs.collect()] if a is not None and covers(p, a) and covers(q, b) and c >= f]
    assert sorted(tuple(r) for r in got) == sorted(want) and want


def test_cohesion_against_all_pairs(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(15), 2))) for _ in range(45)}
    adjacency = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(b, a, 1) for a, b in pairs], "a long, b long, weight long")
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(15)}
    for r in graph.cohesion(adjacency).collect():
        peers = sorted(near[r["node"]])
        assert r["linked"] == sum((a, b) in pairs for i, a in enumerate(peers) for b in peers[i + 1 :])


def test_partition_keeps_cliques_apart():
    clique = lambda vs: [(a, b, 1.0) for a in vs for b in vs if a < b]
    found, hubs = community.partition(list(range(10)), clique(range(5)) + clique(range(5, 10)) + [(4, 5, 1.0)], {}, {})
    assert len({found[v] for v in range(5)}) == 1 and len({found[v] for v in range(5, 10)}) == 1 and found[0] != found[9] and not hubs
    assert community.connected([(0, 1), (1, 2)], {0, 1, 2}) and not community.connected([(0, 1)], {0, 1, 2})


def test_partition_removes_hubs():
    star = [(0, k, 1.0) for k in range(1, 21)] + [(k, k + 1, 1.0) for k in range(1, 20, 2)]
    _, hubs = community.partition(list(range(21)), star, {0: 20}, {k: f"f{k % 4}" for k in range(21)})
    assert hubs == {0}


@pytest.mark.parametrize("odd", [True, False])
def test_hubs_are_judged_by_all_pairs_of_their_neighbours(odd):
    """Of 130 neighbours the odd ones alone tell the opposite of all: each pair of them is linked and few others, or none and the rest."""
    near = range(1, 131)
    links = [(0, k, 1.0) for k in near] + [(a, b, 1.0) for a in near for b in near if a < b and (a % 2 == b % 2 == 1) == odd]
    plain = [(k, k + 1, 2.0) for k in range(200, 900, 2)]
    nodes = [*range(131), *range(200, 902)]
    _, hubs = community.partition(nodes, links + plain, {0: 1}, {k: f"f{k // 2 % 3}" for k in nodes})
    assert hubs == ({0} if odd else set())


@pytest.mark.parametrize("at_once", [2_000_000, 50])
def test_hubs_equal_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(community, "EDGES_AT_ONCE", at_once)
    large = 0
    for seed in range(6):
        rng = random.Random(seed)
        dense = rng.sample(range(300), 110)
        pairs = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(300)} | {tuple(sorted((a, b))) for a in dense[:6] for b in dense[6:]}
        pairs |= {p for p in ((min(a, b), max(a, b)) for a in dense[6:] for b in dense[6:] if a != b) if rng.random() < (0.3 + 0.08 * seed)}
        incoming, file_of = {v: rng.randrange(3) for v in dense}, {v: f"f{rng.randrange(3)}" for v in range(0, 300, 2)}
        near = {v: set() for v in range(300)}
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        sizes = sorted(len(x) for x in near.values() if len(x) > 1)
        gone = set()
        for v in range(300):
            peers = sorted(near[v] - gone)
            if len(near[v]) >= 2 * sizes[len(sizes) // 2] and incoming.get(v, 0) and len({file_of[u] for u in peers if u in file_of}) > 1:
                linked = sum(b in near[a] for i, a in enumerate(peers) for b in peers[i + 1 :])
                if len(peers) > 1 and linked * 2 <= len(peers) * (len(peers) - 1) // 2:
                    gone.add(v)
                large += len(peers) > 64
        assert community.partition(list(range(300)), [(a, b, 1.0) for a, b in sorted(pairs)], incoming, file_of)[1] == gone
    assert large


def test_leiden_takes_any_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(community, "SINGLE_TASK_EDGES", 3, raising=False)
    links = [(a, b) for vs in (range(5), range(5, 10)) for a in vs for b in vs if a < b] + [(4, 5), (5, 4), (7, 7)] + [(20, k) for k in range(10)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in links], "src long, dst long, confidence int")
    nodes = spark.createDataFrame([(k, f"f{k % 2}" if k else None, True) for k in range(12)] + [(50, None, False)], "node long, file string, is_defined boolean")
    weight, incoming = {}, {}
    for a, b in links:
        if a != b:
            weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0.0) + 1
            incoming[b] = incoming.get(b, 0) + 1
    found, hubs = community.partition([*range(12), 20], [(*p, w) for p, w in weight.items()], incoming, {k: f"f{k % 2}" for k in range(1, 12)})
    got = community.leiden(edges, nodes).collect()
    assert {r["node"]: r["community"] for r in got} == found and {r["node"] for r in got if r["is_hub"]} == hubs
    assert found[0] == found[4] != found[9] == found[6] and found[10] != found[11]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 8)), 3)
    x[5] = x[6]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "node long, vec array<double>")
    got = embed.nearest(df.filter("node % 10 = 0 and node < 60").selectExpr("node as query", "vec"), df, 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for q in range(0, 60, 10):
        want = sorted((n for n in range(60) if n != q), key=lambda n: (-s[q, n], n))[:4]
        assert [r["node"] for r in sorted(got.filter(f"query = {q}").collect(), key=lambda r: r["rank"])] == want


def test_signature_is_fixed():
    a = embed.signature(np.array([0, 1, 2]))
    assert np.allclose(np.linalg.norm(a, axis=1), 1) and np.allclose(a, embed.signature(np.array([0, 1, 2]))) and abs(a[0] @ a[1]) < 0.5


def test_unknown_confidence_is_an_error():
    assert confidence_floor("inferred") == 1 and confidence_floor(None) == 0
    with pytest.raises(ValueError):
        confidence_floor("certain")


@pytest.mark.parametrize("block", [20_000, 7])
def test_nearest_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 4)), 1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, [None, 1.0, 1.0, 1.0])], "node long, vec array<double>").selectExpr("*", "1 as query", "2 as block", "3 as width")
    asked = df.filter("node % 3 = 0").select("node", "vec").withColumnRenamed("node", "query")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    got = {(r["query"], r["rank"]): r["node"] for r in embed.nearest(asked, df, 3, block).collect()}
    assert got == {(q, k + 1): n for q in range(0, 40, 3) for k, n in enumerate(sorted((n for n in range(40) if n != q), key=lambda n: (-s[q, n], n))[:3])}
    assert embed.nearest(asked.limit(0), df, 3).collect() == []


def test_cycles_equal_enumeration(spark):
    import itertools
    import random

    rng = random.Random(3)
    pairs = sorted({(f"f{rng.randrange(7)}", f"f{rng.randrange(7)}") for _ in range(22)})
    df = spark.createDataFrame(pairs, "from_file string, to_file string")
    want = [list(p) for n in range(2, 6) for p in itertools.permutations(sorted({x for e in pairs for x in e}), n) if p[0] == min(p) and all(e in pairs for e in zip(p, (*p[1:], p[0]), strict=True))]
    want.sort(key=lambda p: (len(p), p))
    assert sorted((r["files"] for r in graph.cycles(df, 5).collect()), key=lambda p: (len(p), p)) == want and len(want) > 5
    assert [r["files"] for r in graph.cycles(df, 5, limit=4).collect()] == want[:4]


def test_cohesion_of_some_nodes(spark):
    rng = np.random.default_rng(2)
    links = {tuple(sorted(map(int, e))) for e in rng.integers(0, 14, (40, 2)) if e[0] != e[1]}
    adjacency = spark.createDataFrame([e for a, b in links for e in ((a, b), (b, a))], "a long, b long")
    whole = {r["node"]: r for r in graph.cohesion(adjacency).collect()}
    some = graph.cohesion(adjacency, spark.createDataFrame([(n,) for n in (0, 3, 5, 99)], "node long")).collect()
    assert {r["node"] for r in some} == {0, 3, 5} & set(whole) and all(r == whole[r["node"]] for r in some)
    for n, r in whole.items():
        near = [b for a, b in links if a == n] + [a for a, b in links if b == n]
        assert r["linked"] == sum((min(x, y), max(x, y)) in links for i, x in enumerate(near) for y in near[:i])
