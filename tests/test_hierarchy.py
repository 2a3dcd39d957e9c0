import random

import pytest

from tracewood.operators.hierarchy import class_parents, hierarchy, walk


def brute(links):
    parent = {}
    for n, p in links:
        if n is not None:
            old = parent.get(n)
            parent[n] = p if old is None else (old if p is None else min(old, p))
    out = {}
    for n in parent:
        path, v = [n], parent[n]
        while v is not None and v in parent and v not in path:
            path.append(v)
            v = parent[v]
        ring = v is not None and v in parent
        out[n] = (-1, -1) if ring else (path[-1], len(path) - 1)
    return out


def circle_ends(links):
    """The node before the least one of every circle."""
    parent = {}
    for n, p in links:
        if n is not None:
            old = parent.get(n)
            parent[n] = p if old is None else (old if p is None else min(old, p))
    out = set()
    for n in parent:
        ring, v = [n], parent[n]
        while v in parent and v not in ring:
            ring.append(v)
            v = parent[v]
        if v in parent and v == n:
            out.add(ring[ring.index(min(ring)) - 1])
    return out


@pytest.mark.parametrize("path_cells", [200_000, 3])
def test_random_forests_with_rings(spark, path_cells):
    rng = random.Random(5)
    links = [(n, rng.choice([None, 999, *range(1, 40)])) for n in range(1, 40)] + [(100 + k, 99 + k if k else None) for k in range(30)]
    links += [(None, 3), (7, 7), links[3]]
    df = spark.createDataFrame(links, "node long, parent long").selectExpr("node", "parent", "'x' as comp", "1 as ptr", "true as done")
    got = {r["node"]: r for r in hierarchy(df, path_cells=path_cells).collect()}
    want = brute(links)
    assert {n: (r["root"], r["depth"]) for n, r in got.items()} == want
    for n, r in got.items():
        if r["depth"] >= 0:
            assert r["path"][0] == r["root"] and r["path"][-1] == n and len(r["path"]) == r["depth"] + 1
            assert r["descendants"] == sum(n in x["path"] and m != n for m, x in got.items())
        else:
            assert r["path"] == [] and r["descendants"] == -1
    assert {n for n, r in got.items() if r["back_edge"]} == circle_ends(links)


def test_back_edges_do_not_hang_on_the_order_of_rows():
    import numpy as np

    for order in ([1, 2, 3, 4], [4, 3, 2, 1], [2, 3, 1, 4]):
        up = {1: 2, 2: 3, 3: 1, 4: 1}  # 4 lies below the circle
        rows = walk(np.array(order), np.array([up[v] for v in order]))
        assert rows["node"][rows["back_edge"]].tolist() == [3]


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "node long, parent long")).collect() == []


def test_parents_of_classes(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, "r", "a.py#Base", None, t),
        (2, "r", "b.py#Child", [None, "", "Generic<Base>", " pkg.mod::Base<T> "], t),
        (2, "r", "b.py#Child", ["Other"], dt.datetime(2023, 1, 1)),
        (3, "r", "c.py#Loop", ["x.Loop"], t),
        (4, "q", "d.py#Child2", ["Base"], t),
        (5, None, "e.py#E", ["Base"], None),
        (None, "r", "f.py#F", ["Base"], t),
        (6, "r", None, ["Base[Child]"], t),
    ]
    df = spark.createDataFrame(rows, "node long, repo string, class_symbol string, class_bases array<string>, read_at timestamp").selectExpr("*", "1 as parent", "'z' as name", "2 as pos")
    got = {r["node"]: r["parent"] for r in class_parents(df).collect()}
    assert got == {1: None, 2: 1, 3: 3, 4: None, 5: None, 6: 1}


def test_members_over_all_bases(spark):
    from tracewood.operators.resolve import inherited_over

    bases = [(1, 0, 2), (1, 1, 3), (2, 0, None), (3, 0, 4), (5, 0, 6), (6, 0, 5), (6, 1, 4), (7, 0, None), (7, 1, 4), (8, 0, 3), (8, 1, 2)]
    members = [(3, "run"), (2, "run"), (4, "stop"), (4, "run"), (6, "own"), (1, "mine")]
    got = inherited_over(spark.createDataFrame(bases, "node long, pos int, base long").selectExpr("*", "1 as owner"), spark.createDataFrame(members, "node long, member string"))
    told = {(r["node"], r["member"]): (r["owner"], r["distance"], r["known"]) for r in got.collect()}
    assert told[1, "run"] == (2, 1, True) and told[8, "run"] == (3, 1, True)  # as near, so the first written
    assert told[1, "stop"] == (4, 2, False)  # a base of 2 is no class and as near
    assert told[5, "stop"] == (4, 2, True) and told[6, "own"] == (6, 0, True) and told[5, "own"] == (6, 1, True) and told[7, "run"] == (4, 1, False)
    assert told[1, "mine"] == (1, 0, True) and (2, "stop") not in told
    assert inherited_over(spark.createDataFrame([], "node long, pos int, base long"), spark.createDataFrame([], "node long, member string")).collect() == []
