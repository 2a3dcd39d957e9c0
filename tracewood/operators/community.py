"""Subsystems of a graph: the exact order-dependent partition in one task, and a distributed one."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewood.session import Workspace

EDGES_AT_ONCE = 2_000_000  # ends of pairs that are laid out at once


def _upto(x: np.ndarray, kind: type) -> np.ndarray:
    """Sums of what lies before each place, and of all."""
    out = np.zeros(len(x) + 1, kind)
    np.cumsum(x, dtype=kind, out=out[1:])
    return out


class _Level:
    """Nodes 0, 1, ... with their neighbours and weights one after another: those of v lie from ptr[v] to ptr[v + 1]."""

    def __init__(self, ptr: np.ndarray, peers: np.ndarray, weights: np.ndarray, loops: np.ndarray) -> None:
        self.ptr, self.peers, self.weights, self.loops, self.n = ptr, peers, weights, loops, len(ptr) - 1
        upto = _upto(weights, np.float64)  # weights are counts or dyadic parts of them, so sums are exact
        self.degree = (upto[ptr[1:]] - upto[ptr[:-1]] + 2 * loops).tolist()
        self.total = sum(self.degree) / 2


def _settle(level: _Level, part: list[int], bound: list[int] | None = None, passes: int = 10, gamma: float = 1.0) -> bool:
    """Moves nodes in order to the neighbouring part with the best gain, ties to the lower id; in place. ``bound`` keeps
    every node within its outer part."""
    if level.total <= 0:
        return False
    ever, ptr, degree = False, level.ptr.tolist(), level.degree
    for _ in range(passes):
        weight = np.bincount(np.array(part, np.int64), degree, level.n).tolist()
        moved = False
        for v in range(level.n):
            s, e = ptr[v], ptr[v + 1]
            if s == e:
                continue
            own, k = part[v], degree[v]
            weight[own] -= k
            pull: dict[int, float] = {}
            if bound is None:
                for u, w in zip(level.peers[s:e].tolist(), level.weights[s:e].tolist(), strict=True):
                    c = part[u]
                    pull[c] = pull.get(c, 0.0) + w
            else:
                home = bound[v]
                for u, w in zip(level.peers[s:e].tolist(), level.weights[s:e].tolist(), strict=True):
                    if bound[u] == home:
                        c = part[u]
                        pull[c] = pull.get(c, 0.0) + w
            scale = gamma * k / (2 * level.total)
            stay = best = pull.get(own, 0.0) - scale * weight[own]
            to = own
            for c, w in pull.items():
                gain = w - scale * weight[c]
                if gain > best or (gain == best and to != own and c < to):
                    best, to = gain, c
            if to != own:
                part[v], moved, ever = to, True, True
            weight[part[v]] += k
        if not moved:
            break
    return ever


def _dense(part: list[int]) -> int:
    ids: dict[int, int] = {}
    for i, c in enumerate(part):
        part[i] = ids.setdefault(c, len(ids))
    return len(ids)


def _ends(ptr: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the neighbours of nodes ``of``, and how many each has."""
    size = ptr[of + 1] - ptr[of]
    return np.arange(size.sum()) + np.repeat(ptr[of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size), size


def _collapse(level: _Level, part: list[int], count: int) -> _Level:
    """One node per part. Inside weight is halved when it is taken up and the sum once more with the loops it carries."""
    to = np.array(part, np.int64)
    loops = np.bincount(to, level.loops, count)
    order = np.argsort(to, kind="stable")
    upto = np.concatenate([[0], np.cumsum(np.diff(level.ptr)[order])])
    first = np.searchsorted(to[order], np.arange(count + 1))
    at, sizes, peers, weights = 0, np.zeros(count, np.int64), [], []
    while at < count:
        end = max(at + 1, int(np.searchsorted(upto[first], upto[first[at]] + EDGES_AT_ONCE, "right")) - 1)
        mine = order[first[at] : first[end]]
        place, size = _ends(level.ptr, mine)
        row, col, w = np.repeat(to[mine], size), to[level.peers[place]], level.weights[place].astype(np.float64)
        inside = row == col
        loops += np.bincount(row[inside], w[inside] / 2, count)
        key, inverse = np.unique((row * count + col)[~inside], return_inverse=True)
        peers.append((key % count).astype(np.int32))
        weights.append(np.bincount(inverse, w[~inside], len(key)))
        sizes += np.bincount(key // count, minlength=count)
        at = end
    return _Level(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.zeros(0, np.int32), *peers]), np.concatenate([np.zeros(0), *weights]), loops / 2)


def _ahead(ptr: np.ndarray, peers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, peers) with every pair once, at its end of fewer neighbours, ties at the lower one: no node has many."""
    n, size, found, at = len(ptr) - 1, np.diff(ptr), [], 0
    count = np.zeros(n, np.int64)
    while at < n:
        end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + EDGES_AT_ONCE, "right")) - 1)
        a, b = np.repeat(np.arange(at, end), size[at:end]), peers[ptr[at] : ptr[end]]
        up = (size[a] < size[b]) | ((size[a] == size[b]) & (a < b))
        count[at:end] = np.bincount(a[up] - at, minlength=end - at)
        found.append(b[up])
        at = end
    return _upto(count, np.int64), np.concatenate([np.zeros(0, np.int32), *found])


def _cohesion(ptr: np.ndarray, ahead: np.ndarray, near: np.ndarray, among: np.ndarray) -> float:
    """Share of all pairs of ``near`` that are linked. A link is counted at the end where ``ahead`` has it, so pairs that are
    none cost nothing. ``among``: room for a mark per node, false before and after."""
    pairs = len(near) * (len(near) - 1) // 2
    if not pairs:
        return 1.0
    among[near] = True
    linked, at, upto = 0, 0, _upto(ptr[near + 1] - ptr[near], np.int64)
    while at < len(near):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + EDGES_AT_ONCE, "right")) - 1)
        place, _ = _ends(ptr, near[at:end])
        linked += int(np.count_nonzero(among[ahead[place]]))
        at = end
    among[near] = False
    return linked / pairs


def _laid_out(n: int, chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, peers, weights) of pairs in chunks, each of both directions; the list is emptied."""
    size = np.zeros(n, np.int64)
    for a, b, _ in chunks:
        size += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    ptr = np.concatenate([[0], np.cumsum(size)])
    peers, weights = np.zeros(ptr[-1], np.int32), np.zeros(ptr[-1], chunks[0][2].dtype if chunks else np.float64)
    free = ptr[:-1].copy()
    while chunks:
        one, other, w = chunks.pop()
        for a, b in ((one, other), (other, one)):
            by = np.argsort(a, kind="stable")
            a = a[by]
            place = free[a] + np.arange(len(a)) - np.searchsorted(a, a)
            peers[place], weights[place] = b[by], w[by]
            free += np.bincount(a, minlength=n)
    return ptr, peers, weights


def _partition(ptr: np.ndarray, peers: np.ndarray, weights: np.ndarray, incoming: np.ndarray, file: np.ndarray, factor: float, most: float, levels: int) -> tuple[list[int], np.ndarray]:
    """Part of every node and whether it is a hub; ``file``: a number per node, -1 for none."""
    n = len(ptr) - 1
    level = _Level(ptr, peers, weights, np.zeros(n))
    degree = np.array(level.degree)
    above = np.sort(degree[degree > 1])
    median = above[len(above) // 2] if len(above) else 0.0
    gone = np.zeros(n, bool)
    first, ahead = _ahead(ptr, peers)
    among = np.zeros(n, bool)
    for v in np.flatnonzero((degree >= factor * median) & (incoming >= 1)) if median > 0 else []:
        near = peers[ptr[v] : ptr[v + 1]]
        near = near[~gone[near]]
        homes = file[near]
        homes = homes[homes >= 0]
        gone[v] = len(homes) > 0 and bool((homes != homes[0]).any()) and _cohesion(first, ahead, near, among) <= most
    del first, ahead, among
    if gone.any():
        keep = ~(np.repeat(gone, np.diff(ptr)) | gone[peers])
        upto = _upto(keep, np.int64)
        ptr, peers, weights = upto[ptr], peers[keep], weights[keep]
        del keep, upto
        level = _Level(ptr, peers, weights, np.zeros(n))
    whole = list(range(n))
    for _ in range(levels):
        part = list(range(level.n))
        if not _settle(level, part):
            break
        _dense(part)
        fine = list(range(level.n))
        _settle(level, fine, part)
        count = _dense(fine)
        whole = [fine[c] for c in whole]
        if count >= level.n:
            break
        level = _collapse(level, fine, count)
    _dense(whole)
    return whole, gone


def partition(nodes: list[int], pairs: list[tuple[int, int, float]], incoming: dict[int, int], file_of: dict[int, str], factor: float = 2.0, most: float = 0.5, levels: int = 10) -> tuple[dict[int, int], set[int]]:
    """Part of every node, and the hubs that were taken out first, one after another in node order."""
    place, files = {v: i for i, v in enumerate(nodes)}, {f: i for i, f in enumerate(sorted({*file_of.values()}))}
    chunk = np.array([place[a] for a, _, _ in pairs], np.int32), np.array([place[b] for _, b, _ in pairs], np.int32), np.array([w for _, _, w in pairs], np.float64)
    found, hubs = _partition(*_laid_out(len(nodes), [chunk]), np.array([incoming.get(v, 0) for v in nodes], np.int64), np.array([files[file_of[v]] if v in file_of else -1 for v in nodes], np.int64), factor, most, levels)
    return dict(zip(nodes, found, strict=True)), {nodes[i] for i in np.flatnonzero(hubs)}


def leiden(edges: DataFrame, nodes: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(node, community, is_hub) of all definitions by local movement, refinement and aggregation in node order.

    The result depends on the order in which nodes move, so it is one task's work, whatever the number of pairs: the task reads
    them in batches and holds 16 bytes for each besides what a level needs, 4 more while hubs are judged (by all pairs of their
    neighbours). ``propagate_labels`` is the distributed way. Nodes without edges are parts of their own.
    """
    work = work or Workspace(edges.sparkSession, "leiden")
    links = work.cut(edges.filter("src <> dst").select("src", "dst"))
    pairs = links.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    incoming = links.groupBy(F.col("dst").alias("a")).agg(F.count("*").alias("w"))
    defined = nodes.filter("is_defined").select("node", "file")
    rows = pairs.select(F.lit(0).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("int").alias("w"), F.lit(None).cast("string").alias("file"))
    rows = rows.union(incoming.select(F.lit(1), "a", F.lit(0).cast("long"), F.col("w").cast("int"), F.lit(None).cast("string"))).union(defined.select(F.lit(2), "node", F.lit(0).cast("long"), F.lit(0), "file"))
    return rows.repartition(1).mapInArrow(_in_one_task, "node long, community long, is_hub boolean")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: list = []
    arrivals, own, names, files = [], [], [], {}
    for b in batches:
        kind, x, y, w = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if (of := kind == 0).any():
            chunks.append((x[of], y[of], w[of]))
        if (of := kind == 1).any():
            arrivals.append((x[of], w[of]))
        if (of := kind == 2).any():
            own.append(x[of])
            names.append(np.array([-1 if f is None else files.setdefault(f, len(files)) for f in b.column(4).filter(pa.array(of)).to_pylist()], np.int64))
    none = np.zeros(0, np.int64)
    known = np.unique(np.concatenate([none, *own]))
    for at in range(0, len(chunks), 200):
        known = np.union1d(known, np.concatenate([c for x, y, _ in chunks[at : at + 200] for c in (x, y)]))
    for i, (x, y, w) in enumerate(chunks):
        chunks[i] = np.searchsorted(known, x).astype(np.int32), np.searchsorted(known, y).astype(np.int32), w
    joined = []
    for at in range(0, len(chunks), 100):  # batches are small
        joined.append(tuple(np.concatenate(c) for c in zip(*chunks[at : at + 100], strict=True)))
        chunks[at : at + 100] = [None] * len(chunks[at : at + 100])
    incoming, file = np.zeros(len(known), np.int64), np.full(len(known), -1, np.int64)
    for x, w in arrivals:
        incoming[np.searchsorted(known, x)] = w
    for x, f in zip(own, names, strict=True):
        file[np.searchsorted(known, x)] = f
    found, hubs = _partition(*_laid_out(len(known), joined), incoming, file, 2.0, 0.5, 10)
    for at in range(0, len(known), 100_000):
        end = at + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(known[at:end]), pa.array(found[at:end], pa.int64()), pa.array(hubs[at:end])], names=["node", "community", "is_hub"])


def propagate_labels(adjacency: DataFrame, rounds: int = 10, work: Workspace | None = None) -> DataFrame:
    """(node, community): each round every node takes the heaviest label around it, ties to the lower one. Distributed: one
    join and one aggregate per round; labels spread at most ``rounds`` steps."""
    work = work or Workspace(adjacency.sparkSession, "labels")
    links = work.cut(adjacency.select("a", "b", "weight"))
    state = work.cut(links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community")))
    for _ in range(rounds):
        votes = links.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        own = state.select(F.col("node").alias("a"), "community", F.lit(0.5).alias("w"))
        new = votes.unionByName(own).groupBy("a", "community").agg(F.sum("w").alias("w")).groupBy(F.col("a").alias("node")).agg(F.min(F.struct(-F.col("w"), "community")).alias("top")).select("node", F.col("top.community").alias("community"))
        before, state = state, work.cut(new)
        if not state.join(before.withColumnRenamed("community", "old"), "node").filter("community <> old").take(1):
            break
    return state


def connected(pairs: list[tuple[int, int]], members: set[int]) -> bool:
    """Whether the members hang together by pairs that stay inside."""
    if len(members) < 2:
        return True
    near: dict[int, set[int]] = defaultdict(set)
    for a, b in pairs:
        if a in members and b in members:
            near[a].add(b)
            near[b].add(a)
    first = min(members)
    seen, stack = {first}, [first]
    while stack:
        for u in near[stack.pop()] - seen:
            seen.add(u)
            stack.append(u)
    return seen == members


__all__ = ["connected", "leiden", "partition", "propagate_labels"]
