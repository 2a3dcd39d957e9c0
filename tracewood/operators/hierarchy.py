"""Parent-child rows to full hierarchies.

1. Connected components by pointer doubling: after k rounds every node has its 2^k-th ancestor, so the number of rounds
   is the logarithm of the depth. Nodes that never reach a root lie on or below a circle.
2. Components are co-located (hash of the component) and each is walked by an iterative depth-first traversal with node
   colours: paths and depths going down from the root, back edges where a walk meets a grey node.
3. A component whose paths hold more than ``path_cells`` nodes together never goes into one task: its roots and depths are those
   of the doubling, its paths are joined together from doubled path pieces. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewood.functions.text import latest, plain_class_name
from tracewood.session import Workspace

PATH_CELLS = 4_000_000  # 32 MB of paths; the sum of a component's depths, so a long chain counts in full
SCHEMA = "node long, parent long, root long, depth long, path array<long>, descendants long, back_edge boolean"


def class_bases(facts: DataFrame) -> DataFrame:
    """(node, pos, base) of every written base: the class of the same repo that it names, or null. See ``class_parents``."""
    _, entries, names = _written(facts)
    return entries.join(names, ["repo", "name"], "left").select("node", "pos", F.col("parent").alias("base"))


def class_parents(facts: DataFrame) -> DataFrame:
    """(node, parent) of every class: the first entry of class_bases that names a class of the same repo, or null.

    The latest reading of a node holds. Null, empty and foreign entries are skipped; a class without repo has no parent.
    Should a repo define a name twice, the smaller node is meant. Rows without node are no classes.
    """
    now, named, names = _written(facts)
    first = named.join(names, ["repo", "name"]).groupBy("node").agg(F.min_by("parent", "pos").alias("parent"))
    return now.select("node").join(first, "node", "left")


def _written(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Present classes, their named bases (node, repo, pos, name), and what a repo's names mean (repo, name, parent)."""
    now = latest(facts.select("node", "repo", "class_symbol", "class_bases", "read_at").filter("node is not null"), "node", "read_at")
    now = now.select("node", "repo", F.expr("substr(class_symbol, instr(class_symbol, '#') + 1)").alias("written"), "class_bases")
    names = now.select(F.col("node").alias("parent"), "repo", plain_class_name(F.col("written")).alias("name")).filter("repo is not null and name is not null")
    names = names.groupBy("repo", "name").agg(F.min("parent").alias("parent"))
    entries = now.select("node", "repo", F.posexplode("class_bases").alias("pos", "entry"))
    return now, entries.select("node", "repo", "pos", plain_class_name(F.col("entry")).alias("name")).filter("name is not null"), names


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, parent, ptr, hops, comp, circular) of (node, parent) rows.

    ``links`` has one row per node; a parent that is no node makes its child a root. For nodes under a root, ptr is the
    root, hops the depth and comp the root. For the rest comp is the least node of the circle.
    """
    known = links.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    start = links.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    state = work.cut(
        start.select("node", "parent", F.coalesce("parent", "node").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.least("node", F.coalesce("parent", "node")).alias("low"), F.col("parent").isNull().alias("done"), F.lit(None).cast("long").alias("comp"))
    )
    finished: list[DataFrame] = [state.filter("done")]
    active = state.filter("not done")
    last = -1
    while True:
        # the ancestor's row may be a finished one: then the node is finished too
        far = work_union([*finished, active]).select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("hops").alias("_hops"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        step = active.join(far, "ptr").select(
            "node", "parent", F.col("_ptr").alias("ptr"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), F.col("_done").alias("done"),
            F.col("_low").alias("comp"), F.coalesce(F.col("comp") == F.col("_low"), F.lit(False)).alias("same"),
        )
        step = work.cut(step)
        counts = step.agg(F.count("*").alias("n"), F.sum(F.col("done").cast("int")).alias("done"), F.sum((~F.col("done") & ~F.col("same")).cast("int")).alias("moved")).first()
        step = step.drop("same")
        finished.append(step.filter("done"))
        active = step.filter("not done")
        left = counts.n - (counts.done or 0)
        if not left or (not counts.done and last == 0 and not counts.moved):
            break
        last = counts.done or 0
    under = work_union(finished).select("node", "parent", "ptr", "hops", F.col("ptr").alias("comp"), F.lit(False).alias("circular"))
    return under.unionByName(active.select("node", "parent", "ptr", "hops", "comp", F.lit(True).alias("circular")))


def work_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def walk(node: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
    """Depth-first traversal of whole components with node colours (0 white, 1 grey, 2 black); parent -1 is none."""
    n = len(node)
    place = {int(v): i for i, v in enumerate(node)}
    up = [place.get(int(p), -1) if p >= 0 else -1 for p in parent]
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(up):
        if p >= 0:
            children[p].append(i)
    colour, depth, root = [0] * n, [-1] * n, [-1] * n
    path: list[list[int]] = [[] for _ in range(n)]
    below, back = [0] * n, [False] * n
    for r in range(n):
        if up[r] >= 0:
            continue
        stack, trail = [(r, 0)], []
        while stack:
            v, k = stack.pop()
            if k == 0:
                colour[v] = 1
                trail.append(int(node[v]))
                depth[v], root[v], path[v] = len(trail) - 1, int(node[r]), list(trail)
            if k < len(children[v]):
                stack.append((v, k + 1))
                stack.append((children[v][k], 0))
            else:
                colour[v] = 2
                trail.pop()
                if up[v] >= 0:
                    below[up[v]] += below[v] + 1
    for s in range(n):  # white nodes lie on or below a circle
        v, trail = s, []
        while colour[v] == 0:
            colour[v] = 1
            trail.append(v)
            v = up[v]
        if colour[v] == 1:  # a grey node is met again: its circle is closed by the link to its least node
            ring = trail[trail.index(v) :]
            least = min(ring, key=lambda i: node[i])
            back[ring[ring.index(least) - 1]] = True
        for i in trail:
            colour[i] = 2
    return pd.DataFrame({"node": node, "parent": pd.array([int(node[p]) if p >= 0 else None for p in up], dtype="Int64"), "root": root, "depth": depth, "path": path, "descendants": [below[i] if depth[i] >= 0 else -1 for i in range(n)], "back_edge": back})


def _walk_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by component; whole components are walked as soon as the next one begins."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if batch.empty:
            continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        final = held["comp"].iloc[-1]
        whole = held[held["comp"] != final]
        if len(whole):
            yield walk(whole["node"].to_numpy(), whole["parent"].fillna(-1).to_numpy().astype("int64"))
            held = held[held["comp"] == final].reset_index(drop=True)
    if held is not None and len(held):
        yield walk(held["node"].to_numpy(), held["parent"].fillna(-1).to_numpy().astype("int64"))


def _large(parts: DataFrame, work: Workspace) -> DataFrame:
    """Paths of components too large for a task, by doubling path pieces; descendants by counting ancestors."""
    tree = parts.filter("not circular")
    state = work.cut(tree.select("node", "parent", F.col("comp").alias("root"), F.col("hops").alias("depth"), F.coalesce("parent", "node").alias("ptr"), F.array("node").alias("path")))
    deepest = state.agg(F.max("depth")).first()[0] or 0
    span = 1
    while span <= deepest:
        far = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("path").alias("_path"))
        joined = state.join(far, "ptr").select("node", "parent", "root", "depth", F.col("_ptr").alias("ptr"), F.when(F.size("path") < F.col("depth") + 1, F.concat("_path", "path")).otherwise(F.col("path")).alias("path"))
        state, span = work.cut(joined), span * 2
    below = state.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node")).groupBy("node").agg(F.count("*").alias("descendants"))
    trees = state.join(below, "node", "left").select("node", "parent", "root", "depth", "path", F.coalesce("descendants", F.lit(0)).alias("descendants"), F.lit(False).alias("back_edge"))
    empty = F.array().cast("array<long>")
    # pointers of 2^k steps lead from every node to its circle and from a circle's nodes to all of them
    on_ring = parts.filter("circular").select(F.col("ptr").alias("node"), F.lit(True).alias("on_ring")).distinct()
    rings = parts.filter("circular").join(on_ring, "node", "left").select("node", "parent", F.lit(-1).cast("long").alias("root"), F.lit(-1).cast("long").alias("depth"), empty.alias("path"), F.lit(-1).cast("long").alias("descendants"), (F.coalesce("on_ring", F.lit(False)) & (F.col("parent") == F.col("comp"))).alias("back_edge"))
    return trees.unionByName(rings)


def hierarchy(links: DataFrame, path_cells: int = PATH_CELLS, work: Workspace | None = None) -> DataFrame:
    """Root, depth, path from the root, number of descendants and back edges of every node of (node, parent) rows.

    Nodes on or below a circle have root, depth and descendants -1 and an empty path; ``back_edge`` marks, once per circle, the
    node on it whose parent is the circle's least node. Null nodes are dropped, a repeated node keeps its least parent, a parent that is no node
    makes its child a root, further columns are ignored, and no rows give no rows.
    """
    spark = links.sparkSession
    work = work or Workspace(spark, "hierarchy")
    links = links.filter("node is not null").groupBy(F.col("node").cast("long").alias("node")).agg(F.min(F.col("parent").cast("long")).alias("parent"))
    parts = work.cut(components(work.cut(links), work))
    cells = F.sum(F.when(F.col("circular"), 1).otherwise(F.col("hops") + 1))
    big = work.cut(parts.groupBy("comp").agg(cells.alias("cells")).filter(F.col("cells") > path_cells).select("comp", F.lit(True).alias("big")))
    if not big.take(1):
        return parts.repartition("comp").sortWithinPartitions("comp").select("node", "parent", "comp").mapInPandas(_walk_partition, SCHEMA)
    told = parts.join(big, "comp", "left")
    small = told.filter("big is null").repartition("comp").sortWithinPartitions("comp").select("node", "parent", "comp").mapInPandas(_walk_partition, SCHEMA)
    return small.unionByName(_large(told.filter("big"), work))
