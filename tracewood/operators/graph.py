"""Operators on the provenance-labelled multigraph.

``edges``: src, dst, ts, authority, edge_kind, confidence, seq; ``nodes``: node, symbol, file, name, is_defined. A node that
is not defined is a placeholder: a call's target known by name only, standing for the definitions it resolves to.
Rows with a null src or dst are no edges. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewood.session import Workspace


def union_view(base: DataFrame, added: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Base without tombstoned pairs, and what was added. A tombstone masks all parallel edges of its pair in the base."""
    return base.join(tombstones.select("src", "dst").distinct(), ["src", "dst"], "left_anti").unionByName(added)


def replace_file(edges: DataFrame, owners: DataFrame, fresh: DataFrame) -> DataFrame:
    """All outgoing edges of the nodes in ``owners`` (node) give way to ``fresh``."""
    return edges.join(owners.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select(edges.columns).unionByName(fresh.select(edges.columns))


def replace_kind(edges: DataFrame, kind: int, fresh: DataFrame) -> DataFrame:
    return edges.filter(F.col("edge_kind") != kind).unionByName(fresh.select(edges.columns))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholders without an edge in either direction."""
    used = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return nodes.filter(~F.col("is_defined")).join(used.distinct(), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree; each counts parallel edges. One shuffle: both ends are tagged and summed together."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")).filter("node is not null")


def strongest(edges: DataFrame) -> DataFrame:
    """One row per pair at its strongest confidence."""
    return edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(via, target, confidence): placeholders and the definitions they lead to."""
    kinds = nodes.select(F.col("node").alias("src"), F.col("is_defined").alias("src_defined"))
    return edges.join(kinds, "src").filter("not src_defined").groupBy(F.col("src").alias("via"), F.col("dst").alias("target")).agg(F.max("confidence").alias("confidence"))


def calls(edges: DataFrame, nodes: DataFrame, floor: int = 0) -> DataFrame:
    """(caller, callee, confidence, via, seq): every call between definitions, directly or through one placeholder.

    Both edges of a call through a placeholder must reach the floor, and the weaker one is its confidence; nobody calls
    itself through a placeholder. Documents don't call.
    """
    strong = edges.filter(F.col("confidence") >= floor)
    known = nodes.select("node", "is_defined", F.lower(F.coalesce("file", F.lit(""))).rlike(r"\.(md|markdown)$").alias("doc"))
    from_defined = strong.join(known.withColumnRenamed("node", "src"), "src").filter("is_defined and not doc")
    direct = from_defined.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "confidence", F.lit(-1).cast("long").alias("via"), "seq")
    links = strong.join(known.withColumnRenamed("node", "src"), "src").filter("not is_defined").select(F.col("src").alias("via"), F.col("dst").alias("callee"), F.col("confidence").alias("link"))
    into = from_defined.select(F.col("src").alias("caller"), F.col("dst").alias("via"), "confidence", "seq")
    through = into.join(links, "via").filter("caller <> callee").select("caller", "callee", F.least("confidence", "link").alias("confidence"), "via", "seq")
    ends = known.filter("is_defined").select(F.col("node").alias("callee"))
    return direct.join(ends, "callee").select("caller", "callee", "confidence", "via", "seq").unionByName(through)


def direct_callers(edges: DataFrame, nodes: DataFrame, floor: int = 0) -> DataFrame:
    """(node, caller, confidence): one row per caller at its strongest confidence, for all nodes at once."""
    return calls(edges, nodes, floor).groupBy(F.col("callee").alias("node"), "caller").agg(F.max("confidence").alias("confidence"))


def undecided_callers(edges: DataFrame, nodes: DataFrame, floor: int = 0) -> DataFrame:
    """(name, caller): definitions that call a placeholder which resolves to nothing."""
    known = nodes.select("node", "is_defined", "name")
    loose = known.filter("not is_defined").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("dst"), "name")
    who = edges.filter(F.col("confidence") >= floor).join(loose, "dst").join(known.filter("is_defined").select(F.col("node").alias("src")), "src")
    return who.select("name", F.col("src").alias("caller")).distinct()


def reverse_levels(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, floor: int = 0, work: Workspace | None = None) -> DataFrame:
    """(node, hop, confidence): everything that reaches the seeds backwards within ``depth``, at its shortest distance.

    The confidence is that of the first discovery: least frontier node, least placeholder, least sequence. Each round joins
    only the newest level with the calls and is written out, so lineage stays short.
    """
    work = work or Workspace(edges.sparkSession, "levels")
    links = work.cut(calls(edges, nodes, floor).groupBy("caller", "callee").agg(F.min(F.struct("via", "seq", "confidence")).alias("how")))
    seen = work.cut(seeds.select("node").filter("node is not null").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast("int").alias("confidence")))
    level, levels = seen, [seen]
    for hop in range(1, depth + 1):
        reached = level.select(F.col("node").alias("callee")).join(links, "callee")
        first = reached.groupBy(F.col("caller").alias("node")).agg(F.min(F.struct("callee", "how")).alias("first")).select("node", F.lit(hop).alias("hop"), F.col("first.how.confidence").alias("confidence"))
        before = levels[0].select("node")
        for x in levels[1:]:
            before = before.union(x.select("node"))
        level = work.cut(first.join(before, "node", "left_anti"))
        if not level.take(1):
            break
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit in a total order, with ``rank`` from 1."""
    ordered = rows.orderBy(*order).offset(offset).limit(limit)
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 3, floor: int = 0, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the dependents of the seeds, nearest first: hop, symbol, confidence, rank."""
    levels = reverse_levels(edges, nodes, seeds, min(max(depth, 1), 10), floor).filter("hop > 0")
    return page(levels.join(nodes.select("node", "symbol"), "node").select("hop", "node", "symbol", "confidence"), ["hop", "node"], min(max(limit, 1), 1000), max(offset, 0))


def distances(edges: DataFrame, nodes: DataFrame, source: DataFrame, depth: int, floor: int = 0, work: Workspace | None = None) -> DataFrame:
    """(node, hops, parent): forward distances between definitions; a placeholder in between costs nothing. The parent is
    the least predecessor, strongest confidence first."""
    work = work or Workspace(edges.sparkSession, "paths")
    links = work.cut(calls(edges, nodes, floor).groupBy("caller", "callee").agg(F.max("confidence").alias("confidence")))
    level = work.cut(source.select("node").distinct().select("node", F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent")))
    levels = [level]
    for hop in range(1, depth + 1):
        near = level.select(F.col("node").alias("caller")).join(links, "caller").groupBy(F.col("callee").alias("node")).agg(F.min(F.struct(-F.col("confidence"), "caller")).alias("from"))
        before = levels[0].select("node")
        for x in levels[1:]:
            before = before.union(x.select("node"))
        level = work.cut(near.select("node", F.lit(hop).alias("hops"), F.col("from.caller").alias("parent")).join(before, "node", "left_anti"))
        if not level.take(1):
            break
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def shortest_path(edges: DataFrame, nodes: DataFrame, source: int, target: int, floor: int = 0, depth: int = 30) -> DataFrame:
    """(step, node, symbol) from source to target; no rows if there is no path. The walk back joins one row per step."""
    spark = edges.sparkSession
    work = Workspace(spark, "path")
    start = spark.createDataFrame([(source,)], "node long")
    found = work.cut(distances(edges, nodes, start, depth, floor, work))
    steps, at = [], target
    while at is not None and len(steps) <= depth:
        row = found.filter(F.col("node") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, node long, symbol string")
        steps.append((row["hops"], at))
        at = row["parent"]
    return spark.createDataFrame(steps, "step int, node long").join(nodes.select("node", "symbol"), "node", "left").select("step", "node", "symbol")


def file_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_file, to_file, confidence): strongest edge between files. A placeholder stands for a file only if all the
    definitions it leads to lie in that one file; edges within a file are dropped."""
    homes = nodes.filter("is_defined and file is not null").select("node", "file")
    loose = nodes.filter("not is_defined").select("node")
    stands = edges.join(loose.withColumnRenamed("node", "src"), "src").join(homes.select(F.col("node").alias("dst"), "file"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("file").alias("file"), F.max("file").alias("other")).filter("file = other").select("node", "file")
    places = homes.unionByName(stands)
    out = edges.join(homes.select(F.col("node").alias("src"), F.col("file").alias("from_file")), "src").join(places.select(F.col("node").alias("dst"), F.col("file").alias("to_file")), "dst")
    return out.filter("from_file <> to_file").groupBy("from_file", "to_file").agg(F.max("confidence").alias("confidence"))


def cycles(pairs: DataFrame, max_len: int, limit: int | None = None, work: Workspace | None = None) -> DataFrame:
    """(files, length): simple cycles of (from_file, to_file) pairs, each once, beginning at its least file; with ``limit`` the
    first so many by length and files, and no longer ones are looked for once that many are found.

    Paths grow by one file per round and only over files above their start, so a cycle has one spelling. A file is stepped on
    only if it leads back to the start within the steps left, so paths that close no cycle are never built.
    """
    work = work or Workspace(pairs.sparkSession, "cycles")
    links = work.cut(pairs.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")).filter("a <> b").distinct())
    for _ in range(3):  # files without a way in or out lie on no cycle
        links = work.cut(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
    back = work.cut(links.filter("a > b").select(F.col("b").alias("start"), F.col("a").alias("node"), F.lit(1).alias("dist")))
    edge = back
    for dist in range(2, max_len):
        step = edge.select("start", F.col("node").alias("b")).join(links, "b").filter("a > start").select("start", F.col("a").alias("node")).distinct()
        edge = work.cut(step.join(back, ["start", "node"], "left_anti").withColumn("dist", F.lit(dist)))
        if edge.isEmpty():
            break
        back = back.unionByName(edge)
    paths = links.filter("b > a").select(F.col("a").alias("start"), F.col("b").alias("tip"), F.array("a", "b").alias("files"))
    out, count = None, 0
    for length in range(2, max_len + 1):
        near = back.filter(F.col("dist") <= max_len + 1 - length).select("start", F.col("node").alias("tip"), (F.col("dist") == 1).alias("closes"))
        paths = work.cut(paths.join(near, ["start", "tip"]))
        closed = paths.filter("closes").select("files", F.lit(length).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        if limit is not None:
            count += closed.count()
            if count >= limit:
                break
        if length < max_len:
            paths = paths.join(links.select(F.col("a").alias("tip"), F.col("b").alias("next")), "tip").filter("next > start and not array_contains(files, next)").select("start", F.col("next").alias("tip"), F.concat("files", F.array("next")).alias("files"))
    return out if limit is None else out.orderBy("length", "files").limit(limit)


def covers(pattern, file):
    """Whether an architecture rule's path covers a file: the path itself, or what lies below it."""
    return (file == pattern) | file.startswith(F.concat(pattern, F.lit("/"))) | file.startswith(F.concat(pattern, F.lit(".")))


def denied(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, from_file, to_file, confidence): file edges that a deny rule (rule, from_path, to_path, floor) forbids.

    A rule's path that covers a file is one of its prefixes, so edges meet their rules by equality, however many there are.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length("from_file") + 1), lambda i: (i > F.length("from_file")) | F.substring(F.col("from_file"), i, F.lit(1)).isin("/", "."))
    reached = pairs.withColumn("from_path", F.explode(F.transform(ends, lambda i: F.substring(F.col("from_file"), F.lit(1), i - 1))))
    return reached.join(rules, "from_path").filter(covers(F.col("to_path"), F.col("to_file")) & (F.col("confidence") >= F.col("floor"))).select("rule", "from_file", "to_file", "confidence")


def check_architecture(pairs: DataFrame, rules: DataFrame, longest: int = 12, limit: int | None = 50, work: Workspace | None = None) -> DataFrame:
    """(rule, kind, files): what breaks the rules (rule, kind, from_path, to_path, floor): file edges that a 'deny' rule forbids, and
    the cycles of edges at a 'no-cycles' rule's floor or above, the shortest ``limit`` of each floor up to ``longest`` files."""
    work = work or Workspace(pairs.sparkSession, "rules")
    pairs = work.cut(pairs)
    out = denied(pairs, rules.filter("kind = 'deny'").select("rule", "from_path", "to_path", F.coalesce("floor", F.lit(0)).alias("floor"))).select("rule", F.lit("deny").alias("kind"), F.array("from_file", "to_file").alias("files"))
    closed = rules.filter("kind = 'no-cycles'").select("rule", F.coalesce("floor", F.lit(0)).alias("floor"))
    for (floor,) in closed.select("floor").distinct().orderBy("floor").collect():  # one of three confidences each
        rings = cycles(pairs.filter(F.col("confidence") >= floor), longest, limit, work).select("files")
        out = out.unionByName(rings.withColumn("floor", F.lit(floor)).join(F.broadcast(closed), "floor").select("rule", F.lit("no-cycles").alias("kind"), "files"))
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) in both directions: how many edges join two nodes; loops are dropped."""
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def contracted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, confidence) between definitions, placeholders taken out, at the strongest confidence."""
    return calls(edges, nodes).groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.max("confidence").alias("confidence"))


def cohesion(adjacency: DataFrame, of: DataFrame | None = None, work: Workspace | None = None) -> DataFrame:
    """(node, peers, linked, cohesion): share of a node's neighbour pairs that are linked themselves; 1 below two peers.
    ``of``: only these nodes (node).

    Every triangle is found from its node of least degree, so a hub's neighbour pairs are never formed.
    """
    work = work or Workspace(adjacency.sparkSession, "cohesion")
    one = work.cut(adjacency.select("a", "b").distinct())
    size = work.cut(one.groupBy("a").agg(F.count("*").alias("d")))
    half = one.filter("a < b").join(size.select("a", F.col("d").alias("da")), "a").join(size.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    low = F.when((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))), True).otherwise(False)
    directed = work.cut(half.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    if of is None:
        wedge = directed.select("x", F.col("y").alias("y1")).join(directed.select("x", F.col("y").alias("y2")), "x").filter("y1 < y2")
        triangles = wedge.join(one.select(F.col("a").alias("y1"), F.col("b").alias("y2")), ["y1", "y2"])
        linked = triangles.select(F.explode(F.array("x", "y1", "y2")).alias("a")).groupBy("a").agg(F.count("*").alias("linked"))
    else:  # an edge lies among a node's neighbours if both its ends do; ends of less degree have few
        size = size.join(of.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
        mine = work.cut(one.join(size.select(F.col("a").alias("b")), "b", "left_semi"))
        met = directed.join(mine.select(F.col("a").alias("x"), F.col("b").alias("of")), "x").join(mine.select(F.col("a").alias("y"), F.col("b").alias("of")), ["y", "of"], "left_semi")
        linked = met.groupBy(F.col("of").alias("a")).agg(F.count("*").alias("linked"))
    out = size.join(linked, "a", "left").select(F.col("a").alias("node"), F.col("d").alias("peers"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"))
    pairs = F.col("peers") * (F.col("peers") - 1) / 2
    return out.withColumn("cohesion", F.round(F.when(F.col("peers") < 2, 1.0).otherwise(F.col("linked") / pairs), 6))


def hub_candidates(edges: DataFrame, nodes: DataFrame, factor: float = 2.0, most_cohesion: float = 0.5, files: int = 2, work: Workspace | None = None) -> DataFrame:
    """Nodes that bridge unrelated files: degree at least ``factor`` times the upper median of degrees above one, an
    incoming edge, low cohesion, neighbours in several files. All are judged on the whole graph; removal one after
    another, as the partition needs it, is part of ``community``. The cheap tests come first, so triangles are looked for around
    the few nodes that pass them."""
    work = work or Workspace(edges.sparkSession, "hubs")
    edges = work.cut(edges.select("src", "dst").filter("src <> dst"))
    adjacency = work.cut(undirected(edges))
    weights = work.cut(adjacency.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")))
    ranked = weights.filter("degree > 1").groupBy("degree").agg(F.count("*").alias("n"))
    sums = ranked.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).join(F.broadcast(ranked.agg(F.sum("n").alias("all"))))  # a row per distinct degree beside one total
    median = sums.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("degree").alias("median"))
    large = weights.join(F.broadcast(median), F.col("degree") >= factor * F.col("median")).select("node", "degree")
    incoming = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("incoming"))
    around = adjacency.select(F.col("a").alias("node"), "b").join(large.select("node"), "node", "left_semi")
    spread = around.join(nodes.filter("file is not null").select(F.col("node").alias("b"), "file"), "b").groupBy("node").agg(F.count_distinct("file").alias("files"))
    kept = work.cut(large.join(incoming, "node").join(spread, "node").filter(F.col("files") >= files))
    return kept.join(cohesion(adjacency, kept, work).select("node", "cohesion"), "node").filter(F.col("cohesion") <= most_cohesion).select("node", "degree", "incoming", "files", "cohesion")


def modularity(adjacency: DataFrame, partition: DataFrame) -> DataFrame:
    """Modularity of a partition (node, community) of an undirected weighted graph."""
    part = partition.select("node", "community")
    told = adjacency.join(part.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(part.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    by = told.groupBy("ca").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    whole = by.agg(F.sum("degree").alias("all"))
    return by.join(F.broadcast(whole)).agg(F.round(F.sum(F.col("inside") / F.col("all") - F.pow(F.col("degree") / F.col("all"), 2)), 6).alias("modularity"))
