"""Subsystems: names, entry points, links between them, and the parts of a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewood.session import Workspace, running


def labels(parts: DataFrame) -> DataFrame:
    """(community, label, size): communities (node, community, file) of two members at least, named after the stem of the file
    most members live in; documents don't name, ties go to the lower path."""
    size = parts.groupBy("community").agg(F.count("*").alias("size")).filter("size >= 2")
    code = parts.filter(F.col("file").isNotNull() & ~F.lower("file").rlike(r"\.(md|markdown)$"))
    by = code.groupBy("community", "file").agg(F.count("*").alias("n"))
    top = by.groupBy("community").agg(F.min(F.struct(-F.col("n"), "file")).alias("top")).select("community", F.col("top.file").alias("file"))
    stem = F.regexp_extract(F.regexp_extract("file", r"([^/\\]*)$", 1), r"^(.[^.]*)", 1)
    return size.join(top, "community").select("community", stem.alias("label"), "file", "size")


def entry_points(parts: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """(label, node, callers, rank): the most called members of each label that live in a file of its name."""
    named = labels(parts).select("community", "label")
    calls = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))
    stem = F.regexp_extract(F.regexp_extract("file", r"([^/\\]*)$", 1), r"^(.[^.]*)", 1)
    met = parts.join(named, "community").filter(stem == F.col("label")).join(calls, "node")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("callers"), "node"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= top).select("label", "node", "callers", "rank")


def merged(named: DataFrame) -> DataFrame:
    """(label, size): groups of one label count as one, largest first in rank."""
    by = named.groupBy("label").agg(F.sum("size").alias("size"), F.count("*").alias("communities"))
    return by.select("label", "size", "communities")


def subsystem_names(parts: DataFrame, most: int = 8) -> DataFrame:
    """(label, size): names of the largest subsystems, for an answer that found nothing: of each community (node, community, file)
    with two definitions or more the stem most of them lie in; a label counts once, by its largest community."""
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    stems = parts.filter("file is not null").withColumn("label", F.regexp_replace(base, r"(?<=.)\.[^.]*$|^\.[^.]*$", "")).groupBy("community", "label").agg(F.count("*").alias("n"))
    told = stems.groupBy("community").agg(F.sum("n").alias("size"), F.min(F.struct(-F.col("n"), F.col("label"))).alias("best")).filter("size >= 2")
    return told.groupBy(F.col("best.label").alias("label")).agg(F.max("size").alias("size")).orderBy(F.desc("size"), "label").limit(most)


def links(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight): edges between two communities, in either direction."""
    home = parts.select("node", "community")
    met = edges.join(home.select(F.col("node").alias("src"), F.col("community").alias("x")), "src").join(home.select(F.col("node").alias("dst"), F.col("community").alias("y")), "dst").filter("x <> y")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight"))


def discs(parts: DataFrame, cell: float = 128.0, work: Workspace | None = None) -> DataFrame:
    """(node, x, y, cx, cy): members of a community on a golden-angle spiral around its centre, the centres, largest first, on a
    wider one; cx and cy are the grid cell."""
    sizes = parts.groupBy("community").agg(F.count("*").alias("size"))
    angle = 2.399963229728653  # fixed value: the golden angle
    placed = running(sizes, [F.desc("size"), F.asc("community")], "size", work or Workspace(parts.sparkSession, "discs")).withColumnRenamed("place", "order")
    centre = placed.select("community", (F.sqrt("before") * 24 * F.cos(F.col("order") * angle)).alias("x0"), (F.sqrt("before") * 24 * F.sin(F.col("order") * angle)).alias("y0"))
    k = F.row_number().over(Window.partitionBy("community").orderBy("node")) - 1
    spots = parts.select("node", "community").withColumn("k", k).join(centre, "community")
    x, y = F.col("x0") + F.sqrt("k") * 8 * F.cos(F.col("k") * angle), F.col("y0") + F.sqrt("k") * 8 * F.sin(F.col("k") * angle)
    return spots.select("node", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy"))


def viewport(layout: DataFrame, degrees: DataFrame, box: tuple[float, float, float, float], most: int = 3000, cell: float = 128.0) -> DataFrame:
    """Nodes in a rectangle, the most connected first; grid cells are tested first, which prunes a table partitioned by them."""
    x1, y1, x2, y2 = box
    near = layout.filter(F.col("cx").between(int(x1 // cell), int(x2 // cell)) & F.col("cy").between(int(y1 // cell), int(y2 // cell))).filter(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    return near.join(degrees, "node", "left").select("node", "x", "y", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "node").limit(most)


def force_layout(nodes: list[int], pairs: list[tuple[int, int]], passes: int = 140, seed: int = 1) -> dict[int, tuple[float, float]]:
    """Free layout of a bounded neighbourhood: repulsion between all, springs along edges, cooling."""
    import numpy as np

    place = {v: i for i, v in enumerate(nodes)}
    x = np.random.default_rng(seed).normal(size=(len(nodes), 2)) * 10
    a = np.array([place[p] for p, _ in pairs], dtype=int)
    b = np.array([place[q] for _, q in pairs], dtype=int)
    for step in range(passes):
        d = x[:, None, :] - x[None, :, :]
        r2 = (d**2).sum(-1) + 1e-3
        move = (d / r2[..., None]).sum(1) * 40
        if len(a):
            spring = (x[a] - x[b]) * 0.05
            np.add.at(move, a, -spring)
            np.add.at(move, b, spring)
        x += np.clip(move, -10, 10) * (1 - step / passes)
    return {v: (float(x[i, 0]), float(x[i, 1])) for v, i in place.items()}
