"""Best-first expansion over weighted edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewood.session import Workspace

HALF_LIFE = 14 * 86_400
HOP_DECAY, FOREIGN, THRESHOLD = 0.5, 0.05, 0.01
AUTHORITY = (0.3, 0.7, 1.0)  # fixed values: by confidence


def temporal_weight(age: Column, half_life: float = HALF_LIFE) -> Column:
    """Halves every ``half_life`` seconds; 1 for no half-life, negative ages count as none."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.exp(-F.lit(math.log(2)) * F.greatest(age, F.lit(0)) / F.lit(float(half_life)))


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_hops: int = 3, max_nodes: int = 40, now: int | None = None, half_life: float = HALF_LIFE, work: Workspace | None = None) -> DataFrame:
    """(node, symbol, score, hops): nodes by their best path product from the seeds (node, weight), best first, ties by id.

    Every edge at least halves a path, so entries whose path lies in (2^-(k+1), 2^-k] can't improve one another: the
    frontier is settled band by band, in seven rounds down to the threshold, as a priority queue would settle it. Within a
    band entries relax in order of path and node; a target keeps those that beat all before them. A node that isn't
    defined ranks at a twentieth while its path goes on undiminished. Only an entry that still holds its node's best rank
    (or whose path isn't below it) is expanded.
    """
    work = work or Workspace(edges.sparkSession, "expand")
    if now is None:
        now = edges.agg(F.max("ts")).first()[0] or 0
    trust = F.when(F.col("confidence") == 2, AUTHORITY[2]).when(F.col("confidence") == 1, AUTHORITY[1]).otherwise(AUTHORITY[0])
    factor = trust * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("authority"))) * temporal_weight(F.lit(now) - F.col("ts"), half_life) * HOP_DECAY
    local = nodes.select(F.col("node").alias("dst"), "is_defined")
    # parallel edges of a pair: only the best factor can ever matter
    links = work.cut(edges.select("src", "dst", factor.alias("factor")).filter(F.col("factor") >= THRESHOLD * 0.05).groupBy("src", "dst").agg(F.max("factor").alias("factor")).join(local, "dst", "left"))
    start = work.cut(seeds).groupBy("node").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("weight").cast("double"))).alias("path")).join(local.withColumnRenamed("dst", "node"), "node", "left")
    rank = F.when(F.coalesce("is_defined", F.lit(False)), F.col("path")).otherwise(F.col("path") * FOREIGN)
    best = work.cut(start.select("node", rank.alias("score"), F.lit(0).alias("hops")))
    queue = work.cut(start.select("node", "path", F.lit(0).alias("hops")))
    for band in range(7):
        low, high = 2.0 ** -(band + 1), 2.0**-band
        here = queue.filter((F.col("path") > low) & (F.col("path") <= high if band else F.lit(True)))
        live = here.join(best.select("node", "score"), "node").filter(~(F.col("score") > F.col("path"))).filter(F.col("hops") < max_hops)
        step = live.select(F.col("node").alias("src"), F.col("path").alias("from_path"), "hops").join(links, "src").withColumn("path", F.col("from_path") * F.col("factor")).filter(F.col("path") >= THRESHOLD)
        step = step.withColumn("score", F.when(F.coalesce("is_defined", F.lit(False)), F.col("path")).otherwise(F.col("path") * FOREIGN))
        order = Window.partitionBy("dst").orderBy(F.desc("from_path"), "src", "hops")
        known = best.select(F.col("node").alias("dst"), F.col("score").alias("held"))
        ranked = step.join(known, "dst", "left").withColumn("before", F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        kept = work.cut(ranked.filter(F.col("score") > F.coalesce(F.greatest("before", "held"), F.lit(-1.0))).select(F.col("dst").alias("node"), "path", "score", (F.col("hops") + 1).alias("hops"), "from_path", "src"))
        if kept.take(1):
            last = kept.groupBy("node").agg(F.max_by(F.struct("score", "hops"), F.struct("score", F.struct(-F.col("hops")))).alias("top")).select("node", F.col("top.score").alias("score"), F.col("top.hops").alias("hops"))
            best = work.cut(best.join(last.select("node"), "node", "left_anti").unionByName(last))
            queue = work.cut(queue.filter(F.col("path") <= low).unionByName(kept.select("node", "path", "hops")))
    top = best.join(nodes.select("node", "symbol"), "node", "left").orderBy(F.desc("score"), "node").limit(max_nodes)
    return top.select("node", "symbol", F.round("score", 3).alias("score"), "hops")
