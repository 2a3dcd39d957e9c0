"""Structural embeddings and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 64
OWN, NEAR, SINK = 0.35, 0.65, 0.3


def signature(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A unit vector per id from a SplitMix64 stream that the id seeds."""
    with np.errstate(over="ignore"):
        golden = np.uint64(0x9E3779B97F4A7C15)  # fixed values of the published generator
        z = ids.astype(np.uint64)[:, None] + golden * np.arange(1, dims + 1, dtype=np.uint64)[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    x = (z >> np.uint64(40)).astype(np.float64) / float(1 << 24) * 2 - 1
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def signatures(nodes: DataFrame) -> DataFrame:
    """(node, vec) of every node, vectorised per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = signature(b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), DIMS).cast(pa.list_(pa.float64()))], names=["node", "vec"])

    return nodes.filter("node is not null").select(F.col("node").cast("long").alias("node")).mapInArrow(run, "node long, vec array<double>")


def unit(vec):
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def propagate(vectors: DataFrame, links: DataFrame, dims: int = DIMS) -> DataFrame:
    """One round: a node with links (src, dst) becomes 0.35 of itself and 0.65 of its neighbours' mean, where a neighbour
    without links of its own weighs 0.3; others stay. Unit length. A node's sums are one row of ``dims`` numbers, combined before
    the shuffle."""
    starts = links.select(F.col("src").alias("node")).distinct().withColumn("moves", F.lit(True))
    told = vectors.join(starts, "node", "left")
    near = links.select("src", F.col("dst").alias("node")).join(told, "node").select(F.col("src").alias("node"), F.when(F.col("moves"), 1.0).otherwise(SINK).alias("w"), "vec")
    sums = near.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(F.col("w") * F.element_at("vec", i + 1)).alias(f"s{i}") for i in range(dims)])
    mean = sums.select("node", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dims)]).alias("mean"))
    mixed = F.when(F.col("moves") & F.col("mean").isNotNull(), F.zip_with("vec", "mean", lambda x, m: OWN * x + NEAR * m)).otherwise(F.col("vec"))
    return told.join(mean, "node", "left").select("node", unit(mixed).alias("vec"))


BLOCK_ROWS = 20_000  # rows of a block of queries or vectors


def _packed(rows: DataFrame, block: Column, names: tuple[str, str]) -> DataFrame:
    """(block, ids, flat): whole blocks of vectors of one width, a row each."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.BinaryType())])

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "width": [int(pdf["width"].iloc[0])], names[0]: [pdf["id"].to_numpy(np.int64).tobytes()], names[1]: [x.tobytes()]})

    return rows.withColumn("block", block).withColumn("width", F.size("vec")).groupBy("block", "width").applyInPandas(run, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, node, score, rank): the k vectors (node, vec) of largest cosine to each query (query, vec), itself left out.

    Exact: blocks of queries meet blocks of vectors in tasks of their own, so neither side is held by the driver or broadcast,
    and each pair of blocks keeps only its own k best: the last shuffle carries k rows per query and block of vectors. Ties go to
    the lower node; vectors of other length than the query, null ones and those with a null in them don't count.
    """
    sound = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter("id is not null and vec is not null and size(vec) > 0").filter(~F.exists("vec", lambda x: x.isNull()))
    asked, given = sound(queries, "query").distinct(), sound(vectors, "node")
    parts = max(1, -(-asked.count() // block_rows)), max(1, -(-given.count() // block_rows))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    q = _packed(asked, place(parts[0]), ("q_ids", "q"))
    v = _packed(given, place(parts[1]), ("v_ids", "v")).withColumnRenamed("block", "v_block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[0] - 1).cast("long"))))
    both = v.join(q, ["block", "width"]).repartition(parts[0] * parts[1], "block", "v_block").select("width", "q_ids", "q", "v_ids", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, nodes = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["v_ids"], np.int64)
                x, y = (np.frombuffer(row[c]).reshape(-1, row["width"]) for c in ("q", "v"))
                for at in range(0, len(ids), 500):  # 500 rows of scores at once
                    mine = ids[at : at + 500]
                    score = np.round(x[at : at + 500] @ y.T, 6)
                    score[mine[:, None] == nodes[None, :]] = -np.inf
                    if score.shape[1] > 4 * k:  # all that may be among the k best, ties included
                        least = np.partition(score, -k, axis=1)[:, -k]
                        r, c = np.nonzero(score >= least[:, None])
                    else:
                        r, c = np.nonzero(np.ones(score.shape, dtype=bool))
                    s = score[r, c]
                    order = np.lexsort((nodes[c], -s, r))
                    r, c, s = r[order], c[order], s[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    keep = (rank < k) & np.isfinite(s)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[r[keep]]), pa.array(nodes[c[keep]]), pa.array(s[keep])], names=["query", "node", "score"])

    found = both.mapInArrow(run, "query long, node long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
