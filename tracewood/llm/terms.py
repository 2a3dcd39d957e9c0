"""Frequency of every distinct value or term: uses, records and a mark for those too rare or too common.

Heavy-light aggregation. A bounded sketch (at most ``HEAVY`` terms, built in one pass, mergeable) detects heavy terms, which
are broadcast as a table from term to slot. Rows then shuffle once: a light term's rows meet by term, a heavy term's are
spread by slot and record and carry the slot in place of the term. Repeated rows fall away there, and light terms are counted
for good. Heavy terms are counted exactly in local arrays, one counter per slot and task, and the arrays are added up. Both
count tables are then united. The sketch decides merely where a term is counted: counts are exact whatever it says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.functions.text import fingerprint, global_symbol
from tracewood.session import Workspace

HEAVY = 256  # the most terms that are ever broadcast
RARE_RECORDS = 1
COMMON_SHARE = (1, 20)


def heavy_terms(rows: DataFrame, limit: int = HEAVY) -> list[str]:
    """Terms that may hold many rows: the sketch's items above a thousandth of all rows, never more than ``limit``."""
    got = rows.agg(F.expr(f"approx_top_k(term, {limit}, {8 * limit})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in got["top"] or [] if x["item"] is not None and x["count"] * 1000 >= got["n"]][:limit]


def _add_up(slots: int):
    """Exact counter arrays over the slots of one task: uses and records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, records = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
        for batch in batches:
            slot = batch.column(0).to_numpy()
            np.add.at(uses, slot, batch.column(1).to_numpy())
            records += np.bincount(slot, minlength=slots)
        met = np.flatnonzero(records)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(uses[met]), pa.array(records[met])], names=["_slot", "uses", "records"])

    return run


def count_terms(named: DataFrame, heavy: list[str], unique: bool, work: Workspace) -> DataFrame:
    """(term, uses, records) of (term, _r1, _r2, _uid) rows with a term; ``heavy`` terms are counted in slots.

    A use is a distinct _uid within a term and record, or with ``unique`` each record once.
    """
    spark = named.sparkSession
    slots = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(heavy)], "term string, _slot int"))
    heavily = F.col("_slot").isNotNull()
    place = F.when(heavily, F.xxhash64("_slot", "_r1")).otherwise(F.xxhash64("term"))  # a heavy row's place stands for its _r1
    lean = [place.alias("_place"), "_slot", F.when(~heavily, F.col("term")).alias("term"), F.when(~heavily, F.col("_r1")).alias("_r1"), "_r2"]
    met = named.join(slots, "term", "left").select(*lean, *([] if unique else ["_uid"])).repartition("_place")
    # everything below finds its rows together, so the only further shuffle is that of the arrays
    pairs = met.distinct().groupBy("_place", "_slot", "term", "_r1", "_r2").agg(F.lit(1).cast("long").alias("n") if unique else F.count("_uid").alias("n"))
    counted = work.cut(pairs.groupBy("_place", "_slot", "term").agg(F.sum("n").alias("uses"), F.count("*").alias("records")).drop("_place"))
    light = counted.filter("_slot is null").select("term", "uses", "records")
    if not heavy:
        return light
    arrays = counted.filter("_slot is not null").select("_slot", "uses").mapInArrow(_add_up(len(heavy)), "_slot int, uses long, records long")
    dense = arrays.groupBy("_slot").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))
    return light.unionByName(dense.join(slots, "_slot").select("term", "uses", "records"))


def term_frequency(rows: DataFrame, term: Column, record: list[str], uid: str | None = None, limit: int = HEAVY, work: Workspace | None = None) -> DataFrame:
    """term, uses, records, mark of every non-null term; records are the distinct values of ``record``.

    Rows with one ``uid`` are one use (a row without uid can't be told from copies and gives no use, but its record
    counts); without ``uid`` each distinct record is one use. Null parts of ``record`` are values. ``mark`` is 'rare' for
    a term in one record, 'common' for one in more than a twentieth of all records (terms or not), else null; a term
    that is both is rare. No rows give no rows.
    """
    work = work or Workspace(rows.sparkSession, "terms")
    a, b = fingerprint(*record)
    base = rows.select(a.alias("_r1"), b.alias("_r2"), term.alias("term"), *([F.col(uid).alias("_uid")] if uid else []))
    total = base.select("_r1", "_r2").distinct().agg(F.count("*").alias("_all"))
    named = base.filter("term is not null")
    counts = count_terms(named, heavy_terms(named, limit), uid is None, work)
    top, bottom = COMMON_SHARE
    common = F.col("records") * bottom > F.col("_all") * top
    mark = F.when(F.col("records") <= RARE_RECORDS, "rare").when(common, "common")
    return counts.join(F.broadcast(total)).select("term", "uses", "records", mark.alias("mark"))


def path_parts(path: Column) -> Column:
    """Parts of a path between slashes of either kind, without empty parts and '.'."""
    return F.filter(F.split(path, r"[/\\]"), lambda p: (p != "") & (p != "."))


def symbol_terms(occurrences: DataFrame) -> DataFrame:
    """Frequency of every symbol over the files of the occurrence table."""
    return term_frequency(occurrences, global_symbol("symbol"), ["repo", "relative_path"], "occ_id")


def path_terms(files: DataFrame) -> DataFrame:
    """Frequency of every path part over the files of the document table. Files without id are left out."""
    parts = files.filter("file_id is not null").select("file_id", F.explode_outer(path_parts(F.col("relative_path"))).alias("part"))
    return term_frequency(parts, F.col("part"), ["file_id"])


def all_terms(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """field, term, uses, records, mark of both fields."""
    return symbol_terms(occurrences).withColumn("field", F.lit("symbol")).unionByName(path_terms(files).withColumn("field", F.lit("relative_path"))).select("field", "term", "uses", "records", "mark")
