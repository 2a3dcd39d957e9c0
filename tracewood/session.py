"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", memory: str = "8g", shuffles: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster the submitter's session is used as it is."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("tracewood").config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffles), **conf}.items():
        build = build.config(key, value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where it is unset, a session whose executors are
    its driver (tests, ``local[n]``) gets a temporary one; any other is refused, as its hosts share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewood-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = f"file://{folder}"
    return folder.rstrip("/")


class Workspace:
    """Written tables of one run below the shared folder, for lineage cuts that survive lost executors.

    ``cut`` writes a DataFrame and reads it back, so later plans start from files and have sizes to plan with.
    ``drop`` removes a table that nothing reads any more; the rest goes when the application ends, as results that are not
    evaluated yet still read it.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0

    def cut(self, df: DataFrame, *, buckets: int | None = None, by: str | None = None) -> DataFrame:
        """``df`` written and read again; ``by`` names a column with few values by which it lies in folders that filters prune."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        out = (df.coalesce(buckets) if buckets else df).write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        if self.count == 1:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tracewood_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_tracewood_path", None)
            if path:
                jvm = self.spark._jvm
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def running(df: DataFrame, order: list[Column], weight: str, work: Workspace) -> DataFrame:
    """``df`` with ``place`` (from 0) and ``before`` (sum of ``weight`` over all earlier rows) in a total order.

    Rows are laid out in ranges; each range is counted by itself, and only one sum per range is added up in one place.
    """
    laid = work.cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = laid.groupBy("_range").agg(F.sum(weight).alias("_sum"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_range").orderBy(*order)
    told = laid.withColumn("_within", F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_rank", F.row_number().over(within) - 1)
    return told.join(F.broadcast(base), "_range").withColumn("before", F.col("_base") + F.col("_within")).withColumn("place", F.col("_first") + F.col("_rank")).drop("_range", "_within", "_rank", "_base", "_first")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, unless PYTHONPATH already does; once per application."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    place = Path(tempfile.mkdtemp(prefix="tracewood-")) / "tracewood.zip"
    with zipfile.ZipFile(place, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(place))
    _shipped.add(app)


def cores(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
