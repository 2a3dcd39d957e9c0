"""Node-link JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "nodes array<struct<id:string,label:string,source_file:string>>, links array<struct<source:string,target:string,relation:string,confidence:string,weight:double,source_file:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string,weight:double,source_file:string>>"
DEFAULT_WEIGHT = (0.3, 0.7, 1.0)  # fixed values: by confidence


def link(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are nodes, and the dangling rest. An unknown confidence is the weakest, a missing weight that of its
    confidence; parallel edges stay."""
    rank = F.when(F.lower("confidence") == "extracted", 2).when(F.lower("confidence") == "inferred", 1).otherwise(0)
    told = links.withColumn("confidence", rank)
    told = told.withColumn("weight", F.coalesce("weight", F.when(F.col("confidence") == 2, DEFAULT_WEIGHT[2]).when(F.col("confidence") == 1, DEFAULT_WEIGHT[1]).otherwise(DEFAULT_WEIGHT[0])))
    ids = nodes.select("id").filter("id is not null").distinct()
    marked = told.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("a")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("b")), "target", "left")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    return marked.filter(whole).drop("a", "b"), marked.filter(~whole).drop("a", "b")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dangling) of node-link files; either ``links`` or ``edges`` holds the edges."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return _told(raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode(F.concat(F.coalesce("links", F.array()), F.coalesce("edges", F.array()))).alias("e")).select("e.*"))


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dangling) of what ``write`` has written."""
    element = lambda name: next(f.dataType.elementType for f in spark.createDataFrame([], SCHEMA).schema if f.name == name)
    lines = spark.read.text(path)
    of = lambda kind, name: lines.filter(F.get_json_object("value", "$.kind") == kind).select(F.from_json("value", element(name)).alias("x")).select("x.*")
    return _told(of("node", "nodes"), of("link", "links"))


def _told(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return nodes.dropDuplicates(["id"]), *link(nodes.dropDuplicates(["id"]), links)


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes one JSON line per node and edge, tagged by kind, so that no task gathers the graph."""
    a = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    if "confidence" in edges.columns and edges.schema["confidence"].dataType.typeName() != "string":
        edges = edges.withColumn("confidence", F.element_at(F.array(F.lit("ambiguous"), F.lit("inferred"), F.lit("extracted")), F.col("confidence").cast("int") + 1))
    b = edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), *edges.columns)).alias("value"))
    a.union(b).write.mode("overwrite").text(path)
