"""Whole answers put together from the operators: what a question, a symbol or a change leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewood.operators import graph, retrieval, spans
from tracewood.operators.embed import nearest
from tracewood.operators.expand import expand
from tracewood.operators.unused import is_test_symbol

SEEDS = 24


def resolve_one(nodes: DataFrame, text: str) -> tuple[int, str]:
    """The one node a text names: in full, else by tail, else as part of it. Placeholders stand back behind definitions;
    none or several are an error that lists the first eight."""
    for test in (F.col("symbol") == text, F.col("name") == text, F.contains(F.col("symbol"), F.lit(text))):
        hits = nodes.filter(test).orderBy(F.desc("is_defined"), "node").limit(9).collect()
        hits = [h for h in hits if h["is_defined"]] or hits
        if len(hits) == 1:
            return hits[0]["node"], hits[0]["symbol"]
        if hits:
            raise ValueError(f"{text} is ambiguous: {', '.join(h['symbol'] for h in hits[:8])}")
    raise ValueError(f"nothing is named {text}")


def seeds(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, weight): where a question enters the graph. Cascade: full symbol, all of a file, tail (eight at most), part (at 0.8),
    else the best of a search, by share of the best score. Tests count 0.8 unless the question asks for tests."""
    full = nodes.filter(F.col("symbol") == text).select("node", F.lit(1.0).alias("weight"))
    steps = [full, nodes.filter((F.col("file") == text) & F.col("is_defined")).select("node", F.lit(1.0).alias("weight")), nodes.filter(F.col("name") == text).orderBy("node").limit(8).select("node", F.lit(1.0).alias("weight"))]
    if len(text.encode()) >= 3:
        steps.append(nodes.filter(F.contains(F.col("symbol"), F.lit(text))).orderBy("node").limit(8).select("node", F.lit(0.8).alias("weight")))
    for found in steps:
        if found.take(1):
            return found
    query = nodes.sparkSession.createDataFrame([(0, text)], "query long, text string")
    hits = retrieval.search(query, docs, SEEDS)
    top = hits.agg(F.max("score").alias("top"))
    scored = hits.join(F.broadcast(top)).select("node", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("score") / F.col("top"))).alias("weight")).join(nodes.select("node", "file", "name"), "node", "left")
    asks = set(text.lower().split()) & {"test", "tests", "testing", "spec", "specs"}
    factor = F.lit(1.0) if asks else F.when(is_test_symbol(F.coalesce("file", F.lit("")), F.coalesce("name", F.lit(""))), 0.8).otherwise(1.0)
    return scored.select("node", (F.col("weight") * factor).alias("weight"))


def query_graph(edges: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, max_nodes: int = 40, max_hops: int = 3) -> DataFrame:
    """(node, symbol, file, score, hops): what belongs to a question."""
    got = expand(edges, nodes, seeds(nodes, docs, text), min(max(max_hops, 1), 30), min(max(max_nodes, 1), 400))
    return got.join(nodes.select("node", "file"), "node", "left").select("node", "symbol", "file", "score", "hops")


def explain(edges: DataFrame, nodes: DataFrame, parts: DataFrame, node: int, siblings: int = 8, vectors: DataFrame | None = None, near: int = 5) -> DataFrame:
    """(relation, symbol, confidence): what a node calls, who calls it, others of its community, and with ``vectors`` (node, vec)
    the ``near`` defined ones most alike."""
    made = graph.calls(edges, nodes)
    names = nodes.select("node", "symbol")
    out = made.filter(F.col("caller") == node).groupBy(F.col("callee").alias("node")).agg(F.max("confidence").alias("confidence")).select(F.lit("calls").alias("relation"), "node", "confidence")
    into = made.filter(F.col("callee") == node).groupBy(F.col("caller").alias("node")).agg(F.max("confidence").alias("confidence")).select(F.lit("callers").alias("relation"), "node", "confidence")
    own = parts.filter(F.col("node") == node).select("community")
    beside = parts.join(own, "community", "left_semi").filter(F.col("node") != node).orderBy("node").limit(siblings).select(F.lit("siblings").alias("relation"), "node", F.lit(None).cast("int").alias("confidence"))
    told = out.unionByName(into).unionByName(beside)
    if vectors is not None:
        defined = vectors.join(nodes.filter("is_defined").select("node"), "node", "left_semi")
        alike = nearest(vectors.filter(F.col("node") == node).select(F.col("node").alias("query"), "vec"), defined, near)
        told = told.unionByName(alike.select(F.lit("similar").alias("relation"), "node", F.lit(None).cast("int").alias("confidence")))
    return told.join(names, "node").select("relation", "symbol", "confidence")


def line_ranges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file, node, first, last): lines of byte spans (file, node, start, end) in texts (file, text); spans outside are left out."""
    met = symbols.filter("start >= 0 and start < end").join(files.select("file", F.encode("text", "utf-8").alias("raw")), "file").filter(F.col("end") <= F.length("raw"))
    line = lambda at: F.length(F.substring(F.col("raw"), F.lit(1), at)) - F.length(F.regexp_replace(F.decode(F.substring(F.col("raw"), F.lit(1), at), "ISO-8859-1"), "\n", "")) + 1
    return met.select("file", "node", line(F.col("start")).alias("first"), line(F.col("end") - 1).alias("last"))


def changed_hunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, first, last): runs of lines of the new texts (file, text) that the old text of the file doesn't hold."""
    lines = lambda df: df.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("n"), F.rtrim(F.regexp_replace("line", "\r$", "")).alias("line"))
    fresh = lines(new).join(lines(old).select("file", "line").distinct(), ["file", "line"], "left_anti")
    island = F.col("n") - F.row_number().over(Window.partitionBy("file").orderBy("n"))
    return fresh.withColumn("island", island).groupBy("file", "island").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("island")


def detect_changes(symbols: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, node): definitions that a change of texts touches, the innermost of nested ones."""
    hunks = changed_hunks(old, new)
    return spans.touched(hunks, line_ranges(symbols.join(hunks.select("file").distinct(), "file", "left_semi"), new))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Source of a byte span widened to the comment and attribute lines directly above it."""
    raw = F.encode(text, "utf-8")
    before = F.decode(F.substring(raw, F.lit(1), start), "utf-8")
    above = F.regexp_extract(before, r"((?:^|\n)(?:[ \t]*(?://|#|\*|/\*|--|@)[^\n]*\n)+[ \t]*)$", 1)
    return F.concat(F.regexp_replace(above, "^\n", ""), spans.byte_slice(text, start, end))


def package_suffix(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(asked, path): the path whose directory shares the longest run of last parts with a package (asked), if only one does.

    The join runs on the last part, so a package meets only directories that end like it.
    """
    want = asked.select("asked", F.filter(F.split("asked", r"[./\\:]+"), lambda p: p != "").alias("a")).filter("size(a) > 0").withColumn("key", F.element_at("a", -1))
    have = paths.select("path", F.filter(F.split("path", r"[/\\]+"), lambda p: p != "").alias("b")).filter("size(b) > 0").withColumn("key", F.element_at("b", -1))
    met = want.join(have, "key")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda k: F.slice(F.col("a"), F.size("a") - k + 1, k) == F.slice(F.col("b"), F.size("b") - k + 1, k)))
    scored = met.withColumn("same", same)
    by = Window.partitionBy("asked")
    return scored.withColumn("best", F.max("same").over(by)).filter("same = best").withColumn("n", F.count("*").over(by)).filter("n = 1").select("asked", "path", F.col("same").alias("parts"))


def defining_macros(calls: DataFrame, definers: DataFrame) -> DataFrame:
    """(file, name): definitions that macro calls (file, macro, first) make: the macro is among any file's definers (macro)."""
    return calls.join(definers.select("macro").distinct(), "macro", "left_semi").filter("first is not null").select("file", F.col("first").alias("name")).distinct()


def dispatch(stores: DataFrame, calls: DataFrame, constants: DataFrame, rounds: int = 8) -> DataFrame:
    """(caller, target): indirect calls (caller, slot) resolved through what was stored in the slot (slot, value); constants
    (name, value) stand for one another over at most ``rounds`` steps."""
    known = constants.select("name", "value")
    for _ in range(rounds):
        step = known.select("name", F.col("value").alias("via")).join(constants.select(F.col("name").alias("via"), F.col("value").alias("deeper")), "via", "left")
        following = step.select("name", F.coalesce("deeper", "via").alias("value")).distinct()
        if not following.exceptAll(known).take(1):
            break
        known = following
    plain = lambda df, c: df.join(known.select(F.col("name").alias(c), "value_of"), c, "left").withColumn(c, F.coalesce("value_of", F.col(c))).drop("value_of")
    known = known.select("name", F.col("value").alias("value_of"))
    placed = plain(plain(stores.select("slot", "value"), "slot"), "value")
    return plain(calls.select("caller", "slot"), "slot").join(placed, "slot").select("caller", F.col("value").alias("target")).distinct()


def outside_modules(files: DataFrame, mods: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(file): source files that no root reaches through module declarations (file, child)."""
    reached = roots.select("file").distinct()
    level = reached
    for _ in range(depth):
        level = level.join(mods, "file").select(F.col("child").alias("file")).distinct().join(reached, "file", "left_anti")
        if not level.take(1):
            break
        reached = reached.union(level)
    return files.select("file").distinct().join(reached, "file", "left_anti")


def partition_scale(parts: DataFrame, named: DataFrame) -> DataFrame:
    """Members (node, community, file) placed in the community named (community, label) for their file's stem, placed elsewhere
    though such a community exists, or without one."""
    stem = F.regexp_extract(F.regexp_extract("file", r"([^/\\]*)$", 1), r"^(.[^.]*)", 1)
    own = parts.join(named.select("community", "label"), "community", "left").withColumn("stem", stem)
    there = named.select(F.col("label").alias("stem")).distinct().withColumn("exists", F.lit(True))
    verdict = F.when(F.col("label") == F.col("stem"), "placed").when(F.col("exists"), "wrong").otherwise("absent")
    return own.join(there, "stem", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
