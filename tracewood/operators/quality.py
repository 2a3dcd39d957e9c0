"""How well extraction and retrieval do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewood.operators.ranking import best
from tracewood.operators.retrieval import tokens
from tracewood.session import Workspace


def extraction_yield(files: DataFrame, defs: DataFrame) -> DataFrame:
    """Files, lines, definitions, files without any and definitions per thousand lines, by language."""
    per = defs.groupBy("file_id").agg(F.count("*").alias("k"))
    by = files.join(per, "file_id", "left").groupBy("lang").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum(F.coalesce("k", F.lit(0))).alias("defs"), F.sum(F.col("k").isNull().cast("long")).alias("empty_files"))
    return by.withColumn("defs_per_kloc", F.round(F.col("defs") * 1000.0 / F.col("lines"), 6))


def below_floor(measured: DataFrame, floors: DataFrame, by: str = "lang", value: str = "defs_per_kloc") -> DataFrame:
    """Measurements below their floor; what has no measurement or no floor doesn't fail."""
    return measured.join(floors, by).filter(F.col(value) < F.col("least")).select(by, value, "least")


def recall_precision(expected: DataFrame, found: DataFrame, returned: int) -> DataFrame:
    """Recall and precision of found (query, node) against expected (query, node), for queries that expect something."""
    hit = found.distinct().withColumn("hit", F.lit(1))
    by = expected.distinct().join(hit, ["query", "node"], "left").groupBy("query").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    return by.select("query", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.col("hits") / F.lit(returned), 6).alias("precision"))


def grep(queries: DataFrame, files: DataFrame, top: int = 5, block: int = 200_000, work: Workspace | None = None) -> DataFrame:
    """(query, file_id, hits, rank): the plain baseline: files that hold most of the query words' first five characters.

    The distinct stems of all queries, in blocks, go over each text once in one automaton; every file's stems are one written row,
    and files are ranked where they lie (``ranking.best``).
    """
    work = work or Workspace(files.sparkSession, "grep")
    asked = work.cut(queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).filter(F.length("term") > 3).select("query", F.substring("term", 1, 5).alias("term")).distinct())
    stems = asked.select("term").distinct().orderBy("term")
    texts = files.filter("text is not null and file_id is not null").select(F.col("file_id").cast("long").alias("node"), F.lower("text").alias("text"))
    met = None
    for start in range(0, max(stems.count(), 1), block):
        words = [r["term"] for r in stems.offset(start).limit(block).collect()]
        part = work.cut(texts.mapInArrow(_finder(words), "node long, terms array<string>"))
        met = part if met is None else met.unionByName(part).groupBy("node").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    one = F.lit(1.0)
    packed = met.select("node", "terms", F.transform("terms", lambda t: one).alias("freqs"))
    lists = stems.select("term", F.col("term").alias("related"), one.alias("idf"))
    found = best(asked.select("query", "term", one.alias("w")), lists, packed, top, 0.0, work)  # the score is the square of the hits
    return found.select("query", F.col("node").alias("file_id"), F.col("coverage").alias("hits"), "rank")


def _finder(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for b in batches:
            found = [list({w for _, w in machine.iter(text)}) if words else [] for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["node", "terms"])

    return run


def anomalies(defines: DataFrame, calls: DataFrame) -> DataFrame:
    """(kind, n, examples): definitions and calls that look like a scanner's mistake, with up to five examples of each: keywords
    as names, odd characters, ranges without room or across others, names defined twice at one place, files mostly outside."""
    from tracewood.operators.spans import partial_overlaps

    words = ["if", "for", "while", "return", "else", "switch", "case", "new", "try", "catch", "class", "def", "function"]
    shown = F.concat_ws("#", "file", "name")
    rows = defines.select(F.when(F.col("name").isin(words), "keyword-def").when(~F.col("name").rlike(r"^[\p{L}_$~][\p{L}\p{N}_$.:?!=-]*$"), "odd-name").when(F.col("start") >= F.col("end"), "bad-range").alias("kind"), shown.alias("what"))
    called = calls.filter(F.col("callee").isin(words)).select(F.lit("keyword-call").alias("kind"), F.concat_ws("#", "file", "callee").alias("what"))
    twice = defines.groupBy("file", "name", "start").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("kind"), shown.alias("what"))
    crossing = partial_overlaps(defines.select("file", F.concat_ws("#", "file", "name").alias("node"), "start", "end")).select(F.lit("crossing").alias("kind"), F.col("a").alias("what"))
    outside = calls.groupBy("file").agg(F.avg((F.col("caller") == "<module>").cast("double")).alias("share"), F.count("*").alias("n")).filter("share > 0.8 and n >= 10").select(F.lit("module-heavy").alias("kind"), F.col("file").alias("what"))
    found = rows.filter("kind is not null").unionByName(called).unionByName(twice).unionByName(crossing).unionByName(outside)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("what"))
    return found.withColumn("r", rank).groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("what")))).alias("examples"))

CHARS_PER_TOKEN = 4  # fixed value: the benchmark's measure of an answer's length
EXPECTATIONS = 50_000  # of one question and section that go over its text at once


def structural_recall(answers: DataFrame, expected: DataFrame, block: int = EXPECTATIONS) -> DataFrame:
    """(question, asked, found, returned, tokens): how many expectations (question, expected) the text of a tool's answer
    (question, answer) holds. An expectation ``in: section symbol`` looks only at the section named so (blanks for its
    underscores), which ends at a blank line; an answer that is null holds nothing.

    The expectations of a question and section, in blocks, are a row and go over the text once in one automaton, so an answer is
    neither repeated nor searched for each of them.
    """
    within = F.coalesce(F.col("expected").startswith("in: "), F.lit(False))
    section = F.when(within, F.regexp_replace(F.regexp_extract("expected", r"^in: (\S+) ", 1), "_", " ")).otherwise(F.lit(""))
    symbol = F.when(within, F.regexp_extract("expected", r"^in: \S+ (.*)$", 1)).otherwise(F.col("expected"))
    told = expected.select("question", within.alias("within"), section.alias("section"), symbol.cast("binary").alias("symbol"))
    keys = ["question", "within", "section"]
    size = told.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    same = F.col("question").eqNullSafe(F.col("_question")) & (F.col("within") == F.col("_within")) & (F.col("section") == F.col("_section"))
    rows = told.join(size, same).groupBy(*keys, F.pmod(F.xxhash64("symbol"), F.col("blocks")).alias("block")).agg(F.count("*").alias("asked"), F.collect_list("symbol").alias("symbols"))
    known = answers.select("question", F.coalesce("answer", F.lit("")).alias("answer"))
    lines = F.size(F.filter(F.split("answer", "\n"), lambda s: s.contains("#")))
    known = known.select("question", "answer", lines.alias("returned"), F.floor(F.length("answer") / CHARS_PER_TOKEN).alias("tokens"))
    met = rows.join(known, "question", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    begins = F.expr("instr(answer, section)")
    part = F.when(F.col("within"), F.when((F.col("section") != "") & (begins > 0), F.substring_index(F.expr("substr(answer, instr(answer, section))"), "\n\n", 1))).otherwise(F.col("answer"))
    kinds = {f.name: f.dataType for f in met.schema.fields}
    out = T.StructType([T.StructField("question", kinds["question"]), *[T.StructField(k, T.LongType()) for k in ("asked", "found", "returned", "tokens")]])
    found = met.select("question", "asked", "returned", "tokens", "within", part.cast("binary").alias("part"), "symbols").mapInArrow(_held, out)
    return found.groupBy("question").agg(F.sum("asked").alias("asked"), F.sum("found").alias("found"), F.coalesce(F.max("returned"), F.lit(0)).cast("int").alias("returned"), F.coalesce(F.max("tokens"), F.lit(0).cast("long")).alias("tokens"))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the symbols that a text holds; bytes are read as single characters, so bytes are what is compared."""
    import ahocorasick

    for b in batches:
        counts = []
        for i in range(b.num_rows):
            within, part, symbols = (b.column(k)[i].as_py() for k in (4, 5, 6))
            if not symbols or part is None:
                counts.append(0 if symbols else None)
                continue
            machine = ahocorasick.Automaton()
            for s in {*symbols} - {b""}:
                machine.add_word(s.decode("latin-1"), s)
            machine.make_automaton()
            held = {s for _, s in machine.iter(part.decode("latin-1"))} if len(machine) else set()
            if not within:
                held.add(b"")
            counts.append(sum(s in held for s in symbols))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), b.column(2).cast(pa.int64()), b.column(3)], names=["question", "asked", "found", "returned", "tokens"])
