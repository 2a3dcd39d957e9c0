"""Lexical retrieval: an inverted index over names and documentation, BM25 with coverage, stem fallback and compounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewood.operators.ranking import best, by_node
from tracewood.session import Workspace

# Words a question is phrased with rather than about.
STOP_WORDS = """the and for with that this from into how what when where why who which does did are is was were be been it its of to in on at by as an or if then than so not no
can will would should could may might must has have had do get one per out up down back about any all some you your
der die das den dem des ein eine einer eines einem einen und oder nicht kein keine wie wieso warum weshalb wann wer welche welcher welches wird werden wurde wurden sind waren ist hat haben hatte
kann koennen können soll sollen sollte muss muessen müssen sich man jemand etwas bei mit von vom beim fuer für ueber über nach aus auf zum zur durch gegen ohne wenn dass damit weil
diese dieser dieses auch schon noch nur wieder gibt sowie dabei dann also wobei actually really simply just exactly eigentlich wirklich genau einfach tatsaechlich tatsächlich""".split()
K1, DOC_SCALE, DOC_WEIGHT, STEM, FALLBACK_DF, MIN_PART, SPLIT_WEIGHT = 1.2, 100, 0.03, 5, 3, 4, 0.5


def tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of an identifier or a text: split where a capital follows a small letter or digit and at all that is no letter
    or digit; lower case; without single bytes and stop words. Null gives an empty list."""
    parts = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (F.octet_length(w) > 1) & ~w.isin(stop))


def postings(symbols: DataFrame) -> DataFrame:
    """(term, node, freq) of ``symbols`` (node, symbol, docs): a word of the name counts 100, one of the documentation that
    isn't in the name 3 per use, cut as 32-bit arithmetic cuts it."""
    return _postings(symbols).drop("named")


def _postings(symbols: DataFrame) -> DataFrame:
    """As ``postings``, and ``named``: the word is in the name."""
    words = symbols.select("node", F.explode(F.concat(F.transform(tokens(F.col("symbol")), lambda w: F.struct(w.alias("term"), F.lit(1).alias("name"), F.lit(0).alias("doc"))), F.transform(tokens(F.col("docs")), lambda w: F.struct(w.alias("term"), F.lit(0).alias("name"), F.lit(1).alias("doc"))))).alias("w"))
    counts = words.groupBy("node", "w.term").agg(F.sum("w.name").alias("name"), F.sum("w.doc").alias("doc"))
    in_doc = (F.col("doc").cast("float") * F.lit(DOC_WEIGHT).cast("float") * F.lit(DOC_SCALE).cast("float")).cast("int")
    return counts.select("term", "node", F.when(F.col("name") > 0, (F.col("name") * DOC_SCALE).cast("int")).otherwise(in_doc).alias("freq"), (F.col("name") > 0).alias("named"))


def lengths(symbols: DataFrame) -> DataFrame:
    size = (F.size(tokens(F.col("symbol"))).cast("float") + F.size(tokens(F.col("docs"))).cast("float") * F.lit(DOC_WEIGHT).cast("float")) * F.lit(float(DOC_SCALE)).cast("float")
    return symbols.select("node", size.cast("int").alias("length"), (F.size(tokens(F.col("symbol"))) > 0).alias("named")).filter("named").drop("named")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def _is_code() -> Column:
    return ~F.coalesce(F.lower("symbol").rlike(r"\.(md|markdown)#"), F.lit(False))


def prose_only(symbols: DataFrame, index: DataFrame) -> DataFrame:
    """Terms of the index that no code symbol carries, in its name or documentation; Markdown symbols aren't code."""
    code = symbols.filter(_is_code()).select("node").distinct()
    return index.join(code, "node", "left_anti").select("term").distinct().join(index.join(code, "node", "left_semi").select("term").distinct(), "term", "left_anti")


def stem_relatives(terms: DataFrame, vocabulary: DataFrame, prose: DataFrame) -> DataFrame:
    """(term, related, df): for query terms that occur at most three times or in prose only, the indexed words that begin with
    their first five characters; if there are none, with k and z spelled c on both sides."""
    thin = terms.join(vocabulary.select("term", "df"), "term", "left").join(prose.withColumn("prose", F.lit(True)), "term", "left").filter("df is null or df <= 3 or prose").filter(F.length("term") >= STEM).select("term", F.substring("term", 1, STEM).alias("stem"))
    heads = vocabulary.filter(F.length("term") >= STEM).select(F.col("term").alias("related"), "df", F.substring("term", 1, STEM).alias("stem"))
    plain = thin.join(heads, "stem").select("term", "related", "df")
    fold = lambda c: F.translate(c, "kz", "cc")
    rest = thin.join(plain.select("term").distinct(), "term", "left_anti")
    folded = rest.select("term", fold("stem").alias("stem")).join(heads.select("related", "df", fold("stem").alias("stem")), "stem").select("term", "related", "df")
    return plain.filter("term <> related").unionByName(folded.filter("term <> related"))


def compound_parts(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, head, tail): terms not indexed that split into two indexed words of at least four bytes, longest head first."""
    words = vocabulary.select("term")
    unknown = terms.join(words, "term", "left_anti").filter(F.octet_length("term") >= 2 * MIN_PART)
    cuts = unknown.select("term", F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("at")).select("term", "at", F.expr("substr(term, 1, at)").alias("head"), F.expr("substr(term, at + 1)").alias("tail")).filter((F.octet_length("head") >= MIN_PART) & (F.octet_length("tail") >= MIN_PART))
    good = cuts.join(words.withColumnRenamed("term", "head"), "head").join(words.withColumnRenamed("term", "tail"), "tail")
    return good.groupBy("term").agg(F.max_by(F.struct("head", "tail"), "at").alias("best")).select("term", "best.head", "best.tail")


def bm25(queries: DataFrame, index: DataFrame, documents: DataFrame, top: int = 24, work: Workspace | None = None) -> DataFrame:
    """(query, node, score, coverage, rank): best nodes of each query (query, text) by exact terms.

    Score: the sum of idf and saturated frequency, times the number of distinct query terms matched. Only nodes that share a word
    are scored; they are scored where they lie (``ranking.best``).
    """
    work = work or Workspace(index.sparkSession, "bm25")
    packed = by_node(index, work)
    return _by_exact_terms(_asked(queries), packed, document_frequency(packed.select(F.explode("terms").alias("term"))), documents.agg(F.count("*").alias("n")), top, work)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _by_exact_terms(asked: DataFrame, packed: DataFrame, vocabulary: DataFrame, total: DataFrame, top: int, work: Workspace) -> DataFrame:
    lists = vocabulary.join(F.broadcast(total)).select("term", F.col("term").alias("related"), _idf().alias("idf"))
    return best(asked.withColumn("w", F.lit(1.0)), lists.join(asked.select("term").distinct(), "term", "left_semi"), packed, top, K1, work)


def _idf() -> Column:
    return F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def search(queries: DataFrame, symbols: DataFrame, top: int = 24, work: Workspace | None = None) -> DataFrame:
    """As ``bm25``, with stem relatives (each list with its own df, coverage once per term) and halves of compounds (half
    weight, no coverage). Texts are split once: index and vocabulary are written, and all else reads them."""
    work = work or Workspace(symbols.sparkSession, "search")
    packed = by_node(postings(symbols), work)
    code = symbols.filter(_is_code()).select("node", F.lit(True).alias("code"))
    held = packed.join(code.distinct(), "node", "left").select(F.explode("terms").alias("term"), F.coalesce("code", F.lit(False)).alias("code"))
    vocabulary = work.cut(held.groupBy("term").agg(F.count("*").alias("df"), F.max("code").alias("code")))
    asked = work.cut(_asked(queries))
    words = asked.select("term").distinct()
    halves = compound_parts(words, vocabulary).select("term", F.explode(F.array("head", "tail")).alias("part"))
    terms = work.cut(asked.select("query", "term", F.lit(1.0).alias("w")).unionByName(asked.join(halves, "term").select("query", F.col("part").alias("term"), F.lit(SPLIT_WEIGHT).alias("w"))).groupBy("query", "term").agg(F.max("w").alias("w")))
    every = terms.select("term").distinct()
    lists = every.join(vocabulary, "term").select("term", F.col("term").alias("related"), "df").unionByName(stem_relatives(every, vocabulary, vocabulary.filter("not code").select("term")))
    total = lengths(symbols).agg(F.count("*").alias("n"))
    return best(terms, lists.join(F.broadcast(total)).select("term", "related", _idf().alias("idf")), packed, top, K1, work)


def vocabulary_suggestion(results: DataFrame, symbols: DataFrame, index: DataFrame, queries: DataFrame, top: int = 6) -> DataFrame:
    """(query, word, weight): words of the ten best results that the query didn't use: twice a symbol's name's words and once its
    file stem's, by the root of their document frequency."""
    return _suggested(results, symbols, document_frequency(index), _asked(queries), top)


def suggest(queries: DataFrame, symbols: DataFrame, top: int = 6, work: Workspace | None = None) -> DataFrame:
    """``vocabulary_suggestion`` of the best results by ``bm25``. The texts of ``symbols``, a row per node, and of the queries are
    split once: index, vocabulary and the queries' words are written, and all else reads them."""
    work = work or Workspace(symbols.sparkSession, "suggest")
    packed = by_node(_postings(symbols), work, F.max("named").alias("named"))
    vocabulary = work.cut(document_frequency(packed.select(F.explode("terms").alias("term"))))
    asked = work.cut(_asked(queries))
    total = packed.agg(F.count_if("named").alias("n"))
    return _suggested(_by_exact_terms(asked, packed, vocabulary, total, 10, work), symbols, vocabulary, asked, top)


def _suggested(results: DataFrame, symbols: DataFrame, vocabulary: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    best = results.filter("rank <= 10").select("query", "node").join(symbols.select("node", "symbol"), "node")
    name = tokens(F.expr("substr(symbol, instr(symbol, '#') + 1)"))
    stem = tokens(F.regexp_extract("symbol", r"([^/\\#]*?)(\.[^./\\#]*)?#", 1))
    words = best.select("query", F.explode(F.concat(F.transform(name, lambda w: F.struct(w.alias("word"), F.lit(2).alias("n"))), F.transform(stem, lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"))))).alias("x"))
    counts = words.groupBy("query", "x.word").agg(F.sum("x.n").alias("n")).filter(F.length("word") > 2)
    told = counts.join(asked.withColumnRenamed("term", "word"), ["query", "word"], "left_anti").join(vocabulary.withColumnRenamed("term", "word"), "word")
    scored = told.withColumn("weight", F.round(F.col("n") / F.sqrt("df"), 6))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("query", "word", "weight", "rank")


def mention_counts(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, mentions, files): how often each name (name) is written as a whole identifier over all texts (file, text)."""
    words = files.select("file", F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("name")).filter(F.length("name") > 2)
    wanted = words.join(names.select("name").distinct(), "name", "left_semi")
    return wanted.groupBy("file", "name").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("mentions"), F.count("*").alias("files"))


def named_elsewhere(files: DataFrame, defs: DataFrame) -> DataFrame:
    """(name, file): files other than its home whose text writes a name that is defined exactly once (defs: name, file)."""
    once = defs.groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("home")).filter((F.col("n") == 1) & (F.length("name") > 2)).select("name", "home")
    words = files.select("file", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_]+"))).alias("name"))
    return words.join(once, "name").filter("file <> home").select("name", "file")
