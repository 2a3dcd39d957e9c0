"""From names to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewood.operators.unused import is_test_path
from tracewood.session import Workspace, running


def mint(defs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(node, file, name, symbol): one id per file and name, in order of file and first ordinal; ids are dense.

    ``defs``: file, name, ordinal. Ids count up within ranges of files of like size, so neither a common path prefix nor the
    whole table ends up in one task.
    """
    work = work or Workspace(defs.sparkSession, "mint")
    one = defs.filter("file is not null and name is not null").groupBy("file", "name").agg(F.min("ordinal").alias("ordinal"))
    starts = running(one.groupBy("file").agg(F.count("*").alias("n")), [F.col("file")], "n", work).select("file", F.col("before").alias("start"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("ordinal", "name"))
    return one.join(starts, "file").select((F.col("start") + rank - 1).alias("node"), "file", "name", F.concat("file", F.lit("#"), "name").alias("symbol"))


def bind_same_file(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """calls (file, caller, callee, has_receiver) with ``target``: the definition of that name in the same file, for calls
    without receiver; else null."""
    own = defs.select("file", F.col("name").alias("callee"), F.col("node").alias("target"), "receiver_only")
    met = calls.join(own, ["file", "callee"], "left")
    return met.withColumn("target", F.when(~F.col("has_receiver") & ~F.coalesce("receiver_only", F.lit(False)), F.col("target"))).drop("receiver_only")


def link_unique(placeholders: DataFrame, defs: DataFrame) -> DataFrame:
    """(name, target): placeholders (name) whose bare name exactly one definition (name, node) has. With ``file`` definitions in
    tests don't count, as tests define names that shadow those of the code."""
    if "file" in defs.columns:
        defs = defs.filter(~F.coalesce(is_test_path(F.col("file")), F.lit(False)))
    return placeholders.join(_candidates(defs), "name").filter("candidates = 1").select("name", "target")


def ambiguous(placeholders: DataFrame, defs: DataFrame) -> DataFrame:
    return placeholders.join(_candidates(defs), "name").filter("candidates > 1").select("name", "candidates")


def _candidates(defs: DataFrame) -> DataFrame:
    return defs.select("name", "node").distinct().groupBy("name").agg(F.count("*").alias("candidates"), F.min("node").alias("target"))


def inherited(classes: DataFrame, members: DataFrame, depth: int = 64) -> DataFrame:
    """(node, member, owner, distance): nearest definition of each member along the chain of parents.

    ``classes``: node, path (root first, from ``hierarchy``); ``members``: node, member. A class's own definition stops the chain.
    """
    chain = classes.filter("depth >= 0").select("node", F.posexplode(F.slice(F.reverse("path"), 1, depth)).alias("distance", "owner"))
    met = chain.join(members.select(F.col("node").alias("owner"), "member"), "owner")
    return met.groupBy("node", "member").agg(F.min(F.struct("distance", "owner")).alias("near")).select("node", "member", F.col("near.owner").alias("owner"), F.col("near.distance").alias("distance"))


def inherited_over(bases: DataFrame, members: DataFrame, depth: int = 64, work: Workspace | None = None) -> DataFrame:
    """(node, member, owner, distance, known): nearest definition of each member along all bases of a class, level by level; of
    two as near the one whose way is written first. ``known`` is false if a base on the nearer levels names no class, so a
    nearer definition may lie outside.

    ``bases``: node, pos, base (null for a name that is no class); ``members``: node, member. Circles end where they began.
    """
    work = work or Workspace(bases.sparkSession, "inherited")
    links = work.cut(bases.select("node", "pos", "base").distinct())
    owners = links.select(F.col("node").alias("o"), "pos", "base")
    every = links.select("node").unionByName(links.filter("base is not null").select(F.col("base").alias("node"))).unionByName(members.select("node")).distinct()
    level = work.cut(every.select("node", F.col("node").alias("owner"), F.lit(0).alias("distance"), F.array().cast("array<int>").alias("way")))
    seen, gaps = level, None
    for distance in range(1, depth + 1):
        step = level.join(owners, level["owner"] == owners["o"]).select("node", F.col("base").alias("owner"), F.concat("way", F.array(F.col("pos").cast("int"))).alias("way"))
        loose = step.filter("owner is null").select("node", F.lit(distance).alias("gap"))
        gaps = loose if gaps is None else gaps.unionByName(loose)
        fresh = step.filter("owner is not null").groupBy("node", "owner").agg(F.min("way").alias("way"))
        level = work.cut(fresh.join(seen.select("node", "owner"), ["node", "owner"], "left_anti").select("node", "owner", F.lit(distance).alias("distance"), "way"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    near = seen.join(members.select(F.col("node").alias("owner"), "member"), "owner").groupBy("node", "member").agg(F.min(F.struct("distance", "way", "owner")).alias("near"))
    first_gap = gaps.groupBy("node").agg(F.min("gap").alias("gap"))
    known = F.coalesce(F.col("gap") > F.col("near.distance"), F.lit(True))
    return near.join(first_gap, "node", "left").select("node", "member", F.col("near.owner").alias("owner"), F.col("near.distance").alias("distance"), known.alias("known"))


def mentions(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc, node): backticked words of documents (doc, text) that name a symbol (node, symbol, name) in full, or by a tail
    that only one symbol has. Nothing is minted; repeated mentions count once."""
    words = docs.select("doc", F.explode(F.expr(r"regexp_extract_all(text, '`([^`\n]{3,})`', 1)")).alias("word")).select("doc", F.regexp_replace("word", r"\(.*$", "").alias("word")).distinct()
    full = words.join(symbols.select(F.col("symbol").alias("word"), "node"), "word").select("doc", "node")
    tails = symbols.groupBy(F.col("name").alias("word")).agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other").select("word", "node")
    return full.union(words.join(tails, "word").select("doc", "node")).distinct()


def uses_by_name(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(source, target): names used (node, name) that exactly one definition (node, name, file) outside documents has."""
    unique = defs.filter(~F.lower("file").rlike(r"\.(md|markdown)$")).groupBy("name").agg(F.min("node").alias("target"), F.count_distinct("node").alias("n")).filter("n = 1").select("name", "target")
    return uses.join(unique, "name").filter("node <> target").select(F.col("node").alias("source"), "target").distinct()


def segments(path):
    """Parts of a route: lower case, parameters of any spelling as '*'."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^(\{.*\}|:.+|<.+>|\*)$"), "*").otherwise(p))


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(sender, handler, literals): requests (sender, verb, path) meet the most literal routes (handler, verb, path) of equal
    length whose segments are equal or '*' in the route; verb 'ANY' meets all; nobody serves itself.

    The join runs on the number of segments and the first literal of the route, so routes of a length aren't all tried.
    """
    ask = requests.select("sender", F.upper("verb").alias("verb"), segments(F.col("path")).alias("ask"))
    serve = routes.select("handler", F.upper("verb").alias("offered"), segments(F.col("path")).alias("serve"))
    first = F.coalesce(F.try_element_at("ask", F.lit(1)), F.lit(""))
    ask = ask.withColumn("size", F.size("ask")).withColumn("key", F.explode(F.array_distinct(F.array(first, F.lit("*")))))
    serve = serve.withColumn("size", F.size("serve")).withColumn("key", F.coalesce(F.try_element_at("serve", F.lit(1)), F.lit("")))
    agree = F.forall(F.zip_with("ask", "serve", lambda a, s: (a == s) | (s == "*")), lambda x: x)
    met = ask.join(serve, ["size", "key"]).filter(agree & ((F.col("verb") == F.col("offered")) | (F.col("verb") == "ANY") | (F.col("offered") == "ANY")) & (F.col("sender") != F.col("handler")))
    met = met.withColumn("literals", F.size(F.filter("serve", lambda s: s != "*")))
    best = F.rank().over(Window.partitionBy("sender", "verb", "ask").orderBy(F.desc("literals")))
    return met.withColumn("best", best).filter("best = 1").select("sender", "handler", "literals").distinct()


def handlers(routes: DataFrame, defs: DataFrame) -> DataFrame:
    """routes (file, handler, verb, path) with ``node``: the definition (node, file, name) a handler means, or null.

    A handler written ``file#name`` means that one. A bare name means the tree's only definition of it, else the only one that
    lies in a file which declares routes itself, as a client often shares the name its server carries.
    """
    asked = routes.select("handler").filter("handler is not null").distinct()
    exact = defs.groupBy(F.concat_ws("#", "file", "name").alias("handler")).agg(F.min("node").alias("exact"))
    serving = routes.select("file").distinct().withColumn("serves", F.lit(True))
    by = defs.join(serving, "file", "left").groupBy(F.col("name").alias("handler")).agg(
        F.count_distinct("node").alias("n"), F.min("node").alias("one"), F.count_distinct(F.when(F.col("serves"), F.col("node"))).alias("m"), F.min(F.when(F.col("serves"), F.col("node"))).alias("served")
    )
    bare = F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("served"))
    known = asked.join(exact, "handler", "left").join(by, "handler", "left").select("handler", F.when(F.col("handler").contains("#"), F.col("exact")).otherwise(bare).alias("node"))
    return routes.join(known, "handler", "left").select("file", "handler", "verb", "path", "node")


def contracts(imports: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (repo, package, version, contract) joined to the first export (repo, package, version, contract, ord) with the
    same package, exact version and contract; and those without one."""
    first = exports.groupBy("package", "version", "contract").agg(F.min(F.struct("ord", "repo")).alias("first")).select("package", "version", "contract", F.col("first.repo").alias("provider"))
    keys = ["package", "version", "contract"]
    return imports.join(first, keys).select("repo", *keys, "provider"), imports.join(first, keys, "left_anti").select("repo", *keys)

# Languages whose definitions can be called from one another.
FAMILIES = {"java": "jvm", "kotlin": "jvm", "scala": "jvm", "groovy": "jvm", "javascript": "js", "typescript": "js", "c": "c", "cpp": "c", "objc": "c"}


def family(language):
    out = language
    for name, group in FAMILIES.items():
        out = F.when(language == name, group).otherwise(out)
    return out


def cascade(calls: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, caller, callee, target, how, confidence) of every call (file, caller, callee, has_receiver, lang).

    The first that gives exactly one definition (node, file, name, lang) wins: the same file (no receiver), an import
    (file, name, target) whose module ends like the definition's path, the only definition of that name in the language's
    family. Calls on a receiver of unknown type are ambiguous, the rest inferred; unresolved calls keep a null target.
    """
    one = calls.groupBy("file", "caller", "callee", "has_receiver", "lang").agg(F.count("*").alias("uses")).withColumn("call", F.xxhash64("file", "caller", "callee", "has_receiver", "lang"))
    places = defs.select("node", "name", "lang", F.col("file").alias("def_file"))
    local = one.filter(~F.col("has_receiver")).join(places.select(F.col("name").alias("callee"), F.col("def_file").alias("file"), "node"), ["file", "callee"]).groupBy("call").agg(F.min("node").alias("target"), F.count_distinct("node").alias("n")).filter("n = 1").select("call", "target", F.lit("file").alias("how"), F.lit(0).alias("step"))
    # the last part of the module must be the definition's file stem or directory, so the join has a narrow key
    module = F.regexp_replace(F.regexp_replace("target", r"#.*$", ""), r"^[./\\]+", "")
    told = imports.select("file", F.col("name").alias("callee"), F.regexp_extract("target", r"([^.#/\\:]+)$", 1).alias("symbol"), F.filter(F.split(module, r"[./\\:]+"), lambda p: p != "").alias("parts"))
    keyed = told.select("file", "callee", "symbol", F.explode(F.array_distinct(F.slice(F.reverse("parts"), 1, 2))).alias("key"))
    stems = places.select(F.col("name").alias("symbol"), "node", F.explode(F.array_distinct(F.array(F.regexp_extract("def_file", r"([^/\\.]+)\.[^/\\]*$", 1), F.regexp_extract("def_file", r"([^/\\]+)[/\\][^/\\]*$", 1)))).alias("key")).filter("key <> ''")
    brought = one.join(keyed, ["file", "callee"]).join(stems, ["symbol", "key"]).groupBy("call").agg(F.min("node").alias("target"), F.count_distinct("node").alias("n")).filter("n = 1").select("call", "target", F.lit("import").alias("how"), F.lit(1).alias("step"))
    alone = places.groupBy("name", family(F.col("lang")).alias("family")).agg(F.min("node").alias("target"), F.count_distinct("node").alias("n")).filter("n = 1")
    named = one.withColumn("family", family(F.col("lang"))).join(alone.select(F.col("name").alias("callee"), "family", "target"), ["callee", "family"]).select("call", "target", F.lit("name").alias("how"), F.lit(2).alias("step"))
    first = local.unionByName(brought).unionByName(named).groupBy("call").agg(F.min(F.struct("step", "target", "how")).alias("best")).select("call", "best.target", "best.how")
    sure = F.when(F.col("target").isNull() | F.col("has_receiver") | (F.col("how") == "name"), 0).otherwise(1)
    return one.join(first, "call", "left").select("file", "caller", "callee", "has_receiver", "uses", "target", "how", sure.alias("confidence"))


def untraced(calls: DataFrame, home: str, top: int = 10) -> DataFrame:
    """Calls (file, caller, callee) without a target, nearest to a file by the length of their common directory path."""
    parts = [p for p in home.replace("\\", "/").split("/")[:-1]]
    mine = F.array(*[F.lit(p) for p in parts]) if parts else F.array().cast("array<string>")
    theirs = F.slice(F.split("file", r"[/\\]"), 1, F.greatest(F.size(F.split("file", r"[/\\]")) - 1, F.lit(0)))
    common = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(parts))), lambda k: (k > 0) & (F.size(theirs) >= k) & (F.slice(theirs, F.lit(1), k) == F.slice(mine, F.lit(1), k))))
    return calls.filter("target is null").withColumn("common", common).orderBy(F.desc("common"), "file", "caller", "callee").limit(top).select("file", "caller", "callee", "common")


def file_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, caller, target): jobs of a workflow (file, job, path) and the files (file) they run, once each."""
    return refs.select("file", F.col("job").alias("caller"), F.col("path").alias("target")).join(files.select(F.col("file").alias("target")), "target").select("file", "caller", "target").distinct()
