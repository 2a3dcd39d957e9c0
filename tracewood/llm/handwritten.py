"""Files that nobody wrote by hand in their repo: generated, minified or vendored ones and data stored as code.

Merkle hashes go bottom-up over every repo's directory tree, level by level, each level written before the next: a file's is
that of its text, a directory's an order-free hash of its entries' names and hashes, an algebraic aggregate that is combined
before the shuffle. What unrelated repos share in these trees marks third-party code: subtrees with equal hashes are copies, and
a directory that unrelated repos keep under one name at a vendoring place is a project, whose files there, and files elsewhere
whose header names it with a version or a licence, are copies as well. Header and layout rules find tool output, squeezed
scripts and data. All rules run where the text is read; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewood.functions.text import latest
from tracewood.session import Workspace

SHARED_LINES = 10  # distinct lines of a shared text or subtree; two people may write less alike by chance
NAMED_LINES = 3  # the same for a file that is shared under the same name
# Names of directories and files by which tools and projects mark such files.
VENDOR_DIRS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "extern", "externals", "external", "deps", "godeps", "node_modules", "bower_components", "jspm_packages", "site-packages", "pods", "carthage")
GENERATED_DIRS = ("_generated", "__generated__", "generated", "generated-sources", "generated-src", "generated_sources", "bindings_gen", "autogen", "__pycache__")
GENERATED_NAME = r"(?i)(_pb2(_grpc)?\.pyi?|[._]pb\.(go|js|rb|ts|cc|h|c|swift|dart)|[._]pb\.gw\.go|\.g\.(ts|dart|cs|js)|\.generated\.\w+|\.designer\.cs|\.tab\.[ch]|\.yy\.[ch])$|^(zz_generated[_.]|lex\.[^/]*\.c$|moc_[^/]*\.cpp$)"
MINIFIED_NAME = r"(?i)([.\-]min\.(js|mjs|cjs|ts|css)|\.bundle\.js|\.chunk\.js|\.[0-9a-f]{8,}\.(js|mjs|ts|css))$"
# A header says in some sentence that a tool made the whole file: who or what made it follows, or the sentence's subject is the
# file. Sentences that deny it don't count, nor do those that speak of a stub or method only.
_MADE = r"(?:auto[- ]?|automatically[- ]|machine[- ])?generated|auto[- ]?produced|machine[- ](?:made|written)|emitted"
DENIED = r"(?iU)\b(?:nothing|not|no|none|never|isn't|nichts|nicht|kein\w*|rien|aucune?|jamais|nada|ning[uú]n\w*|nunca)\b[^.;:!?\n]*(?:generat|produc|erzeugt|generiert|g[ée]n[ée]r|produit)\w*"
_ON = r"(?:[^.;\n]|[.](?=\w))*"  # on within the sentence
GENERATED_LINE = (
    rf"(?iU)@generated\b|<auto-?generated|\bgenerated\s*[:=]\s*(?:true|yes)\b"
    rf"|\b(?:{_MADE})(?: automatically)? (?:by|from|with|using)\b"
    rf"|\b(?:{_MADE}) (?:file|code|source|module|content)s?\b"
    rf"|\b(?:file|code|source|module)s?\b{_ON}\b(?:{_MADE}|produced) (?:by|from|with|using)\b"
    rf"|\b(?:file|code|source|module)\b{_ON}\b(?:created|written) by {_ON}(?:compiler|generator|tool|script)\b"
    rf"|^\W*(?:{_MADE})\W*$"
    rf"|\b(?:datei|quelltext|code)\b{_ON}\b(?:wird|wurde|ist)\b{_ON}\b(?:erzeugt|generiert)|\bautomatisch (?:erzeugt|generiert)"
    rf"|\b(?:fichier|code)\b{_ON}\b(?:g[ée]n[ée]r[ée]|produit)e?\b{_ON}\b(?:par|partir)\b|\bg[ée]n[ée]r[ée]e? automatiquement\b"
    rf"|\b(?:archivo|fichero|c[óo]digo)\b{_ON}\b(?:generado|producido)\b{_ON}\b(?:por|partir)\b|\bgenerado autom[áa]ticamente\b"
)
HINT = r"(?i)generat|machine|emitted|produ|created|written|erzeugt|generiert|g[ée]n[ée]r"  # only such a line can be one of the above
# A header says that the file is a copy: a word for copying, and of what.
COPIED_LINE = (
    r"(?iU)^.*(?:\bvendored\b|\bbundled (?:copy|version)\b|\b(?:verbatim|unmodified|unchanged) copy\b|\bcopied (?:\w+ )?from\b|\b(?:fix|report|send) [\w ]*\bupstream\b"
    r"|\bunver[äa]ndert\w*|\bkopie (?:von|aus|der|des)\b|\bcopie (?:\w+ )?d[eu']|\bsans modifications?\b|\bcopia (?:\w+ )?del?\b|\bsin cambios\b)"
)
COPYRIGHT = r"(?imU)^.*(?:copyright|\(c\)|©)\W+(?:\d{4}(?:-\d{4})?,? )?(?:by )?(?:the )?([\w.-]+) (?:project|authors|contributors|developers)\b"
# A line that could name the project a file comes from: it holds a version, a year or a licence.
CLAIM = r"(?iU)\d+\.\d+|@\d|\b(?:19|20)\d\d\b|\(c\)|©|\blicen[cs]ed?\b"
FIRST_CODE = r"(?md)^(?![ \t]*(?:#(?!\s*(?:include|define|if|ifdef|ifndef|pragma)\b)|//|/\*|\*|--|<!--|;;|\r?$))"


def clean_parts(path: Column) -> Column:
    """Parts of a path without empty ones and '.'."""
    return F.filter(F.split(path, r"[/\\]"), lambda p: (p != "") & (p != "."))


def header(text: Column) -> Column:
    """Comment lines and blank lines before the first line of code, and the first block comment if it comes first."""
    code = F.regexp_instr(text, F.lit(FIRST_CODE))
    lines = F.when(code > 0, F.substring(text, F.lit(1), code - 1)).otherwise(text)
    return F.concat_ws("\n", lines, F.regexp_extract(text, r"^\s*/\*[\s\S]*?\*/", 0))


def footer(lines: Column) -> Column:
    """Comment lines among the last five of the given non-blank lines, if the last of all is one; some tools sign at the end."""
    is_comment = lambda s: s.rlike(r"^\s*(#(?!\s*(?:endif|if|define|include)\b)|//|/\*|\*|--|<!--)")
    tail = F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5))
    return F.when(is_comment(F.try_element_at(lines, F.lit(-1))), F.array_join(F.filter(tail, is_comment), "\n")).otherwise("")


def with_evidence(files: DataFrame) -> DataFrame:
    """``files`` (repo, parts, text) with ``lines`` (without blank ones and white space at the end), ``rule`` (that path and text
    fall under, or null) and ``words`` (of header lines that could name a project). Each step is computed once."""
    rows = files.withColumn("lines", F.filter(F.transform(F.split("text", "\n"), lambda s: F.rtrim(s, F.lit(" \t\r"))), lambda s: s != ""))
    rows = rows.withColumn("said", F.filter(F.split(F.concat_ws("\n", header(F.col("text")), footer(F.col("lines"))), r"\r?\n"), lambda s: F.length(s) > 3))
    own = F.lower(F.coalesce("repo", F.lit("")))
    rows = rows.withColumn("claims", F.filter("said", lambda s: s.rlike(CLAIM)))
    folders = F.transform(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: F.lower(p))
    name = F.try_element_at("parts", F.lit(-1))
    owners = F.filter(F.transform("claims", lambda s: F.lower(F.regexp_extract(s, COPYRIGHT, 1))), lambda o: (o != "") & (o != own))
    words = F.filter(F.array_distinct(F.split(F.lower(F.array_join("claims", " ")), r"[^\p{L}\p{N}_.-]+|[.](?:\s|$)")), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}") & (w != own))
    shapes = F.array_distinct(F.transform("lines", lambda s: F.translate(s, "0123456789", "")))
    long_text = F.array_join(F.filter("lines", lambda s: F.length(s) > 400), "\n")
    size = F.greatest(F.length("text"), F.lit(1))
    solid = F.length(F.translate(long_text, " \t\n", "")) / F.greatest(F.length(long_text), F.lit(1))
    values = F.regexp_replace("text", r"""(["'])[0-9A-Za-z+/=_-]{24,}\1|\b0[xX][0-9a-fA-F]+\b|-?\b\d[\d_]*(?:\.\d+)?\b|[,\s]""", "")
    rule = (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_DIRS))), "vendored: directory")
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_DIRS))), "generated: directory")
        .when(name.rlike(GENERATED_NAME), "generated: name")
        .when(name.rlike(MINIFIED_NAME), "minified: name")
        .when(F.exists("said", lambda s: s.rlike(HINT) & F.regexp_replace(s, DENIED, " ").rlike(GENERATED_LINE)), "generated: header")
        .when(F.exists("said", lambda s: s.rlike(COPIED_LINE)) | (F.size(owners) > 0), "vendored: header")
        .when((F.length(long_text) * 2 > size) & (solid > 0.92), "minified: layout")
        .when((size >= 200) & (F.length(values) * 4 < size), "data: layout")
        .when((F.size("lines") >= 20) & (F.size(shapes) * 6 < F.size("lines")), "generated: layout")
    )
    return rows.withColumn("rule", rule).withColumn("words", F.when(F.size("claims") > 0, words)).drop("said", "claims")


def forks(files: DataFrame, work: Workspace) -> DataFrame:
    """(repo, origin) of every fork or mirror: a repo more than half of whose files one and the same other repo has with the
    same text at the same path. Of two such repos the one with more files (of equals the lesser name) is the origin, and a
    fork's fork has the first one's; together they are one witness of what they share with others.

    ``files``: repo, path, h, g. Files in the same set of repos are counted together before repos are paired.
    """
    held = files.distinct()
    total = held.groupBy("repo").agg(F.count("*").alias("files"))
    sets = held.groupBy("path", "h", "g").agg(F.count("*").alias("repos"), F.bit_xor(F.xxhash64("repo")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "repo")).alias("t")).filter("repos > 1")
    common = work.cut(held.join(sets, ["path", "h", "g"]).groupBy("repo", "s", "t").agg(F.count("*").alias("n")))
    most = common.groupBy("repo").agg(F.sum("n").alias("common")).join(total, "repo").filter(F.col("common") * 2 > F.col("files")).select("repo")
    near = common.join(most, "repo").join(common.select(F.col("repo").alias("other"), "s", "t"), ["s", "t"]).filter("repo <> other").groupBy("repo", "other").agg(F.sum("n").alias("common"))
    pairs = near.join(total, "repo").join(total.select(F.col("repo").alias("other"), F.col("files").alias("other_files")), "other").filter(F.col("common") * 2 > F.col("files"))
    larger = pairs.filter((F.col("other_files") > F.col("files")) | ((F.col("other_files") == F.col("files")) & (F.col("other") < F.col("repo"))))
    parents = work.cut(larger.groupBy("repo").agg(F.max_by("other", F.struct("common", "other_files", "other")).alias("origin")))
    while True:  # origins are larger than their forks, so every chain ends; its length halves each time
        up = parents.select(F.col("repo").alias("origin"), F.col("origin").alias("next"))
        if parents.join(up, "origin").isEmpty():
            return parents
        parents = work.cut(parents.join(up, "origin", "left").select("repo", F.coalesce("next", "origin").alias("origin")))


def merkle_nodes(files: DataFrame, work: Workspace) -> DataFrame:
    """repo, depth, path, parent, name, h, g, n, lines, vendored of every file and directory, bottom-up.

    ``files``: file_id, repo, parts, h, g, lines, vendored (whether a path rule names the place). Each level reads the files of
    its depth and the directories written before, so a path of any depth adds one small step and no plan grows with it.
    """
    path = F.array_join("parts", "/")
    leaf = files.select("repo", F.size("parts").alias("depth"), path.alias("path"), F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("parent"), F.try_element_at("parts", F.lit(-1)).alias("name"), "h", "g", F.lit(1).cast("long").alias("n"), "lines", F.col("vendored").cast("int").alias("vendored"))
    leaf = work.cut(leaf, by="depth")
    order = ["repo", "depth", "path", "parent", "name", "h", "g", "n", "lines", "vendored"]
    nodes, below = [leaf.select(order)], None
    for depth in range(leaf.agg(F.max("depth")).first()[0] or 0, 1, -1):
        here = leaf.filter(F.col("depth") == depth).select(order)
        here = here if below is None else here.unionByName(below)
        up = here.groupBy("repo", "parent").agg(
            F.bit_xor(F.xxhash64("name", "h", "g")).alias("h"), F.bit_xor(F.xxhash64(F.lit(7), "g", "h", "name")).alias("g"), F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.max("vendored").alias("vendored")
        )
        below = work.cut(up.select("repo", F.lit(depth - 1).alias("depth"), F.col("parent").alias("path"), F.regexp_replace("parent", r"/?[^/]*$", "").alias("parent"), F.regexp_extract("parent", r"[^/]*$", 0).alias("name"), "h", "g", "n", "lines", "vendored"))
        nodes.append(below)
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x)
    return out


def shared_copies(files: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(repo, path) of subtrees that unrelated repos share, one home of each left out; and (project) names that unrelated repos
    give to a directory at a vendoring place or to a shared directory.

    A file counts with ``SHARED_LINES`` distinct lines, or with ``NAMED_LINES`` under the same name; a directory's lines are those
    of its files. ``files`` as for merkle_nodes.
    """
    nodes = merkle_nodes(files, work)
    vendors = F.array(*map(F.lit, VENDOR_DIRS))
    alike = F.when(F.col("lines") < SHARED_LINES, F.col("name")).otherwise("")
    held = nodes.filter((F.col("lines") >= SHARED_LINES) | ((F.col("lines") >= NAMED_LINES) & (F.col("n") == 1))).withColumn("alike", alike)
    classes = held.groupBy("h", "g", "alike").agg(F.min("repo").alias("first"), F.max("repo").alias("last")).filter("first <> last").select("h", "g", "alike")
    members = work.cut(held.join(classes, ["h", "g", "alike"]).select("repo", "path", "name", "depth", "n", "vendored", "h", "g", "alike"))
    places = work.cut(nodes.filter(F.array_contains(vendors, F.lower(F.regexp_extract("parent", r"[^/]*$", 0)))).select("repo", F.lower("name").alias("project"), "path"))
    kin = forks(files.select("repo", F.array_join("parts", "/").alias("path"), "h", "g"), work)
    told = members.join(kin, "repo", "left").withColumn("fork", F.col("origin").isNotNull()).withColumn("origin", F.coalesce("origin", "repo"))
    witnesses = told.groupBy("h", "g", "alike").agg(F.min("origin").alias("first"), F.max("origin").alias("last"), F.min(F.struct("vendored", "depth", "fork", "repo", "path")).alias("home")).filter("first <> last")
    copies = work.cut(members.join(witnesses.select("h", "g", "alike", "home"), ["h", "g", "alike"]).filter((F.col("repo") != F.col("home.repo")) | (F.col("path") != F.col("home.path"))).select("repo", "path", F.when(F.col("n") > 1, F.lower("name")).alias("project")).distinct())
    named = places.select("repo", "project").unionByName(copies.filter("project is not null").select("repo", "project")).distinct()
    names = named.join(kin, "repo", "left").withColumn("origin", F.coalesce("origin", "repo")).groupBy("project").agg(F.min("origin").alias("first"), F.max("origin").alias("last")).filter("first <> last").select("project")
    projects = work.cut(names.filter(F.length("project") > 2))
    found = copies.select("repo", "path", F.lit("vendored: shared subtree").alias("why")).unionByName(places.join(projects, "project").select("repo", "path", F.lit("vendored: shared project").alias("why")))
    return found.groupBy("repo", "path").agg(F.max("why").alias("why")), projects


def not_handwritten(files: DataFrame, work: Workspace | None = None) -> DataFrame:
    """file_id and reason of every file whose present state nobody wrote by hand in its repo.

    What unrelated repos share comes first, then the header and layout rules. Path rules hold for null and empty texts too; such
    texts have no layout and take no part in shared subtrees. Rows without file_id are left out, a null path has no parts, a null
    repo shares nothing, repeated rows count once, and no rows give no rows.
    """
    work = work or Workspace(files.sparkSession, "handwritten")
    parts = F.coalesce(clean_parts(F.col("relative_path")), F.array().cast("array<string>"))
    chosen = files.filter("file_id is not null").select("file_id", "repo", "indexed_at", parts.alias("parts"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = F.size(F.array_distinct("lines")).cast("long")
    marked = with_evidence(chosen).select("file_id", "repo", "indexed_at", "parts", F.col("rule").alias("reason"), "words", F.xxhash64("lines").alias("h"), F.xxhash64(F.lit(11), "lines").alias("g"), distinct.alias("lines"))
    now = work.cut(latest(marked, "file_id", "indexed_at").drop("indexed_at"))
    known = now.filter("lines > 0 and repo is not null and size(parts) > 0").withColumn("vendored", F.coalesce(F.col("reason").startswith("vendored"), F.lit(False)))
    copies, projects = shared_copies(known, work)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice(F.col("parts"), F.lit(1), k), "/"))
    below = now.filter("repo is not null and size(parts) > 0").select("file_id", "repo", F.explode(prefixes).alias("path")).join(copies, ["repo", "path"]).select("file_id", "why")
    naming = now.filter("words is not null").select("file_id", F.explode("words").alias("project")).join(projects, "project").select("file_id", F.lit("vendored: names a shared project").alias("why"))
    shared = below.unionByName(naming).groupBy("file_id").agg(F.max("why").alias("why"))
    return now.join(shared, "file_id", "left").select("file_id", F.coalesce("why", "reason").alias("reason")).filter("reason is not null")
