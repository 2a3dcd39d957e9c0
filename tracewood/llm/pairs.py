"""Functions paired with their documentation.

A light lexer turns every file into token rows: heads of functions, what opens and closes blocks, and lines of comments and
decorators. SQL does the rest over these rows: a cumulative sum of the block changes gives each token's depth, and the first
closing token behind a head that falls back to the head's depth ends the function; runs of adjoining comment lines are islands
(line number less rank); ``lag`` attaches the island directly above a head. A node of the registry is a function if its span
begins at a head and ends where that head's function does. Texts are lexed where they are read; only such rows are shuffled.

Two kinds of blocks are told apart by the head (``scheme``): braces, and indented lines below ``def``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewood.functions.text import latest

OPEN, CLOSE, STOP, COMMENT, DECORATOR, HEAD, NOTHING = range(7)
BRACES, INDENTS = 0, 1
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|do|try|new|throw|await|typeof|sizeof|synchronized|using|lock|foreach|elif|with|unless|until|when|super|this|void|func|function|fn|def|class)\b)"
_DEF_HEAD = r"(?:async[ \t]+)?def[ \t]+(?P<def>(?:self\.)?[\w.]+[?!=]?|[^\s\w(]+)"
_BRACE_HEAD = (
    r"(?:@\w[\w.]*(?:\([^()\n]*\))?[ \t]+)*(?:"
    r"func[ \t]*(?:\([^()\n]*\)[ \t]*)?(?P<go>\w+)[ \t]*(?=[\[(])"
    r"|(?:pub(?:\([^()\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern)[ \t]+(?:\"[^\"\n]*\"[ \t]+)?)*fn[ \t]+(?P<rust>\w+)"
    r"|(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<js>[\w$]*)[ \t]*(?=[<(])"
    r"|(?:local[ \t]+)?function[ \t]+(?P<lua>[\w.:]+)[ \t]*(?=\()"
    r"|(?:[a-z]+[ \t]+)*fun[ \t]+(?:<[^<>\n]*>[ \t]*)?(?P<kt>[\w.]+)[ \t]*(?=\()"
    r"|(?:(?:export|const|let|var|public|private|protected|static|readonly|local)[ \t]+)*(?P<arrow>[\w$.]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:function\b|(?:<[^<>\n]*>[ \t]*)?\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)[ \t]*(?::[^=\n]+)?=>|[\w$]+[ \t]*=>)"
    r"|(?:(?!return\b|new\b|throw\b|else\b|await\b|class\b|struct\b|interface\b|enum\b|case\b|goto\b|typedef\b)[\w$<>\[\],.?&*:]+[ \t]+)*[*&]*" + _NOT_NAMES + r"(?P<method>[\w$#~]+)[ \t]*(?:<[^<>\n]*>)?\((?P<params>[^(){};]*(?:\([^()]*\)[^(){};]*)*)\)\s*(?:(?::|->)[^{};=\n]+|throws\s+[\w.,\s]+?|const\b|noexcept\b|override\b)?\s*(?=\{)"
    r")"
)
_HEAD = re.compile(rf"[ \t]*(?P<at>(?:{_DEF_HEAD})|{_BRACE_HEAD})")
_FIRST_WORDS = ("{", "=>", "def ", "def\t", "fn ", "fun ", "func", "function")
_BORDER = re.compile(r"[{};](?=[ \t]*[^\s{};])")
_NAMES = ("def", "go", "rust", "js", "lua", "kt", "arrow", "method")
_DEF_FILE = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w", re.M)
_RUST_FILE = re.compile(r"\bfn[ \t]+\w+")
_TICK = {False: r"'(?:[^'\\\n]|\\[^\n])+?'", True: r"'(?:[^'\\\n]|\\[^\n']+|\\')'"}  # Rust has lifetimes beside characters
_BRACED = {rust: re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|" + tick + r"|[{}]") for rust, tick in _TICK.items()}
_QUOTED = re.compile(r"(?:[rbuRBU]{0,2})(\"\"\"|''')[\s\S]*?(?:\1|\Z)|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_LINE = re.compile(r"^[ \t]*(?:(?P<c>///?!?|//|#(?!\[|!)|--)|(?P<d>@\w|#!?\[))", re.M)
_PREPROCESSOR = re.compile(r"[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|endif|pragma|undef|else|elif|error|line|warning)\b")
_INDENT = re.compile(r"^([ \t]*)(?=[^\s#])", re.M)
_BLANK = re.compile(r"[ \t]*")
_END = re.compile(r"[ \t]*end(?=[ \t]*(?:[#;)\r\n.]|\Z))")
_PARENS = re.compile(r"\((?>[^()]+|\((?>[^()]+|\((?>[^()]+|\([^()]*\))*\))*\))*\)")
_BODY = re.compile(r"[{};]")
_LOOSE = re.compile(r"[)\]]*[ \t]*[;,]?\s*")
_STATEMENT = re.compile(r"[^;\n]*(?:\n(?=[ \t]*[.?:+\-*/&|)\]])[^;\n]*)*;?")
_SIGNATURE = re.compile(r"#[^\n]*|(\"\"\"|''')(?:[^\\]|\\[\s\S])*?\1|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[()\[\]{}:\n]")
_FIRST_STRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*[rRuU]?(?:\"\"\"((?:[^\\]|\\[\s\S])*?)(?:\"\"\"|\Z)|'''((?:[^\\]|\\[\s\S])*?)(?:'''|\Z)|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")


def _def_signature(text: str, at: int) -> tuple[int, str | None]:
    """Where the signature of a ``def`` ends (behind its colon, or its parentheses where it has none), and the first string
    token of the body."""
    depth, end = 0, at
    for m in _SIGNATURE.finditer(text, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            end = m.end()
            if depth < 0:
                return end, None
        elif c == ":" and not depth:
            doc = _FIRST_STRING.match(text, m.end())
            return m.end(), next((g for g in doc.groups() if g is not None), None) if doc else None
        elif c == "\n" and not depth:
            return max(end, m.start()), None
    return max(end, at), None


def scan(text: str) -> list[tuple[int, int, int, int, int, int, int, str | None, str | None, str | None]]:
    """Token rows (seq, line, scheme, kind, change of depth, byte offset, loose end, comment text or signature, name, docstring).

    The byte offset is that of a head's or note's first character, and of the end of a closing token; white space and a
    separator behind that reach to its loose end.
    """
    starts = [0]
    find = text.find
    i = find("\n")
    while i >= 0:
        starts.append(i + 1)
        i = find("\n", i + 1)
    n, lines = len(text), len(starts)
    starts.append(n)

    def line_of(at: int) -> int:
        return min(bisect_right(starts, at) - 1, lines - 1)

    by_indent = _DEF_FILE.search(text) is not None
    covered: list[tuple[int, int]] = []  # strings and comments
    blocks: list[tuple[int, int]] = []
    braces: list[tuple[int, int]] = []
    hidden_lines: list[tuple[int, int]] = []
    for m in _BRACED[_RUST_FILE.search(text) is not None].finditer(text):
        first = text[m.start()]
        if first == "{" or first == "}":
            braces.append((m.start(), 1 if first == "{" else -1))
        elif first == "/" and text[m.start() + 1] == "*":
            blocks.append(m.span())
            covered.append(m.span())
        elif not by_indent:
            covered.append(m.span())
    if by_indent:
        covered = [m.span() for m in _QUOTED.finditer(text)]
        hidden_lines = [(a, b) for a, b in covered if b - a >= 6 and "\n" in text[a:b]]
        covered += blocks
        covered.sort()
    opens = [a for a, _ in covered]

    def is_covered(at: int) -> bool:
        k = bisect_right(opens, at) - 1
        return k >= 0 and covered[k][0] < at < covered[k][1]

    rows: list[tuple[int, int, int, int, int, int, int, str | None, str | None, str | None]] = []
    noted: set[int] = set()
    for a, b in blocks:
        line = line_of(a)
        if text[starts[line] : a].strip():
            continue
        last = line_of(max(a, b - 1))
        if text[b : starts[last + 1]].strip():
            continue
        for k in range(line, last + 1):
            if k not in noted:
                noted.add(k)
                at = _BLANK.match(text, starts[k]).end()
                rows.append((at, k, BRACES, COMMENT, 0, at, at, text[starts[k] : starts[k + 1]].strip(), None, None))
    for m in _LINE.finditer(text):
        at = m.start("c") if m["c"] else m.start("d")
        line = line_of(at)
        if line in noted or is_covered(m.start()) or is_covered(at):
            continue
        if m["d"]:
            noted.add(line)
            rows.append((at, line, BRACES, DECORATOR, 0, at, at, None, None, None))
        elif m["c"] != "#" or by_indent or not _PREPROCESSOR.match(text, m.start()):
            noted.add(line)
            rows.append((at, line, BRACES, COMMENT, 0, at, at, text[at : starts[line + 1]].strip(), None, None))
    schemes, skipped, skip_lines, short = set(), [], [], set()
    for m in _heads(text, starts, lines):
        at = m.start("at")
        if is_covered(at):
            continue
        line = line_of(at)
        name = next((m[g] for g in _NAMES if m[g] is not None), "")
        doc = None
        if m["def"] is not None:
            scheme = INDENTS
            end, doc = _def_signature(text, m.end())
            skip_lines.append((line + 1, line_of(end - 1)))
            short.add(line_of(end - 1))
        else:
            if line in noted and m["method"] is None and text[starts[line] : at].strip() == "":
                continue
            scheme = BRACES
            end = m.end()
            expression = text[end - 2 : end] == "=>"
            if m["method"] is None and not expression:
                params = _PARENS.match(text, max(find("(", end), end))
                end = params.end() if params else end
            if expression and text[_BLANK.match(text, end).end() :][:1] != "{":
                stop = _STATEMENT.match(text, end).end()
                skipped.append((end, stop))
                rows.append((stop, line_of(stop), BRACES, STOP, 0, stop, _LOOSE.match(text, stop).end(), None, None, None))
            else:
                body = _BODY.search(text, end)
                if body is None or body.group() != "{":  # a declaration
                    stop = body.start() + (body.group() == ";") if body else n
                    rows.append((stop, line_of(stop), BRACES, STOP, 0, stop, _LOOSE.match(text, stop).end(), None, None, None))
                else:
                    end = body.start()
                    skipped.append((at, end))
        schemes.add(scheme)
        rows.append((at, line, scheme, HEAD, 0, at, at, text[at:end], name, doc))
    if BRACES in schemes:
        inside = iter(sorted(skipped))
        a, b = next(inside, (n, n))
        for at, delta in braces:
            while at >= b and a < n:
                a, b = next(inside, (n, n))
            if a <= at < b:  # a brace of a signature
                continue
            behind = at + 1
            if delta > 0:
                rows.append((at, line_of(at), BRACES, OPEN, 1, at, at, None, None, None))
            else:
                on = text[_BLANK.match(text, behind).end() :][:1] == "{"  # a type's brace before a body's
                rows.append((at, line_of(at), BRACES, OPEN if on else CLOSE, -1, behind, _LOOSE.match(text, behind).end(), None, None, None))
    if INDENTS in schemes:
        rows += _indent_rows(text, starts, lines, hidden_lines, covered, skip_lines, short, line_of)
    rows.sort(key=lambda r: (r[0], r[3] == HEAD))
    rows = _folded(rows)
    if not text.isascii() and rows:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        place = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000))])
        return [(k, *r[1:5], int(place[r[5]]), int(place[r[6]]), *r[7:]) for k, r in enumerate(rows)]
    return [(k, *r[1:]) for k, r in enumerate(rows)]


def _heads(text: str, starts: list[int], lines: int) -> Iterator[re.Match]:
    """Heads at the beginning of lines and of statements, in order. Lines that can't begin one are passed over unread."""
    behind = 0
    match = _HEAD.match
    for k in range(lines):
        line = text[starts[k] : starts[k + 1]]
        if "(" not in line and "=>" not in line and "def" not in line and "fn" not in line:
            continue
        if not any(w in line for w in _FIRST_WORDS):
            last = line.rstrip()[-1:]
            if last in (";", ":", "") or (last not in "(," and text[starts[k + 1] : starts[k + 1] + 1 + len(line)].lstrip()[:1] != "{"):
                continue
        for at in (starts[k], *(m.end() for m in _BORDER.finditer(text, starts[k], starts[k + 1]))):
            if at >= behind:
                m = match(text, at)
                if m:
                    behind = m.end()
                    yield m


def _folded(rows: list[tuple]) -> list[tuple]:
    """The rows without opening tokens: each change of depth rides on the next row of its scheme."""
    out, waiting = [], [0, 0]
    for r in rows:
        if r[3] == OPEN:
            waiting[r[2]] += r[4]
        elif waiting[r[2]]:
            out.append((*r[:4], r[4] + waiting[r[2]], *r[5:]))
            waiting[r[2]] = 0
        else:
            out.append(r)
    return out


def _indent_rows(text, starts, lines, hidden, covered, skip_lines, short, line_of):
    """OPEN, CLOSE and STOP rows of indented blocks. A block ends with its last line of code, or with an ``end`` below it."""
    hidden_at = [a for a, _ in hidden]
    skip = {k for a, b in skip_lines for k in range(a, b + 1)}
    comment_at = {}
    for a, b in covered:
        if text[a] == "#":
            comment_at[line_of(a)] = a
    out, levels = [], [0]
    last_end, last_line = 0, -1
    for m in _INDENT.finditer(text):
        at = m.end()
        line = line_of(at)
        k = bisect_right(hidden_at, m.start()) - 1
        if line in skip or (k >= 0 and hidden[k][0] < m.start() < hidden[k][1]):
            last_line = line
            last_end = _code_end(text, starts, line, comment_at, hidden, hidden_at)
            continue
        width = len(m[1].expandtabs(8))
        closing = _END.match(text, m.start())
        if width <= levels[-1] and last_line in short:  # a function without indented lines
            out.append((last_end, last_line, INDENTS, STOP, 0, last_end, m.start(), None, None, None))
        while width < levels[-1]:
            levels.pop()
            if closing and width >= levels[-1]:
                end = closing.end()
                out.append((end, line, INDENTS, CLOSE, -1, end, _LOOSE.match(text, end).end(), None, None, None))
            else:
                out.append((last_end, last_line, INDENTS, CLOSE, -1, last_end, at, None, None, None))
        if width > levels[-1]:
            levels.append(width)
            out.append((m.start(), line, INDENTS, OPEN, 1, at, at, None, None, None))
        last_line = line
        last_end = _code_end(text, starts, line, comment_at, hidden, hidden_at)
    if last_line in short:
        out.append((last_end, last_line, INDENTS, STOP, 0, last_end, len(text), None, None, None))
    for _ in levels[1:]:
        out.append((last_end, last_line, INDENTS, CLOSE, -1, last_end, len(text), None, None, None))
    return out


def _code_end(text, starts, line, comment_at, hidden, hidden_at):
    """End of a line's code; of a string that goes on below, its end's line."""
    stop = comment_at.get(line, starts[line + 1])
    k = bisect_right(hidden_at, stop - 1) - 1
    if k >= 0 and hidden[k][0] >= starts[line] and hidden[k][1] > stop:
        stop = hidden[k][1]
        line_end = text.find("\n", stop)
        stop = line_end if line_end >= 0 else len(text)
    return starts[line] + len(text[starts[line] : stop].rstrip())


_SCHEMA = "file_id bigint, indexed_at timestamp, n_bytes int, uid bigint, seq int, line int, scheme int, kind int, delta int, at int, loose int, words string, name string, docstring string"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.strip().split()[0] for c in _SCHEMA.split(",")]
    empty = [(-1, -1, BRACES, NOTHING, 0, 0, 0, None, None, None)]  # a row even of an empty state, so that it can win over an older one
    for batch in batches:
        ids, stamps, uids, texts = (batch.column(i) for i in range(4))
        take, sizes, rows = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            found = (scan(text) if text else None) or empty
            take.extend([i] * len(found))
            sizes.extend([len(text.encode()) if text else 0] * len(found))
            rows.extend(found)
        index = pa.array(take, pa.int32())
        cols = list(zip(*rows, strict=True)) if rows else [()] * 10
        yield pa.RecordBatch.from_arrays(
            [ids.take(index), stamps.take(index), pa.array(sizes, pa.int32()), uids.take(index), *(pa.array(c, pa.int32()) for c in cols[:7]), *(pa.array(c, pa.string()) for c in cols[7:])], names=names
        )


def function_units(files: DataFrame) -> DataFrame:
    """file_id, n_bytes, name, signature, start (byte offset), above (of the comment's first line or the head), ends (byte offset
    behind the function, null where its end isn't found), loose (behind white space and a separator after it), comment, docstring
    of every function head in each file's present state.

    A null or empty text has no functions; repeated rows and equal indexed_at count once.
    """
    source = files.select("file_id", F.col("indexed_at").cast("timestamp").alias("indexed_at"), F.monotonically_increasing_id().alias("uid"), "text").filter("file_id is not null")
    rows = source.mapInArrow(_scan_batches, _SCHEMA).repartition("file_id")  # the one shuffle of rows: all below stays within a file
    # depth by cumulative changes; the sort serves the choice of the present state as well
    depth = F.sum("delta").over(Window.partitionBy("file_id", "uid", "scheme").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max(F.struct(F.col("indexed_at").isNotNull().alias("has"), "indexed_at", "uid")).over(Window.partitionBy("file_id"))
    now = rows.withColumn("depth", depth).withColumn("newest", newest["uid"]).filter("uid = newest").drop("newest", "uid", "indexed_at", "delta")
    # behind a head the first closing token of its own depth ends the function
    closing = F.when(F.col("kind").isin(CLOSE, STOP), F.struct("at", "loose"))
    behind = Window.partitionBy("file_id", "scheme", "depth").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    ended = now.withColumn("closed", F.last(closing, ignorenulls=True).over(behind)).filter(F.col("kind").isin(COMMENT, DECORATOR, HEAD))
    # islands of adjoining noted lines become a row each, a head is one by itself
    noted = F.col("kind") != HEAD
    rank = F.sum(noted.cast("int")).over(Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    units = ended.withColumn("island", F.when(noted, F.col("line") - rank).otherwise(-1 - F.col("seq"))).groupBy("file_id", "island").agg(
        F.min("seq").alias("seq"), F.max("line").alias("line"), F.min("at").alias("at"), F.max("kind").alias("kind"), F.first("n_bytes").alias("n_bytes"), F.first("name").alias("name"), F.first("docstring").alias("docstring"), F.first("closed").alias("closed"),
        F.first("words").alias("signature"), F.collect_list(F.when(F.col("kind") == COMMENT, F.struct("seq", "words"))).alias("lines"),
    )
    order = Window.partitionBy("file_id").orderBy("seq")
    told = units.withColumn("over", F.lag(F.struct("line", "at", "kind", "lines")).over(order)).filter(F.col("kind") == HEAD)
    direct = F.coalesce((F.col("over.line") == F.col("line") - 1) & (F.col("over.kind") != HEAD), F.lit(False))
    comment = F.array_join(F.transform(F.sort_array("over.lines"), lambda x: x["words"]), "\n")
    return told.select(
        "file_id", "n_bytes", "name", "signature", F.col("at").alias("start"), F.when(direct, F.col("over.at")).otherwise(F.col("at")).alias("above"), F.col("closed.at").alias("ends"), F.col("closed.loose").alias("loose"),
        F.when(direct, comment).alias("comment"), "docstring",
    )


# Words that say nothing about a function by themselves, in the corpus's languages.
GENERIC = frozenset(
    """a an the this that these it its is are was be to of for and or in on at by with from as into not no when which does do did done
    function functions method methods helper helpers routine procedure func def class object value values result results return returns returned returning
    param params parameter parameters arg args argument arguments type types rtype raises throws throw given
    todo fixme xxx hack tbd tba wip none null nil undefined na n description describe descriptions document documented documentation undocumented docs doc docstring add here
    see above below ditto same auto generated autogenerated automatically stub stubs placeholder missing inheritdoc inherit inherited summary comment write fill later
    die der das den dem des ein eine einen und oder zu zum zur für von mit ist wird diese dieser dieses funktion methode hilfsfunktion beschreibung beschreiben dokumentieren dokumentation fehlt siehe oben unten gibt zurück
    le la les un une des du de et ou à au aux pour ce cette est fonction méthode voir ci dessus documenter renvoie retourne sans
    el los las una unos y o del al para por esta este es función método descripción véase arriba documentar documentación devuelve sin""".split()
)
_MARK = re.compile(
    r"^(?:noqa|nolint|nosec|nosonar|type:\s*ignore|eslint|prettier|tslint|jshint|jslint|pylint|flake8|mypy|pyright|ruff|rubocop|standard:|clang-format|clang-tidy|cppcheck|istanbul|c8 ignore|v8 ignore|coverage|pragma|fmt:|yapf:|isort:|black:|@ts-|@formatter|noinspection|suppress|go:|\+build|lint:|lint-|swiftlint|ktlint|detekt|checkstyle|spell-?check|cspell|region\b|endregion\b|#region|sourcery|skipcq|codeclimate|sonar|webpack|vite-|biome-|deno-)",
    re.I,
)
_EMPTY = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip)\b", re.I)
_CODE_LINE = re.compile(
    r"^(?:(?:return|yield|await|throw|raise|del|delete|assert|goto)\b[^.]*[()\[\]+*/=;]|(?:if|for|while|switch|elif|else if|catch|except|with|unless|until)\b.*[({:]\s*$|(?:const|let|var|int|float|double|char|bool|auto|static|def|func|fn|function|import|from|include|require|class|struct|package|use)\b.*[(={;'\"]|[\w.\[\]'\"]+\s*(?::=|[-+*/|&%]?=(?!=))\s*\S|[\w.]+\([^)]*\)\s*;?\s*$|[{}\[\]();]+\s*$|end\s*$|\}?\s*else\b\s*[{:]|.*[;{}]\s*$|.*=>\s*\{)"
)
_STRIP = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|///?!?|//+|#+!?|--+|\"\"\"|''')?\s?|\s*\*+/\s*$")
_TAG = re.compile(r"\{@\w+[^}]*\}|</?\w+[^>\n]*>|[@\\]param(?:eter)?\s+(?:\{[^}]*\}\s*)?[\w$.\[\]]+|[@\\]\w+|:(?:param|arg|argument|type|raises|keyword|var|ivar|cvar)(?:\s+[\w.]+)*\s*:|:(?:returns?|rtype)\s*:")
_SPLIT = re.compile(r"(?<=[a-zß-ÿ0-9])(?=[A-Z])|[\W_]+")


def _stems(signature: str) -> tuple[frozenset[str], list[str]]:
    words = [w.lower() for w in _SPLIT.split(signature) if w]
    return frozenset(words), [w[:-1] if w.endswith("e") else w for w in words if len(w) > 2]


def says_something(doc: str | None, signature: str) -> bool:
    """Whether a documentation holds a word that name and signature don't already say. Lines that are marks for tools,
    placeholders or code count as empty."""
    if not doc or not doc.strip():
        return False
    exact, stems = _stems(signature)
    for raw in doc.split("\n"):
        line = _STRIP.sub("", _STRIP.sub("", raw.strip())).strip()
        if not line or _MARK.match(line) or _EMPTY.match(line) or _CODE_LINE.match(line):
            continue
        for word in _SPLIT.split(_TAG.sub(" ", line)):
            word = word.lower()
            if len(word) < 2 or word.isdigit() or word in GENERIC or word in exact:
                continue
            if any(word.startswith(s) and len(word) - len(s) <= 4 for s in stems):
                continue
            return True
    return False


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, signature, docs, comment, docstring = (batch.column(i).to_pylist() for i in range(5))
        good, text = [], []
        for s, d, c, q in zip(signature, docs, comment, docstring, strict=True):
            chosen = next((x for x in ((d,) if d is not None else (c, q)) if says_something(x, s or "")), None)
            good.append(chosen is not None)
            text.append(chosen)
        kept = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(text, pa.string())], names=["node", "description"]).filter(kept)


def documented_functions(registry: DataFrame, files: DataFrame) -> DataFrame:
    """node and description of every function or method whose documentation says something.

    The latest reading of a node and the present state of its file hold. Nodes without span, or with one that lies outside
    the text, begins at no function or doesn't end where that function ends, are left out, as are those without documentation. ``docs`` counts where it isn't
    null, even if blank; else the comment directly above or a Python docstring. No rows give no rows.
    """
    nodes = latest(registry.select("node", "file_id", "docs", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"), "symbol", "read_at").filter("node is not null"), "node", "read_at")
    placed = nodes.filter("file_id is not null and start >= 0 and end > start")
    units = function_units(files)
    keyed = units.withColumn("place", F.explode(F.array_distinct(F.array("start", "above"))))
    met = placed.join(keyed.select("file_id", F.col("place").alias("start"), "ends", "loose", "n_bytes", "name", "signature", "comment", "docstring"), ["file_id", "start"]).filter("end between ends and least(loose, n_bytes)")
    told = met.select("node", F.concat_ws(" ", F.col("signature"), F.col("symbol")).alias("signature"), "docs", "comment", "docstring")
    return told.mapInArrow(_judge, "node bigint, description string").distinct()


def code_pairs(registry: DataFrame, files: DataFrame) -> DataFrame:
    """node, code, description: the bytes of the span beside the documentation."""
    nodes = latest(registry.select("node", "file_id", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"), "read_at").filter("node is not null"), "node", "read_at")
    now = latest(files.select("file_id", "text", "indexed_at").filter("file_id is not null"), "file_id", "indexed_at")
    described = documented_functions(registry, files)
    spans = nodes.join(described, "node").join(now.select("file_id", "text"), "file_id")
    code: Column = F.expr("decode(substr(encode(text, 'utf-8'), start + 1, end - start), 'utf-8')")
    return spans.select("node", code.alias("code"), "description")
