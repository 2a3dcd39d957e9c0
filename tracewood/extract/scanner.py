"""Facts of one source text: definitions with ranges and documentation, calls, imports, names used, routes and requests.

One scanner over the token streams of ``lexing`` serves all languages; rule files say which words define and how blocks
close. Definitions by shape (methods, arrow functions) and by keyword share one path. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewood.extract import lexing
from tracewood.extract.lexing import Tokens
from tracewood.extract.rules import Rules, load

MODULE = "<module>"
MOST_DOC = 16 * 1024
_LEXERS = {"python": lexing.lex_python, "ruby": lexing.lex_ruby, "lua": lexing.lex_lua, "go": lexing.lex_go, "rust": lexing.lex_rust, "java": lexing.lex_java, "javascript": lexing.lex_js, "typescript": lexing.lex_ts, "c": lexing.lex_c, "kotlin": lexing.lex_kotlin}
_NOT_CALLS = frozenset("if for while switch catch return else do try new throw await typeof sizeof synchronized elif with del not and or in is case unless function func def fn fun class".split())
_CLEAN = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|///?!?|//+|#+!?|--+)?[ \t]?|\s*\*+/\s*$", re.M)
_SCREAM = re.compile(r"^[A-Z][A-Z0-9_]+$")


@dataclass
class Facts:
    defines: list[tuple[str, int, int, str]] = field(default_factory=list)
    calls: list[tuple[str, str, bool]] = field(default_factory=list)
    refs: list[tuple[str, str]] = field(default_factory=list)
    imports: list[tuple[str, str, str]] = field(default_factory=list)
    members: list[str] = field(default_factory=list)
    routes: list[tuple[str, str, str]] = field(default_factory=list)
    requests: list[tuple[str, str, str]] = field(default_factory=list)
    had_errors: bool = False


@cache
def rules_by_extension() -> dict[str, Rules]:
    return load()


def rules_for(path: str) -> Rules | None:
    m = re.search(r"(\.[^./\\]+)$", path.lower())
    return rules_by_extension().get(m[1]) if m else None


def clean(comment: str) -> str:
    """A comment without its marks, white space folded."""
    return " ".join(_CLEAN.sub("", comment).split())


def _matches(tokens: Tokens, family: str) -> tuple[dict[int, int], bool]:
    """Index of each opener's closer; and whether something stayed open."""
    pairs, stack, bad = {}, [], False
    for i, t in enumerate(tokens.types):
        if t in ("(", "[", "{", "INDENT", "FOPEN"):
            stack.append((t, i))
        elif t in (")", "]", "}", "DEDENT", "FCLOSE"):
            want = {")": "(", "]": "[", "}": "{", "DEDENT": "INDENT", "FCLOSE": "FOPEN"}[t]
            if stack and stack[-1][0] == want:
                pairs[stack.pop()[1]] = i
            else:
                bad = True
        elif family == "end":
            before = tokens.types[i - 1] if i else "NL"
            starts = before in ("NL", ";", "=", "(", "INDENT", "then", "else", "do", "[", ",", "return", "||", "&&") or tokens.breaks[i]
            if t in ("def", "class", "module", "begin", "case", "function") or (t in ("if", "unless") and starts) or (t == "if" and "then" in tokens.types and "NL" not in tokens.types):
                stack.append(("end", i))
            elif t in ("while", "until", "for") and starts and "NL" in tokens.types:
                stack.append(("end", i))
            elif t == "do":
                stack.append(("end", i))
            elif t == "end":
                if stack and stack[-1][0] == "end":
                    pairs[stack.pop()[1]] = i
                else:
                    bad = True
    return pairs, bad or bool(stack) or "BAD" in tokens.types


def scan(path: str, text: str, rules: Rules | None = None) -> Facts:
    """Facts of a text by the rules of its extension; none for unknown languages."""
    rules = rules or rules_for(path)
    out = Facts()
    if rules is None or not text:
        return out
    tokens = _LEXERS[rules.lexer](text)
    T, S, E = tokens.types, tokens.starts, tokens.ends
    word = lambda i: text[S[i] : E[i]]
    pairs, out.had_errors = _matches(tokens, rules.family)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    comment_ends = [b for _, b in tokens.comments]

    def doc_above(at: int) -> str:
        """Comments that end on the lines directly above an offset."""
        parts, line = [], bisect_right(lines, at) - 1
        k = bisect_right(comment_ends, at) - 1
        while k >= 0:
            a, b = tokens.comments[k]
            last = bisect_right(lines, max(a, b - 1)) - 1
            first = bisect_right(lines, a) - 1
            if last not in (line - 1, line) or text[lines[first] : a].strip():
                break
            parts.append(clean(text[a:b]))
            line, k = first, k - 1
        return "\n".join(reversed(parts))[:MOST_DOC]

    def is_name(i: int) -> bool:
        return i < len(T) and bool(re.match(r"[^\W\d][\w$]*[?!=]?$", word(i))) and T[i] not in ("STR", "NUM")

    found: dict[int, tuple[str, int, int, str]] = {}  # name token to (name, start, end, kind)
    heads: set[int] = set()

    def statement_start(i: int) -> int:
        """First token of the statement that token i lies in: modifiers and decorators belong to it."""
        while i > 0 and T[i - 1] not in ("{", "}", ";", "NL", "INDENT", "DEDENT", ")", "EOF", ":") and not (tokens.breaks[i] and rules.family == "brace" and T[i - 1] not in ("]", "export", "default", "async", "pub", "static")):
            if rules.family == "end" and tokens.breaks[i]:
                break
            i -= 1
        while rules.family == "indent" and i > 1 and T[i - 1] == "NL":  # decorators above
            k = i - 2
            while k >= 0 and T[k] not in ("NL", "INDENT", "DEDENT"):
                k -= 1
            if T[k + 1] != "@":
                break
            i = k + 1
        return i

    def body(i: int) -> tuple[int, int] | None:
        """Opening and closing token of the block that a head's token i leads to."""
        if rules.family == "indent":
            depth = 0
            for k in range(i, len(T)):
                depth += (T[k] in "([{") - (T[k] in ")]}") if len(T[k]) == 1 else 0
                if T[k] == ":" and not depth:
                    if k + 2 < len(T) and T[k + 1] == "NL" and T[k + 2] == "INDENT":
                        return (k + 2, pairs.get(k + 2, len(T) - 1))
                    stop = next((j for j in range(k + 1, len(T)) if T[j] in ("NL", "EOF")), len(T) - 1)
                    return (k, stop)
                if T[k] in ("NL", "EOF") and not depth:
                    return None
            return None
        if rules.family == "end":
            return None
        k = i
        while k < len(T) and T[k] not in ("{", ";", "}", "EOF"):
            if T[k] in ("(", "["):
                k = pairs.get(k, len(T) - 1)
            k += 1
        return (k, pairs.get(k, len(T) - 1)) if k < len(T) and T[k] == "{" else None

    def last_before(k: int) -> int:
        while k > 0 and T[k] in ("DEDENT", "NL", "INDENT", "EOF"):
            k -= 1
        return k

    def define(i: int, start: int, span: tuple[int, int] | None, kind: str, fallback: int) -> None:
        end = last_before(span[1]) if span else fallback
        found[i] = (word(i), start, end, kind)

    n = len(T)

    def with_semicolon(k: int) -> int:
        return k + 1 if k + 1 < n and T[k + 1] == ";" and S[k + 1] < E[k + 1] else k

    def arrow_at(i: int) -> int:
        """The '=>' or 'function' of a function bound to the name at token i, or 0."""
        if rules.lexer not in ("javascript", "typescript") or T[i] != "ID" or i + 2 >= n or T[i + 1] not in ("=", ":") or not i or T[i - 1] not in ("const", "let", "var", ".", "{", "}", ";", "static", "readonly", "public", "private"):
            return 0
        k = i + 1
        while k < n and T[k] not in ("=", ";", "EOF", "{", ",", ")"):
            k += 1
        k += 2 if k + 1 < n and T[k + 1] == "async" else 1
        if k >= n or T[k] == "function":
            return k if k < n else 0
        arrow = pairs.get(k, k) + 1 if T[k] == "(" else k + 1
        while arrow < n and T[arrow] not in ("=>", ";", "EOF", "{", ")", ","):  # a type between the parameters and the arrow
            arrow = pairs.get(arrow, arrow) + 1 if T[arrow] in ("[", "(") else arrow + 1
        return arrow if arrow < n and T[arrow] == "=>" else 0

    for i, t in enumerate(T):
        if t in rules.definitions or (t == "ID" and word(i) in rules.definitions):
            k = i + 1
            if t == "func" and k < n and T[k] == "(":  # a receiver
                k = pairs.get(k, n) + 1
            while k < n and T[k] in ("*", "self", ".") and k < i + 4:
                k += 1
            if rules.lexer == "lua":
                while k + 2 < n and T[k + 1] in (".", ":"):
                    k += 2
            if not is_name(k):
                continue
            if rules.family == "end":
                close = pairs.get(i, n - 1)
                define(k, statement_start(i), (i, close), "function", k)
            else:
                span = body(k + 1)
                stop = next((j for j in range(k, n) if T[j] in (";", "NL", "EOF")), n - 1)
                define(k, statement_start(i), span, "function", last_before(stop))
            heads.add(k)
        elif (t in rules.classes or (t == "ID" and word(i) in rules.classes)) and is_name(i + 1) and not (i and T[i - 1] in (".", "::")):
            if rules.family == "end":
                define(i + 1, statement_start(i), (i, pairs.get(i, n - 1)), "class", i + 1)
            else:
                stop = next((j for j in range(i, n) if T[j] in (";", "NL", "EOF")), n - 1)
                define(i + 1, statement_start(i), body(i + 2), "class", last_before(stop))
            heads.add(i + 1)
        elif rules.methods and is_name(i) and i + 1 < n and T[i + 1] == "(" and word(i) not in _NOT_CALLS and (T[i] == "ID" or T[i] in ("get", "set", "static", "of", "from", "as")) and not (i and T[i - 1] in (".", "new", "->", "::", "return", "=", "(", ",", "!", "&&", "||", "+", "?.")):
            close = pairs.get(i + 1)
            k = close + 1 if close else n
            while k < n and T[k] not in ("{", ";", "=", "}", "EOF", "(", ","):
                k = pairs.get(k, k) + 1 if T[k] == "[" else k + 1
            if close and k < n and T[k] == "{" and i not in heads:
                define(i, statement_start(i), (k, pairs.get(k, n - 1)), "method", k)
                heads.add(i)
        elif arrow := arrow_at(i):
            if T[arrow] == "function":
                span = body(arrow)
            else:
                span = body(arrow + 1) if arrow + 1 < n and T[arrow + 1] == "{" else None
            end = span[1] if span else last_before(next((j for j in range(arrow + 1, n) if T[j] in (";", "EOF") or tokens.breaks[j]), n - 1) - 1)
            found[i] = (word(i), statement_start(i), with_semicolon(end), "function")
            heads.add(i)
        elif rules.constants and t in ("ID", "CONST") and i + 1 < n and T[i + 1] in ("=", ":") and _SCREAM.match(word(i)) and not (i and T[i - 1] in (".", ",", "(", "{")):
            stop = next((j for j in range(i, n) if T[j] in (";", "NL", "EOF") or (tokens.breaks[j] and j > i + 2 and rules.family == "brace")), n - 1)
            found[i] = (word(i), statement_start(i), with_semicolon(last_before(max(i + 1, stop - 1))), "constant")
            heads.add(i)

    ordered = sorted(found.items(), key=lambda x: (x[1][1], -x[1][2]))
    scopes = [(start, end, name, kind) for _, (name, start, end, kind) in ordered if kind != "constant"]
    owner, open_ = [""] * n, []
    at = 0
    for i in range(n):
        while at < len(scopes) and scopes[at][0] <= i:
            open_.append(scopes[at])
            at += 1
        while open_ and open_[-1][1] < i:
            open_.pop()
        open_ = [s for s in open_ if s[1] >= i]
        owner[i] = next((s[2] for s in reversed(open_) if s[3] != "class"), MODULE)
    to_byte = _byte_offsets(text)
    for i, (name, start, end, kind) in ordered:
        doc = doc_above(S[start])
        if rules.family == "indent":
            span = body(i + 1)
            if span and span[0] + 1 < n and T[span[0]] == "INDENT" and T[span[0] + 1] == "STR":
                doc = " ".join(x for x in (doc, clean(word(span[0] + 1).strip("rRuUbB\"'"))) if x)
        out.defines.append((name, to_byte(S[start]), to_byte(E[end]), doc))
        if kind == "method" or (kind == "function" and any(s[3] == "class" and s[0] <= start and end <= s[1] for s in scopes)):
            out.members.append(name)
    if rules.lexer == "c":
        for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(?:\([^)\n]*\))?(?:[^\n\\]|\\[\s\S])*", text, re.M):
            out.defines.append((m[1], to_byte(m.start()), to_byte(m.start() + len(m.group().rstrip())), doc_above(m.start())))
        out.defines.sort(key=lambda d: d[1])
    seen = set()
    for i in range(n):
        if T[i] not in ("ID", "CONST") or i in found:
            continue
        if i + 1 < n and T[i + 1] == "(":
            if word(i) not in _NOT_CALLS:
                dotted = i > 0 and T[i - 1] in (".", "->", "::", "?.", "&.")
                receiver = word(i - 2) if dotted and i > 1 else ""
                out.calls.append((owner[i], word(i), dotted and receiver not in rules.receivers))
        elif len(word(i)) > 2 and word(i) != owner[i] and (owner[i], word(i)) not in seen:
            seen.add((owner[i], word(i)))
            out.refs.append((owner[i], word(i)))
    out.imports = imports(rules.language, text)
    out.routes, out.requests = http(text, owner, tokens)
    return out


def _byte_offsets(text: str):
    if text.isascii():
        return lambda at: at
    marks = list(range(0, len(text), 1024))
    sizes = [0]
    for a in marks:
        sizes.append(sizes[-1] + len(text[a : a + 1024].encode()))
    return lambda at: sizes[at // 1024] + len(text[at // 1024 * 1024 : at].encode())


_IMPORTS = {
    "python": [(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+\(?([\w \t,*]+)", "names"), (r"^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)", "modules")],
    "javascript": [(r"import\s+(?:type\s+)?(?:[\w$]+\s*,?\s*)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)", "braced"), (r"import\s+(?:\*\s+as\s+)?([\w$]+)(?:\s*,\s*\{[^}]*\})?\s+from\s*['\"]([^'\"]+)", "default"), (r"(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)", "default")],
    "go": [(r"^[ \t]*(?:import[ \t]+)?(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"[ \t]*$", "default")], "java": [(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;", "path")], "kotlin": [(r"^[ \t]*import[ \t]+([\w.]+(?:\.\*)?)", "path")],
    "rust": [(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);", "path")], "c": [(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)", "path")], "ruby": [(r"^[ \t]*require(?:_relative)?[ \t(]+['\"]([^'\"]+)", "path"), (r"^[ \t]*include[ \t]+([\w:]+)", "mixin")], "lua": [(r"(?:local[ \t]+(\w+)[ \t]*=[ \t]*)?require[ \t(]+['\"]([^'\"]+)", "default")],
}
_IMPORTS["typescript"], _IMPORTS["cpp"] = _IMPORTS["javascript"], _IMPORTS["c"]


def imports(language: str, text: str) -> list[tuple[str, str, str]]:
    """(kind, name, target): modules and names that a file brings in; kind module, name or mixin."""
    out = []
    for pattern, shape in _IMPORTS.get(language, ()):
        for m in re.finditer(pattern, text, re.M):
            if shape == "names":
                for part in m[2].split(","):
                    words = part.split()
                    if words:
                        out.append(("name", words[-1], f"{m[1]}.{words[0]}"))
            elif shape == "modules":
                for part in m[1].split(","):
                    words = part.split()
                    out.append(("module", words[-1], words[0]))
            elif shape == "braced":
                for part in m[1].split(","):
                    words = part.split()
                    if words:
                        out.append(("name", words[-1], f"{m[2]}#{words[0] if words[0] != 'type' else words[1]}"))
            elif shape == "default":
                out.append(("module", m[1] or m[2].rsplit("/", 1)[-1], m[2]))
            else:
                out.append(("mixin" if shape == "mixin" else "module", re.split(r"[.:/\\]+", m[1])[-1], m[1]))
    return out


_VERB = r"(get|post|put|patch|delete|head|options|any|all)"
_ROUTE = re.compile(rf"@(?:\w+\.)?(?:(?P<v1>get|post|put|patch|delete)|route|(?P<v2>Get|Post|Put|Patch|Delete|Request)Mapping)\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"'](?P<p1>/[^\"']*)|\b(?:app|router|server|mux|r|e|api)\.(?P<v3>{_VERB[1:-1]}|HandleFunc|Handle)\(\s*[\"'`](?P<p2>/[^\"'`]*)[\"'`]\s*,\s*(?P<h>[\w.]+)?", re.I)
_REQUEST = re.compile(rf"\bfetch\(\s*[\"'`](?P<p1>[^\"'`]*/[^\"'`]*)|\b(?:axios|requests|http|client|session|httpx|\$http)\.(?P<v>{_VERB[1:-1]})\(\s*f?[\"'`](?P<p2>[^\"'`]*/[^\"'`]*)", re.I)


def http(text: str, owner: list[str], tokens: Tokens) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """Routes (handler, verb, path) and requests (sender, verb, path); interpolations in a path are parameters."""
    plain = lambda p: re.sub(r"\$?\{[^}]*\}", "*", re.sub(r"^https?://[^/]+", "", p).split("?")[0])
    at = lambda pos: max(0, bisect_right(tokens.starts, pos) - 1)
    routes, requests = [], []
    for m in _ROUTE.finditer(text):
        verb = (m["v1"] or m["v2"] or m["v3"] or "any").upper()
        verb = "ANY" if verb in ("HANDLEFUNC", "HANDLE", "REQUEST", "ALL", "ROUTE") else verb
        handler = m["h"]
        if not handler:
            i = at(m.end())
            ahead = next((owner[k] for k in range(i, len(owner)) if owner[k] != owner[i]), owner[i])
            handler = owner[i] if m["p1"] and owner[i] != MODULE else ahead  # a decorator belongs to its function
        routes.append((handler, verb, plain(m["p1"] or m["p2"])))
    for m in _REQUEST.finditer(text):
        requests.append((owner[at(m.start())] if owner else MODULE, (m["v"] or "get").upper(), plain(m["p1"] or m["p2"])))
    return routes, requests


SCHEMA = (
    "file string, lang string, had_errors boolean, defines array<struct<name:string,start:int,end:int,doc:string>>, calls array<struct<caller:string,callee:string,has_receiver:boolean>>, refs array<struct<owner:string,name:string>>, "
    "imports array<struct<kind:string,name:string,target:string>>, members array<string>, routes array<struct<handler:string,verb:string,path:string>>, requests array<struct<sender:string,verb:string,path:string>>"
)


def extract(files: DataFrame, file: str = "file", text: str = "text", path: str = "file") -> DataFrame:
    """One nested row of facts per file of a known language. Files are independent, so nothing is shuffled; null and empty
    texts give empty facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in _arrow_schema()]
        for b in batches:
            cols: list[list] = [[] for _ in types]
            for name, where, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rules = rules_for(where or "")
                if rules is None:
                    continue
                f = scan(where, body or "", rules)
                values = [
                    name, rules.language, f.had_errors, [dict(zip(("name", "start", "end", "doc"), x, strict=True)) for x in f.defines], [dict(zip(("caller", "callee", "has_receiver"), x, strict=True)) for x in f.calls], [dict(zip(("owner", "name"), x, strict=True)) for x in f.refs],
                    [dict(zip(("kind", "name", "target"), x, strict=True)) for x in f.imports], f.members, [dict(zip(("handler", "verb", "path"), x, strict=True)) for x in f.routes], [dict(zip(("sender", "verb", "path"), x, strict=True)) for x in f.requests],
                ]
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=_arrow_schema())

    return files.select(F.col(file).cast("string"), F.col(path).alias("_path"), F.col(text)).mapInArrow(run, SCHEMA)


def _arrow_schema() -> pa.Schema:
    s = pa.string()
    rows = lambda **f: pa.list_(pa.struct(list(f.items())))
    return pa.schema(
        [("file", s), ("lang", s), ("had_errors", pa.bool_()), ("defines", rows(name=s, start=pa.int32(), end=pa.int32(), doc=s)), ("calls", rows(caller=s, callee=s, has_receiver=pa.bool_())), ("refs", rows(owner=s, name=s)), ("imports", rows(kind=s, name=s, target=s)), ("members", pa.list_(s)), ("routes", rows(handler=s, verb=s, path=s)), ("requests", rows(sender=s, verb=s, path=s))]
    )


def facts(extracted: DataFrame, kind: str) -> DataFrame:
    """Rows of one list of facts with their file and position."""
    return extracted.select("file", F.posexplode(kind).alias("seq", "f")).select("file", "seq", "f.*") if kind != "members" else extracted.select("file", F.explode("members").alias("name"))
