"""Tokens of source texts. Lexers drop comments and white space and note line breaks before each token.

A text that can't be cut into tokens (an open string or comment, a stray character) gives a BAD token, which no grammar
accepts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tokens:
    types: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)
    gaps: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)

    def add(self, kind: str, start: int, end: int, broken: bool = False, gap: bool = False) -> None:
        self.types.append(kind)
        self.starts.append(start)
        self.ends.append(end)
        self.breaks.append(broken)
        self.gaps.append(gap)


NUMBER = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|(?:\d[\d_]*)(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?[a-zA-Z_]*\d*|\.\d[\d_]*(?:[eE][+-]?\d+)?[a-zA-Z]*"
SPACE = r"[^\S\n]+"
DOUBLE = r'"(?:[^"\\\n]|\\[\s\S])*"'
SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
LINE, BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/"


def _master(**groups: str) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in groups.items()))


def _punct(text: str) -> str:
    return "|".join(re.escape(p) for p in sorted(text.split(), key=lambda p: (-len(p), p)))


def plain(master: re.Pattern, words: frozenset[str]):
    """A lexer that needs no context: groups space, nl, comment are dropped, id may be a word, op is its own type."""

    def lex(text: str) -> Tokens:
        out = Tokens()
        types, starts, ends, breaks, gaps = out.types, out.starts, out.ends, out.breaks, out.gaps
        at, n, broken, gap, match = 0, len(text), False, False, master.match
        if text.startswith("﻿"):
            at = 1
        while at < n:
            m = match(text, at)
            if m is None:
                out.add("BAD", at, at + 1, broken, gap)
                break
            kind, end = m.lastgroup, m.end()
            if kind == "space":
                gap = True
            elif kind == "nl":
                broken = gap = True
            elif kind == "comment":
                out.comments.append((at, end))
                gap = True
                if "\n" in m.group():
                    broken = True
            else:
                if kind == "id":
                    word = m.group()
                    types.append(word if word in words else "ID")
                elif kind == "op":
                    types.append(m.group())
                else:
                    types.append(kind.upper())
                starts.append(at)
                ends.append(end)
                breaks.append(broken)
                gaps.append(gap)
                broken = gap = False
            at = end
        out.add("EOF", n, n, True, True)
        return out

    return lex


# ---------------------------------------------------------------- C, Java, Rust, Lua, Kotlin

_C_OPS = "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= ## { } [ ] ( ) ; : , . + - * / % & | ^ ~ ! = < > ? @"
C_WORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Atomic _Noreturn _Static_assert static_assert _Thread_local _Alignas _Alignof alignas alignof __attribute__ __extension__ __inline __restrict typeof __typeof__ asm __asm__ bool".split()
)
lex_c = plain(
    _master(space=SPACE, nl=r"\n", comment=rf"{LINE}|{BLOCK}|(?<![^\n])[^\S\n]*#(?:[^\n\\]|\\(?:\r\n|[\s\S])|/\*[\s\S]*?\*/)*|\\\r?\n", str=r'(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"', char=r"[uUL]?'(?:[^'\\\n]|\\[^\n])+'", id=r"[^\W\d]\w*|\$\w+", num=NUMBER, op=_punct(_C_OPS)), C_WORDS
)

JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits yield when non".split()
)
lex_java = plain(
    _master(space=SPACE, nl=r"\n", comment=rf"{LINE}|{BLOCK}", text=r'"""[^\S\n]*\n(?:[^\\]|\\[\s\S])*?"""', str=r'"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")', char=r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'", id=r"[^\W\d]\w*(?:\$\w*)*|\$\w*", num=NUMBER,
            op=_punct("... -> :: ++ -- << <= >= == != && || += -= *= /= %= &= ^= |= <<= { } [ ] ( ) ; : , . + - * / % & | ^ ~ ! = < > ? @")), JAVA_WORDS
)

RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules _ yield".split())


def _nested(text: str, at: int, opening: str, closing: str) -> int:
    """End of a nested comment that begins at ``at``, or -1."""
    depth, n = 0, len(text)
    both = re.compile(re.escape(opening) + "|" + re.escape(closing))
    while at < n:
        m = both.search(text, at)
        if not m:
            return -1
        depth += 1 if m.group() == opening else -1
        at = m.end()
        if not depth:
            return at
    return -1


_RUST_RAW = re.compile(r'b?c?r(#*)"')
_RUST = _master(
    space=SPACE, nl=r"\n", comment=LINE, deep=r"/\*", raw=r'(?:br|cr|r)#*"', str=r'[bc]?"(?:[^"\\]|\\[\s\S])*"', char=r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'", life=r"'[^\W\d]\w*", id=r"r#\w+|[^\W\d]\w*", num=r"0[xX][0-9a-fA-F_]+\w*|0[bo][0-7_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*",
    op=_punct("... ..= .. :: -> => << <= >= == != && || += -= *= /= %= &= ^= |= <<= { } [ ] ( ) ; : , . + - * / % & | ^ ~ ! = < > ? @ # $"),
)


def lex_rust(text: str) -> Tokens:
    out, at, n, broken, gap = Tokens(), 0, len(text), False, False
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at) and not text.startswith("#![", at):
        at = max(text.find("\n", at), 0) or n
    while at < n:
        m = _RUST.match(text, at)
        if m is None:
            out.add("BAD", at, at + 1, broken, gap)
            break
        kind, end = m.lastgroup, m.end()
        if kind in ("space", "nl", "comment", "deep"):
            if kind == "deep":
                end = _nested(text, at, "/*", "*/")
                if end < 0:
                    out.add("BAD", at, at + 2, broken, gap)
                    break
            if kind in ("comment", "deep"):
                out.comments.append((at, end))
            broken, gap = broken or "\n" in text[at:end], True
        else:
            if kind == "raw":
                close = text.find('"' + "#" * m.group().count("#"), end)
                if close < 0:
                    out.add("BAD", at, end, broken, gap)
                    break
                end, kind = close + 1 + m.group().count("#"), "str"
            word = m.group()
            out.add(word if kind == "op" or (kind == "id" and word in RUST_WORDS) else kind.upper(), at, end, broken, gap)
            broken = gap = False
        at = end
    out.add("EOF", n, n, True, True)
    return out


LUA_WORDS = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
lex_lua = plain(
    _master(space=SPACE, nl=r"\n", comment=r"--\[(?P<eq>=*)\[[\s\S]*?\](?P=eq)\]|--(?!\[=*\[)[^\n]*|(?<![\s\S])#[^\n]*", long=r"\[(?P<lq>=*)\[[\s\S]*?\](?P=lq)\]", str=rf"{DOUBLE}|{SINGLE}", id=r"[^\W\d]\w*", num=r"0[xX][0-9a-fA-F.]+(?:[pP][+-]?\d+)?|\d+(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?", op=_punct("... .. :: == ~= <= >= << >> // + - * / % ^ # & ~ | < > = ( ) { } [ ] ; : , .")),
    LUA_WORDS,
)


def _lua_fixed(text: str) -> Tokens:
    out = lex_lua_raw(text)
    out.types = ["STR" if t == "LONG" else t for t in out.types]
    return out


lex_lua_raw, lex_lua = lex_lua, _lua_fixed

GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO = plain(
    _master(space=SPACE, nl=r"\n", comment=rf"{LINE}|{BLOCK}", raw=r"`[^`]*`", str=r'"(?:[^"\\\n]|\\.)*"', char=r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'", id=r"[^\W\d]\w*", num=r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bBoO][0-7_]+i?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?i?|\.\d+(?:[eE][+-]?\d+)?i?",
            op=_punct("... <<= >>= &^= := <- ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= &^ { } [ ] ( ) ; : , . + - * / % & | ^ ~ ! = < >")), GO_WORDS
)
_GO_ENDS = frozenset("ID NUM STR CHAR break continue fallthrough return ++ -- ) ] }".split())


def lex_go(text: str) -> Tokens:
    """Go puts a semicolon at the end of a line whose last token may end a statement."""
    raw, out = _GO(text), Tokens()
    out.comments = raw.comments
    last = ""
    for kind, start, end, broken, gap in zip(raw.types, raw.starts, raw.ends, raw.breaks, raw.gaps, strict=True):
        if broken and last in _GO_ENDS:
            out.add(";", start, start)
        kind = "STR" if kind == "RAW" else kind
        out.add(kind, start, end, broken, gap)
        last = kind
    return out


KOTLIN_WORDS = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while import by catch constructor finally get init set where companion enum sealed data open abstract final override private public internal protected inline suspend operator infix lateinit const vararg out annotation inner tailrec external crossinline noinline reified expect actual value".split())
_KOTLIN = _master(
    space=SPACE, nl=r"\n", comment=LINE, deep=r"/\*", text=r'"""', quote=r'"', char=r"'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|.))'", id=r"[^\W\d]\w*|`[^`\n]+`", num=r"0[xX][0-9a-fA-F_]+[uUL]*|0[bB][01_]+[uUL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[uULfF]*",
    op=_punct("... ..< .. === !== == != <= >= && || ++ -- += -= *= /= %= -> :: ?. ?: !! { } [ ] ( ) ; : , . + - * / % ! = < > ? @ #"),
)


def lex_kotlin(text: str) -> Tokens:
    out, at, n, broken, gap = Tokens(), 0, len(text), False, False

    def string(at: int, close: str) -> int:
        """Behind the string whose inside begins at ``at``; templates in it are skipped with their own strings."""
        while at < n:
            if text.startswith(close, at):
                at += len(close)
                while close == '"""' and text.startswith('"', at):
                    at += 1
                return at
            if text.startswith("${", at):
                depth, at = 1, at + 2
                while at < n and depth:
                    if text.startswith('"""', at):
                        at = string(at + 3, '"""')
                    elif text[at] == '"':
                        at = string(at + 1, '"')
                    else:
                        depth += (text[at] == "{") - (text[at] == "}")
                        at += 1
                    if at < 0:
                        return -1
                continue
            if close == '"' and text[at] == "\n":
                return -1
            at += 2 if close == '"' and text[at] == "\\" else 1
        return -1

    while at < n:
        m = _KOTLIN.match(text, at)
        end = m.end() if m else -1
        kind = m.lastgroup if m else "bad"
        if kind == "deep":
            end = _nested(text, at, "/*", "*/")
        elif kind in ("text", "quote"):
            end, kind = string(end, m.group()), "str"
        if end < 0:
            out.add("BAD", at, at + 1, broken, gap)
            break
        if kind in ("space", "nl", "comment", "deep"):
            if kind in ("comment", "deep"):
                out.comments.append((at, end))
            broken, gap = broken or "\n" in text[at:end], True
        else:
            word = m.group()
            out.add(word if kind == "op" or (kind == "id" and word in KOTLIN_WORDS) else kind.upper(), at, end, broken, gap)
            broken = gap = False
        at = end
    out.add("EOF", n, n, True, True)
    return out


# ---------------------------------------------------------------- JavaScript and TypeScript

JS_WORDS = frozenset(
    "async await break case catch class const continue debugger default delete do else export extends finally for function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield null true false from as".split()
)
TS_WORDS = JS_WORDS | frozenset("abstract any asserts declare enum implements infer interface is keyof module namespace private protected public readonly satisfies type unique override accessor".split())
_JS = _master(
    space=r"[^\S\n  ]+", nl=r"[\n  ]", comment=rf"{LINE}|{BLOCK}|(?<![\s\S])#![^\n]*", num=r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?n?|\.\d[\d_]*(?:[eE][+-]?\d+)?", str=rf"{DOUBLE}|{SINGLE}", id=r"[^\W\d]\w*(?:\$+\w*)*|\$[\w$]*", priv=r"#[^\W\d][\w$]*", tick=r"`",
    op=_punct("... => ?. ?? ??= &&= ||= **= ** === !== == != <= >= << <<= && || ++ -- += -= *= /= %= &= ^= |= { } [ ] ( ) ; : , . + - * / % & | ^ ~ ! = < > ? @"),
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_VALUE_ENDS = frozenset("ID NUM STR REGEX TEMPLATE TTAIL PRIV ) ] } this super null true false ++ -- get set of async from as static let type declare any module namespace readonly is abstract".split())


def _script(words: frozenset[str]):
    def lex(text: str) -> Tokens:
        out, at, n, broken, gap = Tokens(), 0, len(text), False, False
        types = out.types
        braces: list[bool] = []  # True: the brace of a template's ${
        parens: list[bool] = []  # True: the parenthesis of if, while, for or with
        after_head = False
        if text.startswith("﻿"):
            at = 1
        match = _JS.match
        while at < n:
            m = match(text, at)
            if m is None:
                out.add("BAD", at, at + 1, broken, gap)
                break
            kind, end = m.lastgroup, m.end()
            if kind in ("space", "nl", "comment"):
                if kind == "comment":
                    out.comments.append((at, end))
                if kind != "space" and (kind == "nl" or "\n" in m.group()):
                    broken = True
                gap, at = True, end
                continue
            word = m.group()
            if kind == "id":
                kind = word if word in words else "ID"
            elif kind == "op":
                kind = word
                last = types[-1] if types else ""
                if word in ("/", "/=") and (last not in _VALUE_ENDS or (last == ")" and after_head)):
                    r = _REGEX.match(text, at)
                    if r:
                        kind, end = "REGEX", r.end()
                elif word == "{":
                    braces.append(False)
                elif word == "(":
                    parens.append(last in ("if", "while", "for", "with"))
                elif word == ")":
                    after_head = parens.pop() if parens else False
                elif word == "}":
                    if braces and braces.pop():
                        t = _TEMPLATE.match(text, end)
                        if t is None:
                            out.add("BAD", at, end, broken, gap)
                            break
                        end = t.end()
                        kind = "TTAIL" if t[1] == "`" else "TMID"
                        if kind == "TMID":
                            braces.append(True)
            elif kind == "tick":
                t = _TEMPLATE.match(text, end)
                if t is None:
                    out.add("BAD", at, end, broken, gap)
                    break
                end = t.end()
                kind = "TEMPLATE" if t[1] == "`" else "THEAD"
                if kind == "THEAD":
                    braces.append(True)
            else:
                kind = kind.upper()
                if kind == "NUM" and end < n and (text[end].isalpha() or text[end] == "_"):
                    kind = "BAD"
            out.add(kind, at, end, broken, gap)
            broken = gap = False
            at = end
        out.add("EOF", n, n, True, True)
        return out

    return lex


lex_js, lex_ts = _script(JS_WORDS), _script(TS_WORDS)

# ---------------------------------------------------------------- Python

PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split())
_PY = _master(
    space=r"[^\S\n\r]+|\\\r?\n", nl=r"\r?\n|\r", comment=r"#[^\n\r]*", pre=r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:\"\"\"|'''|\"|')", id=r"[^\W\d]\w*", num=r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?",
    op=_punct("... **= //= >>= <<= := -> ** // << >> <= >= == != += -= *= /= %= &= |= ^= @= { } [ ] ( ) ; : , . + - * / % & | ^ ~ = < > @ !"),
)
_PY_STR = {q: re.compile(rf"(?:[^\\{q[0]}" + ("\\n\\r" if len(q) == 1 else "") + r"]|\\(?:\r\n|[\s\S])" + (f"|{q[0]}(?!{q[0]}{q[0]})" if len(q) == 3 else "") + f")*{q}") for q in ("'", '"', "'''", '"""')}


def lex_python(text: str) -> Tokens:
    out, at, n = Tokens(), 1 if text.startswith("﻿") else 0, len(text)
    indents, depth, fresh = [0], 0, True

    def expression(at: int, quote: str, spec: bool) -> int:
        """Tokens of a replacement field behind its '{'; gives the place behind its '}' or -1."""
        level = 0
        while at < n:
            c = text[at]
            if not level and c == "}":
                out.add("FCLOSE", at, at + 1)
                return at + 1
            if not level and c == "!" and text[at + 1 : at + 2] != "=":
                m = re.compile(r"!\s*[A-Za-z]\w*").match(text, at)
                if not m:
                    return -1
                out.add("FCONV", at, m.end())
                at = m.end()
                continue
            if not level and c == ":":
                out.add("FSPEC", at, at + 1)
                return body(at + 1, quote, False, True)
            m = _PY.match(text, at)
            if m is None:
                return -1
            kind, end = m.lastgroup, m.end()
            if kind == "pre":
                end = string(at, m)
                if end < 0:
                    return -1
            elif kind == "op":
                level += (c in "([{") - (c in ")]}")
                if level < 0:
                    return -1
                out.add(m.group(), at, end)
            elif kind in ("id", "num"):
                out.add(m.group() if m.group() in PY_WORDS else kind.upper(), at, end)
            at = end
        return -1

    def body(at: int, quote: str, raw: bool, spec: bool) -> int:
        """The inside of an f-string up to its quote, or of a format specification up to its '}'."""
        while at < n:
            c = text[at]
            if spec and c == "}":
                out.add("FCLOSE", at, at + 1)
                return at + 1
            if text.startswith(quote, at):
                return -1 if spec else at + len(quote)
            if c == "{":
                if text.startswith("{{", at) and not spec:
                    at += 2
                    continue
                out.add("FOPEN", at, at + 1)
                at = expression(at + 1, quote, spec)
                if at < 0:
                    return -1
                continue
            if c == "}":
                if not text.startswith("}}", at):
                    return -1
                at += 2
                continue
            if c == "\\":
                if text.startswith("\\N{", at) and not raw:
                    at = text.find("}", at)
                    if at < 0:
                        return -1
                    at += 1
                else:
                    at += 1 if text[at + 1 : at + 2] in "{}" else 2
                continue
            if c == "\n" and len(quote) == 1:
                return -1
            at += 1
        return -1

    def string(at: int, m: re.Match) -> int:
        opening = m.group()
        quote = opening.lstrip("rRbBuUfFtT")
        prefix = opening[: -len(quote)].lower()
        if "f" in prefix or "t" in prefix:
            out.add("FBEG", at, m.end())
            end = body(m.end(), quote, "r" in prefix, False)
            if end >= 0:
                out.add("FEND", end, end)
            return end
        s = _PY_STR[quote].match(text, m.end())
        if not s:
            return -1
        out.add("STR", at, s.end())
        return s.end()

    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 1]
            if rest not in ("", "\n", "\r", "#"):
                lead = m.group().replace("\f", "")
                width = len(lead.expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.add("INDENT", at, m.end())
                while width < indents[-1]:
                    indents.pop()
                    out.add("DEDENT", m.end(), m.end())
                if width != indents[-1]:
                    out.add("BAD", at, m.end())
                    break
            at, fresh = m.end(), False
            continue
        m = _PY.match(text, at)
        if m is None:
            out.add("BAD", at, at + 1)
            break
        kind, end = m.lastgroup, m.end()
        if kind == "nl":
            if not depth:
                if out.types and out.types[-1] not in ("NL", "INDENT", "DEDENT"):
                    out.add("NL", at, end)
                fresh = True
        elif kind == "comment":
            out.comments.append((at, end))
        elif kind == "pre":
            end = string(at, m)
            if end < 0:
                out.add("BAD", at, m.end())
                break
        elif kind == "op":
            word = m.group()
            depth = max(0, depth + (word in "([{") - (word in ")]}"))
            out.add(word, at, end)
        elif kind != "space":
            word = m.group()
            if kind == "num" and end < n and (text[end].isalpha() or text[end] == "_") and not re.compile(r"(?:and|or|in|is|if|else|for|not)\b").match(text, end):
                out.add("BAD", at, end)
                break
            out.add(word if word in PY_WORDS else kind.upper(), at, end)
        at = end
    if out.types and out.types[-1] not in ("NL", "DEDENT", "BAD"):
        out.add("NL", n, n)
    if not depth:
        for _ in indents[1:]:
            out.add("DEDENT", n, n)
    out.add("EOF", n, n)
    return out


# ---------------------------------------------------------------- Ruby

RUBY_WORDS = frozenset("alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__".split())
_RUBY = _master(
    space=r"[^\S\n]+|\\\r?\n", nl=r"\n", block=r"(?<![^\n])=begin\b[\s\S]*?\n=end\b[^\n]*", comment=r"#[^\n]*", stop=r"(?<![^\n])__END__\r?(?:\n[\s\S]*|$)", label=r"(?:[^\W\d]\w*[?!]?):(?!:)(?=[\s\S]|$)", ivar=r"@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|[0-9~*$?!@/\;,.=:_\"<>&`'+]|-\w)",
    id=r"[^\W\d]\w*(?:[?!](?![=~>])|[?!](?===))?", num=r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*", sym=r":(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*[?!]?|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+\-]@?|[*/%<>&|^~])", heredoc=r"<<[~-]?(?:[A-Z_]\w*|\"[^\"\n]+\"|'[^'\n]+'|`[^`\n]+`)",
    quote=r":?\"|:?'|`", op=_punct("**= <=> === ... <<= >>= &&= ||= && || ** == != >= <= << >> =~ !~ .. :: &. -> => += -= *= /= %= &= |= ^= { } [ ] ( ) ; : , . + - * / % & | ^ ~ ! = < > ?"),
)
_RUBY_VALUES = frozenset("ID CONST NUM STR SYM IVAR REGEX ) ] } end self nil true false __FILE__ __LINE__ __method__".split())
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def lex_ruby(text: str) -> Tokens:
    out, at, n, gap = Tokens(), 0, len(text), False
    types = out.types
    waiting: list[tuple[str, bool, bool]] = []  # heredocs that begin behind this line
    loop = -1  # bracket depth of a loop's head whose do is still due
    stack: list[str] = []

    def quoted(at: int, opening: str, closing: str, interpolates: bool) -> int:
        """Behind the closing delimiter; nested delimiters count, #{} is skipped with its own strings."""
        depth = 1
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
                continue
            if interpolates and text.startswith("#{", at):
                at = inner(at + 2)
                if at < 0:
                    return -1
                continue
            if c == closing:
                depth -= 1
                if not depth:
                    return at + 1
            elif c == opening and opening != closing:
                depth += 1
            at += 1
        return -1

    def inner(at: int) -> int:
        depth = 1
        while at < n:
            c = text[at]
            if c in "\"'`":
                at = quoted(at + 1, c, c, c != "'")
                if at < 0:
                    return -1
                continue
            depth += (c == "{") - (c == "}")
            at += 1
            if not depth:
                return at
        return -1

    while at < n:
        last = types[-1] if types else "NL"
        c = text[at]
        value = last in _RUBY_VALUES
        if c == "%" and (not value or (gap and last in ("ID", "CONST") and text[at + 1 : at + 2] not in (" ", "=", "\n"))):
            m = re.compile(r"%([qQwWiIrsx]?)([^\w\s])").match(text, at)
            if m:
                end = quoted(m.end(), m[2], _CLOSERS.get(m[2], m[2]), m[1] in ("", "Q", "W", "I", "r", "x"))
                if end < 0:
                    out.add("BAD", at, m.end(), False, gap)
                    break
                if m[1] == "r":
                    while end < n and text[end].isalpha():
                        end += 1
                out.add("STR", at, end, False, gap)
                gap, at = False, end
                continue
        if c == "/" and (not value or (gap and last == "ID" and text[at + 1 : at + 2] not in (" ", "=", "\n"))):
            end = at + 1
            while end < n and text[end] not in "/\n":
                if text[end] == "\\":
                    end += 1
                elif text[end] == "[":
                    close = re.compile(r"\[(?:[^\]\\\n]|\\.)*\]").match(text, end)
                    if close:
                        end = close.end() - 1
                end += 1
            if end < n and text[end] == "/":
                end += 1
                while end < n and text[end].isalpha():
                    end += 1
                out.add("REGEX", at, end, False, gap)
                gap, at = False, end
                continue
            out.add("BAD", at, at + 1, False, gap)
            break
        if c == "?" and not value:
            m = re.compile(r"\?(?:\\.|\S)(?!\w)").match(text, at)
            if m:
                out.add("STR", at, m.end(), False, gap)
                gap, at = False, m.end()
                continue
        m = _RUBY.match(text, at)
        if m is None:
            out.add("BAD", at, at + 1, False, gap)
            break
        kind, end, word = m.lastgroup, m.end(), m.group()
        if kind == "space":
            gap, at = True, end
            continue
        if kind in ("comment", "block", "stop"):
            out.comments.append((at, end))
            at = end
            continue
        if kind == "nl":
            at = end
            failed = False
            for tag, loose, raw in waiting:
                while True:
                    stop = text.find("\n", at)
                    line = text[at : stop if stop >= 0 else n]
                    at = stop + 1 if stop >= 0 else n
                    if (line.strip() if loose else line.rstrip("\r")) == tag:
                        break
                    if stop < 0:
                        failed = True
                        break
            waiting.clear()
            if failed:
                out.add("BAD", at, at, False, gap)
                break
            loop = -1
            if not stack or stack[-1] == "{":
                ahead = re.compile(r"(?:[^\S\n]|\n|#[^\n]*\n)*(?:\.(?!\.)|&\.)").match(text, at)
                if not ahead and last != "NL":
                    out.add("NL", end - 1, end, False, gap)
            gap = True
            continue
        if kind == "heredoc":
            quoted_tag = word.lstrip("<~-")
            squiggle = word[2] in "~-"
            if (value and not gap) or (value and last != "ID") or (value and gap and last == "ID" and not squiggle and quoted_tag[:1] not in "\"'"):
                kind, end, word = "op", at + 2, "<<"
            else:
                waiting.append((quoted_tag.strip("\"'`"), squiggle, quoted_tag[:1] == "'"))
                kind = "STR"
        elif kind == "quote":
            q = word[-1]
            end = quoted(end, q, q, q != "'")
            if end < 0:
                out.add("BAD", at, at + 1, False, gap)
                break
            kind = "STR"
            if word[0] != ":" and text.startswith(":", end) and not text.startswith("::", end) and last in ("{", ",", "(", "NL", "|"):
                kind, end = "LABEL", end + 1
        elif kind == "label":
            # a ternary's a ? b : c has blanks around its colon; word: glued to the colon is a label unless a value is due
            if last == "?" or (stack and stack[-1] == "?"):
                kind, end, word = "id", end - 1, word[:-1]
        if kind == "id":
            if last in (".", "&.") or (last == "def" and word not in ("self",)):
                kind = "ID"
            elif word in RUBY_WORDS:
                kind = word
                if word in ("while", "until", "for") and not value:
                    loop = len(stack)
                elif word == "do" and loop == len(stack):
                    kind, loop = "LOOPDO", -1
            else:
                kind = "CONST" if word[0].isupper() else "ID"
            if word == "defined" and text.startswith("?", end):
                kind, end = "defined?", end + 1
        elif kind == "op":
            kind = word
            if word in ("(", "[", "{"):
                stack.append(word)
            elif word in (")", "]", "}"):
                if stack:
                    stack.pop()
        elif kind in ("label", "ivar", "num", "sym"):
            kind = kind.upper()
        out.add(kind, at, end, False, gap)
        gap, at = False, end
    if waiting:
        out.add("BAD", n, n)
    if types and types[-1] != "NL":
        out.add("NL", n, n)
    out.add("EOF", n, n, True, True)
    return out
