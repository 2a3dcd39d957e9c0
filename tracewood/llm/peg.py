"""Parsing-expression grammars over tokens, compiled to packrat parsers.

Notation: ``rule <- expression``; ``/`` ordered choice, ``* + ?`` repetition, ``& !`` lookahead, ``( )`` grouping, quoted
literals and UPPERCASE names for token types, ``.`` any token but EOF, ``@nl`` / ``@same`` a line break / none before the
next token, ``@gap`` / ``@glued`` white space / none before it. ``rule <~ ...`` is not memoised (cheap rules).

A grammar becomes one Python function: rules are closures that take a position and give the position behind the match or
-1; results are kept per rule and position, so parsing is linear. Choices first look at the next token where the first
sets allow it. A second build of the same grammar also records the furthest position at which a token was refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count

_ITEM = re.compile(r"\s*(?:(#[^\n]*)|(\"[^\"]*\"|'[^']*')|(@\w+)|(\w+)|(<-|<~|[/*+?&!().]))")
ANY = None  # an unknown first set


@dataclass
class Node:
    kind: str
    items: tuple = ()


def _read(text: str) -> dict[str, tuple[bool, Node]]:
    parts, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _ITEM.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        at = m.end()
        if not m[1]:
            parts.append(m[0].strip())
    parts.append("")
    rules: dict[str, tuple[bool, Node]] = {}
    i = 0

    def choice() -> Node:
        nonlocal i
        options = [sequence()]
        while parts[i] == "/":
            i += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else Node("alt", tuple(options))

    def sequence() -> Node:
        nonlocal i
        items = []
        while parts[i] not in ("", "/", ")") and parts[i + 1 : i + 2] not in (["<-"], ["<~"]):
            items.append(prefixed())
        return items[0] if len(items) == 1 else Node("seq", tuple(items))

    def prefixed() -> Node:
        nonlocal i
        if parts[i] in "&!":
            kind = "and" if parts[i] == "&" else "not"
            i += 1
            return Node(kind, (prefixed(),))
        node = atom()
        while parts[i] in ("*", "+", "?"):
            node = Node({"*": "star", "+": "plus", "?": "opt"}[parts[i]], (node,))
            i += 1
        return node

    def atom() -> Node:
        nonlocal i
        part = parts[i]
        i += 1
        if part == "(":
            node = choice()
            if parts[i] != ")":
                raise ValueError(f"grammar: ')' missing before {parts[i : i + 4]}")
            i += 1
            return node
        if part[0] in "\"'":
            return Node("tok", (part[1:-1],))
        if part == ".":
            return Node("any")
        if part[0] == "@":
            return Node(part)
        return Node("tok", (part,)) if part.isupper() else Node("rule", (part,))

    while parts[i]:
        name, arrow = parts[i], parts[i + 1]
        i += 2
        rules[name] = (arrow == "<-", choice())
    return rules


class Grammar:
    def __init__(self, text: str, start: str = "file") -> None:
        self.rules, self.start = _read(text), start
        for _, body in self.rules.values():
            self._known(body)
        self.empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        self.firsts: dict[str, set | None] = {r: set() for r in self.rules}
        changed = True
        while changed:
            changed = False
            for name, (_, body) in self.rules.items():
                e, f = self._empty(body), self._first(body)
                if e != self.empty[name] or f != self.firsts[name]:
                    self.empty[name], self.firsts[name], changed = e, f, True
        self.literals = {t for _, body in self.rules.values() for t in self._tokens(body)}
        self._built: dict[bool, object] = {}

    def _known(self, node: Node) -> None:
        if node.kind == "rule" and node.items[0] not in self.rules:
            raise ValueError(f"grammar: no rule {node.items[0]}")
        for x in node.items:
            if isinstance(x, Node):
                self._known(x)

    def _tokens(self, node: Node):
        if node.kind == "tok":
            yield node.items[0]
        for x in node.items:
            if isinstance(x, Node):
                yield from self._tokens(x)

    def _empty(self, n: Node) -> bool:
        if n.kind == "rule":
            return self.empty[n.items[0]]
        if n.kind == "seq":
            return all(map(self._empty, n.items))
        if n.kind == "alt":
            return any(map(self._empty, n.items))
        return n.kind in ("star", "opt", "and", "not") or n.kind[0] == "@" or (n.kind == "plus" and self._empty(n.items[0]))

    def _first(self, n: Node) -> set | None:
        """Tokens a match may begin with; None if unknown. Empty matches add nothing here and are asked for apart."""
        if n.kind == "tok":
            return {n.items[0]}
        if n.kind == "rule":
            return self.firsts[n.items[0]]
        if n.kind in ("star", "opt", "plus"):
            return self._first(n.items[0])
        if n.kind in ("not",) or n.kind[0] == "@":
            return set()
        if n.kind == "alt":
            out: set = set()
            for x in n.items:
                f = self._first(x)
                if f is None:
                    return None
                out |= f
            return out
        if n.kind == "seq":
            out = set()
            for x in n.items:
                if x.kind == "and":
                    continue
                f = self._first(x)
                if f is None:
                    return None
                out |= f
                if not self._empty(x):
                    return out
            return out
        return None

    def build(self, track: bool = False):
        """``parse(types, breaks, gaps)`` giving the end position or -1, and the furthest refused position (0 untracked)."""
        if track not in self._built:
            self._built[track] = _Build(self, track).function
        return self._built[track]


class _Build:
    def __init__(self, grammar: Grammar, track: bool) -> None:
        self.g, self.track, self.names, self.consts, self.lines = grammar, track, count(), {}, []
        self.lines.append("def parse(T, N, G):")
        self.lines.append(" far = 0")
        for name, (keep, body) in grammar.rules.items():
            if keep:
                self.lines.append(f" M_{name} = {{}}")
            self.lines.append(f" def r_{name}(p):")
            if track:
                self.lines.append("  nonlocal far")
            if keep:
                self.lines += [f"  q = M_{name}.get(p)", "  if q is not None: return q", "  s = p"]
            self.clear = [f"M_{r}" for r, (k, _) in grammar.rules.items() if k and r != grammar.start] if name == grammar.start else []
            self.emit(body, 2)
            if keep:
                self.lines.append(f"  M_{name}[s] = p")
            self.lines.append("  return p")
        self.lines.append(f" return r_{grammar.start}(0), far")
        space = dict(self.consts.values())
        exec("\n".join(self.lines), space)  # noqa: S102 - the code comes from the grammars of this package
        self.function = space["parse"]

    def const(self, tokens: set) -> str:
        key = frozenset(tokens)
        if key not in self.consts:
            self.consts[key] = (f"S{len(self.consts)}", key)
        return self.consts[key][0]

    def out(self, depth: int, text: str) -> None:
        self.lines.append(" " * depth + text)

    def refuse(self, depth: int, test: str) -> None:
        if self.track:
            self.out(depth, f"if {test}: p += 1")
            self.out(depth, "else:")
            self.out(depth + 1, "if p > far: far = p")
            self.out(depth + 1, "p = -1")
        else:
            self.out(depth, f"p = p + 1 if {test} else -1")

    def emit(self, n: Node, d: int) -> None:
        k = n.kind
        if k == "tok":
            self.refuse(d, f"T[p] == {n.items[0]!r}")
        elif k == "any":
            self.refuse(d, "T[p] != 'EOF'")
        elif k == "@nl":
            self.out(d, "if not N[p]: p = -1")
        elif k == "@same":
            self.out(d, "if N[p]: p = -1")
        elif k == "@gap":
            self.out(d, "if not G[p]: p = -1")
        elif k == "@glued":
            self.out(d, "if G[p]: p = -1")
        elif k == "rule":
            name = n.items[0]
            first = self.g.firsts[name]
            if first and not self.g.empty[name] and not self.track:
                self.out(d, f"p = r_{name}(p) if T[p] in {self.const(first)} else -1")
            else:
                self.out(d, f"p = r_{name}(p)")
        elif k == "seq":
            for i, x in enumerate(n.items):
                self.emit(x, d + i)
                if i + 1 < len(n.items):
                    self.out(d + i, "if p >= 0:")
            if not n.items:
                self.out(d, "pass")
        elif k == "alt":
            if all(x.kind == "tok" for x in n.items):
                self.refuse(d, f"T[p] in {self.const({x.items[0] for x in n.items})}")
                return
            v = f"v{next(self.names)}"
            self.out(d, f"{v} = p")
            for i, x in enumerate(n.items):
                first = self.g._first(x)
                guard = [] if i == 0 else ["p < 0"]
                if first and not self.g._empty(x) and not self.track:
                    guard.append(f"T[{v}] in {self.const(first)}" if len(first) > 1 else f"T[{v}] == {next(iter(first))!r}")
                if i == 0 and not guard:
                    self.emit(x, d)
                    continue
                if i == 0:
                    self.out(d, "p = -1")
                self.out(d, f"if {' and '.join(guard)}:")
                self.out(d + 1, f"p = {v}")
                self.emit(x, d + 1)
        elif k in ("star", "plus"):
            v, w = f"v{next(self.names)}", f"v{next(self.names)}"
            if k == "plus":
                self.out(d, f"{w} = p")
            self.out(d, "while True:")
            self.out(d + 1, f"{v} = p")
            self.emit(n.items[0], d + 1)
            self.out(d + 1, f"if p <= {v}:")
            self.out(d + 2, f"p = {v}")
            self.out(d + 2, "break")
            if self.clear:  # nothing goes back behind a whole item of the start rule
                self.out(d + 1, f"if p - {v} > 16:")
                self.out(d + 2, f"for m in ({', '.join(self.clear)},): m.clear()")
            if k == "plus":
                self.out(d, f"if p == {w}: p = -1")
        elif k == "opt":
            v = f"v{next(self.names)}"
            first = self.g._first(n.items[0])
            if first and not self.g._empty(n.items[0]) and not self.track:
                self.out(d, f"if T[p] in {self.const(first)}:")
                d += 1
            self.out(d, f"{v} = p")
            self.emit(n.items[0], d)
            self.out(d, f"if p < 0: p = {v}")
        elif k in ("and", "not"):
            v = f"v{next(self.names)}"
            self.out(d, f"{v} = p")
            self.emit(n.items[0], d)
            self.out(d, f"p = {v} if p {'>=' if k == 'and' else '<'} 0 else -1")
        else:
            raise ValueError(k)
