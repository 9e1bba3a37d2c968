"""Loops and variables of languages with braces, by a scanner with a stack of open blocks.

Comments and strings are skipped; a header waits for its block, or for the one statement that stands in its place.
C, C++, C#, Java, Go, JavaScript and TypeScript read alike here; it is a reading of tokens, not of grammars.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .rules import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|#[a-z][^\n]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>[0-9][\w.]*)|(?P<mark>:=|=>|==|!=|<=|>=|[-+*/%&|^]=|\+\+|--|.)", re.S)
#: Words that declare variables, open loops, functions or classes, or are no names.
DECLARE = frozenset("let const var auto int long short float double bool boolean char byte string String void unsigned size_t".split())
LOOPS = frozenset("for while do".split())
CLASSES = frozenset("class struct interface enum".split())
FUNCTIONS = frozenset("function func fn".split())
NO_NAMES = DECLARE | LOOPS | CLASSES | FUNCTIONS | frozenset("if else switch case default break continue return new delete in of range public private protected static final this self null nil true false import package using namespace try catch finally throw throws async await yield typeof instanceof extends implements type".split())


@dataclass
class Block:
    """An open block, or a header that waits for its own: a loop, function, class, or anything else in braces."""

    kind: str
    name: str = ""
    line: int = 0
    braced: bool = False
    depth: int = 0
    names: set[str] = field(default_factory=set)


def tokens_of(text: str) -> list[tuple[str, str, int]]:
    """``kind, text, line`` without white space, comments and strings, which leave a mark ``""``."""
    out, line = [], 1
    for m in TOKEN.finditer(text):
        kind, said = m.lastgroup or "mark", m[0]
        if kind == "skip":
            if said[0] in "\"'`":
                out.append(("mark", '""', line))
        elif not said.isspace():
            out.append((kind, said, line))
        line += said.count("\n")
    return out


def closing(tokens: list[tuple[str, str, int]], at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``, or the end."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k][1] == "(") - (tokens[k][1] == ")")
        if not depth:
            return k
    return len(tokens)


def scan(text: str) -> tuple[list[tuple[int, str, list[str]]], list[tuple[str, int, str, str, int]]]:
    """Loops (line, kind, names that they read) and variables (scope, depth, kind, name, line) of a source.

    A name is read unless it is only given a value or declared, or follows a dot. What an inner loop reads counts for the outer ones. A ``do`` loop's condition is its own.
    """
    tokens = tokens_of(text)
    at_ = lambda k: tokens[k][1] if 0 <= k < len(tokens) else ""
    stack: list[Block] = []
    loops: list[Block] = []
    variables: list[tuple[str, int, str, str, int]] = []
    waiting: Block | None = None
    parens = header_end = 0

    def scopes() -> list[str]:
        return [b.name for b in stack if b.kind in ("function", "class") and b.name]

    def add(kind: str, name: str, line: int, own: list[str]) -> None:
        variables.append((".".join(own), len(own), kind, name, line))

    def inside() -> str:
        return next((b.kind for b in reversed(stack) if b.kind in ("function", "class")), "module")

    def leave_statement() -> None:
        while stack and not stack[-1].braced and stack[-1].depth == parens:
            ended = stack.pop()
            if ended.kind == "do":
                break

    def parameters(first: int, last: int, own: list[str]) -> None:
        part: list[int] = []
        for k in [*range(first, last), -1]:
            if k >= 0 and at_(k) != ",":
                part.append(k)
                continue
            ends = next((i for i, p in enumerate(part) if at_(p) in ("=", ":")), len(part))
            named = [p for p in part[:ends] if tokens[p][0] == "name" and tokens[p][1] not in NO_NAMES - {"self"}]
            typed = any(tokens[p][1] in DECLARE for p in part[:ends])
            if named:
                # C and Java name the type first, Go the parameter
                pick = named[-1] if typed and tokens[part[0]][1] in DECLARE or len(named) > 1 and tokens[named[0]][1][0].isupper() else named[0]
                add("parameter", at_(pick), tokens[pick][2], own)
            part = []

    skip_to = -1
    for k, (kind, said, line) in enumerate(tokens):
        if waiting is not None and k > header_end and said != "{":  # one statement in place of a block
            if waiting.kind in ("for", "while", "do"):
                waiting.depth = parens
                stack.append(waiting)
            waiting = None
        if said in "([":
            parens += 1
        elif said in ")]":
            parens -= 1
        elif said == "{":
            block = waiting or Block("other")
            block.braced, waiting = True, None
            block.depth = parens
            stack.append(block)
        elif said == "}":
            while stack and not stack[-1].braced:
                stack.pop()
            if stack:
                stack.pop()
            leave_statement()
        elif said == ";" and (waiting is None or k > header_end) and (not stack or parens <= stack[-1].depth):
            waiting = None
            leave_statement()
        if kind != "name" or k <= skip_to:
            continue
        before, after = at_(k - 1), at_(k + 1)
        if said in LOOPS:
            if said == "while" and before == "}" and loops and loops[-1].kind == "do" and loops[-1] not in stack:
                continue  # the condition of a do loop
            waiting = Block(said, line=line)
            loops.append(waiting)
            go = said == "for" and after != "("
            header_end = next((i - 1 for i in range(k, len(tokens)) if at_(i) == "{"), len(tokens)) if go else closing(tokens, k + 1) if after == "(" else k
            continue
        if said in CLASSES and tokens[k + 1 : k + 2] and tokens[k + 1][0] == "name":
            waiting = Block("class", at_(k + 1))
            header_end = next((i - 1 for i in range(k, len(tokens)) if at_(i) in ("{", ";")), len(tokens))
            skip_to = header_end
            continue
        typed = tokens[k - 1][0] == "name" and before not in NO_NAMES - DECLARE if k else False
        if after == "(" and said not in NO_NAMES and (before in FUNCTIONS or typed or inside() == "class"):
            end = closing(tokens, k + 1)
            brace = next((i for i in range(end + 1, min(end + 8, len(tokens))) if at_(i) in ("{", ";", "=", ")")), -1)
            if at_(brace) == "{":
                own = [*scopes(), said]
                parameters(k + 2, end, own)
                waiting, header_end, skip_to = Block("function", said), brace - 1, brace - 1
                continue
        if said in NO_NAMES or before == ".":
            continue
        declared = before in DECLARE or after == ":=" or (typed and after in ("=", ";") and before not in FUNCTIONS)
        if declared:
            add({"function": "local", "class": "field", "module": "global"}[inside()], said, line, scopes())
        elif after != "=" and not (tokens[k + 1 : k + 2] and tokens[k + 1][0] == "name"):
            for b in [*stack, *([waiting] if waiting else [])]:
                b.names.add(said)
    return [(b.line, b.kind, sorted(b.names)) for b in loops], sorted(set(variables), key=lambda v: (v[4], v))


def brace_loops(sources: DataFrame) -> DataFrame:
    """``id, line, kind, names``: loops of sources with braces and the names that they read, which count for every loop around them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *loop) for i, text in zip(pdf["id"], pdf["text"], strict=True) for loop in scan(text or "")[0]]
            yield pd.DataFrame(rows, columns=["id", "line", "kind", "names"])

    return spread(sources).mapInPandas(run, f"id {dict(sources.dtypes)['id']}, line int, kind string, names array<string>")


def brace_variables(sources: DataFrame) -> DataFrame:
    """``id, scope, depth, kind, name, line``: parameters, locals, fields and globals that sources with braces declare, where they first do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                first: dict = {}
                for *key, line in scan(text or "")[1]:
                    first.setdefault(tuple(key), line)
                rows += [(i, *key, line) for key, line in first.items()]
            yield pd.DataFrame(rows, columns=["id", "scope", "depth", "kind", "name", "line"])

    return spread(sources).mapInPandas(run, f"id {dict(sources.dtypes)['id']}, scope string, depth int, kind string, name string, line int")
