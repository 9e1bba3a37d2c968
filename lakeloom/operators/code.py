"""Structure of source code: chunks, classes, functions, inheritance, variables, outlines.

Python sources are read by their syntax tree, others by braces; both scan whole texts over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking, graph
from .rules import import_references, python_symbols, spread
from .segments import line_rows


def file_chunks(files: DataFrame, size: int, hard: bool = True) -> DataFrame:
    """``path, chunk, first_line, lines, content`` of many files (``path, text``): each is cut where no bracket, string or comment is open."""
    rows = chunking.code_chunks(files.select(F.col("path").alias("id"), "text"), size, hard)
    from pyspark.sql import Window

    n = F.size(F.split("content", "\n"))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(F.col("id").alias("path"), "chunk", (before + 1).alias("first_line"), n.alias("lines"), "content")


def symbol_chunks(sources: DataFrame, kind: str, nested: bool = True) -> DataFrame:
    """``id, chunk, name, first_line, last_line, content`` of the classes or functions of Python sources, in their order; without ``nested`` the outermost ones only."""
    from pyspark.sql import Window

    found = python_symbols(sources).where(F.col("kind") == kind)
    if not nested:
        found = found.where("parent is null")
    held = found.join(sources.select("id", "text"), "id")
    content = F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("end") - F.col("line") + 1), "\n")
    return held.select("id", F.row_number().over(Window.partitionBy("id").orderBy("line", "end")).alias("chunk"), "name", F.col("line").alias("first_line"), F.col("end").alias("last_line"), content.alias("content"))


def brace_chunks(sources: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """``id, chunk, name, first_line, last_line``: declarations of brace languages that begin with one of the keywords, in closing order.

    ``;`` before the brace cancels a declaration; one that never closes runs to the end. Strings and comments do not count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        skip = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
        token = re.compile(rf"(?P<skip>{skip})|(?P<kw>\b(?:{'|'.join(keywords)})\s+(?P<name>[A-Za-z_]\w*))|(?P<mark>[{{}};])", re.S)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                text = text or ""
                waiting, stack, closed = None, [], []
                line_of = lambda at, t=text: t.count("\n", 0, at) + 1
                for m in token.finditer(text):
                    if m["kw"]:
                        waiting = (m["name"], line_of(m.start()))
                    elif m["mark"] == ";":
                        waiting = None
                    elif m["mark"] == "{":
                        stack.append(waiting)
                        waiting = None
                    elif m["mark"] == "}" and stack:
                        own = stack.pop()
                        if own:
                            closed.append((*own, line_of(m.start())))
                closed += [(*own, text.count("\n") + 1) for own in reversed(stack) if own]
                out += [(i, k + 1, *c) for k, c in enumerate(closed)]
            yield pd.DataFrame(out, columns=["id", "chunk", "name", "first_line", "last_line"])

    return spread(sources).mapInPandas(run, f"id {dict(sources.dtypes)['id']}, chunk int, name string, first_line int, last_line int")


def class_bases(sources: DataFrame) -> DataFrame:
    """``id, name, base``: classes of Python sources and their bases by last name; a class without any has a null base."""
    rows = line_rows(sources)
    head = r"^\s*class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*:"
    found = rows.withColumns({"name": F.regexp_extract("line", head, 1), "_b": F.regexp_extract("line", head, 2)}).where("name <> ''")
    each = found.select("id", "name", F.explode_outer(F.filter(F.transform(F.split("_b", ","), lambda b: F.element_at(F.split(F.trim(b), r"\."), -1)), lambda b: (b != "") & ~F.contains(b, F.lit("=")))).alias("base"))
    return each.distinct()


def inheritance_groups(bases: DataFrame) -> DataFrame:
    """``id, name, group_name, depth``: classes of one source that are tied by inheritance, named by the first; depth 1 without a known base, on a cycle as well, else one more than the deepest base."""
    known = bases.select("id", "name").distinct()
    node = lambda c: F.concat_ws("/", F.col("id").cast("string"), c)
    edges = bases.join(known.select("id", F.col("name").alias("base")), ["id", "base"]).where("name <> base")
    groups = graph.components(edges.select(node(F.col("name")).alias("a"), node(F.col("base")).alias("b")))
    parents = known.join(edges.select("id", "name", "base"), ["id", "name"], "left").select(node(F.col("name")).alias("node"), F.when(F.col("base").isNotNull(), node(F.col("base"))).alias("parent"))
    depth = graph.depths(parents).groupBy("node").agg((F.max("depth") + 1).alias("depth"))
    own = known.withColumn("_node", node(F.col("name")))
    out = own.join(groups, own["_node"] == groups["node"], "left").drop("node").join(depth, F.col("_node") == depth["node"])
    return out.select("id", "name", F.coalesce(F.element_at(F.split("component", "/"), -1), F.col("name")).alias("group_name"), "depth")


def is_code_line(line: Column) -> Column:
    """Whether a line looks like code: a keyword at its head, an end mark of code, an assignment, a call alone, or a comment sign."""
    line = F.coalesce(line, F.lit(""))
    return (
        line.rlike(r"^\s*(def|class|import|from|return|if|elif|else|for|while|try|except|with|public|private|static|void|int|func|function|const|let|var|#include)\b.*[:;{(\"<)]?\s*$") & line.rlike(r"[:;{}()=<\"]")
    ) | line.rlike(r"[;{}]\s*$") | line.rlike(r"^\s*[A-Za-z_][\w.\[\]]*\s*[-+*/]?=\s*\S") | line.rlike(r"^\s*[A-Za-z_][\w.]*\([^)]*\)\s*;?$") | line.rlike(r"^\s*(//|#!|/\*|\*/)")


def code_share(text: Column) -> Column:
    """Share of the lines that are not blank which look like code."""
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda r: F.trim(r) != "")
    return F.size(F.filter(rows, is_code_line)) / F.greatest(F.size(rows), F.lit(1))


def structures(docs: DataFrame, code_lines: int, paragraphs: int) -> DataFrame:
    """``id, kind, chunk, content``: code (half of the lines look like it) in chunks of lines, other texts in groups of paragraphs."""
    held = docs.withColumn("_code", code_share(F.col("text")) >= 0.5)
    code = chunking.code_chunks(held.where("_code"), code_lines)
    text = chunking.grouped(chunking.pattern_parts(held.where("not _code and text is not null"), r"\n\s*\n+", False), paragraphs, "\n\n")
    return code.select("id", F.lit("code").alias("kind"), "chunk", "content").unionByName(text.select("id", F.lit("text").alias("kind"), "chunk", "content"))


def outline(sources: DataFrame) -> DataFrame:
    """``folder, files, lines, classes, functions, imports`` of Python sources (``id, path, text``) by folder."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    files = sources.select("id", folder.alias("folder"), F.size(F.split("text", "\n")).alias("lines"))
    counted = python_symbols(sources).groupBy("id").agg(F.count(F.when(F.col("kind") == "class", 1)).alias("classes"), F.count(F.when(F.col("kind") == "function", 1)).alias("functions"))
    imports = import_references(sources).groupBy("id").agg(F.count("*").alias("imports"))
    out = files.join(counted, "id", "left").join(imports, "id", "left").fillna(0, ["classes", "functions", "imports"])
    return out.groupBy("folder").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("lines", "classes", "functions", "imports")))


def variables(sources: DataFrame) -> DataFrame:
    """``id, scope, depth, kind, name, line``: parameters, locals, fields and globals of Python sources by their syntax tree; unparsable ones have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        def walk(node, scope, inside, out):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                    name = getattr(child, "name", "lambda")
                    own = [*scope, name]
                    args = child.args
                    for a in [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]:
                        out.append((".".join(own), len(own), "parameter", a.arg, a.lineno if hasattr(a, "lineno") else child.lineno))
                    walk(child, own, "function", out)
                elif isinstance(child, ast.ClassDef):
                    walk(child, [*scope, child.name], "class", out)
                else:
                    if isinstance(child, ast.Name) and isinstance(child.ctx, ast.Store):
                        kind = {"function": "local", "class": "field", "module": "global"}[inside]
                        out.append((".".join(scope), len(scope), kind, child.id, child.lineno))
                    elif isinstance(child, ast.Attribute) and isinstance(child.ctx, ast.Store) and isinstance(child.value, ast.Name) and child.value.id == "self":
                        out.append((".".join(scope), len(scope), "field", child.attr, child.lineno))
                    walk(child, scope, inside, out)

        for pdf in batches:
            rows: list = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                found: list = []
                try:
                    walk(ast.parse(text or ""), [], "module", found)
                except (SyntaxError, ValueError):
                    continue
                first: dict = {}
                for scope, depth, kind, name, line in found:
                    key = (scope, depth, kind, name)
                    first[key] = min(line, first.get(key, line))
                rows += [(i, *k, line) for k, line in first.items()]
            yield pd.DataFrame(rows, columns=["id", "scope", "depth", "kind", "name", "line"])

    return spread(sources).mapInPandas(run, f"id {dict(sources.dtypes)['id']}, scope string, depth int, kind string, name string, line int")


def loop_data(sources: DataFrame) -> DataFrame:
    """``id, line, kind, names``: loops of Python sources with the names that their bodies read, which count for every enclosing loop."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
                        names = sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)})
                        out.append((i, node.lineno, "while" if isinstance(node, ast.While) else "for", names))
            yield pd.DataFrame(out, columns=["id", "line", "kind", "names"])

    return spread(sources).mapInPandas(run, f"id {dict(sources.dtypes)['id']}, line int, kind string, names array<string>")


def symbols(text: Column, most: int = 0) -> Column:
    """Names that a text defines or writes in code form, in order, once each: ``def``, ``class`` and ``func`` names, then identifiers with an underscore or inner capitals."""
    text = F.coalesce(text, F.lit(""))
    defined = F.regexp_extract_all(text, F.lit(r"\b(?:def|class|func|function)\s+([A-Za-z_]\w*)"), F.lit(1))
    written = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]+_\w+|[a-z]+[A-Z]\w*)\b"), F.lit(1))
    found = F.array_distinct(F.concat(defined, written))
    return F.slice(found, 1, most) if most else found
