"""Labels, rewards and checks as column expressions; conversations; parsers of code and marked text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens

#: Word lists of the labels.
REQUEST = ("please", "could", "would", "can")
DIRECTIVE = ("must", "should", "need", "do")
POSITIVE = ("good", "great", "love", "nice", "happy")
NEGATIVE = ("bad", "hate", "awful", "sad", "angry")
FILLERS = ("um", "uh", "like", "so", "well")
PRONOUNS = {"first": ("i", "me", "my", "we", "us", "our"), "second": ("you", "your", "yours"), "third": ("he", "she", "they", "them", "his", "her", "their", "it")}


def bands(value: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """The name of the first step that the value does not exceed, else ``top``."""
    out = None
    for most, name in steps:
        out = F.when(value <= most, name) if out is None else out.when(value <= most, name)
    return out.otherwise(top)


def count_in(words: Column, listed: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def intent(text: Column) -> Column:
    """question, request, directive or statement; the first that applies."""
    words = tokens(text)
    return F.when(F.endswith(F.trim(text), F.lit("?")), "question").when(count_in(words, REQUEST) > 0, "request").when(count_in(words, DIRECTIVE) > 0, "directive").otherwise("statement")


def sentiment(text: Column) -> Column:
    words = tokens(text)
    p, n = count_in(words, POSITIVE), count_in(words, NEGATIVE)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def perspective(text: Column) -> Column:
    """The person whose pronouns are most frequent; ``mixed`` at a tie, ``unknown`` without any."""
    words = tokens(text)
    counts = {k: count_in(words, v) for k, v in PRONOUNS.items()}
    top = F.greatest(*counts.values())
    leaders = sum((F.when(c == top, 1).otherwise(0) for c in counts.values()), F.lit(0))
    out = F.when(top == 0, "unknown").when(leaders > 1, "mixed")
    for k, c in counts.items():
        out = out.when(c == top, k)
    return out


def fluency(text: Column) -> Column:
    """1 less 0.6 of the share of fillers and 0.4 of the share of words that repeat the one before, within 0 and 1."""
    words = tokens(text)
    n = F.greatest(F.size(words), F.lit(1))
    repeats = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.get(words, i - 1).eqNullSafe(F.get(words, i - 2)) & (i <= F.size(words))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.6 * count_in(words, FILLERS) / n - 0.4 * repeats / n))


def pause_ms(text: Column, short: int = 200, long: int = 500) -> Column:
    """Pause behind a segment: by its last mark, shorter after six words at most and longer after twenty."""
    n, end = F.size(tokens(text)), F.substring(F.trim(text), -1, 1)
    base = F.when(end.isin(".", "!", "?"), long).when(end.isin(",", ";", ":"), short).otherwise(0)
    return F.greatest(F.lit(0), base + F.when(n <= 6, -80).when(n >= 20, 120).otherwise(0))


def missing_required(found: DataFrame, required: list[str]) -> DataFrame:
    """``id, missing, allowed`` from ``id, term``: which required terms a document lacks."""
    lacks = F.array_sort(F.array_except(F.array(*(F.lit(t) for t in required)), F.collect_set("term")))
    return found.groupBy("id").agg(lacks.alias("missing")).withColumn("allowed", F.size("missing") == 0)


def citation_errors(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``id, citation``: bracketed citations that name no evidence of the answer."""
    cited = answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1)))).alias("citation"))
    return cited.join(evidence.select("id", F.col("evidence_id").alias("citation")), ["id", "citation"], "left_anti")


def context_block(items: DataFrame, by: list[str], order: str, per_item: int, total: int) -> DataFrame:
    """``..., context``: items cut to ``per_item`` characters, in order, until ``total`` is used up; the last one is cut to fit."""
    w = Window.partitionBy(*by).orderBy(order)
    cut = items.withColumn("_c", F.substring("content", 1, per_item))
    cut = cut.withColumn("_before", F.coalesce(F.sum(F.length("_c")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < total)
    cut = cut.withColumn("_c", F.substring("_c", F.lit(1), (total - F.col("_before")).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_c").alias("c")))), lambda x: x["c"]), "\n\n")
    return cut.groupBy(*by).agg(joined.alias("context"))


def conversation_segments(docs: DataFrame) -> DataFrame:
    """``id, index, speaker, content``: lines with ``Name:`` or behind a blank line begin a segment."""
    rows = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    speaker = F.regexp_extract("line", r"^\s*([A-Z][A-Za-z0-9_ ]{0,30}):\s+", 1)
    w = Window.partitionBy("id").orderBy("pos")
    blank = F.trim("line") == ""
    starts = (speaker != "") | F.coalesce(F.lag(blank).over(w), F.lit(True))
    rows = rows.withColumns({"_s": F.when(starts & ~blank, 1).otherwise(0), "speaker": F.when(speaker != "", speaker), "_blank": blank})
    rows = rows.withColumn("index", F.sum("_s").over(w)).where("not _blank")
    body = F.regexp_replace("line", r"^\s*[A-Z][A-Za-z0-9_ ]{0,30}:\s+", "")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(body).alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy("id", "index").agg(F.first("speaker", ignorenulls=True).alias("speaker"), parts.alias("content"))


def import_references(sources: DataFrame) -> DataFrame:
    """``id, line, module``: import lines of common languages."""
    rows = sources.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    patterns = [r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)", r"^\s*#include\s*[<\"]([^>\"]+)", r"^\s*use\s+([\w:]+)", r"require\(\s*['\"]([^'\"]+)", r"\bfrom\s+['\"]([^'\"]+)"]
    hit = F.coalesce(*(F.nullif(F.regexp_extract("l", p, 1), F.lit("")) for p in patterns))
    return rows.select("id", (F.col("pos") + 1).alias("line"), hit.alias("module")).where("module is not null")


def spread(sources: DataFrame) -> DataFrame:
    """``id, text`` dealt out to as many tasks as shuffles have partitions: a small file of sources is much work, and would be one task's."""
    return sources.select("id", "text").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def python_symbols(sources: DataFrame) -> DataFrame:
    """``id, kind, name, line, end, parent, calls``: functions, classes and loops of Python sources, by their syntax tree; unparsable ones have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop"}

        def walk(node, parent, i, out):
            """Appends what is below a node, and returns the names called there."""
            called = set()
            for child in ast.iter_child_nodes(node):
                kind, at = kinds.get(type(child)), len(out)
                name = (getattr(child, "name", None) or type(child).__name__.lower()) if kind else None
                if kind:
                    out.append(None)
                below = walk(child, name if kind in ("function", "class") else parent, i, out)
                if isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                    below.add(child.func.id if isinstance(child.func, ast.Name) else child.func.attr)
                if kind:
                    out[at] = (i, kind, name, child.lineno, child.end_lineno, parent, sorted(below))
                called |= below
            return called

        for pdf in batches:
            out: list = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                try:
                    walk(ast.parse(text or ""), None, i, out)
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["id", "kind", "name", "line", "end", "parent", "calls"])

    kind = dict(sources.dtypes)["id"]
    return spread(sources).mapInPandas(run, f"id {kind}, kind string, name string, line int, end int, parent string, calls array<string>")


def leader_clusters(rows: DataFrame, least: float, most: int) -> DataFrame:
    """``group, id, cluster``: one pass over each group's token sets (``group, pos, id, terms``) in order.

    A row joins the most similar cluster whose leader has a Jaccard similarity of ``least``, or leads a new one
    while there are fewer than ``most``; else it has none. A group is one sequence, so it is one task's work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[frozenset] = []
        found = []
        for terms in pdf.sort_values("pos")["terms"]:
            own = frozenset(terms)
            scores = [len(own & x) / max(1, len(own | x)) for x in leaders]
            best = max(range(len(scores)), key=lambda k: (scores[k], -k), default=-1)
            if best >= 0 and scores[best] >= least:
                found.append(best)
            elif len(leaders) < most:
                leaders.append(own)
                found.append(len(leaders) - 1)
            else:
                found.append(None)
        out = pdf.sort_values("pos")[["group", "id"]].copy()
        out["cluster"] = pd.array(found, dtype="Int64")
        return out

    kinds = dict(rows.dtypes)
    return rows.groupBy("group").applyInPandas(run, f"group {kinds['group']}, id {kinds['id']}, cluster long")


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.posexplode(sentences("text")).alias("pos", "sentence"))
