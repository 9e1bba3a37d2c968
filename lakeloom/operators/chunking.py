"""Chunkers: one row in, a row a chunk out, by array expressions where the rule has no memory.

All take ``id, text`` and return ``id, chunk int, content string`` and offsets where stated; texts without
content have no chunks. Chunks are computed in the row's own task; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines


def _starts(size: Column, step: int) -> Column:
    return F.explode(F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")))).alias("chunk")


def fixed_chars(docs: DataFrame, size: int) -> DataFrame:
    return docs.select("id", "text", _starts(F.length("text"), size)).select("id", "chunk", F.substring("text", F.col("chunk") * size + 1, F.lit(size)).alias("content"))


def sliding_chars(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters; tail windows are kept. Offsets start at 0 and include their ends."""
    step = size - overlap
    at = docs.select("id", "text", _starts(F.length("text"), step)).withColumn("first_char", F.col("chunk") * step)
    last = F.least(F.col("first_char") + size, F.length("text")) - 1
    return at.select("id", "chunk", F.substring("text", F.col("first_char") + 1, F.lit(size)).alias("content"), "first_char", last.alias("last_char"))


def sliding_lines(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` lines; line numbers start at 1 and include their ends."""
    step = size - overlap
    at = docs.where("text <> ''").select("id", lines("text").alias("l")).select("id", "l", _starts(F.size("l"), step))
    first = F.col("chunk") * step + 1
    return at.select("id", "chunk", F.array_join(F.slice("l", first, F.lit(size)), "\n").alias("content"), first.alias("first_line"), F.least(first + size - 1, F.size("l")).alias("last_line"))


def sliding_words(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` words between white space, joined by single spaces; tail windows are kept."""
    step = size - overlap
    at = docs.select("id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("w")).select("id", "w", _starts(F.size("w"), step))
    return at.select("id", "chunk", F.array_join(F.slice("w", F.col("chunk") * step + 1, F.lit(size)), " ").alias("content"))


def grouped(parts: DataFrame, size: int, joiner: str) -> DataFrame:
    """``size`` neighbours of an array column ``parts`` a chunk (sentences, paragraphs, lines, matches of a pattern)."""
    at = parts.select("id", "parts", _starts(F.size("parts"), size))
    return at.select("id", "chunk", F.array_join(F.slice("parts", F.col("chunk") * size + 1, F.lit(size)), joiner).alias("content"))


def variable_chars(docs: DataFrame, sizes: list[int], repeat: bool = True) -> DataFrame:
    """Chunks of the sizes in turn; without ``repeat`` the rest is one more chunk."""
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    period = ends[-1]
    at = docs.select("id", "text", F.length("text").alias("n")).where("n > 0")
    rounds = F.floor((F.col("n") - 1) / period).cast("int") if repeat else F.lit(0)
    begins = F.flatten(F.transform(F.sequence(F.lit(0), rounds), lambda r: F.array(*(F.struct((r * period + e - s).alias("a"), F.lit(s).alias("s")) for e, s in zip(ends, sizes, strict=True)))))
    if not repeat:
        begins = F.concat(begins, F.array(F.struct(F.lit(period).alias("a"), F.greatest(F.col("n") - period, F.lit(0)).alias("s"))))
    held = at.select("id", "text", F.posexplode(F.filter(begins, lambda b: b["a"] < F.col("n"))).alias("chunk", "b"))
    return held.select("id", "chunk", F.substring("text", F.col("b.a") + 1, F.col("b.s")).alias("content"))


def pattern_parts(docs: DataFrame, pattern: str, keep: bool) -> DataFrame:
    """``id, parts``: text cut at a separator pattern, which stays at the head of its part or goes."""
    if keep:
        parts = F.split("text", f"(?={pattern})")
    else:
        parts = F.split("text", pattern)
    return docs.select("id", F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "").alias("parts"))


def headings(docs: DataFrame) -> DataFrame:
    """``id, line, depth, title``: headings that begin with ``#``, outside of fenced code."""
    at = docs.select("id", F.posexplode(lines("text")).alias("pos", "content"))
    from pyspark.sql import Window

    fence = F.sum(F.when(F.col("content").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)).over(Window.partitionBy("id").orderBy("pos"))
    found = at.withColumn("open", fence % 2).where("open = 0").where(F.col("content").rlike(r"^#{1,6}\s+\S"))
    return found.select("id", (F.col("pos") + 1).alias("line"), F.length(F.regexp_extract("content", "^(#+)", 1)).alias("depth"), F.trim(F.regexp_replace("content", r"^#+\s*", "")).alias("title"))


def code_chunks(docs: DataFrame, size: int, hard: bool = True) -> DataFrame:
    """Chunks of about ``size`` lines that end where no bracket, string or block comment is open, by a scanner over Arrow batches.

    The last such line is the cut; without one the chunk is cut anyway (``hard``) or grows.
    """

    def scan(text: str) -> list[str]:
        out, start, depth, safe, quote = [], 0, 0, -1, ""
        rows = text.splitlines()
        for k, row in enumerate(rows):
            at = 0
            while at < len(row):
                c = row[at]
                if quote:
                    if row.startswith(quote, at):
                        at += len(quote) - 1
                        quote = ""
                    elif c == "\\":
                        at += 1
                elif row.startswith(('"""', "'''"), at):
                    quote = row[at : at + 3]
                    at += 2
                elif row.startswith("/*", at):
                    quote = "*/"
                    at += 1
                elif c in "\"'":
                    quote = c
                elif c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth = max(0, depth - 1)
                elif c == "#" or row.startswith("//", at):
                    break
                at += 1
            if quote in ('"', "'"):
                quote = ""
            if depth == 0 and not quote:
                safe = k
            if k - start + 1 >= size:
                cut = safe if safe >= start else k if hard else -1
                if cut >= start:
                    out.append("\n".join(rows[start : cut + 1]))
                    start = cut + 1
        if start < len(rows):
            out.append("\n".join(rows[start:]))
        return out

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, k, c) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, c in enumerate(scan(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "content"])

    return docs.select("id", "text").mapInPandas(run, f"id {dict(docs.dtypes)['id']}, chunk int, content string")
