"""Segmenters of dialogue, speech and time-stamped text, and groups of chunks.

All take ``id, text`` unless said otherwise. Rules that look at a line and the ones before it are window
expressions over the lines of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, sentences
from .state import checkpointed


def line_rows(docs: DataFrame) -> DataFrame:
    """``id, pos, line`` with positions from 0."""
    return docs.select("id", F.posexplode(lines("text")).alias("pos", "line"))


def unit_parts(text: Column, unit: str) -> Column:
    """The words, sentences, paragraphs, lines or characters of a text."""
    text = F.coalesce(text, F.lit(""))
    kinds = {
        "words": F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)),
        "sentences": sentences(text),
        "paragraphs": F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda s: F.trim(s)), lambda s: s != ""),
        "lines": F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")),
        "chars": F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))),
    }
    return kinds[unit]


JOINERS = {"words": " ", "sentences": " ", "paragraphs": "\n\n", "lines": "\n", "chars": ""}


def unit_chunks(docs: DataFrame, unit: str, size: int, overlap: int = 0, most: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``id, chunk, first, last, content, truncated, error``: windows of ``size`` units, places from 0 with their ends.

    ``truncated`` says that ``most`` chunks left a rest. A chunk over ``max_bytes`` has an error and no content.
    """
    step = size - overlap
    held = docs.select("id", unit_parts(F.col("text"), unit).alias("u")).where(F.size("u") > 0).withColumn("_n", F.size("u"))
    count = F.floor((F.col("_n") - 1) / step).cast("int") + 1
    kept = count if most is None else F.least(count, F.lit(most))
    rows = held.withColumn("truncated", F.lit(False) if most is None else count > most).select("id", "u", "_n", "truncated", F.explode(F.sequence(F.lit(0), kept - 1)).alias("chunk"))
    content = F.array_join(F.slice("u", F.col("chunk") * step + 1, F.lit(size)), JOINERS[unit])
    rows = rows.select("id", "chunk", (F.col("chunk") * step).alias("first"), (F.least(F.col("chunk") * step + size, F.col("_n")) - 1).alias("last"), content.alias("content"), "truncated")
    over = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    return rows.withColumn("error", F.when(over, F.concat(F.lit("over "), F.lit(max_bytes), F.lit(" bytes")))).withColumn("content", F.when(~over, F.col("content")))


def section_headings(docs: DataFrame) -> DataFrame:
    """``id, line, depth, title, per_100_lines``: ATX (``#``), setext (underlined) and numbered headings outside of fenced code; numbered ones are as deep as their number has parts."""
    w = Window.partitionBy("id").orderBy("pos")
    rows = line_rows(docs).withColumns({"next": F.lead("line").over(w), "n": F.count("*").over(Window.partitionBy("id"))})
    fence = F.sum(F.when(F.col("line").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)).over(w)
    text = F.trim("line") != ""
    number = F.regexp_extract("line", r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\S", 1)
    depth = (
        F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", "^(#+)", 1)))
        .when(text & F.col("next").rlike(r"^=+\s*$"), 1)
        .when(text & F.col("next").rlike(r"^-+\s*$") & ~F.col("line").rlike(r"^-+\s*$"), 2)
        .when(number != "", F.size(F.split(number, r"\.")))
    )
    found = rows.withColumns({"_open": fence % 2, "depth": depth}).where("_open = 0 and depth is not null")
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s*", ""), r"^[0-9]+(?:\.[0-9]+)*\.?\s+", ""))
    return found.select("id", (F.col("pos") + 1).alias("line"), "depth", title.alias("title"), F.round(100 * F.count("*").over(Window.partitionBy("id")) / F.col("n"), 4).alias("per_100_lines"))


def dialogue(docs: DataFrame, least_chars: int = 0) -> DataFrame:
    """``id, segment, speaker, content``: a line that begins with ``Name:`` or a blank line begins a segment; its lines are joined by spaces; shorter ones than ``least_chars`` go."""
    w = Window.partitionBy("id").orderBy("pos")
    name = F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z0-9_ ]{0,30}):\s", 1)
    blank = F.trim("line") == ""
    rows = line_rows(docs).withColumns({"_name": name, "_blank": blank}).withColumn("_new", F.when((F.col("_name") != "") | F.col("_blank"), 1).otherwise(0))
    rows = rows.withColumn("_s", F.sum("_new").over(w)).where("not _blank")
    body = F.trim(F.regexp_replace("line", r"^\s*[A-Za-z][A-Za-z0-9_ ]{0,30}:\s", ""))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("_name") != "", body).otherwise(F.trim("line")).alias("t")))), lambda x: x["t"]), " ")
    found = rows.groupBy("id", "_s").agg(F.max(F.nullif("_name", F.lit(""))).alias("speaker"), parts.alias("content")).where(F.length("content") >= least_chars)
    return found.withColumn("segment", F.row_number().over(Window.partitionBy("id").orderBy("_s"))).select("id", "segment", "speaker", "content")


def sentence_spans(docs: DataFrame) -> DataFrame:
    """``id, sentence, start, end, content``: runs up to ``.``, ``!`` or ``?`` with all white space that follows, trimmed; offsets are of the untrimmed run."""
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^.!?]*[.!?]+\s*|[^.!?]+$)"), F.lit(1))
    rows = docs.select("id", F.posexplode(parts).alias("pos", "part"))
    end = F.sum(F.length("part")).over(Window.partitionBy("id").orderBy("pos"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("part"))
    return rows.where(F.trim("part") != "").select("id", (F.col("pos") + 1).alias("sentence"), "start", "end", F.regexp_replace("part", r"^\s+|\s+$", "").alias("content"))


def vocal_units(docs: DataFrame, most_words: int, words_per_second: float) -> DataFrame:
    """``id, unit, content, seconds``: pieces between punctuation of at most so many words, with their estimated duration."""
    pieces = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.,;:!?]+"), lambda p: F.regexp_extract_all(p, F.lit(r"(\S+)"), F.lit(1))), lambda p: F.size(p) > 0)
    cut = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / most_words).cast("int")), lambda k: F.slice(p, k * most_words + 1, F.lit(most_words))))
    rows = docs.select("id", F.posexplode(F.flatten(cut)).alias("pos", "w"))
    return rows.select("id", (F.col("pos") + 1).alias("unit"), F.array_join("w", " ").alias("content"), F.round(F.size("w") / words_per_second, 4).alias("seconds"))


def clock_seconds(text: Column) -> Column:
    """``[hh:]mm:ss`` in seconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda s, x: s * 60 + x.try_cast("long"))


def timestamped(docs: DataFrame) -> DataFrame:
    """``id, segment, seconds, content``: a line that begins with ``[hh:mm:ss]`` or ``[mm:ss]`` begins a segment; lines before the first belong to one without a time."""
    w = Window.partitionBy("id").orderBy("pos")
    stamp = F.regexp_extract("line", r"^\s*\[([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\]", 1)
    rows = line_rows(docs).withColumn("_t", stamp).withColumn("segment", F.sum(F.when(F.col("_t") != "", 1).otherwise(0)).over(w))
    body = F.trim(F.regexp_replace("line", r"^\s*\[[0-9:]+\]", ""))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("t")))), lambda x: x["t"]), " ")
    found = rows.groupBy("id", "segment").agg(F.max(F.when(F.col("_t") != "", clock_seconds(F.col("_t")))).alias("seconds"), parts.alias("content"))
    return found.where("seconds is not null or content <> ''")


def intervals(docs: DataFrame) -> DataFrame:
    """``id, interval, start, end, content``: lines that begin with ``mm:ss-mm:ss`` or ``mm:ss``; a single mark ends where the next begins, the last has no end."""
    clock = r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)"
    first = F.regexp_extract("line", rf"^\s*{clock}", 1)
    last = F.regexp_extract("line", rf"^\s*{clock}\s*-\s*{clock}", 2)
    rows = line_rows(docs).withColumns({"_a": first, "_b": last}).where("_a <> ''")
    rows = rows.withColumns({"start": clock_seconds(F.col("_a")), "_end": F.when(F.col("_b") != "", clock_seconds(F.col("_b")))})
    w = Window.partitionBy("id").orderBy("pos")
    body = F.trim(F.regexp_replace("line", rf"^\s*{clock}(\s*-\s*{clock})?", ""))
    return rows.select("id", F.row_number().over(w).alias("interval"), "start", F.coalesce("_end", F.lead("start").over(w)).alias("end"), body.alias("content"))


def group_levels(rows: DataFrame, by: list[str], order: str, size: int, chars: int) -> DataFrame:
    """``by..., level, place, content``: texts (``content``) joined in groups of ``size``, again and again until one is left; each is cut to ``chars`` characters.

    Level 0 are the texts themselves, cut. A level has a ``size``-th of the rows of the one before.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    now = checkpointed(rows.select(*by, F.lit(0).alias("level"), place.alias("place"), F.substring("content", 1, chars).alias("content")))
    out, level = now, 0
    while now.where("place > 0").limit(1).count():
        level += 1
        open_ = now.join(now.groupBy(*by).agg(F.max("place").alias("_last")).where("_last > 0").select(*by), by, "left_semi")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), " ")
        now = checkpointed(open_.groupBy(*by, F.floor(F.col("place") / size).cast("int").alias("place")).agg(text.alias("content")).select(*by, F.lit(level).alias("level"), "place", F.substring("content", 1, chars).alias("content")))
        out = out.unionByName(now)
    return out
