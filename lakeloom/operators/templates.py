"""Prompt templates as data: parsed into literal and slot rows, joined with values, put together in order; and message lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT = r"\{[A-Za-z_][A-Za-z0-9_]*\}"
TOKEN = SLOT + r"|\{|[^{]+"


def parse_templates(templates: DataFrame) -> DataFrame:
    """``template_id, place, slot, literal`` of ``template_id, template``: each part in order, with the name of a slot ``{name}`` or its text. A brace that opens no slot is text."""
    parts = F.regexp_extract_all(F.coalesce("template", F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = templates.select("template_id", F.posexplode_outer(parts).alias("place", "part"))
    slot = F.when(F.col("part").rlike(f"^{SLOT}$"), F.expr("substring(part, 2, length(part) - 2)"))
    return rows.select("template_id", F.coalesce("place", F.lit(0)).alias("place"), slot.alias("slot"), F.when(slot.isNull(), F.coalesce("part", F.lit(""))).alias("literal"))


def fill_templates(templates: DataFrame, requests: DataFrame, values: DataFrame) -> DataFrame:
    """``id, text, error`` of ``requests`` (``id, template_id``), filled from ``values`` (``id, name, value``; an id's names differ).

    A slot without a value is an error that names it, and so is a request without a template; the text is null then. What is put
    in is not parsed again. A template without slots is followed by its request's values, a line ``name: value`` each, by name.
    """
    parts = parse_templates(templates)
    shape = parts.groupBy("template_id").agg(F.max(F.col("slot").isNotNull()).alias("has_slots"))
    parts = parts.join(shape, "template_id")
    asked = requests.select("id", "template_id").join(parts, "template_id", "left")
    given = values.select("id", F.col("name").alias("slot"), "value")
    pieces = asked.join(given, ["id", "slot"], "left")
    missing = F.when(F.col("slot").isNotNull() & F.col("value").isNull(), F.col("slot"))
    whole = pieces.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("literal", "value", F.lit("")).alias("piece")))), lambda p: p["piece"]), "").alias("text"),
        F.array_sort(F.collect_set(missing)).alias("missing"), F.max("has_slots").alias("has_slots"), F.max("place").isNull().alias("unknown"),
    )
    bare = whole.where("not has_slots").select("id")
    lines = values.join(bare, "id").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.coalesce("value", F.lit("")).alias("value")))), lambda v: F.concat(v["name"], F.lit(": "), v["value"])), "\n").alias("extra"))
    text = F.when(F.col("extra").isNotNull(), F.concat(F.rtrim("text"), F.lit("\n\n"), F.col("extra"))).otherwise(F.col("text"))
    error = F.when(F.col("unknown"), "no such template").when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
    return whole.join(lines, "id", "left").select("id", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def message_lists(messages: DataFrame, systems: DataFrame) -> DataFrame:
    """``id, place, role, content``: usable messages of ``id, place, role, content``, numbered from 1, after the system text of ``systems`` (``id, text``), number 0.

    Roles and contents are trimmed; a missing role is the user's, and messages without content are left out. An id that keeps no message gets one row with
    place -1 and nothing else.
    """
    tidy = messages.select("id", "place", F.trim(F.coalesce("role", F.lit(""))).alias("role"), F.trim(F.coalesce("content", F.lit(""))).alias("content"))
    kept = tidy.where("content <> ''").withColumn("role", F.when(F.col("role") == "", "user").otherwise(F.col("role")))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("place", "role", "content")).cast("long"))
    first = systems.select("id", F.trim(F.coalesce("text", F.lit(""))).alias("content")).where("content <> ''").join(kept.select("id").distinct(), "id", "left_semi")
    none = messages.select("id").distinct().join(kept, "id", "left_anti")
    empty = F.lit(None).cast("string")
    return kept.unionByName(first.select("id", F.lit(0).cast("long").alias("place"), F.lit("system").alias("role"), "content")).unionByName(none.select("id", F.lit(-1).cast("long").alias("place"), empty.alias("role"), empty.alias("content")))
