"""Lexicon joins, rules, text search and sentence selection.

A lexicon is an input of its own. Containment has no equi-key, so its terms are broadcast and found by an automaton in one pass
over each text. ``MAX_TERMS`` bounds what is broadcast: larger lexicons are joined on tokens (``by_token``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lines, sentences, snippet, tokens

#: Largest lexicon, in rows and in bytes of its terms, that is joined by containment.
MAX_TERMS, MAX_BYTES = 100_000, 4_000_000


def checked(terms: DataFrame) -> DataFrame:
    """The lexicon as a broadcast side, after its size has been checked."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in terms.columns), F.lit(0))
    rows, size = terms.limit(MAX_TERMS + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows > MAX_TERMS or size > MAX_BYTES:
        raise ValueError(f"more than {MAX_TERMS} terms or {MAX_BYTES} bytes: join on tokens instead (by_token)")
    return F.broadcast(terms)


def automaton_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` with ``_low``, the lower-cased text, and ``_hit`` (term, n, first_at): one row for each different lower-cased term that a text contains.

    All terms are looked for in one pass over a text by an automaton, which every task builds from the broadcast terms; the work does not grow with their number. ``n``
    counts occurrences that do not overlap, from the left.
    """
    spark = docs.sparkSession
    checked(terms)
    known = sorted({r[0] for r in terms.select(F.lower("term")).distinct().collect() if r[0]})
    held = spark.sparkContext.broadcast(known)
    low = docs.withColumn("_low", F.coalesce(F.lower("text"), F.lit("")))
    hit = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first_at", T.IntegerType())]))
    at = low.columns.index("_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for k, term in enumerate(held.value):
            trie.add_word(term, k)
        trie.make_automaton()
        sizes = [len(t) for t in held.value]
        kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64()), ("first_at", pa.int32())]))
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                found: dict[int, list[int]] = {}  # term: count, first, where the last one counted ends
                for end, k in trie.iter(text) if sizes else ():
                    first = end + 1 - sizes[k]
                    own = found.get(k)
                    if own is None:
                        found[k] = [1, first + 1, end]
                    elif first > own[2]:
                        own[0], own[2] = own[0] + 1, end
                out.append([{"term": held.value[k], "n": n, "first_at": first} for k, (n, first, _) in found.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "_hits"])

    rows = low.mapInArrow(run, T.StructType([*low.schema.fields, T.StructField("_hits", hit)]))
    return rows.withColumn("_hit", F.explode("_hits")).drop("_hits")


def match_terms(docs: DataFrame, terms: DataFrame, radius: int = 40) -> DataFrame:
    """Terms that occur in the lower-cased text: how often, where first, and the text around that. Empty and null terms and texts match nothing."""
    hits = automaton_hits(docs, terms)
    pairs = hits.join(F.broadcast(terms), F.lower("term") == F.col("_hit.term"))
    pairs = pairs.withColumns({"n": F.col("_hit.n"), "first_at": F.col("_hit.first_at")})
    return pairs.withColumn("snippet", snippet(F.col("text"), F.col("first_at"), F.length("term"), radius)).drop("_low", "_hit")


def by_token(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, term, n``: whole-token matches by an equi-join, for lexicons of any size."""
    words = docs.select("id", F.explode(tokens("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    return words.join(terms, "term")


def categories(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, category, terms, active`` for every document and category, also where nothing matches."""
    hits = automaton_hits(docs.select("id", "text"), terms)
    own = hits.join(F.broadcast(terms.select("term", "category")), F.lower("term") == F.col("_hit.term")).groupBy("id", "category").agg(F.count("*").alias("terms"))
    names = [r[0] for r in terms.select("category").distinct().collect()]
    every = docs.select("id").distinct().withColumn("category", F.explode(F.array(*(F.lit(n) for n in names))))
    found = every.join(own, every["id"].eqNullSafe(own["id"]) & every["category"].eqNullSafe(own["category"]), "left").select(every["id"], every["category"], F.coalesce("terms", F.lit(0)).alias("terms"))
    return found.withColumn("active", F.col("terms") > 0)


def weighted_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Matches with their weight, 0.6 + 0.25 a token up to 3, and its share of the document's weights."""
    found = match_terms(docs, terms).withColumn("weight", F.least(F.lit(3.0), 0.6 + 0.25 * F.size(tokens("term"))))
    return found.withColumn("confidence", F.col("weight") / F.sum("weight").over(Window.partitionBy("id")))


def coverage(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``id, words, matched, coverage``: share of each document's distinct words that are in the dictionary."""
    known = words.join(dictionary.select("word", F.lit(1).alias("_hit")), "word", "left")
    return known.groupBy("id").agg(F.count("*").alias("words"), F.count("_hit").alias("matched")).withColumn("coverage", F.col("matched") / F.col("words"))


def rule_predicate(value: Column, kind: Column, pattern: Column) -> Column:
    """Case-insensitive contains, prefix, suffix or regex."""
    v, p = F.lower(value), F.lower(pattern)
    return F.when(kind == "contains", F.contains(v, p)).when(kind == "prefix", F.startswith(v, p)).when(kind == "suffix", F.endswith(v, p)).when(kind == "regex", F.rlike(v, pattern)).otherwise(False)


def apply_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents with the rules (``tag, kind, pattern``) that they meet."""
    return docs.join(checked(rules), rule_predicate(F.col("text"), F.col("kind"), F.col("pattern")))


def grep(docs: DataFrame, term: str, ignore_case: bool = False, regex: bool = False) -> DataFrame:
    """``id, line, content, before, after``: lines with a match and their neighbours, from the document's own array."""
    rows = docs.select("id", lines("text").alias("l")).select("id", "l", F.posexplode("l").alias("pos", "content"))
    hay = F.lower("content") if ignore_case and not regex else F.col("content")
    hit = F.rlike(F.col("content"), F.lit(("(?i)" if ignore_case else "") + term)) if regex else F.contains(hay, F.lit(term.lower() if ignore_case else term))
    before, after = F.when(F.col("pos") > 0, F.get("l", F.greatest(F.col("pos") - 1, F.lit(0)))), F.get("l", F.col("pos") + 1)
    return rows.where(hit).select("id", (F.col("pos") + 1).alias("line"), "content", before.alias("before"), after.alias("after"))


def key_sentences(docs: DataFrame, keywords: list[str], top: int) -> DataFrame:
    """Sentences by 2 a keyword and up to 1 for their length, ties in text order."""
    rows = docs.select("id", F.posexplode(sentences("text")).alias("pos", "sentence"))
    hits = sum((F.when(F.contains(F.lower("sentence"), F.lit(k)), 1).otherwise(0) for k in keywords), F.lit(0))
    scored = rows.withColumn("score", F.round(2 * hits + F.least(F.length("sentence") / 200, F.lit(1.0)), 6))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("id", "sentence", "score", "rank")


def sentence_flags(docs: DataFrame) -> DataFrame:
    """Counts of sentences, claims, negations and questions."""
    rows = docs.select("id", F.explode(sentences("text")).alias("s"))
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("id").agg(
        F.count("*").alias("sentences"),
        count(F.lower("s").rlike(r"(^|[^a-z0-9_])(is|are|was|were)($|[^a-z0-9_])")).alias("claims"),
        count(F.lower("s").rlike(r"(^|[^a-z0-9_])(not|no|never|none)($|[^a-z0-9_])")).alias("negations"),
        count(F.endswith(F.col("s"), F.lit("?"))).alias("questions"),
    )
