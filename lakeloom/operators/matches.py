"""Joins between texts, windows, labels and places: blended similarities, history, ranges, lookups by name.

Pairs are only ever built inside a stated scope (a conversation, a file) or through a shared term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, jaccard, ratio
from .terms import both_ways, top_neighbours


#: Terms of all labels that are broadcast, so that no document's terms are shuffled to meet them.
MOST_LABEL_TERMS = 100_000


def scoped_pairs(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by..., a, b`` (a < b) and the columns of both sides as structs ``x``, ``y``."""
    side = lambda name, s: rows.select(*by, F.col("id").alias(name), F.struct(*columns).alias(s))
    return side("a", "x").join(side("b", "y"), by).where("a < b")


#: Right rows of one key that a task of ``spread_join`` meets.
KEY_ROWS = 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """The inner join on ``key``, whose few values may have very many rows on both sides, with a key as the work of many tasks.

    The right rows of a key are dealt by ``by`` into blocks of about ``KEY_ROWS``; a left row is sent once to each block of its key. Rows of a block are few
    bytes and much work, so there are as many tasks as shuffles have partitions.
    """
    sizes = right.groupBy(key).agg(F.ceil(F.count("*") / KEY_ROWS).alias("_n"))
    x = left.join(sizes, key).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    y = right.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64(by), "_n")).drop("_n")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (rows.repartition(tasks, key, "_block") for rows in (x, y))
    return x.join(y.hint("merge"), [key, "_block"]).drop("_block")


def similar_parts(rows: DataFrame, by: list[str], least: float, top: int) -> DataFrame:
    """``by..., a, b, score, relation``: parts (``id, v, terms``) of one scope by the cosine of their vectors where both have one, else by Jaccard; pairs a < b in the top list of a."""
    both = F.col("x.v").isNotNull() & F.col("y.v").isNotNull()
    pairs = scoped_pairs(rows, by, ["v", "terms"]).withColumn("relation", F.when(both, "vectors").otherwise("terms"))
    pairs = pairs.withColumn("score", F.round(F.when(both, cosine(F.col("x.v"), F.col("y.v"))).otherwise(jaccard(F.col("x.terms"), F.col("y.terms"))), 9))
    pairs = pairs.where(F.col("score") >= least).select(*by, "a", "b", "score", "relation")
    return top_neighbours(both_ways(pairs), "score", top, tuple(by)).where("a < b").drop("rank")


def token_bucket(token: Column, buckets: int) -> Column:
    """The bucket of a token's hashed feature: the first 32 bits of its MD5 modulo ``buckets``."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def blended_pairs(parts: DataFrame, words: DataFrame, by: list[str], buckets: int, weights: tuple[float, float, float], least: float, top: int) -> DataFrame:
    """``by..., a, b, lexical, structural, density, score``: pairs of parts of one scope.

    ``words`` (``by..., id, term, n``) become hashed counts, whose cosine is the lexical score: an equi-join on the bucket.
    ``parts`` (``by..., id, chars, words, lines``) give the mean ratio of sizes and the ratio of words by characters. The best
    ``top`` partners of each part by the lexical score are blended; pairs under ``least`` go.
    """
    counted = words.groupBy(*by, "id", token_bucket(F.col("term"), buckets).alias("bucket")).agg(F.sum("n").cast("double").alias("w"))
    norm = counted.groupBy(*by, "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = counted.join(norm, [*by, "id"]).withColumn("w", F.col("w") / F.col("norm"))
    a, b = (unit.select(*by, "bucket", F.col("id").alias(x), F.col("w").alias(f"w_{x}")) for x in "ab")
    pairs = a.join(b, [*by, "bucket"]).where("a < b").groupBy(*by, "a", "b").agg(F.round(F.sum(F.col("w_a") * F.col("w_b")), 9).alias("lexical"))
    near = top_neighbours(both_ways(pairs), "lexical", top, tuple(by)).where("a < b").drop("rank")
    side = lambda name, s: parts.select(*by, F.col("id").alias(name), F.struct("chars", "words", "lines").alias(s))
    out = near.join(side("a", "x"), [*by, "a"]).join(side("b", "y"), [*by, "b"])
    sizes = [ratio(F.col(f"x.{c}"), F.col(f"y.{c}")) for c in ("chars", "words", "lines")]
    dense = lambda s: F.col(f"{s}.words") / F.greatest(F.col(f"{s}.chars"), F.lit(1))
    out = out.withColumns({"structural": sum(sizes[1:], sizes[0]) / 3, "density": ratio(dense("x"), dense("y"))})
    out = out.withColumn("score", weights[0] * F.col("lexical") + weights[1] * F.col("structural") + weights[2] * F.col("density"))
    return out.where(F.col("score") >= least).select(*by, "a", "b", "lexical", "structural", "density", "score")


def recent_and_history(recent: DataFrame, history: DataFrame, by: list[str], least: float, top: int) -> DataFrame:
    """``by..., a, b, similarity, rank``: for each recent row the most similar earlier ones by Jaccard over ``terms``, ties to the older; rows that share nothing do not meet."""
    side = lambda rows, name: rows.select(*by, F.col("id").alias(name), F.size("terms").alias(f"n_{name}"), F.explode("terms").alias("term"))
    pairs = side(recent, "a").join(side(history, "b"), [*by, "term"]).groupBy(*by, "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    pairs = pairs.withColumn("similarity", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6)).where(F.col("similarity") >= least)
    return top_neighbours(pairs.select(*by, "a", "b", "similarity"), "similarity", top, tuple(by))


def chunk_of_line(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """``lines`` (``id, line``) with the first chunk (``id, chunk, first_line, last_line``) that holds each; lines of no chunk have none."""
    l, c = lines.alias("l"), chunks.select("id", "chunk", "first_line", "last_line").alias("c")
    hit = l.join(c, F.expr("l.id = c.id and l.line between c.first_line and c.last_line")).groupBy("l.id", "l.line").agg(F.min("c.chunk").alias("chunk"))
    return lines.join(hit, ["id", "line"], "left")


def outside_spans(points: DataFrame, spans: DataFrame, by: list[str], at: str) -> DataFrame:
    """Points that lie in no span (``by..., first, last``, the last excluded) of their group."""
    p, s = points.alias("p"), spans.alias("s")
    rule = F.lit(True)
    for c in by:
        rule = rule & (F.col(f"p.{c}") == F.col(f"s.{c}"))
    return p.join(s, rule & (F.col(f"p.{at}") >= F.col("s.first")) & (F.col(f"p.{at}") < F.col("s.last")), "left_anti")


def recursive_calls(symbols: DataFrame) -> DataFrame:
    """``id, line, recursive``: loops of ``python_symbols`` with the recursive functions that they call, sorted; a call counts by its last name."""
    own = F.when((F.col("kind") == "function") & F.array_contains("calls", F.col("name")), F.col("name"))
    known = symbols.withColumn("_own", F.collect_set(own).over(Window.partitionBy("id"))).where("kind = 'loop'")  # sources are parsed once
    called = F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda c: F.element_at(F.split(c, r"\."), -1))
    hits = known.select("id", "line", F.array_intersect(called, "_own").alias("hits"))
    return hits.groupBy("id", "line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("recursive"))


def score_chunks(questions: DataFrame, weighted: DataFrame, first: DataFrame, top: int) -> DataFrame:
    """``question, chunk, score, rank``: chunks by the weights of the question's terms (``question, term``) that they hold (``chunk, term, weight``).

    A question that no chunk answers gets the first chunk (one row ``chunk``) with score 0.
    """
    from .state import checkpointed

    # questions and the first chunk are found before the chunks are read: a broadcast that waits behind those ends with an error after some minutes
    asked, least = checkpointed(questions.distinct()), first.select("chunk").first()
    side = F.broadcast(asked) if asked.count() <= MOST_LABEL_TERMS else asked
    hits = weighted.join(side, "term").groupBy("question", "chunk").agg(F.sum("weight").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "chunk"))).where(F.col("rank") <= top)
    ranked = checkpointed(ranked.select("question", "chunk", "score", "rank"))
    alone = asked.select("question").distinct().join(ranked.select("question").distinct(), "question", "left_anti")
    chunk = F.lit(least["chunk"] if least else None).cast(weighted.schema["chunk"].dataType)
    return ranked.unionByName(alone.select("question", chunk.alias("chunk"), F.lit(0).cast("long").alias("score"), F.lit(1).alias("rank")))


def recommend_labels(sets: DataFrame, labels: DataFrame, top: int, mode: str = "overlap") -> DataFrame:
    """``id, label, shared, score, coverage, rank``: labels (``label, term``) by the overlap coefficient or Jaccard similarity with a term set (``id, term``), best first, ties by shared terms and name."""
    from .state import checkpointed

    labels = checkpointed(labels)
    n, m = sets.groupBy("id").agg(F.count("*").alias("n")), labels.groupBy("label").agg(F.count("*").alias("m"))
    shared = sets.join(F.broadcast(labels) if labels.count() <= MOST_LABEL_TERMS else labels, "term").groupBy("id", "label").agg(F.count("*").alias("shared")).join(n, "id").join(m, "label")
    base = F.least("n", "m") if mode == "overlap" else F.col("n") + F.col("m") - F.col("shared")
    out = shared.withColumns({"score": F.round(F.col("shared") / base, 6), "coverage": F.round(F.col("shared") / F.col("n"), 6)})
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("shared"), "label")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("id", "label", "shared", "score", "coverage", "rank")


def name_hits(text: Column, names: list[str]) -> Column:
    """The names that a text holds, sorted; hyphens and spaces within a name are the same."""
    low = F.lower(F.coalesce(text, F.lit("")))
    flat = F.replace(low, F.lit("-"), F.lit(" "))
    hit = lambda n: F.contains(low, F.lit(n.lower())) | F.contains(flat, F.lit(n.lower().replace("-", " "))) | F.contains(low, F.lit(n.lower().replace(" ", "-")))
    return F.array_sort(F.array_compact(F.array(*(F.when(hit(n), F.lit(n)) for n in sorted(set(names))))))


def requested(names: DataFrame, known: DataFrame) -> DataFrame:
    """``asked, name, warning``: requested names by their normal form (trimmed, lower case), then with spaces for hyphens; unknown ones come with a warning."""
    norm = F.lower(F.trim("asked"))
    own = known.select(F.lower(F.trim("name")).alias("_key"), "name")
    first = names.withColumn("_norm", norm).join(own.withColumnsRenamed({"_key": "_k1", "name": "n1"}), F.col("_norm") == F.col("_k1"), "left")
    both = first.join(own.withColumnsRenamed({"_key": "_k2", "name": "n2"}), F.replace("_norm", F.lit("-"), F.lit(" ")) == F.col("_k2"), "left")
    found = F.coalesce("n1", "n2")
    return both.select("asked", found.alias("name"), F.when(found.isNull(), F.concat(F.lit("unknown: "), "_norm")).alias("warning"))


def linked_windows(windows: DataFrame, by: list[str], weights: tuple[float, float], least: float, top: int) -> DataFrame:
    """``by..., a, b, terms, styles, score, rank``: directed links between windows (``id, terms, styles``) of one scope that share terms and styles."""
    t, s = jaccard(F.col("x.terms"), F.col("y.terms")), jaccard(F.col("x.styles"), F.col("y.styles"))
    pairs = scoped_pairs(windows, by, ["terms", "styles"]).withColumns({"t": t, "s": s}).where("t > 0 and s > 0")
    pairs = pairs.withColumn("score", F.round(weights[0] * F.col("t") + weights[1] * F.col("s"), 6)).where(F.col("score") >= least)
    return top_neighbours(both_ways(pairs.select(*by, "a", "b", F.round("t", 6).alias("terms"), F.round("s", 6).alias("styles"), "score")), "score", top, tuple(by))
