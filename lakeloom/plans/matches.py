"""Queries of joins between texts, windows, labels and places, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import matches as M
from ..operators import ordered as O
from ..operators import rules as R
from ..operators import search as V
from ..operators import terms as T
from . import generated as N
from .base import query, table
from .ordered import JACCARD, STOP, TERMS, terms
from .terms import COUNTS, TURN_PAIRS, TURNS, counts, turn_counts

COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), "role", "text", terms().alias("terms"))


GREEDY = """list_reduce(list([{{'a': a, 'b': b, 's': s}}] ORDER BY s DESC, a, b), lambda acc, y: CASE WHEN len(list_filter(acc, lambda p: p.a = y[1].a)) < {pa} AND len(list_filter(acc, lambda p: p.b = y[1].b)) < {pb} THEN list_concat(acc, y) ELSE acc END)"""


@query("j4_greedy_pairs", TURN_PAIRS.replace("WITH ", "WITH ", 1) + f", q AS (SELECT conv_id * 100 + a AS a, conv_id * 100 + b AS b, round(jaccard, 6) AS s FROM j WHERE shared >= 2 AND turn_ok), g AS (SELECT unnest({GREEDY.format(pa=1, pb=1)}) AS p FROM q) SELECT p.a, p.b, p.s AS jaccard FROM g".replace(" AND turn_ok", ""))
def j4_greedy_pairs(spark, d):
    """Similar turns, matched from the best pair on, each turn once on either side."""
    pairs = T.scoped_similarity(turn_counts(spark, d).drop("n"), ["conv_id"], least_shared=2)
    pairs = pairs.select((F.col("conv_id") * 100 + F.col("a")).alias("a"), (F.col("conv_id") * 100 + F.col("b")).alias("b"), F.round("jaccard", 6).alias("jaccard"))
    return T.greedy_match(pairs, "jaccard", 1, 1)


VECTORS = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("j6_similar_parts", f"""WITH {VECTORS}, t AS (SELECT conv_id, turn AS id, {TERMS} AS w, v FROM conversations LEFT JOIN e ON vec_id = conv_id * 5 + turn AND turn <= 4),
p AS (SELECT a.conv_id, a.id AS a, b.id AS b, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'vectors' ELSE 'terms' END AS relation, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN {COSINE.format(a='a.v', b='b.v')} ELSE {JACCARD.format(a='a.w', b='b.w')} END, 9) AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.id < b.id),
f AS (SELECT * FROM p WHERE score >= 0.05), y AS (SELECT conv_id, a, b, score, relation FROM f UNION ALL SELECT conv_id, b, a, score, relation FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY score DESC, b) AS k FROM y) SELECT conv_id, a, b, round(score, 6) AS score, relation FROM r WHERE k <= 2 AND a < b""")
def j6_similar_parts(spark, d):
    """Similar turns of a conversation: by vectors where both turns have one, else by terms."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    t = turns(spark, d)
    held = t.join(v, (v["vec_id"] == t["conv_id"] * 5 + t["id"]) & (t["id"] <= 4), "left")
    return M.similar_parts(held, ["conv_id"], 0.05, 2).withColumn("score", F.round("score", 6))


@query("j9_blended_pairs", f"""WITH {TURNS}, bk AS (SELECT conv_id, id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS BIGINT) AS k, CAST(sum(n) AS DOUBLE) AS w FROM counts GROUP BY 1, 2, 3), z AS (SELECT conv_id, id, sqrt(sum(w * w)) AS norm FROM bk GROUP BY 1, 2),
u AS (SELECT bk.conv_id, bk.id, k, w / norm AS w FROM bk JOIN z USING (conv_id, id)), l AS (SELECT a.conv_id, a.id AS a, b.id AS b, round(sum(a.w * b.w), 9) AS lexical FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.k = b.k AND a.id < b.id GROUP BY 1, 2, 3),
y AS (SELECT * FROM l UNION ALL SELECT conv_id, b, a, lexical FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY lexical DESC, b) AS k FROM y),
s AS (SELECT conv_id, turn AS id, length(text) AS c, len(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS w, len(string_split(text, chr(10))) AS l FROM conversations),
q AS (SELECT r.conv_id, a, b, lexical, ((1 - abs(x.c - z.c) / greatest(x.c, z.c, 1e-6)) + (1 - abs(x.w - z.w) / greatest(x.w, z.w, 1e-6)) + (1 - abs(x.l - z.l) / greatest(x.l, z.l, 1e-6))) / 3 AS structural, 1 - abs(x.w / greatest(x.c, 1) - z.w / greatest(z.c, 1)) / greatest(x.w / greatest(x.c, 1), z.w / greatest(z.c, 1), 1e-6) AS density FROM r JOIN s x ON x.conv_id = r.conv_id AND x.id = a JOIN s z ON z.conv_id = r.conv_id AND z.id = b WHERE k <= 3 AND a < b)
SELECT conv_id, a, b, round(lexical, 6) AS lexical, round(structural, 6) AS structural, round(density, 6) AS density, round(0.7 * lexical + 0.2 * structural + 0.1 * density, 6) AS score FROM q WHERE 0.7 * lexical + 0.2 * structural + 0.1 * density >= 0.3""")
def j9_blended_pairs(spark, d):
    """Turns by hashed words, sizes and density together."""
    parts = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), F.length("text").alias("chars"), F.size(X.tokens("text")).alias("words"), F.size(X.lines("text")).alias("lines"))
    found = M.blended_pairs(parts, turn_counts(spark, d), ["conv_id"], 64, (0.7, 0.2, 0.1), 0.3, 3)
    return found.select("conv_id", "a", "b", *(F.round(c, 6).alias(c) for c in ("lexical", "structural", "density", "score")))


@query("j12_recent_history", f"""WITH t AS (SELECT conv_id, turn AS id, {TERMS} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 AS recent FROM conversations), s AS (SELECT conv_id, id, recent, len(w) AS n, unnest(w) AS term FROM t),
p AS (SELECT a.conv_id, a.id AS a, b.id AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS similarity FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.term = b.term AND a.recent AND NOT b.recent GROUP BY a.conv_id, a.id, b.id, a.n, b.n), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, a ORDER BY similarity DESC, b) AS INTEGER) AS rank FROM p WHERE similarity >= 0.01) SELECT * FROM r WHERE rank <= 2""")
def j12_recent_history(spark, d):
    """The last two turns of a conversation against all before them."""
    t = turns(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("id"))))
    return M.recent_and_history(t.where("k <= 2"), t.where("k > 2"), ["conv_id"], 0.01, 2)


KEYS = COUNTS + ", kw AS (SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS k FROM counts) WHERE k <= 10)"


def key_terms(spark, d, top=10):
    return T.keywords(counts(spark, d), top).select("id", "term")


@query("j24_keyword_sets", f"WITH {KEYS}, s AS (SELECT d.source, d.lang, id, term FROM kw JOIN documents d ON doc_id = id), p AS (SELECT a.source, a.lang, a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.source = b.source AND a.lang = b.lang AND a.term = b.term AND a.id < b.id GROUP BY 1, 2, 3, 4) SELECT source, lang, a, b, shared FROM p WHERE shared >= 3")
def j24_keyword_sets(spark, d):
    """Documents of one source and language that share three of their ten keywords."""
    named = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    sets = key_terms(spark, d).join(named, "id")
    return T.scoped_overlaps(sets, ["source", "lang"], 3)


@query("j27_line_chunks", "WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text <> '') SELECT id, CAST(line AS INTEGER) AS line, CAST(greatest(0, (line - 2) // 4) AS INTEGER) AS chunk FROM l WHERE contains(c, ', ')")
def j27_line_chunks(spark, d):
    """Lines with a comma and the first of the overlapping chunks of lines that hold them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = docs.where("text <> ''").select("id", F.posexplode(X.lines("text")).alias("pos", "c")).where(F.contains(F.col("c"), F.lit(", "))).select("id", (F.col("pos") + 1).alias("line"))
    return M.chunk_of_line(hits, C.sliding_lines(docs, 5, 1))


@query("j30_outside_spans", "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s FROM events) SELECT event_id FROM e a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'view' AND a.user_id = b.user_id AND a.s >= b.s AND a.s < b.s + 86400000000)")
def j30_outside_spans(spark, d):
    """Clicks that lie in no day from a view of the same user on."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", O.micros("ts").alias("at"))
    spans = e.where("event_type = 'view'").select("user_id", F.col("at").alias("first"), (F.col("at") + 86_400_000_000).alias("last"))
    return M.outside_spans(e.where("event_type = 'click'"), spans, ["user_id"], "at").select("event_id")


@query("j31_recursive_loops", f"SELECT id, line, CASE kind WHEN 'for' THEN list_concat(CASE WHEN {N.TURNS} THEN ['turn_' || p_size] ELSE [] END, CASE WHEN {N.WALKS} THEN ['walk_' || p_size] ELSE [] END) ELSE [] END AS recursive FROM {N.RECURSIVE.sql()} JOIN part ON p_partkey = id WHERE kind IS NOT NULL")
def j31_recursive_loops(spark, d):
    """Loops of a source with the recursive functions that they call."""
    return M.recursive_calls(R.python_symbols(N.RECURSIVE.sources(spark, d)))


@query("j32_cluster_ids", "SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN CAST(dense AS INTEGER) END AS cluster FROM (SELECT conv_id, turn, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS dense FROM conversations)")
def j32_cluster_ids(spark, d):
    """The cluster of each turn's speaker, where one is known."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    speakers = rows.select("conv_id", "role").distinct().withColumn("cluster", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("role")))
    return rows.join(speakers.where("conv_id % 2 = 0"), ["conv_id", "role"], "left")


QUESTION = f"list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))"


@query("j33_question_chunks", f"""WITH {KEYS}, q AS (SELECT item_id AS question, unnest({QUESTION}) AS term FROM benchmark), nt AS (SELECT doc_id AS id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1), lambda x: lower(x)))) AS term FROM documents),
w AS (SELECT id AS chunk, term, 2 AS weight FROM kw UNION ALL SELECT id, term, 3 FROM nt), h AS (SELECT question, chunk, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN w USING (term) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM h)
SELECT question, chunk, score, rank FROM r WHERE rank <= 3 UNION ALL SELECT DISTINCT question, (SELECT min(doc_id) FROM documents), CAST(0 AS BIGINT), 1 FROM q WHERE question NOT IN (SELECT question FROM h)""")
def j33_question_chunks(spark, d):
    """Documents that answer a benchmark item best, by its terms among their keywords and names."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.explode(terms()).alias("term"))
    docs = table(spark, d, "documents")
    names = docs.select(F.col("doc_id").alias("chunk"), F.explode(F.array_distinct(F.transform(X.named_terms("text"), lambda x: F.lower(x)))).alias("term"), F.lit(3).cast("long").alias("weight"))
    held = key_terms(spark, d).select(F.col("id").alias("chunk"), "term", F.lit(2).cast("long").alias("weight")).unionAll(names)
    return M.score_chunks(q, held, docs.agg(F.min("doc_id").alias("chunk")), 3)


@query("j34_recommended_labels", f"""WITH {COUNTS}, lt AS (SELECT lang AS label, term, sum(n) AS n FROM counts JOIN documents ON doc_id = id GROUP BY 1, 2), l AS (SELECT label, term FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS k FROM lt) WHERE k <= 30),
s AS (SELECT id, term FROM counts), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT s.id, label, count(*) AS shared FROM s JOIN l USING (term) GROUP BY 1, 2), c AS (SELECT p.id, label, shared, round(shared / least(n, (SELECT count(*) FROM l x WHERE x.label = p.label)), 6) AS score, round(shared / n, 6) AS coverage FROM p JOIN n USING (id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, shared DESC, label) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 2""")
def j34_recommended_labels(spark, d):
    """Languages by the overlap of their most frequent terms with a document's."""
    c = counts(spark, d)
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    by = c.join(lang, "id").groupBy("label", "term").agg(F.sum("n").alias("n"))
    labels = by.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "term"))).where("k <= 30").select("label", "term")
    return M.recommend_labels(c.select("id", "term"), labels, 2)


@query("j37_topic_references", "WITH s AS (SELECT DISTINCT event_type AS id, user_id AS term FROM events), z AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b")
def j37_topic_references(spark, d):
    """Kinds of events by the users that they share."""
    sets = table(spark, d, "events").select(F.col("event_type").alias("id"), F.col("user_id").alias("term")).distinct()
    return T.set_similarity(sets).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("j38_marked_look_back", f"""WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS i, role, {TERMS} AS w FROM conversations),
p AS (SELECT a.conv_id, a.i, b.i AS j, a.role, {JACCARD.format(a='a.w', b='b.w')} AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 3 AND a.i - 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, j) AS k FROM p WHERE score > 0) SELECT conv_id, i, j, round(score, 6) AS score FROM r WHERE k = 1 AND role = 'assistant'""")
def j38_marked_look_back(spark, d):
    """Answers and the turn among the three before that they take up."""
    rows = table(spark, d, "conversations")
    found = O.look_back(rows, ["conv_id"], ["turn"], terms(), 3, 1)
    place = rows.select("conv_id", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("i"))
    return found.join(place.where("role = 'assistant'"), ["conv_id", "i"]).select("conv_id", "i", "j", F.round("score", 6).alias("score"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("j39_document_neighbours", f"WITH {VECTORS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COSINE.format(a='a.v', b='b.v')}, 9) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def j39_document_neighbours(spark, d):
    """The three nearest other vectors of every fiftieth."""
    v = vectors(spark, d).select("id", "v")
    found = V.vector_search(v, v.where("id % 50 = 0"), 4).where("id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 3")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("j45_queries_and_stores", f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS store FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.store, b.vec_id AS id, round({COSINE.format(a='a.v', b='b.v')}, 9) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, store ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) SELECT query_id, store, id, round(score, 6) AS score, rank FROM r WHERE rank <= 2")
def j45_queries_and_stores(spark, d):
    """Several queries against two stores, the best two of each."""
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").select("id", "v")
    found = V.union_of({name: V.vector_search(v.where(f"label % 2 = {k}").select("id", "v"), asked, 2) for k, name in enumerate(("even", "odd"))})
    return found.select("query_id", "store", "id", F.round("score", 6).alias("score"), "rank")


@query("o2_two_level_top", f"WITH {VECTORS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COSINE.format(a='a.v', b='b.v')}, 9) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def o2_two_level_top(spark, d):
    """The best five of each shard, then of all."""
    v = vectors(spark, d)
    asked = v.where("id % 100 = 0").select("id", "v")
    parts = V.union_of({str(k): V.vector_search(v.where(F.col("id") % 4 == k).select("id", "v"), asked, 5) for k in range(4)})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.drop("rank", "store").withColumn("rank", F.row_number().over(order)).where("rank <= 5").withColumn("score", F.round("score", 6))


STYLES = ["the the", "of-and", "in the", "der die", "to-be"]
HAS = "(contains(lower(text), '{0}') OR contains(replace(lower(text), '-', ' '), '{1}') OR contains(lower(text), '{2}'))"


@query("j42_style_presence", "WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS s FROM documents WHERE " + HAS.format(s, s.replace("-", " "), s.replace(" ", "-")) for s in STYLES) + ") SELECT doc_id, list(s ORDER BY s) AS styles FROM m GROUP BY 1")
def j42_style_presence(spark, d):
    """Documents that hold one of some names, with all that they hold."""
    found = table(spark, d, "documents").select("doc_id", M.name_hits(F.col("text"), STYLES).alias("styles"))
    return found.where(F.size("styles") > 0)


@query("j43_requested_names", "WITH a AS (SELECT n_name AS asked FROM nation UNION ALL SELECT ' ' || lower(replace(n_name, ' ', '-')) FROM nation UNION ALL SELECT 'No-' || r_name FROM region) SELECT asked, n_name AS name, CASE WHEN n_name IS NULL THEN 'unknown: ' || lower(trim(asked)) END AS warning FROM a LEFT JOIN nation ON lower(n_name) = lower(trim(asked)) OR lower(n_name) = replace(lower(trim(asked)), '-', ' ')")
def j43_requested_names(spark, d):
    """Nations asked for by name in several spellings, and names of none."""
    n = table(spark, d, "nation")
    asked = n.select(F.col("n_name").alias("asked")).unionAll(n.select(F.concat(F.lit(" "), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))))).unionAll(table(spark, d, "region").select(F.concat(F.lit("No-"), "r_name")))
    return M.requested(asked, n.select(F.col("n_name").alias("name")))


@query("j44_linked_windows", f"""WITH t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS id, role, {TERMS} AS w FROM conversations), m AS (SELECT conv_id, id, list_distinct(flatten(list(w))) AS w, list_distinct(list(role)) AS s FROM t GROUP BY 1, 2),
p AS (SELECT a.conv_id, a.id AS a, b.id AS b, {JACCARD.format(a='a.w', b='b.w')} AS t, {JACCARD.format(a='a.s', b='b.s')} AS s FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.id <> b.id), f AS (SELECT conv_id, a, b, round(t, 6) AS terms, round(s, 6) AS styles, round(0.8 * t + 0.2 * s, 6) AS score FROM p WHERE t > 0 AND s > 0 AND round(0.8 * t + 0.2 * s, 6) >= 0.1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, a ORDER BY score DESC, b) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 2""")
def j44_linked_windows(spark, d):
    """Windows of two turns that share terms and speakers."""
    rows = turns(spark, d).withColumn("w", F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("id")) - 1) / 2))
    windows = rows.groupBy("conv_id", F.col("w").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"), F.collect_set("role").alias("styles"))
    return M.linked_windows(windows, ["conv_id"], (0.8, 0.2), 0.1, 2)
