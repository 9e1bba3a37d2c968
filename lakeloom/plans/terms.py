"""Queries of term statistics and similarity joins, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokens
from ..operators import terms as T
from .base import query, table

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
COUNTS = f"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)) AS term, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), 1) - 1 AS pos FROM documents),
counts AS (SELECT id, term, count(*) AS n, min(pos) AS "first" FROM tok WHERE length(term) >= 3 AND term NOT IN ({STOP}) GROUP BY 1, 2)"""


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def counts(spark, d):
    return T.term_counts(documents(spark, d), least=3, stopwords=STOPWORDS)


@query("a1_term_counts", f"WITH {COUNTS} SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS documents FROM counts GROUP BY 1")
def a1_term_counts(spark, d):
    return counts(spark, d).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@query("a3_keywords", f"WITH {COUNTS}, r AS (SELECT id, term, n, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS INTEGER) AS rank FROM counts) SELECT * FROM r WHERE rank <= 5")
def a3_keywords(spark, d):
    return T.keywords(counts(spark, d), 5).select("id", "term", "n", "rank")


@query("a4_keywords_first_seen", f'WITH {COUNTS}, r AS (SELECT id, term, n, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, "first", term) AS INTEGER) AS rank FROM counts) SELECT * FROM r WHERE rank <= 5')
def a4_keywords_first_seen(spark, d):
    return T.keywords(counts(spark, d), 5, "first").select("id", "term", "n", "rank")


@query("a31_shared_topics", f"WITH {COUNTS} SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS score FROM counts GROUP BY 1 HAVING count(*) >= 5 ORDER BY df DESC, score DESC, term LIMIT 50")
def a31_shared_topics(spark, d):
    found = counts(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("score")).where("df >= 5")
    return found.orderBy(F.desc("df"), F.desc("score"), "term").limit(50)


@query("a27_bigrams", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1) AS w FROM documents),
g AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM w)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM g GROUP BY 1 HAVING count(*) >= 3""")
def a27_bigrams(spark, d):
    return T.ngram_counts(documents(spark, d), 2).where("n >= 3")


@query("a22_window_pairs", f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3 AND t NOT IN ({STOP})) AS w FROM conversations),
p AS (SELECT unnest(flatten([[{{'x': w[i], 'y': w[i + k], 'k': k}} FOR i IN range(1, len(w) - k + 1)] FOR k IN [1, 2, 3]]), recursive := true) FROM w)
SELECT least(x, y) AS "left", greatest(x, y) AS "right", count(*) AS n, round(avg(k), 6) AS distance FROM p GROUP BY 1, 2""")
def a22_window_pairs(spark, d):
    found = T.window_pairs(table(spark, d, "conversations").withColumn("id", F.col("conv_id")), 3, least=3, stopwords=STOPWORDS)
    return found.withColumn("distance", F.round("distance", 6))


@query("a23_cooccurrence", f"""WITH {COUNTS}, df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60), h AS (SELECT id, term, df FROM counts JOIN df USING (term)),
p AS (SELECT a.term AS "left", b.term AS "right", a.df AS da, b.df AS db, count(*) AS together FROM h a JOIN h b ON a.id = b.id AND a.term < b.term GROUP BY 1, 2, 3, 4)
SELECT "left", "right", together, round(together / (da + db - together), 6) AS jaccard, round(together / least(da, db), 6) AS overlap, round((together / (da + db - together) + together / least(da, db)) / 2, 6) AS score FROM p""")
def a23_cooccurrence(spark, d):
    found = T.cooccurrence(counts(spark, d), 60)
    return found.select("left", "right", "together", *(F.round(c, 6).alias(c) for c in ("jaccard", "overlap", "score")))


@query("a29_bridge_terms", f"WITH {COUNTS} SELECT term, count(DISTINCT lang) AS labels, string_agg(DISTINCT lang, ',' ORDER BY lang) AS names FROM counts JOIN documents ON id = doc_id GROUP BY 1 HAVING count(DISTINCT lang) >= 2")
def a29_bridge_terms(spark, d):
    return T.bridge_terms(counts(spark, d).join(documents(spark, d).select("id", "lang"), "id"), "lang")


@query("j17_label_overlap", f"""WITH {COUNTS}, s AS (SELECT DISTINCT lang AS id, term FROM counts JOIN documents ON id = doc_id), z AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard, round(shared / least(x.n, y.n), 6) AS overlap FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b""")
def j17_label_overlap(spark, d):
    sets = counts(spark, d).join(documents(spark, d).select("id", "lang"), "id").select(F.col("lang").alias("id"), "term").distinct()
    return rounded(T.set_similarity(sets))


def rounded(pairs):
    return pairs.withColumns({"jaccard": F.round("jaccard", 6), "overlap": F.round("overlap", 6)})


#: Pairs of distinct term sets of whole documents, each named by the smallest id that has it.
PAIRS = f"""WITH {COUNTS}, k AS (SELECT id, string_agg(term, ' ' ORDER BY term) AS k FROM counts GROUP BY 1), c AS (SELECT min(id) AS id, count(*) AS copies, k FROM k GROUP BY k),
s AS (SELECT id, unnest(string_split(k, ' ')) AS term FROM c), z AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
j AS (SELECT a, b, shared, shared / (x.n + y.n - shared) AS jaccard, shared / least(x.n, y.n) AS overlap FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE shared / (x.n + y.n - shared) >= 0.5)"""


def similar(spark, d, least=0.5):
    """Pairs of distinct term sets of documents with a Jaccard similarity of a half."""
    return T.jaccard_pairs(counts(spark, d).select("id", "term"), least, documents(spark, d).count())


TURNS = f"""tok AS (SELECT conv_id, turn AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)) AS term FROM conversations),
counts AS (SELECT conv_id, id, term, count(*) AS n FROM tok WHERE length(term) >= 3 AND term NOT IN ({STOP}) GROUP BY 1, 2, 3)"""
TURN_PAIRS = f"""WITH {TURNS}, z AS (SELECT conv_id, id, count(*) AS n FROM counts GROUP BY 1, 2), p AS (SELECT a.conv_id, a.id AS a, b.id AS b, count(*) AS shared FROM counts a JOIN counts b ON a.conv_id = b.conv_id AND a.term = b.term AND a.id < b.id GROUP BY 1, 2, 3),
j AS (SELECT p.*, shared / (x.n + y.n - shared) AS jaccard, shared / least(x.n, y.n) AS overlap FROM p JOIN z x ON x.conv_id = p.conv_id AND x.id = a JOIN z y ON y.conv_id = p.conv_id AND y.id = b)"""


#: Names of the shared terms of each pair of ``r``, in order, eight at most.
SHARED = "t AS (SELECT conv_id, id, list(DISTINCT term) AS terms FROM counts GROUP BY 1, 2), l AS (SELECT r.*, list_sort(list_intersect(x.terms, y.terms))[1:8] AS shared_terms FROM r JOIN t x ON x.conv_id = r.conv_id AND x.id = a JOIN t y ON y.conv_id = r.conv_id AND y.id = b WHERE rank <= 5)"


def turn_counts(spark, d):
    """Terms of the turns of conversations, which are to each conversation what chunks are to a file."""
    words = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), F.explode(tokens("text", least=3, stopwords=STOPWORDS)).alias("term"))
    return words.groupBy("conv_id", "id", "term").agg(F.count("*").alias("n"))


@query("j1_cross_references", TURN_PAIRS + """, e AS (SELECT conv_id, a, b, shared FROM p WHERE shared >= 2 UNION ALL SELECT conv_id, b, a, shared FROM p WHERE shared >= 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, a ORDER BY shared DESC, b) AS INTEGER) AS rank FROM e), """ + SHARED + " SELECT * FROM l")
def j1_cross_references(spark, d):
    """For each turn the turns of its conversation that share most terms with it, and the first eight of those terms."""
    terms = turn_counts(spark, d).drop("n")
    pairs = T.scoped_similarity(terms, ["conv_id"], least_shared=2).select("conv_id", "a", "b", "shared")
    return T.with_shared_terms(T.top_neighbours(T.both_ways(pairs), "shared", 5, ("conv_id",)), terms, ["conv_id"], 8)


@query("j5_jaccard_pairs", PAIRS + " SELECT a, b, shared, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM j")
def j5_jaccard_pairs(spark, d):
    return rounded(similar(spark, d))


@query("j5_loose_pairs", PAIRS.replace(">= 0.5)", ">= 0.2)") + " SELECT a, b, shared, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM j")
def j5_loose_pairs(spark, d):
    """The same at a fifth."""
    return rounded(similar(spark, d, 0.2))


@query("j5_members", PAIRS + ", y AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j) SELECT k.id, c.id AS class_id, (SELECT count(*) FROM y WHERE y.a = c.id) AS links FROM k JOIN c USING (k)")
def j5_members(spark, d):
    """Each document with the class of its term set, and how many other classes that is similar to."""
    links = T.both_ways(similar(spark, d).select("a", "b")).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    members = T.set_members(counts(spark, d).select("id", "term"))
    return members.join(links, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query("j2_tfidf_cosine", f"""WITH {TURNS}, n AS (SELECT conv_id, count(DISTINCT id) AS of FROM counts GROUP BY 1), df AS (SELECT conv_id, term, count(*) AS df FROM counts GROUP BY 1, 2),
w AS (SELECT conv_id, id, term, counts.n * (ln((of + 1) / (df + 1)) + 1) AS w FROM counts JOIN df USING (conv_id, term) JOIN n USING (conv_id) WHERE df <= 0.75 * of), z AS (SELECT conv_id, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1, 2),
u AS (SELECT conv_id, id, term, w / norm AS w FROM w JOIN z USING (conv_id, id)),
p AS (SELECT a.conv_id, a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.term = b.term AND a.id < b.id GROUP BY 1, 2, 3 HAVING sum(a.w * b.w) >= 0.02),
e AS (SELECT conv_id, a, b, round(cosine, 9) AS cosine FROM p UNION ALL SELECT conv_id, b, a, round(cosine, 9) FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY cosine DESC, b) AS rank FROM e),
""" + SHARED + " SELECT conv_id, a, b, round(cosine, 6) AS cosine, shared_terms FROM l WHERE a < b")
def j2_tfidf_cosine(spark, d):
    """Similar turns of a conversation, by the weight of the terms that they share, and the first eight of those terms."""
    counted = turn_counts(spark, d)
    pairs = T.tfidf_cosine(counted, ["conv_id"], 0.02, 5).withColumn("cosine", F.round("cosine", 6))
    return T.with_shared_terms(pairs, counted, ["conv_id"], 8)


@query("j3_bipartite_match", f"""WITH {COUNTS}, i AS (SELECT item_id AS id, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))) AS term FROM benchmark), x AS (SELECT id, count(*) AS n FROM i GROUP BY 1), z AS (SELECT id, count(*) AS n FROM counts GROUP BY 1),
p AS (SELECT i.id AS a, counts.id AS b, count(*) AS shared FROM i JOIN counts USING (term) GROUP BY 1, 2), j AS (SELECT a, b, shared / (x.n + z.n - shared) AS s FROM p JOIN x ON x.id = a JOIN z ON z.id = b WHERE shared >= 2), k AS (SELECT a, b, round(s, 6) AS s FROM j WHERE s >= 0.02),
g AS (SELECT unnest(list_reduce(list([{{'a': a, 'b': b, 's': s}}] ORDER BY s DESC, a, b), lambda acc, y: CASE WHEN len(list_filter(acc, lambda q: q.a = y[1].a)) < 3 AND len(list_filter(acc, lambda q: q.b = y[1].b)) < 1 THEN list_concat(acc, y) ELSE acc END)) AS q FROM k) SELECT q.a, q.b, q.s AS jaccard FROM g""")
def j3_bipartite_match(spark, d):
    """Benchmark items and documents, matched from the best pair on with at most one and three partners."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.array_distinct(tokens("text", least=3, stopwords=STOPWORDS))).alias("term"))
    own = counts(spark, d).select("id", "term")
    pairs = T.set_similarity(items, 0.02, 2, other=own).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
    return T.greedy_match(pairs, "jaccard", 3, 1)
