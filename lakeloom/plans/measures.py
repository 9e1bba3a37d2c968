"""Queries of signals, taxonomies, usage and scalar functions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import lexicon as L
from ..operators import ordered as O
from ..operators import profile as P
from ..operators import rules as R
from ..operators import search as SE
from ..operators import signals as G
from ..operators import stores as S
from ..operators import terms as T
from .base import query, table
from .labels import WORDS, listed
from .matches import key_terms, vectors
from .ordered import JACCARD, STOP, TERMS, terms
from .relations import SENTENCES
from .terms import COUNTS, TURNS, counts, turn_counts


def turns(spark, d):
    return table(spark, d, "conversations")


def has(words):
    return f"list_has_any(w, [{', '.join(repr(x) for x in words)}])"


CATEGORY = ", ".join(
    f"CASE WHEN {has(words)}" + "".join(f" OR contains(lower(text), '{p}')" for p in phrases) + (" OR contains(text, '?')" if name == "question" else "") + f" THEN '{name}' END" for name, words, phrases in G.CONVERSATION_RULES
)


@query("p28_categories", f"WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, {WORDS} AS w FROM conversations), c AS (SELECT conv_id, turn, list_filter([{CATEGORY}], lambda x: x IS NOT NULL) AS c FROM t) SELECT conv_id, turn, CASE WHEN len(c) = 0 THEN ['statement'] ELSE c[1:3] END AS categories FROM c")
def p28_categories(spark, d):
    """Up to three categories of every turn."""
    return turns(spark, d).select("conv_id", "turn", G.categories(F.col("text"), most=3).alias("categories"))


#: A small taxonomy over words that the texts have.
TAXONOMY = {"article": ("the", "der", "die", "das", "el", "la", "le"), "link": ("and", "or", "und", "et", "con"), "place": ("in", "on", "at", "to", "zu", "en", "sur"), "verb": ("is", "was", "be", "are", "ist", "est")}
TAXED = "list_sort(list_filter([" + ", ".join(f"{{'s': -len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))), 'k': {k}, 'name': '{n}'}}" for k, (n, ws) in enumerate(TAXONOMY.items())) + "], lambda x: x.s < 0))[1:2]"
ASSIGNED = f"t AS (SELECT doc_id, {WORDS} AS w FROM documents), a AS (SELECT doc_id, w, {TAXED} AS c FROM t), c AS (SELECT doc_id, w, CASE WHEN len(c) = 0 THEN [{{'name': 'other', 'hits': 0}}] ELSE list_transform(c, lambda x: {{'name': x.name, 'hits': CAST(-x.s AS INTEGER)}}) END AS c FROM a)"


@query("p27_taxonomy", f"WITH {ASSIGNED} SELECT doc_id, list_transform(c, lambda x: x.name) AS names, list_transform(c, lambda x: x.hits) AS hits FROM c")
def p27_taxonomy(spark, d):
    """The two categories of a taxonomy that a document's words hit most."""
    found = table(spark, d, "documents").select("doc_id", G.assigned(X.tokens("text"), TAXONOMY, 2).alias("c"))
    return found.select("doc_id", F.col("c.name").alias("names"), F.col("c.hits").alias("hits"))


@query("a19_taxonomy_buckets", f"WITH {ASSIGNED}, r AS (SELECT unnest(c).name AS category, w FROM c), n AS (SELECT category, count(*) AS items FROM r GROUP BY 1), k AS (SELECT category, t, count(*) AS n FROM (SELECT category, unnest(w) AS t FROM r) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, t) AS k FROM k) SELECT n.category, n.items, coalesce(list(t ORDER BY k) FILTER (t IS NOT NULL), []) AS terms FROM n LEFT JOIN b ON b.category = n.category AND k <= 3 GROUP BY 1, 2")
def a19_taxonomy_buckets(spark, d):
    """Documents and most frequent words of each category."""
    # a text becomes words once, for all categories
    named = F.transform(F.array(X.tokens("text")), lambda w: F.transform(G.assigned(w, TAXONOMY, 2), lambda c: F.struct(c["name"].alias("category"), w.alias("words"))))
    found = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.flatten(named)).alias("x"))
    return G.buckets(found.select("id", "x.category", "x.words"), 3)


def neg_sql(w):
    return f"len(list_filter({w}, lambda x: x IN ('not', 'no', 'never', 'none'))) / greatest(len({w}), 1)"


TONE = f"CASE WHEN {listed(R.POSITIVE)} > {listed(R.NEGATIVE)} THEN 'positive' WHEN {listed(R.POSITIVE)} < {listed(R.NEGATIVE)} THEN 'negative' ELSE 'neutral' END"
STANCE = f"CASE WHEN greatest(p1, p2, p3) = 0 THEN 'unknown' WHEN (p1 = greatest(p1, p2, p3))::INT + (p2 = greatest(p1, p2, p3))::INT + (p3 = greatest(p1, p2, p3))::INT > 1 THEN 'mixed' WHEN p1 = greatest(p1, p2, p3) THEN 'first' WHEN p2 = greatest(p1, p2, p3) THEN 'second' ELSE 'third' END"
INTENT = f"CASE WHEN ends_with(trim(text, ' '), '?') THEN 'question' WHEN {listed(R.REQUEST)} > 0 THEN 'request' WHEN {listed(R.DIRECTIVE)} > 0 THEN 'directive' ELSE 'statement' END"
SIGNALS = f"s0 AS (SELECT conv_id, turn, text, {WORDS} AS w FROM conversations), s1 AS (SELECT *, {listed(R.PRONOUNS['first'])} AS p1, {listed(R.PRONOUNS['second'])} AS p2, {listed(R.PRONOUNS['third'])} AS p3 FROM s0), s2 AS (SELECT conv_id, turn, {TONE} AS tone, {STANCE} AS stance, {INTENT} AS intent, {neg_sql('w')} AS negation, list_distinct(list_filter(w, lambda t: length(t) >= 3 AND t NOT IN ({STOP}))) AS terms FROM s1)"


@query("p17_sentiment", f"WITH {SIGNALS} SELECT conv_id, turn, tone FROM s2")
def p17_sentiment(spark, d):
    return turns(spark, d).select("conv_id", "turn", R.sentiment(F.col("text")).alias("tone"))


@query("p18_perspective", f"WITH {SIGNALS} SELECT conv_id, turn, stance FROM s2")
def p18_perspective(spark, d):
    return turns(spark, d).select("conv_id", "turn", R.perspective(F.col("text")).alias("stance"))


@query("p15_effort", f"WITH t AS (SELECT doc_id, len({WORDS}) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 60 THEN 'low' WHEN n <= 200 THEN 'medium' ELSE 'high' END AS effort FROM t")
def p15_effort(spark, d):
    """A band of effort from the number of words."""
    return table(spark, d, "documents").select("doc_id", R.bands(F.size(X.tokens("text")), [(60, "low"), (200, "medium")], "high").alias("effort"))


@query("p19_relationships", f"""WITH {SIGNALS}, l AS (SELECT *, lag(tone) OVER o AS t0, lag(stance) OVER o AS s0, lag(intent) OVER o AS i0, lag(negation) OVER o AS n0, lag(terms) OVER o AS w0 FROM s2 WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, {JACCARD.format(a='terms', b='w0')} >= 0.02 AS alike, list_filter([CASE WHEN t0 <> tone AND t0 <> 'neutral' AND tone <> 'neutral' THEN 'tone:' || t0 || '->' || tone END, CASE WHEN s0 <> stance AND s0 <> 'unknown' AND stance <> 'unknown' THEN 'stance:' || s0 || '->' || stance END, CASE WHEN i0 <> intent THEN 'intent:' || i0 || '->' || intent END, CASE WHEN abs(n0 - negation) >= 0.3 THEN 'negation-shift' END], lambda x: x IS NOT NULL) AS shifts FROM l WHERE w0 IS NOT NULL)
SELECT conv_id, turn, CASE WHEN alike AND len(shifts) > 0 THEN 'contrast' WHEN alike THEN 'reinforcing' ELSE 'adjacent' END AS kind, shifts FROM r""")
def p19_relationships(spark, d):
    """How each turn stands to the one before: contrast, reinforcing or adjacent, with what shifts."""
    text = F.col("text")
    words = X.tokens("text")
    negation = R.count_in(words, ("not", "no", "never", "none")) / F.greatest(F.size(words), F.lit(1))
    s = F.struct(R.sentiment(text).alias("tone"), R.perspective(text).alias("stance"), R.intent(text).alias("intent"), negation.alias("negation"), terms().alias("terms"))
    rows = turns(spark, d).select("conv_id", "turn", s.alias("y")).withColumn("x", F.lag("y").over(Window.partitionBy("conv_id").orderBy("turn"))).where("x is not null")
    found = rows.select("conv_id", "turn", G.relationship("x", "y", V.jaccard(F.col("x.terms"), F.col("y.terms")) >= 0.02).alias("r"))
    return found.select("conv_id", "turn", "r.kind", "r.shifts")


CAPS = "regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9'']+)', 1)"
TRIPLE = "len(list_filter(range(1, length({w}) - 1), lambda i: lower({w})[i] = lower({w})[i + 1] AND lower({w})[i] = lower({w})[i + 2] AND regexp_matches(lower({w})[i], '[a-z]'))) > 0"


@query("p26_word_levels", f"WITH w AS (SELECT doc_id, unnest({CAPS}) AS word, generate_subscripts({CAPS}, 1) AS place FROM documents), l AS (SELECT doc_id, CAST(place AS INTEGER) AS place, word, CASE WHEN length(word) > 2 AND upper(word) = word AND lower(word) <> word THEN 2.0 ELSE 0 END + CASE WHEN lower(word) IN ('very', 'really', 'the') THEN 1.5 ELSE 0 END + CASE WHEN {TRIPLE.format(w='word')} THEN 1.0 ELSE 0 END AS db FROM w) SELECT doc_id, place, word, CAST(db AS DOUBLE) AS db FROM l WHERE db > 0")
def p26_word_levels(spark, d):
    """Words that are louder than the rest, with their decibels."""
    found = table(spark, d, "documents").select("doc_id", F.explode(G.word_levels(F.col("text"), ("very", "really", "the"))).alias("l"))
    return found.select("doc_id", "l.place", "l.word", "l.db")


@query("f38_decibel_plan", f"""WITH t AS (SELECT conv_id, turn, text, {CAPS} AS w FROM conversations), m AS (SELECT *, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1) AS mean, len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) / greatest(len(w), 1) AS caps, len(list_filter(w, lambda x: lower(x) IN ('um', 'the'))) / greatest(len(w), 1) AS fill FROM t),
g AS (SELECT conv_id, turn, CAST(greatest(-6.0, least(8.0, CASE WHEN n > 0 AND n <= 5 THEN 2.0 ELSE 0 END + CASE WHEN coalesce(mean, 0) >= 7 THEN 1.0 ELSE 0 END + CASE WHEN caps >= 0.2 THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(text, '[!?]') THEN 1.0 ELSE 0 END - CASE WHEN fill >= 0.1 THEN 2.0 ELSE 0 END)) AS DOUBLE) AS gain_db FROM m) SELECT conv_id, turn, 60 + gain_db AS target_db, gain_db, CASE WHEN abs(gain_db) * 4 <= 4 THEN 'loud' WHEN abs(gain_db) * 4 <= 8 THEN 'medium' ELSE 'soft' END AS volume FROM g""")
def f38_decibel_plan(spark, d):
    """Loudness of every turn, and a volume band of its change."""
    found = turns(spark, d).select("conv_id", "turn", G.decibel_plan(F.col("text"), ("um", "the")).alias("p")).select("conv_id", "turn", "p.*")
    return found.withColumn("volume", G.volume_band(F.abs("gain_db") * 4, "soft", "medium", "loud"))


@query("f38_flux", "WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN 1.0 WHEN '2' THEN 0.5 ELSE 0.0 END AS p, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END AS v, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END AS r FROM orders), x AS (SELECT o_custkey, (abs(p - lag(p) OVER w) + abs(v - lag(v) OVER w) + abs(r - lag(r) OVER w)) / 3 AS f FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, round(coalesce(avg(f), 0.0), 6) AS flux FROM x GROUP BY 1")
def f38_flux(spark, d):
    """Mean change of three levels along a sequence."""
    level = lambda c, one, half: F.when(c == one, 1.0).when(c == half, 0.5).otherwise(0.0)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", level(F.substring("o_orderpriority", 1, 1), "1", "2").alias("pitch"), level(F.col("o_orderstatus"), "F", "O").alias("volume"), F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0).alias("rate"))
    return G.flux(o, ["o_custkey"], "o_orderkey")


@query("p29_own_segments", "WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 OR turn % 3 = 2 THEN NULL WHEN conv_id % 3 = 1 THEN 'assistant' ELSE role END AS speaker FROM conversations), m AS (SELECT *, coalesce(speaker = 'user', false) AS mine, bool_or(coalesce(speaker = 'user', false)) OVER (PARTITION BY conv_id) AS anyone, bool_or(speaker IS NOT NULL) OVER (PARTITION BY conv_id) AS named FROM t) SELECT conv_id, turn, speaker, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM m WHERE CASE WHEN anyone THEN mine WHEN NOT named THEN true ELSE speaker IS NULL END")
def p29_own_segments(spark, d):
    """A speaker's own segments, or what may be theirs where nobody is named so."""
    speaker = F.when((F.col("conv_id") % 3 == 0) | (F.col("turn") % 3 == 2), F.lit(None)).when(F.col("conv_id") % 3 == 1, "assistant").otherwise(F.col("role"))
    return G.own_segments(turns(spark, d).select("conv_id", "turn", speaker.alias("speaker")), ["conv_id"], "turn", ["User"])


@query("p20_marked_sentences", f"WITH s AS (SELECT conv_id, turn, {SENTENCES} AS s FROM conversations) SELECT conv_id, turn, list_filter(s, lambda x: regexp_matches(lower(x), ' (the|that) '))[1:2] AS marked FROM s")
def p20_marked_sentences(spark, d):
    """The first two sentences with a marker."""
    return turns(spark, d).select("conv_id", "turn", G.marked_sentences(F.col("text"), " (the|that) ", 2).alias("marked"))


@query("f31_rationales", f"WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM documents) SELECT doc_id, list_filter(s, lambda x: regexp_matches(lower(x), '(^|[^a-z])(for|as|so)[^a-z]'))[1:3] AS rationales, list_filter(s, lambda x: regexp_matches(lower(x), '[a-z] (is|are) [a-z]'))[1:3] AS definitions, list_filter(s, lambda x: regexp_matches(lower(x), '[?]$'))[1:3] AS questions FROM s")
def f31_rationales(spark, d):
    """Sentences that give reasons, define or ask, three of each at most."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", G.marked_sentences(t, "(^|[^a-z])(for|as|so)[^a-z]", 3).alias("rationales"), G.marked_sentences(t, "[a-z] (is|are) [a-z]", 3).alias("definitions"), G.marked_sentences(t, "[?]$", 3).alias("questions"))


@query("p23_citations", "SELECT item_id AS id, 'e' || (item_id % 4) AS citation FROM benchmark WHERE item_id % 4 <> 1 UNION ALL SELECT item_id, 'x' FROM benchmark")
def p23_citations(spark, d):
    """Bracketed citations that name no evidence: of two, the one that is there and one that is not."""
    b = table(spark, d, "benchmark")
    answers = b.select(F.col("item_id").alias("id"), F.concat(F.lit("Shown in [e"), F.col("item_id") % 4, F.lit("] and [x], again [x].")).alias("text"))
    return R.citation_errors(answers, b.select(F.col("item_id").alias("id"), F.lit("e1").alias("evidence_id")))


@query("a15_weighted_terms", f"WITH {TURNS} SELECT term, round(sum(n * (1.0 / (1 + id))), 6) AS weight FROM counts GROUP BY 1 HAVING count(*) >= 2")
def a15_weighted_terms(spark, d):
    """Counts of terms, weighted by how early their turn is."""
    c = turn_counts(spark, d)
    return c.groupBy("term").agg(F.round(F.sum(F.col("n") * (1.0 / (1 + F.col("id")))), 6).alias("weight"), F.count("*").alias("k")).where("k >= 2").drop("k")


@query("a24_attention", f"""WITH w AS (SELECT list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3 AND t NOT IN ({STOP})) AS w FROM conversations), p AS (SELECT unnest([{{'x': w[i], 'y': w[i + 1]}} FOR i IN range(1, len(w))], recursive := true) FROM w),
n AS (SELECT least(x, y) AS l, greatest(x, y) AS r, count(*) AS n FROM p WHERE x <> y GROUP BY 1, 2), e AS (SELECT l AS term, r AS other, n FROM n UNION ALL SELECT r, l, n FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, other) AS k FROM e) SELECT term, CAST(sum(n) AS BIGINT) AS total, list(other ORDER BY k) FILTER (k <= 3) AS links FROM k GROUP BY 1""")
def a24_attention(spark, d):
    """Terms with the number of their neighbours and the three most frequent of these."""
    pairs = T.window_pairs(turns(spark, d).withColumn("id", F.col("conv_id")), 1, least=3, stopwords=X.STOPWORDS)
    return G.pair_links(pairs, 3)


@query("a26_symbol_rules", "WITH s AS (SELECT DISTINCT user_id AS id, event_type AS type, 'k' || (CAST(json_extract(props, '$.k') AS INTEGER) // 20) AS symbol, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS related FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY type, symbol, related ORDER BY id) AS k FROM s) SELECT type, symbol, related, count(*) AS n, list(id ORDER BY id) FILTER (k <= 3) AS evidence FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def a26_symbol_rules(spark, d):
    """Relations that at least two users show, with the first three of them."""
    e = table(spark, d, "events")
    k = F.floor(F.from_json("props", "k int")["k"] / 20).cast("string")
    rows = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), F.concat(F.lit("k"), k).alias("symbol"), F.when(F.col("value") > 50, "high").otherwise("low").alias("related"))
    return G.symbol_rules(rows, 2, 3)


CENTROID = "list_sum(list_transform(m, lambda x, i: x * (i - 1) * 100.0 / 64)) / list_sum(m)"


@query("a42_wave_stats", f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64), f AS (SELECT vec_id, v, list_transform(range(0, 33), lambda k: sqrt(pow(list_sum(list_transform(v, lambda x, i: x * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(v, lambda x, i: x * sin(2 * pi() * k * (i - 1) / 64))), 2))) AS m FROM e) SELECT vec_id, round(sqrt(list_dot_product(v, v) / 64), 6) AS rms, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak, round(len(list_filter(range(2, 65), lambda i: (v[i] >= 0) <> (v[i - 1] >= 0))) / 63, 6) AS crossings, round({CENTROID}, 4) AS centroid FROM f")
def a42_wave_stats(spark, d):
    """Level, peak, zero crossings and spectral centroid, of vectors taken as waves at 100 Hz."""
    w = table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", G.wave_stats(F.col("embedding"), 100).alias("s"))
    return w.select("vec_id", F.round("s.rms", 6).alias("rms"), F.round("s.peak", 6).alias("peak"), F.round("s.crossings", 6).alias("crossings"), F.round("s.centroid", 4).alias("centroid"))


@query("a47_style_references", "SELECT o_orderpriority AS term, o_orderstatus AS category, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:5] AS segments FROM orders GROUP BY 1, 2")
def a47_style_references(spark, d):
    """Terms by category, with their number and the first five places, which every part of a term finds for itself first."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("term"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("id"), F.pmod(F.xxhash64("o_orderkey"), F.lit(64)).alias("part"))
    five = o.withColumn("k", F.row_number().over(Window.partitionBy("term", "category", "part").orderBy("id"))).where("k <= 5")
    first = five.groupBy("term", "category").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("segments"))
    return o.groupBy("term", "category").agg(F.count("*").alias("n")).join(first, ["term", "category"]).select("term", "category", "n", "segments")


DOMAINS = ", ".join(f"('{n}', '{w}')" for n, ws in TAXONOMY.items() for w in ws)
USAGE = f"wc AS (SELECT conv_id AS id, t AS term, count(*) AS n FROM (SELECT conv_id, unnest({WORDS}) AS t FROM conversations) GROUP BY 1, 2), l(tag, term) AS (VALUES {DOMAINS}), z AS (SELECT id, sum(n) AS words FROM wc GROUP BY 1), u AS (SELECT id, tag, CAST(sum(n) AS BIGINT) AS hits, CAST(any_value(words) AS BIGINT) AS words, round(sum(n) / any_value(words), 6) AS coverage FROM wc JOIN l USING (term) JOIN z USING (id) GROUP BY 1, 2)"


def used(spark, d):
    words = turns(spark, d).select(F.col("conv_id").alias("id"), F.explode(X.tokens("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    lists = spark.createDataFrame([(n, w) for n, ws in TAXONOMY.items() for w in ws], "tag string, term string")
    return words, G.usage(words, lists)


@query("a49_domain_usage", f"WITH {USAGE}, b AS (SELECT id, 'verb' AS tag, 0.05 AS boost FROM u WHERE tag = 'place' AND hits > 3), s AS (SELECT coalesce(u.id, b.id) AS id, coalesce(u.tag, b.tag) AS tag, round(coalesce(coverage, 0) + coalesce(boost, 0), 6) AS score FROM u FULL JOIN b ON u.id = b.id AND u.tag = b.tag), r AS (SELECT id, tag, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def a49_domain_usage(spark, d):
    """Domains of a conversation by the words that their lists cover, one with a boost where another is frequent."""
    _, found = used(spark, d)
    boosts = found.where("tag = 'place' and hits > 3").select("id", F.lit("verb").alias("tag"), F.lit(0.05).alias("boost"))
    return G.recommended(found, boosts, 3)


@query("a51_variant_usage", f"WITH {USAGE}, b AS (SELECT id, tag, 0.2 AS boost FROM u WHERE coverage > 0.1 UNION ALL SELECT id, tag, 0.1 FROM u WHERE hits >= 4), s AS (SELECT u.id, u.tag, round(coverage + coalesce((SELECT sum(boost) FROM b WHERE b.id = u.id AND b.tag = u.tag), 0), 6) AS score FROM u), r AS (SELECT id, tag, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 1")
def a51_variant_usage(spark, d):
    """The variant that fits a conversation best, with boosts from a table of rules."""
    _, found = used(spark, d)
    boosts = found.where("coverage > 0.1").select("id", "tag", F.lit(0.2).alias("boost")).unionAll(found.where("hits >= 4").select("id", "tag", F.lit(0.1)))
    return G.recommended(found, boosts, 1)


@query("a53_document_summaries", f"WITH {TURNS}, s AS (SELECT conv_id, count(*) AS chunks, round(avg(length(text)), 4) AS chars FROM conversations GROUP BY 1), k AS (SELECT conv_id, term, sum(n) AS n FROM counts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS k FROM k) SELECT s.conv_id, chunks, chars, list(term ORDER BY k) AS keywords FROM s JOIN r ON r.conv_id = s.conv_id AND k <= 3 GROUP BY 1, 2, 3")
def a53_document_summaries(spark, d):
    """Conversations with the number and mean size of their turns and their keywords."""
    size = turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 4).alias("chars"))
    total = turn_counts(spark, d).groupBy("conv_id", "term").agg(F.sum("n").alias("n"))
    best = total.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "term"))).where("k <= 3")
    words = best.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("keywords"))
    return size.join(words, "conv_id")


FORMS = r"""fr AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS r FROM documents),
fs AS (SELECT doc_id, round(len(list_filter(r, lambda x: regexp_matches(x, '[{};]\s*$|^\s*(def|class|import|return|if|for)\b.*[:(]'))) / greatest(len(r), 1), 6) AS code, round(len(list_filter(r, lambda x: regexp_matches(x, '^\s*([-*+]|[0-9]+[.)])\s+'))) / greatest(len(r), 1), 6) AS list, round(len(list_filter(r, lambda x: regexp_matches(x, '\|.*\|'))) / greatest(len(r), 1), 6) AS tab, round(len(list_filter(r, lambda x: regexp_matches(x, '^[A-Z][A-Za-z]{0,20}:\s'))) / greatest(len(r), 1), 6) AS dialogue, round(len(list_filter(r, lambda x: regexp_matches(x, '^#{1,6}\s'))) / greatest(len(r), 1), 6) AS heading FROM fr),
ff AS (SELECT doc_id, greatest(code, list, tab, dialogue, heading) AS top, CASE WHEN greatest(code, list, tab, dialogue, heading) < 0.2 THEN 'prose' WHEN code = greatest(code, list, tab, dialogue, heading) THEN 'code' WHEN dialogue = greatest(code, list, tab, dialogue, heading) THEN 'dialogue' WHEN heading = greatest(code, list, tab, dialogue, heading) THEN 'heading' WHEN list = greatest(code, list, tab, dialogue, heading) THEN 'list' ELSE 'table' END AS form FROM fs)"""


@query("f29_forms", f"WITH {FORMS} SELECT doc_id, form, top FROM ff")
def f29_forms(spark, d):
    """The form that most lines of a document have."""
    scores = G.form_scores(F.col("text"))
    return table(spark, d, "documents").select("doc_id", G.primary_form(scores).alias("form"), F.array_max(F.map_values(scores)).alias("top"))


@query("a54_form_summaries", f"WITH {FORMS}, t AS (SELECT doc_id, {WORDS} AS w FROM documents), k AS (SELECT form, x, count(*) AS n FROM (SELECT form, unnest(list_filter(w, lambda y: length(y) >= 3)) AS x FROM ff JOIN t USING (doc_id)) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, x) AS k FROM k) SELECT form AS category, (SELECT count(*) FROM ff y WHERE y.form = r.form) AS items, list(x ORDER BY k) AS terms FROM r WHERE k <= 3 GROUP BY form")
def a54_form_summaries(spark, d):
    """Documents and keywords of each form."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), G.primary_form(G.form_scores(F.col("text"))).alias("category"), X.tokens("text", least=3).alias("words"))
    return G.buckets(rows, 3)


@query("a55_vowel_context", f"WITH w AS (SELECT conv_id, turn, t, regexp_replace(t, '[^aeiou]', '', 'g') AS v FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1)) AS t FROM conversations)) SELECT v AS vowels, count(*) AS n, count(DISTINCT t) AS words, list_sort(list_distinct(list(t)))[1:3] AS sample, count(DISTINCT (conv_id, turn)) AS segments FROM w WHERE v <> '' GROUP BY 1")
def a55_vowel_context(spark, d):
    """Sequences of vowels with their words and segments."""
    w = turns(spark, d).select("conv_id", "turn", F.explode(X.tokens("text", pattern="[a-z]+")).alias("t")).withColumn("v", X.vowels(F.col("t"))).where("v <> ''")
    words = w.groupBy("v", "t").agg(F.count("*").alias("n"))
    found = words.groupBy(F.col("v").alias("vowels")).agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.slice(F.array_sort(F.collect_set("t")), 1, 3).alias("sample"))
    return found.join(w.select("v", "conv_id", "turn").distinct().groupBy(F.col("v").alias("vowels")).agg(F.count("*").alias("segments")), "vowels")


@query("a56_lexicon_stats", f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), l AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'und', 'con', 'les'))) / greatest(len(w), 1) AS density, list_filter(w, lambda x: x IN ('the', 'und', 'con', 'les')) AS h FROM t), k AS (SELECT x AS word, count(*) AS n FROM (SELECT unnest(h) AS x FROM l) GROUP BY 1) SELECT word, n, round((SELECT avg(density) FROM l), 6) AS mean_density FROM k")
def a56_lexicon_stats(spark, d):
    """Words of a lexicon by frequency, with the unweighted mean of the documents' densities."""
    listed_words = ("the", "und", "con", "les")
    words = table(spark, d, "documents").select("doc_id", X.tokens("text").alias("w"))
    mean = words.agg(F.round(F.avg(R.count_in(F.col("w"), listed_words) / F.greatest(F.size("w"), F.lit(1))), 6).alias("mean_density"))
    n = words.select(F.explode("w").alias("word")).where(F.col("word").isin(*listed_words)).groupBy("word").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(mean))


@query("a6_percentiles", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def a6_percentiles(spark, d):
    """Quantiles with linear interpolation."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.1)), 6).alias("p10"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query("a9_effect_sizes", "WITH s AS (SELECT event_type, count(value) FILTER (event_id % 2 = 0) AS n1, avg(value) FILTER (event_id % 2 = 0) AS m1, stddev_samp(value) FILTER (event_id % 2 = 0) AS s1, count(value) FILTER (event_id % 2 = 1) AS n2, avg(value) FILTER (event_id % 2 = 1) AS m2, stddev_samp(value) FILTER (event_id % 2 = 1) AS s2 FROM events GROUP BY 1) SELECT event_type, round((m2 - m1) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 6) AS effect FROM s")
def a9_effect_sizes(spark, d):
    """Difference of two halves by their pooled deviation."""
    half = lambda f, k: f(F.when(F.col("event_id") % 2 == k, F.col("value")))
    s = table(spark, d, "events").groupBy("event_type").agg(*(half(f, k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))))
    return s.select("event_type", F.round(P.pooled_effect(F.col("n0"), F.col("s0"), F.col("n1"), F.col("s1"), F.col("m1") - F.col("m0")), 6).alias("effect"))


@query("w7_focus_shifts", "WITH l AS (SELECT user_id, event_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, before, after FROM l WHERE before <> after")
def w7_focus_shifts(spark, d):
    return G.focus_shifts(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("w10_connections", f"""WITH t AS (SELECT conv_id, turn, text, role, {WORDS} AS w, lag(text) OVER o AS t0, lag(role) OVER o AS r0, lag({WORDS}) OVER o AS w0, row_number() OVER o AS k FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), e AS (SELECT *, right(rtrim(t0, ' '), 1) AS e FROM t WHERE k > 1)
SELECT conv_id, turn, CAST(round(greatest(0.0, least(1.0, CASE WHEN e IN ('.', '?', '!') THEN -0.2 WHEN e IN (',', ';', ':') THEN 0.25 ELSE 0.35 END + CASE WHEN coalesce(w0[-1], '') IN ('and', 'or', 'the') THEN 0.25 ELSE 0 END + CASE WHEN coalesce(w[1], '') IN ('and', 'is', 'of', 'to', 'the') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '^[a-z]') THEN 0.1 ELSE 0 END + CASE WHEN r0 = role THEN 0.2 ELSE -0.1 END)), 3) AS DOUBLE) AS connection FROM e""")
def w10_connections(spark, d):
    """How closely each turn follows on the one before."""
    rows = turns(spark, d).select("conv_id", "turn", "text", F.col("role").alias("speaker"))
    return G.connection(rows, ["conv_id"], "turn", ("and", "is", "of", "to", "the"), ("and", "or", "the")).select("conv_id", "turn", "connection")


@query("w13_marked_sequences", "WITH l AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1) // 4 AS k FROM l), n AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY g, k) AS island FROM c) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first FROM n GROUP BY 1, 2")
def w13_marked_sequences(spark, d):
    """Runs of events that a sign-up begins, four at most."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    found = O.islands(e, ["user_id"], ["event_id"], (F.col("event_type") == "signup") | F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).isNull(), 4)
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


HEADS = [("1", "1"), ("3", "2"), ("4", "CAST(2 + p_size % 2 AS INTEGER)"), ("6", "CAST(1 + p_partkey % 3 AS INTEGER)"), ("9", "CAST(1 + p_size % 3 AS INTEGER)"), ("10", "3")]


@query("w21_heading_sections", "WITH h AS (SELECT p_partkey AS id, unnest([" + ", ".join(a for a, _ in HEADS) + "]) AS line, unnest([" + ", ".join(b for _, b in HEADS) + "]) AS depth FROM part) SELECT id, line, depth, (SELECT max(x.line) FROM h x WHERE x.id = h.id AND x.line < h.line AND x.depth < h.depth) AS parent, (SELECT min(x.line) - 1 FROM h x WHERE x.id = h.id AND x.line > h.line AND x.depth <= h.depth) AS last FROM h")
def w21_heading_sections(spark, d):
    """Parents and ends of the sections of headings."""
    rows = F.array(*(F.struct(F.expr(a).alias("line"), F.expr(b).alias("depth")) for a, b in HEADS))
    heads = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(rows).alias("h")).select("id", "h.*")
    return O.parent_heading(heads, ["id"]).select("id", "line", "depth", "parent", F.col("end").alias("last"))


@query("w22_top_each", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def w22_top_each(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), "o_totalprice")
    return T.top_neighbours(pairs, "o_totalprice", 3).select(F.col("a").alias("o_custkey"), F.col("b").alias("o_orderkey"), "rank")


@query("o8_ranked_relations", f"WITH {TURNS}, z AS (SELECT conv_id, id, count(*) AS n FROM counts GROUP BY 1, 2), p AS (SELECT a.conv_id, a.id AS a, b.id AS b, count(*) AS shared FROM counts a JOIN counts b ON a.conv_id = b.conv_id AND a.term = b.term AND a.id < b.id GROUP BY 1, 2, 3) SELECT p.conv_id, a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN z x ON x.conv_id = p.conv_id AND x.id = a JOIN z y ON y.conv_id = p.conv_id AND y.id = b ORDER BY jaccard DESC, shared DESC, p.conv_id, a, b LIMIT 40")
def o8_ranked_relations(spark, d):
    """The forty closest pairs of turns: by similarity, shared terms, then place."""
    pairs = T.scoped_similarity(turn_counts(spark, d).drop("n"), ["conv_id"]).withColumn("jaccard", F.round("jaccard", 6))
    return pairs.select("conv_id", "a", "b", "shared", "jaccard").orderBy(F.desc("jaccard"), F.desc("shared"), "conv_id", "a", "b").limit(40)


@query("o12_evidence_sentences", f"WITH s AS (SELECT doc_id AS id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS pos FROM documents), c AS (SELECT *, round(2 * ((contains(lower(sentence), 'the '))::INT + (contains(lower(sentence), 'der '))::INT) + least(length(sentence) / 200, 1.0), 6) AS score FROM s), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM c) SELECT id, sentence, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 2")
def o12_evidence_sentences(spark, d):
    """The two sentences of a document that hold most of some terms."""
    return L.key_sentences(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["the ", "der "], 2)


@query("t4_style_changes", "WITH t AS (SELECT conv_id, turn, list_sort(list_filter(['the', 'and', 'is', 'of'], lambda x: contains(lower(text), ' ' || x || ' '))) AS s FROM conversations), l AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS s0 FROM t) SELECT conv_id, turn, list_sort(list_filter(s, lambda x: NOT list_contains(s0, x))) AS added, list_sort(list_filter(s0, lambda x: NOT list_contains(s, x))) AS removed FROM l WHERE s0 IS NOT NULL AND s <> s0")
def t4_style_changes(spark, d):
    """Styles that a turn adds to or drops from those of the turn before."""
    names = F.array(*(F.lit(x) for x in ("and", "is", "of", "the")))
    held = F.filter(names, lambda x: F.contains(F.lower("text"), F.concat(F.lit(" "), x, F.lit(" "))))
    rows = turns(spark, d).select("conv_id", "turn", held.alias("s")).withColumn("s0", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("s0 is not null and s <> s0")
    return rows.select("conv_id", "turn", F.array_except("s", "s0").alias("added"), F.array_except("s0", "s").alias("removed"))


@query("f1_tokens", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)) AS words, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_'']+)', 1)) AS quoted, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z]+(?:[''-][a-z]+)*)', 1)) AS letters, len(regexp_extract_all(lower(coalesce(text, '')), '([a-z_][a-z0-9_]{2,})', 1)) AS identifiers FROM documents")
def f1_tokens(spark, d):
    """How many tokens each of the four kinds finds."""
    n = lambda p: F.size(X.tokens("text", pattern=p)).cast("long")
    return table(spark, d, "documents").select("doc_id", n(X.WORD_TOKEN).alias("words"), n(X.APOSTROPHE_TOKEN).alias("quoted"), n(X.LETTER_TOKEN).alias("letters"), n(X.IDENTIFIER).alias("identifiers"))


@query("f3_paragraphs", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')) AS paragraphs FROM documents")
def f3_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.paragraphs("text")).cast("long").alias("paragraphs"))


@query("f7_normalised", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total FROM e WHERE list_dot_product(v, v) > 0")
def f7_normalised(spark, d):
    """Vectors divided by their length: their first component and sum."""
    v = vectors(spark, d).withColumn("u", V.normalized(F.col("v")))
    return v.select(F.col("id").alias("vec_id"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(V.total(F.col("u")), 6).alias("total"))


@query("f8_dot_products", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def f8_dot_products(spark, d):
    """Inner products of neighbours."""
    v = vectors(spark, d)
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w")), "id").select(F.col("id").alias("vec_id"), F.round(V.dot(F.col("v"), F.col("w")), 6).alias("dot"))


@query("f9_count_cosine", f"WITH {TURNS}, p AS (SELECT a.conv_id, a.id, sum(a.n * b.n) AS dot FROM counts a JOIN counts b ON a.conv_id = b.conv_id AND b.id = a.id + 1 AND a.term = b.term GROUP BY 1, 2), z AS (SELECT conv_id, id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1, 2) SELECT p.conv_id, p.id, round(dot / (x.norm * y.norm), 6) AS cosine FROM p JOIN z x ON x.conv_id = p.conv_id AND x.id = p.id JOIN z y ON y.conv_id = p.conv_id AND y.id = p.id + 1")
def f9_count_cosine(spark, d):
    """Cosine of the word counts of neighbouring turns that share a word."""
    c = turn_counts(spark, d).groupBy("conv_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("m"))
    w = Window.partitionBy("conv_id").orderBy("id")
    out = c.withColumns({"next": F.lead("m").over(w), "at": F.lead("id").over(w)}).where(F.col("at") == F.col("id") + 1)
    return out.withColumn("cosine", F.round(V.count_cosine(F.col("m"), F.col("next")), 6)).where("cosine > 0").select("conv_id", "id", "cosine")


@query("f10_jaccard", f"WITH t AS (SELECT conv_id, turn, {TERMS} AS w, lag({TERMS}) OVER (PARTITION BY conv_id ORDER BY turn) AS w0 FROM conversations) SELECT conv_id, turn, round({JACCARD.format(a='w', b='w0')}, 6) AS jaccard, round(CASE WHEN least(len(w), len(w0)) = 0 THEN 0.0 ELSE len(list_intersect(w, w0)) / least(len(w), len(w0)) END, 6) AS overlap FROM t WHERE w0 IS NOT NULL")
def f10_jaccard(spark, d):
    """Jaccard and overlap of neighbouring turns."""
    rows = turns(spark, d).select("conv_id", "turn", terms().alias("w")).withColumn("w0", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("w0 is not null")
    return rows.select("conv_id", "turn", F.round(V.jaccard(F.col("w"), F.col("w0")), 6).alias("jaccard"), F.round(V.overlap(F.col("w"), F.col("w0")), 6).alias("overlap"))


@query("f11_overlap", "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1) SELECT a.user_id, round(len(list_intersect(a.k, b.k)) / least(len(a.k), len(b.k)), 6) AS overlap FROM s a JOIN s b ON b.user_id = a.user_id + 1")
def f11_overlap(spark, d):
    """Overlap coefficients of the event kinds of neighbouring users."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return s.join(s.select((F.col("user_id") - 1).alias("user_id"), F.col("k").alias("m")), "user_id").select("user_id", F.round(V.overlap(F.col("k"), F.col("m")), 6).alias("overlap"))


@query("f13_sequence_ratio", "SELECT p_partkey, CAST(1.0 AS DOUBLE) AS same, round(2 * length(p_name) / (2 * length(p_name) + 4), 6) AS longer, CAST(0.0 AS DOUBLE) AS none FROM part")
def f13_sequence_ratio(spark, d):
    """Matching-block ratios of names with themselves, with a longer text, and with one that shares nothing."""
    p = table(spark, d, "part")
    return p.select("p_partkey", X.sequence_ratio(F.col("p_name"), F.col("p_name")).alias("same"), F.round(X.sequence_ratio(F.col("p_name"), F.concat("p_name", F.lit("@@@@"))), 6).alias("longer"), X.sequence_ratio(F.col("p_name"), F.lit("@@@")).alias("none"))


@query("f45_unified_diff", "SELECT p_partkey, '--- left' || chr(10) || '+++ right' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' ' || p_name || chr(10) || '-' || p_brand || chr(10) || '+' || p_type AS diff FROM part")
def f45_unified_diff(spark, d):
    """Differences of two texts of two lines that share the first."""
    p = table(spark, d, "part")
    return p.select("p_partkey", X.unified_diff(F.concat_ws("\n", "p_name", "p_brand"), F.concat_ws("\n", "p_name", "p_type")).alias("diff"))


SIZES = "s AS (SELECT conv_id, turn, length(text) AS c, len(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS w, len(string_split(text, chr(10))) AS l FROM conversations), z AS (SELECT *, lag(c) OVER o AS c0, lag(w) OVER o AS w0, lag(l) OVER o AS l0 FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"


@query("f14_structural", f"WITH {SIZES} SELECT conv_id, turn, round(((1 - abs(c - c0) / greatest(c, c0)) + (1 - abs(w - w0) / greatest(w, w0)) + (1 - abs(l - l0) / greatest(l, l0))) / 3, 6) AS structural FROM z WHERE c0 IS NOT NULL AND least(c, c0, w, w0) > 0")
def f14_structural(spark, d):
    """Mean ratio of the sizes of neighbouring turns."""
    s = F.struct(F.length("text").alias("c"), F.size(X.tokens("text")).alias("w"), F.size(X.lines("text")).alias("l"))
    rows = turns(spark, d).select("conv_id", "turn", s.alias("y")).withColumn("x", F.lag("y").over(Window.partitionBy("conv_id").orderBy("turn"))).where("x is not null and least(x.c, y.c, x.w, y.w) > 0")
    return rows.select("conv_id", "turn", F.round(G.profile_similarity("x", "y", ["c", "w", "l"]), 6).alias("structural"))


@query("f15_patterns", f"WITH t AS (SELECT conv_id, turn, len({WORDS}) AS n, length(text) AS c, len(regexp_extract_all(text, '([,])', 1)) AS k, len(regexp_extract_all(text, '([.])', 1)) AS p FROM conversations), m AS (SELECT conv_id, turn, c / greatest(n, 1) AS a, 100 * k / greatest(n, 1) AS b, 100 * p / greatest(n, 1) AS e FROM t), z AS (SELECT *, lag(a) OVER o AS a0, lag(b) OVER o AS b0, lag(e) OVER o AS e0 FROM m WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, round(((1 - abs(a - a0) / greatest(a, a0, 1e-6)) + (1 - abs(b - b0) / greatest(b, b0, 1e-6)) + (1 - abs(e - e0) / greatest(e, e0, 1e-6))) / 3, 6) AS pattern FROM z WHERE a0 IS NOT NULL")
def f15_patterns(spark, d):
    """How alike neighbouring turns are in word length and punctuation."""
    n = F.greatest(F.size(X.tokens("text")), F.lit(1))
    marks = lambda p: 100 * F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))) / n
    s = F.struct((F.length("text") / n).alias("a"), marks("[,]").alias("b"), marks("[.]").alias("e"))
    rows = turns(spark, d).select("conv_id", "turn", s.alias("y")).withColumn("x", F.lag("y").over(Window.partitionBy("conv_id").orderBy("turn"))).where("x is not null")
    return rows.select("conv_id", "turn", F.round(G.profile_similarity("x", "y", ["a", "b", "e"]), 6).alias("pattern"))


@query("f17_derivatives", "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), s AS (SELECT vec_id, x, 1 / (1 + exp(-x)) AS v FROM e) SELECT vec_id, round(v * (1 - v), 6) AS slope, round(CASE WHEN v * (1 - v) >= 0.249 THEN v ELSE 0 END, 6) AS gated, round(v * (1 + 0.5 * v * (1 - v)), 6) AS scaled FROM s")
def f17_derivatives(spark, d):
    """Slopes of an activation, and its value gated or scaled by them."""
    x = F.get("v", F.lit(0))
    rows = vectors(spark, d).select("id", x.alias("x")).withColumn("y", V.activation(F.col("x"), "sigmoid"))
    rows = rows.withColumn("s", G.derivative("sigmoid", F.col("x"), F.col("y")))
    return rows.select(F.col("id").alias("vec_id"), F.round("s", 6).alias("slope"), F.round(G.gated(F.col("y"), F.col("s"), 0.249), 6).alias("gated"), F.round(G.scaled(F.col("y"), F.col("s"), 0.5), 6).alias("scaled"))


@query("f19_cache_features", "SELECT o_orderkey, round(1 - abs(length(o_orderpriority) - length(o_orderstatus)) / greatest(length(o_orderpriority), length(o_orderstatus), 1), 6) AS length, round(1 / (1 + (o_orderkey % 100) / 24), 6) AS recency FROM orders")
def f19_cache_features(spark, d):
    """Length and recency features of cache entries."""
    f = S.cache_features(F.lit(1.0), F.col("o_orderpriority"), F.col("o_orderstatus"), (F.col("o_orderkey") % 100).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", F.round(f[1], 6).alias("length"), F.round(f[2], 6).alias("recency"))


CACHE = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS s FROM e a JOIN e b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS k FROM p), f AS (SELECT query_id, entry_id, s, 1 / (1 + exp(-(4 * s - 1.2 + 0.5 * (1 / (1 + (entry_id % 50) / 24))))) AS decision FROM t WHERE k = 1)"


def admitted(spark, d):
    v = vectors(spark, d).select("id", "v")
    near = SE.vector_search(v.where("id % 20 <> 0"), v.where("id % 20 = 0"), 1)
    age = (F.col("entry_id") % 50).cast("double")
    held = near.select("query_id", F.col("id").alias("entry_id"), F.col("score").alias("similarity"))
    held = held.withColumn("features", F.array("similarity", 1 / (1 + age / 24)))
    return S.cache_admission(held, 0.3, [4.0, 0.5], -1.2, 0.5)


@query("p32_cache_decisions", f"WITH {CACHE} SELECT query_id, entry_id, round(s, 6) AS similarity, round(decision, 6) AS decision, s >= 0.3 AND decision >= 0.5 AS hit FROM f")
def p32_cache_decisions(spark, d):
    """Whether the nearest cached vector answers a query: by similarity and by a learned unit."""
    return admitted(spark, d).select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"), F.round("decision", 6).alias("decision"), "hit")


@query("r7_learned_cache", f"WITH {CACHE}, c AS (SELECT CASE WHEN s >= 0.3 AND decision >= 0.5 THEN entry_id ELSE query_id END AS entry_id, query_id AS used FROM f), u AS (SELECT entry_id, max(used) AS used, count(*) AS uses FROM c GROUP BY 1) SELECT entry_id, used, uses FROM u ORDER BY used DESC, entry_id LIMIT 15")
def r7_learned_cache(spark, d):
    """A cache after some queries: hits refresh their entry, misses are stored, the fifteen last used stay."""
    now = admitted(spark, d).select(F.when(F.col("hit"), F.col("entry_id")).otherwise(F.col("query_id")).alias("entry_id"), F.col("query_id").alias("used"))
    held = now.groupBy("entry_id").agg(F.max("used").alias("used"), F.count("*").alias("uses"))
    return held.orderBy(F.desc("used"), "entry_id").limit(15)


@query("f21_dequantised", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS k FROM e) SELECT vec_id, bool_and(abs(x - round_even(x / k, 0) * k) <= k / 2 + 1e-9) AS close FROM (SELECT vec_id, k, unnest(v) AS x FROM s) GROUP BY 1")
def f21_dequantised(spark, d):
    """Whether what 8 bits give back is within half a step of every component."""
    v = vectors(spark, d).withColumn("q", V.quantized_int8(F.col("v")))
    back = V.dequantized(F.col("q.q"), F.col("q.scale"))
    return v.select(F.col("id").alias("vec_id"), F.forall(F.zip_with("v", back, lambda x, y: F.abs(x - y)), lambda e: e <= F.col("q.scale") / 2 + 1e-9).alias("close"))


@query("f23_packed_vectors", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, embedding AS back FROM embeddings")
def f23_packed_vectors(spark, d):
    """Vectors as bytes of 32-bit floats, and back."""
    data = table(spark, d, "embeddings").select("vec_id", G.packed_floats(F.col("embedding")).alias("b"))
    return data.select("vec_id", F.octet_length("b").alias("bytes"), G.unpacked_floats(F.col("b")).alias("back"))


@query("f24_token_estimates", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def f24_token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("f26_snippets", "WITH p AS (SELECT doc_id, text, instr(lower(text), ' the ') AS p FROM documents) SELECT doc_id, trim(substr(text, greatest(p - 20, 1), p + 5 + 20 - greatest(p - 20, 1)), ' ') AS snippet FROM p WHERE p > 0")
def f26_snippets(spark, d):
    """Twenty characters to each side of a word's first occurrence."""
    at = F.instr(F.lower("text"), " the ")
    return table(spark, d, "documents").where(at > 0).select("doc_id", X.snippet(F.col("text"), at, F.lit(5), 20).alias("snippet"))


LABELS = {"link": ("and", "or", "und", "et"), "place": ("in", "on", "at"), "time": ("when", "now", "then")}
LABEL_SQL = "list_sort(list_filter([" + ", ".join(f"{{'s': -round(len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) / greatest(len(w), 1), 6), 'label': '{n}'}}" for n, ws in LABELS.items()) + "], lambda x: x.s < 0))"


@query("f28_label_profile", f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), l AS (SELECT doc_id, {LABEL_SQL} AS l FROM t) SELECT doc_id, list_transform(l, lambda x: x.label) AS labels, list_transform(l, lambda x: -x.s) AS scores FROM l")
def f28_label_profile(spark, d):
    """Labels by the share of a document's words that speak for them."""
    found = table(spark, d, "documents").select("doc_id", G.label_scores(F.col("text"), LABELS).alias("l"))
    return found.select("doc_id", F.col("l.label").alias("labels"), F.col("l.score").alias("scores"))


@query("f35_complex_numbers", "WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 7 + 1 AS b FROM part) SELECT p_partkey, CAST(a AS DOUBLE) AS re, CAST(-b AS DOUBLE) AS im, round(sqrt(a * a + b * b), 6) AS magnitude, round(atan2(-b, a), 6) AS phase FROM p UNION ALL SELECT p_partkey, 0.0, CAST(b AS DOUBLE), CAST(b AS DOUBLE), round(atan2(b, 0), 6) FROM p")
def f35_complex_numbers(spark, d):
    """Complex numbers of a text, and an imaginary one on its own."""
    b = F.col("p_partkey") % 7 + 1
    said = F.concat(F.lit("z is "), "p_size", F.lit(" - "), b, F.lit("i, w is "), b, F.lit("j and x3 none"))
    found = table(spark, d, "part").select("p_partkey", F.explode(G.complex_numbers(said)).alias("c"))
    return found.select("p_partkey", "c.re", "c.im", "c.magnitude", "c.phase")


@query("f40_stringified", "SELECT o_custkey, string_agg(o_orderkey, '; ' ORDER BY o_orderkey) AS joined, '{\"n\":' || count(*) || ',\"low\":' || min(o_orderkey) || '}' AS json FROM orders GROUP BY 1")
def f40_stringified(spark, d):
    """Lists as text with semicolons, records as JSON."""
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return held.select("o_custkey", F.array_join(F.col("k").cast("array<string>"), "; ").alias("joined"), F.to_json(F.struct(F.size("k").alias("n"), F.array_min("k").alias("low"))).alias("json"))


@query("f46_math", "SELECT p_partkey, round(ln(p_retailprice), 6) AS a, round(ln(1 + p_size), 6) AS b, round(exp(-p_size), 9) AS c, round((exp(2.0 * p_size / 100) - 1) / (exp(2.0 * p_size / 100) + 1), 6) AS d, round(sqrt(p_retailprice), 6) AS e, round(pow(p_size, 1.5), 4) AS f, round(atan2(p_size, 2), 6) AS g FROM part")
def f46_math(spark, d):
    p = table(spark, d, "part")
    s = F.col("p_size")
    return p.select("p_partkey", F.round(F.log("p_retailprice"), 6).alias("a"), F.round(F.log1p(s), 6).alias("b"), F.round(F.exp(-s), 9).alias("c"), F.round(F.tanh(s / 100), 6).alias("d"), F.round(F.sqrt("p_retailprice"), 6).alias("e"), F.round(F.pow(s, F.lit(1.5)), 4).alias("f"), F.round(F.atan2(s, F.lit(2)), 6).alias("g"))
