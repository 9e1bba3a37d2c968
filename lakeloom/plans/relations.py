"""Queries of evidence, summaries, transitions and selections, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import ordered as O
from ..operators import terms as T
from .base import query, table
from .ordered import JACCARD, TERMS, terms
from .terms import COUNTS, TURN_PAIRS, counts, turn_counts

SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query("j22_contradictions", f"""WITH s AS (SELECT conv_id, turn, {TERMS} AS w, regexp_matches(lower(text), '(^|[^a-z0-9_])(not|no|never|none)($|[^a-z0-9_])') AS neg FROM conversations)
SELECT a.conv_id, a.turn AS left_turn, b.turn AS right_turn, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.neg <> b.neg AND len(list_intersect(a.w, b.w)) >= 1""")
def j22_contradictions(spark, d):
    """Turns of one conversation that share terms while only one is negated."""
    neg = F.lower("text").rlike("(^|[^a-z0-9_])(not|no|never|none)($|[^a-z0-9_])")
    s = table(spark, d, "conversations").select("conv_id", "turn", terms().alias("w"), neg.alias("neg"))
    a, b = s.select("conv_id", F.col("turn").alias("left_turn"), F.col("w").alias("wa"), F.col("neg").alias("na")), s.select("conv_id", F.col("turn").alias("right_turn"), F.col("w").alias("wb"), F.col("neg").alias("nb"))
    pairs = a.join(b, "conv_id").where("left_turn < right_turn and na <> nb").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    return pairs.where("shared >= 1").select("conv_id", "left_turn", "right_turn", "shared")


@query("j21_evidence", f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS w FROM benchmark), c AS (SELECT conv_id, turn, {TERMS} AS w FROM conversations),
qt AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM (SELECT item_id, list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({", ".join(repr(x) for x in X.STOPWORDS)})) AS w FROM q)), ct AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS t FROM c)
SELECT item_id, conv_id, turn, count(*) AS shared, round(count(*) / (qt.n + ct.n - count(*)), 6) AS jaccard FROM qt JOIN ct USING (t) GROUP BY item_id, conv_id, turn, qt.n, ct.n HAVING count(*) >= 2""")
def j21_evidence(spark, d):
    """Benchmark items and the turns that share terms with them."""
    own = lambda w: F.filter(w, lambda t: (F.length(t) >= 3) & ~t.isin(*X.STOPWORDS))
    q = table(spark, d, "benchmark").select("item_id", own(X.token_set("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    c = table(spark, d, "conversations").select("conv_id", "turn", terms().alias("w")).select("conv_id", "turn", F.size("w").alias("m"), F.explode("w").alias("t"))
    pairs = q.join(c, "t").groupBy("item_id", "conv_id", "turn", "n", "m").agg(F.count("*").alias("shared")).where("shared >= 2")
    return pairs.select("item_id", "conv_id", "turn", "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("jaccard"))


@query("j23_record_references", TURN_PAIRS + " SELECT conv_id, a, b, shared FROM j WHERE jaccard >= 0.05 AND shared >= 3")
def j23_record_references(spark, d):
    """Turns of a conversation that share terms enough by number and by share."""
    return T.scoped_similarity(turn_counts(spark, d).drop("n"), ["conv_id"], 0.05, 3).select("conv_id", "a", "b", "shared")


@query("j41_source_overlap", f"""WITH {COUNTS}, l AS (SELECT DISTINCT source AS id, term FROM counts JOIN documents ON counts.id = doc_id), z AS (SELECT id, count(*) AS n FROM l GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM l a JOIN l b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / least(x.n, y.n), 6) AS overlap FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b""")
def j41_source_overlap(spark, d):
    source = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    labels = counts(spark, d).join(source, "id").select(F.col("source").alias("id"), "term").distinct()
    return T.set_similarity(labels).select("a", "b", "shared", F.round("overlap", 6).alias("overlap"))


@query("w4_term_changes", f"""WITH t AS (SELECT conv_id, turn, {TERMS} AS w FROM conversations), l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS w0 FROM t)
SELECT conv_id, turn, CAST(len(list_filter(w, lambda x: NOT list_contains(w0, x))) AS INTEGER) AS added, CAST(len(list_filter(w0, lambda x: NOT list_contains(w, x))) AS INTEGER) AS removed FROM l WHERE w0 IS NOT NULL""")
def w4_term_changes(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", terms().alias("w"))
    rows = rows.withColumn("w0", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("w0 is not null")
    return rows.select("conv_id", "turn", F.size(F.array_except("w", "w0")).alias("added"), F.size(F.array_except("w0", "w")).alias("removed"))


@query("w5_context_drift", f"""WITH t AS (SELECT conv_id, turn, ends_with(trim(text, ' '), '?') AS q, {TERMS} AS w FROM conversations), l AS (SELECT *, lag(w) OVER o AS w0, lag(q) OVER o AS q0 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, round({JACCARD.format(a='w', b='w0')}, 6) AS similarity, q <> q0 AS changed FROM l WHERE w0 IS NOT NULL) SELECT *, similarity < 0.1 OR changed AS drifted FROM s""")
def w5_context_drift(spark, d):
    o = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.endswith(F.trim("text"), F.lit("?")).alias("q"), terms().alias("w"))
    rows = rows.withColumns({"w0": F.lag("w").over(o), "q0": F.lag("q").over(o)}).where("w0 is not null")
    rows = rows.select("conv_id", "turn", F.round(V.jaccard(F.col("w"), F.col("w0")), 6).alias("similarity"), (F.col("q") != F.col("q0")).alias("changed"))
    return rows.withColumn("drifted", (F.col("similarity") < 0.1) | F.col("changed"))


@query("w9_adjacent_edges", f"""WITH t AS (SELECT conv_id, turn, {TERMS} AS w FROM conversations), l AS (SELECT conv_id, turn, w, lead(turn) OVER o AS next_turn, lead(w) OVER o AS w1 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, next_turn, list_sort(list_intersect(w, w1)) AS shared FROM l WHERE next_turn IS NOT NULL""")
def w9_adjacent_edges(spark, d):
    o = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", terms().alias("w")).withColumns({"next_turn": F.lead("turn").over(o), "w1": F.lead("w").over(o)})
    return rows.where("next_turn is not null").select("conv_id", "turn", "next_turn", F.array_sort(F.array_intersect("w", "w1")).alias("shared"))


@query("w6_transitions", """WITH l AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r0 FROM conversations) SELECT r0 AS "from", role AS "to", CASE WHEN r0 = role THEN 'stable' ELSE 'change' END AS kind, count(*) AS n FROM l WHERE r0 IS NOT NULL GROUP BY 1, 2, 3""")
def w6_transitions(spark, d):
    rows = table(spark, d, "conversations").withColumn("from", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("`from` is not null")
    return rows.groupBy("from", F.col("role").alias("to")).agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("from") == F.col("to"), "stable").otherwise("change"))


@query("w24_best_label", """WITH m AS (SELECT * FROM (VALUES ('question', '?'), ('list', ','), ('end', '.')) AS t(label, mark)), s AS (SELECT conv_id, turn, label, length(text) - length(replace(text, mark, '')) AS score FROM conversations, m),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, label) AS k FROM s) SELECT conv_id, turn, CASE WHEN score > 0 THEN label ELSE 'none' END AS label FROM r WHERE k = 1""")
def w24_best_label(spark, d):
    marks = {"question": "?", "list": ",", "end": "."}
    scored = F.array(*(F.struct((-X.occurrences("text", F.lit(m))).alias("s"), F.lit(k).alias("label")) for k, m in marks.items()))
    best = F.array_min(scored)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(best["s"] < 0, best["label"]).otherwise("none").alias("label"))


@query("a17_candidates", """WITH s AS (SELECT role, count(*) AS segments, sum(len(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))) AS tokens FROM conversations GROUP BY 1) SELECT role, round(0.7 * tokens / max(tokens) OVER () + 0.3 * segments / max(segments) OVER (), 6) AS score FROM s""")
def a17_candidates(spark, d):
    s = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("segments"), F.sum(F.size(X.tokens("text"))).alias("tokens"))
    top = s.agg(F.max("tokens").alias("t"), F.max("segments").alias("g"))
    return s.join(F.broadcast(top)).select("role", F.round(0.7 * F.col("tokens") / F.col("t") + 0.3 * F.col("segments") / F.col("g"), 6).alias("score"))


@query("a18_category_buckets", """WITH c AS (SELECT event_id, event_type AS category FROM events UNION ALL SELECT event_id, 'large' FROM events WHERE value > 100) SELECT category, count(*) AS n, list(event_id ORDER BY event_id)[1:5] AS members FROM c GROUP BY 1""")
def a18_category_buckets(spark, d):
    cats = F.array_compact(F.array(F.col("event_type"), F.when(F.col("value") > 100, "large")))
    rows = table(spark, d, "events").select("event_id", F.explode(cats).alias("category"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("event_id")))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("event_id"))))  # five ids a category at most
    return ranked.groupBy("category").agg(F.count("*").alias("n"), first.alias("members"))


@query("a25_relations", """WITH r AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a, b, n, round(n / max(n) OVER (), 6) AS weight FROM r""")
def a25_relations(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))
    return r.join(F.broadcast(r.agg(F.max("n").alias("top")))).select("a", "b", "n", F.round(F.col("n") / F.col("top"), 6).alias("weight"))


@query("a30_label_summaries", "SELECT lang AS label, count(*) AS n, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def a30_label_summaries(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("a46_best_by_keys", "WITH r AS (SELECT l_orderkey, l_partkey, l_quantity, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_partkey, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, l_partkey FROM r WHERE k = 1")
def a46_best_by_keys(spark, d):
    best = F.max_by("l_partkey", F.struct("l_quantity", "l_discount", -F.col("l_partkey"), -F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("l_partkey"))


@query("a50_blend", "WITH s AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1) SELECT event_type, round(v / sum(v) OVER (), 6) AS weight FROM s")
def a50_blend(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return s.join(F.broadcast(s.agg(F.sum("v").alias("all")))).select("event_type", F.round(F.col("v") / F.col("all"), 6).alias("weight"))


@query("a52_regroup_chunks", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content FROM conversations GROUP BY 1")
def a52_regroup_chunks(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, " ").alias("content"))


@query("p5_tag_filter", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'click') AND user_id NOT IN (1, 2, 3)")
def p5_tag_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "click") & ~F.col("user_id").isin(1, 2, 3)).select("event_id")


@query("p11_recent", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY")
def p11_recent(spark, d):
    """Events of three days before a given now."""
    now = F.expr("timestamp_ntz'2024-01-31 00:00:00'")
    return table(spark, d, "events").where(F.col("ts") >= now - F.make_dt_interval(F.lit(3))).select("event_id")


@query("o3_first_of_ties", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 2")
def o3_first_of_ties(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_type"), "event_id"))
    return table(spark, d, "events").withColumn("k", k).where("k <= 2").select("user_id", "event_id")


@query("f27_phrase_counts", "SELECT doc_id AS id, CAST((length(lower(text)) - length(replace(lower(text), 'of the', ''))) // 6 AS BIGINT) AS n, starts_with(lower(text), 'the') AS starts FROM documents")
def f27_phrase_counts(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.occurrences(low, F.lit("of the")).alias("n"), F.startswith(low, F.lit("the")).alias("starts"))


@query("f36_attention_span", "SELECT doc_id AS id, round(n_chars / (1 + 0.05 * length(lang)), 6) AS span FROM documents")
def f36_attention_span(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") / (1 + 0.05 * F.length("lang")), 6).alias("span"))


@query("f47_date_steps", "SELECT event_id, TIMESTAMP '2024-01-01' + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * INTERVAL 250 MILLISECOND AS at FROM events")
def f47_date_steps(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return table(spark, d, "events").select("event_id", F.timestamp_add("MILLISECOND", k * 250, start).alias("at"))


@query("c22_sentences_of_turns", f"WITH s AS (SELECT conv_id, turn, {SENTENCES} AS s FROM conversations) SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def c22_sentences_of_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.sentences("text")).alias("pos", "sentence"))


@query("o13_takeaways", f"""WITH s AS (SELECT DISTINCT unnest({SENTENCES}) AS s FROM conversations), k AS (SELECT s, len(list_filter(['the', 'and', 'that', 'with'], lambda t: list_contains(regexp_extract_all(lower(s), '([a-z0-9_]+)', 1), t))) AS n FROM s) SELECT s AS sentence, CAST(n AS INTEGER) AS n FROM k WHERE n > 0 ORDER BY n DESC, s LIMIT 20""")
def o13_takeaways(spark, d):
    s = table(spark, d, "conversations").select(F.explode(X.sentences("text")).alias("sentence")).distinct()
    listed = F.array(*(F.lit(w) for w in ("the", "and", "that", "with")))
    return s.withColumn("n", F.size(F.array_intersect(listed, X.tokens("sentence")))).where("n > 0").orderBy(F.desc("n"), "sentence").limit(20)


@query("a20_topic_buckets", f"WITH {COUNTS} SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS n, min(id) AS first_document FROM counts GROUP BY 1 HAVING count(*) >= 2")
def a20_topic_buckets(spark, d):
    return counts(spark, d).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("n"), F.min("id").alias("first_document")).where("documents >= 2")


@query("j29_interval_anti_join", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e, event_type FROM events) SELECT event_id FROM e a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND a.s < b.e AND b.s < a.e)""")
def j29_interval_anti_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", O.micros("ts").alias("s")).withColumn("e", F.col("s") + 600_000_000)
    a, b = e.where("event_type = 'view'").alias("a"), e.where("event_type = 'error'").alias("b")
    return a.join(b, F.expr("a.user_id = b.user_id and a.s < b.e and b.s < a.e"), "left_anti").select("event_id")
