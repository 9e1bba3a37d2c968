"""Queries of lookups, references, selections and small aggregates, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import matches as M
from ..operators import ordered as O
from ..operators import stores as S
from .base import query, table

LINKS = r"l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS name FROM pages)"


@query("j19_name_references", f"WITH {LINKS}, n AS (SELECT page_id AS target, lower(split_part(url, '/', 4)) AS name FROM pages) SELECT l.page_id AS source, n.target, count(*) * 2 AS weight FROM l JOIN n ON lower(l.name) = n.name WHERE l.page_id <> n.target AND n.name <> '' GROUP BY 1, 2")
def j19_name_references(spark, d):
    """Links of pages by name to the pages of that name, two points each."""
    pages = table(spark, d, "pages")
    links = pages.select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("name")).withColumn("name", F.lower("name"))
    names = pages.select(F.col("page_id").alias("target"), F.lower(F.coalesce(F.get(F.split("url", "/"), F.lit(3)), F.lit(""))).alias("name")).where("name <> ''")
    links = links.groupBy("source", "name").agg(F.count("*").alias("links"))
    named = names.groupBy("target", "name").agg(F.count("*").alias("rows"))
    several = named.groupBy("target").agg(F.count("*").alias("names")).where("names > 1").select("target")
    weight = F.col("links") * F.col("rows") * 2
    meet = lambda part: M.spread_join(links, part, "name", "target").where("source <> target").select("source", "target", weight.alias("weight"))
    # a page of one name meets a source once, so only pages of several names are summed by pair
    return meet(named.join(several, "target", "left_anti")).unionAll(meet(named.join(several, "target", "left_semi")).groupBy("source", "target").agg(F.sum("weight").alias("weight")))


@query("j20_document_query", """WITH q AS (SELECT unnest(['the', 'license', 'that', 'und']) AS t), w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS t FROM documents), o AS (SELECT id, count(*) AS overlap FROM w JOIN q USING (t) GROUP BY 1), r AS (SELECT doc_id AS id, quality AS refs FROM labels)
SELECT coalesce(o.id, r.id) AS id, coalesce(overlap, 0) AS overlap, coalesce(refs, 0) AS refs FROM o FULL JOIN r ON o.id = r.id WHERE coalesce(overlap, 0) > 0 OR coalesce(refs, 0) > 0 ORDER BY coalesce(refs, 0) > 0 DESC, refs DESC, overlap DESC, id LIMIT 50""")
def j20_document_query(spark, d):
    """Documents by references and shared query terms; the 50 best."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(X.token_set("text")).alias("t"))
    overlap = words.where(F.col("t").isin("the", "license", "that", "und")).groupBy("id").agg(F.count("*").alias("overlap"))
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("refs"))
    both = overlap.join(refs, "id", "full_outer").select("id", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("refs", F.lit(0)).alias("refs")).where("overlap > 0 or refs > 0")
    return both.orderBy(F.desc(F.col("refs") > 0), F.desc("refs"), F.desc("overlap"), "id").limit(50)


@query("j28_prior_parent", "WITH h AS (SELECT conv_id, turn, length(text) AS size FROM conversations) SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.size > a.size GROUP BY 1, 2")
def j28_prior_parent(spark, d):
    """The nearest earlier turn that is longer."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return O.nearest_larger(rows, ["conv_id"], "turn", "size", "parent").select("conv_id", "turn", "parent")


@query("j40_expected_accuracy", """WITH e AS (SELECT * FROM (VALUES ('user', '?'), ('assistant', '.'), ('system', '.')) AS t(role, mark)), s AS (SELECT c.role, CASE WHEN contains(text, mark) THEN 1.0 ELSE 0.0 END AS hit FROM conversations c LEFT JOIN e ON c.role = e.role) SELECT role, count(*) AS n, round(avg(hit), 6) AS accuracy FROM s GROUP BY 1""")
def j40_expected_accuracy(spark, d):
    expected = spark.createDataFrame([("user", "?"), ("assistant", "."), ("system", ".")], "role string, mark string")
    rows = table(spark, d, "conversations").join(F.broadcast(expected), "role", "left").withColumn("hit", F.when(F.contains(F.col("text"), F.col("mark")), 1.0).otherwise(0.0))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("j46_key_lookup", "WITH k AS (SELECT unnest([3, 1, 7, 999999999]) AS key, unnest([1, 2, 3, 4]) AS pos) SELECT pos, c_custkey AS key, c_name FROM k JOIN customer ON key = c_custkey")
def j46_key_lookup(spark, d):
    keys = spark.createDataFrame([(3, 1), (1, 2), (7, 3), (999999999, 4)], "key long, pos int")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name").join(F.broadcast(keys), "key").select("pos", "key", "c_name")


@query("j18_definition_checks", """WITH e AS (SELECT lower(split_part(p_type, ' ', 1)) AS word, p_brand AS dict, min(lower(p_name || ' ' || p_type)) AS text FROM part GROUP BY 1, 2), t AS (SELECT word, dict, list_distinct(regexp_extract_all(text, '([a-z0-9_]+)', 1)) AS w FROM e),
p AS (SELECT a.word, a.dict AS a, b.dict AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS agreement FROM t a JOIN t b ON a.word = b.word AND a.dict < b.dict) SELECT word, a, b, agreement, agreement >= 0.3 AS consistent FROM p""")
def j18_definition_checks(spark, d):
    """Words that two dictionaries define, and whether their definitions agree."""
    word = F.lower(F.element_at(F.split("p_type", " "), 1))
    e = table(spark, d, "part").groupBy(word.alias("word"), F.col("p_brand").alias("dict")).agg(F.min(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("text"))
    t = e.select("word", F.col("dict").alias("id"), X.token_set("text").alias("w"))
    found = M.scoped_pairs(t, ["word"], ["w"]).withColumn("agreement", F.round(V.jaccard(F.col("x.w"), F.col("y.w")), 6))
    return found.select("word", "a", "b", "agreement", (F.col("agreement") >= 0.3).alias("consistent"))


@query("a21_speaker_summaries", "SELECT coalesce(role, 'Unknown') AS speaker, count(*) AS n, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars, max(turn) AS last_turn FROM conversations GROUP BY 1")
def a21_speaker_summaries(spark, d):
    return table(spark, d, "conversations").groupBy(F.coalesce("role", F.lit("Unknown")).alias("speaker")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max("turn").alias("last_turn"))


@query("a28_adjacent_bigrams", "WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS w, generate_subscripts(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), 1) AS pos FROM conversations), l AS (SELECT w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS next FROM t) SELECT w AS \"left\", next AS \"right\", count(*) AS n FROM l WHERE next IS NOT NULL GROUP BY 1, 2")
def a28_adjacent_bigrams(spark, d):
    """Neighbouring tokens over all turns of a conversation."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.tokens("text")).alias("pos", "left"))
    t = t.withColumn("right", F.lead("left").over(Window.partitionBy("conv_id").orderBy("turn", "pos"))).where("right is not null")
    return t.groupBy("left", "right").agg(F.count("*").alias("n"))


@query("a32_level_stats", "WITH p AS (SELECT n_nationkey AS id, n_regionkey AS parent FROM nation), c AS (SELECT parent, count(*) AS k FROM p GROUP BY 1) SELECT 0 AS depth, count(*) AS nodes, round(avg(k), 6) AS branching FROM c UNION ALL SELECT 1, count(*), 0.0 FROM p")
def a32_level_stats(spark, d):
    p = table(spark, d, "nation")
    top = p.groupBy("n_regionkey").agg(F.count("*").alias("k")).agg(F.lit(0).alias("depth"), F.count("*").alias("nodes"), F.round(F.avg("k"), 6).alias("branching"))
    return top.unionAll(p.agg(F.lit(1).alias("depth"), F.count("*").alias("nodes"), F.lit(0.0).alias("branching")))


@query("a34_review", """WITH e AS (SELECT user_id, event_type AS topic, count(*) AS attempts, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS correct, max(ts) AS last_seen FROM events GROUP BY 1, 2), l AS (SELECT max(ts) AS now FROM events),
r AS (SELECT *, CASE WHEN correct >= 0.8 THEN 7 WHEN correct >= 0.5 THEN 3 ELSE 1 END AS days FROM e), d AS (SELECT *, (epoch_us(now) - epoch_us(last_seen)) // 86400000000 AS age FROM r, l)
SELECT user_id, topic, attempts, correct, last_seen, days, age >= days AS due, CAST(row_number() OVER (PARTITION BY user_id ORDER BY age < days, correct, last_seen, topic) AS INTEGER) AS rank FROM d""")
def a34_review(spark, d):
    """What each user is to review: topics by whether they are due, how well they went and how long ago."""
    e = table(spark, d, "events")
    topics = e.groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count("*").alias("attempts"), F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 6).alias("correct"), F.max("ts").alias("last_seen"))
    days = F.when(F.col("correct") >= 0.8, 7).when(F.col("correct") >= 0.5, 3).otherwise(1)
    now = e.agg(F.max("ts").alias("now"))
    out = topics.withColumn("days", days).join(F.broadcast(now)).withColumn("age", F.floor((O.micros("now") - O.micros("last_seen")) / 86_400_000_000))
    order = Window.partitionBy("user_id").orderBy(F.col("age") < F.col("days"), "correct", "last_seen", "topic")
    return out.select("user_id", "topic", "attempts", "correct", "last_seen", "days", (F.col("age") >= F.col("days")).alias("due"), F.row_number().over(order).alias("rank"))


@query("a35_dominant_share", "WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS t FROM s) SELECT user_id, event_type, round(n / t, 6) AS share FROM r WHERE k = 1")
def a35_dominant_share(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = F.array_min(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))).alias("b")  # as many as there are kinds
    return s.groupBy("user_id").agg(best, F.sum("n").alias("t")).select("user_id", "b.event_type", F.round(-F.col("b.m") / F.col("t"), 6).alias("share"))


@query("a41_cluster_centres", "WITH r AS (SELECT l_suppkey AS cluster, l_returnflag AS member, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, member) AS i FROM r) SELECT cluster, member AS centre FROM k WHERE i = 1")
def a41_cluster_centres(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cluster"), F.col("l_returnflag").alias("member")).agg(F.count("*").alias("n"))
    return r.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), "member")).alias("b")).select("cluster", F.col("b.member").alias("centre"))


@query("a48_group_accuracy", "SELECT lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, list_sort(list(DISTINCT source)) AS sources FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1")
def a48_group_accuracy(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("lang is not null")
    return joined.groupBy("lang").agg(F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("o5_reorder", "WITH o AS (SELECT n_nationkey AS pos, n_name AS id FROM nation) SELECT id, row_number() OVER (ORDER BY CASE id WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 3 END, pos) AS pos FROM o")
def o5_reorder(spark, d):
    return S.reordered(table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id")), ["NATION_7", "NATION_3"]).select("id", "pos")


@query("o6_priority_edges", "SELECT o_custkey AS a, o_orderkey AS b, o_totalprice AS score FROM orders ORDER BY o_orderpriority <> '1-URGENT', score DESC, a, b LIMIT 100")
def o6_priority_edges(spark, d):
    from ..operators.search import prioritised

    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("score"), "o_orderpriority")
    return prioritised(edges, F.col("o_orderpriority") == "1-URGENT", "score", 100).select("a", "b", "score")


@query("o10_truncated", "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) > 20 AS truncated FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def o10_truncated(spark, d):
    from ..operators.search import limited

    return limited(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 20)


@query("f12_ratio_similarity", "SELECT o_orderkey, round(1 - abs(o_totalprice - c_acctbal) / greatest(abs(o_totalprice), abs(c_acctbal), 0.000001), 6) AS similarity FROM orders JOIN customer ON o_custkey = c_custkey")
def f12_ratio_similarity(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", F.round(V.ratio(F.col("o_totalprice"), F.col("c_acctbal")), 6).alias("similarity"))


@query("f22_truncated_vectors", "SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings")
def f22_truncated_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.truncated(F.col("embedding"), 8), lambda x: x.cast("double")).alias("v"))


@query("f37_wavelength", "SELECT event_id, CASE WHEN value > 0 THEN round((331 + 0.6 * 20) / value, 6) END AS metres FROM events")
def f37_wavelength(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") > 0, F.round((331 + 0.6 * 20) / F.col("value"), 6)).alias("metres"))


@query("f42_map_merge", "SELECT c_custkey, c_mktsegment AS segment, coalesce(CASE WHEN c_acctbal < 0 THEN 'debt' END, 'fine') AS state FROM customer")
def f42_map_merge(spark, d):
    base = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("state"), F.lit("fine"))
    over = F.map_filter(F.create_map(F.lit("state"), F.when(F.col("c_acctbal") < 0, "debt")), lambda _, v: v.isNotNull())
    merged = F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))
    return table(spark, d, "customer").select("c_custkey", merged["segment"].alias("segment"), merged["state"].alias("state"))


@query("s5_total_budget", "WITH s AS (SELECT doc_id, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY lang ORDER BY doc_id) AS upto, lang FROM documents) SELECT lang, doc_id FROM s WHERE upto <= 100000")
def s5_total_budget(spark, d):
    from ..operators.ordered import budget

    return budget(table(spark, d, "documents"), ["lang"], ["doc_id"], F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), 100_000).select("lang", "doc_id")


@query("p30_line_slice", "SELECT doc_id AS id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS content FROM documents WHERE len(string_split(text, chr(10))) >= 3")
def p30_line_slice(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), X.lines("text").alias("l")).where(F.size("l") >= 3)
    return rows.select("id", F.array_join(F.slice("l", 2, 2), "\n").alias("content"))


@query("p33_aligned_features", "SELECT vec_id, (list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || list_transform(range(0, 70), lambda i: CAST(0 AS DOUBLE)))[1:70] AS v FROM embeddings")
def p33_aligned_features(spark, d):
    """Features of one length: padded with zeros or cut."""
    own = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.slice(F.concat(own, F.array_repeat(F.lit(0.0), 70)), 1, 70).alias("v"))


@query("s19_cache", """WITH e AS (SELECT user_id, event_type AS k, event_id % 2 = 0 AS second, event_id, props FROM events), c AS (SELECT user_id, k, max_by(props, event_id) AS content, max(event_id) AS used, count(*) AS uses FROM e GROUP BY 1, 2), g AS (SELECT * FROM c WHERE NOT (k = 'error' AND user_id % 2 = 0))
SELECT user_id, count(*) AS entries, CAST(sum(uses) AS BIGINT) AS uses, max(used) AS last, round(avg(uses), 6) AS mean_uses, list(content ORDER BY used DESC)[1:2] AS newest FROM g GROUP BY 1""")
def s19_cache(spark, d):
    """A cache that entries are stored in twice and deleted from, listed and counted by scope."""
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("k"), F.col("props").alias("content"), F.col("event_id").alias("used"))
    empty = rows.limit(0).withColumn("uses", F.lit(1).cast("long"))
    held = S.cache_store(S.cache_store(empty, rows.where("used % 2 = 1"), ["user_id"], "k"), rows.where("used % 2 = 0"), ["user_id"], "k")
    held = S.cache_delete(held, rows.where("k = 'error' and user_id % 2 = 0"), ["user_id"], "k")
    newest = S.newest(held, ["user_id"], F.col("used"), 2).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("used")).alias("u"), "content"))), lambda x: x["content"]).alias("newest"))
    return S.cache_stats(held, ["user_id"]).join(newest, "user_id")
