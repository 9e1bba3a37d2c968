"""Queries of graph kernels, stores and relational operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lexicon as L
from ..operators import stores as S
from ..operators import terms as T
from ..operators.state import checkpointed
from .base import query, table
from .terms import PAIRS, similar

EDGES = "e AS (SELECT a, b, round(jaccard, 6) AS score FROM j), y AS (SELECT a, b, score FROM e UNION SELECT b, a, score FROM e)"
RECURSIVE = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)


def edges(spark, d):
    """Similar documents, as the similarity join finds them."""
    return similar(spark, d).select("a", "b", F.round("jaccard", 6).alias("score"))


@query("a37_degrees", PAIRS + f", {EDGES} SELECT a AS node, count(*) AS degree FROM y GROUP BY 1")
def a37_degrees(spark, d):
    return G.degrees(edges(spark, d).select("a", "b"))


@query("a39_components", RECURSIVE + f""", {EDGES}, r AS (SELECT a AS node, a AS other FROM y UNION SELECT r.node, y.b FROM r JOIN y ON r.other = y.a) SELECT node, min(other) AS component FROM r GROUP BY 1""")
def a39_components(spark, d):
    return G.components(checkpointed(edges(spark, d)))


KIN = """y AS (SELECT c_custkey AS b, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, c_acctbal AS score FROM customer),
n AS (SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey) AS nodes FROM customer),
k AS (SELECT *, CAST(dense_rank() OVER (ORDER BY component, (place - 1) // 25) AS BIGINT) AS cluster FROM n WHERE nodes > 1), w AS (SELECT max(cluster) > 60 AS over FROM k)"""


def kin(spark, d):
    """Customers of a nation, each linked to the next."""
    c = table(spark, d, "customer").withColumn("a", F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("a is not null")
    return c.select("a", F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("score"))


@query("a39_cluster_members", f"WITH {KIN} SELECT node, cluster, component, place FROM k WHERE cluster <= 60")
def a39_cluster_members(spark, d):
    """Components in slices of 25 nodes at most, the first 60 of them."""
    return G.clusters(kin(spark, d), 25, 60)[0]


@query("a39_clusters", f"WITH {KIN}, i AS (SELECT x.cluster, count(*) AS links, avg(score) AS s FROM y JOIN k x ON x.node = a JOIN k z ON z.node = b AND z.cluster = x.cluster GROUP BY 1) SELECT cluster, component, count(*) AS size, coalesce(max(links), 0) AS links, round(max(s), 4) AS mean_score, bool_or(nodes > 25) OR any_value(over) AS truncated FROM k LEFT JOIN i USING (cluster), w WHERE cluster <= 60 GROUP BY 1, 2")
def a39_clusters(spark, d):
    """Sizes, links and mean scores of the slices, and whether something was cut."""
    return G.clusters(kin(spark, d), 25, 60, "score")[1].withColumn("mean_score", F.round("mean_score", 4))


@query("a38_core_numbers", RECURSIVE + f""", {EDGES}, h AS (SELECT a AS node, count(*) AS c, 0 AS i FROM y GROUP BY 1
UNION ALL SELECT node, max(least(c, r)) AS c, i + 1 AS i FROM (SELECT y.a AS node, h.c, h.i, row_number() OVER (PARTITION BY y.a ORDER BY h.c DESC) AS r FROM y JOIN h ON h.node = y.b WHERE h.i < 40) GROUP BY node, i)
SELECT node, CAST(c AS INTEGER) AS core FROM h WHERE i = 40""")
def a38_core_numbers(spark, d):
    """Core numbers; the SQL takes them as the limit of h-indices of the neighbours' values."""
    return G.core_numbers(edges(spark, d))


@query("g1_strong_components", RECURSIVE + f""", {EDGES}, t AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM y) WHERE k <= 2),
r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a), n AS (SELECT a AS node FROM t UNION SELECT b FROM t)
SELECT node, least(node, (SELECT min(x.b) FROM r x JOIN r z ON z.a = x.b AND z.b = x.a WHERE x.a = node)) AS component FROM n""")
def g1_strong_components(spark, d):
    """Documents that name each other among their two best partners, directly or around."""
    return G.strong_components(T.top_neighbours(T.both_ways(edges(spark, d)), "score", 2).select("a", "b"))


@query("g2_best_paths", PAIRS + f""", {EDGES},
p2 AS (SELECT x.a, z.b, x.score * z.score AS score, [x.a, x.b, z.b] AS nodes FROM y x JOIN y z ON x.b = z.a WHERE z.b <> x.a AND x.score >= 0.1 AND x.score * z.score >= 0.1),
p3 AS (SELECT p2.a, y.b, p2.score * y.score AS score FROM p2 JOIN y ON p2.b = y.a WHERE NOT list_contains(nodes, y.b) AND p2.score * y.score >= 0.1),
f AS (SELECT a, b, score, 2 AS hops FROM p2 UNION ALL SELECT a, b, score, 3 FROM p3), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(score, 9) DESC, hops) AS k FROM f WHERE a < b) SELECT a, b, round(score, 6) AS score, hops FROM r WHERE k = 1""")
def g2_best_paths(spark, d):
    return G.best_paths(edges(spark, d), 3, 0.1).withColumn("score", F.round("score", 6))


@query("g3_adjacency", PAIRS + f", {EDGES} SELECT a AS node, list(b ORDER BY b) AS neighbours, list(score ORDER BY b) AS scores FROM y GROUP BY 1")
def g3_adjacency(spark, d):
    """Neighbours of each node with their scores, in order."""
    held = F.array_sort(F.collect_list(F.struct("b", "score")))
    found = G.symmetric(edges(spark, d)).groupBy(F.col("a").alias("node")).agg(held.alias("x"))
    return found.select("node", F.col("x.b").alias("neighbours"), F.col("x.score").alias("scores"))


@query("g4_depths", """WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), r AS (SELECT node, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.node, depth + 1 FROM p JOIN r ON p.parent = r.node) SELECT * FROM r""")
def g4_depths(spark, d):
    key = F.col("p_partkey").cast("long")
    return G.depths(table(spark, d, "part").select(key.alias("node"), F.when(key > 1, F.floor(key / 2)).alias("parent")))


@query("s16_changed_files", "SELECT o_orderkey AS path, o_custkey AS size, CASE o_orderkey % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'later' ELSE 'other size' END AS kind FROM orders WHERE o_orderkey % 7 < 3")
def s16_changed_files(spark, d):
    """Of all files those that a store does not have in this state: new ones, later ones, and ones of another size."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 7
    found = o.select(F.col("o_orderkey").alias("path"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_custkey").alias("size"), F.when(k == 0, "new").when(k == 1, "later").when(k == 2, "other size").alias("kind"))
    known = found.where("path % 7 <> 0").select("path", (F.col("mtime") - F.when(F.col("kind") == "later", 1).otherwise(0)).alias("mtime"), (F.col("size") - F.when(F.col("kind") == "other size", 1).otherwise(0)).alias("size"))
    return S.changed_files(found, known).select("path", "size", "kind")


@query("s17_latest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1")
def s17_latest(spark, d):
    rows = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return S.latest(rows, ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@query("s17_add_weights", "SELECT l_suppkey AS source, l_returnflag AS target, count(*) + sum(l_linenumber) AS weight FROM lineitem GROUP BY 1, 2")
def s17_add_weights(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("target"), F.lit(1).cast("long").alias("weight"), F.col("l_linenumber").cast("long").alias("n"))
    out = S.add_weights(line.select("source", "target", "weight"), line.select("source", "target", F.col("n").alias("weight")), ["source", "target"])
    return out.withColumn("weight", F.col("weight").cast("decimal(38,0)"))


@query("s18_upsert", """WITH o AS (SELECT c_custkey AS key, c_name AS content, c_acctbal AS balance FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT c_custkey AS key, CASE WHEN c_nationkey < 12 THEN upper(c_name) END AS content, CASE WHEN c_nationkey = 5 THEN NULL ELSE -c_acctbal END AS balance FROM customer WHERE c_acctbal > 0)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.content, o.content) AS content, CASE WHEN n.key IS NOT NULL THEN n.balance ELSE o.balance END AS balance FROM o FULL JOIN n ON o.key = n.key""")
def s18_upsert(spark, d):
    c = table(spark, d, "customer")
    key, content, balance = F.col("c_custkey").alias("key"), F.col("c_name").alias("content"), F.col("c_acctbal").alias("balance")
    old = c.where("c_mktsegment <> 'BUILDING'").select(key, content, balance)
    new = c.where("c_acctbal > 0").select(key, F.when(F.col("c_nationkey") < 12, F.upper("c_name")).alias("content"), F.when(F.col("c_nationkey") != 5, -F.col("c_acctbal")).alias("balance"))
    return S.upsert_keep_null(old, new, ["key"], ("balance",))


@query("a33_merged_counters", """WITH u AS (SELECT l_returnflag AS k, l_suppkey AS term, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_linestatus, l_suppkey, count(*) FROM lineitem GROUP BY 1, 2), t AS (SELECT k, term, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, term) AS i FROM t) SELECT k, term, n FROM r WHERE i <= 5""")
def a33_merged_counters(spark, d):
    line = table(spark, d, "lineitem")
    part = lambda c: line.groupBy(F.col(c).alias("k"), F.col("l_suppkey").alias("term")).agg(F.count("*").alias("n"))
    return S.merged_counters(part("l_returnflag"), part("l_linestatus"), ["k", "term"], 5)


@query("o7_newest", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT user_id, event_id FROM r WHERE i <= 3")
def o7_newest(spark, d):
    return S.newest(table(spark, d, "events"), ["user_id"], F.struct("ts", "event_id"), 3).select("user_id", "event_id")


STEP = "0.1 * (r.y - 1 / (1 + exp(-(s.w * r.x + s.v * r.z + s.b))))"


@query("r8_online_learning", f"""WITH e AS (SELECT user_id, [{{'w': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'z': 0.0::DOUBLE, 'y': 0.0::DOUBLE}}] || list({{'w': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'x': value / 100, 'z': CAST(hour(ts) / 24 AS DOUBLE), 'y': CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END}} ORDER BY event_id) AS e FROM events GROUP BY 1),
f AS (SELECT user_id, list_reduce(e, lambda s, r: {{'w': s.w + {STEP} * r.x, 'v': s.v + {STEP} * r.z, 'b': s.b + {STEP}, 'x': r.x, 'z': r.z, 'y': r.y}}) AS f FROM e) SELECT user_id, [round(f.w, 9), round(f.v, 9)] AS weights, round(f.b, 9) AS bias FROM f""")
def r8_online_learning(spark, d):
    rows = table(spark, d, "events").withColumn("y", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    x = F.array(F.col("value") / 100, F.hour("ts") / 24)
    out = S.replay(rows, ["user_id"], "event_id", x, F.col("y"), 0.1)
    return out.select("user_id", F.transform("weights", lambda w: F.round(w, 9)).alias("weights"), F.round("bias", 9).alias("bias"))


@query("a43_role_counts", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def a43_role_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a16_speaker_profile", r"""WITH t AS (SELECT role, length(text) AS chars, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS w, len(regexp_extract_all(text, '([A-Z])', 1)) AS upper, len(regexp_extract_all(text, '([.,;:!?])', 1)) AS marks FROM conversations),
x AS (SELECT role, count(*) AS segments, sum(len(w)) AS tokens, sum(upper) AS upper, sum(marks) AS marks, sum(chars) AS chars FROM t GROUP BY 1), v AS (SELECT role, count(DISTINCT term) AS vocab FROM (SELECT role, unnest(w) AS term FROM t) GROUP BY 1)
SELECT role, segments, CAST(tokens AS BIGINT) AS tokens, round(vocab / tokens, 6) AS vocabulary, round(upper / chars, 6) AS upper_share, round(100 * marks / tokens, 6) AS marks_per_100 FROM x JOIN v USING (role)""")
def a16_speaker_profile(spark, d):
    from ..functions.text import tokens

    rows = table(spark, d, "conversations").select("role", "text", tokens("text").alias("w"))
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(1)))
    x = rows.groupBy("role").agg(F.count("*").alias("segments"), F.sum(F.size("w")).alias("tokens"), F.sum(count("([A-Z])")).alias("u"), F.sum(count("([.,;:!?])")).alias("m"), F.sum(F.length("text")).alias("c"))
    v = rows.select("role", F.explode("w").alias("t")).groupBy("role").agg(F.count_distinct("t").alias("vocab"))
    return x.join(v, "role").select("role", "segments", "tokens", F.round(F.col("vocab") / F.col("tokens"), 6).alias("vocabulary"), F.round(F.col("u") / F.col("c"), 6).alias("upper_share"), F.round(100 * F.col("m") / F.col("tokens"), 6).alias("marks_per_100"))


@query("a57_prompt", """WITH l AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM l),
m AS (SELECT conv_id, k, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS content FROM i GROUP BY 1, 2) SELECT conv_id, string_agg(role || ': ' || content, chr(10) || chr(10) ORDER BY k) AS prompt FROM m GROUP BY 1""")
def a57_prompt(spark, d):
    from ..operators.ordered import islands

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = islands(table(spark, d, "conversations"), ["conv_id"], ["turn"], ~F.lag("role").over(w).eqNullSafe(F.col("role")))
    text = lambda order, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("x")))), lambda s: s["x"]), sep)
    merged = rows.groupBy("conv_id", "island").agg(F.first("role").alias("role"), text("turn", F.col("text"), "\n").alias("content"))
    return merged.groupBy("conv_id").agg(text("island", F.concat_ws(": ", "role", "content"), "\n\n").alias("prompt"))


@query("e8_timeline", """WITH l AS (SELECT min(ts) AS t0 FROM events), r AS (SELECT (epoch_us(ts) - epoch_us(t0)) // 7200000000 AS bucket, event_id, event_type, ts FROM events, l), i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS i FROM r),
g AS (SELECT bucket, count(*) AS n, min(ts) AS first, max(ts) AS last, list(event_type || ' ' || event_id ORDER BY i) FILTER (i <= 5) AS captions, count(*) > 5 AS truncated FROM i GROUP BY 1) SELECT *, bucket - lag(bucket) OVER (ORDER BY bucket) > 1 AS after_gap FROM g""")
def e8_timeline(spark, d):
    """Two-hour frames from the first event on: their number, span and first five captions, and whether empty frames came before."""
    from ..operators.ordered import micros

    rows = table(spark, d, "events").select(micros("ts").alias("us"), "ts", "event_id", "event_type")
    start = rows.agg(F.min("us").alias("t0"))
    rows = rows.join(F.broadcast(start)).withColumn("bucket", F.floor((F.col("us") - F.col("t0")) / 7_200_000_000))
    i = F.row_number().over(Window.partitionBy("bucket").orderBy("ts", "event_id"))
    best = rows.withColumn("i", i).where("i <= 5").groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws(" ", "event_type", "event_id").alias("c")))), lambda x: x["c"]).alias("captions"))
    frames = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), (F.count("*") > 5).alias("truncated"))
    before = frames.select((F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("follows"))
    first = frames.agg(F.min("bucket").alias("low"))
    out = frames.join(best, "bucket").join(before, "bucket", "left").join(F.broadcast(first))
    return out.withColumn("after_gap", F.when(F.col("bucket") > F.col("low"), F.col("follows").isNull())).drop("follows", "low")


@query("j26_unresolved", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def j26_unresolved(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("j25_fallback_keys", """WITH c AS (SELECT c_custkey AS id, 1 AS p, s_suppkey AS hit FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey UNION ALL SELECT c_custkey, 2, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY p) AS k FROM c) SELECT id, hit FROM r WHERE k = 1""")
def j25_fallback_keys(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    s = table(spark, d, "supplier")
    exact = c.join(s, (c.id == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).select("id", F.col("s_suppkey").alias("hit"))
    # a second key counts only where the first finds nothing, so those rows are left out before they meet their nation
    loose = c.join(exact.select("id").distinct(), "id", "left_anti").join(s, F.col("c_nationkey") == F.col("s_nationkey")).select("id", F.col("s_suppkey").alias("hit"))
    return exact.unionAll(loose)


@query("t1_term_sets", """WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'shared' AS kind, count(*) AS n FROM (SELECT * FROM s INTERSECT SELECT * FROM l) UNION ALL SELECT 'only_left', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM l) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM s UNION SELECT * FROM l)""")
def t1_term_sets(spark, d):
    users = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).select("user_id").distinct()
    s, l = users("purchase"), users("error")  # noqa: E741
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(s.intersect(l), "shared").unionAll(count(s.subtract(l), "only_left")).unionAll(count(s.union(l).distinct(), "either"))


@query("t7_bag_operations", """SELECT * FROM (SELECT l_returnflag AS k FROM lineitem EXCEPT ALL SELECT l_linestatus FROM lineitem)""")
def t7_bag_operations(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_returnflag").alias("k")).exceptAll(line.select(F.col("l_linestatus").alias("k")))


@query("w25_rank_frames", "SELECT c_custkey, CAST(ntile(4) OVER w AS INTEGER) AS quarter, CAST(dense_rank() OVER w AS INTEGER) AS place, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 100 PRECEDING AND CURRENT ROW), 4) AS near FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def w25_rank_frames(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    near = F.sum("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_acctbal").rangeBetween(-100, 0))
    return table(spark, d, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(w).alias("place"), F.round(near, 4).alias("near"))


@query("a58_label_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a58_label_confusion(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("j36_marker_scores", """WITH m AS (SELECT * FROM (VALUES ('law', 'license'), ('law', 'rights'), ('abuse', 'idiot'), ('abuse', 'moron'), ('none', 'zzz')) AS t(topic, marker)), w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS t FROM documents), c AS (SELECT t AS marker, count(*) AS n FROM w GROUP BY 1)
SELECT topic, CAST(sum(coalesce(n, 0)) AS BIGINT) AS score FROM m LEFT JOIN c USING (marker) GROUP BY 1""")
def j36_marker_scores(spark, d):
    markers = spark.createDataFrame([("law", "license"), ("law", "rights"), ("abuse", "idiot"), ("abuse", "moron"), ("none", "zzz")], "topic string, term string")
    found = L.by_token(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), markers.select("term").distinct()).groupBy("term").agg(F.sum("n").alias("n"))
    return markers.join(found, "term", "left").groupBy("topic").agg(F.sum(F.coalesce("n", F.lit(0))).alias("score"))
