"""Queries of ordered sequences, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, token_set
from ..operators import ordered as O
from .base import query, table

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))"
JACCARD = "CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def terms():
    return token_set("text", least=3, stopwords=STOPWORDS)


@query("w1_rank_score", "SELECT l_orderkey, l_linenumber, round(CASE WHEN count(*) OVER p = 1 THEN 1.0 ELSE 1 - (row_number() OVER w - 1) / (count(*) OVER p - 1) END, 6) AS score FROM lineitem WINDOW p AS (PARTITION BY l_orderkey), w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey)")
def w1_rank_score(spark, d):
    found = O.rank_score(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey"])
    return found.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query("w3_conversation_shifts", f"""WITH t AS (SELECT conv_id, turn, role, text, {TERMS} AS w FROM conversations),
l AS (SELECT *, lag(w) OVER o AS w0, lag(role) OVER o AS role0 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, role <> role0 AS other, contains(text, '?') AS marker, {JACCARD.format(a='w', b='w0')} AS similarity FROM l WHERE w0 IS NOT NULL)
SELECT conv_id, turn, round(similarity, 6) AS similarity, least(round(CASE WHEN other THEN 0.4 ELSE 0 END + CASE WHEN marker THEN 0.3 ELSE 0 END + CASE WHEN similarity < 0.2 THEN 0.3 ELSE 0 END, 6), 1.0)::DOUBLE AS score FROM s""")
def w3_conversation_shifts(spark, d):
    found = O.shifts(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", terms(), F.contains(F.col("text"), F.lit("?")))
    return found.select("conv_id", "turn", F.round("similarity", 6).alias("similarity"), "score")


@query("j10_look_back", f"""WITH t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS i, {TERMS} AS w FROM conversations),
p AS (SELECT a.conv_id, a.i, b.i AS j, {JACCARD.format(a='a.w', b='b.w')} AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 4 AND a.i - 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, i ORDER BY score DESC, j) AS INTEGER) AS rank FROM p WHERE score > 0) SELECT conv_id, i, j, round(score, 6) AS score, rank FROM r WHERE rank <= 2""")
def j10_look_back(spark, d):
    return O.look_back(table(spark, d, "conversations"), ["conv_id"], ["turn"], terms(), 4, 2).withColumn("score", F.round("score", 6))


@query("w12_sessions", """WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def w12_sessions(spark, d):
    found = O.sessions(table(spark, d, "events"), ["user_id"], "ts", 21600)
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("w11_chains", """WITH l AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w = role THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l), i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS k FROM r),
c AS (SELECT *, sum(CASE WHEN b = 1 OR k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM i)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(turn) AS first_turn, count(*) AS n FROM c GROUP BY 1, 2""")
def w11_chains(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    found = O.islands(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.lag("role").over(w).isNull() | (F.lag("role").over(w) == F.col("role")), 3)
    return found.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("w17_dense_buckets", """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), s AS (SELECT unnest(range(0, (hi - lo) // 3600000000 + 1)) AS bucket FROM b),
f AS (SELECT (epoch_us(ts) - lo) // 3600000000 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events, b GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n, total FROM s LEFT JOIN f USING (bucket)""")
def w17_dense_buckets(spark, d):
    found = O.dense_buckets(table(spark, d, "events"), "ts", 3_600_000_000, F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query("w18_trailing_windows", """WITH m AS (SELECT max(ts) AS hi FROM events)
SELECT event_type, count(*) FILTER (ts >= hi - INTERVAL 1 DAY) AS short_n, count(*) FILTER (ts >= hi - INTERVAL 7 DAY) AS long_n FROM events, m GROUP BY 1""")
def w18_trailing_windows(spark, d):
    events = table(spark, d, "events")
    hi = events.agg(F.max("ts").alias("hi"))
    within = lambda days: F.count(F.when(F.col("ts") >= F.col("hi") - F.make_dt_interval(F.lit(days)), 1))
    return events.join(F.broadcast(hi)).groupBy("event_type").agg(within(1).alias("short_n"), within(7).alias("long_n"))


@query("w16_count_windows", """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, value, unnest(range(greatest(CAST(ceil((i - 4) / 3) AS BIGINT), 0), least(i // 3, CAST(greatest(floor((n - 5) / 3), 0) AS BIGINT)) + 1)) AS "window" FROM n)
SELECT user_id, "window", count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""")
def w16_count_windows(spark, d):
    return O.count_windows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5, 3, F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("w15_tumbling", """WITH t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS "window", text FROM conversations)
SELECT conv_id, "window", count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY 1, 2""")
def w15_tumbling(spark, d):
    found = O.tumbling(table(spark, d, "conversations"), ["conv_id"], ["turn"], 4)
    return found.groupBy("conv_id", "window").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("w19_budget", """WITH s AS (SELECT doc_id, source, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id) - strlen(coalesce(text, '')) AS before, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, doc_id, CAST(before AS BIGINT) AS before FROM s WHERE upto <= 50000""")
def w19_budget(spark, d):
    found = O.budget(table(spark, d, "documents"), ["source"], ["doc_id"], F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), 50_000)
    return found.select("source", "doc_id", "before")


@query("w8_trend_labels", """WITH d AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, round(sum(value), 2) AS total FROM events GROUP BY 1, 2),
x AS (SELECT *, round(total - lag(total) OVER (PARTITION BY event_type ORDER BY day), 4) AS delta FROM d)
SELECT event_type, day, delta, CASE WHEN delta IS NULL THEN 'start' WHEN delta > 0.5 THEN 'rise' WHEN delta < -0.5 THEN 'fall' ELSE 'steady' END AS label FROM x""")
def w8_trend_labels(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("total"))
    return O.trend_labels(daily, ["event_type"], ["day"], "total", 0.5).select("event_type", "day", "delta", "label")


@query("w14_lead_rates", """SELECT event_id, round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0, 6) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w14_lead_rates(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round((O.micros(F.lead("ts").over(w)) - O.micros("ts")) / 1_000_000, 6).alias("seconds"))


@query("j11_time_band", """SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000""")
def j11_time_band(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", O.micros("ts").alias("at"))
    a = events.where("event_type = 'purchase'").select(F.col("event_id").alias("left_id"), F.col("at").alias("ta"))
    b = events.where("event_type = 'error'").select(F.col("event_id").alias("right_id"), F.col("at").alias("tb"))
    return O.band_join(a, b, "ta", "tb", 60_000_000).select("left_id", "right_id")


@query("w20_group_packing", """WITH t AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS "group", n_chars FROM documents) SELECT source, "group", count(*) AS n, round(avg(n_chars), 4) AS mean FROM t GROUP BY 1, 2""")
def w20_group_packing(spark, d):
    found = O.tumbling(table(spark, d, "documents"), ["source"], ["doc_id"], 8).withColumnRenamed("window", "group")
    return found.groupBy("source", "group").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("w23_round_robin", """SELECT conv_id, turn, ['proposer', 'critic', 'judge'][(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 + 1] AS part FROM conversations""")
def w23_round_robin(spark, d):
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    parts = F.array(F.lit("proposer"), F.lit("critic"), F.lit("judge"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.element_at(parts, (i - 1) % 3 + 1).alias("part"))


@query("c25_recent_messages", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (k > 3), '') AS older, count(*) FILTER (k <= 3) AS recent FROM r GROUP BY 1""")
def c25_recent_messages(spark, d):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, d, "conversations").withColumn("k", k)
    old = F.array_sort(F.collect_list(F.when(F.col("k") > 3, F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(old, lambda x: x["line"]), "\n").alias("older"), F.count(F.when(F.col("k") <= 3, 1)).alias("recent"))


@query("r11_window_events", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def r11_window_events(spark, d):
    found = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("event_type", F.col("w.start").alias("start"), "n", "total")
