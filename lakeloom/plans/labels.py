"""Queries of labels, checks and conversations, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, token_set
from ..operators import rules as R
from .base import query, table

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)"


def listed(words: tuple[str, ...]) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))"


@query("p14_bands", "SELECT doc_id AS id, CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'middle' ELSE 'long' END AS band FROM documents")
def p14_bands(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), R.bands(F.col("n_chars"), [(500, "short"), (2000, "middle")], "long").alias("band"))


@query(
    "p16_intent",
    f"""WITH t AS (SELECT conv_id, turn, text, {WORDS} AS w FROM conversations), c AS (SELECT *, {listed(R.PRONOUNS['first'])} AS a, {listed(R.PRONOUNS['second'])} AS b, {listed(R.PRONOUNS['third'])} AS c FROM t)
SELECT conv_id, turn, CASE WHEN ends_with(trim(text, ' '), '?') THEN 'question' WHEN {listed(R.REQUEST)} > 0 THEN 'request' WHEN {listed(R.DIRECTIVE)} > 0 THEN 'directive' ELSE 'statement' END AS intent,
 CASE WHEN {listed(R.POSITIVE)} > {listed(R.NEGATIVE)} THEN 'positive' WHEN {listed(R.POSITIVE)} < {listed(R.NEGATIVE)} THEN 'negative' ELSE 'neutral' END AS sentiment,
 CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN (a = greatest(a, b, c))::INT + (b = greatest(a, b, c))::INT + (c = greatest(a, b, c))::INT > 1 THEN 'mixed' WHEN a = greatest(a, b, c) THEN 'first' WHEN b = greatest(a, b, c) THEN 'second' ELSE 'third' END AS perspective FROM c""",
)
def p16_intent(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", R.intent(t).alias("intent"), R.sentiment(t).alias("sentiment"), R.perspective(t).alias("perspective"))


@query(
    "p24_fluency",
    f"""WITH t AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations) SELECT conv_id, turn, round(greatest(0.0, least(1.0, 1 - 0.6 * {listed(R.FILLERS)} / greatest(len(w), 1) - 0.4 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / greatest(len(w), 1))), 6) AS fluency FROM t""",
)
def p24_fluency(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(R.fluency(F.col("text")), 6).alias("fluency"))


@query(
    "p25_pauses",
    f"""WITH t AS (SELECT conv_id, turn, len({WORDS}) AS n, right(trim(text, ' '), 1) AS e FROM conversations)
SELECT conv_id, turn, CAST(greatest(0, CASE WHEN e IN ('.', '!', '?') THEN 500 WHEN e IN (',', ';', ':') THEN 200 ELSE 0 END + CASE WHEN n <= 6 THEN -80 WHEN n >= 20 THEN 120 ELSE 0 END) AS INTEGER) AS ms FROM t""",
)
def p25_pauses(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.pause_ms(F.col("text")).alias("ms"))


@query(
    "e2_context_block",
    """WITH c AS (SELECT conv_id, turn, substr(text, 1, 100) AS c FROM conversations), b AS (SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT conv_id, string_agg(substr(c, 1, CAST(300 - used AS BIGINT)), chr(10) || chr(10) ORDER BY turn) AS context FROM b WHERE used < 300 GROUP BY 1""",
)
def e2_context_block(spark, d):
    return R.context_block(table(spark, d, "conversations").withColumnRenamed("text", "content"), ["conv_id"], "turn", 100, 300)


@query(
    "p7_required_terms",
    f"""WITH w AS (SELECT doc_id AS id, list_distinct({WORDS}) AS w FROM documents), r AS (SELECT id, list_sort(list_filter(['the', 'and', 'that'], lambda t: NOT list_contains(w, t))) AS missing FROM w WHERE len(w) > 0) SELECT id, missing, len(missing) = 0 AS allowed FROM r""",
)
def p7_required_terms(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(token_set("text")).alias("term"))
    return R.missing_required(words, ["the", "and", "that"])


STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
OWN = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))"
SCORES = "list_transform(s.l, lambda x: len(list_intersect(x, r.t)) / greatest(1, len(x) + len(r.t) - len(list_intersect(x, r.t))))"


@query(
    "a40_leader_clusters",
    f"""WITH t AS (SELECT conv_id, turn, {OWN} AS t FROM conversations), e AS (SELECT conv_id, [{{'l': []::VARCHAR[][], 'o': []::BIGINT[], 't': []::VARCHAR[]}}] || list({{'l': []::VARCHAR[][], 'o': []::BIGINT[], 't': t}} ORDER BY turn) AS e, list(turn ORDER BY turn) AS turns FROM t GROUP BY 1),
f AS (SELECT conv_id, turns, list_reduce(e, lambda s, r: {{'l': CASE WHEN coalesce(list_max({SCORES}), 0) >= 0.2 OR len(s.l) >= 4 THEN s.l ELSE list_append(s.l, r.t) END, 'o': list_append(s.o, CASE WHEN coalesce(list_max({SCORES}), 0) >= 0.2 THEN list_position({SCORES}, list_max({SCORES})) - 1 WHEN len(s.l) < 4 THEN len(s.l) END), 't': r.t}}).o AS o FROM e)
SELECT conv_id AS group, unnest(turns) AS id, unnest(o) AS cluster FROM f""",
)
def a40_leader_clusters(spark, d):
    """Turns of each conversation, clustered in order."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("pos"), F.col("turn").alias("id"), token_set("text", least=3, stopwords=STOPWORDS).alias("terms"))
    return R.leader_clusters(rows, 0.2, 4)


@query(
    "c15_conversation_segments",
    "SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, upper(role[1]) || lower(role[2:]) AS speaker, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') AS content FROM conversations",
)
def c15_conversation_segments(spark, d):
    w = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.col("text")).alias("l")))), lambda x: x["l"]), "\n")
    return R.conversation_segments(table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(w.alias("text")))
