"""Queries of text functions, predicates, chunkers and lexicon joins, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import lexicon as L
from .base import query, table


def docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


@query("f2_sentences", r"""SELECT doc_id AS id, CAST(len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')) AS BIGINT) AS sentences,
  CAST(len(list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')) AS BIGINT) AS paragraphs, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents""")
def f2_sentences(spark, d):
    size = lambda c: F.size(c).cast("long")
    return docs(spark, d).select("id", size(X.sentences("text")).alias("sentences"), size(X.paragraphs("text")).alias("paragraphs"), size(X.lines("text")).alias("lines"))


@query("p31_size_statistics", r"""SELECT doc_id AS id, CAST(len(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS BIGINT) AS tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))) AS BIGINT) AS distinct_tokens,
  CAST(length(text) AS BIGINT) AS chars, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS estimate FROM documents""")
def p31_size_statistics(spark, d):
    return docs(spark, d).select("id", X.size_statistics("text").alias("s"), X.token_estimate("text").alias("estimate")).select("id", "s.tokens", "s.distinct_tokens", "s.chars", "estimate")


@query("f25_preview", "SELECT doc_id AS id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM documents")
def f25_preview(spark, d):
    return docs(spark, d).select("id", X.preview("text", 80).alias("preview"))


@query("f25_truncate_bytes", "WITH c AS (SELECT id, k, substr(text, k, 1) AS c FROM (SELECT doc_id AS id, coalesce(text, '') AS text, unnest(range(1, 51)) AS k FROM documents) WHERE k <= length(text)), b AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY id ORDER BY k) AS n FROM c) SELECT d.doc_id AS id, coalesce(string_agg(c, '' ORDER BY k), '') AS cut FROM documents d LEFT JOIN b ON b.id = d.doc_id AND n <= 50 GROUP BY d.doc_id")
def f25_truncate_bytes(spark, d):
    """The longest prefix of whole characters in 50 bytes."""
    return docs(spark, d).select("id", X.truncate_utf8("text", 50).alias("cut"))


@query("f6_hashes", "SELECT doc_id AS id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def f6_hashes(spark, d):
    return docs(spark, d).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("f33_vowels", "SELECT doc_id AS id, regexp_replace(lower(text), '[^aeiou]', '', 'g') AS vowels FROM documents")
def f33_vowels(spark, d):
    return docs(spark, d).select("id", X.vowels("text").alias("vowels"))


@query("f32_named_terms", "SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1))) AS terms FROM documents")
def f32_named_terms(spark, d):
    return docs(spark, d).select("id", F.array_sort(X.named_terms("text")).alias("terms"))


@query("f34_word_forms", r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '([A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*)', 1) AS w FROM documents)
SELECT id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{2,}'))) AS BIGINT) AS upper, CAST(len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]+'))) AS BIGINT) AS capital,
  CAST(len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) AS BIGINT) AS "numeric", CAST(len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z0-9]+') AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))) AS BIGINT) AS mixed,
  CAST(len(list_filter(w, lambda x: contains(x, ''''))) AS BIGINT) AS contraction, CAST(len(list_filter(w, lambda x: contains(x, '-'))) AS BIGINT) AS hyphen FROM w""")
def f34_word_forms(spark, d):
    return docs(spark, d).select("id", X.word_forms("text").alias("f")).select("id", "f.*")


@query("f39_escape", "SELECT page_id AS id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages")
def f39_escape(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5(X.escape_xml("html").cast("binary")).alias("escaped"))


@query("f41_tags", r"SELECT DISTINCT regexp_replace(trim(lower(c_mktsegment), ' '), '\s+', ' ', 'g') AS tag FROM customer")
def f41_tags(spark, d):
    return table(spark, d, "customer").select(X.tag("c_mktsegment").alias("tag")).distinct()


@query("f5_durations", "SELECT event_id AS id, event_id % 500 * CASE event_id % 4 WHEN 0 THEN 1000000 WHEN 1 THEN 1000000000 WHEN 2 THEN 60000000000 ELSE 3600000000000 END AS ns FROM events")
def f5_durations(spark, d):
    unit = F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit(" m"), F.lit("h")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.duration_ns(F.concat((F.col("event_id") % 500).cast("string"), unit)).alias("ns"))


@query("f4_timestamps", "SELECT event_id AS id, epoch_us(date_trunc('second', ts)) * 1000 AS ns FROM events")
def f4_timestamps(spark, d):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.timestamp_ns(iso).alias("ns"))


@query("s8_json_properties", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s8_json_properties(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json(X.lenient_json("props"), "k long")["k"].alias("k"))


@query("f44_links", r"""WITH l AS (SELECT page_id AS id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), t AS (SELECT id, trim(regexp_replace(regexp_replace(href, '#.*$', ''), '\?.*$', ''), ' ') AS target FROM l)
SELECT target, count(*) AS n, count(DISTINCT id) AS pages FROM t WHERE target <> '' GROUP BY 1""")
def f44_links(spark, d):
    links = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("id", X.link_target("href").alias("target")).where("target <> ''").groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("id").alias("pages"))


@query("f43_titles", r"""WITH f AS (SELECT doc_id AS id, trim(coalesce(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '')[1], ''), ' ') AS f FROM documents)
SELECT id, CASE WHEN starts_with(f, '#') THEN regexp_extract(f, '^#+\s*(.*)$', 1) WHEN starts_with(lower(f), 'title:') THEN regexp_extract(f, '(?i)^title:\s*(.*)$', 1) ELSE substr(f, 1, 120) END AS title FROM f""")
def f43_titles(spark, d):
    return docs(spark, d).select("id", X.title("text").alias("title"))


@query("s23_text_search", """WITH l AS (SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS content FROM documents), c AS (SELECT *, lag(content) OVER w AS before, lead(content) OVER w AS after FROM l WINDOW w AS (PARTITION BY id ORDER BY line))
SELECT id, CAST(line AS INTEGER) AS line, content, before, after FROM c WHERE contains(lower(content), 'license')""")
def s23_text_search(spark, d):
    return L.grep(docs(spark, d), "license", ignore_case=True)


TERMS = ["the", "ing", "license", "idiot", "von", "que"]
TERM_SQL = "t AS (SELECT unnest(['the', 'ing', 'license', 'idiot', 'von', 'que']) AS term), x AS (SELECT doc_id AS id, lower(text) AS text FROM documents)"


def lexicon(spark):
    return spark.createDataFrame([(t, "short" if len(t) <= 3 else "long") for t in TERMS], "term string, category string")


@query("j13_contains_terms", f"WITH {TERM_SQL} SELECT id, term, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS BIGINT) AS n, CAST(strpos(text, term) AS INTEGER) AS first_at FROM x, t WHERE contains(text, term)")
def j13_contains_terms(spark, d):
    return L.match_terms(docs(spark, d), lexicon(spark)).select("id", "term", "n", "first_at")


@query("j35_categories", f"""WITH {TERM_SQL}, c AS (SELECT term, CASE WHEN length(term) <= 3 THEN 'short' ELSE 'long' END AS category FROM t), m AS (SELECT id, category, count(*) FILTER (contains(text, term)) AS terms FROM x, c GROUP BY 1, 2) SELECT id, category, terms, terms > 0 AS active FROM m""")
def j35_categories(spark, d):
    return L.categories(docs(spark, d), lexicon(spark))


@query("j14_weights", f"""WITH {TERM_SQL}, m AS (SELECT id, term, least(3, 0.6 + 0.25) AS w FROM x, t WHERE contains(text, term)) SELECT id, term, round(w / sum(w) OVER (PARTITION BY id), 6) AS confidence FROM m""")
def j14_weights(spark, d):
    return L.weighted_matches(docs(spark, d), lexicon(spark)).select("id", "term", F.round("confidence", 6).alias("confidence"))


@query("j15_dictionary_coverage", """WITH w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS word FROM documents), dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS word FROM benchmark)
SELECT id, count(*) AS words, count(dict.word) AS matched, round(count(dict.word) / count(*), 6) AS coverage FROM w LEFT JOIN dict USING (word) GROUP BY 1""")
def j15_dictionary_coverage(spark, d):
    words = docs(spark, d).select("id", F.explode(X.token_set("text")).alias("word"))
    entries = table(spark, d, "benchmark").select(F.explode(X.token_set("text")).alias("word")).distinct()
    return L.coverage(words, entries).withColumn("coverage", F.round("coverage", 6))


@query("j16_missing_words", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS word FROM benchmark), dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS word FROM documents) SELECT word FROM w ANTI JOIN dict USING (word)""")
def j16_missing_words(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.token_set("text")).alias("word")).distinct()
    return words.join(docs(spark, d).select(F.explode(X.token_set("text")).alias("word")).distinct(), "word", "left_anti")


@query("p8_rules", """WITH r AS (SELECT * FROM (VALUES ('a', 'contains', 'license'), ('b', 'prefix', 'the '), ('c', 'suffix', '.'), ('d', 'regex', '[0-9]{3,}')) AS t(tag, kind, pattern)), x AS (SELECT doc_id AS id, lower(text) AS text FROM documents)
SELECT id, tag FROM x, r WHERE CASE kind WHEN 'contains' THEN contains(text, pattern) WHEN 'prefix' THEN starts_with(text, pattern) WHEN 'suffix' THEN ends_with(text, pattern) ELSE regexp_matches(text, pattern) END""")
def p8_rules(spark, d):
    rules = spark.createDataFrame([("a", "contains", "license"), ("b", "prefix", "the "), ("c", "suffix", "."), ("d", "regex", "[0-9]{3,}")], "tag string, kind string, pattern string")
    return L.apply_rules(docs(spark, d), rules).select("id", "tag")


@query("c1_fixed_chunks", "SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk, substr(text, i * 500 + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents)")
def c1_fixed_chunks(spark, d):
    return C.fixed_chars(docs(spark, d), 500)


@query("c2_sliding_chunks", "SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk, substr(text, i * 300 + 1, 400) AS content, CAST(i * 300 AS INTEGER) AS first_char, CAST(least(i * 300 + 400, length(text)) - 1 AS INTEGER) AS last_char FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 299) // 300)) AS i FROM documents)")
def c2_sliding_chunks(spark, d):
    return C.sliding_chars(docs(spark, d), 400, 100)


@query("c2_sliding_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk, array_to_string(l[i * 3 + 1 : i * 3 + 4], chr(10)) AS content, CAST(i * 3 + 1 AS INTEGER) AS first_line, CAST(least(i * 3 + 4, len(l)) AS INTEGER) AS last_line FROM (SELECT doc_id, l, unnest(range(0, (len(l) + 2) // 3)) AS i FROM l)")
def c2_sliding_lines(spark, d):
    return C.sliding_lines(docs(spark, d), 4, 1)


@query("c4_sentence_groups", r"""WITH s AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM documents)
SELECT id, CAST(i AS INTEGER) AS chunk, array_to_string(s[i * 4 + 1 : i * 4 + 4], ' ') AS content FROM (SELECT id, s, unnest(range(0, (len(s) + 3) // 4)) AS i FROM s)""")
def c4_sentence_groups(spark, d):
    return C.grouped(docs(spark, d).select("id", X.sentences("text").alias("parts")), 4, " ")


@query("c5_word_chunks", r"WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '(\S+)', 1) AS w FROM documents) SELECT id, CAST(i AS INTEGER) AS chunk, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS content FROM (SELECT id, w, unnest(range(0, (len(w) + 79) // 80)) AS i FROM w)")
def c5_word_chunks(spark, d):
    return C.sliding_words(docs(spark, d), 100, 20)


@query("c3_variable_chunks", "WITH k AS (SELECT doc_id AS id, text, unnest(range(0, ((length(text) - 1) // 1400 + 1) * 3)) AS k FROM documents WHERE text <> ''), a AS (SELECT id, text, k, (k // 3) * 1400 + [0, 200, 600][k % 3 + 1] AS a, [200, 400, 800][k % 3 + 1] AS s FROM k) SELECT id, CAST(k AS INTEGER) AS chunk, substr(text, a + 1, s) AS content FROM a WHERE a < length(text)")
def c3_variable_chunks(spark, d):
    return C.variable_chars(docs(spark, d), [200, 400, 800])


@query("o11_key_sentences", r"""WITH s AS (SELECT doc_id AS id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM documents),
p AS (SELECT id, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS sentence FROM s),
k AS (SELECT id, pos, sentence, round(2 * (CASE WHEN contains(lower(sentence), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(sentence), 'the') THEN 1 ELSE 0 END) + least(length(sentence) / 200, 1), 6) AS score FROM p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM k) SELECT id, sentence, score, rank FROM r WHERE rank <= 3""")
def o11_key_sentences(spark, d):
    return L.key_sentences(docs(spark, d), ["license", "the"], 3)


@query("f30_claims", r"""WITH s AS (SELECT doc_id AS id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')) AS s FROM documents)
SELECT id, count(*) AS sentences, count(*) FILTER (regexp_matches(lower(s), '(^|[^a-z0-9_])(is|are|was|were)($|[^a-z0-9_])')) AS claims, count(*) FILTER (regexp_matches(lower(s), '(^|[^a-z0-9_])(not|no|never|none)($|[^a-z0-9_])')) AS negations, count(*) FILTER (ends_with(s, '?')) AS questions FROM s GROUP BY 1""")
def f30_claims(spark, d):
    return L.sentence_flags(docs(spark, d))
