"""Queries of chunkers, segmenters, code structure and actions, with the SQL that checks them."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import actions as A
from ..operators import braces as B
from ..operators import chunking as C
from ..operators import code as K
from ..operators import rules as R
from ..operators import segments as S
from ..streaming import windows as W
from . import generated as N
from .base import query, table
from .relations import SENTENCES
from .streams import finished, shared, stream


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def turns(spark, d):
    return table(spark, d, "conversations")


LINES = "string_split(coalesce(text, ''), chr(10))"


@query("c6_unit_chunks", "WITH w AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '(\\S+)', 1) AS w FROM documents), n AS (SELECT *, (len(w) - 1) // 40 + 1 AS n FROM w WHERE len(w) > 0), c AS (SELECT id, w, n > 5 AS truncated, unnest(range(0, least(n, 5))) AS chunk FROM n), t AS (SELECT id, chunk, truncated, len(w) AS n, list_aggregate(w[chunk * 40 + 1:chunk * 40 + 50], 'string_agg', ' ') AS content FROM c)\nSELECT id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 40 AS INTEGER) AS first, CAST(least(chunk * 40 + 50, n) - 1 AS INTEGER) AS last, CASE WHEN strlen(content) <= 400 THEN content END AS content, truncated, CASE WHEN strlen(content) > 400 THEN 'over 400 bytes' END AS error FROM t")
def c6_unit_chunks(spark, d):
    """Windows of fifty words, five at most, with errors for those of too many bytes."""
    return S.unit_chunks(documents(spark, d), "words", 50, 10, 5, 400)


@query("c7_guarded_lines", f"WITH l AS (SELECT doc_id AS id, {LINES} AS l FROM documents WHERE text <> ''), c AS (SELECT id, l, unnest(range(0, (len(l) - 1) // 4 + 1)) AS chunk FROM l), t AS (SELECT id, chunk, list_aggregate(l[chunk * 4 + 1:chunk * 4 + 4], 'string_agg', chr(10)) AS content FROM c) SELECT id, CAST(chunk AS INTEGER) AS chunk, CASE WHEN strlen(content) <= 500 THEN content END AS content, CASE WHEN strlen(content) > 500 THEN 'over 500 bytes' END AS error FROM t")
def c7_guarded_lines(spark, d):
    """Chunks of four lines; too large ones are errors."""
    return S.unit_chunks(documents(spark, d), "lines", 4, max_bytes=500).select("id", "chunk", "content", "error")


@query("c8_headings", f"WITH l AS {N.HEADED.sql()}, n AS (SELECT id, count(*) AS n, count(depth) AS h FROM l GROUP BY 1) SELECT id, line, depth, name AS title, CAST(round(100 * h / n, 4) AS DOUBLE) AS per_100_lines FROM l JOIN n USING (id) WHERE depth IS NOT NULL")
def c8_headings(spark, d):
    """Headings by sign, underline and number, outside of fenced code."""
    return S.section_headings(N.HEADED.sources(spark, d))


@query("c9_code_chunks", f"SELECT id, block AS chunk, string_agg(t, chr(10) ORDER BY line) AS content FROM {N.CODE.sql()} GROUP BY 1, 2")
def c9_code_chunks(spark, d):
    """Chunks of three lines of code that end where nothing is open."""
    return C.code_chunks(N.CODE.sources(spark, d), 3)


@query("c10_file_chunks", f"SELECT '/src/' || id || '.py' AS path, block AS chunk, CAST(min(line) AS BIGINT) AS first_line, CAST(count(*) AS INTEGER) AS lines FROM {N.CODE.sql()} GROUP BY id, block")
def c10_file_chunks(spark, d):
    """Chunks of many files with their lines."""
    files = N.CODE.sources(spark, d).select(F.concat(F.lit("/src/"), "id", F.lit(".py")).alias("path"), "text")
    return K.file_chunks(files, 3).select("path", "chunk", "first_line", "lines")


@query("c11_class_chunks", f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY min(line)) AS INTEGER) AS chunk, max(name) FILTER (kind = 'class') AS name, min(line) AS first_line, max(line) AS last_line FROM {N.PYTHON.sql()} WHERE block <= 3 GROUP BY id, block")
def c11_class_chunks(spark, d):
    return K.symbol_chunks(N.PYTHON.sources(spark, d), "class", nested=False).drop("content")


@query("c12_function_chunks", f"SELECT id, 1 AS chunk, max(name) AS name, min(line) AS first_line, max(line) AS last_line, string_agg(t, chr(10) ORDER BY line) AS content FROM {N.PYTHON.sql()} WHERE block = 4 GROUP BY id")
def c12_function_chunks(spark, d):
    return K.symbol_chunks(N.PYTHON.sources(spark, d), "function", nested=False)


@query("c12_brace_chunks", f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY block) AS INTEGER) AS chunk, max(name) AS name, min(line) AS first_line, max(line) AS last_line FROM {N.BRACES.sql()} WHERE block IS NOT NULL GROUP BY id, block")
def c12_brace_chunks(spark, d):
    """Classes of a language with braces, in closing order."""
    return K.brace_chunks(N.BRACES.sources(spark, d), ("class",))


@query("c13_inheritance", f"SELECT * FROM (SELECT p_partkey AS id, unnest([{N.BASE}, 'Last_' || p_size, CASE WHEN {N.CHILD} THEN 'Child_' || p_size END]) AS name, unnest([{N.BASE}, CASE WHEN {N.CHILD} THEN {N.BASE} ELSE 'Last_' || p_size END, {N.BASE}]) AS group_name, unnest([1, CASE WHEN {N.CHILD} THEN 3 ELSE 1 END, 2]) AS depth FROM part) WHERE name IS NOT NULL")
def c13_inheritance(spark, d):
    """Classes that are tied by inheritance."""
    return K.inheritance_groups(K.class_bases(N.PYTHON.sources(spark, d)))


@query("c14_structures", f"WITH l AS {N.CODE.sql()}, c AS (SELECT l.*, {N.EVEN} AS code FROM l JOIN part ON p_partkey = id) SELECT id, CASE WHEN code THEN 'code' ELSE 'text' END AS kind, CASE WHEN code THEN block ELSE 0 END AS chunk, length(string_agg(t, chr(10) ORDER BY line)) AS chars FROM c GROUP BY 1, 2, 3 UNION ALL SELECT -doc_id - 1, 'text', 0, length(trim(regexp_replace(text, '[\\n]', ' ', 'g'), ' ')) FROM documents WHERE trim(regexp_replace(text, '[\\n]', ' ', 'g'), ' ') <> '' AND NOT regexp_matches(text, '[=;{{}}(]')")
def c14_structures(spark, d):
    """Code (half of the lines look like it) in chunks of lines, other texts in groups of paragraphs."""
    plain = F.regexp_replace("text", r"\n", " ")
    docs = documents(spark, d).where(~F.col("text").rlike("[=;{}(]")).select((-F.col("id") - 1).alias("id"), plain.alias("text"))
    return K.structures(N.CODE.sources(spark, d).unionByName(docs), 3, 5).select("id", "kind", "chunk", F.length("content").cast("long").alias("chars"))


def talks(spark, d):
    """Each conversation as one text, a line a turn."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s:]+", " ")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.trim(flat)).alias("l"))))
    return turns(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("text"))


FLAT = r"trim(regexp_replace(coalesce(text, ''), '[\s:]+', ' ', 'g'), ' ')"


@query("c16_dialogue", f"WITH t AS (SELECT conv_id AS id, turn, role, {FLAT} AS c FROM conversations) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn) AS INTEGER) AS segment, role AS speaker, c AS content FROM t WHERE length(c) >= 100")
def c16_dialogue(spark, d):
    """Segments of dialogue of at least a hundred characters."""
    return S.dialogue(talks(spark, d), 100)


@query("c17_sentence_spans", r"WITH p AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(text, '([^.!?]*[.!?]+\s*|[^.!?]+$)', 1)) AS p, generate_subscripts(regexp_extract_all(text, '([^.!?]*[.!?]+\s*|[^.!?]+$)', 1), 1) AS k FROM conversations), e AS (SELECT *, sum(length(p)) OVER (PARTITION BY id ORDER BY k) AS e FROM p) SELECT id, CAST(k AS INTEGER) AS sentence, CAST(e - length(p) AS BIGINT) AS start, CAST(e AS BIGINT) AS end, regexp_replace(p, '^\s+|\s+$', '', 'g') AS content FROM e WHERE trim(p, ' ') <> ''")
def c17_sentence_spans(spark, d):
    """Sentences of turns with their offsets."""
    return S.sentence_spans(turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"))


@query("c18_word_windows", r"WITH w AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(text, '(\S+)', 1) AS w FROM conversations), c AS (SELECT id, w, unnest(range(0, (len(w) - 1) // 6 + 1)) AS chunk FROM w WHERE len(w) > 0) SELECT id, CAST(chunk AS INTEGER) AS chunk, list_aggregate(w[chunk * 6 + 1:chunk * 6 + 8], 'string_agg', ' ') AS content FROM c")
def c18_word_windows(spark, d):
    """Windows of eight spoken words, two of them shared."""
    return C.sliding_words(turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), 8, 2)


@query("c19_vocal_units", r"WITH p AS (SELECT conv_id * 100 + turn AS id, unnest(string_split_regex(text, '[.,;:!?]+')) AS p, generate_subscripts(string_split_regex(text, '[.,;:!?]+'), 1) AS k FROM conversations), w AS (SELECT id, k, regexp_extract_all(p, '(\S+)', 1) AS w FROM p), c AS (SELECT id, k, w, unnest(range(0, (len(w) - 1) // 5 + 1)) AS j FROM w WHERE len(w) > 0), u AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, j) AS unit, w[j * 5 + 1:j * 5 + 5] AS w FROM c) SELECT id, CAST(unit AS INTEGER) AS unit, list_aggregate(w, 'string_agg', ' ') AS content, round(len(w) / 2.5, 4) AS seconds FROM u")
def c19_vocal_units(spark, d):
    """Pieces of speech between punctuation, five words at most, with their duration."""
    return S.vocal_units(turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), 5, 2.5)


def stamped(spark, d, mark):
    """Each conversation as one text with a mark before every turn."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\[\]]+", " "))
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, flat).alias("l"))))
    return turns(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("text"))


BARE = r"trim(regexp_replace(coalesce(text, ''), '[\s\[\]]+', ' ', 'g'), ' ')"


@query("c20_timestamped", f"WITH t AS (SELECT conv_id AS id, turn, {BARE} AS c FROM conversations), g AS (SELECT *, turn // 2 AS g FROM t) SELECT id, CAST(g + 1 AS BIGINT) AS segment, CAST(g * 60 + 5 AS BIGINT) AS seconds, string_agg(c, ' ' ORDER BY turn) AS content FROM g GROUP BY id, g")
def c20_timestamped(spark, d):
    """Segments of text with a time stamp on every other line."""
    stamp = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[00:"), F.lpad(F.floor(F.col("turn") / 2).cast("string"), 2, "0"), F.lit(":05] "))).otherwise("")
    return S.timestamped(stamped(spark, d, stamp))


@query("c21_intervals", f"WITH t AS (SELECT conv_id AS id, turn, {BARE} AS c, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn) AS INTEGER) AS interval, CAST(turn * 60 AS BIGINT) AS start, CAST(CASE WHEN turn % 3 = 0 THEN turn * 60 + 30 ELSE nx * 60 END AS BIGINT) AS end, c AS content FROM t")
def c21_intervals(spark, d):
    """Intervals of lines with one mark or two."""
    minute = F.lpad(F.col("turn").cast("string"), 2, "0")
    mark = F.when(F.col("turn") % 3 == 0, F.concat(minute, F.lit(":00 - "), minute, F.lit(":30 "))).otherwise(F.concat(minute, F.lit(":00 ")))
    return S.intervals(stamped(spark, d, mark))


@query("c23_line_groups", f"WITH l AS (SELECT doc_id AS id, {LINES} AS l FROM documents), c AS (SELECT id, l, unnest(range(0, (len(l) - 1) // 3 + 1)) AS chunk FROM l) SELECT id, CAST(chunk AS INTEGER) AS chunk, list_aggregate(l[chunk * 3 + 1:chunk * 3 + 3], 'string_agg', chr(10)) AS content FROM c")
def c23_line_groups(spark, d):
    """Groups of three lines."""
    return C.grouped(documents(spark, d).select("id", X.lines("text").alias("parts")), 3, "\n")


@query("c24_summary_levels", """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, substr(text, 1, 60) AS content FROM conversations),
r AS (SELECT conv_id, 0 AS level, place, content FROM t UNION ALL SELECT conv_id, any_value(level) + 1, place // 3, substr(string_agg(content, ' ' ORDER BY place), 1, 60) FROM (SELECT *, max(place) OVER (PARTITION BY conv_id) AS m FROM r) WHERE m > 0 GROUP BY conv_id, place // 3)
SELECT conv_id, CAST(level AS INTEGER) AS level, CAST(place AS INTEGER) AS place, content FROM r""")
def c24_summary_levels(spark, d):
    """Turns joined by three, again and again, each cut to sixty characters."""
    return S.group_levels(turns(spark, d).select("conv_id", "turn", F.col("text").alias("content")), ["conv_id"], "turn", 3, 60)


@query("g5_imports", f"SELECT id, line, name AS module FROM {N.PYTHON.sql()} WHERE kind = 'import'")
def g5_imports(spark, d):
    return R.import_references(N.PYTHON.sources(spark, d))


@query("g6_outline", f"SELECT '/src/' || (id % 3) AS folder, count(DISTINCT id) AS files, count(*) AS lines, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'import') AS imports FROM {N.PYTHON.sql()} GROUP BY 1")
def g6_outline(spark, d):
    """Sizes and symbols of sources by folder."""
    files = N.PYTHON.sources(spark, d).withColumn("path", F.concat(F.lit("/src/"), F.col("id") % 3, F.lit("/"), "id", F.lit(".py")))
    return K.outline(files)


@query("g7_loops", f"SELECT id, line, kind, CASE kind WHEN 'for' THEN ['n', 'range', 'step_' || p_size, 'total'] ELSE ['n', 'shift', 'total'] END AS names FROM {N.PYTHON.sql()} JOIN part ON p_partkey = id WHERE kind IN ('for', 'while')")
def g7_loops(spark, d):
    """Names that loops read."""
    return K.loop_data(N.PYTHON.sources(spark, d))


@query("g8_variables", N.variable_rows(N.VARIABLES, N.PYTHON))
def g8_variables(spark, d):
    """Variables with their scopes."""
    return K.variables(N.PYTHON.sources(spark, d))


@query("g7_brace_loops", f"SELECT id, line, kind, string_split(name, ',') AS names FROM {N.BRACED.sql()} WHERE kind IS NOT NULL")
def g7_brace_loops(spark, d):
    """Names that loops of four other languages read."""
    return B.brace_loops(N.BRACED.sources(spark, d))


@query("g8_brace_variables", N.variable_rows(N.BRACED_VARIABLES, N.BRACED))
def g8_brace_variables(spark, d):
    """Variables of four other languages with their scopes."""
    return B.brace_variables(N.BRACED.sources(spark, d))


@query("g9_code_lines", "SELECT p_partkey AS id, unnest([" + ", ".join(t for t, _ in N.PAGE) + "]) AS line, unnest([" + ", ".join(c for _, c in N.PAGE) + "]) AS code FROM part")
def g9_code_lines(spark, d):
    """Which lines of a page look like code."""
    said = F.array(*(F.expr(t) for t, _ in N.PAGE))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(said).alias("line")).withColumn("code", K.is_code_line(F.col("line")))


SYMBOLS = "'class ' || replace(p_brand, '#', '') || ': def run_' || p_size || '(x): my_name_' || p_partkey || ' = ' || CASE WHEN p_partkey % 2 = 0 THEN 'camelCase' ELSE 'plain' END || ' + my_name_' || p_partkey"


@query("g10_symbols", "SELECT p_partkey AS id, list_concat([replace(p_brand, '#', ''), 'run_' || p_size, 'my_name_' || p_partkey], CASE WHEN p_partkey % 2 = 0 THEN ['camelCase'] ELSE [] END) AS symbols FROM part")
def g10_symbols(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), K.symbols(F.expr(SYMBOLS)).alias("symbols"))


EVENT = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}


@query("p21_schema_errors", "WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ['$: not JSON'] WHEN event_id % 5 = 1 THEN ['$.k: missing', '$.x: not allowed'] WHEN k < 10 THEN ['$.k: under 10'] WHEN k > 60 THEN ['$.k: over 60'] ELSE [] END AS errors FROM e")
def p21_schema_errors(spark, d):
    """What is wrong with JSON texts against a schema."""
    said = F.when(F.col("event_id") % 5 == 0, "{k").when(F.col("event_id") % 5 == 1, '{"x": 1}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", A.json_errors(said, EVENT).alias("errors"))


SPEC = {"name": "top_parts", "description": "dearest parts", "parameters": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}}}, "sql": "SELECT p_partkey, p_retailprice FROM u_parts ORDER BY p_retailprice DESC, p_partkey LIMIT :n"}


def registry(spark, d):
    """Actions from specifications, one of which is no JSON, one lacks its SQL, and one takes a name twice."""
    table(spark, d, "part").createOrReplaceTempView("u_parts")
    texts = [("a", json.dumps(SPEC)), ("b", "{"), ("c", json.dumps({k: v for k, v in SPEC.items() if k != "sql"})), ("d", json.dumps(SPEC))]
    actions = A.Actions()
    bad = A.load_specs(spark.createDataFrame(texts, "path string, text string"), actions)
    actions.register("count_rows", lambda spark, name: table(spark, d, name).agg(F.count("*").alias("n")), {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}}}, "rows of a table")
    actions.alias("best_parts", "top_parts", n=3)
    return actions, bad


def nation_actions(spark, d):
    """Actions from a specification for each nation: some are no JSON, some lack their SQL, some take a name twice."""
    n = table(spark, d, "nation")
    name = F.concat(F.lit("top_"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    head = F.concat(F.lit('{"name": "'), name, F.lit('", "description": "dearest of '), F.col("n_name"), F.lit('", "parameters": ' + json.dumps(SPEC["parameters"])))
    good, k = F.concat(head, F.lit(f', "sql": "{SPEC["sql"]}"}}')), F.col("n_nationkey")
    first = n.select(F.col("n_name").alias("path"), F.when(k % 4 == 0, "{").when(k % 4 == 1, F.concat(head, F.lit("}"))).otherwise(good).alias("text"))
    actions = A.Actions()
    return actions, A.load_specs(first.unionAll(n.where(k % 5 == 0).select(F.concat("n_name", F.lit("2")), good)), actions)


TOP = "'top_' || lower(replace(n_name, ' ', '_'))"


@query("u1_tools", f"SELECT {TOP} AS name, 'dearest of ' || n_name AS description, ['n'] AS parameters FROM nation WHERE n_nationkey % 4 IN (2, 3) OR n_nationkey % 5 = 0")
def u1_tools(spark, d):
    """All table functions that are registered."""
    return nation_actions(spark, d)[0].listing(spark)


@query("u2_action_specs", f"SELECT n_name AS path, CASE n_nationkey % 4 WHEN 0 THEN 'not JSON' ELSE '$.sql: missing' END AS error FROM nation WHERE n_nationkey % 4 IN (0, 1) UNION ALL SELECT n_name || '2', 'taken: ' || {TOP} FROM nation WHERE n_nationkey % 4 IN (2, 3) AND n_nationkey % 5 = 0")
def u2_action_specs(spark, d):
    """Specifications of actions that cannot be registered."""
    return spark.createDataFrame(nation_actions(spark, d)[1], "path string, error string")


@query("u3_run_action", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
def u3_run_action(spark, d):
    """An action, run by name with checked arguments."""
    return registry(spark, d)[0].run("top_parts", spark, n=7)


@query("u6_alias", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3")
def u6_alias(spark, d):
    """An action under another name with its argument fixed."""
    return registry(spark, d)[0].run("best_parts", spark)


RULES = ("CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'T' || p_partkey END AS tag", "CASE p_size % 5 WHEN 0 THEN 'like' WHEN 1 THEN 'regex' WHEN 2 THEN 'contains' WHEN 3 THEN 'prefix' ELSE 'suffix' END AS kind", "CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN '(' || p_brand ELSE p_brand || '+' END AS pattern")


@query("u5_rule_errors", f"SELECT * FROM (SELECT tag, CASE WHEN tag = '' THEN 'no tag' WHEN trim(pattern) = '' THEN 'no pattern' WHEN kind = 'like' THEN 'unknown kind' WHEN kind = 'regex' AND left(pattern, 1) = '(' THEN 'not a regular expression' END AS error FROM (SELECT {', '.join(RULES)} FROM part)) WHERE error IS NOT NULL")
def u5_rule_errors(spark, d):
    """Rules that cannot be applied."""
    return A.rule_errors(table(spark, d, "part").selectExpr(*RULES))


@query("e3_saved_records", "SELECT o_custkey, count(*) AS records, CAST(max(k) AS INTEGER) AS last FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1")
def e3_saved_records(spark, d):
    """Records of two calls, appended to one table."""
    to = shared(spark)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        saved = A.appended(A.numbered(rows.where(part), ["o_custkey"], "o_orderkey"), to)
    return saved.groupBy("o_custkey").agg(F.count("*").alias("records"), F.max("saved").alias("last"))


@query("e4_best_answers", "SELECT conv_id AS question, turn AS pass, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, length(text) DESC, turn) AS k FROM conversations) WHERE k = 1")
def e4_best_answers(spark, d):
    """Of several answers the one with the fewest errors, then the longest."""
    rows = turns(spark, d).select(F.col("conv_id").alias("question"), F.col("turn").alias("pass"), (F.col("turn") % 3).alias("errors"), F.col("text").alias("answer"))
    return A.best_answers(rows).select("question", "pass", F.length("answer").cast("long").alias("chars"))


@query("e5_research_sources", "WITH h AS (SELECT doc_id AS seen, source, lang AS chunk, md5(coalesce(text, '')) AS content, CASE WHEN doc_id % 3 > 0 THEN doc_id % 17 END AS score FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY source, chunk, content ORDER BY seen) AS k FROM h), t AS (SELECT * FROM o WHERE k = 1 ORDER BY seen LIMIT 60) SELECT seen, source, CAST(score AS BIGINT) AS score FROM t")
def e5_research_sources(spark, d):
    """Sources that are found, once each, sixty at most."""
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("seen"), "source", F.col("lang").alias("chunk"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 17).alias("score"))
    return A.research_sources(hits, 60).select("seen", "source", "score")


@query("e6_examples", "WITH e AS (SELECT item_id AS pos, CASE WHEN item_id % 4 > 0 THEN 'a' || item_id END AS output, item_id % 7 AS score FROM benchmark), k AS (SELECT * FROM e WHERE output IS NOT NULL) SELECT 'all' AS mode, pos FROM k UNION ALL SELECT 'first', pos FROM (SELECT pos FROM k ORDER BY pos LIMIT 5) UNION ALL SELECT 'semantic', pos FROM (SELECT pos FROM k ORDER BY score DESC, pos LIMIT 5)")
def e6_examples(spark, d):
    """Examples with an output: all, the first, the most similar."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.when(F.col("item_id") % 4 > 0, F.concat(F.lit("a"), "item_id")).alias("output"), (F.col("item_id") % 7).alias("score"))
    out = None
    for mode in ("all", "first", "semantic"):
        part = A.chosen_examples(rows, mode, 5, "score").select(F.lit(mode).alias("mode"), "pos")
        out = part if out is None else out.unionAll(part)
    return out


@query("r3_stream_chunks", "SELECT CAST(count(*) AS BIGINT) AS chunks FROM (SELECT conv_id, turn, unnest(range(0, (length(t) - 1) // 50)) AS k FROM (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z0-9]', 'x', 'g') AS t FROM conversations) WHERE length(t) > 50)")
def r3_stream_chunks(spark, d):
    """Chunks of fifty characters of texts without a boundary, as a stream; what is left waits."""
    rows = stream(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.regexp_replace("text", "[^A-Za-z0-9]", "x").alias("t"))
    return finished(W.text_chunks(rows, "key", "t", 50), "append").agg(F.count("*").alias("chunks"))
