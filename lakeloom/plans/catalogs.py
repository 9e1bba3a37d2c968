"""Queries of file sources, catalogs, stores and sinks, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexicon as L
from ..operators import profile as P
from ..operators import search as V
from ..operators import stores as S
from ..sources import files as Z
from . import generated as N
from .base import query, table
from .streams import shared

FLAT = r"regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g')"


def text_folder(spark, d):
    """Turns of conversations as text files, a folder a role, a line a turn."""
    to = shared(spark)
    table(spark, d, "conversations").select("role", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").alias("value")).write.partitionBy("role").text(to)
    return to


def as_files(spark, d):
    """Documents as a listing of files with their bytes."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.concat(F.lit("/"), "doc_id").alias("path"), F.octet_length(text).alias("size"), F.encode(text, "UTF-8").alias("content"))


@query("s1_scan_files", f"SELECT role, CAST(sum(strlen({FLAT}) + 1) AS BIGINT) AS bytes FROM conversations WHERE role <> 'system' GROUP BY 1")
def s1_scan_files(spark, d):
    """Sizes of the text files under a folder and all its folders, without those that a glob excludes."""
    found = Z.scan_files(spark, text_folder(spark, d), Z.include_globs(["txt"]), ["**/role=system/**"])
    return found.select(F.regexp_extract("rel", "role=([a-z]+)/", 1).alias("role"), "size").groupBy("role").agg(F.sum("size").alias("bytes"))


@query("s2_globs", r"SELECT page_id, regexp_matches(url, '1$') AS one, regexp_matches(url, '[0-4].$') AS low, regexp_matches(url, '^https://[^/]*/.*s') AS deep FROM pages")
def s2_globs(spark, d):
    """Shell patterns over the addresses of pages."""
    hit = lambda g: F.col("url").rlike(Z.glob_regex(g))
    return table(spark, d, "pages").select("page_id", hit("*1").alias("one"), hit("*[0-4]?").alias("low"), (F.col("url").rlike("^https://[^/]*/.*s") & hit("https:**")).alias("deep"))


HEAD = "WITH c AS (SELECT doc_id, k, substr(text, k, 1) AS c FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(1, 101)) AS k FROM documents) WHERE k <= length(text)), b AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM c)"


@query("s3_head_bytes", HEAD + " SELECT '/' || d.doc_id AS path, coalesce(string_agg(c, '' ORDER BY k), '') AS text FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND n <= 100 GROUP BY d.doc_id")
def s3_head_bytes(spark, d):
    """The first 100 bytes of every file, less a character that the limit cuts."""
    return Z.head_bytes(as_files(spark, d), 100)


@query("s4_whole_texts", "SELECT '/' || doc_id AS path, CASE WHEN strlen(coalesce(text, '')) <= 4000 THEN length(coalesce(text, '')) END AS chars, CASE WHEN strlen(coalesce(text, '')) > 4000 THEN 'over the limit: ' || strlen(text) || ' bytes' END AS error FROM documents")
def s4_whole_texts(spark, d):
    """Whole texts of the files within a limit; the others are errors, not cut."""
    texts, errors = Z.whole_texts(as_files(spark, d), 4000)
    good = texts.select("path", F.length("text").cast("long").alias("chars"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors.select("path", F.lit(None).cast("long").alias("chars"), "error"))


@query("s6_line_range", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents), b AS (SELECT *, sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l WHERE line BETWEEN 2 AND 4) SELECT '/' || doc_id AS path, CAST(line AS INTEGER) AS line, content FROM b WHERE n <= 1000")
def s6_line_range(spark, d):
    """Lines 2 to 4 of every text, a thousand bytes of them at most."""
    texts, _ = Z.whole_texts(as_files(spark, d))
    return Z.line_range(texts, 1, 3, 1000)


@query("s7_delimited", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, 'csv' AS kind FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, 'tsv' FROM supplier")
def s7_delimited(spark, d):
    """A CSV and a TSV file, read as strings by their extension."""
    to = shared(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(f"{to}.csv", header=True)
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.csv(f"{to}.tsv", header=True, sep="\t")
    a = Z.read_table(spark, f"{to}.csv").withColumn("kind", F.lit("csv"))
    b = Z.read_table(spark, f"{to}.tsv").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("tsv").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("s9_detected_formats", "SELECT * FROM (SELECT 'csv' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'tsv', count(*) FROM nation UNION ALL SELECT 'jsonl', count(*) FROM nation)")
def s9_detected_formats(spark, d):
    """The same table in three formats without extension; the content tells which is which."""
    rows, to, out = table(spark, d, "nation").coalesce(1), shared(spark), None
    rows.write.csv(f"{to}-a", header=True)
    rows.write.csv(f"{to}-b", header=True, sep="\t")
    rows.write.json(f"{to}-c")
    for end in "abc":
        path = f"{to}-{end}"
        kind = Z.sniff(spark, path)
        part = Z.read_table(spark, path, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = part if out is None else out.unionAll(part)
    return out


STORE_ROWS = "SELECT DISTINCT label FROM embeddings"


@query("s11_store_catalog", f"WITH s AS ({STORE_ROWS}) SELECT 'store/' || label AS path, 'faiss' AS store_type, CASE WHEN label % 2 = 0 THEN 'L' || label ELSE 'store/' || label END AS label, CAST(NULL AS VARCHAR) AS error FROM s WHERE label % 3 <> 0 UNION ALL SELECT CASE WHEN label % 2 = 0 THEN 'store/' || label END, NULL, NULL, CASE WHEN label % 2 = 0 THEN 'unknown store type' ELSE 'no path' END FROM s WHERE label % 3 = 0")
def s11_store_catalog(spark, d):
    """Stores of a JSONL catalog, with the rows that name none."""
    label, to = F.col("label"), shared(spark) + ".jsonl"
    path = F.when((label % 3 != 0) | (label % 2 == 0), F.concat(F.lit("store/"), "label"))
    kind = F.when((label % 3 == 0) & (label % 2 == 0), "paper").otherwise("FAISS")
    rows = table(spark, d, "embeddings").select("label").distinct().select(path.alias("path"), kind.alias("store_type"), F.when(label % 2 == 0, F.concat(F.lit("L"), "label")).alias("label"))
    rows.write.json(to)
    good, bad = Z.load_catalog(spark, to)
    return good.select("path", "store_type", "label").unionByName(bad, allowMissingColumns=True)


@query("t3_inline_and_catalog", f"WITH s AS ({STORE_ROWS}) SELECT 'store/' || label AS path, 'faiss' AS store_type, 'store/' || label AS label FROM s UNION ALL SELECT 'own', 'faiss', 'inline'")
def t3_inline_and_catalog(spark, d):
    """One store given inline and those of a catalog in CSV."""
    to = shared(spark) + ".csv"
    table(spark, d, "embeddings").select("label").distinct().select(F.concat(F.lit("store/"), "label").alias("path"), F.lit("faiss").alias("store_type"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("min_score"), F.lit(None).cast("int").alias("max_results"), F.lit(None).cast("string").alias("_corrupt")).write.csv(to, header=True)
    good, _ = Z.load_catalog(spark, to)
    inline = spark.createDataFrame([("own", "faiss", "inline")], "path string, store_type string, label string")
    return Z.catalog_with(inline, good).select("path", "store_type", "label")


def vector_store(spark, d):
    """The embeddings as a store in a folder a label."""
    to = shared(spark)
    Z.write_store(table(spark, d, "embeddings").select(F.col("label").alias("store_label"), "vec_id", "embedding"), to)
    return to


@query("s12_store_scan", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE label = 1")
def s12_store_scan(spark, d):
    """One label of a store; the folders of the others are not read."""
    return spark.read.parquet(vector_store(spark, d)).where("store_label = 1").select("vec_id", F.size("embedding").alias("dim"))


@query("s14_store_manifest", "SELECT label, count(*) AS chunks, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings GROUP BY 1")
def s14_store_manifest(spark, d):
    """Files of a store with their rows, summed by label."""
    files = Z.manifest(spark, vector_store(spark, d))
    return files.groupBy(F.regexp_extract("file", "store_label=([0-9]+)", 1).cast("int").alias("label")).agg(F.sum("chunks").alias("chunks"), F.max("dim").alias("dim"))


@query("s15_store_appends", "SELECT label AS store_label, 2 * count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings GROUP BY 1")
def s15_store_appends(spark, d):
    """A store that the same chunks were appended to twice."""
    to = shared(spark)
    rows = table(spark, d, "embeddings").select(F.col("label").alias("store_label"), "vec_id", "embedding")
    for _ in range(2):
        Z.write_store(rows, to, rows_per_file=1000)
    return spark.read.parquet(to).groupBy("store_label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))


@query("s13_chunk_table", "SELECT 's13_chunks' AS name, count(*) AS n FROM embeddings")
def s13_chunk_table(spark, d):
    """The first table of chunks that the session has, of several names."""
    table(spark, d, "embeddings").createOrReplaceTempView("s13_chunks")
    name = Z.chunk_table(spark, ["s13_missing", "s13_chunks", "s13_never"])
    return spark.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))


@query("s20_session_segments", "SELECT conv_id, turn AS id, CASE WHEN turn <= 2 THEN upper(role) ELSE role END AS role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn > 2 AND turn % 2 = 1, turn) AS INTEGER) AS pos FROM conversations WHERE turn % 2 = 0 OR turn <= 2 OR turn > 4")
def s20_session_segments(spark, d):
    """Segments of a session: known ones keep their place, new ones follow in their order."""
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), "role")
    old = S.upsert_segments(None, rows.where("id % 2 = 0 or id <= 2"), ["conv_id"], "id")
    fresh = rows.where("id <= 2").withColumn("role", F.upper("role")).unionByName(rows.where("id > 4 and id % 2 = 1"))
    return S.upsert_segments(old, fresh, ["conv_id"], "id")


@query("s21_job_store", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END AS status, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS retries FROM orders")
def s21_job_store(spark, d):
    """A job table that is replaced as a whole: queued jobs, then some of them done."""
    to = shared(spark)
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("queued").alias("status"), F.lit(0).alias("retries"))
    Z.replace_folder(jobs, to)
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    now = spark.read.parquet(to).join(done.withColumn("_done", F.lit(True)), "id", "left")
    Z.replace_folder(now.select("id", F.when(F.col("_done"), "done").otherwise(F.col("status")).alias("status"), F.when(F.col("_done"), F.col("retries") + 1).otherwise(F.col("retries")).alias("retries")), to)
    return spark.read.parquet(to)


@query("s22_profile_sink", "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def s22_profile_sink(spark, d):
    """A profile written as JSON and read back."""
    cells = table(spark, d, "events").select("event_type", "value")
    to = shared(spark) + ".json"
    P.numeric_summary(cells, ["event_type"], quantiles=False).select("event_type", "n", F.round("mean", 4).alias("mean")).write.json(to)
    return spark.read.schema("event_type string, n long, mean double").json(to)


@query("s24_dictionaries", "SELECT lower(p_type) AS word, max(p_brand) AS definition FROM part GROUP BY 1 UNION ALL SELECT lower(n_name), 'nation ' || n_nationkey FROM nation UNION ALL SELECT lower(r_name), NULL FROM region")
def s24_dictionaries(spark, d):
    """Words and definitions of rows with other column names, of lines with a colon, and of bare lines."""
    rows = table(spark, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.max("p_brand").alias("meaning"))
    nations = table(spark, d, "nation").select(F.concat("n_name", F.lit(": nation "), "n_nationkey").alias("l"))
    regions = table(spark, d, "region").select(F.col("r_name").alias("l"))
    text = nations.unionAll(regions).unionAll(nations.sparkSession.createDataFrame([("# comment",), ("",)], "l string")).select(F.col("l").alias("text"))
    return Z.dictionary_entries(rows).unionByName(Z.dictionary_lines(text).select("word", F.nullif("definition", F.lit("")).alias("definition")))


@query("s25_definitions", "SELECT lower(r_name) AS word, 'region ' || r_regionkey AS definition FROM region UNION ALL SELECT lower(n_name), 'nation ' || n_nationkey FROM nation")
def s25_definitions(spark, d):
    """Definitions of lines with a colon or a dash between word and definition."""
    a = table(spark, d, "region").select(F.concat("r_name", F.lit(" - region "), "r_regionkey").alias("text"))
    b = table(spark, d, "nation").select(F.concat("n_name", F.lit(" : nation "), "n_nationkey").alias("text"))
    return Z.dictionary_lines(a.unionAll(b))


@query("s28_math_blocks", f"SELECT id, kind, name AS content FROM {N.FORMULAS.sql()}")
def s28_math_blocks(spark, d):
    """Formulas of LaTeX sources, one of them within a comment and one inside another."""
    return Z.math_blocks(N.FORMULAS.sources(spark, d)).select("id", "kind", "content")


@query("s29_tool_output", "SELECT doc_id, 'compiler' AS kind, 'cc' AS label, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS INTEGER) AS line, length(unnest(string_split(coalesce(text, ''), chr(10)))) AS chars FROM documents")
def s29_tool_output(spark, d):
    """Lines of output with what made them."""
    rows = Z.labelled_output(table(spark, d, "documents").select("doc_id", "text"), "compiler", "cc")
    return rows.select("doc_id", "kind", "label", "line", F.length("content").cast("long").alias("chars"))


@query("p2_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def p2_projection(spark, d):
    """Columns by include, then exclude lists; names in any case, those that are not there are ignored."""
    df = table(spark, d, "customer")
    return df.select(*P.chosen_columns(df.columns, ["c_custkey", "C_NAME", "c_mktsegment", "c_acctbal", "none"], ["C_ACCTBAL"]))


@query("p6_categories", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def p6_categories(spark, d):
    """Category filter, without case; an empty include list lets everything through."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    other = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("supplier").alias("c_mktsegment"))
    return rows.where(P.listed_only(F.col("c_mktsegment"), ["Building", " MACHINERY", "household"], ["HOUSEHOLD"])).unionAll(other.where(P.listed_only(F.col("c_mktsegment"), [], ["nobody"])))


@query("p10_speakers", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn, 'only ' || role FROM conversations WHERE role = 'user'")
def p10_speakers(spark, d):
    """Turns by speaker: all but one, and one alone."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    only = rows.where(P.listed_only(F.col("role"), ["User"], [])).withColumn("role", F.concat(F.lit("only "), "role"))
    return rows.where(P.listed_only(F.col("role"), [], [" SYSTEM "])).unionAll(only)


@query("p1_columns", "SELECT * FROM (VALUES ('customer', 5), ('supplier', 4)) v(source, columns)")
def p1_columns(spark, d):
    """How many columns each of two tables has, from its cells."""
    out = None
    for name in ("customer", "supplier"):
        df = table(spark, d, name)
        part = P.melt(df, df.columns).groupBy().agg(F.lit(name).alias("source"), F.count_distinct("column").cast("int").alias("columns"))
        out = part if out is None else out.unionAll(part)
    return out


CELLS = "CASE event_id % 7 WHEN 0 THEN repeat(' ', CAST(event_id % 3 AS INTEGER)) WHEN 1 THEN '-' || event_id || '.5' WHEN 2 THEN event_type WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'FALSE' END WHEN 4 THEN (event_id % 999 + 1) || ',234' WHEN 5 THEN event_id || 'e3' ELSE props END"


@query("p3_cell_kinds", f"SELECT event_id, {CELLS} AS v, CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 2 THEN 'text' WHEN 3 THEN 'bool' WHEN 6 THEN 'text' ELSE 'number' END AS kind FROM events")
def p3_cell_kinds(spark, d):
    """Missing, number, bool or text, for cells of each kind."""
    return table(spark, d, "events").select("event_id", F.expr(CELLS).alias("v")).withColumn("kind", P.classify(F.col("v")))


@query("p12_job_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def p12_job_page(spark, d):
    """The newest jobs of one status; the filter comes before the limit."""
    return S.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), [F.desc("o_orderdate"), "o_orderkey"], 20, F.col("o_orderstatus") == "O").drop("o_orderstatus")


@query("p13_allow_deny", "SELECT url, regexp_matches(url, '[0-9]$') AND NOT regexp_matches(url, '3[0-9]*$') AS allowed FROM pages")
def p13_allow_deny(spark, d):
    """Addresses that an allowed pattern matches and no denied one."""
    return table(spark, d, "pages").select("url", (F.col("url").rlike(Z.glob_regex("*[0-9]")) & ~F.col("url").rlike("3[0-9]*$")).alias("allowed"))


@query("p9_rule_tags", "SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT doc_id, 'the' AS tag FROM documents WHERE contains(lower(text), ' the ') UNION ALL SELECT doc_id, 'der' FROM documents WHERE starts_with(lower(text), 'd') OR contains(lower(text), ' der ')) GROUP BY 1")
def p9_rule_tags(spark, d):
    """Tags of the rules that a text meets; several rules of one tag count once."""
    rules = spark.createDataFrame([("the", "contains", " the "), ("der", "prefix", "d"), ("der", "contains", " der ")], "tag string, kind string, pattern string")
    found = L.apply_rules(table(spark, d, "documents").select("doc_id", "text"), rules)
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("p22_json_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS strict, CAST(json_extract(props, '$.k') AS BIGINT) AS lenient FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_id % 2 = 1")
def p22_json_parse(spark, d):
    """JSON as it is, and behind the words that come before its first brace."""
    said = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Result: "), "props"))
    rows = table(spark, d, "events").select("event_id", said.alias("said"))
    return rows.select("event_id", F.from_json("said", "k long")["k"].alias("strict"), F.from_json(X.lenient_json(F.col("said")), "k long")["k"].alias("lenient"))


@query("t2_union_of_stores", "SELECT 'low' AS store, vec_id, label FROM embeddings WHERE label < 3 UNION ALL SELECT 'all', vec_id, label FROM embeddings")
def t2_union_of_stores(spark, d):
    """Rows of several stores as one bag, each with its store's label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return V.union_of({"low": rows.where("label < 3"), "all": rows})


@query("t5_distinct_sources", "SELECT source, min(doc_id) AS first FROM documents GROUP BY 1")
def t5_distinct_sources(spark, d):
    """Candidates by path, the first that is seen."""
    rows = table(spark, d, "documents").select("source", "doc_id").unionByName(table(spark, d, "documents").where("lang = 'en'").select("source", "doc_id"))
    return S.first_seen(rows, ["source"], "doc_id").select("source", F.col("doc_id").alias("first"))


@query("t6_vocabulary", f"SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)) AS w FROM benchmark UNION ALL SELECT lower(r_name) FROM region)")
def t6_vocabulary(spark, d):
    """Words of two dictionaries, once each."""
    a = table(spark, d, "benchmark").select(F.explode(X.tokens("text")).alias("w"))
    return a.unionAll(table(spark, d, "region").select(F.lower("r_name").alias("w"))).distinct()


@query("a44_distinct", "SELECT DISTINCT lang, source FROM documents")
def a44_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("a2_merged_counts", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def a2_merged_counts(spark, d):
    """Counts of two runs, merged."""
    part = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return S.merged_counters(part, part, ["event_type"])


@query("r6_latest_memory", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) WHERE r <= 3")
def r6_latest_memory(spark, d):
    """A memory of the last event of each kind, the newest three for each user."""
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return S.latest_memory(rows, ["user_id"], "event_type", ["ts", "event_id"], 3).select("user_id", "event_id", "event_type")


@query("o9_top_orders", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def o9_top_orders(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("o9_orders")
    return spark.sql("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o9_orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
