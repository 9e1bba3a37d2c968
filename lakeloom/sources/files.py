"""Sources: file scans, whole texts, line ranges, tables of text, JSON shapes, dictionaries; and the vector-store sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lines


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over a path; ``*`` also crosses folders, ``?`` and ``[...]`` as usual."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out += ".*"
            if pattern[i : i + 1] == "/":
                i += 1
                out += "/?"
            continue
        if c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]"
            i = end
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def include_globs(extensions: list[str] | None = None, globs: list[str] | None = None) -> list[str]:
    """Extensions as globs, with those given, lower-cased, sorted and once each."""
    found = {"**/*." + e.lower().lstrip(".") for e in extensions or ()} | set(globs or ())
    return sorted(found)


def scan_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """``path, rel, mtime, size, content binary`` of the files under a folder, in path order when limited.

    Globs apply to the path under the root. The content is not read unless it is asked for.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^[a-z]+:/*" + re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
    df = df.select("path", rel.alias("rel"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    if include:
        df = df.where(_any(F.col("rel"), include))
    if exclude:
        df = df.where(~_any(F.col("rel"), exclude))
    return df if max_files is None else df.orderBy("path").limit(max_files)


def _any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def whole_texts(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, text`` and ``path, error``: files over the limit are errors, not cut; bytes that are no UTF-8 are replaced."""
    over = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    errors = files.where(over).select("path", F.concat(F.lit("over the limit: "), F.col("size"), F.lit(" bytes")).alias("error"))
    return files.where(~over).select("path", F.expr("try_validate_utf8(cast(content as string))").alias("strict"), F.expr("make_valid_utf8(cast(content as string))").alias("text")).drop("strict"), errors


def head_bytes(files: DataFrame, limit: int) -> DataFrame:
    """``path, text``: the first bytes of each file, without what is no whole character."""
    return files.select("path", F.regexp_replace(F.expr(f"make_valid_utf8(cast(substring(content, 1, {int(limit)}) as string))"), "�+$", "").alias("text"))


def line_range(texts: DataFrame, offset: int, limit: int, max_bytes: int | None = None) -> DataFrame:
    """``path, line, content``: lines behind ``offset``, ``limit`` at most, and no more bytes than allowed."""
    rows = texts.select("path", F.posexplode(lines("text")).alias("pos", "content")).where((F.col("pos") >= offset) & (F.col("pos") < offset + limit))
    if max_bytes is not None:
        rows = rows.withColumn("_sum", F.sum(F.octet_length("content") + 1).over(Window.partitionBy("path").orderBy("pos"))).where(F.col("_sum") <= max_bytes).drop("_sum")
    return rows.select("path", (F.col("pos") + 1).alias("line"), "content")


def read_table(spark: SparkSession, path: str, kind: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A CSV, TSV, JSON or JSONL file as strings (CSV, TSV) or as inferred (JSON); the kind from the extension, else from the content."""
    kind = kind or sniff(spark, path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep=delimiter or ("\t" if kind == "tsv" else ","), inferSchema=False, multiLine=False)
    if kind == "jsonl":
        return spark.read.json(path)
    return json_rows(spark.read.json(path, multiLine=True))


def sniff(spark: SparkSession, path: str) -> str:
    """csv, tsv, json or jsonl. Two lines that are JSON objects of their own mean jsonl."""
    for end in ("csv", "tsv", "jsonl", "json"):
        if path.lower().endswith("." + end):
            if end != "json":
                return end
    head = [r.value.strip() for r in spark.read.text(path).limit(20).collect() if r.value.strip()]
    first = head[0] if head else ""
    if len(head) > 1 and all(x.startswith("{") and x.endswith("}") for x in head[:2]):
        return "jsonl"
    if first.startswith(("{", "[")):
        return "json"
    return "tsv" if "\t" in first else "csv"


def json_rows(df: DataFrame) -> DataFrame:
    """Rows of common JSON shapes: a list of rows, ``rows`` or ``data`` around them, or one list for each column, padded with nulls."""
    for name in ("rows", "data"):
        if df.columns == [name] and isinstance(df.schema[name].dataType, T.ArrayType):
            kind = df.schema[name].dataType.elementType
            return df.select(F.inline(name)) if isinstance(kind, T.StructType) else df.select(F.explode(name).alias("value"))
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        return df.select(F.inline(F.arrays_zip(*df.columns)))
    return df


#: What a row of a store catalog may hold.
CATALOG = "path string, store_type string, label string, min_score double, max_results int"


def load_catalog(spark: SparkSession, path: str, kind: str | None = None, store_types: tuple[str, ...] = ("sqlite", "faiss")) -> tuple[DataFrame, DataFrame]:
    """Store descriptions of a catalog file (jsonl, json, csv or tsv) and its bad rows.

    Bad are rows that cannot be parsed, that have no path or an unknown store type; they come with ``error``.
    A missing label is the path.
    """
    kind = kind or sniff(spark, path)
    schema = T.StructType.fromDDL(f"{CATALOG}, _corrupt string")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if kind in ("csv", "tsv"):
        rows = reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        rows = reader.json(path, multiLine=kind == "json")
    error = (
        F.when(F.col("_corrupt").isNotNull(), "not readable")
        .when(F.coalesce(F.trim("path"), F.lit("")) == "", "no path")
        .when(~F.coalesce(F.lower("store_type").isin(*store_types), F.lit(False)), "unknown store type")
    )
    rows = rows.withColumn("error", error)
    good = rows.where("error is null").select("path", F.lower("store_type").alias("store_type"), F.coalesce("label", "path").alias("label"), "min_score", "max_results")
    return good, rows.where("error is not null").select("path", "error")


def catalog_with(inline: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stores given inline and those of a catalog, one list; columns that one side lacks are null."""
    return inline.unionByName(catalog, allowMissingColumns=True)


def chunk_table(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the candidate tables or views that the session knows."""
    return next((name for name in candidates if spark.catalog.tableExists(name)), None)


def replace_folder(df: DataFrame, path: str) -> None:
    """Write a table beside its place, then swap it in by renames, so a reader sees the old or the new one.

    A first write has nothing to swap out. What a failed swap leaves is the old table under ``<path>.old``.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, staged, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old"))
    fs = to.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(staged, to):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(old, True)


def labelled_output(texts: DataFrame, kind: str, label: str) -> DataFrame:
    """``kind, label, line, content``: lines of tool output (``text``) with what made them."""
    if kind not in ("compiler", "interpreter", "transpiled"):
        raise ValueError(f"unknown kind of output: {kind}")
    return texts.select(*[c for c in texts.columns if c != "text"], F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.posexplode(lines("text")).alias("pos", "content")).withColumn("line", F.col("pos") + 1).drop("pos")


def math_blocks(docs: DataFrame) -> DataFrame:
    """``id, start, end, kind, content``: LaTeX formulas of a text, by an Arrow-batched scanner.

    Comments (from an unescaped ``%`` to the end of the line) are blanked first. Environments, brackets and
    dollar spans are taken by start, then end; one that overlaps an earlier accepted one is dropped.
    """

    def run(batches):
        import pandas as pd

        names = "equation|align|gather|multline|eqnarray|displaymath|math"
        kinds = [
            ("environment", re.compile(rf"\\begin\{{(({names})\*?)\}}(.*?)\\end\{{\1\}}", re.S)),
            ("bracket", re.compile(r"\\\[(.*?)\\\]", re.S)),
            ("bracket", re.compile(r"\\\((.*?)\\\)", re.S)),
            ("dollars", re.compile(r"(?<!\\)\$\$(.+?)(?<!\\)\$\$", re.S)),
            ("dollar", re.compile(r"(?<![\\$])\$(?!\$)((?:\\.|[^$\\])+?)\$(?!\$)", re.S)),
        ]
        comment = re.compile(r"(?<!\\)%[^\n]*")
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                plain = comment.sub(lambda m: " " * len(m[0]), text or "")
                at = 0
                for start, end, kind in sorted((m.start(), m.end(), k) for k, p in kinds for m in p.finditer(plain)):
                    if start >= at:
                        out.append((i, start, end, kind, plain[start:end]))
                        at = end
            yield pd.DataFrame(out, columns=["id", "start", "end", "kind", "content"])

    return docs.select("id", "text").mapInPandas(run, f"id {dict(docs.dtypes)['id']}, start int, end int, kind string, content string")


def dictionary_entries(rows: DataFrame) -> DataFrame:
    """``word, definition`` from rows with any of the usual column names."""
    pick = lambda names: F.coalesce(*(F.col(c).cast("string") for c in names if c in rows.columns), F.lit(None).cast("string"))
    return rows.select(F.lower(F.trim(pick(("word", "term", "entry")))).alias("word"), pick(("definition", "meaning", "def")).alias("definition")).where("word is not null and word <> ''")


def dictionary_lines(texts: DataFrame) -> DataFrame:
    """``word, definition`` from lines: split at the first colon or dash; ``#`` begins a comment; a bare line is a word."""
    rows = texts.select(F.explode(lines("text")).alias("l")).select(F.trim("l").alias("l")).where("l <> '' and l not like '#%'")
    word = F.regexp_extract("l", r"^(.*?)\s*(?::|\s-\s|-)\s*(.*)$", 1)
    split = F.col("l").rlike(r":|-")
    return rows.select(F.lower(F.when(split, word).otherwise(F.col("l"))).alias("word"), F.when(split, F.regexp_extract("l", r"^(.*?)\s*(?::|\s-\s|-)\s*(.*)$", 2)).alias("definition"))


def write_store(chunks: DataFrame, path: str, label: str = "store_label", rows_per_file: int = 1_000_000) -> None:
    """Append chunks to a vector store, a folder of Parquet files by label."""
    chunks.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(label).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, chunks, dim``: the store's files, from their rows."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("chunks"), F.max(F.size("embedding")).alias("dim"))
