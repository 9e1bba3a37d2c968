"""Token counts of documents in flat, unindexed token files by a separator scan.

A token file holds the ids of one document after the other, each id as an unsigned little-endian
integer of two or four bytes, and an end-of-document id behind every document. Nothing else is
stored: no index, no lengths, no document ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import ranges

#: Bytes of a block of a file; blocks are scanned independently of each other.
BLOCK_BYTES = 1 << 20
#: Bytes of blocks that one task scans, one after the other.
TASK_BYTES = 32 << 20
#: Documents of a token file; a task writes as many files as it needs.
FILE_ROWS = 4096


def separator_bytes(separator: int, width: int) -> bytes:
    return int(separator).to_bytes(width, "little")


def write_token_files(tokens: DataFrame, path: str, separator: int, width: int = 2, rows_per_file: int = FILE_ROWS) -> None:
    """Write the rows of a ``tokens binary`` column, ids already packed, as flat files of ``rows_per_file`` documents.

    The text sink writes the bytes as they are and the separator's bytes as the end of each row. Files are named
    ``part-<task>-...-c<file of the task>``, which with the place in the file tells a row's place in its task.
    """
    row_end = separator_bytes(separator, width).decode("iso-8859-1")
    writer = tokens.select(F.col("tokens").cast("string").alias("value")).write
    writer.option("encoding", "iso-8859-1").option("lineSep", row_end).option("compression", "none").option("maxRecordsPerFile", rows_per_file).text(path)


def row_of(file, ordinal, rows_per_file: int = FILE_ROWS) -> F.Column:
    """The row number (as ``monotonically_increasing_id`` gives it) of a document in the scan that ``write_token_files`` wrote."""
    task, k = F.regexp_extract(file, r"/part-(\d+)-", 1).cast("long"), F.regexp_extract(file, r"-c(\d+)(?:\.[a-z]+)?$", 1).cast("long")
    return F.shiftleft(task, 33) + k * rows_per_file + ordinal


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file string, block long, data binary``: flat files cut at fixed offsets, wherever documents end.

    Blocks are byte ranges, so a file of any size is the work of many tasks, which hold one block each at a time. Files
    are reached through pyarrow's file systems (local and shared folders, HDFS, S3, GCS). Empty files have no blocks.
    """
    ranges.register(spark)
    step = max(width, block_bytes - block_bytes % width)
    held = spark.read.format("lakeloom_ranges").option("block", step).option("task", TASK_BYTES).load(path)
    return held.where("size > 0").select(F.col("path").alias("file"), (F.col("offset") / step).cast("long").alias("block"), F.col("content").alias("data"))


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """One row a block: ``file, block, n_tokens, n_ends, head, tail, inner array<int>``.

    ``head`` counts the tokens before the block's first separator (all, if it has none), ``tail``
    those behind its last one, ``inner`` the tokens of the documents that lie whole in between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            rows = []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), kind)
                ends = np.flatnonzero(ids == separator)
                if len(ends):
                    rows.append((len(ids), len(ends), int(ends[0]), len(ids) - int(ends[-1]) - 1, np.diff(ends).astype(np.int32) - 1))
                else:
                    rows.append((len(ids), 0, len(ids), 0, np.zeros(0, np.int32)))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            inner = pa.array([r[4] for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, inner], names=["file", "block", "n_tokens", "n_ends", "head", "tail", "inner"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, n_tokens long, n_ends long, head long, tail long, inner array<int>")


def document_counts(scanned: DataFrame) -> DataFrame:
    """``file, ordinal long, start long, n_tokens long``: the documents of each file in their order.

    A prefix scan over the blocks' summaries stitches documents that blocks cut: it gives every
    block the tokens and separators before it and the place behind the last separator before it,
    where the document that is open at its start began. ``start`` is a document's first token in the
    file. Tokens behind a file's last separator are one more document; a document without tokens
    counts zero.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    at = scanned.select(
        "*",
        zero(F.sum("n_tokens").over(before)).alias("tokens_before"),
        zero(F.sum("n_ends").over(before)).alias("ends_before"),
        F.lead("block").over(order).isNull().alias("is_last"),
    )
    behind = F.when(F.col("n_ends") > 0, F.col("tokens_before") + F.col("n_tokens") - F.col("tail"))
    at = at.withColumn("behind", behind).withColumn("open_from", zero(F.max("behind").over(before)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.to_pydict()
            for file, n, ends, head, inner, tokens, earlier, last, open_from in zip(*(b[k] for k in names), strict=True):
                sizes = np.array(inner, np.int64)
                if ends:
                    ordinal = earlier + np.arange(ends)
                    first_inner = tokens + head + 1
                    start = np.concatenate(([open_from], first_inner + np.cumsum(sizes + 1) - sizes - 1))
                    size = np.concatenate(([tokens + head - open_from], sizes))
                    open_from = first_inner + int((sizes + 1).sum())
                else:
                    ordinal = start = size = np.zeros(0, np.int64)
                if last and tokens + n > open_from:
                    ordinal, start, size = np.append(ordinal, earlier + ends), np.append(start, open_from), np.append(size, tokens + n - open_from)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(ordinal), pa.string()), "ordinal": pa.array(ordinal, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64())})

    names = ["file", "n_tokens", "n_ends", "head", "inner", "tokens_before", "ends_before", "is_last", "open_from"]
    return at.select(*names).mapInArrow(run, "file string, ordinal long, start long, n_tokens long")


def count_tokens(spark: SparkSession, path: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token counts of the documents in the flat files under ``path``; empty files have none."""
    return document_counts(scan_blocks(read_blocks(spark, path, width, block_bytes), separator, width))


def packed_ids(documents: DataFrame, ranks: str, pattern: str, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens binary``: ids of whole texts by a rank file, packed for ``write_token_files``.

    Null texts count as empty; an id that ``width`` bytes cannot hold is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(table.values()) >= 1 << (8 * width):
            raise ValueError("ids do not fit")
        enc, kind = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), np.dtype(f"<u{width}")
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [np.array(enc.encode_ordinary(t), kind).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "tokens": pa.array(found, pa.binary())})

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens binary")


def counted_documents(documents: DataFrame, ranks: str, pattern: str, separator: int, width: int = 2, rows_per_file: int = FILE_ROWS, scope: str = "lakeloom", settled: bool = False) -> DataFrame:
    """``doc_id, start_token, n_tokens``: all documents (``doc_id, text``) written as flat token files, scanned, and matched to their counts.

    The files carry no ids. A task writes its rows in their order, so file names and ordinals give the row
    number of a document in the scan. ``documents`` is scanned twice, and a frame behind a shuffle may be dealt out
    otherwise the second time; so it is written first, unless it is ``settled``: a plain scan of files that do not change. A document without a count
    or a count without a document is an error, never a null. The token files go when they are counted. Null
    texts count as empty and have 0 tokens; repeated rows are documents of their own; an empty table gives no rows.
    """
    import uuid

    from .common import delete, materialize, shared_dir

    spark = documents.sparkSession
    if not settled:
        documents = materialize(documents.select("doc_id", "text"), scope)
    path = f"{shared_dir(spark)}/lakeloom-tokens-{uuid.uuid4().hex}"
    write_token_files(packed_ids(documents, ranks, pattern, width), path, separator, width, rows_per_file)
    counts = count_tokens(spark, path, separator, width)
    counts = materialize(counts.select(row_of(F.col("file"), F.col("ordinal"), rows_per_file).alias("row"), F.col("start").alias("start_token"), "n_tokens"), scope)
    delete(spark, path)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.lit(True).alias("here"))
    both = rows.join(counts, "row", "full_outer")
    whole = F.when(F.col("here").isNull() | F.col("n_tokens").isNull(), F.raise_error(F.lit("the documents were dealt out otherwise when they were written"))).otherwise(F.col("n_tokens"))
    return both.select("doc_id", "start_token", whole.alias("n_tokens"))


def op8_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Write all documents as flat token files and count each file's documents by the separators."""
    import public_tokenizers as tokenizers_dir

    from .common import table

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted_documents(documents, tokenizers_dir.path("byte_bpe_multi_50k.tiktoken"), tokenizers_dir.PATTERN, 50256, settled=True)
