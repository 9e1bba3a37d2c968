"""Streaming queries: each reads a table as a stream, runs until it is used up, and returns what it wrote."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import windows as W
from .base import query, table


_WRITTEN: list[str] = []


def _delete_written() -> None:
    """At the end of the process: delete what queries wrote for themselves, if its session is still there."""
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    path_of, conf = context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()
    for place in _WRITTEN:
        store = path_of(place).getFileSystem(conf)
        for found in store.globStatus(path_of(place + "*")) or ():  # with what has its name and an ending
            store.delete(found.getPath(), True)


def shared(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share; a local one only for a local master. It goes with the process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lakeloom-stream-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append(f"{found}/stream-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream: the file or folder is matched by a pattern, as the source wants one."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(df: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all that is there; in complete mode the last batch's result counts."""
    spark = df.sparkSession
    to = shared(spark)
    write = "overwrite" if mode == "complete" else "append"
    schema = df.schema
    started = df.writeStream.outputMode(mode).option("checkpointLocation", f"{to}-checkpoint").foreachBatch(lambda rows, _: rows.write.mode(write).parquet(to)).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(schema).parquet(to)


@query("r11_stream_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r11_stream_windows(spark, d):
    events = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = finished(W.windowed(events, "ts", "1 hour", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "complete")
    return found.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("r1_stream_sessions", """WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def r1_stream_sessions(spark, d):
    events = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = finished(W.sessions(events, "ts", "6 hours", "1 hour", ["user_id"], F.count("*").alias("n")), "complete")
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("r5_stream_totals", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(sum(value * value), 4) AS squares, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def r5_stream_totals(spark, d):
    found = finished(W.running_totals(stream(spark, d, "events"), ["event_type"], "value"), "complete")
    return found.select("event_type", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"), "low", "high")


@query("r4_stream_index", "SELECT source AS path, count(*) AS chunks FROM documents GROUP BY 1")
def r4_stream_index(spark, d):
    """Documents indexed twice into one store: the second run adds nothing."""
    to = shared(spark)
    files = stream(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"))
    for k in range(2):
        W.index_new_files(files, to, f"{to}-checkpoint-{k}", lambda rows: rows).awaitTermination()
    return spark.read.parquet(to).groupBy("path").agg(F.count("*").alias("chunks"))
