"""Structured Streaming: event-time windows, sessions, running counters, chunks of a growing text, incremental stores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, ts: str, width: str, late: str, by: list[str], *aggregates, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; rows later than the watermark are dropped by Spark, state behind it goes."""
    at = events.withWatermark(ts, late)
    return at.groupBy(F.window(ts, width, slide), *by).agg(*aggregates)


def sessions(events: DataFrame, ts: str, gap: str, late: str, by: list[str], *aggregates) -> DataFrame:
    """Sessions that a silence of ``gap`` ends."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(*aggregates)


def running_totals(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mergeable totals for ``outputMode("update")``: count, sum, sum of squares, range."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"), F.min(value).alias("low"), F.max(value).alias("high"))


def first_seen(rows: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """Rows whose keys did not occur within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def cut_at(buffer: str, most: int, least: int) -> int:
    """Where to cut a buffer of more than ``most`` characters: behind the last sentence, line or word end there, or hard."""
    head = buffer[:most]
    for marks in (".!?", "\n", " "):
        at = max((head.rfind(m) for m in marks), default=-1) + 1
        if at >= max(1, least):
            return at
    return most


def text_chunks(rows: DataFrame, key: str, text: str, most: int, least: int = 0, idle: str | None = None) -> DataFrame:
    """``key, seq long, content``: chunks of texts that grow row by row.

    What is left over waits for more; with ``idle`` ("1 minute") it is sent when nothing comes for so long of
    processing time, which needs a trigger that goes on. State is one string of at most ``most`` characters a key.
    """
    millis = {"second": 1000, "minute": 60_000, "hour": 3_600_000}[idle.split()[1].rstrip("s")] * int(idle.split()[0]) if idle else 0

    def pop(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, seq = state.get if state.exists else ("", 0)
        out = []
        if state.hasTimedOut:
            if buffer:
                out.append((k[0], seq, buffer))
            state.remove()
        else:
            for part in parts:
                buffer += "".join(t for t in part[text] if t)
            while len(buffer) > most:
                at = cut_at(buffer, most, least)
                out.append((k[0], seq, buffer[:at].strip()))
                buffer, seq = buffer[at:].lstrip(), seq + 1
            state.update((buffer, seq))
            if millis:
                state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=[key, "seq", "content"])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(pop, f"{key} {kind}, seq long, content string", "buffer string, seq long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def index_new_files(found: DataFrame, store: str, checkpoint: str, chunk, keys: tuple[str, ...] = ("path", "mtime", "size")):
    """Start a query that appends the chunks of files that the store has not seen in this state.

    ``chunk`` maps new files to the store's rows. A batch that runs again finds its files in the store and adds nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(store)
        fresh = rows
        if at.getFileSystem(conf).exists(at):
            fresh = rows.join(spark.read.parquet(store).select(*keys).distinct(), list(keys), "left_anti")
        chunk(fresh).write.mode("append").parquet(store)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
