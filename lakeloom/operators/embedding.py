"""An embedding step around any function from texts to vectors: distinct texts only, in batches, with retries, kept in a store."""

from __future__ import annotations

import math
import sys
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

STORED = "text_hash string, model string, run string, embedding array<double>, error string"


def text_hash(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def batches_by_bytes(texts: list[str], most: int) -> Iterator[list[int]]:
    """Places of consecutive texts that have ``most`` bytes together, or one text that has more."""
    group, size = [], 0
    for i, t in enumerate(texts):
        n = len(t.encode())
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def checked(vector: Sequence[float], dimension: int) -> tuple[list[float] | None, str | None]:
    """The vector at unit length, or why it is none; a zero vector stays as it is."""
    try:
        v = [float(x) for x in vector]
    except TypeError:
        return None, "not a vector"
    if len(v) != dimension:
        return None, f"{len(v)} dimensions, not {dimension}"
    if not all(map(math.isfinite, v)):
        return None, "not finite"
    length = math.sqrt(sum(x * x for x in v))
    return ([x / length for x in v] if length else v), None


def attempt(function: Callable[[list[str]], Sequence], texts: list[str], retries: int, wait: float) -> tuple[Sequence | None, str | None]:
    """The function's vectors, or the last of ``retries`` + 1 errors."""
    error = None
    for k in range(retries + 1):
        if k and wait:
            time.sleep(wait * 2 ** (k - 1))
        try:
            found = function(texts)
            if len(found) == len(texts):
                return found, None
            error = f"{len(found)} vectors for {len(texts)} texts"
        except Exception as e:  # noqa: BLE001  what a model's client may raise is not known here
            error = f"{type(e).__name__}: {e}"
    return None, error


def stored(spark, store: str, model: str) -> DataFrame | None:
    """What the store holds of a model, one row a text: a vector if there is one, else the last error; None if there is no store yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(conf).exists(at):
        return None
    rows = spark.read.schema(STORED).parquet(store).where(F.col("model") == model)
    best = F.max_by(F.struct("embedding", "error"), F.struct(F.col("error").isNull(), "run")).alias("best")
    return rows.groupBy("text_hash").agg(best).select("text_hash", "best.*")


def embed(texts: DataFrame, function: Callable[[list[str]], Sequence], store: str, model: str, dimension: int, batch_bytes: int = 1 << 20, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """``id, text_hash, embedding, error`` of every row of ``texts`` (``id, text``; null texts are empty).

    Each different text is given to ``function`` once, in lists of at most ``batch_bytes`` bytes (a longer text goes alone), unless the store has its
    vector for this model. A list that fails ``retries`` times more is tried text by text, so that one bad text is one error. Vectors of another
    dimension or with non-finite numbers are errors; the others are brought to unit length. Results, errors too, are
    appended to the store (Parquet); errors are tried again by the next run. A lost task asks the function again for its texts.
    """
    spark = texts.sparkSession
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    fresh = rows.groupBy("text_hash").agg(F.first("text").alias("text"))
    known = stored(spark, store, model)
    if known is not None:
        fresh = fresh.join(known.where("error is null").select("text_hash"), "text_hash", "left_anti")
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, said = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in batches_by_bytes(said, batch_bytes):
                vectors, error = attempt(function, [said[i] for i in group], retries, wait)
                if error is None:
                    found = [checked(v, dimension) for v in vectors]
                elif len(group) == 1:
                    found = [(None, error)]
                else:
                    found = []
                    for i in group:
                        alone, why = attempt(function, [said[i]], retries, wait)
                        found.append((None, why) if why else checked(alone[0], dimension))
                columns = [[hashes[i] for i in group], [model] * len(group), [run] * len(group), [v for v, _ in found], [e for _, e in found]]
                kinds = [pa.string()] * 3 + [pa.list_(pa.float64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in STORED.split(", ")])

    fresh.select("text_hash", "text").mapInArrow(call, STORED).write.mode("append").parquet(store)
    return rows.select("id", "text_hash").join(stored(spark, store, model), "text_hash", "left").select("id", "text_hash", "embedding", "error")


def runs(spark, store: str) -> DataFrame:
    """``run, place, texts``: how many texts each run gave to its function, runs in order."""
    counts = spark.read.schema(STORED).parquet(store).groupBy("run").agg(F.count("*").alias("texts"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy("run")))  # one row a run
