"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES: dict[str, list[str]] = {}
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lakeloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, scope: str = "lakeloom") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive the loss of any executor. ``release`` removes those of a scope.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeloom-{scope}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(scope, []).append(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.lakeloom_path = path
    return held


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``materialize`` returned, once nothing that is still to run reads them."""
    for df in frames:
        path = getattr(df, "lakeloom_path", None)
        if path:
            delete(df.sparkSession, path)
            for held in _TABLES.values():
                if path in held:
                    held.remove(path)


def release(spark: SparkSession, scope: str = "lakeloom") -> None:
    """Delete what ``materialize`` wrote for a scope and is still there; frames that read it end with this."""
    for path in _TABLES.pop(scope, []):
        delete(spark, path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a frame that ``materialize`` returned."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(path)
        total += at.getFileSystem(conf).getFileStatus(at).getLen()
    return total


def held_out(doc_id) -> F.Column:
    """True for the fifth of all ids that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, rows: int, per_class: bool = False
) -> DataFrame:
    """Training rows ``doc_id, text, y``: at most ``rows`` of the learnable labels (of each class with ``per_class``).

    The rows are those with the smallest hash of their id, so the choice depends neither on
    partitioning nor on row order. The sample is bounded by ``rows`` and therefore safe to broadcast.
    Rows with a null id or label are no training rows; an id with several labels counts once a label,
    one with several texts with the first of them in order.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    ranked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y")
    if per_class:
        ranked = ranked.where("y = 1").limit(rows).unionAll(known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    else:
        ranked = ranked.limit(rows)
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ranked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def put_on_path(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from the driver's checkout (local masters)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
