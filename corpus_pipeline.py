"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame: the columns of ``documents`` for all
stages but the last, which returns the packing. A stage's result is to be written before the next
stage runs; what the stage before has kept in the shared folder is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import common, packing, quality, simhash, suffix, toxicity


def _rejected_go(docs: DataFrame, score, model, keep_predicted: int) -> DataFrame:
    """The rows of ``docs`` with a prediction, all their columns unchanged."""
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return score(rows, model, keep=("row",)).where(F.col("predicted") == keep_predicted).select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    common.put_on_path(spark)
    return _rejected_go(docs, quality.score_quality, quality.train(docs, common.table(spark, sf_dir, "labels")), 1)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network accepts; it also learns from those that an earlier stage has rejected."""
    common.put_on_path(spark)
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return _rejected_go(docs, toxicity.score_toxicity, model, 0)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one with the smallest id."""
    common.put_on_path(spark)
    return simhash.drop_near_copies(docs, scope="pipeline-copies").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that occur elsewhere too; those with nothing else are gone."""
    common.put_on_path(spark)
    common.release(spark, "pipeline-copies")
    columns = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    left = suffix.remove_repeated_words(rows, PASSAGE_WORDS, keep=("row",), scope="pipeline-repeats").where("n_removed = 0 or n_removed < n_words")
    left = left.select("doc_id", F.col("kept_text").alias("text"), "row.*").withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 words from all that is left."""
    common.put_on_path(spark)
    common.release(spark, "pipeline-repeats")
    return packing.pack(docs)


#: Passages of at least so many words go.
PASSAGE_WORDS = 50

STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("SimHash near-dedup", keep_one_copy),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: The classifiers are trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = common.materialize(stage(spark, docs, sf_dir), "pipeline-stages")
        common.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
