"""Chunks for questions: texts of very many capitalised words, and what waits for what."""

from pyspark.sql import functions as F

from lakeloom import plans
from lakeloom.functions import text as X
from lakeloom.operators import matches


def test_a_run_of_very_many_names_is_one_name(spark):
    (row,) = spark.range(1).select(X.named_terms(F.repeat(F.lit("Anna "), 200_000)).alias("x"), X.named_terms(F.lit("an Anna  Bo Carl Da x Eva")).alias("y")).collect()
    assert len(row.x) == 1 and len(row.x[0]) == 5 * 200_000 - 1
    assert row.y == ["Anna", "Bo Carl Da", "Eva"]


def test_first_chunk_is_known_before_chunks_are_scored(spark, tmp_path):
    """Nothing that is read with the chunks is broadcast, so no broadcast waits behind them."""
    spark.createDataFrame([(4, "red Green"), (3, "blue Blue Sky")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'web' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "blue sky"), (2, "nothing here"), (3, "green red green")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = plans.load()[0]["j33_question_chunks"](spark, str(tmp_path))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 3, 4, 1), (2, 3, 0, 1), (3, 4, 7, 1)]
    empty = matches.score_chunks(spark.sql("select 1L as question, 'a' as term"), spark.sql("select 1L as chunk, 'a' as term, 2L as weight where false"), spark.sql("select min(1L) as chunk where false"), 3)
    assert [tuple(r) for r in empty.collect()] == [(1, None, 0, 1)]
