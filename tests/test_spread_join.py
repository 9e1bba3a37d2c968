"""Joins on few keys with very many rows."""

from pyspark.sql import functions as F

from lakeloom.operators import matches


def test_one_key_is_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(matches, "KEY_ROWS", 10)
    left = spark.range(50).select(F.col("id").alias("a"), F.when(F.col("id") < 45, "hot").when(F.col("id") < 48, "cold").alias("k"))
    right = spark.range(200).select(F.col("id").alias("b"), F.when(F.col("id") < 190, "hot").when(F.col("id") < 193, "cold").when(F.col("id") < 195, "none").alias("k"))
    found = matches.spread_join(left, right, "k", "b")
    assert sorted(map(tuple, found.select("a", "b", "k").collect())) == sorted(map(tuple, left.join(right, "k").select("a", "b", "k").collect()))
    assert found.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
