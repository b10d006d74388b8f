"""Joins, samples and scratch tables that the operators share."""

import os

import pytest
from hazardframe.llm import common
from pyspark.sql import functions as F


@pytest.mark.parametrize("often,most", [(5, 500_000), (5, 0), (10**9, 500_000)])
def test_hot_join_is_a_join(spark, tmp_path, monkeypatch, often, most):
    """Keys that many rows share, keys of one row, and keys that only one side has."""
    monkeypatch.setattr(common, "OFTEN", often)
    monkeypatch.setattr(common, "OFTEN_MOST", most)
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"), "id")
    counts = left.where("k != 39").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    counts.unionByName(spark.range(1).selectExpr("99L k", "6L n", "0L x")).write.parquet(f"{tmp_path}/t")
    right = spark.read.parquet(f"{tmp_path}/t")
    got, want = common.hot_join(left, right.drop("n"), ["k"], right.select("k", "n")), left.join(right.drop("n"), ["k"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 300 - left.where("k = 39").count()


def test_scratch_is_freed(spark):
    mark = common.opened()
    scratch = common.Scratch(spark, "test")
    table = scratch.table(spark.range(5), "five")
    assert table.count() == 5 and os.path.isdir(scratch.path("five"))
    common.release(mark)
    assert common.opened() == mark and not os.path.exists(scratch.root)


def test_tidy_passes_batches_on():
    assert list(common.tidy(lambda it: (x + 1 for x in it))(iter([1, 2]))) == [2, 3]
    with pytest.raises(ZeroDivisionError):
        list(common.tidy(lambda it: (1 / x for x in it))(iter([0])))


def test_names_with_dots_and_ticks(spark):
    df = spark.range(1).select(F.lit(1).alias("a.b"), F.lit(2).alias("c`d"))
    assert df.select(*common.all_of(df)).columns == ["a.b", "c`d"]
