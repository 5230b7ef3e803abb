"""Rounds written below the checkpoint folder."""

import os

from pyspark.sql import functions as F

from rfcover.operators.runtime import cut_lineage


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_round_leaves_no_shuffle_files_and_is_computed_once(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.struct(F.lit("a").alias("b"), F.array("id").alias("c")).alias("s"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    before = shuffle_files(spark)
    got = cut_lineage(rows.repartition(3, "k").mapInArrow(count, rows.schema))
    assert shuffle_files(spark) <= before
    assert seen.value == 1000
    assert got.schema.simpleString() == rows.schema.simpleString()
    assert sorted(got.collect()) == sorted(rows.collect())
    for f in got.inputFiles():
        assert os.path.exists(f.removeprefix("file:"))


def test_a_round_without_rows_keeps_its_columns(spark):
    assert cut_lineage(spark.range(0).withColumn("a", F.lit("x"))).columns == ["id", "a"]
