"""What staged tables leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from mediacast.session import CLEANUP_SETTING, stage, unstage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rpartition("/")[2] for f in files.split("\n") if "shuffle_" in f}


def test_shuffle_files_of_a_staged_table_go_with_its_write(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffle_files(spark)
    staged = stage(counts, "counts")
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP_SETTING, None) is None
    # the plan itself can run again
    assert sorted(counts.collect()) == sorted(staged.collect()) == sorted((k, 1000 // 7 + (k < 1000 % 7)) for k in range(7))
    try:
        spark.conf.set(CLEANUP_SETTING, "false")
        stage(counts, "counts")
        assert spark.conf.get(CLEANUP_SETTING) == "false"
    finally:
        spark.conf.unset(CLEANUP_SETTING)


def test_unstage_removes_staged_tables_and_nothing_else(spark, tmp_path):
    first, second = stage(spark.range(5), "first"), stage(spark.range(7), "second")
    folders = {os.path.dirname(f.removeprefix("file:").replace("//", "")) for f in first.inputFiles()}
    unstage(first.union(first))
    assert folders and not any(map(os.path.exists, folders)) and second.count() == 7
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        unstage(spark.read.parquet(str(tmp_path / "other")))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 3
