import os

import pytest
from pyspark.sql import functions as F

from broadsheet import stages
from broadsheet.plans import load_catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(stages, "folder", lambda spark: f"file://{tmp_path}")
    return tmp_path


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stage_leaves_its_rows_and_no_shuffle_files(spark, folder):
    rows = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 > 0, F.array(F.col("id") % 7)))
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    before, setting = shuffle_files(spark), spark.conf.get(stages.CLEANUP, None)
    kept = stages.staged(counted, "counted")
    assert shuffle_files(spark) <= before and spark.conf.get(stages.CLEANUP, None) == setting
    assert kept.schema.simpleString() == counted.schema.simpleString() and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, kept.collect())) == sorted(map(str, counted.collect()))
    assert [n.rpartition("-")[0] for n in os.listdir(folder)] == ["counted"]


@pytest.mark.parametrize("name, made", [
    ("article_detail", {"article-texts", "page-links"}),
    ("delivery_request", {"delivery-pictures", "delivery-articles"}),
    ("job_browser", {"article-titles", "browser-pages"}),
])
def test_queries_run_in_stages_with_the_same_rows(spark, folder, monkeypatch, name, made):
    found = load_catalog()[0][name](spark, SF)
    assert {n.rpartition("-")[0] for n in os.listdir(folder)} == made
    monkeypatch.setattr(stages, "folder", lambda spark: None)
    whole = load_catalog()[0][name](spark, SF)
    assert whole.count() == found.count() and whole.exceptAll(found).count() == 0
