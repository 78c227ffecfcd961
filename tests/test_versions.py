"""Published versions: readers see one version whole, failed writes leave the old one."""

import tempfile

import pytest
from pyspark.sql import functions as F

from placeweave.sources import sinks, versions


def place():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


def test_a_reader_keeps_its_version_while_another_is_published(spark):
    path = place()
    versions.write_version(spark.range(10).withColumn("v", F.lit(1)), path, "a")
    before = versions.read_current(spark, path)
    versions.write_version(spark.range(5).withColumn("v", F.lit(2)), path, "a")
    assert {r["v"] for r in before.collect()} == {1} and before.count() == 10
    after = versions.read_current(spark, path)
    assert {r["v"] for r in after.collect()} == {2} and after.count() == 5


def test_a_failed_write_leaves_the_old_version(spark):
    path = place()
    versions.write_version(spark.range(3), path, "a")
    broken = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        versions.write_version(broken, path, "a")
    assert versions.read_current(spark, path, "a").count() == 3
    assert versions.pointers(spark, path).count() == 1


def test_names_stand_beside_each_other(spark):
    path = place()
    with pytest.raises(ValueError):
        versions.read_current(spark, path)
    rows = spark.createDataFrame([(1, "most_viewed", 2, "top5")], "listing_id bigint, ranking_key string, rank int, tier string")
    for day in ("2024-05-01", "2024-05-02", "2024-05-01"):
        sinks.write_result(rows, sinks.POPULARITY, path, day)
    assert sinks.read_results(spark, path).count() == 2
    assert sinks.read_results(spark, path, "2024-05-02").first()["run_date"] == "2024-05-02"
    assert versions.pointers(spark, path).count() == 3


def test_compaction_keeps_the_newest_of_each_store(spark):
    path = place()
    rows = spark.range(100).selectExpr("id as event_id", "id % 3 as store", "timestamp_seconds(id) as saved_at")
    versions.write_version(rows, path, "lookups")
    old = versions.read_current(spark, path, "lookups")
    versions.compact(spark, path, "lookups", ["store"], "saved_at", 4)
    assert {r["event_id"] for r in versions.read_current(spark, path, "lookups").collect()} == set(range(88, 100))
    assert old.count() == 100
