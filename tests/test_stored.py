"""Landed batches, one review's rows and bucketed logs."""

import datetime

import pytest
from pyspark.sql import functions as F

from revlens import schemas
from revlens.operators import reports
from revlens.operators.review_table import ReviewTable
from revlens.plans import stored

DAY = datetime.date(2025, 3, 1)


def rows(ids, day=0, text="old", platform="Google Play"):
    date = DAY + datetime.timedelta(day)
    return [(i, date, f"user_{i}", platform, "en", f"{text} {i}", "No") for i in ids]


@pytest.fixture
def table(spark, tmp_path):
    return ReviewTable(spark, str(tmp_path / "reviews"), buckets=4)


def landed(spark, table, name, *parts):
    return table.merge(spark.createDataFrame([r for p in parts for r in p], schemas.REVIEWS), name)


def texts(df):
    return {(r.platform, r.review_id): r.review for r in df.collect()}


def test_upserts_keep_the_newest_row_of_a_key(spark, table):
    assert table.read().count() == 0 and table.rows_of(1).count() == 0
    assert landed(spark, table, "a", rows(range(20)), rows([3], -5, "older"), rows([4], 5, "newer"))
    assert landed(spark, table, "b", rows(range(10, 30), 1, "later"), rows([0], -1, "late news"), rows([1], 0, "same day"))
    assert landed(spark, table, "c", rows([5], platform="App Store"))
    got = texts(table.read())
    assert len(got) == table.read().count() == 31
    assert got["Google Play", 3] == "old 3" and got["Google Play", 4] == "newer 4"
    assert got["Google Play", 10] == "later 10" and got["Google Play", 0] == "old 0"
    assert got["Google Play", 1] == "same day 1" and got["App Store", 5] == "old 5"
    assert table.rows_of(5).count() == 2 and table.rows_of(99).count() == 0


def test_a_batch_counts_once_and_a_lost_one_leaves_nothing(spark, table):
    landed(spark, table, "a", rows(range(8)))
    before = texts(table.read())
    assert not landed(spark, table, "a", rows(range(100, 200)))
    # a job that wrote its data and was lost before the manifest
    spark.createDataFrame(rows([500]), schemas.REVIEWS).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(
        f"{table.path}/data/version=2"
    )
    assert texts(table.read()) == before
    landed(spark, table, "b", rows([500], 1, "again"))
    assert texts(table.read()) == before | {("Google Play", 500): "again 500"}
    assert table.merge(spark.createDataFrame([], schemas.REVIEWS), "empty") and len(texts(table.read())) == 9
    assert not table.merge(spark.createDataFrame([], schemas.REVIEWS), "empty")
    with pytest.raises(ValueError):
        landed(spark, table, "c", rows([None]))


def test_a_lookup_reads_one_bucket_and_buckets_are_newest_first(spark, table):
    parts = [rows([i], day=i % 9) for i in range(60)]
    landed(spark, table, "a", *parts)
    files = table.rows_of(7).inputFiles()
    assert len(files) == 1 < len(table.read().inputFiles())
    for path in table.read().inputFiles():
        dates = [r.date for r in spark.read.parquet(path).collect()]
        assert dates == sorted(dates, reverse=True)


def test_bucketed_logs_join_without_a_shuffle(spark, sf):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = reports.e2e_detail(*stored.bucketed_logs(spark, sf))
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert report.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
