"""Queries over tables that are kept: landed batches, one review's rows, bucketed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import reports, unify
from revlens.operators.backends import offline_calls
from revlens.operators.review_table import ReviewTable, bucketed
from revlens.plans import jobs
from revlens.plans.registry import (
    customer_rows,
    present,
    query,
    report_responses,
    report_sentiment,
)
from revlens.session import new_table_path
from revlens.sources import corpus


def _landed(spark: SparkSession, sf: str) -> ReviewTable:
    """All reviews in two batches that overlap by a third; the second lands twice."""
    both = jobs.extract(corpus.raw_google(spark, sf), corpus.raw_appstore(spark, sf))
    table = ReviewTable(spark, new_table_path(spark, "review-table"))
    table.merge(both.filter("review_id % 3 <> 0"), "first")
    table.merge(both.filter("review_id % 3 <> 1"), "second")
    table.merge(both.filter("review_id % 3 <> 1"), "second")
    return table


@query
def reviews_landed(spark, sf):
    """The review table after landed batches: the same as extracted at once."""
    return present(_landed(spark, sf).read())


@query
def rows_of_review(spark, sf):
    """The rows of the review with the largest id, from the one bucket that has them."""
    last = corpus.reviews(spark, sf).agg(F.max("review_id")).first()[0]
    return present(_landed(spark, sf).rows_of(last))


def bucketed_logs(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The sentiment, summary and response logs of the report, bucketed by call."""
    rows = unify.unreplied(customer_rows(spark, sf))
    logs = (
        ("sentiment_log", report_sentiment(spark, sf, rows).select("review_id", "model", "prediction")),
        ("summary_log", jobs.priced_text(offline_calls(rows, "summary", 2)).select("review_id", "model", "output")),
        ("response_log", report_responses(spark, sf).select("review_id", "model", "output")),
    )
    return [bucketed(log, name, ("review_id", "model")) for name, log in logs]


@query
def e2e_detail_bucketed(spark, sf):
    """The end-to-end report from bucketed logs: its joins read them as they lie."""
    return present(reports.e2e_detail(*bucketed_logs(spark, sf)))
