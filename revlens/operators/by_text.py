"""Views that identify a review by its text instead of its key.

Copies of one text may be a third of all rows. Every step here is a partial
aggregate on a digest of the text, or a salted join on it; no window or list is
ever built over the copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.skew import hot_key_join


def digest(text: str = "review") -> Column:
    return F.sha2(F.col(text), 256)


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """One row per distinct text, kept under its lowest review_id."""
    return reviews.groupBy("review").agg(
        F.min("review_id").alias("review_id"), F.count("*").alias("copies")
    )


def first_reference_by_text(reviews: DataFrame, references: DataFrame) -> DataFrame:
    """For each review the reference summary of the first review with that text."""
    keyed = reviews.select("review_id", digest().alias("_digest"))
    told = keyed.join(references.select("review_id"), "review_id", "left_semi")
    earliest = told.groupBy("_digest").agg(F.min("review_id").alias("first_review_id"))
    first = earliest.join(
        references.select(F.col("review_id").alias("first_review_id"), "reference_summary"),
        "first_review_id",
    )
    copies = keyed.groupBy("_digest").agg(F.count("*").alias("n_rows"))
    met = hot_key_join(keyed, first, ["_digest"], copies, ["review_id"], both_large=True)
    return met.drop("_digest")


def last_output_by_text(calls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per (text, model) the output of the last review with that text."""
    keyed = reviews.select("review_id", digest().alias("_digest"))
    return (
        calls.join(keyed, "review_id")
        .groupBy("_digest", "model")
        .agg(
            F.max("review_id").alias("review_id"),
            F.max_by("output", "review_id").alias("output"),
            F.count("*").alias("n_calls"),
        )
        .drop("_digest")
    )


def rows_of_review(rows: DataFrame, review_id: int) -> DataFrame:
    """All rows of one review; on a stored table the filter reaches the scan."""
    return rows.filter(F.col("review_id") == review_id)
