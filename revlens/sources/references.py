"""Reference texts: one summary per review, several replies per user."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def responses_from_map(spark: SparkSession, by_user: Mapping[str, Sequence[str]]) -> DataFrame:
    """A {user: [reply, ...]} mapping as rows (user_name, ref_no, ref_text)."""
    rows = [(user, list(refs)) for user, refs in by_user.items()]
    return explode_responses(spark.createDataFrame(rows, "user_name string, refs array<string>"))


def explode_responses(df: DataFrame) -> DataFrame:
    """(user_name, refs array) as (user_name, ref_no, ref_text); ref_no keeps order."""
    return df.select("user_name", F.posexplode("refs").alias("pos", "ref_text")).select(
        "user_name", (F.col("pos") + 1).cast("bigint").alias("ref_no"), "ref_text"
    )


def summaries_by_position(sample: DataFrame, summaries: Sequence[str]) -> DataFrame:
    """Bind a list of summaries to the rows of a small ordered sample.

    ``sample`` carries ``position`` 1..n; the list becomes a keyed table, so the
    binding is an equi join and not an accident of row order.
    """
    spark = sample.sparkSession
    table = spark.createDataFrame(
        [(i + 1, s) for i, s in enumerate(summaries)], "position int, reference_summary string"
    )
    return sample.join(F.broadcast(table), "position", "left").select(
        "review_id", "reference_summary"
    )
