"""Polarity of a text: the mean polarity of its words that a lexicon knows.

The lexicon is a table (word, polarity). Each text's words are matched with the lexicon,
which is broadcast where its measured size allows and else meets the different words of
blocks of texts (functions/priced.py), and averaged in fixed point; a text without a hit
has polarity 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.numeric import micros, r6
from revlens.functions.priced import price_sums
from revlens.functions.text import words
from revlens.session import materialise

#: Largest measured size, in bytes, of a lexicon that is broadcast.
LIMIT = 64 * 2**20


def lexicon_from_labels(reviews: DataFrame, truth: DataFrame) -> DataFrame:
    """(word, polarity): how far a word's occurrences in labelled reviews lean to
    the positive ones. Partial counts per word, then arithmetic."""
    labelled = reviews.select("review_id", "review").join(
        truth.filter(F.col("label") != "neutral"), "review_id"
    )
    counts = (
        labelled.select("label", F.explode(words(F.col("review"))).alias("word"))
        .groupBy("word")
        .agg(
            F.count_if(F.col("label") == "positive").alias("_pos"),
            F.count_if(F.col("label") == "negative").alias("_neg"),
        )
    )
    pos, neg = F.col("_pos"), F.col("_neg")
    return counts.select(
        "word", r6((pos - neg).cast("double") / (pos + neg).cast("double")).alias("polarity")
    )


def polarity(
    texts: DataFrame,
    lexicon: DataFrame,
    key: Sequence[str],
    text: str = "review",
    broadcast_limit: int = LIMIT,
    near: Sequence[str] | None = None,
) -> DataFrame:
    """(key, n_hits, polarity) for every text. ``near``: columns of the key in which texts
    of one origin agree."""
    key = list(key)
    priced = materialise(
        lexicon.select(F.col("word").alias("term"), micros(F.col("polarity")).alias("_sum")), "lexicon"
    )
    return (
        price_sums(texts, priced, key, text, broadcast_limit, near)
        .select(
            *key, "n_hits",
            F.when(
                F.col("n_hits") > 0,
                r6(F.col("_sum").cast("double") / F.lit(1e6) / F.col("n_hits").cast("double")),
            ).otherwise(F.lit(0.0)).alias("polarity"),
        )
    )


def tone(value: Column) -> Column:
    """The sign of a polarity as a label."""
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("neutral")
