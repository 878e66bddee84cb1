"""User-level jobs: extraction, the three model comparisons, the end-to-end report.

Each job takes DataFrames and returns DataFrames; where the calls come from
(the offline stand-in or a stored call log) is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.numeric import r6
from revlens.operators import classification, reports
from revlens.operators.lcs import rouge_l
from revlens.operators.nearest_reference import best_reference
from revlens.operators.noise import add_noise
from revlens.operators.overlap import meteor, rouge_n
from revlens.operators.perplexity import perplexity, train
from revlens.operators.polarity import polarity, tone
from revlens.operators.scoring import (
    alignment,
    compression_ratio,
    price,
    with_output,
    with_sentiment,
)
from revlens.operators.soft_match import soft_match
from revlens.operators.unify import unify
from revlens.session import materialise
from revlens.sources.catalog import MODELS, NO_REFERENCE, Model, models_table

WordIds = Callable[[Column], Column]
KEY = ("review_id", "model")
QUALITY = ("rouge_1", "rouge_2", "rouge_l", "soft_f1", "meteor", "compression")


def evaluation_set(reviews: DataFrame, truth: DataFrame, edge: DataFrame) -> DataFrame:
    """The customer, edge and noisy datasets as one table with a dataset column,
    so that one job covers all three comparisons. A review and its noisy copy come
    from the same scan and the same join with the labels."""
    columns = ("dataset", "review_id", "user_name", "review", "label")
    labelled = reviews.select("review_id", "user_name", "review").join(truth, "review_id")
    noisy = add_noise(F.col("review"), F.col("review_id"))
    versions = F.array(
        F.struct(F.lit("customer").alias("dataset"), F.col("review").alias("review")),
        F.struct(F.lit("noisy").alias("dataset"), noisy.alias("review")),
    )
    both = labelled.select("review_id", "user_name", "label", F.explode(versions).alias("_v"))
    edges = edge.withColumn("dataset", F.lit("edge")).select(*columns)
    return both.select("review_id", "user_name", "label", "_v.*").select(*columns).unionByName(edges)


def extract(google: DataFrame, appstore: DataFrame) -> DataFrame:
    return unify(google, appstore)


def scored_sentiment(calls: DataFrame, models: tuple[Model, ...] = MODELS) -> DataFrame:
    """Clean, validate and price a sentiment log (with ``label`` where known)."""
    priced = price(with_output(calls), models_table(calls.sparkSession, models))
    return with_sentiment(priced)


def sentiment_comparison(calls: DataFrame) -> DataFrame:
    return classification.sentiment_leaderboard(scored_sentiment(calls))


def priced_text(
    calls: DataFrame, lower_responses_of: tuple[str, ...] = (), models: tuple[Model, ...] = MODELS
) -> DataFrame:
    return price(with_output(calls, lower_responses_of), models_table(calls.sparkSession, models))


def summary_pairs(
    calls: DataFrame, reference_summaries: DataFrame, word_ids: WordIds | None = None
) -> DataFrame:
    """Candidate and reference summary of each call, joined on the review key.
    ``word_ids`` adds r_ids, computed once per reference and not once per call."""
    refs = reference_summaries
    if word_ids is not None:
        refs = refs.withColumn("r_ids", word_ids(F.col("reference_summary")))
    return calls.join(refs, "review_id", "left").withColumnRenamed(
        "reference_summary", "reference"
    )


def response_pairs(
    calls: DataFrame,
    reference_responses: DataFrame,
    word_ids: WordIds | None = None,
    rows_per_user: DataFrame | None = None,
) -> DataFrame:
    """Candidate reply and the best of its user's references."""
    if word_ids is None:
        return best_reference(calls, reference_responses, KEY, rows_per_user=rows_per_user)
    refs = reference_responses.withColumn("r_ids", word_ids(F.col("ref_text")))
    stock = F.when(F.col("reference").isNotNull(), word_ids(F.lit(NO_REFERENCE)))
    pairs = best_reference(calls, refs, KEY, rows_per_user=rows_per_user)
    return pairs.withColumn("r_ids", F.coalesce("r_ids", stock))


def with_overlap_metrics(pairs: DataFrame) -> DataFrame:
    """ROUGE-1/2/L and METEOR of (output, reference), all local to the row."""
    cand, ref = F.col("output"), F.col("reference")
    return (
        pairs.withColumn("_n", rouge_n(cand, ref))
        .withColumn("rouge_1", r6(F.col("_n.n1.set")))
        .withColumn("rouge_2", r6(F.col("_n.n2.set")))
        .withColumn("rouge_l", r6(rouge_l(cand, ref)))
        .withColumn("meteor", r6(meteor(cand, ref)))
        .drop("_n")
    )


def quality_board(
    pairs: DataFrame, corpus: DataFrame, vectors: DataFrame, word_ids: WordIds
) -> DataFrame:
    """The quality leaderboard of a text task: sums and means of all metrics.

    ``pairs`` come with r_ids. They are read twice (perplexity needs a join per
    token, the other metrics none), so the scored log is written first, like the
    bigram model. The two parts meet again as one row per model.
    """
    needed = (*KEY, "error", "elapsed_s", "cost_usd", "review_tokens", "output", "reference", "r_ids")
    pairs = materialise(pairs.select(*needed), "pairs")
    cand = F.col("output")
    overlap = ("rouge_1", "rouge_2", "rouge_l", "meteor")
    scored = with_overlap_metrics(pairs).select(
        *KEY, "error", "elapsed_s", "cost_usd", *overlap,
        r6(compression_ratio(F.col("review_tokens"), cand)).alias("compression"),
        word_ids(cand).alias("c_ids"), "r_ids",
    )
    scored = soft_match(scored, vectors, KEY).withColumn("soft_f1", r6(F.col("soft_f1")))
    board = reports.metric_leaderboard(scored, QUALITY)
    finished = pairs.filter(F.col("error").isNull()).select(*KEY, "output")
    fluency = perplexity(finished, bigram_model(corpus), KEY, near=("review_id",))
    sums = fluency.groupBy("model").agg(
        F.sum(F.col("perplexity").cast("decimal(24,6)")).cast("double").alias("perplexity_sum"),
        F.count("*").alias("_n"),
    )
    mean = r6(F.col("perplexity_sum") / F.col("_n").cast("double"))
    return board.join(
        sums.select("model", "perplexity_sum", mean.alias("perplexity_avg")), "model", "left"
    )


def bigram_model(corpus: DataFrame) -> DataFrame:
    """The trained model as a written table: trained once, read by each use."""
    return materialise(train(corpus), "bigram-model")


def tone_alignment(
    reviews: DataFrame, replies: DataFrame, lexicon: DataFrame
) -> DataFrame:
    """Per model, how often a reply has the tone of the review it answers."""
    review_tone = polarity(reviews, lexicon, ["review_id"]).select(
        "review_id", tone(F.col("polarity")).alias("review_tone")
    )
    reply_tone = polarity(
        replies.filter(F.col("error").isNull()), lexicon, KEY, text="output", near=("review_id",)
    ).select(*KEY, tone(F.col("polarity")).alias("reply_tone"))
    aligned = alignment(F.col("review_tone"), F.col("reply_tone"))
    return (
        reply_tone.join(review_tone, "review_id")
        .groupBy("model")
        .agg(F.count("*").alias("n_replies"), F.sum(aligned).alias("n_aligned"))
        .withColumn(
            "aligned_share",
            r6(F.col("n_aligned").cast("double") / F.col("n_replies").cast("double")),
        )
    )
