"""Sentiment by multinomial naive Bayes, trained on labelled reviews.

Training is one aggregate of (term, label) counts. With add-one smoothing a token
adds ln(n + 1) - ln(N + V) to a label's score, where n counts the term under the
label, N all its tokens and V the vocabulary: the terms seen at least ``MIN_COUNT``
times. Other terms say nothing (else a text of misspellings would go to the label with
the fewest tokens), so a score needs the known terms and one row of totals. Logarithms are kept in billionths, so the
sums are exact and do not depend on the order of tasks.

The term table is broadcast where its measured size allows; beyond that, the different
words of blocks of texts meet it (functions/priced.py). Both give one result.
:func:`client_factory` wraps a model of bounded size as a client for batch calls.

A text without known words gets the label that most training reviews have; ties go to the
earlier of the labels; rows without text count as empty.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.hashing import h32
from revlens.functions.priced import price_sums, table_size
from revlens.functions.text import count_tokens, words
from revlens.session import materialise
from revlens.sources.catalog import LABELS, Model

NAME = "Naive Bayes"
MODEL = Model(NAME, Decimal(0), Decimal(0), 0.0, "clean", "user")
#: One in so many reviews, by a hash of its id, is kept from training.
FOLDS = 5
#: Terms seen less often are not learned.
MIN_COUNT = 10
#: Largest measured size, in bytes, of a term table that is broadcast or shipped.
LIMIT = 64 * 2**20


@dataclass(frozen=True)
class Trained:
    """``terms`` (term, w_<label>) and ``totals`` (one row: base_<label>, prior_<label>),
    both written; weights in billionths."""

    terms: DataFrame
    totals: DataFrame


def held_out(review_id: Column) -> Column:
    return h32(F.lit("fold"), review_id) % FOLDS == 0


def _billionths(x: Column) -> Column:
    return F.floor(F.log(x.cast("double")) * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def train(labelled: DataFrame, text: str = "review", min_count: int = MIN_COUNT) -> Trained:
    """Of rows with a text and a ``label``; the caller leaves out what is held out."""
    label = F.col("label")
    told = labelled.filter(label.isin(*LABELS)).select("label", words(F.col(text)).alias("_words"))
    counts = materialise(
        told.select("label", F.explode("_words").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"), *[F.count_if(label == x).alias(f"n_{x}") for x in LABELS])
        .filter(F.col("n") >= min_count),
        "term-label-counts",
    )
    terms = counts.select("term", *[_billionths(F.col(f"n_{x}") + 1).alias(f"w_{x}") for x in LABELS])
    sizes = counts.agg(
        F.count(F.lit(1)).alias("vocabulary"),
        *[F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"tokens_{x}") for x in LABELS],
    )
    docs = told.agg(*[F.count_if(label == x).alias(f"docs_{x}") for x in LABELS])
    totals = sizes.crossJoin(F.broadcast(docs)).select(  # two rows of totals
        *[
            _billionths(F.greatest(F.col(f"tokens_{x}") + F.col("vocabulary"), F.lit(1))).alias(f"base_{x}")
            for x in LABELS
        ],
        *[_billionths(F.col(f"docs_{x}") + 1).alias(f"prior_{x}") for x in LABELS],
    )
    return Trained(materialise(terms, "naive-bayes-terms"), materialise(totals, "naive-bayes-totals"))


def classify(
    rows: DataFrame, model: Trained, key: Sequence[str], text: str = "review", limit: int = LIMIT
) -> DataFrame:
    """(key, n_known, prediction, margin) of every row: the best label and how far, in
    billionths of a natural logarithm, it is ahead of the second."""
    key = list(key)
    weights = [f"w_{x}" for x in LABELS]
    sums = price_sums(rows, model.terms.select("term", *weights), key, text, limit).withColumnRenamed("n_hits", "n_known")
    scored = sums.crossJoin(F.broadcast(model.totals))  # one row
    ranked = F.sort_array(
        F.array(
            *[
                F.struct(
                    (F.col(f"w_{x}") + F.col(f"prior_{x}") - F.col("n_known") * F.col(f"base_{x}")).alias("score"),
                    F.lit(-i).alias("order"),
                    F.lit(x).alias("label"),
                )
                for i, x in enumerate(LABELS)
            ]
        ),
        asc=False,
    )
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    return scored.withColumn("_ranked", ranked).select(
        *key, "n_known", best["label"].alias("prediction"), (best["score"] - second["score"]).alias("margin")
    )


def trained_calls(rows: DataFrame, model: Trained, limit: int = LIMIT) -> DataFrame:
    """The model's answers as a call log of the sentiment task, beside those of other
    models; it is scored within the job, so it has no response time and no cost."""
    key = ["dataset", "review_id"]
    asked = rows.select(
        *key, "user_name", "label", count_tokens(F.col("review")).alias("review_tokens")
    )
    answers = classify(rows, model, key, limit=limit).select(*key, F.col("prediction").alias("raw_output"))
    return asked.join(answers, key).select(
        F.lit("sentiment").alias("task"), *key, F.lit(NAME).alias("model"), "user_name", "review_tokens",
        F.lit(0).cast("bigint").alias("input_tokens"), "raw_output",
        F.lit(None).cast("bigint").alias("completion_tokens"), F.lit(0.0).alias("elapsed_s"),
        F.lit(None).cast("string").alias("error"), "label",
    )


def _words(text: str) -> list[str]:
    runs = itertools.groupby(text.lower(), str.isalpha)
    return ["".join(run) for letters, run in runs if letters]


class Client:
    """Answers requests with the whole model at hand; ``known`` is a broadcast variable."""

    def __init__(self, known, base: list[int], prior: list[int]) -> None:
        self.known, self.base, self.prior = known.value, base, prior

    def __call__(self, request: dict) -> tuple[str, int | None]:
        times = Counter(_words(request["review"] or ""))
        weighed = [(k, self.known[t]) for t, k in times.items() if t in self.known]
        n, scores = sum(k for k, _ in weighed), []
        for i in range(len(LABELS)):
            hits = sum(k * weights[i] for k, weights in weighed)
            scores.append(hits + self.prior[i] - n * self.base[i])
        return LABELS[scores.index(max(scores))], None

    def ask_all(self, requests: list[dict]) -> list[tuple[str, int | None]]:
        return [self(request) for request in requests]


def client_factory(model: Trained, limit: int = LIMIT) -> Callable[[str, str, int], Client]:
    """A factory for batch calls whose clients hold the whole model. A model larger than
    ``limit`` is refused: use :func:`classify`, which joins."""
    if (size := table_size(model.terms)) > limit:
        raise ValueError(f"the term table has {size} bytes, more than {limit}")
    spark = model.terms.sparkSession
    known = {r[0]: tuple(r)[1:] for r in model.terms.select("term", *[f"w_{x}" for x in LABELS]).collect()}
    (totals,) = model.totals.collect()
    shared = spark.sparkContext.broadcast(known)
    base, prior = ([totals[f"{part}_{x}"] for x in LABELS] for part in ("base", "prior"))

    def factory(name: str, task: str, max_tokens: int) -> Client:
        return Client(shared, base, prior)

    return factory


def billionths(x: float) -> int:
    """What :func:`train` keeps of ln(x)."""
    return math.floor(math.log(x) * 1e9 + 0.5)
