"""Classification quality per model in one partial aggregate.

The label set is fixed, so the confusion counts are nine conditional sums. Only
(dataset, model) rows reach the shuffle, whatever the number of calls, and the
weighted scores are arithmetic on that small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import micros, r6
from revlens.sources.catalog import ERROR_LABEL, LABELS


def confusion(scored: DataFrame) -> DataFrame:
    """Counts of (true label, predicted label), predictions as columns."""
    predicted = F.coalesce("prediction", F.lit(ERROR_LABEL))
    return (
        scored.withColumn("prediction", predicted)
        .groupBy("dataset", "model", "label")
        .agg(
            *[
                F.count_if(F.col("prediction") == name).alias(f"pred_{name}")
                for name in (*LABELS, ERROR_LABEL)
            ]
        )
    )


def _zero_if_none(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(
        num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    )


def _weighted(value, support_total: Column) -> Column:
    total = F.lit(0.0)
    for c in LABELS:
        total = total + F.col(f"_support_{c}").cast("double") * value(c)
    return r6(total / support_total.cast("double"))


def class_scores() -> dict[str, Column]:
    """Accuracy and the support-weighted scores from the counts n_reviews, _right,
    _support_<label>, _predicted_<label> and _tp_<label>."""

    def precision(c: str) -> Column:
        return _zero_if_none(F.col(f"_tp_{c}"), F.col(f"_predicted_{c}"))

    def recall(c: str) -> Column:
        return _zero_if_none(F.col(f"_tp_{c}"), F.col(f"_support_{c}"))

    def f1(c: str) -> Column:
        return _zero_if_none(
            F.lit(2) * F.col(f"_tp_{c}"), F.col(f"_predicted_{c}") + F.col(f"_support_{c}")
        )

    n = F.col("n_reviews")
    return {
        "accuracy": r6(F.col("_right").cast("double") / n.cast("double")).alias("accuracy"),
        "f1": _weighted(f1, n).alias("f1"),
        "recall": _weighted(recall, n).alias("recall"),
        "precision": _weighted(precision, n).alias("precision"),
    }


def sentiment_leaderboard(scored: DataFrame) -> DataFrame:
    """Accuracy, support-weighted F1, recall and precision, total time and cost.

    ``scored`` has dataset, model, label, prediction, elapsed_s and cost_usd. A
    failed call counts as a wrong answer.
    """
    label, pred = F.col("label"), F.coalesce("prediction", F.lit(ERROR_LABEL))
    aggs = [
        F.count("*").alias("n_reviews"),
        F.count_if(label == pred).alias("_right"),
        F.sum(micros(F.col("elapsed_s"))).alias("_micro_s"),
        F.sum("cost_usd").alias("_cost"),
    ]
    for c in LABELS:
        aggs += [
            F.count_if(label == c).alias(f"_support_{c}"),
            F.count_if(pred == c).alias(f"_predicted_{c}"),
            F.count_if((label == c) & (pred == c)).alias(f"_tp_{c}"),
        ]
    board = scored.groupBy("dataset", "model").agg(*aggs)

    return board.select(
        "dataset",
        "model",
        "n_reviews",
        *class_scores().values(),
        (F.col("_micro_s") / F.lit(1e6)).alias("total_response_time"),
        F.col("_cost").cast("decimal(24,6)").alias("total_cost"),
    )


def rank_models(board: DataFrame, metric: str = "f1", by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Best model first within each dataset; equal scores share a rank."""
    order = Window.partitionBy(*by).orderBy(F.col(metric).desc())
    return board.withColumn("model_rank", F.rank().over(order).cast("bigint"))


def robustness(board: DataFrame, clean: str = "customer", noisy: str = "noisy") -> DataFrame:
    """Score drop from clean to noisy text per model. The two datasets meet by a
    group on the model, so the leaderboard is computed once and not per side."""
    metrics = ("accuracy", "f1", "recall", "precision")

    def of(dataset: str, metric: str) -> Column:
        return F.max(F.when(F.col("dataset") == dataset, F.col(metric)))

    sides = board.groupBy("model").agg(
        *[of(clean, m).alias(f"{m}_clean") for m in metrics],
        *[of(noisy, m).alias(f"{m}_noisy") for m in metrics],
    )
    drops = {f"{m}_drop": r6(F.col(f"{m}_clean") - F.col(f"{m}_noisy")) for m in metrics}
    return sides.withColumns(drops)
