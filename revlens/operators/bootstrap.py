"""Error bars of leaderboards by a Poisson bootstrap in one pass.

Each row counts in each replicate as often as a Poisson draw of mean one says. The
draws follow from a digest of the row's key, so they are the same on any partitioning
and for all models that answered it: models are compared on the same resampled
reviews. The confusion counts of all replicates are one aggregate with an array of
sums; what reaches a shuffle is a row for each (dataset, model, label, prediction).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.arrays import let
from revlens.functions.numeric import r6
from revlens.operators.classification import class_scores
from revlens.sources.catalog import ERROR_LABEL, LABELS

REPLICATES = 96
#: Draws of 16 bits in one sha256.
PER_DIGEST = 16
#: A draw of 16 bits counts as many times as there are thresholds at or below it.
THRESHOLDS = tuple(
    round(2**16 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)
)
#: Order statistics left out at either end: 2 of 96 leave about 95 %.
TAIL = 2


def weights(key: list[Column], replicates: int = REPLICATES) -> Column:
    """array<bigint>: how often the row of ``key`` counts in each replicate."""

    def draws(block: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit("boot"), *[k.cast("string") for k in key], block.cast("string")), 256)
        return let(
            digest,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(PER_DIGEST - 1)),
                lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"),
            ),
        )

    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // PER_DIGEST) - 1))
    times = lambda u: sum(((u >= t).cast("bigint") for t in THRESHOLDS[1:]), (u >= THRESHOLDS[0]).cast("bigint"))
    return F.slice(F.transform(F.flatten(F.transform(blocks, draws)), times), 1, replicates)


def replicate_scores(scored: DataFrame, key: list[str], replicates: int = REPLICATES) -> DataFrame:
    """(dataset, model, replicate, f1): replicate 0 is the sample as it is."""
    cell = ["dataset", "model", "label", "prediction"]
    rows = scored.select(
        *cell[:3], F.coalesce("prediction", F.lit(ERROR_LABEL)).alias("prediction"),
        weights([F.col(k) for k in key], replicates).alias("_w"),
    )
    sums = [F.sum(F.get("_w", F.lit(i))).alias(f"_{i + 1}") for i in range(replicates)]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_0"), *sums)
    each = cells.select(
        *cell, F.posexplode(F.array(*[f"_{i}" for i in range(replicates + 1)])).alias("replicate", "n")
    )
    label, pred, n = F.col("label"), F.col("prediction"), F.col("n")

    def total(rows: Column) -> Column:
        return F.sum(F.when(rows, n).otherwise(0))

    aggs = [F.sum("n").alias("n_reviews"), total(label == pred).alias("_right")]
    for c in LABELS:
        aggs += [
            total(label == c).alias(f"_support_{c}"),
            total(pred == c).alias(f"_predicted_{c}"),
            total((label == c) & (pred == c)).alias(f"_tp_{c}"),
        ]
    counts = each.groupBy("dataset", "model", "replicate").agg(*aggs)
    return counts.filter("n_reviews > 0").select("dataset", "model", "replicate", class_scores()["f1"])


def rank_intervals(scored: DataFrame, key: list[str], replicates: int = REPLICATES, tail: int = TAIL) -> DataFrame:
    """Per (dataset, model) the F1 and the rank of the sample, what they lie between in
    all replicates but ``tail`` at either end, and the share of replicates it leads."""
    order = Window.partitionBy("dataset", "replicate").orderBy(F.col("f1").desc())
    ranked = replicate_scores(scored, key, replicates).withColumn("place", F.rank().over(order))
    drawn = F.col("replicate") > 0

    def between(values: Column, name: str) -> list[Column]:
        listed = F.sort_array(F.collect_list(F.when(drawn, values)))
        return [
            F.get(listed, F.least(F.lit(tail), F.size(listed) - 1)).alias(f"{name}_low"),
            F.get(listed, F.greatest(F.size(listed) - 1 - tail, F.lit(0))).alias(f"{name}_high"),
        ]

    led = F.count_if(drawn & (F.col("place") == 1)).cast("double")
    return ranked.groupBy("dataset", "model").agg(
        F.max(F.when(~drawn, F.col("f1"))).alias("f1"), *between(F.col("f1"), "f1"),
        F.max(F.when(~drawn, F.col("place"))).alias("model_rank"), *between(F.col("place"), "rank"),
        r6(led / F.count_if(drawn).cast("double")).alias("leads"),
    )
