"""From raw model output to a clean, validated and priced call."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas
from revlens.functions.text import count_tokens, strip
from revlens.sources.catalog import ERROR_LABEL, LABELS, TASKS, UNSUPPORTED

LOWERED_TASKS = tuple(t.task for t in TASKS if t.lower_output)


def clean_output(lower_responses_of: tuple[str, ...] = ()) -> Column:
    """Strip; lower-case for the tasks that ask for it, and for the responses of
    any model listed (the end-to-end report lowers one model's replies)."""
    stripped = strip(F.col("raw_output"))
    lowered = F.col("task").isin(*LOWERED_TASKS)
    if lower_responses_of:
        lowered = lowered | F.col("model").isin(*lower_responses_of)
    return F.when(lowered, F.lower(stripped)).otherwise(stripped)


def with_output(calls: DataFrame, lower_responses_of: tuple[str, ...] = ()) -> DataFrame:
    return calls.withColumn("output", clean_output(lower_responses_of))


def price(calls: DataFrame, models: DataFrame) -> DataFrame:
    """Output tokens and cost per call. ``calls`` has ``output``.

    Tokens times USD per million tokens is the cost in micro-USD, so the sum is
    exact in decimals; it is rounded half-even to whole micro-USD per call and
    also kept unrounded. An unknown model becomes an error row without cost.
    """
    dim = models.select("model", "price_in", "price_out", "output_count")
    joined = calls.join(F.broadcast(dim), "model", "left")
    unknown = F.col("price_in").isNull()
    counted = F.when(F.col("output_count") == "raw", count_tokens(F.col("raw_output"))).otherwise(
        count_tokens(F.col("output"))
    )
    failed = unknown | F.col("error").isNotNull()
    joined = joined.withColumn(
        "output_tokens", F.when(~failed, F.coalesce("completion_tokens", counted))
    )
    micro = (
        F.col("input_tokens").cast("decimal(14,0)") * F.col("price_in")
        + F.col("output_tokens").cast("decimal(14,0)") * F.col("price_out")
    )
    to_usd = F.lit(Decimal("0.000001"))
    return (
        joined.withColumn("_micro", F.when(~failed, micro).otherwise(F.lit(Decimal(0))))
        .withColumn(
            "cost_usd",
            (F.bround(F.col("_micro"), 0).cast("decimal(18,0)") * to_usd).cast("decimal(18,6)"),
        )
        .withColumn("cost_exact", (F.col("_micro") * to_usd).cast("decimal(28,10)"))
        .withColumn("elapsed_s", F.when(failed, 0.0).otherwise(F.col("elapsed_s")))
        .withColumn("error", F.when(unknown, UNSUPPORTED).otherwise(F.col("error")))
        .drop("_micro", "price_in", "price_out", "output_count")
    )


def validate_sentiment(output: Column) -> tuple[Column, Column]:
    """(label, ambiguous): the first of positive, negative, neutral that occurs in
    the output, else the error label; ambiguous when more than one occurs."""
    text = F.lower(output)
    found = [F.contains(text, F.lit(label)) for label in LABELS]
    label = F.coalesce(
        *[F.when(hit, name) for hit, name in zip(found, LABELS)], F.lit(ERROR_LABEL)
    )
    hits = sum((hit.cast("int") for hit in found[1:]), found[0].cast("int"))
    return label, F.coalesce(hits > 1, F.lit(False))


def with_sentiment(calls: DataFrame) -> DataFrame:
    label, ambiguous = validate_sentiment(F.col("output"))
    return calls.withColumn("prediction", label).withColumn("ambiguous", ambiguous)


def legacy_error_as_output(calls: DataFrame) -> DataFrame:
    """The view in which an error message stands in the output column."""
    return calls.withColumn("output", F.coalesce("error", "output"))


def parse_chat_response(calls: DataFrame, body: str = "body") -> DataFrame:
    """Text and token usage of a JSON chat response; malformed bodies become errors."""
    parsed = calls.withColumn("_r", F.from_json(F.col(body), schemas.CHAT_RESPONSE))
    content = F.get(F.col("_r.choices"), F.lit(0))["message"]["content"]
    return (
        parsed.withColumn("raw_output", content)
        .withColumn("completion_tokens", F.col("_r.usage.completion_tokens"))
        .withColumn("error", F.when(content.isNull(), F.lit("malformed response")))
        .drop("_r", body)
    )


def compression_ratio(text_tokens: Column, output: Column) -> Column:
    """Words of the text over words of the output; null for an empty output."""
    return text_tokens.cast("double") / F.nullif(
        count_tokens(output).cast("double"), F.lit(0.0)
    )


def alignment(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("bigint")
