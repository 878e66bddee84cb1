"""Prompts, chat messages and input token counts, built once per review.

The prompt does not depend on the model, so it is rendered and counted before
the fan-out; only its count travels with the seven call rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import WS_CHARS, count_tokens
from revlens.sources import prompts
from revlens.sources.catalog import MODEL_NAMES, MODELS, fan_out, per_model


def _isolated(parts: list[tuple[str, str]]) -> bool:
    """True when white space (or an end) separates every placeholder from its
    neighbours, so that token counts of the parts add up."""
    for i, (kind, _) in enumerate(parts):
        if kind != "column":
            continue
        before = parts[i - 1][1] if i and parts[i - 1][0] == "text" else None
        after = parts[i + 1][1] if i + 1 < len(parts) and parts[i + 1][0] == "text" else None
        if i and (before is None or before[-1] not in WS_CHARS):
            return False
        if i + 1 < len(parts) and (after is None or after[0] not in WS_CHARS):
            return False
    return True


TokenCounter = Callable[[Column], Column]


def prompt_tokens(template: str, counter: TokenCounter = count_tokens) -> Column:
    """Tokens of the rendered prompt. ``counter`` is any function from a text column to a
    count (a subword vocabulary's, say); white-space tokens are counted by default and
    then, where that is exact, part by part."""
    parts = prompts.pieces(template)
    if counter is not count_tokens or not _isolated(parts):
        return counter(prompts.render(template))
    fixed = sum(len(v.split()) for kind, v in parts if kind == "text")
    total = F.lit(fixed).cast("bigint")
    for kind, v in parts:
        if kind == "column":
            total = total + count_tokens(F.col(v))
    return total


def with_prompt(rows: DataFrame, task: str, version: int = 1) -> DataFrame:
    template = prompts.TEMPLATES[(task, version)]
    return rows.withColumn("task", F.lit(task)).withColumn("prompt", prompts.render(template))


def requests(
    rows: DataFrame,
    task: str,
    version: int = 1,
    models: tuple[str, ...] = MODEL_NAMES,
    counter: TokenCounter = count_tokens,
) -> DataFrame:
    """One request per (row, model) with its prompt and input token count."""
    template = prompts.TEMPLATES[(task, version)]
    ready = with_prompt(rows, task, version).select(
        "task", "dataset", "review_id", "user_name", "review", "prompt",
        counter(F.col("review")).alias("review_tokens"),
        prompt_tokens(template, counter).alias("input_tokens"),
        *[c for c in ("label",) if c in rows.columns],
    )
    return fan_out(ready, models)


def messages(reqs: DataFrame) -> DataFrame:
    """The chat messages a provider receives, by its chat style: one user message,
    one system message, or the prompt as system plus the review as user."""

    def message(role: str, content: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    style = per_model("chat_style", MODELS)
    return reqs.withColumn(
        "messages",
        F.when(style == "system", F.array(message("system", "prompt")))
        .when(
            style == "system_user",
            F.array(message("system", "prompt"), message("user", "review")),
        )
        .otherwise(F.array(message("user", "prompt"))),
    )
