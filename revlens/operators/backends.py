"""A deterministic stand-in for model endpoints.

Its answers are a pure function of (task, dataset, model, review) and exist so
that the pipeline can be run and checked without a provider. Scores computed
from them describe this stand-in and say nothing about any vendor's model.

Two forms give the same answers: column expressions (:func:`offline_calls`) and
a Python callable for the batch operator (:func:`python_backend`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.arrays import let
from revlens.functions.hashing import h32
from revlens.functions.text import count_tokens, strip, tokens
from revlens.operators.prompting import prompt_tokens
from revlens.sources import prompts
from revlens.sources.corpus import SENTENCE_END, sentences
from revlens.sources.catalog import (
    LABELS,
    MODEL_NAMES,
    MODELS,
    fan_out,
)

# Fixed values of the stand-in: percent of right answers per model, and how many
# points noise takes off.
SKILL = {
    "OpenAI GPT-4o": 92,
    "Claude 3.7 Sonnet": 90,
    "Gemini 2.0 Flash": 85,
    "DeepSeek V3": 88,
    "LLaMA 3.3 70B": 80,
    "Mistral Large": 83,
    "Grok 2": 86,
}
DEFAULT_SKILL = 50
NOISE_PENALTY = 15
BACKEND_ERROR = "backend timeout"
NO_OPINION = "no clear opinion"
REPORTED = tuple(m.model for m in MODELS if m.output_count == "reported")


def _skill() -> Column:
    expr = F.lit(DEFAULT_SKILL)
    for name, points in SKILL.items():
        expr = F.when(F.col("model") == name, points).otherwise(expr)
    return expr - F.when(F.col("dataset") == "noisy", NOISE_PENALTY).otherwise(0)


def _label(index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LABELS]), index.cast("int"))


def _sentiment(h: Column) -> Column:
    known = F.col("label")
    place = F.array_position(F.array(*[F.lit(x) for x in LABELS]), known) - 1
    base = (
        F.when(known.isNull(), _label(h % 3))
        .when(h % 100 < _skill(), known)
        .otherwise(_label((place + 1 + h % 2) % 3))
    )
    return (
        F.when(h % 50 == 7, NO_OPINION)
        .when(h % 41 == 5, F.concat(base, F.lit(" rather than "), _label(h % 3)))
        .when(h % 3 == 0, F.concat(F.lit("  "), F.initcap(base), F.lit(".\n")))
        .when(h % 3 == 1, F.concat(F.lit("Sentiment: "), F.upper(base), F.lit("!")))
        .otherwise(base)
    )


def _quoted(h: Column, extra: Column) -> Column:
    """One whole sentence of the review, or two in reading order; empty without any."""

    def of(s: Column) -> Column:
        one, two = h % F.size(s), (h + extra) % F.size(s)
        places = F.array_distinct(F.array(F.least(one, two), F.greatest(one, two)))
        return F.array_join(F.transform(places, lambda i: strip(F.get(s, i.cast("int")))), ". ")

    return F.when(F.size("_sentences") > 0, let(F.col("_sentences"), of)).otherwise("")


def _summary(h: Column) -> Column:
    return F.concat(F.lit(" "), _quoted(h, h % 3), F.lit("\n"))


def _response(h: Column) -> Column:
    return F.concat(
        F.lit("Dear "), F.col("user_name"), F.lit(", thank you. "),
        _quoted(h, h % 2), F.lit("  "),
    )


def offline_calls(
    rows: DataFrame,
    task: str,
    version: int = 1,
    models: tuple[str, ...] = MODEL_NAMES,
) -> DataFrame:
    """The call log of one task over ``rows`` (dataset, review_id, user_name,
    review and, for sentiment, label), without leaving the JVM."""
    template = prompts.TEMPLATES[(task, version)]
    extra = ["label"] if "label" in rows.columns else []
    ready = rows.select(
        F.lit(task).alias("task"), "dataset", "review_id", "user_name", *extra,
        count_tokens(F.col("review")).alias("review_tokens"),
        *([] if task == "sentiment" else [sentences(F.col("review")).alias("_sentences")]),
        prompt_tokens(template).alias("input_tokens"),
    )
    calls = fan_out(ready, models).withColumn(
        "_h", h32(F.col("task"), F.col("dataset"), F.col("model"), F.col("review_id"))
    )
    h = F.col("_h")
    failed = h % 97 == 3
    answer = {
        "sentiment": lambda: _sentiment(h),
        "summary": lambda: _summary(h),
        "response": lambda: _response(h),
    }[task]()
    calls = calls.withColumn("raw_output", F.when(~failed, answer))
    return calls.select(
        "task", "dataset", "review_id", "model", "user_name", "review_tokens", "input_tokens",
        "raw_output",
        F.when(
            F.col("model").isin(*REPORTED) & ~failed,
            F.size(tokens(F.col("raw_output"))) + 2,
        ).cast("bigint").alias("completion_tokens"),
        F.when(failed, 0.0).otherwise((100 + h % 900) / F.lit(1000.0)).alias("elapsed_s"),
        F.when(failed, BACKEND_ERROR).alias("error"),
        *extra,
    )


def _answer(task: str, key: str, model: str, dataset: str, row: dict) -> str:
    h = int(hashlib.md5(key.encode()).hexdigest()[:8], 16)
    if h % 97 == 3:
        raise TimeoutError(BACKEND_ERROR)
    if task == "sentiment":
        label = row.get("label")
        skill = SKILL.get(model, DEFAULT_SKILL) - (NOISE_PENALTY if dataset == "noisy" else 0)
        if label is None:
            base = LABELS[h % 3]
        elif h % 100 < skill:
            base = label
        else:
            base = LABELS[(LABELS.index(label) + 1 + h % 2) % 3]
        if h % 50 == 7:
            return NO_OPINION
        if h % 41 == 5:
            return f"{base} rather than {LABELS[h % 3]}"
        return (f"  {base.capitalize()}.\n", f"Sentiment: {base.upper()}!", base)[h % 3]
    told = [s for s in re.split(SENTENCE_END, row["review"]) if s.split()]
    places = {h % len(told), (h + h % (3 if task == "summary" else 2)) % len(told)} if told else ()
    picked = ". ".join(told[i].strip() for i in sorted(places))
    if task == "summary":
        return f" {picked}\n"
    return f"Dear {row['user_name']}, thank you. {picked}  "


def python_backend(model: str, task: str, max_tokens: int) -> Callable[[pd.Series], tuple]:
    """A client for one model, as the batch operator expects it: a callable from
    a request row to (text, completion tokens or None)."""

    def call(row: pd.Series) -> tuple[str, int | None]:
        data = {k: (None if pd.isna(v) else v) for k, v in row.items()}
        key = f"{task}:{data['dataset']}:{model}:{data['review_id']}"
        text = _answer(task, key, model, data["dataset"], data)
        return text, len(text.split()) + 2 if model in REPORTED else None

    return call
