"""The model and task dimensions: small, declared in code, never derived from data."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas


@dataclass(frozen=True)
class Model:
    """One model. ``output_count`` says where output tokens come from: 'reported'
    by the provider, or counted here on the 'clean' or the 'raw' output."""

    model: str
    price_in: Decimal
    price_out: Decimal
    pace_seconds: float
    output_count: str
    chat_style: str

    def row(self) -> tuple:
        return (
            self.model, self.price_in, self.price_out,
            self.pace_seconds, self.output_count, self.chat_style,
        )


@dataclass(frozen=True)
class Task:
    task: str
    max_tokens: int
    temperature: float
    lower_output: bool


# Model names, list prices in USD per million tokens (input,
# output), the pause between two calls, and output budgets per task.
MODELS: tuple[Model, ...] = (
    Model("OpenAI GPT-4o", Decimal("2.50"), Decimal("10.00"), 0.0, "reported", "system"),
    Model("Claude 3.7 Sonnet", Decimal("3.00"), Decimal("15.00"), 0.0, "raw", "user"),
    Model("Gemini 2.0 Flash", Decimal("0.10"), Decimal("0.40"), 0.0, "clean", "user"),
    Model("DeepSeek V3", Decimal("0.27"), Decimal("1.10"), 0.0, "reported", "system_user"),
    Model("LLaMA 3.3 70B", Decimal("2.80"), Decimal("2.80"), 0.0, "clean", "user"),
    Model("Mistral Large", Decimal("2.00"), Decimal("6.00"), 2.0, "clean", "user"),
    Model("Grok 2", Decimal("2.00"), Decimal("10.00"), 0.0, "reported", "system_user"),
)
TASKS: tuple[Task, ...] = (
    Task("sentiment", 10, 0.0, True),
    Task("summary", 50, 0.0, True),
    Task("response", 150, 0.0, False),
)
LABELS = ("positive", "negative", "neutral")
ERROR_LABEL = "error"
NO_REFERENCE = "No reference available"
UNSUPPORTED = "Unsupported model"

MODEL_NAMES = tuple(m.model for m in MODELS)
TASK_BY_NAME = {t.task: t for t in TASKS}


def models_table(spark: SparkSession, models: tuple[Model, ...] = MODELS) -> DataFrame:
    """The pricing dimension. Its size is the length of a tuple in code."""
    return spark.createDataFrame([m.row() for m in models], schemas.MODELS)


def tasks_table(spark: SparkSession, tasks: tuple[Task, ...] = TASKS) -> DataFrame:
    rows = [(t.task, t.max_tokens, t.temperature, t.lower_output) for t in tasks]
    return spark.createDataFrame(rows, schemas.TASKS)


def fan_out(df: DataFrame, models: tuple[str, ...] = MODEL_NAMES) -> DataFrame:
    """Every row once per model, as a generator over a literal array: no join,
    no shuffle, and nothing is broadcast."""
    return df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def per_model(column: str, models: tuple[Model, ...] = MODELS) -> Column:
    """A catalogue attribute as a CASE over the model name (null when unknown)."""
    expr = F.lit(None)
    for m in reversed(models):
        expr = F.when(F.col("model") == m.model, F.lit(getattr(m, column))).otherwise(expr)
    return expr
