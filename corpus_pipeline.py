"""A corpus in five stages: toxic documents out, repeated lines out, near-duplicates
out, benchmark passages out, and the rest mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm.decontaminate import drop_contaminated
from revlens.llm.line_dedup import dedup_lines
from revlens.llm.mixing import corpus_levels, mix
from revlens.llm.queries import table
from revlens.llm.simhash_bktree import keep_one
from revlens.llm.toxicity import drop_rejected, fit_model
from revlens.session import materialise, ship_package

#: Bytes of rows that go to a Python worker at once. Each batch is held several times, by
#: the executor (which keeps the memory) and by its workers, and rows bring whole texts.
BATCH_BYTES = 4 * 2**20

# Toxicity, SimHash and mixing read texts in ways that SQL cannot express together.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; it learns from the
    labelled ones among them."""
    return drop_rejected(docs, fit_model(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, corpus_levels())


def _shipped(stage: Callable) -> Callable:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("line_dedup", _shipped(drop_repeated_lines)),
    ("simhash_near_dedup", _shipped(drop_near_duplicates)),
    ("benchmark_decontamination", _shipped(drop_benchmark)),
    ("mixing", _shipped(mix_sources)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
