"""The registered query of each operator: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.ann_lsh import EVERY, nearest
from revlens.llm.decontaminate import contamination_report
from revlens.llm.fim_wavelet import fim_report
from revlens.llm.license_scan import license_report
from revlens.llm.line_dedup import line_report
from revlens.llm.merkle_bitmap import manifest_report
from revlens.llm.minhash_bottomk import near_duplicates as similar_sets
from revlens.llm.mixing import corpus_levels, mix
from revlens.llm.pii import pii_report
from revlens.llm.quality_rules import fit_rules, quality
from revlens.llm.simhash_bktree import near_duplicates
from revlens.llm.token_count import token_counts
from revlens.llm.toxicity import fit_model, toxicity
from revlens.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
TOKEN_LIMIT = 1024


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@query
def op2_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


@query
def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs, fit_model(docs, labels))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality(docs, fit_rules(docs, labels))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, corpus_levels()).select(
        "doc_id", "mix_domain", "mix_lang", "mix_source", "n_tokens", "copies"
    )


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_fim_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_report(table(spark, sf_dir, "documents"))


@query
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(table(spark, sf_dir, "documents"))
