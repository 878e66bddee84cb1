"""Landed review exports of the two stores, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas

FORMATS = ("parquet", "json", "csv", "orc")


def _read(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.format(fmt).load(path)


def read_google(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    lang: str | None = None,
    country: str | None = None,
) -> DataFrame:
    """Play store export; the optional filters reach the file scan."""
    df = _read(spark, path, fmt, schemas.RAW_GOOGLE)
    if lang is not None:
        df = df.filter(F.col("lang") == lang)
    if country is not None:
        df = df.filter(F.col("country") == country)
    return df


def read_appstore(
    spark: SparkSession, path: str, fmt: str = "parquet", country: str | None = None
) -> DataFrame:
    df = _read(spark, path, fmt, schemas.RAW_APPSTORE)
    return df if country is None else df.filter(F.col("country") == country)


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """A declared total order for exports that promise 'newest first'."""
    return df.orderBy(F.col(ts).desc(), F.col(tie))
