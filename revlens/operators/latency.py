"""Response times as mergeable quantile sketches beside the call log.

A sketch counts values in buckets whose bounds grow by a fixed factor, so any quantile
of any number of calls is known to within ``ACCURACY`` (a relative error), and two
sketches are merged by adding their counts. Each file of the log gets its sketch once:
:func:`update_sketches` reads only the files that came since the last time, so the cost
of a leaderboard of times does not grow with the age of the log, and a rerun after a
lost job repeats nothing.

Failed calls have no time and do not count; times of zero have a bucket of their own.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens import schemas
from revlens.functions.numeric import r6
from revlens.operators.infer import read_log
from revlens.session import materialise

ACCURACY = 0.01
GROWTH = (1 + ACCURACY) / (1 - ACCURACY)
#: The bucket of zero stands before all others.
ZERO = -(2**31)
SKETCH = "file string, task string, model string, bucket bigint, n bigint"


def bucket(value: Column) -> Column:
    return F.when(value <= 0, F.lit(ZERO).cast("bigint")).otherwise(
        F.ceil(F.log(value) / F.lit(math.log(GROWTH)))
    )


def value_of(bucket: Column) -> Column:
    """The value that is within the accuracy of all of a bucket's."""
    middle = F.lit(2.0) * F.pow(F.lit(GROWTH), bucket.cast("double")) / F.lit(GROWTH + 1)
    return F.when(bucket == ZERO, 0.0).otherwise(middle)


def sketch(calls: DataFrame, by: list[str], value: str = "elapsed_s") -> DataFrame:
    """(by, bucket, n) of the finished calls."""
    done = calls.filter(F.col("error").isNull() & F.col(value).isNotNull())
    return done.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(by, n_calls, p<percent>..) from merged sketches; a sketch has a bucket for each
    factor of GROWTH, some hundreds at most."""
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("bucket"))
    rows = sketches.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))

    def at(share: float) -> Column:
        rank = F.floor(F.lit(share) * (F.col("total") - 1))
        return F.min(F.when(F.col("upto") > rank, F.col("bucket")))

    found = rows.groupBy(*by).agg(
        F.max("total").alias("n_calls"), *[at(s).alias(f"_{i}") for i, s in enumerate(shares)]
    )
    return found.select(
        *by, "n_calls",
        *[r6(value_of(F.col(f"_{i}"))).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)],
    )


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of the log at ``path``, a set of rows for each of its files."""
    spark.createDataFrame([], SKETCH).write.mode("append").parquet(f"{path}-latency")
    return spark.read.schema(SKETCH).parquet(f"{path}-latency")


def update_sketches(spark: SparkSession, path: str) -> int:
    """Add the sketches of the log's new files; returns how many there were. A file
    without finished calls has one row without a bucket, so it is not read again."""
    known = {r.file for r in read_sketches(spark, path).select("file").distinct().collect()}
    files = [unquote(f) for f in read_log(spark, path).inputFiles()]  # they come as URIs
    new = [f for f in files if f.rsplit("/", 1)[1] not in known]
    if new:
        calls = spark.read.schema(schemas.CALL_LOG).option("basePath", path).parquet(*new)
        calls = calls.withColumn("file", F.col("_metadata.file_name"))
        # written first: the files without rows are told from it, and the log is read once
        rows = materialise(sketch(calls, ["file", "task", "model"]), "sketches")
        empty = spark.createDataFrame([(f.rsplit("/", 1)[1],) for f in new], "file string").join(
            rows.select("file"), "file", "left_anti"
        )
        nothing = F.lit(None)
        empty = empty.select(
            "file", nothing.cast("string").alias("task"), nothing.cast("string").alias("model"),
            nothing.cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("n"),
        )
        rows.unionByName(empty).write.mode("append").parquet(f"{path}-latency")
    return len(new)


def latency_of_log(spark: SparkSession, path: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(task, model, n_calls, p50, p90, p99) of the log, from its sketches alone."""
    update_sketches(spark, path)
    by = ["task", "model"]
    return quantiles(merged(read_sketches(spark, path).filter("bucket is not null"), by), by, shares)
