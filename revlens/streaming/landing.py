"""Store exports that keep arriving as files, unified as they land.

The same column work as the batch job, on a file stream: each run takes the files
that are new since the last one, appends them to the review table and stops. The
checkpoint makes a rerun after a failure neither lose nor repeat a file.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from revlens import schemas
from revlens.operators.unify import unify_appstore, unify_google

STORES = {
    "google": (schemas.RAW_GOOGLE, unify_google),
    "appstore": (schemas.RAW_APPSTORE, unify_appstore),
}


def stream_reviews(
    spark: SparkSession,
    source: str,
    store: str,
    target: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    schema, unified = STORES[store]
    raw = spark.readStream.schema(schema).format(fmt).load(source)
    return (
        unified(raw)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("platform")
        .trigger(availableNow=True)
        .start()
    )
