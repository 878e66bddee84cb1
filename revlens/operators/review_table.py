"""The review table as it grows: keyed upserts of landed batches, and bucketed logs.

:class:`ReviewTable` keeps reviews in buckets by a hash of their id. A batch is merged
into the buckets it touches; of rows with one key the newer date stays, of equal dates
the later batch. Merged buckets are written beside the old ones, and one appended
manifest row for each makes them current: a job that is lost half way leaves nothing
that a reader sees, and a batch whose name is in the manifest is not merged again.
Within a bucket the newest reviews stand first. One review is looked up in one bucket.

A bucket is written by one task, so ``buckets`` should grow with the table (one for
some hundred thousand reviews). Rows without an id are refused: unify gives them one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import schemas
from revlens.session import new_table_path

KEY = ("platform", "review_id")
BUCKETS = 16
MANIFEST = "version bigint, batch string, bucket int"


class ReviewTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, review_id: Column) -> Column:
        return F.pmod(F.xxhash64(review_id), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> DataFrame:
        path = f"{self.path}/manifest"
        self.spark.createDataFrame([], MANIFEST).write.mode("append").parquet(path)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def _current(self) -> dict[int, int]:
        """The version of each bucket that has rows; as many entries as buckets at most."""
        newest = self._manifest().filter("bucket is not null").groupBy("bucket").agg(F.max("version"))
        return {bucket: version for bucket, version in newest.collect()}

    def _read(self, buckets: dict[int, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], schemas.REVIEWS)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(buckets.items())]
        return self.spark.read.schema(schemas.REVIEWS).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self._current())

    def rows_of(self, review_id: int) -> DataFrame:
        """The rows of one review, from the one bucket that can hold them."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(review_id).cast("bigint"))).first()[0]
        held = {b: v for b, v in self._current().items() if b == bucket}
        return self._read(held).filter(F.col("review_id") == review_id)

    def merge(self, batch: DataFrame, name: str) -> bool:
        """Upsert the batch; False if a batch of that name was merged before."""
        done = self._manifest().agg(
            F.coalesce(F.max("version"), F.lit(0)), F.coalesce(F.max(F.col("batch") == name), F.lit(False))
        ).first()
        if done[1]:
            return False
        version, columns = done[0] + 1, [c.split()[0] for c in schemas.REVIEWS.split(", ")]
        landed = batch.select(*columns).withColumn("bucket", self._bucket(F.col("review_id")))
        if not landed.filter("review_id is null").isEmpty():
            raise ValueError("a review without an id")
        touched = [r.bucket for r in landed.select("bucket").distinct().collect()]
        old = self._read({b: v for b, v in self._current().items() if b in set(touched)})
        both = old.withColumn("_batch", F.lit(0)).unionByName(landed.drop("bucket").withColumn("_batch", F.lit(1)))
        rest = [c for c in columns if c not in KEY and c != "date"]
        # dates first: of a key the newest row is the largest; a row without a date is the oldest
        row = F.struct("date", "_batch", *rest)
        merged = both.groupBy(*KEY).agg(F.max(row).alias("_row"))
        merged = merged.select(*[F.col(c if c in KEY else f"_row.{c}").alias(c) for c in columns])
        (
            merged.withColumn("bucket", self._bucket(F.col("review_id")))
            .repartition(self.buckets, "bucket")
            .sortWithinPartitions("bucket", F.col("date").desc(), "review_id")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.path}/data/version={version}")
        )
        rows = [(version, name, b) for b in touched] or [(version, name, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return True


def bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``: joins and aggregates of such
    tables on these keys need no shuffle. One file to a bucket."""
    spark = df.sparkSession
    table = f"revlens_{name}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", new_table_path(spark, name))
        .format("parquet")
        .saveAsTable(table)
    )
    return spark.table(table)
