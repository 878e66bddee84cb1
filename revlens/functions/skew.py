"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def hot_key_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    counts: DataFrame,
    spread: Sequence[str],
    *,
    both_large: bool = False,
    salt: str | None = None,
) -> DataFrame:
    """Left equi join of a large side that has hot keys with a narrower one.

    Rows of a hot key are dealt over several salts by the columns in ``spread`` and
    its ``dim`` rows are repeated once per salt; nothing else is repeated.

    ``counts`` has (on, n_rows): how many fact rows each key has. A key is hot
    when it alone exceeds the mean shuffle partition, and it is dealt over as many
    salts as mean partitions it would fill; only its ``dim`` rows are repeated.
    With P shuffle partitions there are fewer than P hot keys whatever the data,
    which bounds both the repeats and the broadcast that names the hot keys.

    ``both_large`` asks for a sort-merge join: where the sides come from exploded
    text, file sizes say little about row counts and a size-based broadcast would
    be chosen on a wrong estimate.

    ``salt`` keeps the salt under that name: the rows of a key and salt stand together.
    """
    on = list(on)
    parts = max(2, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = counts.agg(F.sum("n_rows")).scalar()
    hot = counts.filter(F.col("n_rows") * F.lit(parts) > total).select(
        *on, F.ceil(F.col("n_rows") * F.lit(parts) / total).cast("int").alias("_salts")
    )
    n_salts = F.coalesce("_salts", F.lit(1))
    left = (
        facts.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), n_salts).cast("int"))
        .drop("_salts")
    )
    right = (
        dim.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
        .drop("_salts")
    )
    if both_large:
        right = right.hint("merge")
    met = left.join(right, [*on, "_salt"], "left")
    return met.withColumnRenamed("_salt", salt) if salt else met.drop("_salt")
