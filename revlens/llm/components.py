"""Connected components by alternating star contraction, wholly on Spark.

Every round replaces each node's links by links to the smallest node it sees,
first towards larger neighbours, then towards smaller ones, until nothing
changes: a forest of stars whose centres are the smallest nodes. Only (node,
node) pairs are shuffled; a round is written to the shared folder, which also
cuts the lineage, and nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` has two columns of
    one orderable type, without nulls."""
    a, b = links.columns
    state = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    state, seen = materialise(state, "links"), None
    while True:
        mark = state.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if not mark[0] or tuple(mark) == seen:
            break
        seen = tuple(mark)
        state = _small_star(_large_star(state)).filter("a <> b").distinct()
        state = materialise(state, "links")
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
