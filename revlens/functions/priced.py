"""Sums of word prices over texts, with a table of prices of any size.

A table whose measured size allows is broadcast: words are exploded, meet their prices and
are summed in the task that read them, so that a row per text is shuffled. Beyond that,
texts are dealt to blocks, the different words of a block meet the table once, and the
block's texts are summed by the prices that came back. No row per word is shuffled but
those; a frequent word is one row a block. Both give the same sums, which are whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revlens.functions.arrays import word_ids
from revlens.functions.text import words

#: Characters of the texts that are summed together where the table is not broadcast.
BLOCK_CHARS = 6_000_000


def table_size(prices: DataFrame) -> int:
    """Bytes of (term, prices) as a hash table, about."""
    per_row = F.octet_length("term") + F.lit(8 * (len(prices.columns) - 1) + 32)
    return prices.agg(F.sum(per_row.cast("bigint"))).first()[0] or 0


def price_sums(
    texts: DataFrame,
    prices: DataFrame,
    key: Sequence[str],
    text: str,
    limit: int,
    near: Sequence[str] | None = None,
) -> DataFrame:
    """(key, n_hits, the sum of each price column) for every key. ``prices`` has (term, and
    bigint columns that are null together); an occurrence of a word with a price is a hit.
    ``near``: columns of the key in which texts of one origin, with the same words, agree."""
    key, values = list(key), [c for c in prices.columns if c != "term"]
    known = prices.filter(F.col("term").isNotNull() & F.col(values[0]).isNotNull())
    if table_size(prices) <= limit:
        each = texts.select(*key, F.explode_outer(words(F.col(text))).alias("term"))
        met = each.join(F.broadcast(known), "term", "left")
        hits = F.count(values[0])
    else:
        met = _in_blocks(texts, known, key, values, text, list(near or key))
        hits = F.sum("n_hits")
    return met.groupBy(*key).agg(
        hits.alias("n_hits"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values]
    )


def _in_blocks(
    texts: DataFrame, prices: DataFrame, key: list[str], values: list[str], text: str, near: list[str]
) -> DataFrame:
    """(key, n_hits, sums) of every row."""
    total = texts.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    blocks = F.lit(max(1, -(-total // BLOCK_CHARS)))
    told = words(F.coalesce(F.col(text), F.lit("")))
    dealt = F.pmod(F.xxhash64(*near), blocks).alias("_block")
    used = (
        texts.select(dealt, F.array_distinct(told).alias("_terms"))
        .repartition("_block")  # the distinct words of a block are counted where its texts are
        .select("_block", F.explode("_terms").alias("term"))
        .distinct()
    )
    # a term that stands in the table more than once counts as often
    once = prices.groupBy("term").agg(F.count("*").alias("_times"), *[F.sum(c).alias(c) for c in values])
    met = used.join(once, "term").select(
        F.col("_block").alias("_of"), F.xxhash64("term").alias("_term"), "_times", *values
    )
    ready = texts.select(dealt, *key, word_ids(told).alias("_ids"))
    schema = StructType(
        [*ready.select(*key).schema.fields, *[StructField(c, LongType()) for c in ("n_hits", *values)]]
    )
    both = ready.groupBy("_block").cogroup(met.groupBy("_of"))
    return both.applyInArrow(_block_sums(key, values), schema)


def _block_sums(key: list[str], values: list[str]):
    def run(told: pa.Table, prices: pa.Table) -> pa.Table:
        told, prices = told.combine_chunks(), prices.combine_chunks()
        out = told.select(key)
        ids = prices["_term"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        flat, ends = np.empty(0, np.int64), np.empty(0, np.int64)
        if told.num_rows:
            lists = told["_ids"].combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        place = np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
        found = ids[place] == flat if len(ids) else np.zeros(len(flat), bool)
        for name, column in zip(("n_hits", *values), ("_times", *values), strict=True):
            worth = np.zeros(len(flat), np.int64)
            if len(ids):
                worth[found] = prices[column].to_numpy()[order][place[found]]
            upto = np.concatenate([[0], np.cumsum(worth)])
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            out = out.append_column(name, pa.array(upto[ends] - upto[starts], pa.int64()))
        return out

    return run
