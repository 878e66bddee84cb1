"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest table, in bytes of its values, that is sent to every executor.
BROADCAST_BYTES = 16 * 2**20
ROW_BYTES = 64


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of ``df`` (a written table) is within ``limit``."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(ROW_BYTES)
    for t in texts:
        size = size + F.coalesce(t, F.lit(0))
    for c, kind in df.dtypes:
        if kind == "array<string>":
            size = size + F.coalesce(F.octet_length(F.concat_ws(" ", c)) + 8 * F.size(c), F.lit(0))
    return (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) with a broadcast hint where its measured size is
    within ``limit``, else as it is, for a shuffled join. Both give the same rows."""
    return F.broadcast(df) if is_small(df, limit) else df
