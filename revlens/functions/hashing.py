"""Deterministic draws from md5, equal on every engine that has md5."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def h32(*parts: Column) -> Column:
    """First eight hex digits of md5('a:b:c') as a non-negative bigint."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


@F.arrow_udf(ArrayType(LongType()))
def h32s(texts: pa.Array) -> pa.Array:
    """:func:`h32` of every text of a list, worked out once for each different text of a batch."""
    lengths = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    told = texts.flatten().dictionary_encode()
    draws = [int(hashlib.md5((t or "").encode()).hexdigest()[:8], 16) for t in told.dictionary.to_pylist()]
    places = told.indices.fill_null(len(draws)).to_numpy(zero_copy_only=False)
    draws.append(int(hashlib.md5(b"").hexdigest()[:8], 16))  # a null reads as no text, as in h32
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.array(draws, np.int64)[places]
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)
