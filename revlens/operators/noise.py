"""Reproducible character noise.

int(level * length) draws with replacement; each draw hits one character
position and replaces it. The draws come from md5(key:i:seed), so every
engine and every retried task makes the same ones; on a position hit twice the
later draw counts. All steps are local to the row and linear in the text; they run in
Arrow batches, where a draw is one digest and one list item (as array functions it was
a struct, a sort key and a joined stretch of characters).
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a drawn character becomes.
REPLACEMENTS = ("x", "y", "z", " ", "123")


def _noisy(text: str, n_draws: int, key: str, seed: str) -> str:
    chars, length, prefix = list(text), len(text), f"{key}:"
    for i in range(n_draws):
        drawn = hashlib.md5(f"{prefix}{i}:{seed}".encode()).digest()
        place = int.from_bytes(drawn[:4], "big") % length
        chars[place] = REPLACEMENTS[int.from_bytes(drawn[4:8], "big") % len(REPLACEMENTS)]
    return "".join(chars)


def add_noise(text: Column, key: Column, level: float = 0.1, seed: str = "noise") -> Column:
    """``text`` with its noise; null for a text with draws but without a key."""

    @F.pandas_udf("string")
    def noisy(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for told, of in zip(texts, keys):
            n_draws = 0 if told is None else math.floor(level * len(told))
            if n_draws > 0:
                told = None if of is None else _noisy(told, n_draws, of, seed)
            out.append(told)
        return pd.Series(out, dtype="object")

    return noisy(text, key.cast("string"))
