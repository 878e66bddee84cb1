"""Words as every text operator here reads them, natively and in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words, and a word, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_az(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null stays null.

    ``lower`` says the same for a text of ASCII alone and is far cheaper there.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null and for no words."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), GAP), "")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that names of a caller's columns cannot
    meet names used here; ``select("_row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def py_lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")
