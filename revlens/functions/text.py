"""Whitespace tokens, word tokens and trimming, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.split()/str.strip() treat as
# whitespace, as a regex class (read alike by Java and RE2) and as characters.
WS_CLASS = r"\t-\r\x1C-\x1F\x85\p{Z}"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}+"


def tokens(text: Column) -> Column:
    """Whitespace tokens; an empty array for empty text, null for null."""
    return F.array_remove(F.split(text, f"[{WS_CLASS}]+"), "")


def sentence_free_tokens(text: Column) -> Column:
    """Tokens with full stops read as separators, as the ROUGE package splits text."""
    return F.array_remove(F.split(text, f"[.{WS_CLASS}]+"), "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"\P{L}+"), "")


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text)).cast("bigint")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))
