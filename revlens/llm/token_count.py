"""Token counts of a byte-level pair-merge tokenizer, without its library.

Pre-tokens are held as one ragged array of symbols. In each round every
sequence finds its lowest-rank pair and merges all places of that pair at once,
left to right; sequences without a known pair retire with their length as the
count. Rounds are numpy work over all live sequences together.

A pre-token is counted once per worker as long as it is remembered; the memory is
emptied at a fixed number of entries, so it is bounded whatever the corpus.

Edge cases: null and empty texts have no bytes and no tokens; a special string
inside a text is one token, as the library reads it by default; repeated rows
each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.arrow import map_texts

# Fixed value: how the tokenizer parts a text before any merge.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The same rule for texts of ASCII and Latin letters only, which the plain regular
# expression engine reads three times as fast: every code point of LETTERS is \\p{L}.
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
SPACES = r"\t-\r "
LATIN = re.compile(rf"[{SPACES}!-~{LETTERS}]*")
LATIN_PATTERN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+"
    rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
SHIFT = 20
NONE = np.int64(2**40)
REMEMBERED = 1_000_000
CHARS_AT_ONCE = 500_000
COUNTS = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else
    the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class MergeTable:
    """The vocabulary file as arrays: pair keys in order, their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << SHIFT) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.letters = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.specials = [t["content"] for t in data.get("added_tokens", []) if t["special"]]


def _ranks(table: MergeTable, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> np.ndarray:
    key = (left << SHIFT) | right
    at = np.minimum(np.searchsorted(table.keys, key), table.keys.size - 1)
    return np.where((table.keys[at] == key) & same, table.ranks[at], NONE)


def merged_sizes(table: MergeTable, tokens: list[str]) -> np.ndarray:
    """How many symbols are left of each pre-token when no pair can merge."""
    raw = [t.encode("utf-8") for t in tokens]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    counts = np.ones(len(raw), dtype=np.int64)
    sym = table.letters[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)), sizes)
    rank = np.full(sym.size, NONE)  # of the pair that a symbol and its right neighbour make
    rank[:-1] = _ranks(table, sym[:-1], sym[1:], owner[:-1] == owner[1:])
    while sym.size:
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(starts, append=sym.size)
        done = lowest == NONE
        counts[owner[starts[done]]] = lengths[done]
        best = np.repeat(lowest, lengths)
        hit = (rank == best) & (best < NONE)
        # of overlapping places of one pair (a a a) every second one, from the left
        place = np.arange(sym.size)
        begins = hit.copy()
        begins[1:] &= ~hit[:-1]
        run = np.maximum.accumulate(np.where(begins, place, 0))
        take = hit & ((place - run) % 2 == 0)
        sym[take] = table.result[best[take]]
        live = best < NONE
        live[1:] &= ~take[:-1]
        sym, owner, rank, take = sym[live], owner[live], rank[live], take[live]
        # only pairs at a merged symbol have changed
        new = take.copy()
        new[:-1] |= take[1:]
        at = np.flatnonzero(new)
        right = np.minimum(at + 1, sym.size - 1)
        same = (right > at) & (owner[at] == owner[right])
        rank[at] = _ranks(table, sym[at], sym[right], same)
    return counts


class Counter:
    def __init__(self, table: MergeTable):
        self.table = table
        self.any_text = regex.compile(PATTERN)
        self.special = (
            regex.compile("|".join(map(regex.escape, sorted(table.specials, key=len, reverse=True))))
            if table.specials
            else None
        )
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return (LATIN_PATTERN if LATIN.fullmatch(text) else self.any_text).findall(text)

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the text around its special strings, and how many of those."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        segments = self.special.split(text)
        return [p for s in segments for p in self.split(s)], len(segments) - 1

    def count(self, texts: list[str]) -> list[list]:
        n_bytes, n_tokens, i = [], [], 0
        while i < len(texts):
            parted, size = [], 0
            while i < len(texts) and (not parted or size < CHARS_AT_ONCE):
                parted.append(self.parts(texts[i]))
                n_bytes.append(len(texts[i].encode("utf-8")))
                size += len(texts[i])
                i += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list({p for parts, _ in parted for p in parts}.difference(self.known))
            if new:
                self.known.update(zip(new, merged_sizes(self.table, new).tolist(), strict=True))
            n_tokens += [sum(map(self.known.__getitem__, parts)) + s for parts, s in parted]
        return [n_bytes, n_tokens]


#: One for each vocabulary and worker process, so that later tasks remember too.
_COUNTERS: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text.

    The vocabulary file is read on the driver and broadcast (about 2 MB, fixed by
    the file and not by the corpus), so executors need no copy of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable(vocabulary))

    def setup() -> Callable[[list[str]], list[list]]:
        counter = _COUNTERS.get(vocabulary)
        if counter is None or counter.table is not shared.value:
            counter = _COUNTERS[vocabulary] = Counter(shared.value)
        return counter.count

    return map_texts(docs, {"doc_id": F.col(id_col)}, F.col(text_col), setup, COUNTS)
