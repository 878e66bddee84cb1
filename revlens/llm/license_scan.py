"""Fuzzy search for short licence notices.

A notice with at most k edits is cut into k + 1 pieces: whatever the edits, one
piece survives unchanged. All pieces of all notices are found in one pass of a
multi-pattern automaton; only the neighbourhood of a hit is given to the regex
library, whose bounded-error matching confirms the place and counts its edits.

Texts are searched as their words (see :mod:`revlens.llm.words`) joined by one
space, so line breaks and punctuation inside a notice do not count as edits.

Edge cases: a null or empty text has no words and no spans; repeated rows each
get their own result; an empty table gives an empty table; columns other than
the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect
from typing import NamedTuple

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.arrow import map_texts
from revlens.llm.words import WORD, py_lower_az


class Notice(NamedTuple):
    """``max_edits`` single-character edits are allowed in ``phrase``."""

    label: str
    phrase: str
    max_edits: int = 0


# The base phrases and their labels.
BASE = (
    Notice("gpl", "gnu general public license"),
    Notice("apache", "apache license"),
    Notice("cc-by", "cc by"),
    Notice("mit", "mit license"),
)
FUZZY = (
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("apache", "apache license version", 2),
    Notice("mit", "under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc0", "creative commons zero", 2),
    Notice("reserved", "all rights reserved", 1),
)
SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("notice", T.StringType()),
        T.StructField("max_edits", T.IntegerType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]
)


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece) of the max_edits + 1 pieces, as equal in length as can be."""
    n, k = len(notice.phrase), notice.max_edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(cuts[i], notice.phrase[cuts[i] : cuts[i + 1]]) for i in range(k)]


class Searcher:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        places: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                places.setdefault(piece, []).append((number, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(f"(?be)(?<= )(?:{regex.escape(n.phrase)}){{e<={n.max_edits}}}(?= )")
            for n in notices
        ]

    def spans(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice number, edits, start, end) in words joined by, and set in, spaces."""
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.seeds.iter(joined):
            for number, offset in where:
                starts.setdefault(number, set()).add(end + 1 - size - offset)
        out = []
        for number, found in sorted(starts.items()):
            notice = self.notices[number]
            k, n = notice.max_edits, len(notice.phrase)
            if not k:  # the only piece is the whole phrase: every place counts
                out += [
                    (number, 0, s, s + n)
                    for s in sorted(found)
                    if joined[s - 1] == " " and joined[s + n] == " "
                ]
                continue
            regions: list[tuple[int, int, list]] = []
            for s in sorted(found):
                low, high = max(0, s - k - 1), min(len(joined), s + n + k + 1)
                hit = self.patterns[number].search(joined, low, high)
                hits = [hit] if hit else []
                if regions and low <= regions[-1][1]:
                    low, _, before = regions.pop()
                    before += hits
                    hits = before
                regions.append((low, high, hits))
            for low, high, hits in regions:
                for hit in self._apart(number, joined, low, high, hits):
                    out.append((number, sum(hit.fuzzy_counts), hit.start(), hit.end()))
        return out

    def _apart(self, number: int, joined: str, low: int, high: int, hits: list) -> list:
        """The best of the hits that overlap, and what a search finds between them."""
        kept: list = []
        for hit in sorted(hits, key=lambda h: (sum(h.fuzzy_counts), h.start())):
            i = bisect(kept, hit.start(), key=lambda h: h.start())
            if (not i or kept[i - 1].end() <= hit.start()) and (
                i == len(kept) or hit.end() <= kept[i].start()
            ):
                kept.insert(i, hit)
        notice, edges = self.notices[number], [low, *[x for h in kept for x in h.span()], high]
        rest = list(zip(edges[::2], edges[1::2], strict=True))
        while rest:
            a, b = rest.pop()
            # a match and the space on one side of it at least
            if b - a <= len(notice.phrase) - notice.max_edits:
                continue
            hit = self.patterns[number].search(joined, a, b)
            if hit:
                kept.append(hit)
                rest += [(a, hit.start()), (hit.end(), b)]
        return sorted(kept, key=lambda h: h.start())

    def scan(self, texts: list[str]) -> list[list]:
        counts, spans = [], []
        for text in texts:
            low = py_lower_az(text)
            words = WORD.findall(low)
            counts.append(len(words))
            joined = f" {' '.join(words)} "
            found, rows = self.spans(joined), []
            if found:
                edges = [m.span() for m in WORD.finditer(low)]
            for number, edits, start, end in found:
                notice = self.notices[number]
                first = joined.count(" ", 0, start) - 1
                last = first + joined.count(" ", start, end)
                a, b = edges[first][0], edges[last][1]
                rows.append(
                    (notice.label, notice.phrase, notice.max_edits, edits, first, a, b, text[a:b])
                )
            spans.append([dict(zip(SPAN.names, row, strict=True)) for row in rows])
        return [counts, spans]


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    notices: tuple[Notice, ...] = BASE + FUZZY,
) -> DataFrame:
    """doc_id, n_words and ``spans``: one struct for each place of a notice with
    its label, edits, first word, start and end (code points) and its text."""
    return map_texts(
        docs, {"doc_id": F.col(id_col)}, F.col(text_col), lambda: Searcher(notices).scan, FOUND
    )


def license_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`license_scan`: base places, their extent and labels."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["max_edits"] == 0)
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    closeness = F.transform(
        spans, lambda s: 1 - s["edits"].cast("double") / F.length(s["notice"])
    )
    return license_scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(spans).alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"),
        F.size(spans).cast("bigint").alias("n_spans"),
    )
