import hashlib
import random

import pytest
from pyspark.sql import functions as F

from revlens.llm.line_dedup import (
    banded_distance,
    dedup_lines,
    line_report,
    repeated_lines,
    short_repeats,
    variants,
)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, t, min_chars):
    """What is left of each text: a line goes if an earlier one is within t edits."""
    first = {}
    for doc_id, text in sorted(docs):
        for at, line in enumerate((text or "").split("\n")):
            if len(line) >= min_chars:
                first.setdefault(line, (doc_id, at))
    near = {
        b
        for b in first
        if any(
            first[a] < first[b] and abs(len(a) - len(b)) <= t and distance(a, b) <= t for a in first
        )
    }
    return {
        doc_id: [
            line
            for at, line in enumerate((text or "").split("\n"))
            if len(line) < min_chars or (first[line] == (doc_id, at) and line not in near)
        ]
        for doc_id, text in docs
    }


def edited(rng, line, edits):
    chars = list(line)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars.insert(i, rng.choice("xyzé"))
        elif kind == 1:
            chars[i] = rng.choice("xyzé")
        elif len(chars) > 1:
            chars.pop(i)
    return "".join(chars)


def corpus(rng, n_docs, templates, size):
    """Documents of lines that are edits of few templates: every segment is hot."""
    base = ["".join(rng.choices("abcde é", k=size)) for _ in range(templates)]
    docs = []
    for i in range(n_docs):
        lines = [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(3)]
        docs.append((i, "\n".join([*lines, "short"])))
    return docs


def test_banded_distance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("ab", k=rng.randint(0, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 4)) if a else "b" * rng.randint(0, 3)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", *[banded_distance(F.col("a"), F.col("b"), t).alias(f"t{t}") for t in (0, 1, 3)])
    for r in got.collect():
        for t in (0, 1, 3):
            assert min(r[f"t{t}"], t + 1) == min(distance(r.a, r.b), t + 1), (r, t)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_variants_reach_every_close_pair(t):
    """The starts that are probed are those of the multi-match-aware choice."""
    assert len(variants(t)) == len(set(variants(t)))
    assert sum(v.shorter == t for v in variants(t)) >= 1


@pytest.mark.parametrize(("t", "hot", "size"), [(2, 3, 12), (1, 1000, 30)])
def test_against_all_pairs(spark, t, hot, size):
    """With a limit of three lines to a key the hot path parts keys down to the end."""
    docs = corpus(random.Random(t), 32, 2, size)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = dedup_lines(frame, max_edits=t, min_chars=8, hot=hot, keep_empty=True)
    want = brute(docs, t, 8)
    assert {r.doc_id: r.text.split("\n") for r in kept.collect()} == want


def test_all_pairs_beyond_the_size_check(spark, shuffled):
    docs = corpus(random.Random(77), 24, 3, 12)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = dedup_lines(frame, keep_empty=True, max_edits=2, min_chars=8, hot=3)
    want = brute(docs, 2, 8)
    assert {r.doc_id: r.text for r in got.collect()} == {i: "\n".join(v) for i, v in want.items()}


def test_report_and_edge_cases(spark, odd_docs, no_docs):
    line = "A line that is long enough to be looked at, with some words."
    more = spark.createDataFrame(
        [(90, f"{line}\nkeep"), (91, f"{line}"), (92, f"x\n{line.replace('long', 'lung')}\n\n{line}")],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in line_report(more).collect()}
    assert [(r.n_lines, r.n_exact, r.n_near, r.n_kept) for r in map(rows.get, (90, 91, 92))] == [
        (2, 0, 0, 2), (1, 1, 0, 0), (4, 1, 1, 2),
    ]
    assert rows[92].kept_sha256 == hashlib.sha256(b"x\n").hexdigest()
    assert {r.doc_id for r in dedup_lines(more).collect()} == {90, 92}
    got = dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, odd_docs.collect()))
    assert dedup_lines(no_docs).count() == 0
    assert repeated_lines(no_docs).count() == 0


def test_short_lines_are_counted_and_go_if_asked(spark):
    long = "A line that is long enough to be looked at, with some words."
    docs = [(1, f"Menu\n{long}\nshare\n\n}}"), (2, f"Menu\nshore\n\n}}\n{long}"), (3, "Menu\nlast"), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert tuple(short_repeats(frame).first()) == (2, 3, 1, 1)
    assert tuple(short_repeats(frame.limit(0)).first()) == (0, 0, 0, 0)
    left = {r.doc_id: r.text for r in dedup_lines(frame, min_exact=3).collect()}
    assert left == {1: docs[0][1], 2: "shore\n\n}", 3: "last", 4: None}
    stays = {r.doc_id: r.text for r in dedup_lines(frame).collect()}
    assert stays == {1: docs[0][1], 2: "Menu\nshore\n\n}", 3: "Menu\nlast", 4: None}
