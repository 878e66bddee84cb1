"""Bottom-k near-duplicates against all pairs of full sets."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from revlens.llm import minhash_bottomk as op


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def expected(rows, percent=85):
    """(doc_id, n, component) of every row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(
        ((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str
    )


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = op.near_duplicates(docs, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def corpus(seed, base_words, copies, edits):
    """Copies of some texts with few or many edits, a passage that many texts share,
    and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    passage = [word() for _ in range(70)]
    for _ in range(4):
        base = [word() for _ in range(base_words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    for _ in range(40):
        rows.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(25)]))
        rows.append(" ".join(word() for _ in range(rng.randrange(1, 60))))
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_like_all_pairs_of_full_sets(spark):
    for seed, words, edits in ((1, 120, 5), (2, 300, 12), (3, 40, 3)):
        rows = corpus(seed, words, 25, edits)
        assert found(spark, rows) == expected(rows)


def test_far_side_of_the_broadcast_and_small_blocks(spark, monkeypatch):
    rows = corpus(4, 150, 40, 9)
    want = expected(rows)
    monkeypatch.setattr(op, "BLOCK", 8)
    assert found(spark, rows, limit=0) == want


def test_other_similarity_and_sketch(spark):
    rows = corpus(5, 100, 15, 8)
    assert found(spark, rows, percent=70, k=128, shared=60) == expected(rows, 70)


def test_pairs_without_a_pivot_are_confirmed_on_full_sets(spark, monkeypatch):
    rows = corpus(6, 100, 20, 6)
    monkeypatch.setattr(op, "_differences", lambda led, sets: led.select(
        "cls", F.lit(None).cast("bigint").alias("pivot"), F.lit(None).cast("array<bigint>").alias("apart")
    ).limit(0))
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = op.near_duplicates(odd_docs).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == expected(rows)
    assert op.near_duplicates(no_docs).count() == 0


def test_letters_and_blanks(spark):
    texts = ["A b\tC d\x0be f", "a B c\nd  E F", "a b c d", "É é x y z q", "é É x y z q", "", " ", None]
    rows = list(enumerate(texts))
    assert found(spark, rows) == expected(rows)
