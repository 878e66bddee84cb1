"""Hand-computed rows and brute-force twins for the text metrics."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.functions import priced
from revlens.functions.arrays import matched_from_end, overlaps, running_starts, term_counts, word_ids
from revlens.functions.hashing import h32, h32s
from revlens.functions.text import strip, tokens
from revlens.operators.lcs import rouge_l
from revlens.operators.nearest_reference import best_reference
from revlens.operators.overlap import bleu, meteor, rouge_n
from revlens.operators.perplexity import START, perplexity, train
from revlens.operators.polarity import polarity
from revlens.operators.soft_match import soft_match
from revlens.sources import corpus

rng = random.Random(7)


def _text(n):
    return " ".join(rng.choice("a b c d ee ff الخدمة".split()) for _ in range(n))


PAIRS = [
    ("", "a b"), ("a b", ""), ("a", "a"), ("a b c d", "a b c d"), ("x y", "a b"),
    ("a a b", "a b b"), ("b a", "a b"), ("الخدمة جيدة جدا", "الخدمة سيئة جدا"),
    ("a\tb\nc", "a b c"), ("one. two. one", "one two"), ("A b", "a B"),
] + [(_text(rng.randrange(0, 12)), _text(rng.randrange(0, 40))) for _ in range(60)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, c, r) for i, (c, r) in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "id int, c string, r string")


def _f(o, c, r):
    return 0.0 if not o else 2 * (o / c) * (o / r) / (o / c + o / r)


def _grams(ts, n):
    return [tuple(ts[i : i + n]) for i in range(len(ts) - n + 1)]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _meteor(c, r):
    c, r = list(enumerate(c.lower().split())), list(enumerate(r.lower().split()))
    nc, nr, hits = len(c), len(r), []
    for i in range(nc - 1, -1, -1):
        for j in range(len(r) - 1, -1, -1):
            if c[i][1] == r[j][1]:
                hits.append((c[i][0], r[j][0]))
                r.pop(j)
                break
    if not hits:
        return 0.0
    hits.sort()
    chunks = 1 + sum(
        not (b[0] == a[0] + 1 and b[1] == a[1] + 1) for a, b in zip(hits, hits[1:])
    )
    p, q = len(hits) / nc, len(hits) / nr
    return (1 - 0.5 * (chunks / len(hits)) ** 3) * p * q / (0.9 * p + 0.1 * q)


def _bleu(c, r):
    c, r = c.split(), r.split()
    if not set(c) & set(r):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        hit = sum((Counter(_grams(c, n)) & Counter(_grams(r, n))).values())
        total += math.log((hit or 0.1) / max(1, len(c) - n + 1)) / 4
    return (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(total)


def test_pair_scores(pairs):
    c, r = F.col("c"), F.col("r")
    rows = pairs.select(
        "c", "r", rouge_n(c, r).alias("n"), rouge_l(c, r).alias("l"),
        bleu(c, r).alias("b"), meteor(c, r).alias("m"),
    ).collect()
    for row in rows:
        a, b = (x.replace(".", " ").split() for x in (row.c, row.r))
        for n, got in ((1, row.n.n1), (2, row.n.n2)):
            ga, gb = _grams(a, n), _grams(b, n)
            shared = sum((Counter(ga) & Counter(gb)).values())
            assert got.multiset == pytest.approx(_f(shared, len(ga), len(gb)))
            assert got.set == pytest.approx(_f(len(set(ga) & set(gb)), len(set(ga)), len(set(gb))))
        assert row.l == pytest.approx(_f(_lcs(a, b), len(a), len(b)))
        assert row.b == pytest.approx(_bleu(row.c, row.r))
        assert row.m == pytest.approx(_meteor(row.c, row.r))
        assert all(0 <= x <= 1 for x in (row.l, row.b, row.m, row.n.n1.set))


def test_null_sides_give_null(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "c string, r string")
    c, r = F.col("c"), F.col("r")
    for score in (rouge_n(c, r), rouge_l(c, r), bleu(c, r), meteor(c, r)):
        assert [x[0] for x in df.select(score).collect()] == [None, None]


def test_rouge_is_symmetric(pairs):
    c, r = F.col("c"), F.col("r")
    both = pairs.select(rouge_n(c, r).alias("x"), rouge_n(r, c).alias("y")).collect()
    for row in both:
        assert row.x.n1.multiset == pytest.approx(row.y.n1.multiset)
        assert row.x.n2.set == pytest.approx(row.y.n2.set)


def test_arrays(pairs):
    for x in pairs.select("c", tokens(F.col("c")).alias("t")).collect():
        assert x.t == x.c.split()
    c, r = tokens(F.col("c")), tokens(F.col("r"))
    for x in pairs.select("c", "r", overlaps(word_ids(c), word_ids(r)).alias("o"), term_counts(r).alias("n")).collect():
        a, b = Counter(x.c.split()), Counter(x.r.split())
        assert (x.o.common, x.o.clipped) == (len(a & b), sum((a & b).values()))
        assert {t.term: t.n for t in x.n} == dict(b)


def test_alignment_meets_occurrences_from_the_end(spark):
    def brute(x, y):
        free, out = list(range(len(y))), []
        for i in reversed(range(len(x))):
            at = [j for j in free if y[j] == x[i]]
            if at:
                out.append((i, at[-1]))
                free.remove(at[-1])
        return sorted(out)

    rows = [("", ""), ("a", ""), ("a a b", "a b b"), ("a b a b", "b a b a a")]
    rows += [tuple("".join(rng.choice("abc") + " " for _ in range(12)) for _ in range(2)) for _ in range(40)]
    frame = spark.createDataFrame(rows, "c string, r string")
    ids = [word_ids(tokens(F.col(x))) for x in ("c", "r")]
    for x in frame.select("c", "r", matched_from_end(*ids).alias("m")).collect():
        assert [(p.a, p.b) for p in x.m] == brute(x.c.split(), x.r.split())


def test_long_texts_take_seconds(spark):
    """Twenty thousand tokens a side: the metrics' work is not quadratic."""
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(900)], k=20_000))
    frame = spark.createDataFrame([(text(1), text(2))], "c string, r string").cache()
    frame.count()
    c, r = F.col("c"), F.col("r")
    for score in (meteor(c, r), rouge_n(c, r), bleu(c, r), rouge_l(c, r)):
        start = time.monotonic()
        assert frame.select(score).first()[0] is not None
        assert time.monotonic() - start < 20


def test_sentences_are_whole(spark):
    rows = [("One two. Three!  \nfour five six? .. ", "four five six"), ("...", None), ("", None), ("a b", "a b")]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "review_id int, review string")
    got = {r.review_id: r.reference_summary for r in corpus.reference_summaries(frame).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_strip_is_pythons(spark):
    raw = "　\t x y \n"
    assert spark.createDataFrame([(raw,)], "s string").select(strip(F.col("s"))).first()[0] == raw.strip()


def test_perplexity_by_hand(spark):
    trained = spark.createDataFrame([("a b a",), ("a c",)], "review string")
    texts = spark.createDataFrame([(1, "a b"), (2, "z"), (3, "")], "id int, output string")
    got = {r.id: r for r in perplexity(texts, train(trained), ["id"]).collect()}
    v, k = 3, 0.5
    want = math.exp(-(math.log((2 + k) / (2 + k * v)) + math.log((1 + k) / (2 + k * v))) / 2)
    assert got[1].perplexity == pytest.approx(want, abs=1e-6)
    assert got[2].perplexity == pytest.approx((2 + k * v) / k, abs=1e-6)
    assert 3 not in got and got[1].n_tokens == 2


def test_perplexity_limit_only_when_asked(spark):
    trained = spark.createDataFrame([("a b c d",)], "review string")
    texts = spark.createDataFrame([(1, "a b c d")], "id int, output string")
    assert perplexity(texts, train(trained), ["id"]).first().n_tokens == 4
    assert perplexity(texts, train(trained), ["id"], limit=2).first().n_tokens == 2


def test_polarity(spark):
    lexicon = spark.createDataFrame([("good", 0.5), ("bad", -0.7)], "word string, polarity double")
    texts = spark.createDataFrame(
        [(1, "Good, good, BAD thing"), (2, "nothing"), (3, "")], "id int, review string"
    )
    got = {r.id: (r.n_hits, r.polarity) for r in polarity(texts, lexicon, ["id"]).collect()}
    assert got == {1: (3, 0.1), 2: (0, 0.0), 3: (0, 0.0)}


def test_best_reference_hot_user_and_ties(spark):
    """One user holds most replies and more references than a block takes."""
    refs = [("hot", i, f"w{i} w{i + 1} tail") for i in range(100)] + [("cold", 1, "x"), ("cold", 2, "x")]
    replies = [(i, "hot", f"w{i % 100} w{i % 100 + 1} tail more") for i in range(300)]
    replies += [(1000, "cold", "x"), (1001, "nobody", "x"), (1002, "hot", None)]
    df = best_reference(
        spark.createDataFrame(replies, "id int, user_name string, output string"),
        spark.createDataFrame(refs, "user_name string, ref_no bigint, ref_text string"),
        ["id"],
    )
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(replies)
    assert all(got[i].ref_no == i % 100 for i in range(300))
    assert got[1000].ref_no == 1 and got[1000].similarity == pytest.approx(1.0)
    assert got[1001].reference == "No reference available" and got[1001].ref_no is None
    assert got[1002].reference is None


def test_soft_match_both_plans_agree(spark):
    vectors = spark.createDataFrame(
        [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(30)],
        "vec_id bigint, embedding array<double>",
    )
    rows = [
        (i, [rng.randrange(30) for _ in range(rng.randrange(0, 9))],
         [rng.randrange(30) for _ in range(rng.randrange(0, 20))])
        for i in range(40)
    ] + [(100, [1, 2, 2], [2, 1]), (101, None, [1])]
    pairs = spark.createDataFrame(rows, "id int, c_ids array<bigint>, r_ids array<bigint>")
    small = {r.id: r.soft_f1 for r in soft_match(pairs, vectors, ["id"]).collect()}
    large = {
        r.id: r.soft_f1
        for r in soft_match(pairs, vectors, ["id"], broadcast_limit=0).collect()
    }
    assert small.keys() == large.keys()
    for i, score in small.items():
        assert large[i] == (None if score is None else pytest.approx(score, abs=1e-9))
    assert small[100] == pytest.approx(1.0) and small[101] is None


def test_soft_match_with_odd_vectors(spark):
    """Repeated, missing and incomplete vectors and unknown tokens: one answer."""
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]),
         (5, [float("nan"), 1.0]), (2, [1.0, 1.0])],
        "vec_id bigint, embedding array<double>",
    )
    rows = [(0, [1, 2], [2, 1]), (1, [3, 1], [1, 4]), (2, [9], [1]), (3, [], [1]), (4, [2, 5, 9], [1, 2])]
    pairs = spark.createDataFrame(rows, "id int, c_ids array<bigint>, r_ids array<bigint>")
    scores = [
        {r.id: round(r.soft_f1, 9) for r in soft_match(pairs, vectors, ["id"], **how).collect()}
        for how in ({}, {"broadcast_limit": 0})
    ]
    assert scores[0] == scores[1]
    assert scores[0][0] == scores[0][1] == 1.0 and scores[0][2] == scores[0][3] == 0.0


def test_soft_match_in_blocks_scores_every_row(spark, monkeypatch):
    """Without a broadcast, blocks fetch vectors; rows of one key are scored each for itself."""
    monkeypatch.setattr("revlens.operators.soft_match.BLOCK_TOKENS", 10)
    vectors = spark.createDataFrame(
        [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(12)], "vec_id bigint, embedding array<double>"
    )
    rows = [(i % 3, i, [rng.randrange(14) for _ in range(1 + i % 5)], [rng.randrange(12) for _ in range(4)])
            for i in range(20)]
    pairs = spark.createDataFrame(rows, "id int, no int, c_ids array<bigint>, r_ids array<bigint>")
    small, large = (
        {r.no: round(r.soft_f1, 9) for r in soft_match(pairs, vectors, ["id"], **how).collect()}
        for how in ({}, {"broadcast_limit": 0, "near": ["id"]})
    )
    assert len(small) == 20 and small == large


def test_soft_match_in_tiles_of_any_size(spark, monkeypatch):
    """Long texts are compared tile by tile, lists may hold nulls, and floats stay floats."""
    from revlens.operators import soft_match as module

    vectors = spark.createDataFrame(
        [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id bigint, embedding array<float>"
    )
    rows = [(i, None if i == 7 else i % 2, [rng.randrange(70) for _ in range(i * 9)] + [None],
             [rng.randrange(70) for _ in range(40)]) for i in range(8)]
    pairs = spark.createDataFrame(rows, "id int, of int, c_ids array<bigint>, r_ids array<bigint>")
    large = {r.id: round(r.soft_f1, 9) for r in soft_match(pairs, vectors, ["id"], broadcast_limit=0, near=["of"]).collect()}
    known = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    for size in (1, 12, 100, 262_144):
        matrix = module._unit(np.array([known[i] for i in range(60)], np.float32))
        monkeypatch.setattr(module, "TILE", size)
        monkeypatch.setattr(module, "_TILE_WIDTH", max(1, size // 4))
        lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (2, 3)]
        scores = module._scores(*lists, np.arange(60), matrix).to_pylist()
        assert {i: round(x, 9) for i, x in enumerate(scores)} == large
    c, r = (np.array([known[t] / np.linalg.norm(known[t]) for t in ts if t is not None and t < 60]) for ts in rows[5][2:])
    sims = c @ r.T
    p, q = sims.max(axis=1).mean(), sims.max(axis=0).mean()
    assert large[5] == pytest.approx(2 * p * q / (p + q), abs=1e-6)


def test_draws_of_a_list_are_the_draws_of_its_texts(spark):
    texts = [["a", "b", "a", "ä:b"], [], None, ["", None, "b"]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    one = F.transform("t", lambda x: h32(x))
    assert all(r.a == r.b for r in frame.select(one.alias("a"), h32s(F.col("t")).alias("b")).collect())


def test_best_reference_with_null_and_repeated_numbers(spark):
    refs = [("u", 1, None), ("u", 1, "good match here"), ("u", 1, "no"), ("u", None, "other words"),
            (None, 1, "good match here"), ("u", 10**12, "good match here")]
    replies = [(1, "u", "good match here"), (2, "u", "other words"), (3, None, "x"), (4, "v", "x")]
    df = best_reference(
        spark.createDataFrame(replies, "id int, user_name string, output string"),
        spark.createDataFrame(refs, "user_name string, ref_no bigint, ref_text string"),
        ["id"],
    )
    got = {r.id: (r.reference, r.ref_no) for r in df.collect()}
    none = ("No reference available", None)
    assert got == {1: ("good match here", 1), 2: ("other words", None), 3: none, 4: none}


def test_a_token_is_never_the_start_mark(spark):
    trained = train(spark.createDataFrame([("<s> a <s> b",)], "review string"))
    assert trained.filter(F.col("prev") == START).count() == 1
    assert " " in START


def test_running_starts(spark):
    """Lists below, at and above the sizes at which they are cut into blocks."""
    sizes = [[i * 7 % 11 for i in range(n)] for n in (0, 1, 3, 4, 5, 16, 17, 64, 65, 300)]
    frame = spark.createDataFrame([(s,) for s in sizes], "s array<bigint>")
    out = frame.select("s", running_starts(F.col("s"), block=4).alias("got")).collect()
    for r in out:
        assert r.got == [sum(r.s[:i]) for i in range(len(r.s))]


def test_overlap_counts_are_neither_sorted_nor_shuffled(spark, pairs):
    """The counts come from one Arrow stage, without a sort of each pair's n-grams."""
    c, r = F.col("c"), F.col("r")
    for score in (rouge_n(c, r)["n2"]["set"], bleu(c, r), meteor(c, r)):
        plan = pairs.select("id", score.alias("s"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert "sort_array" not in plan and "Exchange" not in plan


def test_overlap_of_null_and_long_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    rows = [(0, None, "a"), (1, "a", None), (2, None, None), (3, long, long), (4, "", "")]
    frame = spark.createDataFrame(rows, "id int, c string, r string")
    c, r = F.col("c"), F.col("r")
    columns = [rouge_n(c, r)["n2"]["multiset"], bleu(c, r), meteor(c, r)]
    got = {x[0]: tuple(x)[1:] for x in frame.select("id", *columns).collect()}
    assert got[0] == got[1] == got[2] == (None, None, None)
    assert got[3][:2] == (1.0, 1.0) and got[3][2] == pytest.approx(1.0)
    assert got[4] == (0.0, 0.0, 0.0)


def test_words_are_priced_alike_by_a_broadcast_and_in_blocks(spark, monkeypatch):
    """Repeated and null keys, repeated and null words, texts without words; beyond the
    limit no row per word and text is shuffled, texts meet their blocks' words instead."""
    monkeypatch.setattr(priced, "BLOCK_CHARS", 40)
    rows = [(i % 9, None if i % 7 == 0 else " ".join(rng.choices("Good bad fine So so x1y".split(), k=i))) for i in range(30)]
    rows += [(None, "good good"), (None, "bad"), (50, ""), (51, None), (52, "unknown")]
    texts = spark.createDataFrame(rows, "id bigint, review string")
    words = [("good", 0.5), ("bad", -1.0), ("so", 0.25), ("so", 0.75), ("fine", None), (None, 1.0)]
    lexicon = spark.createDataFrame(words, "word string, polarity double")
    want = {}
    for i, text in rows:
        seen = want.setdefault(i, [])
        for w in re.findall("[a-z]+", (text or "").lower()):
            seen += [p for word, p in words if word == w and p is not None]
    for limit in (priced.BLOCK_CHARS * 10**6, 0):
        found = polarity(texts, lexicon, ["id"], broadcast_limit=limit)
        got = {r.id: (r.n_hits, r.polarity) for r in found.collect()}
        assert got == {i: (len(p), pytest.approx(sum(p) / len(p) if p else 0.0, abs=1e-6)) for i, p in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_sentences_hold_a_token(spark):
    """Every white space of str.split(); no sentence is cut into tokens to find one."""
    blank = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [None, "", "...", blank, f"{blank}.a{blank}!{blank}?😀\n{blank}", "one. two two.\u200b. !", "x"]
    texts += ["".join(rng.choice(blank + ".!?\nab😀") for _ in range(30)) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.sentences(F.col("t")).alias("s"))
    for t, s in frame.collect():
        assert s == (None if t is None else [x for x in re.split(corpus.SENTENCE_END, t) if x.split()])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
