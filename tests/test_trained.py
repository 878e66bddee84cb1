"""Models trained here: scores, both plans, and the client for batch calls."""

import math
import os
import pickle
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import bootstrap, extractive, infer, latency, naive_bayes, perplexity, retrieval, word_vectors
from revlens.operators.infer import batch_infer
from revlens.plans import jobs, trained
from revlens.sources.catalog import LABELS

TRAIN = [
    (1, "good good fine lamp", "positive"), (2, "fine lamp, good light", "positive"),
    (3, "bad bad lamp", "negative"), (4, "broken, bad", "negative"),
    (5, "a lamp", "neutral"), (6, "", "neutral"), (7, None, "neutral"), (8, "good", None),
]
ASKED = ["good light", "BAD lamp broken", "a lamp", "unknown words", "", None, "good bad " * 500, "Été İstanbul ß"]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(TRAIN, "review_id bigint, review string, label string")
    return naive_bayes.train(rows, min_count=1)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [("customer", i, "u", t, None) for i, t in enumerate(ASKED)]
    schema = "dataset string, review_id bigint, user_name string, review string, label string"
    return spark.createDataFrame(rows, schema)


def expected(text):
    counts = {x: Counter() for x in LABELS}
    docs = Counter()
    for _, review, label in TRAIN:
        if label:
            docs[label] += 1
            counts[label].update(naive_bayes._words(review or ""))
    known = set().union(*counts.values())
    ws = [w for w in naive_bayes._words(text or "") if w in known]
    scores = []
    for x in LABELS:
        total = sum(counts[x].values()) + len(known)
        scores.append(
            sum(naive_bayes.billionths(counts[x][w] + 1) for w in ws)
            - len(ws) * naive_bayes.billionths(total) + naive_bayes.billionths(docs[x] + 1)
        )
    best = max(range(3), key=lambda i: (scores[i], -i))
    first, second = sorted(scores, reverse=True)[:2]
    return LABELS[best], first - second


@pytest.mark.parametrize("limit", [naive_bayes.LIMIT, 0])
def test_naive_bayes_like_the_formula(model, asked, limit):
    out = naive_bayes.classify(asked, model, ["review_id"], limit=limit).collect()
    got = {r.review_id: (r.prediction, r.margin) for r in out}
    assert got == {i: expected(t) for i, t in enumerate(ASKED)}


def test_training_makes_no_noisy_copies(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("noise is not part of the training rows")

    monkeypatch.setattr(jobs, "add_noise", refuse)
    assert trained._naive_bayes(spark, sf).terms.count() > 0


def test_scores_are_probabilities(model):
    """The kept weights are those of the textbook: ln((n + 1) / (N + V))."""
    row = model.terms.filter("term = 'good'").first()
    assert row.w_positive == naive_bayes.billionths(4)
    totals = model.totals.first()
    assert totals.base_positive == naive_bayes.billionths(8 + 7)
    assert math.isclose(math.exp((row.w_positive - totals.base_positive) / 1e9), 4 / 15, rel_tol=1e-8)


def test_client_answers_like_the_columns(spark, model, asked):
    factory = naive_bayes.client_factory(model)
    requests = asked.withColumns(
        {"model": F.lit(naive_bayes.NAME), "task": F.lit("sentiment"), "prompt": F.lit(""),
         "review_tokens": F.lit(0), "input_tokens": F.lit(0)}
    )
    log = batch_infer(requests, "sentiment", {naive_bayes.NAME: factory}).collect()
    calls = naive_bayes.trained_calls(asked, model).collect()
    assert {r.review_id: r.raw_output for r in log} == {r.review_id: r.raw_output for r in calls}
    assert all(r.error is None for r in log)
    with pytest.raises(ValueError):
        naive_bayes.client_factory(model, limit=10)


def test_rare_terms_are_not_learned(spark):
    rows = spark.createDataFrame(TRAIN, "review_id bigint, review string, label string")
    model = naive_bayes.train(rows, min_count=3)
    assert {r.term for r in model.terms.collect()} == {"good", "lamp", "bad"}
    assert model.totals.first().base_negative == naive_bayes.billionths(3 + 1 + 3)


def test_nothing_to_learn_from(spark, asked):
    empty = naive_bayes.train(spark.createDataFrame([], "review_id bigint, review string, label string"))
    out = naive_bayes.classify(asked, empty, ["review_id"]).collect()
    assert {r.prediction for r in out} == {"positive"} and len(out) == len(ASKED)


# --- extractive summaries -------------------------------------------------------


def graph_centrality(terms, steps=extractive.STEPS):
    """The same weights from the whole matrix of shared terms."""
    sets = [set(t) for t in terms]
    weight = [extractive.SCALE] * len(sets)
    for _ in range(steps):
        gained = [
            sum(w * len(a & b) for b, w in zip(sets, weight, strict=True)) // max(len(a), 1) for a in sets
        ]
        top = max([*gained, 1])
        weight = [g * extractive.SCALE // top for g in gained]
    return weight


def test_centrality_like_the_whole_graph():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 30):
        terms = [rng.integers(0, 20, rng.integers(0, 8)).tolist() for _ in range(n)]
        flat = np.array([t for ts in terms for t in ts], np.int64)
        sizes = np.array([len(t) for t in terms], np.int64)
        assert extractive.centrality(sizes, flat).tolist() == graph_centrality(terms)


def test_summaries_of_odd_and_long_texts(spark):
    story = "The lamp is bright. The lamp was cheap! Cats sleep. The lamp is good and bright? End."
    long = " ".join(f"w{i % 997}" + ("." if i % 13 == 0 else "") for i in range(20_000))
    texts = [story, "", None, " . . ", "one " * 80, "same. same. same", long]
    docs = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, review string")
    got = {r.review_id: r for r in extractive.summaries(docs, ["review_id"]).collect()}
    assert got[0].summary.startswith("The lamp is bright. ") and got[0].n_sentences == 5
    assert [got[i].summary for i in (1, 2, 3)] == ["", "", ""]
    assert got[4].summary == " ".join(["one"] * 50) and got[4].n_sentences == 1
    assert got[5].summary == "same. same. same"
    assert 0 < len(got[6].summary.split()) <= 50
    short = extractive.summaries(docs, ["review_id"], budget=4).filter("review_id = 0").first()
    assert short.summary in story and len(short.summary.split()) <= 4
    copies = docs.union(docs).withColumn("weights", F.lit("clash"))
    assert extractive.summaries(copies, ["review_id"]).count() == 2 * len(texts)
    assert extractive.summaries(docs.limit(0), ["review_id"]).count() == 0


# --- retrieved replies ----------------------------------------------------------


def exhaustive(replies, text):
    """The best reply by scoring all of them; (score, order) or None."""
    docs = {}
    for first, second, t in replies:
        if t is not None and naive_bayes._words(t):
            docs[t] = min(docs.get(t, (first, second)), (first, second))
    tf = {o: Counter(naive_bayes._words(t)) for t, o in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, tokens = float(len(tf)), float(sum(sum(c.values()) for c in tf.values()))
    best = None
    for o, counts in tf.items():
        length, score = float(sum(counts.values())), 0
        for w in set(naive_bayes._words(text or "")) & set(counts):
            idf = math.log(1.0 + (n - df[w] + 0.5) / (df[w] + 0.5))
            share = counts[w] * 2.2 / (counts[w] + 1.2 * (0.25 + 0.75 * (length / (tokens / n))))
            score += math.floor(idf * share * 1e6 + 0.5)
        if score > 0 and (best is None or (-score, o) < (-best[0], best[1])):
            best = (score, o)
    return best


def some_replies(n):
    rng = random.Random(8)
    vocabulary = ["w" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(300)]
    topics = [rng.sample(vocabulary, 25) for _ in range(12)]
    words = lambda: " ".join(rng.choices(rng.choice(topics), k=rng.randrange(4, 30)) + ["the"])
    replies = [(i, i % 5, words()) for i in range(n)]
    replies += [(n + i, 0, replies[i][2]) for i in range(20)] + [(-1, 3, None), (-2, 3, "12 34"), (-3, 0, "")]
    reviews = [words() + " " + words() for _ in range(60)] + ["the", "unknown", "", None, " ".join(vocabulary) * 20]
    return replies, list(enumerate(reviews))


@pytest.mark.parametrize("limit", [retrieval.LIMIT, 20_000])
def test_retrieval_like_scoring_all_replies(spark, limit):
    """In one shard and in several; fewer blocks are scored than there are."""
    replies, reviews = some_replies(1500)
    index = retrieval.build_index(
        spark.createDataFrame(replies, "conv_id bigint, turn bigint, text string"), ("conv_id", "turn")
    )
    asked = spark.createDataFrame(reviews, "review_id bigint, review string")
    assert (retrieval.shards(index, limit)[1] > 1) == (limit < 10**6)
    out = retrieval.retrieve(asked, index, ["review_id"], limit=limit).collect()
    got = {r.review_id: None if r.score is None else (r.score, (r.first, r.second)) for r in out}
    assert got == {i: exhaustive(replies, t) for i, t in reviews}
    scored, blocks = sum(r.scored for r in out), index.count()
    assert scored < 0.6 * blocks * len(reviews), (scored, blocks)


def test_blocks_that_bounds_cannot_rule_out_are_scored_together(spark, monkeypatch):
    """Long reviews share words with every block: a term's replies are added up at once."""
    passes = []
    scores = retrieval.Shard.scores
    monkeypatch.setattr(retrieval.Shard, "scores", lambda self, known: passes.append(1) or scores(self, known))
    replies, reviews = some_replies(600)
    long_review = " ".join(t for _, _, t in replies[:200] if t)
    index = retrieval.build_index(
        spark.createDataFrame(replies, "conv_id bigint, turn bigint, text string"), ("conv_id", "turn")
    )
    shard = retrieval.Shard(index.collect())
    digests = spark.createDataFrame([(long_review,)], "t string").select(
        F.array_distinct(retrieval.word_ids(retrieval.words(F.col("t"))))
    )
    query = np.sort(np.array(digests.first()[0], np.int64))
    found, scored = shard.best(query, (0, 0, 0))
    assert (-found[0], found[1:]) == exhaustive(replies, long_review)
    assert passes == [1] and retrieval.SINGLY < scored <= index.count()


@pytest.mark.parametrize(("few", "dense", "again"), [(0, 1 / 64, 4096), (0, 2.0, 4096), (0, 1 / 20, 0), (200, 1 / 20, 3)])
def test_reviews_scored_together_get_the_best_reply(spark, monkeypatch, few, dense, again):
    """By a matrix of common terms and by lists, in single precision first: as all pairs say."""
    for name, value in (("FEW", few), ("DENSE", dense), ("AGAIN", again), ("LISTED", 10.0**6), ("TOGETHER", 5000)):
        monkeypatch.setattr(retrieval, name, value)
    replies, reviews = some_replies(600)
    index = retrieval.build_index(
        spark.createDataFrame(replies, "conv_id bigint, turn bigint, text string"), ("conv_id", "turn")
    )
    shard = pickle.loads(pickle.dumps(retrieval.Shard(index.toArrow(), read=False)))
    assert (len(shard.matrix) == 0) == (dense > 1)
    asked = spark.createDataFrame([(i, t or "") for i, t in reviews], "i int, t string")
    digests = asked.select("i", F.array_distinct(retrieval.word_ids(retrieval.words(F.col("t")))).alias("q"))
    queries = {r.i: np.sort(np.array(r.q, np.int64)) for r in digests.collect()}
    found, scored = shard.best_of_each([queries[i] for i, _ in reviews], [(0, 0, 0)] * len(reviews))
    got = [(-f[0], f[1:]) if f[0] else None for f in found]
    assert got == [exhaustive(replies, t) for _, t in reviews]
    assert max(scored) <= index.count()


def test_reviews_are_not_written_between_shards(spark, monkeypatch):
    replies, reviews = some_replies(300)
    index = retrieval.build_index(
        spark.createDataFrame(replies, "conv_id bigint, turn bigint, text string"), ("conv_id", "turn")
    )
    monkeypatch.setattr(retrieval, "materialise", None)
    asked = spark.createDataFrame(reviews, "review_id bigint, review string")
    assert retrieval.shards(index, 20_000)[1] > 1
    assert retrieval.retrieve(asked, index, ["review_id"], limit=20_000).count() == len(reviews)


def test_retrieval_without_replies(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, text string")
    rows = spark.createDataFrame(
        [("customer", 1, "u", "good")], "dataset string, review_id bigint, user_name string, review string"
    )
    (call,) = retrieval.retrieved_calls(rows, none, ("conv_id", "turn")).collect()
    assert call.raw_output is None and call.error == retrieval.NO_REPLY


# --- word vectors ---------------------------------------------------------------


def planted_corpus():
    """Texts on three topics; two words of the first only ever stand in for each other."""
    rng = random.Random(3)
    topics = [["lamp", "light", "bulb", "desk", "shade"], ["boat", "sail", "river", "oar", "mast"], ["bread", "oven", "flour", "yeast", "salt"]]
    texts = []
    for _ in range(400):
        topic = rng.choice(topics)
        said = rng.choices(topic, k=rng.randrange(6, 14))
        if topic is topics[0]:
            said.insert(rng.randrange(len(said)), rng.choice(["glim", "lume"]))
        texts.append(" ".join(said))
    return [*texts, None, "", "rare"]


def dense_pmi(texts, window=4, min_count=5):
    said = [naive_bayes._words(t or "") for t in texts]
    often = Counter(w for ws in said for w in ws)
    names = sorted(w for w, n in often.items() if n >= min_count)
    at = {w: i for i, w in enumerate(names)}
    n = np.zeros((len(names), len(names)))
    for ws in said:
        for i, w in enumerate(ws):
            for c in ws[i + 1 : i + 1 + window]:
                if w in at and c in at:
                    n[at[w], at[c]] += 1
                    if w != c:
                        n[at[c], at[w]] += 1
    sums = n.sum(axis=1)
    with np.errstate(divide="ignore"):
        pmi = np.log(n * n.sum() / np.outer(sums, sums))
    return names, np.where(pmi > 0, pmi, 0.0)


@pytest.mark.parametrize("limit", [word_vectors.LIMIT, 0])
def test_vectors_like_a_dense_decomposition(spark, limit):
    texts = planted_corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "review string")
    dim = 8
    vectors = word_vectors.train(docs, dim=dim, limit=limit)
    names, pmi = dense_pmi(texts)
    digests = spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("vec_id"))
    got = {r.w: np.array(r.embedding) for r in vectors.join(digests, "vec_id").collect()}
    assert vectors.count() == len(got) == len(names)
    values, turn = np.linalg.eigh(pmi)
    lead = np.argsort(-np.abs(values))[:dim]
    want = turn[:, lead] * np.sqrt(np.abs(values[lead]))
    own = np.stack([got[w] for w in names])
    assert np.abs(own @ own.T - want @ want.T).max() < 1e-3

    def close(a, b):
        return float(got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b]))

    others = [w for w in names if w not in ("glim", "lume", "lamp", "light", "bulb", "desk", "shade")]
    assert close("glim", "lume") > 0.8 > 0.3 > max(close("glim", w) for w in others)


def test_packed_counts():
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 2**45, 3000) % 2000 * 2**33, rng.integers(1, 9, 3000)
    for top in (1, 2**40):  # a sum that fits beside a key in one number, and one that does not
        got = word_vectors.added(keys, counts * top)
        want = Counter()
        for k, n in zip(keys.tolist(), (counts * top).tolist()):
            want[k] += n
        assert list(zip(*map(np.ndarray.tolist, got))) == sorted(want.items())
        assert [x.tolist() for x in word_vectors.unpack(word_vectors.pack(*got))] == [x.tolist() for x in got]
    assert word_vectors.pack(keys[:0], counts[:0]) == b"" and len(word_vectors.unpack(b"")[0]) == 0
    near = np.cumsum(rng.integers(1, 1000, 10**5))
    assert len(word_vectors.pack(near, np.ones(10**5, np.int64))) < 2 * 10**5


def test_training_in_many_blocks_leaves_only_its_vectors(spark, monkeypatch):
    """Rows of a block stay together; what was written on the way is removed."""
    docs = spark.createDataFrame([(t,) for t in planted_corpus()], "review string").repartition(3)
    whole = {r.vec_id: r.embedding for r in word_vectors.train(docs, dim=8).collect()}
    monkeypatch.setattr(word_vectors, "BLOCK_PAIRS", 2000)
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "revlens")
    before = set(os.listdir(folder))
    counts = word_vectors.cooccurrence(docs, "review", 4, 5, 0)
    assert counts.count() > 4 and max(len(r.packed) for r in counts.collect()) > 1
    before |= set(os.listdir(folder))
    vectors = word_vectors.train(docs, dim=8, limit=0)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("word-vectors")
    got = {r.vec_id: r.embedding for r in vectors.collect()}
    assert set(got) == set(whole) and all(np.allclose(got[w], whole[w], atol=2e-5) for w in got)


def test_vectors_of_repeated_texts_go_to_the_texts(spark):
    """Rows of one key are added up, null keys too; no word becomes a row of the plan."""
    vectors = spark.createDataFrame([("lamp", [1.0, 2.0]), ("boat", [0.5, 0.0]), ("sail", [4.0, 1.0])], "w string, embedding array<double>")
    vectors = vectors.select(F.xxhash64("w").alias("vec_id"), "embedding")
    rows = spark.createDataFrame([(1, "lamp boat lamp"), (1, "sail"), (None, "boat"), (None, "boat"), (2, "none"), (3, None)], "id int, t string")
    for limit in (word_vectors.LIMIT, 0):
        sums = word_vectors.text_vectors(rows, vectors, ["id"], "t", limit)
        assert {r.id: r.v for r in sums.collect()} == {1: [6.5, 5.0], None: [1.0, 0.0]}
        assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()


def test_text_vectors_and_cosine(spark):
    docs = spark.createDataFrame([(t,) for t in planted_corpus()], "review string")
    vectors = word_vectors.train(docs, dim=8)
    rows = spark.createDataFrame([(1, "lamp glim"), (2, "light lume!"), (3, "boat"), (4, "none known"), (5, None)], "id int, t string")
    for limit in (word_vectors.LIMIT, 0):
        sums = {r.id: r.v for r in word_vectors.text_vectors(rows, vectors, ["id"], "t", limit).collect()}
        assert set(sums) == {1, 2, 3}
        pairs = spark.createDataFrame([(sums[1], sums[2]), (sums[1], sums[3]), (sums[1], [0.0] * 8)], "a array<double>, b array<double>")
        same, far, none = (r[0] for r in pairs.select(word_vectors.cosine(F.col("a"), F.col("b"))).collect())
        assert same > 0.8 > far and none is None
    empty = spark.createDataFrame([(None,), ("one",)], "review string")
    assert word_vectors.train(empty, dim=4).count() == 0


# --- Kneser-Ney -----------------------------------------------------------------


def kn_perplexity(texts, asked, d=0.75):
    """By the textbook, from dictionaries; sums of probabilities over the vocabulary are one."""
    c3 = Counter()
    for t in texts:
        ws = ["<s>", "<s>", *(t or "").lower().split()]
        c3.update(zip(ws, ws[1:], ws[2:]))  # noqa: B905
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def prob(u, v, w):
        total, kinds = sum(c1.values()), len(c1)
        p = (max(c1[w] - d, 0) + d * kinds / (kinds + 1)) / total
        if (t := sum(n for (a, _), n in c2.items() if a == v)):
            p = (max(c2[v, w] - d, 0) + d * sum(a == v for a, _ in c2) * p) / t
        if (t := sum(n for (a, b, _), n in c3.items() if (a, b) == (u, v))):
            p = (max(c3[u, v, w] - d, 0) + d * sum((a, b) == (u, v) for a, b, _ in c3) * p) / t
        return p

    for u, v in (("<s>", "<s>"), ("the", "lamp"), ("no", "such")):
        assert math.isclose(sum(prob(u, v, w) for w in [*c1, "<unknown>"]), 1.0)
    ws = ["<s>", "<s>", *asked.lower().split()]
    logs = [math.log(prob(*g)) for g in zip(ws, ws[1:], ws[2:])]  # noqa: B905
    return len(logs), math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("limit", [perplexity.LIMIT, 0])
def test_kneser_ney_like_the_textbook(spark, limit):
    texts = ["the lamp is bright", "The lamp was cheap", "a lamp is a lamp", "the the the", "", None, "the lamp is good"]
    asked = ["the lamp is bright", "unknown words only", "the the lamp is a boat", "lamp " * 300]
    model = perplexity.KneserNey(spark.createDataFrame([(t,) for t in texts], "review string"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*asked, "", None])], "id int, output string")
    got = {r.id: r for r in perplexity.perplexity_kn(rows, model, ["id"], broadcast_limit=limit).collect()}
    assert set(got) == set(range(len(asked)))
    for i, t in enumerate(asked):
        n, want = kn_perplexity(texts, t)
        assert got[i].n_tokens == n and math.isclose(got[i].perplexity, want, abs_tol=2e-6, rel_tol=1e-6)
    cut = perplexity.perplexity_kn(rows, model, ["id"], limit=2).filter("id = 3").first()
    assert cut.n_tokens == 2
    none = perplexity.KneserNey(spark.createDataFrame([], "review string"))
    assert {r.perplexity for r in perplexity.perplexity_kn(rows, none, ["id"]).collect()} == {1.0}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_kneser_ney_with_middle_words_of_several_blocks(spark, monkeypatch, size):
    """A word in the middle of very many trigrams is dealt to several blocks and added up."""
    monkeypatch.setattr(perplexity, "BLOCK_TRIGRAMS", size)
    texts = ["the lamp is bright", "a lamp was cheap", "the lamp is a lamp", "my lamp is bright", "the the the", None]
    asked = ["the lamp is bright", "unknown lamp was a lamp", "lamp bright lamp", "cheap"]
    model = perplexity.KneserNey(spark.createDataFrame([(t,) for t in texts], "review string").repartition(2))
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, output string")
    # texts without any corpus are dealt, too
    none = perplexity.KneserNey(spark.createDataFrame([], "review string"))
    used = perplexity._used(perplexity._told(rows, ["id"], None, perplexity._trigrams(F.col("output"))))
    for trained in (model, none):
        blocks = perplexity._Blocks(trained, used)
        assert (blocks.number > 1) == blocks.any_shared == (size < 1000)
    assert {r.perplexity for r in perplexity.perplexity_kn(rows, none, ["id"]).collect()} == {1.0}
    got = {r.id: r for r in perplexity.perplexity_kn(rows, model, ["id"]).collect()}
    for i, t in enumerate(asked):
        n, want = kn_perplexity(texts, t)
        assert got[i].n_tokens == n and math.isclose(got[i].perplexity, want, abs_tol=2e-6, rel_tol=1e-6)


def test_bigram_prices_on_the_far_side_of_the_broadcast(spark):
    corpus = spark.createDataFrame([("a b a b c",), ("b c",)], "review string")
    model = perplexity.train(corpus)
    rows = spark.createDataFrame([(i, "a b " * i + "z") for i in range(6)], "id int, output string")
    near, far = (
        sorted(map(tuple, perplexity.perplexity(rows, model, ["id"], broadcast_limit=x).collect()))
        for x in (perplexity.LIMIT, 0)
    )
    assert near == far and len(near) == 6


# --- clients of several kinds ---------------------------------------------------


def test_a_worker_builds_a_client_once(spark):
    """Sixteen tasks on four workers: each worker builds each model's client once. One
    kind of client is asked row by row, one batch by batch, one fails."""

    def single(model, task, budget):
        built = f"{os.getpid()}:{uuid.uuid4().hex}"
        return lambda request: (built, None)

    class Many:
        def __init__(self):
            self.built = f"{os.getpid()}:{uuid.uuid4().hex}"

        def ask_all(self, requests):
            if any(r["review"] == "bad" for r in requests):
                raise ValueError("a bad batch")
            return [(f"{self.built}:{r['review_id']}", 1) for r in requests]

    factories = {"a": single, "b": lambda model, task, budget: Many(), "c": lambda *_: 1 / 0}
    rows = spark.range(640).repartition(16).select(
        F.lit("sentiment").alias("task"), F.lit("customer").alias("dataset"), F.col("id").alias("review_id"),
        F.lit("u").alias("user_name"), F.lit("").alias("prompt"), F.lit(1).cast("bigint").alias("review_tokens"),
        F.lit(1).cast("bigint").alias("input_tokens"), F.lit("good").alias("review"),
    )
    reqs = rows.withColumn("model", F.explode(F.array(*map(F.lit, "abcd"))))
    log = batch_infer(reqs, "sentiment", factories, ()).collect()
    assert len(log) == 4 * 640 and len({(r.review_id, r.model) for r in log}) == len(log)
    for model in "ab":
        built = {tuple(r.raw_output.split(":")[:2]) for r in log if r.model == model}
        assert len(built) == len({pid for pid, _ in built}) <= 8
    assert all(r.raw_output.endswith(f":{r.review_id}") for r in log if r.model == "b")
    assert {r.error for r in log if r.model == "c"} == {"division by zero"}
    assert {r.error for r in log if r.model == "d"} == {"Unsupported model"}
    bad = reqs.filter("model = 'b' and review_id < 5").withColumn("review", F.lit("bad"))
    assert {r.error for r in batch_infer(bad, "sentiment", factories, ()).collect()} == {"a bad batch"}


def test_the_oldest_client_makes_room(monkeypatch):
    closed = []

    class Closing:
        def __init__(self, name):
            self.name = name

        def close(self):
            closed.append(self.name)

    monkeypatch.setattr(infer, "KEPT", 2)
    monkeypatch.setattr(infer, "_CLIENTS", infer.OrderedDict())
    for name in "abac":
        assert infer.kept_client("run", name, lambda name=name: Closing(name)).name == name
    assert closed == ["b"]


# --- error bars -----------------------------------------------------------------


def test_bootstrap_draws_are_poisson_and_keyed(spark):
    rows = spark.range(3000).repartition(7)
    drawn = [r.w for r in rows.select(bootstrap.weights([F.lit("d"), F.col("id")]).alias("w")).collect()]
    flat = np.array(drawn).ravel()
    assert flat.size == 3000 * bootstrap.REPLICATES
    for k in range(4):
        share = math.exp(-1) / math.factorial(k)
        assert abs((flat == k).mean() - share) < 0.005
    assert abs(flat.mean() - 1) < 0.01 and abs(flat.var() - 1) < 0.02
    again = rows.coalesce(1).select(bootstrap.weights([F.lit("d"), F.col("id")]).alias("w")).collect()
    assert sorted(map(tuple, drawn)) == sorted(tuple(r.w) for r in again)


def test_intervals_hold_the_sample_and_narrow(spark):
    """A model that is right nine times in ten leads one that is right six times; more
    reviews give narrower intervals, and no partitioning changes a number."""

    def board(n, parts):
        rows = spark.range(n).repartition(parts).select(
            F.lit("d").alias("dataset"), F.col("id").alias("review_id"),
            F.element_at(F.array(*map(F.lit, LABELS)), (F.col("id") % 3 + 1).cast("int")).alias("label"),
            F.explode(F.array(F.lit("good"), F.lit("poor"))).alias("model"),
        )
        right = F.when(F.col("model") == "good", F.col("id") % 10 != 3).otherwise(F.col("id") % 10 > 3)
        rows = rows.withColumn("id", F.col("review_id"))
        return rows.withColumn("prediction", F.when(right, F.col("label")).when(F.col("id") % 20 != 3, "neutral"))

    small, large = (
        {r.model: r for r in bootstrap.rank_intervals(board(n, 5), ["dataset", "review_id"]).collect()}
        for n in (60, 3000)
    )
    other = bootstrap.rank_intervals(board(60, 1), ["dataset", "review_id"]).collect()
    assert {r.model: r for r in other} == small
    for out in (small, large):
        assert all(r.f1_low <= r.f1 <= r.f1_high for r in out.values())
        assert out["good"].model_rank == 1 and out["poor"].model_rank == 2
    assert large["good"].f1_high - large["good"].f1_low < small["good"].f1_high - small["good"].f1_low
    assert large["good"].leads == 1.0 and large["good"].rank_high == 1


# --- response times -------------------------------------------------------------


def test_quantiles_within_the_accuracy(spark):
    """Against exact ranks, for one sketch and for many merged ones."""
    rng = np.random.default_rng(4)
    times = np.concatenate([rng.lognormal(-1, 1.5, 5000), [0.0] * 50, [1e-6, 1e6]])
    rows = [(i % 7, float(t), None) for i, t in enumerate(times)] + [(0, 5e9, "failed")]
    calls = spark.createDataFrame(rows, "part int, elapsed_s double, error string")
    shares = (0.0, 0.005, 0.5, 0.9, 0.99, 1.0)
    whole = latency.sketch(calls.withColumn("k", F.lit(1)), ["k"])
    parts = latency.merged(latency.sketch(calls, ["part"]).withColumn("k", F.lit(1)), ["k"])
    exact = [np.sort(times)[int(math.floor(s * (len(times) - 1)))] for s in shares]
    for sketches in (whole, parts):
        row = latency.quantiles(sketches, ["k"], shares).first()
        assert row.n_calls == len(times)
        for got, want in zip(list(row)[2:], exact, strict=True):
            assert abs(got - want) <= latency.ACCURACY * want + 1e-6


def test_sketches_read_each_file_of_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")

    def commit(first, n, error=None):
        rows = spark.range(first, first + n).select(
            F.lit("summary").alias("task"), F.lit("d").alias("dataset"), F.col("id").alias("review_id"),
            F.lit("A B/c").alias("model"), F.lit(1).alias("attempt"), F.lit("u").alias("user_name"),
            F.lit("").alias("prompt"), F.lit(1).cast("bigint").alias("review_tokens"),
            F.lit(1).cast("bigint").alias("input_tokens"), F.lit("x").alias("raw_output"),
            F.lit(None).cast("bigint").alias("completion_tokens"),
            (F.col("id") + 1).cast("double").alias("elapsed_s"), F.lit(error).cast("string").alias("error"),
        )
        infer.append_log(rows.coalesce(1), path)

    commit(0, 100)
    assert latency.update_sketches(spark, path) == 1
    commit(100, 100)
    commit(500, 5, "timeout")
    assert latency.update_sketches(spark, path) == 2 and latency.update_sketches(spark, path) == 0
    (row,) = latency.latency_of_log(spark, path).collect()
    assert row.n_calls == 200 and abs(row.p50 - 100) <= 1 and abs(row.p99 - 198) <= 2


def test_a_word_of_the_matrix_is_in_one_task(spark):
    """The rows of a word lie in one file, so the sums of a product are few."""
    rows = [(i, " ".join(f"w{'abcdefghij'[(i * k) % 10]}" for k in range(1, 9))) for i in range(200)]
    docs = spark.createDataFrame(rows, "review_id bigint, review string")
    docs = docs.repartition(6)
    for limit in (word_vectors.LIMIT, 0):
        pmi = word_vectors.positive_pmi(word_vectors.cooccurrence(docs, "review", 4, 1, limit), limit)
        files = pmi.select("a", F.input_file_name().alias("f")).distinct().groupBy("a").count()
        assert pmi.count() and files.filter("count > 1").count() == 0


def test_perplexity_in_blocks(spark, monkeypatch):
    """Each block gets the price of each of its n-grams once; repeated keys are one text."""
    monkeypatch.setattr(perplexity, "BLOCK_GRAMS", 8)
    asked = []
    merge = perplexity._block_sums
    monkeypatch.setattr(perplexity, "_block_sums", lambda key: asked.append(key) or merge(key))
    corpus = spark.createDataFrame([("a b a c b a",), ("b c c a",)], "review string")
    rows = [(i % 7, "a b d a", ) for i in range(20)] + [(9, ""), (9, None), (8, "c " * 30)]
    texts = spark.createDataFrame(rows, "id bigint, output string")
    model = perplexity.train(corpus)
    small, large = (
        sorted(map(tuple, perplexity.perplexity(texts, model, ["id"], broadcast_limit=x).collect()))
        for x in (perplexity.LIMIT, 0)
    )
    assert small == large and len(small) == 8 and asked == [["id"]]


def test_an_update_of_sketches_reads_each_call_once(spark, tmp_path, monkeypatch):
    path, read, plain = str(tmp_path / "log"), spark.sparkContext.accumulator(0), latency.sketch
    rows = [("summary", "d", i, "m", 0.5 if i % 3 else 0.0, None if i % 3 else "lost") for i in range(60)]
    calls = spark.createDataFrame(rows, "task string, dataset string, review_id bigint, model string, elapsed_s double, error string")
    known = {f.name for f in calls.schema.fields}
    log = spark.createDataFrame([], latency.schemas.CALL_LOG)
    made = [F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields]
    infer.append_log(calls.select(*made).repartition(3), path)

    def counted(frame, by):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return plain(frame.mapInArrow(run, frame.schema), by)

    monkeypatch.setattr(latency, "sketch", counted)
    files = {os.path.basename(f) for f in spark.read.parquet(path).inputFiles()}
    assert latency.update_sketches(spark, path) == len(files) and read.value == 60
    kept = latency.read_sketches(spark, path).collect()
    assert {r.file for r in kept} == files and sum(r.n for r in kept) == 40
