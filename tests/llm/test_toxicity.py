import math

import numpy as np
import pytest

from revlens.llm.toxicity import (
    Scorer,
    counted_sample,
    drop_rejected,
    fit,
    fit_bags,
    fit_counts,
    fit_model,
    terms,
    toxicity,
)


@pytest.fixture(scope="module")
def labelled(spark, sf):
    wider = sf.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{wider}/documents.parquet")
    labels = spark.read.parquet(f"{wider}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    return [(r.text, r.toxic == 1) for r in rows]


def test_terms_share_stems():
    assert terms("Idiots, idiot!")["idiot*"] == 1 and terms("idiotic idiots")["idiot*"] == 2


def test_held_out_accuracy(labelled):
    train = [r for i, r in enumerate(labelled) if i % 4]
    test = [r for i, r in enumerate(labelled) if i % 4 == 0]
    model = fit([t for t, _ in train], np.array([y for _, y in train]))
    assert np.all(np.diff(model.cuts) > 0)
    severity, p_toxic, grade = Scorer(model).score([t for t, _ in test])
    y, said = np.array([y for _, y in test]), np.array(p_toxic) >= 0.4
    assert (said == y).mean() > 0.97
    assert said[~y].mean() < 0.03
    assert np.mean(np.array(severity)[y]) > 5 * np.mean(np.array(severity)[~y])
    assert all(0 <= s <= 3 for s in severity) and set(grade) <= {0, 1, 2, 3}


def test_grades_share_one_weight_vector():
    """More insults, a higher expected severity: one score moves along all cuts."""
    texts = ["a calm text about trees and rivers"] * 30 + [
        "calm trees " * 3 + "badword " * n for n in range(1, 31)
    ]
    model = fit(texts, np.array([False] * 30 + [True] * 30))
    severity = Scorer(model).score(["calm trees", "badword", "badword " * 4, "badword " * 40])[0]
    assert severity == sorted(severity) and severity[-1] > 1.5 > 0.5 > severity[0]


def test_edge_cases(spark, odd_docs, no_docs):
    schema = "doc_id long, quality int, toxic int, text string"
    docs = odd_docs.select("doc_id", "text", "label")
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, 1, 1, "x"), (0, None, None, "x"), (4, 1, 0, "x")], schema)
    for labels in (none, odd):  # nothing toxic to learn from: nothing is rejected
        model = fit_model(docs, labels)
        assert model is None
        assert {r.severity for r in toxicity(docs, model).collect()} == {0.0}
        assert drop_rejected(odd_docs, model).count() == odd_docs.count()
    texts = ["trash talk scum"] * 6 + ["kind words here"] * 90
    model = fit(texts, np.array([True] * 6 + [False] * 90))
    assert Scorer(model).score(["some scum and trash", "kind words", ""])[1][0] > 0.9
    rows = toxicity(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    kept = drop_rejected(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert drop_rejected(no_docs, model).count() == 0


def test_long_texts_leave_room_for_all(spark):
    """Very long texts, toxic or not, are counted whole and end no sample."""
    rows = [(i, "kind words here", 0) for i in range(60)]
    rows += [(100 + i, "trash talk scum " * (1 + 40 * (i % 2)), 1) for i in range(20)]
    rows += [(200 + i, "plain prose " * 3000, 0) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_model(frame.select("doc_id", "text"), frame.drop("text"))
    assert Scorer(model).score(["some scum and trash", "kind words"])[1][0] > 0.9
    said = toxicity(frame.select("doc_id", "text"), model).filter("rejected").collect()
    assert {r.doc_id for r in said} == set(range(100, 120))


def test_a_rare_class_is_sampled(spark):
    """8 toxic texts of 4,000: a plain sample of 160 holds none of them."""
    rare = [i % 500 == 7 for i in range(4000)]
    rows = [(i, "trash talk scum" if y else "kind words here", int(y)) for i, y in enumerate(rare)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_model(frame.select("doc_id", "text"), frame.drop("text"), max_rows=160)
    assert model is not None and Scorer(model).score(["scum talk"])[1][0] > 0.5


def test_no_model_is_said(spark, caplog):
    docs = spark.createDataFrame([(1, "trash"), (2, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert fit_model(docs, labels) is None
    assert "no toxicity model" in caplog.text


def test_counted_in_spark_like_in_memory(spark, labelled):
    """The same vocabulary, cuts and scores from bags counted in tasks."""
    rows = labelled[:600]
    frame = spark.createDataFrame(rows, "text string, toxic boolean").repartition(5)
    model = fit_bags(counted_sample(frame, 1000))
    want = fit([t for t, _ in rows], np.array([y for _, y in rows]))
    assert set(model.index) == set(want.index)
    assert np.allclose(model.cuts, want.cuts, atol=1e-3)
    texts = [t for t, _ in labelled[600:700]]
    assert np.allclose(Scorer(model).score(texts)[0], Scorer(want).score(texts)[0], atol=1e-2)
    few = counted_sample(frame, 10).groupBy("toxic").count().collect()
    assert {r["count"] for r in few} == {10}


def brute_score(model, text):
    """P(grade <= k) = sigmoid(cut_k - w.x), term by term."""
    x = {t: math.log1p(n) for t, n in terms(text).items() if t in model.index}
    eta = sum(model.weights[model.index[t]] * v for t, v in x.items())
    above = [1 - 1 / (1 + math.exp(-(c - eta))) for c in model.cuts]
    p = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
    return sum(above), above[0], p.index(max(p))


def test_scores_by_the_formula(labelled):
    rows = labelled[:300]
    model = fit([t for t, _ in rows], np.array([y for _, y in rows]))
    texts = [t for t, _ in labelled[300:360]] + ["", "Idiot IDIOTS idiotic", "é 123"]
    for text, *got in zip(texts, *Scorer(model).score(texts), strict=True):
        severity, p_toxic, grade = brute_score(model, text)
        assert abs(got[0] - severity) < 1e-9 and abs(got[1] - p_toxic) < 1e-9 and got[2] == grade


def test_the_fit_is_at_a_minimum():
    """No step of one weight or cut makes the penalised likelihood of the grades better by
    more than the last rounds of the fit still do."""
    rng = np.random.default_rng(2)
    n, d = 200, 5
    toxic = np.arange(n) % 2 == 0
    rows, cols = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(d), indexing="ij"))
    counts = rng.poisson(1 + 2 * toxic[rows] * (cols < 2))
    totals = np.bincount(rows, counts)
    index, z = {f"t{j}": j for j in range(d)}, np.array([9.0, 8.0, 0.0, 0.0, 0.0])
    counted = (rows, cols, counts, totals)
    model = fit_counts(counted, toxic, index, z, rounds=4000)
    telltale = np.bincount(rows, counts * (cols < 2), minlength=n) / np.maximum(1, totals)
    edges = np.quantile(telltale[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(edges, telltale, side="right"), 0)

    def loss(w, cuts):
        eta = np.bincount(rows, np.log1p(counts) * w[cols], minlength=n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        p = [1 / (1 + np.exp(-(edge[grade + k] - eta))) for k in (1, 0)]
        return -np.log(p[0] - p[1]).mean() + 0.0005 / 2 * (w**2).sum()

    best = loss(model.weights, model.cuts)
    for j in range(d + len(model.cuts)):
        for step in (-0.05, 0.05):
            w, cuts = model.weights.copy(), model.cuts.copy()
            (w if j < d else cuts)[j if j < d else j - d] += step
            assert loss(w, cuts) > best - 1e-6
