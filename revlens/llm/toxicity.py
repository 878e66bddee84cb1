"""Severity of toxic texts by a cumulative-link (proportional odds) model.

P(grade <= k) = sigmoid(cut_k - w.x) with increasing cuts and one weight vector
for all thresholds. x holds log(1 + count) of the terms of a text: its words and
the beginnings of its words (invented or inflected insults share a stem). The
expected severity is sum_k P(grade > k).

Labels say toxic or not; the grades between are made from the labelled sample:
a toxic text's grade is the tercile of its share of telltale terms among the
toxic texts, so grades run from 0 (not toxic) to 3.

The model is fitted on about ``max_rows`` labelled texts, chosen by a hash of the
id, from both classes. Their terms are counted whole in Spark, so the driver sees no
text: it gets the vocabulary (a bounded number of terms) and how often each text has
each of these. Every text is scored whole. Edge cases: null and empty texts get the
severity of a text without terms; rows without a label, or whose label is null,
are not learned from; an id labelled both ways counts as toxic; with no toxic or
no other labelled text nothing is rejected (severity 0), with a warning in the log if
there are toxic labels.
"""

from __future__ import annotations

import logging
import math
from array import array
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.arrow import map_texts
from revlens.llm.words import WORD, py_lower_az, whole_row
from revlens.session import materialise

_log = logging.getLogger(__name__)

#: Bound of the labelled sample, in texts.
MAX_ROWS = 4000
#: A class has at least one text in this many of the sample, if it has that many.
RARE = 20
VOCABULARY = 4000
MIN_TEXTS = 4
STEMS = (4, 5, 6, 7)
GRADES = 3
REJECT_AT = 0.4  # P(grade > 0) from which a text is rejected
BAG = T.StructType(
    [
        T.StructField("total", T.LongType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)
SCORE = T.StructType(
    [
        T.StructField("severity", T.DoubleType()),
        T.StructField("p_toxic", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
    ]
)


class Model(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray


def terms_of(word: str) -> list[str]:
    """A word and, under a mark, its stems."""
    return [word, *(f"{word[:size]}*" for size in STEMS if len(word) > size)]


def terms(text: str) -> Counter:
    """Counts of the words and stems of a text."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(py_lower_az(text))).items():
        for term in terms_of(word):
            out[term] += n
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _vocabulary(texts: list[str], toxic: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """The terms that speak most clearly for either side, and their log odds."""
    seen, in_toxic = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        present = terms(text).keys()
        seen.update(present)
        if y:
            in_toxic.update(present)
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    names = sorted(t for t, n in seen.items() if n >= MIN_TEXTS)
    a = np.array([in_toxic[t] for t in names], dtype=float)
    b = np.array([seen[t] for t in names], dtype=float) - a
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = np.argsort(-np.abs(odds / error), kind="stable")[:VOCABULARY]
    return {names[i]: j for j, i in enumerate(best)}, (odds / error)[best]


def _counted(texts: list[str], index: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(row, feature, count) of the known terms, and the number of all terms of each
    text. One text's terms at a time: only known ones are kept."""
    rows, cols, counts, totals = array("l"), array("l"), array("l"), array("l")
    for i, text in enumerate(texts):
        bag = terms(text)
        totals.append(sum(bag.values()))
        for t, n in bag.items():
            if t in index:
                rows.append(i)
                cols.append(index[t])
                counts.append(n)
    return tuple(np.array(a, dtype=np.int64) for a in (rows, cols, counts, totals))


def _grades(counted: tuple[np.ndarray, ...], toxic: np.ndarray, z: np.ndarray) -> np.ndarray:
    rows, cols, counts, totals = counted
    telltale = np.bincount(rows, counts * (z[cols] > 4), minlength=len(toxic))
    share = telltale / np.maximum(1, totals)
    edges = np.quantile(share[toxic], [i / GRADES for i in range(1, GRADES)])
    return np.where(toxic, 1 + np.searchsorted(edges, share, side="right"), 0)


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """The model of texts at hand; None without both classes."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    index, z = _vocabulary(texts, toxic)
    return fit_counts(_counted(texts, index), toxic, index, z)


def fit_counts(
    counted: tuple[np.ndarray, ...],
    toxic: np.ndarray,
    index: dict[str, int],
    z: np.ndarray,
    rounds: int = 400,
    ridge: float = 0.0005,
) -> Model | None:
    """Full-batch Adam on the penalised likelihood of the grades; ``counted`` has row,
    feature and count of the known terms, and the number of all terms of each row."""
    if not index or not toxic.any() or toxic.all():
        return None
    grade = _grades(counted, toxic, z)
    rows, cols, vals = counted[0], counted[1], np.log1p(counted[2])
    n, d = len(toxic), len(index)
    # cuts[0] free, the gaps between cuts positive through exp
    theta = np.concatenate([np.zeros(d), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(rows, vals * w[cols], minlength=n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = edge[grade] - eta, edge[grade + 1] - eta
        p_low, p_high = _sigmoid(low), _sigmoid(high)
        p = np.maximum(p_high - p_low, 1e-12)
        d_low, d_high = p_low * (1 - p_low) / p, p_high * (1 - p_high) / p
        g_eta = d_high - d_low  # of the negative log likelihood
        g_cuts = np.bincount(grade, d_low, GRADES + 1)[1:] - np.bincount(grade, d_high, GRADES + 1)[:-1]
        g = np.concatenate(
            [
                np.bincount(cols, vals * g_eta[rows], minlength=d) / n + ridge * w,
                [g_cuts.sum() / n],
                [g_cuts[k:].sum() / n * gaps[k - 1] for k in range(1, GRADES)],
            ]
        )
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
    return Model(index, theta[:d], cuts)


def present(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """doc_id, _toxic of the labelled ids that ``docs`` has."""
    marks = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("_toxic"))
    )
    ids = docs.select(F.col(id_col).alias("doc_id"))
    return materialise(marks.join(ids, "doc_id", "left_semi"), "labelled-ids")


def sample(
    docs: DataFrame, marks: DataFrame, sizes: dict[bool, int], id_col: str, text_col: str, max_rows: int
) -> DataFrame:
    """The texts (text, toxic) of about ``max_rows`` labelled ids, those of the smallest
    hashes of the id. Both classes keep their shares, but a rare one gives at least
    ``max_rows // RARE`` ids, or all it has."""
    share = max_rows / max(1, sum(sizes.values()))
    parts = {y: min(1.0, max(share, max_rows // RARE / max(1, n))) for y, n in sizes.items()}
    part = F.when(F.col("_toxic"), parts[True]).otherwise(parts[False])
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**12)) < part * F.lit(1e12))
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # at most about max_rows ids, and RARE-ths of it
    return texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("_toxic").alias("toxic"))


def _bags(texts: list[str]) -> list[list]:
    bags = [terms(text) for text in texts]
    return [[sum(b.values()) for b in bags], [list(b) for b in bags], [list(b.values()) for b in bags]]


def counted_sample(found: DataFrame, max_rows: int) -> DataFrame:
    """(no, toxic, total, terms, times) of the sampled texts (text, toxic), whole; of
    ids with many texts the first ones by hash, for each class."""
    key = {"toxic": F.col("toxic"), "h": F.xxhash64("text")}
    bags = map_texts(found, key, F.col("text"), lambda: _bags, BAG)
    bags = materialise(bags.withColumn("no", F.monotonically_increasing_id()), "labelled-bags")
    kept = [
        bags.filter(F.col("toxic") == y).select("no", "h").orderBy("h", "no").limit(max_rows).select("no")
        for y in (True, False)
    ]
    return bags.join(F.broadcast(kept[0].union(kept[1])), "no")  # at most twice max_rows numbers


def _vocabulary_of(bags: DataFrame, sizes: dict[bool, int]) -> list:
    """(term, z) of the terms that speak most clearly for either side."""
    toxic = F.col("toxic").cast("double")
    seen = (
        bags.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").cast("double").alias("n"), F.sum(toxic).alias("a"))
        .filter(F.col("n") >= MIN_TEXTS)
        .withColumn("b", F.col("n") - F.col("a"))
    )
    n1, n0 = (F.lit(float(max(1, sizes[y]))) for y in (True, False))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    z = (odds / F.sqrt(1 / a + 1 / b)).alias("z")
    return seen.select("term", z).orderBy(F.desc(F.abs("z")), "term").limit(VOCABULARY).collect()


def fit_bags(bags: DataFrame) -> Model | None:
    """The model of counted texts. The driver gets at most VOCABULARY terms, and a row
    and column number and a count for each of them in each text."""
    sizes = {False: 0, True: 0} | {r[0]: r[1] for r in bags.groupBy("toxic").count().collect()}
    if not sizes[True] or not sizes[False]:
        return None
    best = _vocabulary_of(bags, sizes)
    index = {r.term: j for j, r in enumerate(best)}
    spark = bags.sparkSession
    rows = bags.select("no", "toxic", "total").orderBy("no").toPandas()
    if not index:
        return None
    names = spark.createDataFrame(list(index.items()), "term string, col int")
    known = (
        bags.select("no", F.explode(F.arrays_zip("terms", "times")).alias("t"))
        .select("no", F.col("t.terms").alias("term"), F.col("t.times").alias("n"))
        .join(F.broadcast(names), "term")
        .select("no", "col", "n")
        .toPandas()
        .sort_values(["no", "col"])  # so that sums come in one order
    )
    place = np.searchsorted(rows["no"].to_numpy(), known["no"].to_numpy())
    counted = (place, known["col"].to_numpy(np.int64), known["n"].to_numpy(), rows["total"].to_numpy())
    return fit_counts(counted, rows["toxic"].to_numpy(bool), index, np.array([r.z for r in best]))


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> Model | None:
    """The model of a bounded labelled sample: about ``max_rows`` texts, whole."""
    marks = present(docs, labels, id_col)
    sizes = {False: 0, True: 0} | {r[0]: r[1] for r in marks.groupBy("_toxic").count().collect()}
    model = None
    if sizes[True] and sizes[False]:
        found = sample(docs, marks, sizes, id_col, text_col, max_rows)
        model = fit_bags(materialise(counted_sample(found, max_rows), "fit-bags"))
    if model is None and not labels.filter("toxic > 0").isEmpty():
        _log.warning(
            "no toxicity model, nothing is rejected: of the labelled documents %d are toxic and %d are not",
            sizes[True], sizes[False],
        )
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = {t: j for t, j in model.index.items() if not t.endswith("*")}
        self.stems = {t[:-1]: j for t, j in model.index.items() if t.endswith("*")}
        self.starts = {t[: STEMS[0]] for t in self.stems}

    def score(self, texts: list[str]) -> list[list]:
        w, cuts = self.model.weights, self.model.cuts
        words, stems, starts, first = self.words, self.stems, self.starts, STEMS[0]
        severity, p_toxic, grade = [], [], []
        for text in texts:
            counts: Counter = Counter()
            for word, n in Counter(WORD.findall(py_lower_az(text))).items():
                if word in words:
                    counts[words[word]] += n
                if word[:first] in starts:  # few words pass
                    for size in STEMS:
                        if len(word) > size and word[:size] in stems:
                            counts[stems[word[:size]]] += n
            eta = sum(w[j] * math.log1p(n) for j, n in counts.items())
            above = 1 - _sigmoid(cuts - eta)
            p = -np.diff(np.concatenate([[1.0], above, [0.0]]))
            severity.append(float(above.sum()))
            p_toxic.append(float(above[0]))
            grade.append(int(p.argmax()))
        return [severity, p_toxic, grade]


def toxicity(
    docs: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id (or the columns of ``keep``), severity (0 to 3), p_toxic, the likeliest
    grade and ``rejected``."""
    kept = keep or {"doc_id": F.col(id_col)}
    if model is None:
        none = [F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade")]
        scored = docs.select(*[c.alias(k) for k, c in kept.items()], *none)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = map_texts(docs, kept, F.col(text_col), lambda: Scorer(shared.value).score, SCORE)
    return scored.withColumn("rejected", F.col("p_toxic") >= REJECT_AT)


def drop_rejected(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the texts that the model rejects."""
    scored = toxicity(docs, model, id_col, text_col, {"_row": whole_row(docs)})
    return scored.filter(~F.col("rejected")).select("_row.*")
