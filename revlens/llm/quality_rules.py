"""A sparse rule ensemble that scores the quality of texts.

Short trees are grown on statistics of labelled texts; every path from a root to
a node becomes one conjunctive rule; a lasso logistic regression over the rules
keeps few of them; the kept rules are compiled to one Spark column, so scoring
is a projection without Python.

The labelled sample is bounded by ``max_rows`` (chosen by a hash of the id);
every text is scored whole. Ids are split by crc32: remainder 0 modulo 5 is held
out and never learned from. Language, source, id and label are no inputs.

Edge cases: null and empty texts get the score of their statistics (all zero);
an id with several labels counts as good when at least half of them are; with no
labels the score is 0.5, with one class only it is that class's smoothed share;
a null id is not held out; repeated rows each get a row.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.arrays import let
from revlens.llm.words import GAP
from revlens.session import materialise

#: Hashes of ids that a share is taken of: fine enough for any number of labels.
HASHES = 10**15
MAX_ROWS = 20_000
FOLDS = 5
CUT = 0.3  # fixed value: the score from which a text is predicted good
TREES, DEPTH, SEED = 24, 3, 11
LASSO = 0.002
# Common words of four languages, for the share of function words in a text.
COMMON = (
    "the of and to in is that it for on with as was be by at this are "
    "le la les de des un une et est en que qui dans pour sur au du "
    "der die das und ist nicht ein eine mit von zu den sich auf "
    "el los las una que por con para como del se su al"
).split()


class Step(NamedTuple):
    stat: str
    above: bool
    edge: float


Rule = tuple[Step, ...]


class Model(NamedTuple):
    bias: float
    rules: tuple[tuple[Rule, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """What the rules are about, by name."""

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))

    def left_of(pattern: str) -> Column:
        return share(F.length(F.regexp_replace(text, pattern, "")), F.length(text))

    words = F.array_remove(F.split(F.lower(text), GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    about_words = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"),
            share(F.size(F.array_distinct(w)), F.size(w)).alias("distinct"),
            share(F.size(F.filter(w, lambda x: x.isin(COMMON))), F.size(w)).alias("common"),
            share(F.length(F.array_join(w, "")), F.size(w)).alias("mean"),
        ),
    )
    about_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n"),
            share(F.size(F.array_distinct(x)), F.size(x)).alias("distinct"),
            share(F.size(F.filter(x, lambda s: s.rlike("[.!?…]$"))), F.size(x)).alias("ended"),
        ),
    )
    return {
        "chars": F.log1p(F.length(text)).cast("double"),
        "upper": left_of(r"[^A-ZÀ-ÖØ-Þ]+"),
        "digit": left_of(r"[^0-9]+"),
        "odd": left_of(r"[\p{L}\p{N}\s.,;:'()-]+"),
        "_words": about_words,
        "_lines": about_lines,
    }


STATS = {
    "chars": "chars", "upper": "upper", "digit": "digit", "odd": "odd",
    "words": "log1p(_words.n)", "word_distinct": "_words.distinct",
    "word_common": "_words.common", "word_length": "_words.mean",
    "lines": "log1p(_lines.n)", "line_distinct": "_lines.distinct", "line_ended": "_lines.ended",
    "line_length": "chars - log1p(_lines.n)",
}


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and one double per statistic."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    parts = rows.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("_text")).items()])
    return parts.select(
        "doc_id", *[F.expr(e).cast("double").alias(f"s_{n}") for n, e in STATS.items()]
    )


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def rules_of(tree) -> list[Rule]:
    """The conjunctions on the way to every node but the root."""
    out: list[Rule] = []
    names = list(STATS)

    def walk(node, path: Rule) -> None:
        if path:
            out.append(path)
        if node.getClass().getSimpleName() == "InternalNode":
            stat, edge = names[node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), (*path, Step(stat, False, edge)))
            walk(node.rightChild(), (*path, Step(stat, True, edge)))

    walk(tree._call_java("rootNode"), ())
    return out


def condition(rule: Rule) -> Column:
    tests = [
        F.col(f"s_{s.stat}") > s.edge if s.above else F.col(f"s_{s.stat}") <= s.edge for s in rule
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> Model:
    marks = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(remainder(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    )
    share = min(1.0, max_rows / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < int(share * HASHES))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_raw"))
    stats = [f"s_{n}" for n in STATS]
    # at most about max_rows ids; the label travels with the id
    keyed = texts.join(F.broadcast(chosen), "doc_id").select(
        F.struct("doc_id", "label").alias("_key"), "_raw"
    )
    train = with_statistics(keyed, "_key", "_raw").select(
        F.col("doc_id.label").alias("label"), *stats
    )
    train = materialise(train, "quality-sample").withColumn("x", array_to_vector(F.array(*stats)))
    n, good = train.agg(F.count("label"), F.sum("label")).first()
    if not n:
        return Model(0.0, ())
    if good in (0, n):
        return Model(math.log((good + 0.5) / (n - good + 0.5)), ())
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        featureSubsetStrategy="onethird", subsamplingRate=0.8,
    ).fit(train)
    rules = list(dict.fromkeys(r for t in forest.trees for r in rules_of(t)))
    if not rules:
        return Model(math.log((good + 0.5) / (n - good + 0.5)), ())
    held = train.select(
        "label",
        array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("rules"),
    )
    lasso = LogisticRegression(
        labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60
    ).fit(held)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    kept = tuple((r, w) for r, w in zip(rules, weights, strict=True) if w)
    return Model(float(lasso.intercept), kept)


def compiled(model: Model) -> Column:
    """The model as one column over the statistics."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT
) -> DataFrame:
    """doc_id, held_out, score and predicted of every text. Row-local: no shuffle."""
    scored = with_statistics(docs, id_col, text_col).withColumn("score", compiled(model))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
