"""Mixing sources to target weights over a domain - language - source tree.

Token counts become a budget for every node, top down. A level's children share
their parent's budget in proportion to their weights; a child that cannot use
its share (its capacity is its tokens times ``max_epochs``) takes what it has,
and the shortage goes to its siblings by the same weights. Since a node's
capacity is that of its leaves (of those that no weight 0 on their path leaves
out), a shortage leaves a subtree only when all of it is full: siblings come before ancestors. Shares are whole tokens, rounded down.

A leaf with budget b and t tokens gives every document ``b div t`` times, and
once more those of a prefix of ``b mod t`` tokens in the order of the next
epoch, which a seeded digest draws anew for each epoch. The prefix ends before
the first document that would exceed it; equal rows go together.

Nothing is ordered as a whole: digests fall into 65,536 buckets by their first
four digits, buckets are summed before they are shuffled, and only the one
bucket where a leaf's prefix ends is looked at by document. The choice is then
one comparison per document, so texts are never shuffled.

Edge cases: a null level is the value ``(none)``; a value without a weight
weighs ``default_weight``; weight 0 leaves a subtree out; documents without
words (null, empty) are not selected; a budget beyond all capacity takes all of
it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.sizes import broadcast_if_small
from revlens.llm.words import whole_row, words
from revlens.session import materialise

NONE = "(none)"
LEVELS = ("domain", "lang", "source")
#: Production weights by level and value; others weigh DEFAULT_WEIGHT.
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 5, "fr": 2, "de": 2, "es": 2},
}
DEFAULT_WEIGHT = 1
PERCENT = 60  # of the corpus's tokens
MAX_EPOCHS = 2
SEED = "mix-1"
DIGITS = 4


def domain_of(source: Column) -> Column:
    """Five numbered sources make a domain; a source without a number is one itself."""
    number = F.regexp_extract(source, "([0-9]+)", 1)
    return F.when(
        number != "", F.concat(F.lit("domain"), F.floor(number.cast("bigint") / 5).cast("string"))
    ).otherwise(source)


def _weight(level: str, weights: dict[str, dict[str, int]], default: int) -> Column:
    out = F.lit(default).cast("bigint")
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(weight).cast("bigint")).otherwise(out)
    return out


def share_out(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``children`` (parent.., name, weight, capacity, budget of the parent) with the
    budget of each child.

    In the order of capacity per weight a child is full exactly when its fair
    part of what the ones before it left is at least its capacity; the others
    share the rest.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(name)]
    family = Window.partitionBy(*parent)
    before = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = family.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    open_ = (
        children.filter("weight > 0 and capacity > 0")
        .withColumn("_left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(onward))
        .withColumn("_full", F.col("capacity") * F.col("_rest") <= F.col("weight") * F.col("_left"))
    )
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(family), F.lit(0))
    weights = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family)
    return (
        open_.withColumn("_over", F.col("budget") - taken)
        .withColumn("_weights", weights)
        .withColumn(
            "budget",
            F.when(F.col("_full"), F.col("capacity")).otherwise(
                F.expr("(weight * _over) div _weights")
            ),
        )
        .drop("_left", "_rest", "_full", "_over", "_weights")
    )


def budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: dict[str, dict[str, int]],
    default_weight: int,
    percent: int,
    max_epochs: int,
) -> DataFrame:
    """(levels.., tokens, budget) of every leaf that gets tokens; ``leaves`` has the
    levels and tokens."""
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    usable = F.lit(True)
    for level in levels:
        usable = usable & (_weight(level, weights, default_weight) > 0)
    room = F.when(usable, F.col("tokens") * max_epochs).otherwise(0)
    got = None
    for depth in range(1, len(levels) + 1):
        parent, name = list(levels[: depth - 1]), levels[depth - 1]
        nodes = leaves.groupBy(*levels[:depth]).agg(
            F.sum("tokens").alias("tokens"), F.sum(room).alias("capacity")
        )
        nodes = nodes.withColumn("weight", _weight(name, weights, default_weight))
        if got is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast("bigint"))
        else:
            nodes = nodes.join(got.select(*parent, "budget"), parent)
        got = share_out(nodes, parent, name)
    return got.select(*levels, "tokens", "budget")


def _digest(seed: str, epoch: Column) -> Column:
    return F.md5(
        F.concat_ws(
            ":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("_id"), F.lit("")), F.col("_md5")
        )
    )


def _measured(docs: DataFrame, levels: dict[str, Column], id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = {name: F.coalesce(c.cast("string"), F.lit(NONE)) for name, c in levels.items()}
    return docs.select(
        whole_row(docs),
        *[c.alias(f"_level_{name}") for name, c in named.items()],
        F.col(id_col).cast("string").alias("_id"),
        F.md5(text).alias("_md5"),
        F.size(words(F.col(text_col))).cast("bigint").alias("_tokens"),
    )


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]] = WEIGHTS,
    default_weight: int = DEFAULT_WEIGHT,
    percent: int = PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The selected rows of ``docs`` with ``n_tokens`` and ``copies`` (epochs that
    hold the document); level values are columns named ``mix_<level>``. A column of
    ``docs`` that is named like one of these gives way to it."""
    names = list(levels)
    added = {*(f"mix_{n}" for n in names), "n_tokens", "copies"}
    measured = _measured(docs, levels, id_col, text_col)
    narrow = measured.filter("_tokens > 0").select(
        *[F.col(f"_level_{n}").alias(n) for n in names], "_id", "_md5", "_tokens"
    )
    narrow = materialise(narrow, "mix-rows")
    leaves = materialise(
        narrow.groupBy(*names).agg(F.sum("_tokens").alias("tokens")), "mix-leaves"
    )
    plan = budgets(leaves, names, weights, default_weight, percent, max_epochs).select(
        *names,
        F.expr("budget div tokens").alias("_full"),
        F.expr("budget % tokens").alias("_part"),
    )
    plan = materialise(plan.filter("_full > 0 or _part > 0"), "mix-plan")
    small = broadcast_if_small(plan)
    keyed = narrow.join(small, names).withColumn("_key", _digest(seed, F.col("_full")))
    cells = keyed.groupBy(*names, F.substring("_key", 1, DIGITS).alias("_cell")).agg(
        F.sum("_tokens").alias("_t"), F.first("_part").alias("_part")
    )
    upto = Window.partitionBy(*names).orderBy("_cell")
    ends = (
        cells.withColumn("_sum", F.sum("_t").over(upto))
        .filter("_sum > _part")
        .groupBy(*names)
        .agg(F.min_by(F.struct("_cell", (F.col("_sum") - F.col("_t")).alias("_before")), "_cell").alias("_e"))
        .select(*names, "_e._cell", "_e._before")
    )
    ends = materialise(ends, "mix-ends")
    last = (
        keyed.withColumn("_cell", F.substring("_key", 1, DIGITS))
        .join(broadcast_if_small(ends), [*names, "_cell"])
        .groupBy(*names, "_key")
        .agg(F.sum("_tokens").alias("_t"), F.first("_part").alias("_part"), F.first("_before").alias("_before"))
        .withColumn("_sum", F.sum("_t").over(Window.partitionBy(*names).orderBy("_key")))
        .filter("_before + _sum <= _part")
        .groupBy(*names)
        .agg(F.max("_key").alias("_last"))
    )
    # a bare cell sorts before every key in it and after every key of lower cells
    cuts = plan.join(ends, names, "left").join(last, names, "left").select(
        *[F.col(n).alias(f"_level_{n}") for n in names],
        "_full",
        F.coalesce("_last", "_cell", F.lit("")).alias("_cut"),
    )
    cuts = materialise(cuts, "mix-cuts")
    chosen = measured.filter("_tokens > 0").join(
        broadcast_if_small(cuts), [f"_level_{n}" for n in names]
    )
    copies = F.col("_full") + F.when(_digest(seed, F.col("_full")) <= F.col("_cut"), 1).otherwise(0)
    return (
        chosen.withColumn("copies", copies.cast("bigint"))
        .filter("copies > 0")
        .select(
            *[F.col(f"_row.`{c}`") for c in docs.columns if c not in added],
            *[F.col(f"_level_{n}").alias(f"mix_{n}") for n in names],
            F.col("_tokens").alias("n_tokens"),
            "copies",
        )
    )


def corpus_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
