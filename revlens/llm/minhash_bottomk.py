"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of its distinct five-word shingles; its sketch is the k
smallest XXH64 values of the set. Of the k smallest values of a union, those in
both sets stand in both sketches, and each is in both with the probability J
(the similarity). Two sets with J >= 0.85 therefore share at least ``SHARED`` of
64 values but for one pair in about 10^8 that lie just at the threshold; sets
that fit their sketches share what J demands, without any chance.

1. Equal sets are one class, so copies are never compared.
2. Inverted lists: retained values and the classes that keep them. Values of one
   class, and classes with too few values that others keep, cannot link and go.
   The rest look each other up only by their rarest values: who shares m of s
   values shares one of the first s - m + 1 in any common order.
   The full sets of those left are read, and who shares too little of its full set
   with any other goes too.
3. In each list every class meets the list's leader, the one whose shingles most
   sets have; what links is one component, and nothing inside it is compared again. So a group of a thousand near copies costs thousands of
   comparisons, not millions. Then the classes of a list that are still apart are
   compared in blocks of bounded size, each pair in the list of its rarest common
   value; pairs that are not similar never become rows where both have one pivot.
4. A pair passes if its union sketch has ``SHARED`` common values, and is then
   confirmed by 100 * intersection >= 85 * union on the full sets.

Every table between the steps is written; nothing but counts reaches the driver.

Edge cases: fewer words than a shingle make one shingle of all; null, empty and
blank texts have an empty set, link with nothing and are their own component; a
null id is the component of a row only where no id is reachable; repeated rows
each get a row; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.arrow import map_texts
from revlens.llm.components import components
from revlens.llm.sizes import BROADCAST_BYTES, broadcast_if_small
from revlens.session import materialise

SEED = 42
SHINGLE = 5
PERCENT = 85
#: Sketch size, and how many values of a union sketch two linked sets have in
#: common: P(Binomial(64, 0.85) < 36) is below 1e-8.
K = 64
SHARED = 36
#: Classes of one list that meet in one block of the last round.
BLOCK = 512
SKETCH = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)
FULL = T.StructType([T.StructField("full", T.ArrayType(T.LongType()))])


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles, in ascending order."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    places = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    distinct = {joined[s:e] for s, e in places}
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in distinct), np.uint64, len(distinct))
    return np.sort(hashes.view(np.int64))


def _sketches(k: int, shingle: int):
    def work(texts: list[str]) -> list[list]:
        out: list[list] = [[], [], []]
        for text in texts:
            h = shingle_hashes(text, shingle)
            out[0].append(h.size)
            out[1].append(hashlib.md5(h.tobytes()).digest() if h.size else None)
            out[2].append(h[:k])
        return out

    return lambda: work


def need(n: Column, k: int, shared: int, percent: int) -> Column:
    """How many values of its sketch a set of ``n`` must share with a partner's."""
    return F.least(F.lit(shared), F.ceil(n * percent / F.lit(100))).cast("int")


def rare_values(classes: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """(cls, n, rare): the rarest values of every class that may link, rarest first
    by one order for all; who links shares one of them."""
    lists = classes.select("cls", "n", F.explode("sketch").alias("value"))
    for _ in range(2):  # the second time without the classes that the first ruled out
        kept = (
            lists.join(_often(lists), "value")
            .groupBy("cls", "n")
            .agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("kept"))
            .filter(F.size("kept") >= need(F.col("n"), k, shared, percent))
        )
        kept = materialise(kept, "kept-values")
        lists = kept.select("cls", "n", F.explode("kept.value").alias("value"))
    spare = F.size("kept") - need(F.col("n"), k, shared, percent) + 1
    return kept.select("cls", "n", F.slice("kept.value", F.lit(1), spare).alias("rare"))


def _often(lists: DataFrame) -> DataFrame:
    return lists.groupBy("value").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")


def shared_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, common, fame) of the classes that may link: how many shingles of the full
    set stand in other sets too, and in how many sets each of them stands on average.
    A set of which more than the rest is its own cannot be similar to any."""
    lists = sets.select("cls", F.size("full").alias("n"), F.explode("full").alias("value"))
    return (
        lists.join(_often(lists), "value")
        .groupBy("cls", "n")
        .agg(F.count(F.lit(1)).alias("common"), F.sum("often").alias("often"))
        .filter(F.col("common") * 100 >= F.col("n") * percent)
        .select("cls", "common", (F.col("often") / F.col("n")).alias("fame"))
    )


def _possible(t: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity: the intersection is at most what the
    lesser of both shares with any set, and what a set shares with none is only in
    the union."""
    top = F.least("common_a", "common_b")
    least_union = F.greatest(
        F.greatest("n_a", "n_b"), top + (F.col("n_a") - F.col("common_a")) + (F.col("n_b") - F.col("common_b"))
    )
    return t.filter(100 * top >= percent * least_union)


def _side(table: DataFrame, name: str, *columns: str) -> DataFrame:
    return table.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def _sketch_passes(pairs: DataFrame, sketches: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """Pairs whose union sketch allows the similarity: how many of the k smallest
    values of the union both sketches hold."""
    both = pairs.join(_side(sketches, "a", "n", "sketch"), "a").join(
        _side(sketches, "b", "n", "sketch"), "b"
    )
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    larger = F.greatest("n_a", "n_b")
    return both.filter(estimate >= need(larger, k, shared, percent)).select("a", "b")


def _similar(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both.cast("bigint") >= percent * (a + b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    return (
        pairs.join(_side(sets, "a", "full"), "a")
        .join(_side(sets, "b", "full"), "b")
        .withColumn("both", F.size(F.array_intersect("full_a", "full_b")))
        .filter(_similar(F.col("both"), F.size("full_a"), F.size("full_b"), percent))
        .select("a", "b")
    )


def _placed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` with the component ``comp`` that each class has by now."""
    roots = components(links).select(F.col("node").alias("cls"), "root")
    return lists.join(roots, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")


def _with_leaders(lists: DataFrame) -> DataFrame:
    """Each class of a list with the list's leader: the class with the most fame."""
    one = F.max(F.struct("fame", "cls", "n", "common"))
    return lists.join(lists.groupBy("value").agg(one.alias("lead")), "value")


def _leader_pairs(led: DataFrame, percent: int) -> DataFrame:
    """(a, b): a class and a leader of its lists, where they may link."""
    sides = [F.col(f"lead.{c}").alias(f"{c}_b") for c in ("n", "common")]
    pairs = led.filter("cls <> lead.cls").select(
        F.col("cls").alias("a"), F.col("lead.cls").alias("b"),
        F.col("n").alias("n_a"), F.col("common").alias("common_a"), *sides,
    )
    return _possible(pairs, percent).select("a", "b").distinct()


def _differences(led: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, pivot, apart): the most famous leader that a class meets, and the shingles
    that only one of the two has, where they share at least half."""
    pivots = led.groupBy("cls").agg(F.max(F.struct("lead.fame", "lead.cls")).alias("p"))
    with_sets = (
        pivots.select(F.col("cls").alias("a"), F.col("p.cls").alias("b"))
        .join(_side(sets, "a", "full"), "a")
        .join(_side(sets, "b", "full"), "b")
    )
    apart = F.array_union(F.array_except("full_a", "full_b"), F.array_except("full_b", "full_a"))
    return (
        with_sets.withColumn("apart", apart)
        .filter(3 * F.size("apart") <= F.size("full_a") + F.size("full_b"))
        .select(F.col("a").alias("cls"), F.col("b").alias("pivot"), "apart")
    )


def _in_blocks(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure): all pairs of a list that are still apart and may link, each in the
    list of its rarest common value. A list is dealt to blocks of about BLOCK classes,
    and each pair of blocks is one key of the join.

    Two sets with one pivot need no full sets: they differ in as many shingles as
    both differ from the pivot, less twice those that both differences hold. Such
    pairs are decided here (``sure``) and only the similar ones become rows.
    """
    sizes = (
        lists.groupBy("value")
        .agg(F.count(F.lit(1)).alias("n_list"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo <> hi")
        .select("value", F.ceil(F.col("n_list") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = (
        lists.join(sizes, "value")
        .join(members, "cls")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def side(df: DataFrame, name: str, low: str, high: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{name}") for c in ("n", "common", "comp", "rare", "pivot", "apart")]
        return df.select(
            "value", F.col(low).alias("i"), F.col(high).alias("j"), F.col("cls").alias(name), *columns
        )

    met = side(dealt.filter("block <= other"), "a", "block", "other").join(
        side(dealt.filter("other <= block"), "b", "other", "block").hint("merge"), ["value", "i", "j"]
    )
    met = _possible(met.filter("comp_a <> comp_b and (i < j or a < b)"), percent)
    met = met.filter(F.get(F.array_intersect("rare_a", "rare_b"), F.lit(0)) == F.col("value"))
    differ = F.size("apart_a") + F.size("apart_b") - 2 * F.size(F.array_intersect("apart_a", "apart_b"))
    total = F.col("n_a") + F.col("n_b")
    sure = F.coalesce(F.col("pivot_a") == F.col("pivot_b"), F.lit(False))
    similar = (100 + percent) * differ <= (100 - percent) * total
    return met.filter(~sure | similar).select("a", "b", sure.alias("sure"))


def class_links(
    classes: DataFrame, full_sets, k: int = K, shared: int = SHARED, percent: int = PERCENT
) -> DataFrame:
    """(a, b): links between classes (cls, n, sketch) that connect all that are
    similar. ``full_sets(cls)`` gives (cls, full) for a table of classes."""
    rare = rare_values(classes, k, shared, percent)
    sets = materialise(full_sets(rare.select("cls")), "full-sets")
    rare = materialise(rare.join(shared_shingles(sets, percent), "cls"), "rare-values")
    sketches = materialise(classes.join(rare.select("cls"), "cls", "left_semi"), "link-sketches")
    lists = rare.select("cls", "n", "common", "fame", F.explode("rare").alias("value"))

    def check(pairs: DataFrame) -> DataFrame:
        return confirmed(_sketch_passes(pairs, sketches, k, shared, percent), sets, percent)

    led = _with_leaders(lists)
    links = materialise(check(_leader_pairs(led, percent)), "class-links")
    differences = materialise(_differences(led, sets), "differences")
    placed = materialise(_placed(lists, links).select("value", "cls", "comp"), "placed-lists")
    members = rare.drop("fame").join(differences, "cls", "left")
    met = materialise(_in_blocks(placed, members, percent), "block-pairs")
    rest = check(met.filter("not sure").select("a", "b"))
    return links.union(met.filter("sure").select("a", "b")).union(materialise(rest, "class-links"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    k: int = K,
    shared: int = SHARED,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    ``k`` and ``shared`` belong to ``percent``: choose them so that a binomial of k
    draws with that chance hardly ever falls below ``shared``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = {"doc_id": F.col(id_col), "text_key": F.unhex(F.md5(text))}
    rows = materialise(map_texts(docs, key, text, _sketches(k, shingle), SKETCH), "sketches")
    classes = materialise(
        rows.filter("n > 0")
        .dropDuplicates(["digest"])
        .withColumn("cls", F.monotonically_increasing_id()),
        "set-classes",
    )

    def full_sets(wanted: DataFrame) -> DataFrame:
        """The full sets of the wanted classes, from the text of one row of each."""
        of = materialise(classes.join(wanted, "cls").select("cls", "doc_id", "text_key"), "wanted")
        of = of.select(F.col("doc_id").alias("_of"), "text_key", "cls")
        source = docs.select(
            F.col(id_col).alias("_id"), text.alias("_body"), F.unhex(F.md5(text)).alias("_key")
        )
        chosen = source.join(
            broadcast_if_small(of, limit),
            (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("_of")),
        )
        sets = map_texts(
            chosen, {"cls": F.col("cls")}, F.col("_body"),
            lambda: lambda texts: [[shingle_hashes(t, shingle) for t in texts]], FULL,
        )
        return sets.dropDuplicates(["cls"])

    linked = components(class_links(classes.select("cls", "n", "sketch"), full_sets, k, shared, percent))
    least = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    rooted = (
        classes.select("cls", "digest")
        .join(linked, F.col("cls") == F.col("node"), "left")
        .select("digest", F.coalesce("root", "cls").alias("root"))
        .join(least, "digest")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("digest", "component_id"), "components")
    named = named.withColumnRenamed("digest", "_set")
    component = F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, F.col("digest") == F.col("_set"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
