"""Row-local array algebra: n-grams, multisets and alignments.

Each helper binds its inputs once with :func:`let`. Without that the optimizer
may inline the expression that builds an array into a lambda body and rebuild
the array for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_ids(ids: Column, n: int) -> Column:
    """Word n-grams of an array of word ids (:func:`word_ids`) as one bigint each."""
    if n == 1:
        return ids
    return let(
        ids,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.slice(t, F.lit(1), F.size(t) - (n - 1)),
                lambda x, i: F.xxhash64(x, *[F.get(t, i + k) for k in range(1, n)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def word_ids(toks: Column) -> Column:
    """A 64-bit digest for each token: numbers sort and compare faster than text."""
    return F.transform(toks, lambda w: F.xxhash64(w))


def _run_starts(s: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Places in the sorted, non-empty array ``s`` where a run of equal items starts."""
    return F.filter(
        F.sequence(F.lit(0), F.size(s) - 1),
        lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, i - 1)),
    )


def term_counts(items: Column, kind: str = "string") -> Column:
    """array<struct<term, n>> of the distinct items, in O(n log n): sort, find
    where each run of equal items starts, and measure the runs."""

    def with_sorted(s: Column) -> Column:
        return let(
            _run_starts(s, lambda x, y: x == y),
            lambda b: F.transform(
                b,
                lambda st, j: F.struct(
                    F.get(s, st).alias("term"),
                    (F.coalesce(F.get(b, j + 1), F.size(s)) - st).cast("bigint").alias("n"),
                ),
            ),
        )

    return F.when(F.size(items) > 0, let(F.sort_array(items), with_sorted)).otherwise(
        F.array().cast(f"array<struct<term:{kind},n:bigint>>")
    )


def overlaps(a: Column, b: Column) -> Column:
    """struct<n_a, n_b, distinct_a, distinct_b, common, clipped> of two arrays of
    bigints: sizes, distinct sizes, shared items, and the sum over shared items of
    min(count in a, count in b).

    The counted items of both sides are sorted as one list, where a shared item
    stands next to itself: O(n log n) whatever repeats.
    """

    def marked(counts: Column, side: int) -> Column:
        return F.transform(
            counts,
            lambda t: F.struct(t["term"].alias("term"), F.lit(side).alias("side"), t["n"].alias("n")),
        )

    def measured(s: Column) -> Column:
        def of_shared(shared: Column) -> Column:
            return F.struct(
                F.size(s["a"]).cast("bigint").alias("n_a"),
                F.size(s["b"]).cast("bigint").alias("n_b"),
                F.size(s["ta"]).cast("bigint").alias("distinct_a"),
                F.size(s["tb"]).cast("bigint").alias("distinct_b"),
                F.size(shared).cast("bigint").alias("common"),
                F.aggregate(
                    shared, F.lit(0).cast("bigint"), lambda acc, x: acc + x
                ).alias("clipped"),
            )

        merged = F.sort_array(F.concat(marked(s["ta"], 0), marked(s["tb"], 1)))
        shared = let(
            merged,
            lambda m: F.filter(
                F.transform(
                    m,
                    lambda x, i: F.when(
                        (i > 0) & (F.get(m, i - 1)["term"] == x["term"]),
                        F.least(F.get(m, i - 1)["n"], x["n"]),
                    ),
                ),
                lambda n: n.isNotNull(),
            ),
        )
        return let(shared, of_shared)

    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda s: let(
            F.struct(
                s["a"].alias("a"),
                s["b"].alias("b"),
                term_counts(s["a"], "bigint").alias("ta"),
                term_counts(s["b"], "bigint").alias("tb"),
            ),
            measured,
        ),
    )


def matched_from_end(a: Column, b: Column) -> Column:
    """array<struct<a, b>> of places, in the order of ``a``: the k-th occurrence of an
    item counted from the end of ``a`` meets its k-th occurrence from the end of ``b``.

    Each side numbers its items' occurrences from the end (one sort); sorted
    together, the two sides of a match are neighbours. O(n log n) in all.
    """

    def numbered(items: Column, side: int) -> Column:
        placed = F.sort_array(F.transform(items, lambda w, i: F.struct(w.alias("w"), (-i).alias("at"))))

        def with_sorted(s: Column) -> Column:
            return let(
                _run_starts(s, lambda x, y: x["w"] == y["w"]),
                lambda starts: F.flatten(
                    F.transform(
                        starts,
                        lambda st, j: F.transform(
                            F.slice(s, st + 1, F.coalesce(F.get(starts, j + 1), F.size(s)) - st),
                            lambda x, k: F.struct(
                                x["w"].alias("w"), k.alias("k"), F.lit(side).alias("side"),
                                (-x["at"]).alias("at"),
                            ),
                        ),
                    )
                ),
            )

        empty = F.array().cast("array<struct<w:bigint,k:int,side:int,at:int>>")
        return F.when(F.size(items) > 0, let(placed, with_sorted)).otherwise(empty)

    def met(m: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            before = F.get(m, i - 1)
            return F.when(
                (i > 0) & (before["w"] == x["w"]) & (before["k"] == x["k"]),
                F.struct(before["at"].alias("a"), x["at"].alias("b")),
            )

        return F.sort_array(F.filter(F.transform(m, pair), lambda p: p.isNotNull()))

    return let(F.sort_array(F.concat(numbered(a, 0), numbered(b, 1))), met)


def running_starts(sizes: Column, block: int = 64, levels: int = 3) -> Column:
    """array<bigint>: for each of the bigint ``sizes`` the sum of those before it.

    A fold that appends to a list copies the list at every step, so only lists of up
    to ``block`` items grow that way: longer ones are cut into blocks, whose sums give
    each block its start, in as many levels. Close to linear for millions of items.
    """
    zero = F.struct(
        F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("starts")
    )

    def grown(items: Column) -> Column:
        return F.aggregate(
            items,
            zero,
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"),
                F.concat(acc["starts"], F.array(acc["sum"])).alias("starts"),
            ),
            lambda acc: acc["starts"],
        )

    if levels == 1:
        return grown(sizes)

    def placed(parts: Column) -> Column:
        sums = F.transform(
            parts, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, y: acc + y)
        )
        return let(
            running_starts(sums, block, levels - 1),
            lambda base: F.flatten(
                F.transform(
                    parts, lambda x, i: F.transform(grown(x), lambda start: start + F.get(base, i))
                )
            ),
        )

    def cut(items: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(items), F.lit(block))
        parts = F.transform(firsts, lambda first: F.slice(items, first, F.lit(block)))
        return F.when(F.size(items) <= block, grown(items)).otherwise(let(parts, placed))

    return let(sizes, cut)
