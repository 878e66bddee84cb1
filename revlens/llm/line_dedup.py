"""Repeated and nearly repeated lines, by a segment-partition edit join.

A line of at least ``min_chars`` characters is dropped when an earlier line (by
id, then text hash, then place) is equal to it or at most t edits away. Shorter
lines repeat by nature and are never compared by edits; those of at least
``min_exact`` characters are dropped when an earlier line is equal, and by default
none is. ``short_repeats`` counts what stays for that reason.

Equal lines are one class, told apart by 96 bits of hash. A class line of n
characters is cut into t + 1 segments, so any line within t edits holds one of
them unchanged, near its place. The index has one key per (length, segment,
text of the segment); a line probes the keys of its own and of each shorter
length, only at the starts that an alignment within t edits allows. Keys held
by one line alone, nearly all of them, end there: keys are counted before
anything is joined.

Candidates are verified by a bit-parallel edit distance over a band of 2 t + 1
diagonals, in integer arithmetic on columns.

Shared keys: lines that share one segment are within t edits if the lines without
it are, and for some segment only if. Up to ``hot`` lines under a key are compared
without it, inside the join, so that only close pairs make rows. A hotter key (a
template that many lines share) is parted by the same rule over what is left of
its lines, again and again, until it is small; at most ``hot`` candidates per line
and key are ever compared, and none is skipped. Where less than a segment is left,
all index lines of the key are within t edits, and a star to the earliest says as
much as all pairs.

Edge cases: null and empty texts have no lines; a null id sorts first; rows equal
in id and text are one document; empty tables stay empty; a document of which
only dropped lines and blank ones were left keeps an empty text (``keep_empty``)
or goes.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.arrays import let
from revlens.llm.sizes import broadcast_if_small
from revlens.llm.words import whole_row
from revlens.session import materialise

MAX_EDITS = 2
MIN_CHARS = 40
HOT = 128
#: Lines under a key up to which their pairs are taken without a look at the rest.
FEW = 3


class Variant(NamedTuple):
    """Segment ``segment`` of an index line ``shorter`` characters shorter than the
    line at hand, looked for ``shift`` places from where the index line has it."""

    segment: int
    shorter: int
    shift: int


def variants(t: int) -> list[Variant]:
    """Index keys first (a line's own segments), then what it probes besides."""
    probes = [
        Variant(i, d, s)
        for d in range(t + 1)
        for i in range(t + 1)
        for s in range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)
    ]
    own = [Variant(i, 0, 0) for i in range(t + 1)]
    return own + [v for v in probes if v not in own]


def _place(
    n: Column, segment: Column, shorter: Column, shift: Column, t: int
) -> tuple[Column, Column, Column, Column]:
    """(length of the index line, start, size, whether it is inside) of a variant in a
    line of n; segments differ in size by at most one, longer ones last."""
    length = n - shorter
    base = F.floor(length / (t + 1)).cast("int")
    late = segment - (t + 1) + (length - base * (t + 1))
    start = segment * base + F.greatest(F.lit(0), late) + shift
    size = base + F.when(late >= 0, 1).otherwise(0)
    return length, start, size, (length > t) & (start >= 0) & (start + size <= n)


def segment_keys(line: Column, n: Column, t: int) -> list[Column]:
    """One key per variant, null where it falls outside."""
    out = []
    for v in variants(t):
        length, start, size, inside = _place(n, *map(F.lit, v), t)
        key = F.xxhash64(F.lit(v.segment), length, F.substring(line, start + 1, size))
        out.append(F.when(inside, key))
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, _h, at, line, n, h1, h2 of every line that takes part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text).alias("_h"),
            F.posexplode(F.split(text, "\n")).alias("at", "line"),
        )
        .withColumn("n", F.length("line"))
        .filter(F.col("n") >= min_chars)
        .withColumns({"h1": F.xxhash64("line"), "h2": F.hash("line")})
    )


def _where() -> Column:
    return F.struct("doc_id", "_h", "at")


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b) of the lines that meet under a key of ``members`` (key, id, own)."""
    index = members.filter("own").select("key", F.col("id").alias("i"))
    met = index.join(members.select("key", F.col("id").alias("j")), "key").filter("i <> j")
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _bucketed(keys: DataFrame) -> DataFrame:
    """key, n, a, b of the keys under which an index line meets another line."""
    return (
        keys.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("own").alias("_own"),
            F.min("id").alias("a"),
            F.max("id").alias("b"),
        )
        .filter("n > 1 and _own and a <> b")
        .drop("_own")
    )


def _met(state: DataFrame, t: int) -> DataFrame:
    """(a, b) of the lines under one key whose rests are within t edits. The distance is
    part of the join's condition: lines that only share the key make no row."""
    one = state.filter("own").select("key", F.col("id").alias("i"), F.col("rest").alias("x"))
    two = state.select(
        "key", F.col("id").alias("j"), F.col("rest").alias("y"), F.col("own").alias("_own")
    )
    once = (F.col("i") != F.col("j")) & (~F.col("_own") | (F.col("i") < F.col("j")))
    met = one.join(two, "key").filter(once & (banded_distance(F.col("x"), F.col("y"), t) <= t))
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _refined(members: DataFrame, lines: DataFrame, t: int, limit: int) -> list[DataFrame]:
    """Pairs from the members (key, id, v, n) of keys, parted until they are small.

    A state row is a line under a key that ``n`` lines share, with the ``rest`` of it and
    how much ``shorter`` the key's index lines are; ``own`` marks those.
    """
    choices = F.array(
        *[
            F.struct(F.lit(k).alias("v"), *[F.lit(x).alias(f) for f, x in v._asdict().items()])
            for k, v in enumerate(variants(t))
        ]
    )
    picked = F.get(choices, F.col("v"))

    def next_state(found: DataFrame, whole: Column) -> DataFrame:
        """Rows (key, id, first, own, v, n) and a line, without the segment of the key."""
        found = found.select("*", *[picked[f].alias(f) for f in Variant._fields])
        n = F.length(whole)
        _, start, size, _ = _place(n, F.col("segment"), F.col("shorter"), F.col("shift"), t)
        rest = F.concat(F.substring(whole, F.lit(1), start), F.substring(whole, start + size + 1, n))
        rows = found.select("key", "id", "first", "own", "shorter", "shift", "n", rest.alias("rest"))
        return rows.withColumn("row", F.xxhash64("key", "id", "own", "shorter", "shift"))

    known = members.join(lines.select("id", "line", "first"), "id")
    state = next_state(known.withColumn("own", F.col("v") <= t), F.col("line"))
    out = []
    while True:
        state = materialise(state, "hot-lines")
        size = F.length("rest")
        few = F.col("n") <= limit
        # too little left for a segment: all index lines here are within t edits
        short = size - F.col("shorter") <= t
        out.append(materialise(_met(state.filter(few), t), "hot-pairs"))
        tail = state.filter(~few & short)
        heads = tail.filter("own").groupBy("key").agg(F.min_by("id", "first").alias("head"))
        star = tail.filter("own").join(heads, "key").select("head", "id").filter("head <> id")
        probes = tail.filter("not own").select("key", F.col("id").alias("head"))
        star = star.union(
            tail.filter("own").join(probes, "key").select("head", "id").filter("head <> id")
        )
        out.append(star.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")))
        crowd = state.filter(~few & ~short)
        if crowd.isEmpty():
            return out
        grown = crowd.select("row", "key", "id", "own", "shorter", "rest", F.explode(choices).alias("c"))
        length, start, part, inside = _place(
            size, F.col("c.segment"), F.col("shorter"), F.col("c.shift"), t
        )
        shared = F.substring("rest", start + 1, part)
        grown = grown.filter((F.col("c.shorter") == F.col("shorter")) & inside).select(
            "row",
            "id",
            F.xxhash64("key", F.col("c.segment"), length, shared).alias("key"),
            (F.col("own") & (F.col("c.v") <= t)).alias("own"),
            "c.v",
        )
        grown = materialise(grown, "hot-keys")
        sizes = materialise(_bucketed(grown).select("key", "n"), "hot-sizes")
        again = grown.join(sizes, "key").select("row", "key", "own", "v", "n")
        state = next_state(
            again.join(state.select("row", "id", "first", "rest"), "row"), F.col("rest")
        )


def banded_distance(left: Column, right: Column, t: int) -> Column:
    """Edits between two strings if at most t, else some number above t.

    One word of 2 t + 1 bits holds the vertical differences of the band; each
    character of the shorter string moves it one diagonal step down. A common
    start of t characters is set before both, so that the band lies inside.
    """
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    def run(s: Column) -> Column:
        a, b, n, m = s["a"], s["b"], F.size(s["a"]), F.size(s["b"])

        def matches(i: Column) -> Column:
            c = F.get(b, i)
            bits = [
                F.when(F.get(a, i + (t + 1 - width + k)) == c, F.lit(1 << k)).otherwise(0)
                for k in range(width)
            ]
            return reduce(lambda x, y: x + y, bits)

        def advance(acc: Column, i: Column) -> Column:
            vp, vn = acc["vp"], acc["vn"]

            def moved(pm: Column) -> Column:
                d0 = (
                    ((pm.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full)).bitwiseXOR(vp))
                    .bitwiseOR(pm)
                    .bitwiseOR(vn)
                )

                def after(d0: Column) -> Column:
                    hp = vn.bitwiseOR(F.lit(full) - d0.bitwiseOR(vp))
                    hn = d0.bitwiseAND(vp)
                    down = F.shiftrightunsigned(d0, 1)
                    inner = i < n - t
                    mask = acc["mask"]
                    step = F.when(
                        inner, F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
                    ).otherwise(
                        F.when(hp.bitwiseAND(mask) != 0, 1).otherwise(0)
                        - F.when(hn.bitwiseAND(mask) != 0, 1).otherwise(0)
                    )
                    return F.struct(
                        hn.bitwiseOR(F.lit(full) - down.bitwiseOR(hp)).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (acc["d"] + step).alias("d"),
                        F.when(inner, mask).otherwise(F.shiftrightunsigned(mask, 1)).alias("mask"),
                    )

                return let(d0, after)

            # so far off that the last t steps cannot bring it back
            return F.when(acc["d"] > 2 * t + m - n, acc).otherwise(let(matches(i), moved))

        start = F.struct(
            F.lit((full << (width - t - 1)) & full).alias("vp"),
            F.lit(0).alias("vn"),
            F.lit(t).alias("d"),
            F.lit(top >> 1).alias("mask"),
        )
        walked = F.aggregate(F.sequence(F.lit(0), m - 1), start, advance, lambda acc: acc["d"])
        return F.when(n - m > t, F.lit(t + 1)).otherwise(walked)

    if t == 0:
        return F.when(left == right, 0).otherwise(1)
    pad = "#" * t
    longer = F.when(F.length(left) >= F.length(right), left).otherwise(right)
    other = F.when(F.length(left) >= F.length(right), right).otherwise(left)
    chars = lambda c: F.split(F.concat(F.lit(pad), c), "")
    return let(F.struct(chars(longer).alias("a"), chars(other).alias("b")), run)


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    hot: int = HOT,
    min_exact: int | None = None,
) -> DataFrame:
    """(doc_id, _h, drops, n_exact, n_near): the places of the lines to drop, for each
    document that has any."""
    t = max_edits
    least = min_chars if min_exact is None else min(min_exact, min_chars)
    scanned = _lines(docs, id_col, text_col, least)
    near_keys = F.array(*segment_keys(F.col("line"), F.col("n"), t))
    if least < min_chars:
        near_keys = F.when(F.col("n") >= min_chars, near_keys)
    classes = scanned.groupBy("h1", "h2").agg(
        F.min(_where()).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.first(near_keys).alias("keys"),
    )
    classes = materialise(classes, "line-classes")
    keys = (
        classes.select(F.col("h1").alias("id"), F.posexplode("keys").alias("v", "key"))
        .filter("key is not null")
        .withColumn("own", F.col("v") <= t)
    )
    met = materialise(_bucketed(keys), "line-keys")
    several = broadcast_if_small(met.filter("n > 2").select("key", "n"))
    members = materialise(keys.join(several, "key"), "line-members")
    pairs = [
        met.filter("n = 2").select("a", "b"),
        materialise(_pairs(members.filter(F.col("n") <= FEW)), "few-pairs"),
    ]
    crowd = members.filter(F.col("n") > FEW)
    ids = [p.select(F.explode(F.array("a", "b")).alias("id")) for p in pairs] + [crowd.select("id")]
    live = materialise(reduce(DataFrame.union, ids).distinct(), "live-ids")
    texts = (
        scanned.join(broadcast_if_small(live), scanned["h1"] == live["id"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.first("line").alias("line"), F.min(_where()).alias("first"))
        .select(F.col("h1").alias("id"), "h2", "line", "first")
    )
    texts = materialise(texts, "live-lines")
    if not crowd.isEmpty():
        pairs += _refined(crowd.select("key", "id", "v", "n"), texts, t, hot)
    candidates = materialise(reduce(DataFrame.union, pairs).distinct(), "line-pairs")
    sides = [
        texts.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "h2", "line", "first")])
        for side in ("a", "b")
    ]
    both = candidates.join(sides[0], F.col("a") == F.col("id_a")).join(
        sides[1], F.col("b") == F.col("id_b")
    )
    links = both.filter(banded_distance(F.col("line_a"), F.col("line_b"), t) <= t)
    a_first = F.col("first_a") < F.col("first_b")
    near = links.select(
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("h1"),
        F.when(a_first, F.col("h2_b")).otherwise(F.col("h2_a")).alias("h2"),
    ).distinct()
    near = materialise(near.withColumn("near", F.lit(True)), "near-lines")
    bad = (
        classes.filter("copies > 1")
        .select("h1", "h2", "first")
        .join(near, ["h1", "h2"], "full")
        .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    bad = materialise(bad, "bad-lines")
    gone = scanned.drop("line", "n").join(broadcast_if_small(bad), ["h1", "h2"])
    # of equal lines the first counts as near, if it goes, and the others as exact
    exact = F.coalesce(_where() != F.col("first"), F.lit(False))
    return (
        gone.withColumn("_exact", exact)
        .filter("near or _exact")
        .groupBy("doc_id", "_h")
        .agg(
            F.collect_set("at").alias("drops"),
            F.countDistinct(F.when(F.col("_exact"), F.col("at"))).alias("n_exact"),
        )
        .withColumn("n_near", F.size("drops") - F.col("n_exact"))
    )


def short_repeats(
    docs: DataFrame,
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """One row (repeated, surplus, long_repeated, long_surplus): the lines that stand more
    than once and their copies beyond the first, of those under ``min_chars`` characters
    (blank ones apart) and of the others. Copies are counted by hash before any shuffle."""
    classes = (
        docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line"))
        .filter(F.trim("line") != "")
        .groupBy(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), (F.length("line") < min_chars).alias("short"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    return classes.agg(
        *[
            made.alias(name)
            for short, prefix in ((F.col("short"), ""), (~F.col("short"), "long_"))
            for made, name in (
                (F.count_if(short), f"{prefix}repeated"),
                (F.coalesce(F.sum(F.when(short, F.col("copies") - 1)), F.lit(0)), f"{prefix}surplus"),
            )
        ]
    )


def _with_drops(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """_row (the columns of ``docs``), _text (what is left of its text), _exact, _near."""
    found = materialise(repeated_lines(docs, id_col, text_col, **how), "dropped-lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        whole_row(docs), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_h"),
        F.col(text_col).alias("_raw"),
    )
    joined = rows.alias("d").join(
        broadcast_if_small(found).alias("f"),
        F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._h") == F.col("f._h")),
        "left",
    )
    raw = F.col("_raw")
    left = let(
        F.split(raw, "\n"),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("f.drops")),
                lambda i: F.get(lines, i),
            ),
            "\n",
        ),
    )
    return joined.select(
        "_row",
        F.when(F.col("f.drops").isNull(), raw).otherwise(left).alias("_text"),
        F.coalesce("f.n_exact", F.lit(0)).cast("bigint").alias("_exact"),
        F.coalesce("f.n_near", F.lit(0)).cast("bigint").alias("_near"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its lines, how many go and why, and what is left."""
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    n_lines = F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0).cast("bigint")
    rows = _with_drops(docs.select("doc_id", "text"), "doc_id", "text")
    return rows.select(
        "_row.doc_id",
        n_lines.alias("n_lines"),
        F.col("_exact").alias("n_exact"),
        F.col("_near").alias("n_near"),
        (n_lines - F.col("_exact") - F.col("_near")).alias("n_kept"),
        F.sha2(F.coalesce("_text", F.lit("")), 256).alias("kept_sha256"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size_col: str | None = "n_chars",
    keep_empty: bool = False,
    **how,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts and ``size_col``
    (if it is there) set to the new length."""
    rows = _with_drops(docs, id_col, text_col, **how)
    if not keep_empty:
        lost = (F.col("_exact") + F.col("_near") > 0) & (F.trim("_text") == "")
        rows = rows.filter(~F.coalesce(lost, F.lit(False)))
    columns = []
    for name, kind in docs.dtypes:
        if name == text_col:
            columns.append(F.col("_text").alias(name))
        elif name == size_col:
            changed = F.col("_exact") + F.col("_near") > 0
            new = F.length("_text").cast(kind)
            columns.append(F.when(changed, new).otherwise(F.col(f"_row.`{name}`")).alias(name))
        else:
            columns.append(F.col(f"_row.`{name}`"))
    return rows.select(*columns)
