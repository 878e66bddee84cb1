"""Benchmark passages in training texts, by a distributed positional inverted index.

1. The words of the benchmark are counted in the corpus.
2. Every window (``WINDOW`` consecutive words of an item, or a shorter item
   whole) names its ``ANCHORS`` rarest words that the corpus has; a window with
   too many words that the corpus lacks can be neither there nor near.
3. The index stores the postings (word, document, position) of the anchor words,
   and each document's length as the posting of the empty word.
4. Postings are shifted by the anchor's place in the item; those that meet within
   ``SLACK`` words of one offset of one document are intersected: only an offset
   with as many anchors around it as a window has is a candidate.
5. At those offsets the document's words are compared with the item's. An exact
   phrase match is a window that stands there word for word. A proximity match is
   a window of which at least ``NEAR`` percent of the words stand within ``SLACK``
   words of their place; it is reported with its item and the place in the
   document where the window would start.

Only benchmark-sized tables are broadcast, after their size is measured; beyond
that, words that are everywhere are dealt over several tasks. A word, a document or
a passage that is everywhere only makes more rows of its postings: nothing is
collected by word, and counts are summed before they are shuffled.

Edge cases: null and empty texts have no words and no hits; an item without
words or without an id takes no part; rows that share an id are told apart by
their text, equal rows get equal results; empty tables give no hits; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.arrays import let
from revlens.functions.skew import hot_key_join
from revlens.llm.sizes import BROADCAST_BYTES, broadcast_if_small, is_small
from revlens.llm.words import whole_row, words
from revlens.session import materialise

WINDOW = 13
ANCHORS = 3
SLACK = 13
NEAR = 75
SHARE = 20  # fixed value: contaminated when at least one word in so many is hit


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash that tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_h"), text.alias("_text")
    )


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (
        F.col(f"{a}._h") == F.col(f"{b}._h")
    )


def benchmark_items(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item (a key of its own), item_id, w (its words) and size of its windows."""
    rows = (
        items.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
        .filter(F.size("w") > 0)
        .distinct()
    )
    return rows.select(
        F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), "w"), 256).alias("item"),
        "item_id",
        "w",
        F.least(F.lit(window), F.size("w")).alias("size"),
    )


def term_counts(keyed: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in the corpus."""
    seen = keyed.select(F.explode(words(F.col("_text"))).alias("word"))
    return seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, per_window: int, near: int) -> DataFrame:
    """(item, place, word, need, len): the rarest words of each window that can be there
    or near, among those that the corpus has."""
    placed = items.select("item", "size", F.posexplode("w").alias("place", "word"))
    ranked = (
        placed.join(counts, "word", "left")
        .groupBy("item", "size")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "word"))
            ).alias("p")
        )
    )

    def rarest(start: Column) -> Column:
        seen = F.filter(F.slice(F.col("p"), start, F.col("size")), lambda x: x["n"] > 0)
        order = F.array_sort(F.transform(seen, lambda x: F.struct(x["n"], x["place"], x["word"])))
        return let(
            order,
            lambda o: F.slice(
                o, 1, F.when(100 * F.size(o) >= near * F.col("size"), per_window).otherwise(0)
            ),
        )

    windows = F.transform(F.sequence(F.lit(1), F.size("p") - F.col("size") + 1), rarest)
    need = F.least(F.lit(per_window), F.col("size"))
    return ranked.select(
        "item",
        need.alias("need"),
        F.size("p").alias("len"),
        F.explode(F.array_distinct(F.flatten(windows))).alias("a"),
    ).select("item", "a.place", "a.word", "need", "len")


def postings(keyed: DataFrame, rare: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """The index: (word, doc_id, _h, at) of every occurrence of the words of ``rare``,
    and one row a document whose word is empty and whose ``at`` is its length.
    ``counts`` (word, n) names the words that are hot in a shuffled join."""
    ends = F.concat(words(F.col("_text")), F.array(F.lit("")))
    at = keyed.select("doc_id", "_h", F.posexplode(ends).alias("at", "word"))
    if is_small(rare, limit):
        return at.join(F.broadcast(rare), "word", "left_semi").select("word", "doc_id", "_h", "at")
    found = hot_key_join(
        at,
        rare.withColumn("_rare", F.lit(True)),
        ["word"],
        counts.withColumnRenamed("n", "n_rows"),
        ["doc_id", "_h", "at"],
    )
    return found.filter(F.col("_rare")).select("word", "doc_id", "_h", "at")


def candidates(index: DataFrame, wanted: DataFrame, counts: DataFrame, slack: int, limit: int) -> DataFrame:
    """(doc_id, _h, item, offset, len, whole): offsets with at least ``need`` anchors
    within ``slack`` words; ``whole`` where so many meet at the offset itself."""
    if is_small(wanted, limit):
        met = index.join(F.broadcast(wanted), "word")
    else:
        met = hot_key_join(
            index.filter("word <> ''"),
            wanted,
            ["word"],
            counts.withColumnRenamed("n", "n_rows"),
            ["doc_id", "_h", "at"],
        )
    # rows that are equal in id and text put their postings here once each
    copies = (
        index.filter("word = ''").groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("copies"))
    )
    repeated = broadcast_if_small(materialise(copies.filter("copies > 1"), "repeated"), limit)
    # dealt by document and item once, for the sum at an offset and for the one around it
    offsets = (
        met.select("doc_id", "_h", "item", "need", "len", (F.col("at") - F.col("place")).alias("offset"))
        .repartition("doc_id", "_h", "item")
        .groupBy("doc_id", "_h", "item", "offset", "need", "len")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    around = Window.partitionBy("doc_id", "_h", "item").orderBy("offset").rangeBetween(-slack, slack)
    met_near = offsets.withColumn("m", F.sum("n").over(around)).filter("m >= need")
    one = F.coalesce("copies", F.lit(1))
    return (
        met_near.alias("o")
        .join(repeated.alias("r"), _same_doc("o", "r"), "left")
        .filter(F.col("m") >= one * F.col("need"))
        .select(
            "o.doc_id", "o._h", "item", "offset", "len",
            (F.col("n") >= one * F.col("need")).alias("whole"),
        )
    )


def _stretches(offsets: DataFrame, keyed: DataFrame, slack: int, limit: int) -> DataFrame:
    """The candidates with ``lead`` and ``ws``: the words of the document from ``lead``
    on that an item at this offset could hold; besides n_words."""
    per_doc = offsets.groupBy("doc_id", "_h").agg(
        F.collect_list(F.struct("item", "offset", "len", "whole")).alias("c")
    )
    per_doc = materialise(per_doc, "candidates")
    keys = broadcast_if_small(per_doc.select("doc_id", "_h"), limit)
    # equal rows are compared once
    texts = (
        keyed.alias("d")
        .join(keys.alias("k"), _same_doc("d", "k"), "left_semi")
        .groupBy("doc_id", "_h")
        .agg(F.first("_text").alias("_text"))
        .select("doc_id", "_h", words(F.col("_text")).alias("words"))
    )

    def cut(of: Column, c: Column) -> Column:
        lead = F.greatest(F.lit(0), c["offset"] - slack)
        size = F.greatest(F.lit(0), c["offset"] + c["len"] + slack - lead)
        return F.struct(
            c["item"].alias("item"), c["offset"].alias("offset"), c["whole"].alias("whole"),
            lead.alias("lead"), F.slice(of, lead + 1, size).alias("ws"),
        )

    both = texts.alias("t").join(per_doc.alias("p"), _same_doc("t", "p"))
    return both.select(
        "t.doc_id",
        "t._h",
        F.size("t.words").cast("bigint").alias("n_words"),
        F.explode(let(F.col("t.words"), lambda of: F.transform("p.c", lambda c: cut(of, c)))).alias("c"),
    ).select("doc_id", "_h", "n_words", "c.*")


def _judged(stretches: DataFrame, items: DataFrame, slack: int, near: int, limit: int) -> DataFrame:
    """doc_id, _h, n_words, item_id, size, hits and nears (places of the document where a
    window of the item stands, and would start)."""
    told = items.select("item", "item_id", "w", "size")
    rows = stretches.join(broadcast_if_small(told, limit), "item")
    ws, offset, lead, size = (F.col(c) for c in ("ws", "offset", "lead", "size"))

    def marks(test) -> Column:
        return F.array_join(
            F.transform("w", lambda x, j: F.when(test(x, offset + j), "1").otherwise("0")), ""
        )

    def stands(x: Column, place: Column) -> Column:
        return F.get(ws, place - lead) == x

    def close(x: Column, place: Column) -> Column:
        first = F.greatest(place - slack, lead)
        return F.array_contains(
            F.slice(ws, first - lead + 1, F.greatest(F.lit(0), place + slack - first + 1)), x
        )

    def windows(line: Column, percent: int) -> Column:
        """Places of the windows with that share of marks."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size("w") - size),
            lambda s: 100 * F.length(F.replace(F.substring(line, s + 1, size), F.lit("0"), F.lit("")))
            >= percent * size,
        )
        return F.transform(starts, lambda s: (offset + s).cast("bigint"))

    none = F.array().cast("array<bigint>")
    return rows.select(
        "doc_id",
        "_h",
        "n_words",
        "item_id",
        "size",
        F.when(F.col("whole"), let(marks(stands), lambda m: windows(m, 100))).otherwise(none).alias("hits"),
        let(marks(close), lambda m: windows(m, near)).alias("nears"),
    ).filter("size(hits) > 0 or size(nears) > 0")


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    per_window: int = ANCHORS,
    slack: int = SLACK,
    near: int = NEAR,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The documents that have an exact or a proximity match, one row for each (id,
    text): doc_id, _h, n_words, n_hit, matched (item ids with exact matches) and near
    (item_id and first place of every item with proximity matches, the exact ones
    among them)."""
    return _find(
        _keyed(docs, id_col, text_col),
        materialise(benchmark_items(benchmark, item_col, item_text_col, window), "items"),
        per_window, slack, near, broadcast_bytes,
    )[0]


def _find(
    keyed: DataFrame, items: DataFrame, per_window: int, slack: int, near: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """What ``find_benchmark`` returns, and the index."""
    terms = materialise(items.select(F.explode("w").alias("word")).distinct(), "terms")
    if is_small(terms, limit):
        counts = term_counts(keyed).join(F.broadcast(terms), "word", "left_semi")
        all_counts = counts = materialise(counts, "term-counts")
    else:
        # all words, since those that are nobody's anchor can be hot as well
        all_counts = materialise(term_counts(keyed), "word-counts")
        counts = all_counts.join(terms, "word", "left_semi")
    wanted = materialise(anchors(items, counts, per_window, near), "anchors")
    empty = terms.sparkSession.range(1).select(F.lit("").alias("word"))
    rare = materialise(wanted.select("word").distinct().union(empty), "anchor-terms")
    index = materialise(postings(keyed, rare, all_counts, limit), "postings")
    stretches = _stretches(candidates(index, wanted, all_counts, slack, limit), keyed, slack, limit)
    judged = materialise(_judged(stretches, items, slack, near, limit), "matches")
    doc = ["doc_id", "_h"]
    # words inside windows: each window counts from where those before it end
    hits = judged.select(*doc, "size", F.explode("hits").alias("at")).groupBy(*doc, "at").agg(F.max("size").alias("size"))
    before = Window.partitionBy(*doc).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(F.max(end).over(before), "at")))
    n_hit = hits.withColumn("fresh", fresh).groupBy(*doc).agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    by_item = judged.groupBy(*doc, "item_id").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.size("hits") > 0).alias("exact"),
        F.min(F.array_min("nears")).alias("at"),
    )
    per_doc = by_item.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"),
        F.collect_list(F.when(F.col("exact"), F.col("item_id"))).alias("matched"),
        F.array_sort(
            F.collect_list(F.when(F.col("at").isNotNull(), F.struct("item_id", "at")))
        ).alias("near"),
    )
    found = per_doc.alias("p").join(n_hit.alias("n"), _same_doc("p", "n"), "left")
    return found.select(
        "p.doc_id", "p._h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "matched", "near"
    ), index


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row for each document with its hits, whether it is contaminated, and its
    proximity matches (``near_items``: item and place of the first of each item)."""
    items = materialise(benchmark_items(benchmark, "item_id", "text", WINDOW), "items")
    found, index = _find(
        _keyed(docs, "doc_id", "text"), items, ANCHORS, SLACK, NEAR, broadcast_bytes
    )
    found = broadcast_if_small(materialise(found, "found"), broadcast_bytes)
    sized = index.filter("word = ''").select("doc_id", "_h", F.col("at").cast("bigint").alias("n_words"))
    rows = sized.alias("d").join(found.alias("f"), _same_doc("d", "f"), "left")
    ids = F.array_sort(F.transform("matched", lambda x: x.cast("string")))
    near = F.array_sort(F.transform("near", lambda x: F.concat_ws(":", x["item_id"], x["at"])))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")

    def size(array: str) -> Column:
        return F.when(F.col(array).isNull(), 0).otherwise(F.size(array)).cast("bigint")

    return rows.select(
        "d.doc_id",
        "d.n_words",
        n_hit.alias("n_hit"),
        size("matched").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("d.n_words")).alias("contaminated"),
        size("near").alias("n_near"),
        F.coalesce(F.array_join(near, ","), F.lit("")).alias("near_items"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = find_benchmark(docs, benchmark, id_col, text_col)
    hit = found.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "_h")
    hit = broadcast_if_small(materialise(hit, "hit-documents"))
    rows = docs.select(
        whole_row(docs),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"),
    )
    return rows.alias("d").join(hit.alias("f"), _same_doc("d", "f"), "left_anti").select("_row.*")
