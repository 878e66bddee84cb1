"""The manifest against one built in memory, and its bitmaps against counting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import merkle_bitmap as op


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(enc, (doc_id, source, lang, n_chars, text)))


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i):
    for level in levels[:-1]:
        yield i, level[i ^ 1] if i ^ 1 < len(level) else None
        i >>= 1


def fold(node, steps):
    for i, other in steps:
        node = h(node) if other is None else h(node, other) if i % 2 == 0 else h(other, node)
    return node


def expected(rows):
    """The contract's rows, every group sorted in memory."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees, shown = {}, {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = build([leaf(*r) for r in members])
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    top = build([trees[x][-1][0] for x in order])
    out = []
    for g, lang in enumerate(order):
        for i, row in enumerate(groups[lang]):
            steps = [*climb(trees[lang], i), *climb(top, g)]
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            n = row[3] + 1 if struck and row[3] is not None else row[3]
            folded = fold(leaf(*row[:3], n, row[4]), steps)
            proof = h(*[s for _, s in steps if s])
            root = top[-1][0]
            out.append((row[0], leaf(*row), trees[lang][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = {"n_chars": F.when(struck, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return sorted((tuple(r) for r in op.manifest(docs, claimed=claimed, **options).collect()), key=str)


def rows_of(seed, n, langs, ids):
    rng = random.Random(seed)
    return [
        (ids(rng, i), rng.choice(["a", "é", None]), rng.choice(langs), rng.choice([None, 1, 9, 99]), f"text {rng.randrange(50)}")
        for i in range(n)
    ]


@pytest.mark.parametrize("levels", [2, 12])
def test_like_one_in_memory(spark, levels):
    """Ids over several bitmaps, some negative, some repeated, some null; with blocks of
    four slots the tree has several stages."""
    ids = lambda rng, i: rng.choice([None, 7, i, i, i * 1000, -i, 2**40 + i])
    rows = rows_of(1, 400, ["en", "de", None, "", "日本"], ids)
    rows += rows[:30]
    got = found(spark, rows, levels=levels)
    assert got == expected(rows)
    assert len({r[6] for r in got}) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9])
def test_small_groups_and_many(spark, n):
    rows = [(i, "s", f"g{g:03d}", 1, "t") for g in range(n) for i in range(g + 1)]
    assert found(spark, rows, levels=1, limit=0) == expected(rows)


def test_crowded_runs_of_ids_are_dealt(spark, monkeypatch):
    """A small limit on rows deals the rows of one bitmap and the copies of one row."""
    monkeypatch.setattr(op, "_dealt", lambda rows, maps, limit: dealt_by_5(rows, maps))
    rows = rows_of(2, 300, ["en"], lambda rng, i: rng.choice([i, 3, None]))
    assert found(spark, rows) == expected(rows)


def dealt_by_5(rows, maps):
    maps = maps.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(4))))
    maps = maps.join(rows.withColumn("deal", (F.col("row") % 5).cast("int")).select("grp", "chunk", "deal").distinct(),
                     ["grp", "chunk", "deal"], "left_semi")
    return rows.withColumn("deal", (F.col("row") % 5).cast("int")), maps


def test_more_rows_of_one_id_than_a_bitmap_has_bits(spark):
    """A third of all rows equal, a third without an id, past 65,536 rows of one id."""
    base = spark.range(150_000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).cast("bigint").alias("doc_id"),
        F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).cast("bigint").alias("n_chars"),
        F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"),
    )
    rows = base.union(spark.createDataFrame([(5, "s", "en", 3, "same")] * 10, SCHEMA))
    rows = rows.union(spark.range(70_000).select(F.lit(9).cast("bigint"), F.lit("s"), F.lit("en"), F.lit(3).cast("bigint"), F.lit("same")))
    got = op.manifest(rows).select("doc_id", "leaf", "proof_sha256", "root", "verified").collect()
    want = expected([tuple(r) for r in rows.collect()])
    assert sorted((str(r.doc_id), r.leaf, r.proof_sha256, r.root) for r in got) == sorted(
        (str(w[0]), w[1], w[4], w[3]) for w in want
    )


def test_bitmaps_and_ranks():
    rng = np.random.default_rng(1)
    for size in (1, 10, 5000, 60_000):
        parts = [rng.integers(0, op.CHUNK, size) for _ in range(3)]
        lows, counts = op.merge([op.pack(*np.unique(p, return_counts=True)) for p in parts])
        allv = np.sort(np.concatenate(parts))
        assert (np.repeat(lows, counts) == allv).all()
        again = op.unpack(op.pack(lows, counts))
        assert (again[0] == lows).all() and (again[1] == counts).all()
        bitmap = op.Bitmap(lows, counts)
        assert (bitmap.rank(lows) == np.searchsorted(allv, lows)).all()
        assert (bitmap.times(lows) == counts).all()


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("bigint"))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in op.manifest_report(docs).collect()), key=str) == expected(rows)
    assert op.manifest_report(no_docs.withColumn("n_chars", F.lit(1))).count() == 0
