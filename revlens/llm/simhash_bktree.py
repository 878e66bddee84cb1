"""SimHash fingerprints linked through BK-trees.

Fingerprints that differ in at most r bits agree wholly on one of r + 1 blocks
of bits, so each distinct fingerprint goes to one shard per block. A shard is a
BK-tree: children are keyed by their Hamming distance to the parent, and a
search follows only edges within r of the distance at hand. A shard that would
be too large for one tree is parted again by the same rule over the bits that
its members may still differ in, until every tree is bounded; no fingerprint is
dropped. Within a shard links are kept as a star (a spanning forest), so copies
never become all pairs, and components of all shards are joined by
:func:`revlens.llm.components.components`.

The shard trees meet their queries by a shuffle on the shard, not by a
broadcast variable: their number grows with the corpus.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; a null id is never the smallest of its component unless all are null;
repeated rows each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.arrow import map_texts
from revlens.llm.components import components
from revlens.llm.words import whole_row
from revlens.session import materialise

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: The most fingerprints in one tree; a hot shard is parted again.
TREE_LIMIT = 4096
FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    parts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in parts], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size).view("<i8")[0])


def fingerprints(
    docs: DataFrame, keep: dict[str, Column], text: Column, shingle: int = SHINGLE
) -> DataFrame:
    """The columns of ``keep`` and ``fp`` of every row."""
    return map_texts(
        docs, keep, text, lambda: lambda texts: [[simhash(t, shingle) for t in texts]], FINGERPRINT
    )


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            distance = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(distance, new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the values at most ``radius`` bits away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            below = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                if edge in below:
                    todo.append(below[edge])


def shard_stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, centre) of every value that links to another: the shard's
    components as stars."""
    tree, up = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, value in enumerate(values):
        unsigned = value & (2**64 - 1)
        for j in tree.within(unsigned, radius):
            up[top(i)] = top(j)
        tree.insert(unsigned)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _parts(mask: int, n: int) -> list[int]:
    """The bits of ``mask`` dealt to n masks, in runs as equal as can be."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(n)]


def _sharded(members: DataFrame, choices: Column) -> DataFrame:
    return members.select("fp", F.explode(choices).alias("mask")).withColumn(
        "value", F.col("fp").bitwiseAND(F.col("mask"))
    )


def _stars(shards: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for v in batch.column(0).to_pylist() for p in shard_stars(v, radius)]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return shards.select("fps").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, radius: int = MAX_BITS, limit: int = TREE_LIMIT) -> DataFrame:
    """(a, b): stars that connect all of the distinct fingerprints ``fp`` that are
    within ``radius`` bits of each other."""
    masks = _parts(2**64 - 1, radius + 1)
    members = _sharded(distinct, F.array(*[F.lit(_signed(m)) for m in masks]))
    found = None
    while True:
        sizes = materialise(
            members.groupBy("mask", "value").agg(F.count("fp").alias("n")).filter("n > 1"),
            "shard-sizes",
        )
        fit = members.join(sizes.filter(F.col("n") <= limit), ["mask", "value"])
        trees = fit.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
        stars = _stars(trees, radius)
        found = stars if found is None else found.union(stars)
        hot = sizes.filter(F.col("n") > limit)
        if hot.isEmpty():
            return found
        finer = {m: [m | p for p in _parts(~m & (2**64 - 1), radius + 1)] for m in masks}
        choices = F.create_map(
            *[
                x
                for m, subs in finer.items()
                for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))
            ]
        )
        crowded = members.join(hot.select("mask", "value"), ["mask", "value"])
        members = materialise(
            _sharded(crowded.withColumn("_next", choices[F.col("mask")]), F.col("_next")).distinct(),
            "hot-shards",
        )
        masks = sorted({s for subs in finer.values() for s in subs})


def component_of(fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """(fp, root): every distinct fingerprint of ``fps`` and its component's centre."""
    distinct = fps.select("fp").distinct()
    linked = components(links(distinct, radius))
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = MAX_BITS,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps = materialise(
        fingerprints(docs, {"doc_id": F.col(id_col)}, F.col(text_col), shingle), "fingerprints"
    )
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = component_of(fps, radius)
    by_root = (
        roots.join(least, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    )
    named = materialise(roots.join(by_root, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with one row left of every component: the smallest id, of rows
    that share it the smallest text hash, and of equal rows one."""
    key = {"_id": F.col(id_col), "_hash": F.xxhash64(F.col(text_col))}
    fps = materialise(fingerprints(docs, key, F.col(text_col), shingle), "fingerprints")
    sizes = fps.groupBy("fp", "_id", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    whose = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash", "_n")
    least = sizes.groupBy("fp").agg(F.min(whose).alias("_first"))
    chosen = (
        component_of(fps, radius)
        .join(least, "fp")
        .groupBy("root")
        .agg(F.min("_first").alias("_first"))
        .select("_first._id", "_first._hash", "_first._n")
    )
    rows = docs.select(
        whole_row(docs), F.col(id_col).alias("_did"), F.xxhash64(F.col(text_col)).alias("_dhash")
    )
    chosen = materialise(chosen, "chosen")
    kept = rows.join(
        chosen, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dhash") == F.col("_hash"))
    )
    single = kept.filter("_n = 1").select("_row")
    repeated = kept.filter("_n > 1").dropDuplicates(["_did", "_dhash"]).select("_row")
    return single.union(repeated).select("_row.*")
