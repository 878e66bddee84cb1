"""A Merkle manifest of a dataset, with leaf places from bitmap ranks.

Every row is a leaf; per group (``lang``) the leaves stand in the order of their
ids, every two neighbours become a node, and the groups' roots, in the order of the
groups, make the root of the dataset. No group is ever sorted:

1. Each batch of rows packs the low 16 bits of its ids into compressed bitmaps, one
   for each (group, id >> 16). The bitmaps of a key are merged, and counts of ids
   that stand more than once are kept beside the bits.
2. The bitmaps' sizes are added up along the digits of the ids, 65,536 values a
   digit, so that every bitmap knows how many leaves of its group come before it.
   The place of a leaf is that base plus a rank query: a popcount directory and one
   masked word. Rows that share an id, told apart by their leaf hash, follow each
   other in stretches of that hash.
3. The place names a block of 4,096 slots and a slot in it. The rows of a block are
   put into its slots, and the whole array is hashed level by level up to one node;
   nodes become the slots of the next blocks until one is left in each group.
4. On the way down each block gets the siblings above it, so every leaf is proven
   (and a tampered leaf refuted) within its block.

Only ids and digests are shuffled; each task holds a block, a bitmap, or a stretch
of 65,536 rows, whatever the size of a group, and nothing reaches the driver but
the number of levels.

Edge cases: a null id stands before all others, a null group before all others;
rows with one id are ordered by leaf hash (equal rows are equal leaves); a group of
one leaf is its own root; null and empty values have different leaves; a null id or
size is never tampered with; an empty table gives an empty table. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.sizes import BROADCAST_BYTES, broadcast_if_small
from revlens.session import materialise

#: Slots of a block: levels hashed in one task.
LEVELS = 12
LOW_BITS = 16
CHUNK = 2**LOW_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The key of a null group stands before all others; the others keep their order.
NO_GROUP, GROUP = "0", "1"


def _hash(*parts: bytes) -> bytes:
    """sha256 of digests written one after the other as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


# --- places: bitmaps and ranks ------------------------------------------------


class Bitmap:
    """Which of 65,536 low values are there, how many before each word, and how many
    rows beyond the first have each repeated value."""

    def __init__(self, lows: np.ndarray, counts: np.ndarray) -> None:
        bits = np.zeros(CHUNK, np.uint8)
        bits[lows] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.directory = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        repeated = np.flatnonzero(counts > 1)
        self.repeated = lows[repeated]
        self.extra = np.concatenate(([0], np.cumsum(counts[repeated] - 1)))

    def rank(self, lows: np.ndarray) -> np.ndarray:
        """Rows with a smaller value."""
        word, bit = lows >> 6, (lows & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        distinct = self.directory[word] + np.bitwise_count(self.words[word] & below)
        return distinct + self.extra[np.searchsorted(self.repeated, lows)]

    def times(self, lows: np.ndarray) -> np.ndarray:
        """Rows with this value, of values that are there."""
        at = np.searchsorted(self.repeated, lows)
        padded = np.append(self.repeated, -1)
        gains = np.append(np.diff(self.extra), 0)
        return np.where(padded[at] == lows, gains[at] + 1, 1)


def pack(lows: np.ndarray, counts: np.ndarray) -> bytes:
    """Compressed: distinct values as two bytes each or as a bit each, whichever is
    shorter, then the repeated ones with their counts."""
    many = counts > 1
    if lows.size < CHUNK // 16:
        body = lows.astype("<u2").tobytes()
    else:
        bits = np.zeros(CHUNK, np.uint8)
        bits[lows] = 1
        body = np.packbits(bits, bitorder="little").tobytes()
    head = np.array([lows.size, int(many.sum())], "<u4").tobytes()
    return head + body + lows[many].astype("<u2").tobytes() + counts[many].astype("<u8").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lows, counts), ascending."""
    size, many = np.frombuffer(data, "<u4", 2).tolist()
    if size < CHUNK // 16:
        lows, at = np.frombuffer(data, "<u2", size, 8), 8 + 2 * size
    else:
        bits = np.frombuffer(data, np.uint8, CHUNK // 8, 8)
        lows, at = np.flatnonzero(np.unpackbits(bits, bitorder="little")), 8 + CHUNK // 8
    counts = np.ones(size, np.int64)
    repeated = np.frombuffer(data, "<u2", many, at)
    counts[np.searchsorted(lows, repeated)] = np.frombuffer(data, "<u8", many, at + 2 * many)
    return lows.astype(np.int64), counts


def merge(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(CHUNK, np.int64)
    for part in parts:
        lows, counts = unpack(part)
        total[lows] += counts
    lows = np.flatnonzero(total)
    return lows, total[lows]


def _batch_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.to_pandas().groupby(["grp", "chunk"], sort=False)["low"]
        found = [(*key, pack(*np.unique(low.to_numpy(), return_counts=True))) for key, low in keys]
        grp, chunk, bitmap = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(grp, pa.string()), pa.array(chunk, pa.int64()), pa.array(bitmap, pa.binary())],
            names=["grp", "chunk", "bitmap"],
        )


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    lows, counts = merge(table.column("bitmap").to_pylist())
    return pa.table(
        {
            "grp": pa.array([key[0].as_py()], pa.string()),
            "chunk": pa.array([key[1].as_py()], pa.int64()),
            "n": pa.array([int(counts.sum())], pa.int64()),
            "bitmap": pa.array([pack(lows, counts)], pa.binary()),
        }
    )


def bitmaps(ids: DataFrame) -> DataFrame:
    """(grp, chunk, n, bitmap): one bitmap for each group and run of 65,536 ids."""
    partial = ids.select("grp", "chunk", "low").mapInArrow(
        _batch_bitmaps, "grp string, chunk bigint, bitmap binary"
    )
    # First in 64 parts: a repeated id has a bitmap in every batch, wherever its rows stand.
    dealt = partial.withColumn("deal", F.spark_partition_id() % 64)
    some = dealt.groupBy("grp", "chunk", "deal").applyInArrow(
        _merged, "grp string, chunk bigint, n bigint, bitmap binary"
    )
    return some.groupBy("grp", "chunk").applyInArrow(
        _merged, "grp string, chunk bigint, n bigint, bitmap binary"
    )


def _before(table: DataFrame, digit: str, upper: list[str], name: str) -> DataFrame:
    """Adds how many leaves stand before each ``digit`` among those with one ``upper``:
    at most 65,536 rows to a window."""
    window = Window.partitionBy(*upper).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn(name, F.coalesce(F.sum("n").over(window), F.lit(0)))


def with_bases(maps: DataFrame, null_ids: DataFrame) -> DataFrame:
    """``maps`` with ``base``: the leaves of the group that come before the bitmap's.
    ``null_ids`` (grp, n_null) come before all."""
    digits = [F.shiftright("chunk", LOW_BITS * i) for i in range(3)]
    first = maps.select("grp", "chunk", "n", digits[1].alias("c1"), digits[2].alias("c2"))
    second = first.groupBy("grp", "c2", "c1").agg(F.sum("n").alias("n"))
    third = second.groupBy("grp", "c2").agg(F.sum("n").alias("n"))
    base = (
        _before(first, "chunk", ["grp", "c1"], "b0")
        .drop("n", "c2")
        .join(_before(second, "c1", ["grp", "c2"], "b1").drop("n"), ["grp", "c1"])
        .join(_before(third, "c2", ["grp"], "b2").drop("n"), ["grp", "c2"])
        .join(null_ids, "grp", "left")
        .select(
            "grp", "chunk",
            (F.col("b0") + F.col("b1") + F.col("b2") + F.coalesce("n_null", F.lit(0))).alias("base"),
        )
    )
    return maps.join(base, ["grp", "chunk"])


def _ranked(rows: pa.Table, maps: pa.Table) -> pa.Table:
    """Adds to each row how many leaves have smaller ids, and how many have its own."""
    bitmap = Bitmap(*unpack(maps.column("bitmap")[0].as_py()))
    lows = rows.column("low").to_numpy()
    rank = maps.column("base")[0].as_py() + bitmap.rank(lows)
    kept = rows.select(["grp", "doc_id", "leaf", "tampered"])
    times = pa.array(bitmap.times(lows), pa.int64())
    return kept.append_column("rank", pa.array(rank, pa.int64())).append_column("times", times)


LEAF = "grp string, doc_id bigint, leaf binary, tampered binary"


def _dealt(rows: DataFrame, maps: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows and bitmaps under one key (grp, chunk, deal): a run of ids that has more
    than 65,536 rows is dealt over several tasks and its bitmap sent to each."""
    deals = F.ceil(F.col("n") / CHUNK).cast("int")
    crowded = materialise(maps.filter(F.col("n") > CHUNK).select("grp", "chunk", deals.alias("deals")), "crowded")
    rows = rows.join(broadcast_if_small(crowded, limit), ["grp", "chunk"], "left")
    rows = rows.withColumn(
        "deal", F.coalesce(F.pmod("row", "deals"), F.lit(0)).cast("int")
    )
    maps = maps.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    return rows.drop("deals"), maps


def _numbered(shared: DataFrame) -> DataFrame:
    """Places of rows whose id others have too: ``rank`` plus the row's number among
    them in the order of leaf hashes, counted in stretches of the hash's first two bytes."""
    stretched = shared.withColumn("stretch", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int"))
    sizes = stretched.groupBy("grp", "doc_id", "stretch").agg(F.count(F.lit(1)).alias("n"))
    sizes = _before(sizes, "stretch", ["grp", "doc_id"], "earlier").drop("n")
    same = (
        stretched.groupBy("grp", "doc_id", "rank", "stretch", "leaf", "tampered")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(sizes.withColumnsRenamed({"grp": "_g", "doc_id": "_d", "stretch": "_s"}),
              F.col("_g").eqNullSafe(F.col("grp")) & F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_s") == F.col("stretch")))
    )
    window = Window.partitionBy("grp", "doc_id", "stretch").orderBy("leaf")
    before = F.coalesce(
        F.sum("copies").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    first, last = F.col("place"), F.col("place") + F.col("copies") - 1
    return (
        same.withColumn("place", F.col("rank") + F.col("earlier") + before)
        .withColumn("part", F.explode(F.sequence(first, last, F.lit(CHUNK).cast("bigint"))))
        .repartition("grp", "doc_id", "part")  # copies of one row, dealt in parts
        .withColumn("place", F.explode(F.sequence("part", F.least(last, F.col("part") + CHUNK - 1))))
        .select("grp", "doc_id", "leaf", "tampered", "place")
    )


def places(leaves: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(grp, doc_id, leaf, tampered, place): every leaf's place in its group, from 0.
    ``leaves`` is a written table (grp, doc_id, leaf, tampered, row) with a number for
    each row."""
    chunk = F.shiftright("doc_id", LOW_BITS).alias("chunk")
    rows = leaves.filter("doc_id is not null").select(
        "*", chunk, F.col("doc_id").bitwiseAND(F.lit(CHUNK - 1)).alias("low")
    )
    without = leaves.filter("doc_id is null")
    null_ids = without.groupBy("grp").agg(F.count(F.lit(1)).alias("n_null"))
    maps = materialise(bitmaps(rows), "bitmaps")
    maps = materialise(with_bases(maps, null_ids), "ranked-bitmaps")
    rows, dealt = _dealt(rows, maps, limit)
    key = ["grp", "chunk", "deal"]
    ranked = (
        rows.groupBy(*key)
        .cogroup(dealt.groupBy(*key))
        .applyInArrow(_ranked, f"{LEAF}, rank bigint, times bigint")
    )
    ranked = materialise(ranked, "ranks")
    columns = ["grp", "doc_id", "leaf", "tampered"]
    single = ranked.filter("times = 1").select(*columns, F.col("rank").alias("place"))
    shared = ranked.filter("times > 1").select(*columns, "rank")
    nulls = without.select(*columns, F.lit(0).cast("bigint").alias("rank"))
    return single.union(_numbered(shared.union(nulls)))


# --- the tree -----------------------------------------------------------------


def tree(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels of a block, from its slots up; a last one without a partner is hashed alone."""
    out = [slots]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def climbs(n: int, levels: int) -> int:
    """Levels hashed in a block of a group of ``n`` nodes: all, or as many as leave one."""
    return min(levels, max(0, (n - 1).bit_length()))


def path(levels: list[list[bytes]], slot: int) -> list[tuple[int, bytes]]:
    """What joins a slot's node at each level: (0, sibling before), (1, sibling after)
    or (2, nothing)."""
    out = []
    for level in levels[:-1]:
        other = slot ^ 1
        if other < len(level):
            out.append((int(other > slot), level[other]))
        else:
            out.append((2, b""))
        slot >>= 1
    return out


def packed(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([kind]) + digest for kind, digest in steps)


def unpacked(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        size = 0 if data[at] == 2 else 32
        out.append((data[at], data[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def fold(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    for kind, digest in steps:
        node = _hash(digest, node) if kind == 0 else _hash(node, digest) if kind == 1 else _hash(node)
    return node


def _slots(table: pa.Table, column: str) -> list[bytes]:
    """The column in slot order: every row is put into its slot, none is compared."""
    slots = np.empty(table.num_rows, object)
    slots[table.column("slot").to_numpy()] = table.column(column).to_pylist()
    return slots.tolist()


def _block_root(levels: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        top = tree(_slots(table, "node"), climbs(table.column("n")[0].as_py(), levels))[-1][0]
        return pa.table(
            {
                "grp": pa.array([key[0].as_py()], pa.string()),
                "place": pa.array([key[1].as_py()], pa.int64()),
                "node": pa.array([top], pa.binary()),
            }
        )

    return run


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumns(
        {
            "block": F.shiftright("place", levels),
            "slot": F.col("place").bitwiseAND(F.lit(2**levels - 1)),
        }
    )


def _with_sizes(nodes: DataFrame, limit: int) -> DataFrame:
    sizes = materialise(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    return nodes.join(broadcast_if_small(sizes, limit), "grp")


def reduce_groups(nodes: DataFrame, levels: int, limit: int) -> list[DataFrame]:
    """Tables of (grp, place, node, n, block, slot): each one's blocks are the next one's
    nodes, and the last has one node in each group."""
    stages = []
    while True:
        stage = materialise(_blocked(_with_sizes(nodes, limit), levels), "merkle-nodes")
        stages.append(stage)
        if (stage.agg(F.max("n")).first()[0] or 0) <= 1:
            return stages
        nodes = stage.groupBy("grp", "block").applyInArrow(
            _block_root(levels), "grp string, place bigint, node binary"
        )


def _paths(levels: int):
    """(grp, block, steps): the siblings of every slot of a block, then the block's own."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        upper = above.column("steps")[0].as_py()
        block = tree(_slots(nodes, "node"), climbs(nodes.column("n")[0].as_py(), levels))
        steps = [packed(path(block, i)) + upper for i in range(nodes.num_rows)]
        first = nodes.column("block")[0].as_py() << levels
        return pa.table(
            {
                "grp": pa.array([nodes.column("grp")[0].as_py()] * len(steps), pa.string()),
                "block": pa.array(range(first, first + len(steps)), pa.int64()),
                "steps": pa.array(steps, pa.binary()),
            }
        )

    return run


def _proofs(levels: int):
    """The result rows of a block of leaves."""

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        upper = unpacked(above.column("steps")[0].as_py())
        own, tampered, ids = (_slots(leaves, c) for c in ("node", "tampered", "doc_id"))
        block = tree(own, climbs(leaves.column("n")[0].as_py(), levels))
        proofs, folded = [], []
        for i, leaf in enumerate(own):
            steps = path(block, i) + upper
            proofs.append(_hash(*[digest for _, digest in steps]).hex())
            folded.append(fold(leaf if tampered[i] is None else tampered[i], steps).hex())
        same = {c: [above.column(c)[0].as_py().hex()] * len(own) for c in ("subroot", "root")}
        columns = {"leaf": [x.hex() for x in own], **same, "proof_sha256": proofs, "folded_root": folded}
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64())}
            | {name: pa.array(values, pa.string()) for name, values in columns.items()}
        )

    return run


def _joined(nodes: DataFrame, above: DataFrame, work, schema: str) -> DataFrame:
    key = ["grp", "block"]
    return nodes.groupBy(*key).cogroup(above.groupBy(*key)).applyInArrow(work, schema)


def _down(stages: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """(grp, block, steps) of the blocks of the lowest stage, from those of the highest."""
    for stage in reversed(stages[1:-1]):
        above = _joined(stage, above, _paths(levels), "grp string, block bigint, steps binary")
        above = materialise(above, "merkle-paths")
    return above


def _in_order(groups: DataFrame) -> DataFrame:
    """(grp, node, place) of the groups' roots. They are sorted over many tasks; the place
    is the start of a row's partition and its number there, which
    monotonically_increasing_id names both."""
    in_part = 2**33 - 1
    rows = groups.orderBy("grp").select("grp", "node", F.monotonically_increasing_id().alias("id"))
    rows = materialise(rows, "group-order").withColumn("part", F.shiftright("id", 33))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    starts = _before(parts, "part", ["all"], "start").select("part", "start")
    place = F.col("start") + F.col("id").bitwiseAND(F.lit(in_part))
    return rows.join(starts, "part").select("grp", "node", place.alias("place"))


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    claimed: dict[str, Column] | None = None,
    levels: int = LEVELS,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``claimed`` gives the fields as somebody shows them: where one differs, the root is
    folded from the shown row's hash along the true siblings, and does not verify.
    """
    true = [F.col(f) for f in fields]
    shown = [(claimed or {}).get(f, F.col(f)) for f in fields]
    differs = F.lit(False)
    for f, c in (claimed or {}).items():
        differs = differs | ~c.eqNullSafe(F.col(f))
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.when(group.isNull(), NO_GROUP).otherwise(F.concat(F.lit(GROUP), group)).alias("grp"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        leaf_hash(true).alias("leaf"),
        F.when(differs, leaf_hash(shown)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialise(leaves, "leaves")
    nodes = materialise(places(leaves, limit), "leaf-places").withColumnRenamed("leaf", "node")
    stages = reduce_groups(nodes, levels, limit)
    groups = materialise(_in_order(stages[-1].select("grp", "node")), "subroots")
    tops = reduce_groups(groups.select(F.lit(GROUP).alias("grp"), "place", "node"), levels, limit)

    start = tops[-1].select("grp", F.col("place").alias("block"), F.lit(b"").alias("steps"))
    if len(tops) > 1:
        start = _joined(
            tops[0], _down(tops, start, levels), _paths(levels), "grp string, block bigint, steps binary"
        )
    of_groups = start.select(F.col("block").alias("place"), "steps").join(groups, "place")
    first = materialise(of_groups.select("grp", F.lit(0).cast("bigint").alias("block"), "steps"), "group-paths")
    above = _down(stages, first, levels)
    known = groups.select("grp", F.col("node").alias("subroot")).crossJoin(
        F.broadcast(tops[-1].select(F.col("node").alias("root")))  # one row
    )
    above = above.join(broadcast_if_small(materialise(known, "roots"), limit), "grp")
    return _joined(
        stages[0], above, _proofs(levels),
        "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest, with one added to the size of every document whose id's CRC is
    divisible by seven."""
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    size = F.col("n_chars").cast("bigint")
    return manifest(docs, claimed={"n_chars": F.when(struck, size + 1).otherwise(size)})
