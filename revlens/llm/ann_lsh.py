"""Nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine.

A unit vector u falls, in each of ``TABLES`` tables, into the bucket of the
``FUNCTIONS`` numbers floor((a.u + b) / width) with normal a and uniform b. A
query visits its own bucket and then perturbed ones (a step of -1, 0 or +1 in
each number) in the order of their estimated success: the sum of the squared
distances to the bucket walls that the perturbation crosses, smallest first.
Candidates of all probes and tables are merged and scored exactly.

Every vector is indexed. Equal vectors are one class: only its k + 1 smallest
ids can be among the k nearest of anything (ties go to the smaller id), so a
class of any size costs one index entry and nothing is lost. A bucket of any
size is cut into packs of about ``PACK`` vectors; a pack meets a pack of
queries as one small matrix product, and only the best of each leave it. The
packs of a common bucket are dealt over many keys, so no task gets all of it.

The defaults are for vectors without structure (independent normal components,
nearest cosine about 0.3 to 0.5), where few buckets can be ruled out; clustered
vectors need fewer probes. Nothing in them depends on the number of rows.

Edge cases: rows with a null id, a null or zero vector, or a null or non-finite
component take no part, nor do vectors of another length than the most frequent
one; repeated rows count once, and of several vectors under one id the smallest
(component by component) counts; a query that meets fewer than k others in its
buckets is compared with all vectors; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.session import materialise

TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 4, 4, 1.5, 32, 17
PACK = 1024
#: Packs of either side that meet under one key.
TOGETHER = 4
EVERY = 50  # fixed value: queries are the ids divisible by it
K = 5


class Hashing:
    """The random functions of all tables; the same on every executor."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim, functions))
        self.b = rng.uniform(0, width, (tables, 1, functions))
        self.mix = rng.integers(1, 2**62, (functions,)) | 1
        self.width, self.probes = width, probes
        self.steps = np.array(list(itertools.product((0, -1, 1), repeat=functions)))

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(tables, rows, functions): places in units of the width."""
        return (np.einsum("nd,tdf->tnf", unit, self.a) + self.b) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix).sum(axis=-1)

    def index(self, unit: np.ndarray) -> np.ndarray:
        """(tables, rows, 1) bucket keys."""
        return self.keys(np.floor(self.places(unit)))[:, :, None]

    def probe(self, unit: np.ndarray) -> np.ndarray:
        """(tables, rows, probes) bucket keys in order of estimated success."""
        at = self.places(unit)
        cell = np.floor(at)
        low, high = (at - cell) ** 2, (1 - (at - cell)) ** 2
        cost = low @ (self.steps == -1).T + high @ (self.steps == 1).T
        order = np.argsort(cost, axis=-1, kind="stable")[:, :, : self.probes]
        return self.keys(cell[:, :, None, :] + self.steps[order])


def _usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False)) & F.coalesce(some, F.lit(False))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(class, ids, v): equal vectors with their k + 1 smallest ids."""
    by_class = Window.partitionBy("h1", "h2").orderBy("id")
    least = vectors.withColumn("_n", F.row_number().over(by_class)).filter(F.col("_n") <= k + 1)
    return least.groupBy("h1", "h2").agg(
        F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("ids"),
        F.min_by("v", "id").alias("v"),
    )


def _hashed(rows: DataFrame, hashing, probing: bool) -> DataFrame:
    """(class, v, slot, bucket): one row for each table, or table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(1)
            x = np.asarray(v.flatten(), dtype=float).reshape(n, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys = h.probe(unit) if probing else h.index(unit)
            tables, _, each = keys.shape
            row = pa.array(np.tile(np.repeat(np.arange(n), each), tables))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    v.take(row),
                    pa.array(np.repeat(np.arange(tables, dtype=np.int32), n * each)),
                    pa.array(keys.reshape(-1)),
                ],
                names=["class", "v", "slot", "bucket"],
            )

    return rows.select("class", "v").mapInArrow(
        run, "class bigint, v array<double>, slot int, bucket bigint"
    )


def _packed(rows: DataFrame, own: str, name: str) -> DataFrame:
    """Buckets cut into their ``own`` number of packs: ids and flat vectors of each."""
    return (
        rows.withColumn("_pack", F.pmod(F.xxhash64("class"), F.col(own)).cast("int"))
        .groupBy("slot", "bucket", "q_packs", "c_packs", "_pack")
        .agg(F.collect_list(F.struct("class", "v")).alias("_m"))
        .select(
            "slot",
            "bucket",
            "q_packs",
            "c_packs",
            F.floor(F.col("_pack") / TOGETHER).cast("int").alias(f"{name}_part"),
            F.transform("_m", lambda m: m["class"]).alias(f"{name}_ids"),
            F.flatten(F.transform("_m", lambda m: m["v"])).alias(f"{name}_flat"),
        )
    )


def _meetings(asking: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each pack of queries beside each pack of vectors of its bucket. One key of the join
    is TOGETHER packs of either side, so a bucket of any size is spread over many tasks;
    the packs of a side are repeated once for each such part of the other."""

    def sizes(rows: DataFrame, size: int, name: str) -> DataFrame:
        packs = F.ceil(F.count(F.lit(1)) / size).cast("int")
        return rows.groupBy("slot", "bucket").agg(packs.alias(name))

    both = sizes(asking, PACK // 4, "q_packs").join(sizes(indexed, PACK, "c_packs"), ["slot", "bucket"])
    both = materialise(both, "pack-sizes")

    def parts(packs: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(packs) - 1) / TOGETHER).cast("int")))

    key = ["slot", "bucket"]
    q = _packed(asking.join(both, key), "q_packs", "q").withColumn("c_part", parts("c_packs"))
    c = _packed(indexed.join(both, key), "c_packs", "c").withColumn("q_part", parts("q_packs"))
    return q.join(c, [*key, "q_part", "c_part"])


def _best(pairs: DataFrame, keep: int) -> DataFrame:
    """(q, c, score): of each pair of packs the best ``keep`` classes of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, c_ids, c = (np.asarray(batch.column(j)[i].values) for j in range(4))
                q, c = q.reshape(len(q_ids), -1), c.reshape(len(c_ids), -1)
                # powers of two: they scale without rounding
                q = q / np.exp2(np.floor(np.log2(np.abs(q).max(axis=1, keepdims=True))))
                c = c / np.exp2(np.floor(np.log2(np.abs(c).max(axis=1, keepdims=True))))
                nq, nc = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
                rough = (q / nq[:, None]) @ (c / nc[:, None]).T
                n = min(keep, len(c_ids))
                # everything as good as the n-th, so that ties are not cut here
                edge = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - 1e-12
                a, b = np.nonzero(rough >= edge[:, None])
                score = (q[a] * c[b]).sum(axis=1) / (nq[a] * nc[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[a]), pa.array(c_ids[b]), pa.array(score)], names=["q", "c", "score"]
                )

    return pairs.select("q_ids", "q_flat", "c_ids", "c_flat").mapInArrow(
        run, "q bigint, c bigint, score double"
    )


def _named(found: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best classes (q, c, score) of each query, by the
    ids of the classes and without the query's own."""
    found = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = found.withColumn("_n", F.row_number().over(by_class)).filter(F.col("_n") <= k + 1)
    return (
        best.join(classes.select(F.col("class").alias("c"), "ids"), "c")
        .select("q", "score", F.explode("ids").alias("vec_id"))
        .join(asked.withColumnRenamed("class", "q"), "q")
        .filter("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    tables: int = TABLES,
    functions: int = FUNCTIONS,
    width: float = WIDTH,
    probes: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row.
    ``is_query`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 1
    rows = (
        rows.filter(F.size("v") == dim)
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    )
    rows = materialise(rows, "vectors")
    classes = materialise(_classes(rows, k), "classes")
    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), "h1", "h2")
    asked = asked.join(classes.select("h1", "h2", "class"), ["h1", "h2"]).drop("h1", "h2")
    asked = materialise(asked, "queries")
    hashing = spark.sparkContext.broadcast(Hashing(dim, tables, functions, width, probes, seed))
    query_rows = classes.join(asked.select("class").distinct(), "class", "left_semi")
    met = _meetings(_hashed(query_rows, hashing, True), _hashed(classes, hashing, False))
    found = materialise(_best(met, k + 1), "neighbours")
    named = materialise(_named(found, classes, asked, k), "named")
    # a query whose probes met fewer than k others is compared with all vectors, in packs
    short = materialise(
        asked.join(named.groupBy("query_id").agg(F.count("vec_id").alias("_got")), "query_id", "left")
        .filter(F.coalesce("_got", F.lit(0)) < k)
        .drop("_got"),
        "short-queries",
    )
    if not short.isEmpty():
        left = classes.join(short.select("class").distinct(), "class", "left_semi")
        here = F.lit(0).cast("bigint").alias("bucket"), F.lit(0).alias("slot")
        met = _meetings(left.select("class", "v", *here), classes.select("class", "v", *here))
        rest = _named(_best(met, k + 1), classes, short, k)
        named = named.join(short, "query_id", "left_anti").unionByName(rest)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
