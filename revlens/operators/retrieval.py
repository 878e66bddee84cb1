"""Replies by retrieval: the best of all known replies by BM25, found block by block.

The index holds each distinct reply once. A reply's score is the sum of the impacts
of the terms it shares with the review; impacts are kept in millionths, so scores
are exact. Replies with the same leading term stand together in blocks of ``BLOCK``,
and a block knows the largest impact of each of its terms. For a review the sum of
these maxima bounds what any reply of the block can reach, so blocks are scored from
the highest bound on, and blocks whose bound does not reach the best score found are left
out: the answer is that of scoring all of them.

A review that shares words with much of the index, as a long one does, is not cheaper to
bound than to score. It is scored against all replies of a shard, many reviews together:
the terms that many replies have by a product with a matrix of their impacts, the others
by their lists. These sums are single precision; whatever their rounding leaves in the
running is scored again in whole numbers.

The index is built by aggregates and joins and written as rows of packed arrays. It
is searched shard by shard: a shard has at most ``LIMIT`` bytes, is sent to every
task, and a batch of reviews takes the best score of one shard to the next. So memory
stays bounded for an index of any size, and reviews are never shuffled or written.

Ties go to the smaller ``order`` columns; a review that shares no term with any reply
gets none; null and empty texts have no terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.arrays import term_counts, word_ids
from revlens.functions.skew import hot_key_join
from revlens.functions.text import count_tokens, words
from revlens.session import materialise, one_at_a_time
from revlens.sources.catalog import Model

NAME = "Retrieval"
MODEL = Model(NAME, Decimal(0), Decimal(0), 0.0, "clean", "user")
K1, B = 1.2, 0.75
BLOCK = 16
LIMIT = 96 * 2**20
#: So many blocks are scored one by one before the rest.
SINGLY = 8
#: A review that meets no more postings than this goes by the bounds.
FEW = 16_384
#: A term that this share of a shard's replies has may stand in its matrix; so many terms at most.
DENSE, DENSE_TERMS = 1 / 64, 256
#: What a cell of a product with the matrix, a posting of a list and a list cost, in nanoseconds.
CELL, POSTING, LISTED = 0.036, 4.0, 1000.0
#: Scores that are made together, about 16 MB.
TOGETHER = 2**22
#: Lists of no more postings are put together in one go; so many replies at most are scored
#: again by their terms, more by the lists.
SHORT, AGAIN = 64, 4096
NO_REPLY = "no reply shares a word"
_INDEX = (
    "first_orders array<bigint>, second_orders array<bigint>, doc array<int>, terms array<bigint>, "
    "impacts array<bigint>"
)


def postings(replies: DataFrame, order: tuple[str, str], text: str = "text") -> DataFrame:
    """(no, first, second, posts): each distinct reply under its smallest ``order`` columns,
    with the (impact, term) of its terms, the largest impact first."""
    smallest = F.min(F.struct(*[F.col(c) for c in order]))
    docs = replies.filter(F.col(text).isNotNull()).groupBy(text).agg(smallest.alias("_o"))
    docs = docs.select(
        F.monotonically_increasing_id().alias("no"), F.col(f"_o.{order[0]}").alias("first"), F.col(f"_o.{order[1]}").alias("second"),
        term_counts(word_ids(words(F.col(text))), "bigint").alias("_t"),
    ).withColumn("length", F.aggregate("_t", F.lit(0).cast("bigint"), lambda a, t: a + t["n"]))
    docs = materialise(docs.filter("length > 0"), "reply-terms")
    each = docs.select("no", "first", "second", "length", F.explode("_t").alias("t")).select(
        "no", "first", "second", "length", F.col("t.term").alias("term"), F.col("t.n").cast("double").alias("tf")
    )
    often = materialise(each.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows")), "reply-term-counts")
    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    dim = often.withColumnRenamed("n_rows", "df")
    known = hot_key_join(each, dim, ["term"], often, ["no"])
    known = known.crossJoin(F.broadcast(sizes))  # one row
    df, n = F.col("df").cast("double"), F.col("n").cast("double")
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    share = F.col("length").cast("double") / (F.col("tokens").cast("double") / n)
    tf = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * share))
    impact = F.floor(idf * tf * F.lit(1e6) + F.lit(0.5)).cast("bigint")
    return known.groupBy("no", "first", "second").agg(
        F.sort_array(F.collect_list(F.struct(impact.alias("impact"), "term")), asc=False).alias("posts")
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _INDEX.split(", ")]
    kinds = [pa.list_(pa.int32() if n == "doc" else pa.int64()) for n in names]
    for batch in batches:
        rows = []
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            posts = part.column(2)
            doc = np.repeat(np.arange(len(posts)), posts.value_lengths().to_numpy(zero_copy_only=False))
            impacts, terms = (c.to_numpy(zero_copy_only=False) for c in posts.flatten().flatten())
            rows.append((part.column(0), part.column(1), doc, terms, impacts))
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.to_pylist() if isinstance(x, pa.Array) else x for x in c], k) for c, k in zip(columns, kinds, strict=True)],
            names=names,
        )


def build_index(replies: DataFrame, order: tuple[str, str], text: str = "text") -> DataFrame:
    """One row for each block of replies; replies with the same leading term are neighbours."""
    posts = postings(replies, order, text)
    lead = F.get("posts", F.lit(0))["term"]
    dealt = posts.withColumn("lead", lead).repartition("lead")
    sorted_ = dealt.sortWithinPartitions("lead", "first", "second").select("first", "second", "posts")
    return materialise(sorted_.mapInArrow(_pack, _INDEX), "reply-index")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of the ranges from ``starts`` to ``ends``, one range after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _added(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """``what`` of the ranges from ``starts`` to ``ends``, added up at its places ``at``; whole
    numbers far below 2 ** 53, so the sums are exact."""
    ranges = _ranges(starts, ends)
    return np.bincount(at[ranges], weights=what[ranges], minlength=n).astype(np.int64)


def _lists(blocks: pa.Table | list, name: str) -> list[np.ndarray]:
    """A list column of the index as one array, and the lengths of its lists."""
    if isinstance(blocks, pa.Table):
        lists = blocks[name].combine_chunks()
    else:
        lists = pa.array([b[name] for b in blocks], pa.list_(pa.int64()))
    flat = lists.flatten()
    values = np.array(flat.to_pylist(), object) if flat.null_count else flat.to_numpy(zero_copy_only=False)
    return [values, lists.value_lengths().to_numpy(zero_copy_only=False)]


class Shard:
    """Some blocks of the index, with the blocks of each term and their largest impact.

    What is sent to the workers is one number for each term, impact and place of a posting;
    the same postings by term, by block and as a matrix are made from it where they are read."""

    def __init__(self, blocks: pa.Table | list, read: bool = True) -> None:
        first, sizes = _lists(blocks, "first_orders")
        self.orders = [first, _lists(blocks, "second_orders")[0]]
        doc, posts = _lists(blocks, "doc")
        self.impacts = _lists(blocks, "impacts")[0].astype(np.int32)
        terms = _lists(blocks, "terms")[0]
        del blocks
        self.block_ends = np.cumsum(sizes)
        reply = doc + np.repeat(self.block_ends - sizes, posts)
        self.reply_ends = np.cumsum(np.bincount(reply, minlength=len(first)))
        del doc, reply
        self.terms, place = np.unique(terms, return_inverse=True)
        self.place = place.astype(np.int32)
        del terms, place
        self.by_term = np.argsort(self.place, kind="stable").astype(np.int32)
        if read:
            self._read()

    def __getstate__(self) -> dict:
        sent = ("orders", "block_ends", "reply_ends", "terms", "place", "impacts", "by_term")
        return {name: getattr(self, name) for name in sent}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._read()

    def _read(self) -> None:
        n = len(self.orders[0])
        self.reply_starts = np.append(0, self.reply_ends[:-1])
        self.block_starts = np.append(0, self.block_ends[:-1])
        self.block_of = np.repeat(np.arange(len(self.block_ends), dtype=np.int32), self.block_ends - self.block_starts)
        # (impact, reply) side by side, as a list of postings is read as one
        self.posts = np.empty(len(self.place), np.int64)
        self.impact, self.reply = (self.posts.view(np.int32)[i::2] for i in (0, 1))
        self.impact[:] = self.impacts[self.by_term]
        self.reply[:] = np.repeat(np.arange(n, dtype=np.int32), self.reply_ends - self.reply_starts)[self.by_term]
        self.often = np.bincount(self.place, minlength=len(self.terms))
        self.post_ends = np.cumsum(self.often)
        self.post_starts = self.post_ends - self.often
        # a term's replies ascend, so those of a block stand side by side
        new = np.ones(len(self.reply), bool)
        block = self.block_of[self.reply]
        new[1:] = block[1:] != block[:-1]
        new[self.post_starts] = True
        first = np.flatnonzero(new)
        self.block, self.top = block[first].astype(np.int32), np.maximum.reduceat(self.impact, first)
        self.starts = np.searchsorted(first, self.post_starts)
        self.ends = np.append(self.starts[1:], len(first))
        # a matrix of the impacts of the terms that most replies have
        dense = np.flatnonzero(self.often >= max(1, n * DENSE))
        dense = dense[np.argsort(-self.often[dense], kind="stable")[:DENSE_TERMS]]
        self.listed = self.often[dense] * POSTING + LISTED
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), n), np.float32)
        for row, term in enumerate(dense):
            at = slice(self.post_starts[term], self.post_ends[term])
            self.matrix[row, self.reply[at]] = self.impact[at]

    def _known(self, query: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, query), self.terms.size - 1)
        return at[self.terms[at] == query]

    def bounds(self, known: np.ndarray) -> np.ndarray:
        """For each block a score that none of its replies exceeds."""
        return _added(self.starts[known], self.ends[known], self.block, self.top, len(self.block_ends))

    def scores(self, known: np.ndarray) -> np.ndarray:
        """The score of each reply."""
        starts, ends = self.post_starts[known], self.post_ends[known]
        return _added(starts, ends, self.reply, self.impact, self.block_of.size)

    def scores_of(self, known: np.ndarray, replies: np.ndarray) -> np.ndarray:
        """The scores of some replies, from their own terms."""
        starts, ends = self.reply_starts[replies], self.reply_ends[replies]
        ranges = _ranges(starts, ends)
        terms = self.place[ranges]
        hit = known[np.minimum(np.searchsorted(known, terms), known.size - 1)] == terms
        of = np.repeat(np.arange(len(replies)), ends - starts)
        return np.bincount(of[hit], weights=self.impacts[ranges[hit]], minlength=len(replies)).astype(np.int64)

    def _better(self, found: tuple, replies: np.ndarray, scores: np.ndarray) -> tuple:
        """The better of ``found`` and the best of ``replies``."""
        top = int(scores.max(initial=0))
        if top <= 0:
            return found
        first, second = self.orders
        return min([found, *((-top, int(first[t]), int(second[t])) for t in replies[scores == top])])

    def best(self, query: np.ndarray, found: tuple) -> tuple[tuple, int]:
        """The better of ``found`` (minus the score, order columns) and the shard's best, and
        how many blocks were scored. ``query`` is sorted. The blocks of the highest bounds are
        scored one by one; all whose bound is still not below the best then go together."""
        known = self._known(query)
        if not known.size:
            return found, 0
        bounds = self.bounds(known)
        order = np.argsort(-bounds, kind="stable")
        scored = 0
        for i in order[:SINGLY].tolist():
            if bounds[i] <= 0 or bounds[i] < -found[0]:
                return found, scored
            scored += 1
            replies = np.arange(self.block_starts[i], self.block_ends[i])
            found = self._better(found, replies, self.scores_of(known, replies))
        left = np.zeros(len(self.block_ends), bool)
        left[order[SINGLY:]] = True
        left &= (bounds > 0) & (bounds >= -found[0])
        if left.any():
            replies = np.flatnonzero(left[self.block_of])
            found = self._better(found, replies, self.scores(known)[replies])
        return found, scored + int(left.sum())

    def _add_listed(self, known: np.ndarray, row: np.ndarray) -> None:
        """Adds the impacts of the terms to ``row``. Their lists are put together first, the long
        ones list by list."""
        long = self.often[known] > SHORT
        starts, ends = self.post_starts[known], self.post_ends[known]
        posts = [self.posts[at : to] for at, to in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        posts.append(self.posts[_ranges(starts[~long], ends[~long])])
        both = np.concatenate(posts).view(np.int32)
        np.add.at(row, both[1::2].astype(np.intp), both[::2].astype(np.float32))

    def _best_of(self, known: np.ndarray, row: np.ndarray, found: tuple) -> tuple:
        """The better of ``found`` and the best reply, given a row of scores that are right but
        for the rounding of their sums: what may be the best is scored again, exactly."""
        top = float(row.max())
        error = (known.size + 4) * 2.0**-23
        if top * (1 + error) < -found[0]:
            return found
        replies = np.flatnonzero(row >= np.float32(top * (1 - 2 * error)))
        if len(replies) > AGAIN:
            return self._better(found, np.arange(len(row)), self.scores(known))
        return self._better(found, replies, self.scores_of(known, replies))

    def best_of_each(self, queries: list[np.ndarray], found: list[tuple]) -> tuple[list[tuple], list[int]]:
        """:meth:`best` of many queries. Those that meet few postings go by the bounds; for the
        others the bounds would cost as much as the scores, and all replies are scored: by a
        product with the matrix for as many of the commonest terms as that is the cheaper
        way, else by lists. Queries of about as many terms go together."""
        found, scored = list(found), [0] * len(queries)
        knowns = [self._known(q) for q in queries]
        together = []
        for i, known in enumerate(knowns):
            if self.often[known].sum() > FEW:
                scored[i] = len(self.block_ends)
                together.append(i)
            else:
                found[i], scored[i] = self.best(queries[i], found[i])
        together.sort(key=lambda i: knowns[i].size)
        n = self.block_of.size
        step = max(1, TOGETHER // n)
        for start in range(0, len(together), step):
            part = together[start : start + step]
            asked = np.zeros((len(part), len(self.matrix)), np.float32)
            for at, i in enumerate(part):
                columns = self.column[knowns[i]]
                asked[at, columns[columns >= 0]] = 1
            gain = np.cumsum(asked.sum(axis=0) * self.listed - len(part) * n * CELL)
            dense = int(gain.argmax()) + 1 if gain.max(initial=0) > 0 else 0
            rows = asked[:, :dense] @ self.matrix[:dense]
            for row, i in zip(rows, part, strict=True):
                column = self.column[knowns[i]]
                self._add_listed(knowns[i][(column < 0) | (column >= dense)], row)
                found[i] = self._best_of(knowns[i], row, found[i])
        return found, scored


_FOUND = "score bigint, first bigint, second bigint, scored bigint"


def _search(shared: list, n_key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(n_key)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            queries = [np.sort(q) for q in np.split(flat, ends[:-1])] if len(lists) else []
            found, scored = [(0, 0, 0)] * len(queries), np.zeros(len(queries), np.int64)
            for shard in one_at_a_time(shared):
                found, n = shard.best_of_each(queries, found)
                scored += np.array(n, np.int64)
                del shard  # before the next one is read
            made = [-np.array([f[0] for f in found], np.int64), *(np.array([f[i] for f in found], np.int64) for i in (1, 2)), scored]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_key], *(pa.array(c) for c in made)], names=[*batch.schema.names[:n_key], "score", "first", "second", "scored"]
            )

    return run


def shards(index: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """``index`` with a shard number, and how many shards of about ``limit`` bytes there are."""
    size = F.size("terms") * 20 + 64
    total = index.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    n = -(-total // limit)
    return index.withColumn("shard", F.pmod(F.xxhash64("first_orders", "second_orders"), F.lit(max(n, 1)))), n


def retrieve(
    rows: DataFrame, index: DataFrame, key: list[str], text: str = "review", limit: int = LIMIT
) -> DataFrame:
    """(key, score, first, second, scored) of every row: the score and order columns of
    its best reply (null without one), and how many blocks had to be scored."""
    spark = rows.sparkSession
    found = rows.select(
        *key, F.array_distinct(word_ids(words(F.coalesce(F.col(text), F.lit(""))))).alias("_terms")
    )
    dealt, n = shards(index, limit)
    shared = []
    for at in range(n):
        blocks = dealt.filter(F.col("shard") == at).drop("shard")
        shard = Shard(blocks.toArrow(), read=False)  # within the limit
        if len(shard.place):
            shared.append(spark.sparkContext.broadcast(shard))
        del shard
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:-1])
    found = found.mapInArrow(_search(shared, len(key)), f"{schema}, {_FOUND}")
    hit = F.col("score") > 0
    return found.select(*key, *[F.when(hit, F.col(c)).alias(c) for c in ("score", "first", "second")], "scored")


def retrieved_calls(
    rows: DataFrame, replies: DataFrame, order: tuple[str, str], limit: int = LIMIT
) -> DataFrame:
    """The replies as a call log of the response task, without response time or cost; a
    review without a reply is a failed call."""
    key = ["dataset", "review_id", "user_name", "review_tokens"]
    asked = rows.withColumn("review_tokens", count_tokens(F.col("review")))
    best = retrieve(asked, build_index(replies, order), key, limit=limit)
    texts = replies.select(
        F.col(order[0]).alias("first"), F.col(order[1]).alias("second"), F.col("text").alias("raw_output")
    ).dropDuplicates(["first", "second"])
    return best.join(texts, ["first", "second"], "left").select(
        F.lit("response").alias("task"), "dataset", "review_id", F.lit(NAME).alias("model"), "user_name",
        "review_tokens", F.lit(0).cast("bigint").alias("input_tokens"), "raw_output",
        F.lit(None).cast("bigint").alias("completion_tokens"), F.lit(0.0).alias("elapsed_s"),
        F.when(F.col("raw_output").isNull(), NO_REPLY).alias("error"),
    )
