"""Word vectors made from the corpus: co-occurrence, positive PMI, truncated SVD.

1. Each text pairs its words with the next ``WINDOW`` ones. A task counts millions of pairs
   by sorting them, in both orders, and sends them to the blocks of the matrix, each of which
   has the whole rows of some words.
2. A pair's weight is max(0, ln(n(w, c) N / (n(w) n(c)))). Blocks keep the counts of the
   pairs of a positive weight, sorted and packed as differences, in about two bytes a pair;
   weights are made from them where they are used.
3. The leading eigenvectors of this symmetric matrix are found by randomised subspace
   iteration: a start of random signs that follow from the words' digests, then
   products of the matrix with a table of ``DIM + EXTRA`` columns. A block's rows of a
   product need nothing but the table; only squares of DIM + EXTRA numbers (for
   orthogonal columns and for the last rotation) are added up.

Words are numbered in the order of their digests. The driver holds the digests and sums of
the vocabulary, 16 bytes a word. The table of vectors goes to the tasks in pieces of bounded
size, of which a task holds one at a time; a piece is a range of words, and blocks are packed
by such ranges. Tables that are not read again are removed at once. A vector is the word's
row of the eigenvectors, each scaled by the root of its eigenvalue's size; signs are fixed by
the largest component. Sums of doubles depend on the order of tasks in their last digits,
so vectors are rounded to six decimals.

Words seen less than ``MIN_COUNT`` times have no vector; a corpus without pairs gives
an empty table; null and empty texts have no words.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.arrays import word_ids
from revlens.functions.numeric import r6
from revlens.functions.text import words
from revlens.session import discard, materialise, one_at_a_time

WINDOW = 4
MIN_COUNT = 5
DIM, EXTRA, ROUNDS = 32, 8, 3
LIMIT = 64 * 2**20
#: Pairs that a task counts together, and pairs of a block before equal ones are one.
PAIRS, BLOCK_PAIRS = 3 * 2**19, 2**21
#: What a word of a piece of vectors may take, in bytes.
WORD_BYTES = 512
#: Entries of a row that are multiplied together.
STEP = 8192
_COUNTS = "first bigint, n_words bigint, a array<bigint>, sums array<bigint>, packed array<binary>"


def _ids(text: str) -> Column:
    return word_ids(words(F.coalesce(F.col(text), F.lit(""))))


def _numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column, or of all its lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.flatten() if pa.types.is_list(column.type) else column
    return column.to_numpy(zero_copy_only=False)


# --- packed counts --------------------------------------------------------------


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of whole numbers, all lowest ones first, without those that are always 0."""
    width = (int(numbers.max()).bit_length() + 7) // 8
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _whole(planes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes) // n] = planes.reshape(-1, n).T
    return out.view("<i8").ravel()


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts in a few bytes each."""
    if not len(keys):
        return b""
    parts = [_planes(np.diff(keys, prepend=0)), _planes(counts)]
    body = np.concatenate([p.ravel() for p in parts])
    return struct.pack("<qq", len(keys), len(parts[0])) + pa.Codec("zstd", 1).compress(body, asbytes=True) + struct.pack("<q", len(body))


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n, width = struct.unpack_from("<qq", packed)
    (size,) = struct.unpack_from("<q", packed, len(packed) - 8)
    body = np.frombuffer(pa.Codec("zstd").decompress(packed[16:-8], size), np.uint8)
    return np.cumsum(_whole(body[: width * n], n)), _whole(body[width * n :], n)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    free = 63 - int(keys.max()).bit_length()
    if int(counts.max()).bit_length() <= free:  # a number that holds both sorts fastest
        both = keys << free
        both |= counts
        both.sort()
        keys, counts = both >> free, both & ((1 << free) - 1)
        del both
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.add.reduceat(counts, new)


# --- the matrix -----------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, times = np.unique(_numpy(batch.column(0)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], names=["word", "n"])


def vocabulary(corpus: DataFrame, text: str, min_count: int) -> DataFrame:
    """(word, n) of the words that are seen often enough, written."""
    each = corpus.select(_ids(text).alias("_w")).mapInArrow(_word_counts, "word bigint, n bigint")
    counted = each.groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.filter(F.col("n") >= min_count), "vocabulary")


def _sorted_words(known: DataFrame) -> np.ndarray:
    return np.sort(_numpy(known.select("word").toArrow()["word"]))


def _shared(known: DataFrame, step: int, n: int, part: Callable[[int, int], tuple]) -> list[Broadcast]:
    """A broadcast of the first word's number and ``part`` of each range of ``step`` words."""
    send = known.sparkSession.sparkContext.broadcast
    return [send((at, *part(at, min(at + step, n)))) for at in range(0, n, step)]


def _numbers(shared: list[Broadcast], digests: np.ndarray) -> np.ndarray:
    """The number of each word, -1 of one that is not in the vocabulary."""
    out = np.full(len(digests), -1, np.int64)
    for base, known in one_at_a_time(shared):
        at = np.minimum(np.searchsorted(known, digests), len(known) - 1)
        hit = known[at] == digests
        out[hit] = base + at[hit]
    return out


def _pairs(shared: list[Broadcast], n_words: int, rows: int, window: int):
    """(block, packed): the counted pairs of some millions at a time, in both orders."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
        counts = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        a, b = np.divmod(keys, max(n_words, 1))
        other = a != b
        turned = (b * n_words + a)[other]
        del a, b
        keys, counts = added(np.concatenate([keys, turned]), np.concatenate([counts, counts[other]]))
        size = rows * n_words
        blocks = np.unique(keys // max(size, 1))
        cuts = np.searchsorted(keys, np.append(blocks, blocks[-1:] + 1) * size)
        packed = [
            pack(keys[x:y] - block * size, counts[x:y])
            for block, x, y in zip(blocks.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], names=["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)]
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            ends, flat = np.cumsum(lengths), _numpy(batch.column(0))
            start = 0
            while start < len(ends):  # so many texts that their pairs are bounded
                told = ends[start] - lengths[start]
                end = max(start + 1, int(np.searchsorted(ends, told + PAIRS // (2 * window), "right")))
                of = np.repeat(np.arange(end - start), lengths[start:end])
                ids = _numbers(shared, flat[told : ends[end - 1]])
                for d in range(1, window + 1):
                    a, b = ids[:-d], ids[d:]
                    met = (of[:-d] == of[d:]) & (a >= 0) & (b >= 0)
                    a, b = a[met], b[met]
                    held.append(np.minimum(a, b) * n_words + np.maximum(a, b))
                if sum(map(len, held)) >= PAIRS:
                    yield sent(held)
                start = end
        if held:
            yield sent(held)

    return run


def _merged(n_words: int, rows: int, step: int):
    """A block of the matrix from what the tasks have sent, packed by ranges of the other word."""

    def run(sent: pa.Table) -> pa.Table:
        block = sent["block"][0].as_py()
        held = [unpack(b"")]
        for packed in sent["packed"]:
            held.append(unpack(packed.as_py()))
            if sum(len(k) for k, _ in held[1:]) > BLOCK_PAIRS:
                held = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        keys, counts = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        at, start = np.unique(keys // n_words, return_index=True)
        piece = keys % n_words // step
        packed = [pack(keys[here], counts[here]) for here in (piece == j for j in range(-(-n_words // step)))]
        row = {
            "first": block * rows, "n_words": n_words, "a": block * rows + at, "sums": np.add.reduceat(counts, start),
            "packed": packed,
        }
        return pa.Table.from_pylist([row], _schema(_COUNTS))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def cooccurrence(
    corpus: DataFrame,
    text: str,
    window: int,
    min_count: int,
    limit: int = LIMIT,
    known: DataFrame | None = None,
) -> DataFrame:
    """How often two words stand within ``window`` words, in both orders: blocks of the rows
    of some words, by their numbers ``a``, with the sum of each row. ``known``: the
    vocabulary, where the caller has it."""
    known = vocabulary(corpus, text, min_count) if known is None else known
    told = _sorted_words(known)
    n = len(told)
    n_told = known.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-n_told * 2 * window // BLOCK_PAIRS))
    rows = max(1, -(-n // blocks))
    shared = _shared(known, max(8, limit // 8), n, lambda x, y: (told[x:y],))
    each = corpus.select(_ids(text).alias("_w")).mapInArrow(_pairs(shared, n, rows, window), "block bigint, packed binary")
    made = each.groupBy("block").applyInArrow(_merged(n, rows, max(8, limit // WORD_BYTES)), _COUNTS)
    counts = materialise(made, "pair-counts")
    _forget(shared)
    return counts


def _forget(shared: list[Broadcast]) -> None:
    for part in shared:
        part.destroy()


def _sums(blocks: DataFrame) -> np.ndarray:
    """The sum of each word's row, by number; 0 without a row."""
    size = blocks.select("n_words").first()
    out = np.zeros(size[0] if size else 0, np.int64)
    rows = blocks.select("a", "sums").toArrow()
    out[_numpy(rows["a"])] = _numpy(rows["sums"])
    return out


def _entries(row: dict, piece: int, base: int, sums: np.ndarray, total: float) -> tuple[np.ndarray, ...]:
    """The entries of a block's piece: key, count, row of the block, place of the other word in
    the piece and weight."""
    keys, counts = unpack(row["packed"][piece])
    at = keys // row["n_words"]
    other = keys - at * row["n_words"] - base
    a = np.array(row["a"], np.int64) - row["first"]
    own = np.ones(a[-1] + 1)
    own[a] = row["sums"]
    return keys, counts, at, other, np.log(counts * total / (own[at] * sums[other]))


def positive_pmi(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The blocks with their pairs of a positive weight alone; ``total`` is the sum of all counts."""
    sums = _sums(counts)
    total = float(sums.sum())
    shared = _shared(counts, max(8, limit // WORD_BYTES), len(sums), lambda x, y: (sums[x:y].astype(float),))
    kind = f"{_COUNTS}, total double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            left = [np.zeros(row["a"][-1] + 1 - row["first"], bool) for row in rows]
            packed: list[list[bytes]] = [[] for _ in rows]
            for piece, (base, theirs) in enumerate(one_at_a_time(shared)):
                for row, there, out in zip(rows, left, packed, strict=True):
                    keys, n, at, _, weight = _entries(row, piece, base, theirs, total)
                    good = weight > 0
                    there[at[good]] = True
                    out.append(pack(keys[good], n[good]))
            for row, there, out in zip(rows, left, packed, strict=True):
                kept = there[np.array(row["a"]) - row["first"]]
                if kept.any():
                    row |= {"a": np.array(row["a"])[kept], "sums": np.array(row["sums"])[kept], "packed": out, "total": total}
                    yield from pa.Table.from_pylist([row], _schema(kind)).to_batches()

    pmi = materialise(counts.mapInArrow(run, kind), "positive-pmi")
    _forget(shared)
    return pmi


# --- products -------------------------------------------------------------------


def _images(rows: list[dict], shared: list[Broadcast], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block the words of its rows, their own vectors and their rows of the product."""
    out = [(np.array(row["a"], np.int64), *(np.zeros((len(row["a"]), width)) for _ in range(2))) for row in rows]
    for piece, (base, theirs, vectors) in enumerate(one_at_a_time(shared)):
        vectors = vectors.astype(np.float64, copy=False)
        for row, (a, own, image) in zip(rows, out, strict=True):
            here = (a >= base) & (a < base + len(vectors))
            own[here] = vectors[a[here] - base]
            _, _, at, other, weight = _entries(row, piece, base, theirs, row["total"])
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, int)
            places = np.searchsorted(a, row["first"] + at[starts])
            for place, start, end in zip(places.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False):
                for x in range(start, end, STEP):
                    y = min(x + STEP, end)
                    image[place] += weight[x:y] @ vectors.take(other[x:y], axis=0)
    return out


def _vector_lists(vectors: np.ndarray) -> pa.Array:
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(vectors).ravel()))


def _times(pmi: DataFrame, shared: list[Broadcast], width: int) -> DataFrame:
    """(word, v): the matrix times the table of vectors, by the words' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, image in _images(batch.to_pylist(), shared, width):
                yield pa.RecordBatch.from_arrays([pa.array(a), _vector_lists(image)], names=["word", "v"])

    return materialise(pmi.mapInArrow(run, "word bigint, v array<double>"), "subspace")


def _added_up(parts: DataFrame, width: int) -> np.ndarray:
    sums = parts.select(F.posexplode("t").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(width * width)
    for row in sums.collect():  # width squared numbers
        out[row.i] = row.x
    return out.reshape(width, width)


def _square(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["t"])


def _form(pmi: DataFrame, shared: list[Broadcast], width: int) -> np.ndarray:
    """The table's columns times the matrix times the table: width x width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _images(batch.to_pylist(), shared, width)
            if found:
                yield _square(sum(own.T @ image for _, own, image in found))

    return _added_up(pmi.mapInArrow(run, "t array<double>"), width)


def _inner(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum over words of the outer products: a width x width matrix, added up on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _numpy(batch.column(0)).reshape(-1, width)
            total += x.T @ x
        yield _square(total)

    return _added_up(vectors.select("v").mapInArrow(run, "t array<double>"), width)


def _orthogonal(vectors: DataFrame, width: int) -> np.ndarray:
    """What turns the table into one of orthonormal columns; directions that vanish become
    zero columns."""
    values, turn = np.linalg.eigh(_inner(vectors, width))
    return turn * np.where(values > values.max(initial=0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def _rotated(vectors: DataFrame, matrix: np.ndarray, shared: list[Broadcast]) -> DataFrame:
    """(vec_id, v): each row times the matrix, under its word's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = _numpy(batch.column(0)), np.zeros(batch.num_rows, np.int64)
            for base, known in one_at_a_time(shared):
                here = (ids >= base) & (ids < base + len(known))
                digests[here] = known[ids[here] - base]
            turned = _numpy(batch.column(1)).reshape(len(ids), -1) @ matrix if len(ids) else np.zeros((0, matrix.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(digests), _vector_lists(turned)], names=["vec_id", "v"])

    return vectors.select("word", "v").mapInArrow(run, "vec_id bigint, v array<double>")


def train(
    corpus: DataFrame,
    text: str = "review",
    dim: int = DIM,
    window: int = WINDOW,
    min_count: int = MIN_COUNT,
    rounds: int = ROUNDS,
    limit: int = LIMIT,
) -> DataFrame:
    """(vec_id, embedding): a vector for each frequent word, under the word's digest."""
    width = dim + EXTRA
    known = vocabulary(corpus, text, min_count)
    counts = cooccurrence(corpus, text, window, min_count, limit, known)
    pmi = positive_pmi(counts, limit)
    discard(counts)
    told, sums = _sorted_words(known), _sums(pmi).astype(float)
    step = max(8, limit // WORD_BYTES)
    signs = F.array(
        *[(F.xxhash64("word", F.lit(j)).bitwiseAND(F.lit(1)) * 2 - 1).cast("tinyint") for j in range(width)]
    )

    def of_signs(x: int, y: int) -> tuple:
        some = known.filter(F.col("word").between(int(told[x]), int(told[y - 1])))
        found = some.select("word", signs.alias("v")).toArrow().sort_by("word")
        return sums[x:y], _numpy(found["v"]).reshape(y - x, width)

    def of_turned(block: DataFrame, turn: np.ndarray) -> Callable[[int, int], tuple]:
        def part(x: int, y: int) -> tuple:
            found = block.filter(F.col("word").between(x, y - 1)).toArrow()
            out = np.zeros((y - x, width))
            out[_numpy(found["word"]) - x] = _numpy(found["v"]).reshape(-1, width) @ turn
            return sums[x:y], out

        return part

    shared = _shared(known, step, len(sums), of_signs)
    block = _times(pmi, shared, width)
    for _ in range(rounds):
        _forget(shared)
        shared = _shared(known, step, len(sums), of_turned(block, _orthogonal(block, width)))
        before, block = block, _times(pmi, shared, width)
        discard(before)
    _forget(shared)
    turn = _orthogonal(block, width)
    shared = _shared(known, step, len(sums), of_turned(block, turn))
    inner = _form(pmi, shared, width)
    _forget(shared)
    values, last = np.linalg.eigh((inner + inner.T) / 2)
    lead = np.argsort(-np.abs(values))[:dim]
    turn = turn @ (last[:, lead] * np.sqrt(np.abs(values[lead])))
    shared = _shared(known, max(8, limit // 8), len(told), lambda x, y: (told[x:y],))
    vectors = _rotated(block, turn * _signs(block, turn), shared)
    vectors = materialise(
        vectors.select("vec_id", F.transform("v", lambda x: r6(x)).alias("embedding")), "word-vectors"
    )
    _forget(shared)
    for table in (block, pmi, known):
        discard(table)
    return vectors


def _signs(block: DataFrame, turn: np.ndarray) -> np.ndarray:
    """For each column the sign that makes its sum positive."""
    width = turn.shape[0]
    sums = block.agg(*[F.sum(F.get("v", F.lit(j))).alias(f"_{j}") for j in range(width)]).first()
    total = np.array([x or 0.0 for x in sums]) @ turn
    return np.where(total < 0, -1.0, 1.0)


def text_vectors(texts: DataFrame, vectors: DataFrame, key: Sequence[str], text: str, limit: int = LIMIT) -> DataFrame:
    """(key, v): the sum of the vectors of a text's words, of texts with a known word. The
    vectors go to the texts, in pieces of at most ``limit`` bytes, and not the words to them."""
    key = list(key)
    vectors = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    told = np.sort(_numpy(vectors.select("vec_id").toArrow()["vec_id"]))
    width = len(vectors.first()["embedding"]) if len(told) else 1
    told = np.unique(told)

    def part(x: int, y: int) -> tuple:
        found = vectors.filter(F.col("vec_id").between(int(told[x]), int(told[y - 1]))).toArrow()
        out = np.zeros((y - x, width))
        np.add.at(out, np.searchsorted(told[x:y], _numpy(found["vec_id"])), _numpy(found["embedding"]).reshape(-1, width))
        return told[x:y], out

    shared = _shared(vectors, max(8, limit // (8 * width + 16)), len(told), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(key))
            flat = _numpy(lists)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            sums, met = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
            for _, known, theirs in one_at_a_time(shared):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = np.flatnonzero(known[at] == flat)
                met[of[hit]] = True
                for x in range(0, len(hit), 16 * STEP):
                    some = hit[x : x + 16 * STEP]
                    starts = np.flatnonzero(np.append(True, of[some][1:] != of[some][:-1]))
                    sums[of[some][starts]] += np.add.reduceat(theirs[at[some]], starts, axis=0)
            columns = [c.filter(pa.array(met)) for c in batch.columns[: len(key)]]
            yield pa.RecordBatch.from_arrays([*columns, _vector_lists(sums[met])], names=[*key, "v"])

    each = texts.select(*key, _ids(text).alias("_w"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema.fields[:-1])
    sums = each.mapInArrow(run, f"{kinds}, v array<double>").groupBy(*key).agg(*[F.sum(F.get("v", F.lit(j))).alias(f"_{j}") for j in range(width)])
    return sums.select(*key, F.array(*[f"_{j}" for j in range(width)]).alias("v"))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; null where one has no direction."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
