"""Fill-in-the-middle examples cut by a wavelet matrix over character classes.

Every character gets a symbol: its class (blank, line feed, word character, mark)
and whether a unit ends with it. A wavelet matrix over the symbols of a run of
texts answers how often a symbol stands before a place; the counts of the symbols
that end a unit, added up, are the number of units before it. So a text's units
are counted by two queries, and each of its two cuts is found by bisection on
these counts, for all texts of the run at once and without a list of units.

A run holds about ``RUN_CHARS`` characters, a longer text is a run of its own;
rows stay in their partition.

Edge cases: null counts as empty; an empty text, a text that holds one of the
sentinels, and half of the others (by their id's hash) stay plain; a null id is
hashed as the empty string, so all rows without an id get the same shares; repeated
rows give equal rows; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are cut, and how many of these put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
RUN_CHARS = 2**20
BLANK, BREAK, WORD, MARK = range(4)
CLASSES = 4
#: Bits of a symbol: two of the class, and the lowest says that a unit ends here.
BITS = 3


def _class_table() -> np.ndarray:
    table = np.full(128, MARK, np.uint8)
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = WORD
    table[[0x20, *range(0x09, 0x0E)]] = BLANK
    table[0x0A] = BREAK
    return table


CLASS_OF = _class_table()


class WaveletMatrix:
    """Ranks of symbols below 2**bits; every level is a bit vector with a popcount
    directory for each 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS) -> None:
        self.size, self.bits = symbols.size, bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit) & 1
            packed = np.zeros((symbols.size // 64 + 1) * 8, np.uint8)
            filled = np.packbits(ones, bitorder="little")
            packed[: filled.size] = filled
            words = packed.view("<u8")
            directory = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((words, directory, symbols.size - int(directory[-1])))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of ``places``."""
        at = np.concatenate((places, [0]))  # the last one follows where the symbol's run starts
        for level, (words, directory, zeros) in enumerate(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = directory[word] + np.bitwise_count(words[word] & below)
            at = zeros + ones if symbol >> (self.bits - 1 - level) & 1 else at - ones
        return at[:-1] - at[-1]


class Run:
    """Texts on end, their symbols, and the wavelet matrix over them."""

    def __init__(self, texts: list[str], unit: str) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = np.full(points.size, WORD, np.uint8)
        ascii_ = points < 128
        kinds[ascii_] = CLASS_OF[points[ascii_]]
        last = np.zeros(points.size, bool)
        if unit == "word":  # a run of others with the blanks before it, or blanks at the end
            gap = kinds <= BREAK
            last[:-1] = ~gap[:-1] & gap[1:]
        elif unit == "line":
            last[:] = kinds == BREAK
        elif unit == "char":
            last[:] = True
        else:
            raise ValueError(f"no unit {unit}: word, line or char")
        last[self.ends[sizes > 0] - 1] = True
        self.matrix = WaveletMatrix(kinds << 1 | last)

    def units_before(self, places: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(kind << 1 | 1, places) for kind in range(CLASSES))

    def counts(self) -> np.ndarray:
        return self.units_before(self.ends) - self.units_before(self.starts)

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """The first place of each text that has so many units before it, from its start."""
        wanted = self.units_before(self.starts) + units
        low, high = self.starts.copy(), self.ends.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.units_before(middle) >= wanted
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low - self.starts


def runs(texts: list[str], limit: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """(first, after the last) of stretches of about ``limit`` characters."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, len(texts)


def _rearranged(text: str, form: str, a: int, b: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _cut(unit: str):
    schema = pa.schema(
        [("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, forms = batch.column("_text").to_pylist(), batch.column("form").to_pylist()
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y"))
            parts = []
            for first, after in runs(texts):
                run = Run(texts[first:after], unit)
                n = run.counts()
                u, v = x[first:after] % (n + 1), y[first:after] % (n + 1)
                parts.append((n, run.cuts(np.minimum(u, v)), run.cuts(np.maximum(u, v))))
            n, a, b = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else [np.empty(0, int)] * 3
            plain = np.array([f == "plain" for f in forms], bool)
            out = [_rearranged(*row) for row in zip(texts, forms, a.tolist(), b.tolist(), strict=True)]
            made = [pa.array(n), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(out, pa.string())]
            made = [c.cast(f.type) for c, f in zip(made, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), made[0], batch.column("form"), *made[1:]],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return work


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "word",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain) and output of every row. ``unit`` is word, line or char."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), F.sha2(key, 256).alias("_h")
    )

    def draw(i: int) -> Column:
        return F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint")

    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("_text"), F.lit(sentinel))
    form = (
        F.when((F.col("_text") == "") | marked | (draw(2) % 100 >= rate), "plain")
        .when(draw(3) % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    rows = drawn.select("doc_id", "_text", form.alias("form"), draw(0).alias("_x"), draw(1).alias("_y"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _cut(unit),
        f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: a cut text holds no sentinel of its own,
    so its three parts stand between the sentinels."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )


def fim_report(docs: DataFrame) -> DataFrame:
    """The examples as digests: of the output, and of the text rebuilt from it."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
