"""Personal data in texts: proposed by patterns, confirmed by checksums, weighed
by context, in built-in functions only.

A pattern's matches come from ``regexp_extract_all`` and the text around them
from ``split`` on the same pattern; lengths added up give the exact places, so no
position is searched twice. Possessive patterns that start where a run of their
characters starts (or where the last match ended) find the same leftmost
matches as the plain ones in linear time and without recursion, however long a
run is.

Kinds: the base kinds email, ip (parts at most 255), card (16 to 19 digits,
Luhn) and phone (8 to 15 digits), and iban (mod-97) as a kind of this operator.
A failing match of a base kind is dropped and nothing inside it is tried again.
An iban is tried at every place where one can start, with the length that its
country fixes; for a country without a registered length, its longest run of whole
words that passes is taken. Of overlapping ibans the first one counts.

A span's score starts at its kind's prior and rises where one of the kind's
context words stands in the ``CONTEXT`` characters before it.

Edge cases: null and empty texts have no spans; repeated rows each get a row;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.arrays import let, running_starts

CONTEXT = 40
LOCAL = "A-Za-z0-9._%+-"


class Kind(NamedTuple):
    """``pattern`` proposes, ``holds`` confirms; ``hint`` is a cheap test of the
    text that every match passes. ``find`` gives the confirmed places by itself."""

    name: str
    pattern: str
    holds: Callable[[Column], Column] | None
    hint: Callable[[Column], Column]
    prior: float
    context: str
    find: Callable[[Column], Column] | None = None


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _byte_parts(span: Column) -> Column:
    """Every part of an address is at most 255, whatever zeros it starts with."""
    return F.forall(
        F.split(span, r"\."),
        lambda p: let(
            F.ltrim(p, F.lit("0")),
            lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255")),
        ),
    )


def luhn(digits: Column) -> Column:
    """Doubling every second digit from the right, the digits add up to a multiple of ten."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    step = F.transform(
        value, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    )
    return F.aggregate(step, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _card(span: Column) -> Column:
    return let(
        _digits(span),
        lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)),
    )


def _phone(span: Column) -> Column:
    return F.length(_digits(span)).between(8, 15)


def mod97(span: Column) -> Column:
    """The first four characters moved to the end and letters read as 10 to 35, the
    number leaves 1 when divided by 97."""
    compact = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = (c >= "0") & (c <= "9")
        return F.when(digit, (acc * 10 + c.cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        )

    return F.aggregate(F.array_remove(F.split(turned, ""), ""), F.lit(0), step) == 1


def _iban(span: Column) -> Column:
    size = F.length(F.regexp_replace(span, " ", ""))
    return F.when(size.between(15, 34), mod97(span)).otherwise(F.lit(False))


#: Characters of an iban by country (the IBAN registry).
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_COUNTRIES = "|".join("|".join(c.split()) for c in IBAN_SIZES.values())
IBAN_START = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}\x20?[A-Z0-9])"
#: What may be an iban where one can start: of a known country, or of another.
IBAN = (
    "^(?:"
    + "|".join(
        rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIZES.items()
    )
    + rf"|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
#: The longest iban with a space between all characters, and one character more; starts
#: are at least five characters apart.
IBAN_WINDOW, IBAN_STARTS = 68, 14
#: Spans that are folded into one list before lists are joined.
FOLD = 256


def _iban_at_start(window: Column) -> Column:
    """The iban that a text starts with, or null."""

    def longest(whole: Column) -> Column:
        words = F.split(whole, " ")
        runs = F.transform(
            F.sequence(F.size(words), F.lit(1), F.lit(-1)),
            lambda k: F.array_join(F.slice(words, 1, k), " "),
        )
        known = whole.rlike(f"^(?:{_COUNTRIES})")
        tried = F.when(known, F.array(whole)).otherwise(runs)
        return F.get(F.filter(tried, _iban), F.lit(0))

    return let(F.regexp_extract(window, IBAN, 0), longest)


def _length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def _apart(spans: Column) -> Column:
    """Of spans in order of their starts those that begin after the last one taken. They
    are folded in blocks, so that no long list grows item by item."""
    kind = "array<struct<start:bigint,end:bigint,text:string,before:string>>"

    def block(upto: Column, items: Column) -> Column:
        zero = F.struct(upto.alias("upto"), F.array().cast(kind).alias("taken"))

        def add(acc: Column, s: Column) -> Column:
            free = s["start"] >= acc["upto"]
            return F.struct(
                F.when(free, s["end"]).otherwise(acc["upto"]).alias("upto"),
                F.when(free, F.concat(acc["taken"], F.array(s))).otherwise(acc["taken"]).alias("taken"),
            )

        return F.aggregate(items, zero, add)

    firsts = F.when(
        F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), F.lit(FOLD))
    ).otherwise(F.array().cast("array<int>"))
    none = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast(f"array<{kind}>").alias("blocks"))
    return F.flatten(
        F.aggregate(
            firsts,
            none,
            lambda acc, first: let(
                block(acc["upto"], F.slice(spans, first, F.lit(FOLD))),
                lambda done: F.struct(
                    done["upto"].alias("upto"),
                    F.concat(acc["blocks"], F.array(done["taken"])).alias("blocks"),
                ),
            ),
            lambda acc: acc["blocks"],
        )
    )


def _iban_places(text: Column) -> Column:
    """array<struct<start, end, text, before>> of the ibans of a text, from its pieces
    between the places where one can start."""

    def placed(cut: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            window = F.array_join(F.slice(cut["heads"], i + 1, IBAN_STARTS), "")
            before = F.array_join(
                F.slice(cut["tails"], F.greatest(i - CONTEXT // 5, F.lit(1)), F.least(i, F.lit(CONTEXT // 5 + 1))), ""
            )
            return F.struct(
                _iban_at_start(F.left(window, F.lit(IBAN_WINDOW))).alias("text"),
                F.right(before, F.lit(CONTEXT)).alias("before"),
            )

        def found(starts: Column) -> Column:
            spans = F.transform(
                F.transform(cut["pieces"], one),
                lambda p, i: F.struct(
                    F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(p["text"])).alias("end"),
                    p["text"].alias("text"), p["before"].alias("before"),
                ),
            )
            return let(F.filter(spans, lambda s: s["text"].isNotNull()), _apart)

        return let(running_starts(F.transform(cut["pieces"], _length)), found)

    def ends(pieces: Column) -> Column:
        return F.struct(
            pieces.alias("pieces"),
            F.transform(pieces, lambda p: F.left(p, F.lit(IBAN_WINDOW))).alias("heads"),
            F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT))).alias("tails"),
        )

    return let(let(F.split(text, IBAN_START, -1), ends), placed)


# The base kinds' patterns (made possessive), limits and order.
BASE = (
    Kind(
        "email",
        rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None,
        lambda t: F.contains(t, F.lit("@")),
        0.9,
        r"(?i)mail|contact|write|address",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _byte_parts,
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        0.6,
        r"(?i)\bip\b|server|host|address|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        _card,
        lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){15}"),
        0.8,
        r"(?i)card|visa|credit|payment|cvv",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _phone,
        lambda t: F.contains(t, F.lit("+")),
        0.7,
        r"(?i)phone|call|tel|mobile|fax",
    ),
)
OWN = (
    Kind(
        "iban",
        IBAN,
        _iban,
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}"),
        0.8,
        r"(?i)iban|account|bank|transfer",
        _iban_places,
    ),
)


def _matches(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, text, before>> of the confirmed matches."""

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        steps = F.transform(found, lambda m, i: _length(F.get(gaps, i)) + _length(m))

        def span(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                gap = F.get(gaps, i)
                start = F.get(starts, i) + _length(gap)
                return F.struct(
                    start.alias("start"), (start + _length(m)).alias("end"),
                    m.alias("text"), F.right(gap, F.lit(CONTEXT)).alias("before"),
                )

            return F.transform(found, one)

        return let(running_starts(steps), span)

    pattern = F.lit(kind.pattern)
    both = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.split(text, kind.pattern, -1).alias("gaps"),
    )
    spans = let(both, placed)
    if kind.holds is not None:
        spans = F.filter(spans, lambda s: kind.holds(s["text"]))
    return spans


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, text, score>> of the confirmed matches."""
    spans = kind.find(text) if kind.find else _matches(text, kind)
    near = lambda s: F.when(s["before"].rlike(kind.context), (1 - kind.prior) / 2).otherwise(0.0)
    scored = F.transform(
        spans,
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["text"].alias("text"),
            (F.lit(kind.prior) + near(s)).alias("score"),
        ),
    )
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>")
    return F.when(kind.hint(text), scored).otherwise(nothing)


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    kinds: tuple[Kind, ...] = BASE + OWN,
) -> DataFrame:
    """doc_id and one column ``<kind>_spans`` for each kind; starts and ends are code
    points, ends exclusive. Row-local: no shuffle."""
    text = F.col("_text")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).select("doc_id", *[_spans(text, k).alias(f"{k.name}_spans") for k in kinds])


def _listed(*arrays: Column) -> Column:
    """kind:start:end of all spans, comma-joined, kinds in the order given."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(a, one) for a in arrays]), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`find_pii`."""
    base = [F.col(f"{k.name}_spans") for k in BASE]
    own = [F.col(f"{k.name}_spans") for k in OWN]
    best = F.array_max(F.concat(*[F.transform(a, lambda s: s["score"]) for a in base + own]))
    return find_pii(docs).select(
        "doc_id",
        *[F.size(f"{k.name}_spans").cast("bigint").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_listed(*base), 256).alias("base_sha256"),
        _listed(*base, *own).alias("spans"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
