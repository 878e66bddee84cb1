import hashlib
import random
import re
import time

from revlens.llm.pii import CONTEXT, find_pii, pii_report


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(span):
    return re.sub("[^0-9]", "", span)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
]
PARTS = [
    "a", "b.", "@", "1", "2", "25", "255.", "256.", "007.", ".", "-", " ", "+", "(", ")", "5", "é", "🙂",
    "4111 1111 1111 1111", "4111111111111111", "_", "%", "a@b.c", "+1 ", "10.0.0.1", "\n", "card ",
]


def brute(text):
    counts, listed = [], []
    for kind, pattern, holds in PLAIN:
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if holds(m.group())]
        counts.append(len(found))
        listed += found
    return (*counts, hashlib.sha256(",".join(listed).encode()).hexdigest()), listed


def test_against_plain_patterns(spark, sf):
    rng = random.Random(9)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["x@y.z_d@e.f", "a.b@" * 500, "a@b." + "c." * 2000, "+1" + "(" * 5000, "1 " * 3000]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii_report(frame).collect():
        want, listed = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, texts[r.doc_id]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("iban")] == listed


def test_checksums_and_context(spark):
    rows = [
        (0, "My IBAN: GB82 WEST 1234 5698 7654 32."), (1, "GB83 WEST 1234 5698 7654 32"),
        (2, "DE89370400440532013000"), (3, "pay by card 4111111111111111"), (4, "so 4111111111111111"),
        (5, "card " + "x" * CONTEXT + " 4111111111111111"),
    ]
    found = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].iban_spans[0].text == "GB82 WEST 1234 5698 7654 32"
    assert found[1].iban_spans == [] and len(found[2].iban_spans) == 1
    assert found[0].iban_spans[0].score > found[2].iban_spans[0].score
    assert found[3].card_spans[0].score > found[4].card_spans[0].score == found[5].card_spans[0].score


def test_edge_cases(spark, odd_docs, no_docs):
    rows = pii_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == nothing and r.spans == "" for r in rows if r.doc_id in (1, 2, 3))
    assert pii_report(no_docs).count() == 0
    long = ["1" * 100_000, "1.1." * 20_000, "a" * 100_000 + "@", "+" + "1" * 100_000, "A1" * 50_000]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert pii_report(frame).count() == len(long)


def test_ibans_among_other_words(spark):
    """Valid ibans before capitals and digits, spaced out, close together and of other countries."""
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    spaced, other = "GB82 " + " ".join("WEST12345698765432"), "ZZ00 1234 5678 9012 345"
    number = int("".join(str(int(c, 36)) for c in other[4:].replace(" ", "") + "ZZ00"))
    other = f"ZZ{98 - number % 97:02d}{other[4:]}"
    rows = [
        (f"{de} BIC COBADEFF", [de]), (f"{gb} THANKS", [gb]), (f"é🙂 {gb} 1234", [gb]), (f"{gb} {de} {gb}", [gb, de, gb]),
        (f"AB12 {de}", [de]), (f"AD12 {de}", [de]), (spaced, None), (f"{other} OK", [other]),
        (f"IBAN {gb}X", []), ("GB82 WEST 1234 5698 7654", []), ("AB12 C " * 3000 + de, [de]), (f"{de}, ({gb})", [de, gb]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in find_pii(frame).collect():
        text, want = rows[r.doc_id]
        found = [s.text for s in r.iban_spans]
        assert all(text[s.start : s.end] == s.text for s in r.iban_spans)
        assert found == ([text] if want is None else want), text[:80]


def test_very_many_matches_in_one_text(spark):
    """About linear in the matches: 200,000 addresses or 20,000 ibans stand in one text."""
    n, de = 200_000, "DE89370400440532013000"
    texts = [" ".join(f"u{i}@x.org" for i in range(n)), "10.0.0.1 " * n, f"{de} " * 20_000, "ab " + f"{de} " * 700]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in pii_report(frame).collect()}
    assert time.monotonic() - began < 60
    assert out[0].n_email == n and out[1].n_ip == n
    assert out[0].base_sha256 == brute(texts[0])[0][4] and out[1].base_sha256 == brute(texts[1])[0][4]
    for i, first in ((2, 0), (3, 3)):
        places = [tuple(map(int, s.split(":")[1:])) for s in out[i].spans.split(",") if s.startswith("iban")]
        assert places == [(at, at + 22) for at in range(first, len(texts[i]) - 1, 23)]
