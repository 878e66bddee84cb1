"""Fill-in-the-middle cuts against a regular expression, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import fim_wavelet as op

UNIT = {
    "word": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"),
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "char": re.compile(r".", re.DOTALL),
}


def expected(doc_id, text, unit="word"):
    text = text or ""
    units = UNIT[unit].findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    u, v = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "Bc", "é", "漢字", "😀", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1f", "\xa0", "<", "<P", "S>", "9.", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ranks_like_counting():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = op.WaveletMatrix(symbols)
        places = np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, places).tolist() == [0, *np.cumsum(symbols == s).tolist()]


@pytest.mark.parametrize("unit", ["word", "line", "char"])
def test_like_the_expression(spark, unit):
    texts = [*random_texts(1, 300), None, "", " ", "\n", "x", "a <P> b", "a <S> b c", "<M>", " lead", "trail "]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in op.fill_in_middle(docs, unit=unit).collect())
    assert got == sorted(expected(i, t, unit) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_short_runs_give_the_same(monkeypatch):
    texts = [*random_texts(2, 100), "", "word " * 500]
    whole = op.Run(texts, "word").counts().tolist()
    assert whole == [len(UNIT["word"].findall(t)) for t in texts]
    parts = [op.Run(texts[a:b], "word").counts().tolist() for a, b in op.runs(texts, 50)]
    assert len(parts) > 20 and sum(parts, []) == whole


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*random_texts(4, 300), "<<P", "a<", "P> b <", "S>"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = op.fill_in_middle(docs).withColumn("back", op.restored(F.col("output"), F.col("form")))
    assert {r.doc_id: r.back for r in out.collect()} == dict(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in op.fill_in_middle(odd_docs).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    report = op.fim_report(odd_docs).collect()
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.restored_sha256 for r in report) == texts
    assert op.fim_report(no_docs).count() == 0
    with pytest.raises(ValueError):
        op.Run(["a"], "verse")
