import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from revlens.llm.token_count import LATIN, Counter, MergeTable, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab \n\té漢s'1²½٣_-.\x1c\xa0\x85ɐ×÷ª", "<|endoftext|>", "🙂", "tion", " the", "'ll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_count_as_the_library_counts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(5000)]
    texts += ["a" * 2000, "ab" * 3000, "<|endoftext|>" * 3, " " * 500 + "x", "", "\n\n\n"]
    texts += ["".join(rng.choices("abcdef", k=20_000))]
    assert {bool(LATIN.fullmatch(t)) for t in texts} == {True, False}
    n_bytes, n_tokens = Counter(MergeTable(PATH)).count(texts)
    assert n_tokens == expected(library, texts)
    assert n_bytes == [len(t.encode()) for t in texts]


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for (doc_id, text), n in zip(texts, expected(library, [t for _, t in texts]), strict=True):
        assert (rows[doc_id].n_bytes, rows[doc_id].n_tokens) == (len(text.encode()), n)


def test_memory_is_emptied(library, monkeypatch):
    monkeypatch.setattr("revlens.llm.token_count.REMEMBERED", 10)
    monkeypatch.setattr("revlens.llm.token_count.CHARS_AT_ONCE", 20)
    texts = [f"some words number {i} and {i * i}" for i in range(50)]
    counter = Counter(MergeTable(PATH))
    assert counter.count(texts)[1] == expected(library, texts)
    assert len(counter.known) < 60


def test_edge_cases(odd_docs, no_docs):
    rows = token_counts(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert token_counts(no_docs, PATH).count() == 0
