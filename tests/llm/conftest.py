import pytest

from revlens.llm import line_dedup, mixing

LONG = " ".join(f"word{i % 977} line" for i in range(30_000))
CLASHING = {
    "_row": "x", "_h": 7, "_text": "t", "score": 0.5, "severity": 1, "rejected": True, "fp": 3,
    "copies": 9, "n_tokens": 8, "label": "l", "_id": 5, "line": "z", "at": 1, "mask": 2, "words": "w",
}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [
        (0, "One plain text of a few words.", "en", "src0"),
        (0, "One plain text of a few words.", "en", "src0"),
        (0, "Another text under the same id, told apart by its text alone.", "en", "src0"),
        (1, None, "en", "src1"),
        (2, "", None, "src1"),
        (None, "A text without an id, and nothing else to tell about it at all.", "de", None),
        (None, None, None, None),
        (3, " \t\n ", "fr", "src7"),
        (4, LONG, "en", "src7"),
        (5, "é" * 50_000, "fr", "other"),
        (6, "7" * 50_000, "en", "src12"),
    ]
    extra = list(CLASHING.values())
    names = ["doc_id", "text", "lang", "source", *CLASHING]
    types = ["bigint", "string", "string", "string"] + [
        {str: "string", int: "int", float: "double", bool: "boolean"}[type(v)] for v in extra
    ]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No table counts as small: the joins beyond the size checks run."""
    for module in (line_dedup, mixing):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, limit=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
