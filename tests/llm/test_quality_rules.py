import math
import zlib

import pytest

from revlens.llm.quality_rules import STATS, fit_rules, quality, with_statistics


@pytest.fixture(scope="module")
def tables(spark, sf):
    wider = sf.replace("sf0.001", "sf0.01")
    return [spark.read.parquet(f"{wider}/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return fit_rules(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = quality(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {
        r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    }
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_compiled_rules_say_what_the_model_says(tables, model):
    """The column against the rules read one by one."""
    docs = tables[0].limit(200)
    stats = {r.doc_id: r.asDict() for r in with_statistics(docs, "doc_id", "text").collect()}
    assert model.rules and all(s.stat in STATS for rule, _ in model.rules for s in rule)
    for r in quality(docs, model).collect():
        total = model.bias
        for rule, weight in model.rules:
            if all((stats[r.doc_id][f"s_{s.stat}"] > s.edge) == s.above for s in rule):
                total += weight
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
        assert r.predicted == (r.score >= 0.3)


def test_edge_cases(spark, odd_docs, no_docs, model):
    rows = quality(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert quality(no_docs, model).count() == 0
    schema = "doc_id long, quality int, label string"
    empty = fit_rules(odd_docs, spark.createDataFrame([], schema))
    assert {r.score for r in quality(odd_docs, empty).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, "x"), (None, 0, "x"), (4, None, "x"), (0, 1, "y")], schema)
    assert all(r.predicted == 1 for r in quality(odd_docs, fit_rules(odd_docs, one)).collect())
