import __spark_entry__ as entry_points
import corpus_pipeline
import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before and after each stage, each written and read again."""
    out = tmp_path_factory.mktemp("stages")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{out}/{name}")
        after = spark.read.parquet(f"{out}/{name}")
        kept.append((name, docs, after))
        docs = after
    return kept


def test_every_stage_takes_effect_and_keeps_the_columns(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    for name, before, after in stages[:-1]:
        assert after.columns == columns
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old) and len(new) >= 0.5 * len(old)
        if name != "line_dedup":
            assert all(new[i] == old[i] for i in new)
        else:
            assert all(r.n_chars == len(r.text) for r in new.values() if r.text != old[r.doc_id].text)
    assert {"doc_id", "text", "n_tokens", "copies"} <= set(stages[-1][2].columns)


def test_no_long_line_is_left_twice(stages):
    after = dict((n, a) for n, _, a in stages)["line_dedup"]
    lines = [x for r in after.collect() for x in r.text.split("\n") if len(x) >= 40]
    assert len(lines) == len(set(lines))


def test_run_gives_the_last_stage(stages, spark, sf):
    got = sorted(repr(tuple(r)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(repr(tuple(r)) for r in stages[-1][2].collect())
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run


def test_long_texts_reach_python_in_small_batches(spark):
    """Rows and sizes of the batches that a stage sends: none far above the bound, none lost."""

    def sizes(batches):
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_pydict({"n": [n], "b": [sum(map(len, batch.column(0).to_pylist()))]})

    docs = spark.range(0, 300, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 5000) as text")
    stage = corpus_pipeline._shipped(
        lambda spark, docs, sf_dir: docs.select("text").mapInArrow(sizes, "n bigint, b bigint")
    )
    got = stage(spark, docs, "").collect()
    assert sum(r.n for r in got) == 300 and sum(r.b for r in got) == 300 * 55_000
    assert max(r.b for r in got) <= 2 * corpus_pipeline.BATCH_BYTES
