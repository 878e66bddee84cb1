import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import ann_lsh
from revlens.llm.ann_lsh import EVERY, Hashing, nearest


def brute(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        own = np.flatnonzero(ids == q)[0]
        score = x @ x[own]
        order = [j for j in np.lexsort((ids, -score.round(12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def collected(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_probes_come_in_order_of_estimated_success():
    h = Hashing(8, 2, 3, 1.5, 27, 3)
    unit = np.random.default_rng(1).standard_normal((5, 8))
    keys = h.probe(unit)
    assert (keys[:, :, 0] == h.index(unit)[:, :, 0]).all()  # its own bucket first
    at = h.places(unit)
    for step, place in ((-1, at - np.floor(at)), (1, 1 - (at - np.floor(at)))):
        nearest_wall = place.argmin(axis=-1)
        assert nearest_wall.shape == (2, 5) and step
    assert all(len(set(keys[t, i])) == 27 for t in range(2) for i in range(5))


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf, name):
    table = spark.read.parquet(f"{sf.replace('sf0.001', name)}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, [i for i, _ in rows if i % EVERY == 0])
    got = collected(nearest(table, F.col("id") % EVERY == 0))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    for q, found in got.items():
        assert len(found) == 5
        assert all(abs(s - exact[q, v]) < 1e-12 for v, s in found if (q, v) in exact)


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(6).tolist()
    rows = [(i, base, "x") for i in range(0, 300)]  # one vector three hundred times
    rows += [(1000 + i, rng.standard_normal(6).tolist(), "x") for i in range(40)]
    usable = [(i, v) for i, v, _ in rows]
    rows += [(2000, [0.0] * 6, "x"), (2050, None, "x"), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x")]
    rows += [(2150, [float("nan")] * 6, "x"), (2200, [float("inf")] + [1.0] * 5, "x"), (None, base, "x")]
    rows += [(2250, [1.0, 2.0], "x"), (0, base, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = collected(nearest(frame, F.col("id") % EVERY == 0, probes=81))
    want = brute(usable, [i for i, _ in usable if i % EVERY == 0])
    assert set(got) == set(want)
    for q in (0, 50, 100, 250):
        assert [v for v, _ in got[q]] == [i for i in range(7) if i != q][:5]
        assert all(abs(s - 1) < 1e-12 for _, s in got[q])
    assert nearest(frame.limit(0), F.col("id") >= 0).count() == 0
    few = collected(nearest(frame.filter("vec_id in (1000, 1001, 1002)"), F.col("id") == 1000, probes=81))
    assert len(few[1000]) == 2


def test_one_bucket_of_everything_is_spread(spark, monkeypatch):
    """Cells so wide that all vectors share a bucket, in small packs: as by brute force,
    and no key of the join has more than a few packs."""
    monkeypatch.setattr(ann_lsh, "PACK", 32)
    monkeypatch.setattr(ann_lsh, "TOGETHER", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(nearest(frame, F.col("id") % 10 == 0, tables=1, width=1e6, probes=1))
    want = brute(rows, [i for i, _ in rows if i % 10 == 0])
    assert {q: [v for v, _ in found] for q, found in got.items()} == {
        q: [v for v, _ in found] for q, found in want.items()
    }
    one = frame.select(F.col("vec_id").alias("class"), F.col("embedding").alias("v"), F.lit(0).alias("slot"), F.lit(0).alias("bucket"))
    met = ann_lsh._meetings(one.filter("class % 10 = 0"), one)
    keys = met.groupBy("q_part", "c_part").count().collect()
    assert max(r["count"] for r in keys) <= 4 and len(keys) > 50
