"""The approximate similarity join against all pairs."""
import numpy as np
from pyspark.sql import functions as F

from conftest import plan_text
from corpusflow.operators import search as se, similarity as si


def unit(rng, n, d, spread=0.35, groups=40):
    x = np.repeat(rng.normal(size=(groups, d)), -(-n // groups), axis=0)[:n] + spread * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype("float32")


def frame(spark, x, key="chunk_id", vec="embedding"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"{key} long, {vec} array<float>")


def expanded(pairs, members, asked):
    """Pairs of rows from pairs of representatives."""
    out = (pairs.join(members.select(F.col("member").alias("x"), F.col("representative").alias("id")), "id")
           .join(asked.select(F.col("member").alias("q"), F.col("representative").alias("qid")), "qid"))
    return {(r.q, r.x) for r in out.collect()}


def brute(q, x, d2_max):
    d = ((q[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= d2_max), strict=True)}


def test_recall_against_the_exact_join(spark):
    rng = np.random.default_rng(11)
    x = unit(rng, 3000, 24)
    index, asked = frame(spark, x), frame(spark, x[::3], "qid", "qvec")
    d2_max = 0.3
    pairs, members, askers = si.similarity_join(index, asked, d2_max, leaf=64)
    exact = se.within_radius(index, asked, d2_max).select("qid", F.col("chunk_id").alias("id"))
    assert exact.count() > 5000 and si.recall(pairs, exact) >= 0.9
    # only right pairs, each once
    found = [(r.qid, r.id) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) <= brute(x[::3], x, d2_max)
    assert members.count() == 3000 and askers.count() == 1000


def test_candidates_are_bounded(spark):
    rng = np.random.default_rng(12)
    x = unit(rng, 4000, 16, spread=0.02, groups=3)  # three dense heaps
    index = frame(spark, x).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    tables = si.fit_tables(index, 4000, 16, 4, leaf=50)
    assert tables.depth == 7
    own = tables.buckets(x.astype(float), 0)
    sizes = [np.bincount(own[:, t, 0], minlength=128) for t in range(4)]
    assert max(s.max() for s in sizes) <= 50 and min(s.sum() for s in sizes) == 4000
    probed = tables.buckets(x[:200].astype(float), 5)
    assert probed.shape == (200, 4, 6) and (probed[:, :, 0] == own[:200, :, 0]).all()
    assert all(len(set(row.tolist())) == 6 for row in probed.reshape(-1, 6)) and probed.min() >= 0 and probed.max() < 128


def test_copies_stand_for_each_other(spark):
    rng = np.random.default_rng(13)
    x = unit(rng, 400, 8)
    x[100:300] = x[7]  # half of the rows
    pairs, members, asked = si.similarity_join(frame(spark, x), frame(spark, x, "qid", "qvec"), 0.2, leaf=32, tables=16, probes=8)
    assert pairs.where("qid between 100 and 299").count() == 0 and members.where("representative = 7").count() == 201
    found, want = expanded(pairs, members, asked), brute(x, x, 0.2)
    assert found <= want and len(found) >= 0.95 * len(want)


def test_blocks_change_nothing(spark, monkeypatch):
    x = unit(np.random.default_rng(14), 300, 6)
    index, asked = frame(spark, x), frame(spark, x, "qid", "qvec")
    want = {(r.qid, r.id) for r in si.similarity_join(index, asked, 0.3, leaf=1000)[0].collect()}
    assert want == brute(x, x, 0.3)  # a single bucket is exact
    monkeypatch.setattr(si, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(si, "BLOCK_QUERIES", 70)
    assert {(r.qid, r.id) for r in si.similarity_join(index, asked, 0.3, leaf=1000)[0].collect()} == want


def test_few_rows(spark):
    x = frame(spark, unit(np.random.default_rng(1), 5, 4))
    asked = x.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    pairs, members, askers = si.similarity_join(x.where("false"), asked, 1.0)
    assert pairs.count() == 0 and members.count() == 0 and askers.count() == 5
    assert si.similarity_join(x, asked.where("false"), 1.0)[0].count() == 0
    holes = spark.createDataFrame([(1, None), (2, [None, 1.0]), (3, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    pairs, members, _ = si.similarity_join(holes, holes.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec")), 1.0)
    assert [(r.qid, r.id, r.d2) for r in pairs.collect()] == [(3, 3, 0.0)] and members.count() == 1


def test_plan_has_no_cross_join(spark):
    x = frame(spark, unit(np.random.default_rng(2), 200, 4))
    plan = plan_text(si.similarity_join(x, x.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec")), 0.1, leaf=20)[0])
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_pair_is_left_out(spark):
    """Vectors without clusters and a wide radius, where near vectors lie in buckets far from each other."""
    x = unit(np.random.default_rng(15), 900, 24, spread=3.0, groups=30)
    pairs, members, asked = si.similarity_join(frame(spark, x), frame(spark, x, "qid", "qvec"), 1.1, leaf=16, tables=2, probes=1)
    want = brute(x, x, 1.1)
    assert len(want) > 5000 and {(r.qid, r.id) for r in pairs.collect()} == want  # 0.30 of them before
    assert si.recall(pairs, spark.createDataFrame(sorted(want), "qid long, id long")) == 1.0
