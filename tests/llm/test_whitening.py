"""Whitening against the SVD of all rows."""
import collections
import math

import numpy as np
import pytest
from llm_texts import clashing
from pyspark.sql import functions as F

from corpusflow.llm import whitening
from corpusflow.llm.whitening import fit_whitening, whiten, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, d):
    """n, sums, covariance, variances and components by the definition."""
    x = np.unique(np.floor(256 * np.array([np.float32(v).astype(float) for v in vectors if len(v) == d])).astype(int), axis=0)
    centred = x - x.sum(0) / len(x)
    _, sigma, columns = np.linalg.svd(centred)
    values = np.zeros(d)
    values[:len(sigma)] = sigma ** 2 / len(x)
    return len(x), x.sum(0), values, columns.T


def check(rows, vectors, ids, d, k, tolerance=1e-9):
    n, sums, values, columns = plain([vectors[i] for i in ids], d)
    by_row = collections.defaultdict(dict)
    for r in rows:
        assert r.n == n and r.component not in by_row[r.vec_id]
        by_row[r.vec_id][r.component] = r
    assert set(by_row) == set(ids) and all(set(v) == set(range(1, k + 1)) for v in by_row.values())
    signs = {}
    for i in ids:
        x = [math.floor(256 * float(np.float32(c))) for c in vectors[i]]
        for c, r in by_row[i].items():
            assert r.deviation == sum((n * e - int(s)) ** 2 for e, s in zip(x, sums, strict=True))
            want = (np.array(x) - sums / n) @ columns[:, c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, math.copysign(1, want * r.whitened))
                assert r.whitened * sign == pytest.approx(want, rel=tolerance, abs=tolerance)
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-8


def test_scores_of_random_vectors(spark):
    rng = np.random.default_rng(1)
    scales = np.linspace(3, 0.2, 12)
    vectors = [list(v) for v in rng.normal(size=(400, 12)) * scales + 5]
    vectors += vectors[:30] + [vectors[0]] * 100
    odd = [None, [], [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0] * 5, [-float("inf")] * 12]
    rows = whiten(clashing(table(spark, vectors + odd))).collect()
    check(rows, vectors + odd, range(len(vectors)), 12, 4)


def test_hardly_independent_dimensions(spark):
    """A condition number that the covariance shows squared: far from orthogonal after one pass."""
    rng = np.random.default_rng(2)
    base = rng.integers(-2000, 2000, size=(300, 6))
    x = np.hstack([base * 64, base[:, :1] * 64 + rng.integers(0, 2, size=(300, 1)), rng.integers(0, 2, size=(300, 1))])
    vectors = [list(v / 256) for v in x]
    check(whiten(table(spark, vectors)).collect(), vectors, range(300), 8, 4, 1e-8)
    df = whole_vectors(table(spark, vectors), "vec_id", "embedding")
    model, fit = fit_whitening(df, 8)
    exact = plain(vectors, 8)[2]
    assert model.variances == pytest.approx(exact, rel=1e-6) and model.identity_error < 1e-6 and fit.count() == 300


def test_more_dimensions_than_vectors_and_constant_ones(spark):
    vectors = [[1, 0, 0, 7, 2, 1, 0, 0], [0, 1, 0, 7, 2, 0, 1, 0], [0, 0, 1, 7, 2, 0, 0, 1], [3, 0, 1, 7, 2, 0, 2, 1]]
    rows = whiten(table(spark, vectors)).collect()
    n, sums, values, columns = plain(vectors, 8)
    assert len(rows) == 16 and all(r.identity_error < 1e-9 for r in rows)
    for r in rows:
        if r.component == 4:
            assert (r.whitened, r.explained) == (0, 0)
        else:
            want = (np.array(vectors[r.vec_id]) * 256 - sums / n) @ columns[:, r.component - 1] / math.sqrt(values[r.component - 1])
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-9)


def test_few_rows(spark):
    assert whiten(table(spark, [])).collect() == [] and whiten(table(spark, [None, [], [None]])).collect() == []
    rows = whiten(table(spark, [[0.5, 1.0], [0.5, 1.0], None])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows)] == [
        (i, c, 1, 0, 0.0, 0.0, 0.0) for i in (0, 1) for c in (1, 2)]
    assert whiten(table(spark, [[0.5], [1.0]])).count() == 2


def test_numbers_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        whiten(table(spark, [[1e30, 1.0], [0.0, 1.0]])).collect()


def test_small_batches_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [list(v) for v in rng.normal(size=(60, 5))]
    monkeypatch.setattr(whitening, "ROWS", 7)
    check(whiten(table(spark, vectors).repartition(5, F.col("vec_id"))).collect(), vectors, range(60), 5, 4)
