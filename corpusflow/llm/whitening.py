"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A of the fit list (each distinct vector once) are orthogonalised without ever being
collected: a pass over the table solves Q R = A for each batch by substitution and adds up Q'Q, whose
Cholesky factor joins R; a shift keeps the factor defined while Q is far from orthogonal. After a few
passes Q'Q is the identity, so A and R have the same right singular vectors and values, and the SVD of the
small R gives the components of the covariance without its squared condition number.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialized

#: Entries become whole numbers of this many parts of one.
SCALE = 256
COMPONENTS = 4
#: Passes at most; three do for any covariance of full rank, more only sharpen directions without variance.
PASSES = 8
#: Directions with less than this share of the greatest variance count as having none.
NO_VARIANCE = 1e-20
#: Vectors that are worked on at a time.
ROWS = 4_096
#: Whole numbers from here on are refused: sums of them might not fit.
LARGEST = 1 << 31


@dataclass
class Whitening:
    """Components (columns) of the fit list and what they explain."""
    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers on the components, each with variance 1; 0 where a component has none."""
        has = self.variances > 0
        return (x - self.sums / self.n) @ np.where(has, self.components / np.sqrt(np.where(has, self.variances, 1)), 0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums over dimensions of (n x - sums) squared."""
        far = max(abs(self.n * int(e) - int(s)) for bound in (x.min(0), x.max(0)) for e, s in zip(bound, self.sums, strict=True)) if x.size else 0
        if x.shape[1] * far ** 2 < 1 << 63:
            return ((self.n * x - self.sums) ** 2).sum(1)
        exact = [sum((self.n * e - s) ** 2 for e, s in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return np.array(exact, np.int64)  # an error, not a wrong number, where one does not fit


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows (key, x) with entries floor(scale * c); rows whose vector is null or empty or holds null or non-finite entries are left out."""
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    good = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, finite))
    return good.select(key, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if x.size and (x.max() >= LARGEST or x.min() <= -LARGEST):
        raise OverflowError(f"a vector has an entry beyond {LARGEST} parts")
    return x


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column(column).slice(at, ROWS))


def _summed(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], zero: str) -> np.ndarray:
    """Sum over the table of what ``work`` gives for a matrix of rows: per task, then per cell, of which there are few."""
    kind = np.int64 if zero == "bigint" else np.float64

    def partial(batches):
        total = None
        for x in _matrices(batches):
            part = work(x).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(kind))], ["cell", "part"])

    rows = fit.mapInArrow(partial, f"cell bigint, part {zero}").groupBy("cell").agg(F.sum("part").alias("part")).orderBy("cell").collect()
    return np.array([r.part for r in rows], kind)


def _solve(r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Q with Q R = A for an upper triangle R, column by column."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _orthogonalise(fit: DataFrame, n: int, mean: np.ndarray, passes: int) -> np.ndarray:
    """R of the centred rows, from repeated Gram passes."""
    d, unit = len(mean), np.finfo(np.float64).eps / 2
    factors: list[np.ndarray] = []
    for nr in range(passes):
        solved = list(factors)

        def gram(x, solved=solved):
            q = x - mean
            for factor in solved:
                q = _solve(factor, q)
            return q.T @ q

        g = _summed(fit, gram, "double").reshape(d, d)
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        settled = np.abs(values - 1) < 1e-12
        if nr and (settled | (values < 1e-14)).all() or nr == passes - 1:
            # what is still off the identity (directions without variance) goes into a symmetric root
            factors.append(vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T)
            break
        shift = 11 * (n * d + d * (d + 1)) * unit * values[-1]
        if nr and values[0] > 4 * shift:
            shift = 0.0  # near enough to orthogonal
        elif shift <= 0:
            shift = 1.0  # all rows are the mean
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    out = np.eye(d)
    for factor in factors:
        out = factor @ out
    return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct vectors of rows (x), and these vectors; None where there are none.

    Vectors whose length is not the most frequent one (of equally frequent ones the greatest) are no part of it.
    The driver is given sums per dimension and per pair of dimensions.
    """
    fit = materialized(vectors.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d, n = lengths[0]
    fit = fit.where(F.size("x") == d)
    sums = _summed(fit, lambda x: x.sum(0), "bigint")
    mean = sums / n
    r = _orthogonalise(fit, n, mean, passes)
    _, sigma, rows = np.linalg.svd(r)
    variances = sigma ** 2 / n
    variances[variances <= NO_VARIANCE * variances[0]] = 0
    k, total = min(components, d), variances.sum()
    out = Whitening(n, sums, rows[:k].T.copy(), variances[:k], variances[:k] / total if total else np.zeros(k), 0.0)

    def moments(x):
        w = out.scores(x)
        return np.vstack([w.sum(0), w.T @ w])

    found = _summed(fit, moments, "double").reshape(k + 1, k) / n
    covariance = found[1:] - np.outer(found[0], found[0])
    has = out.variances > 0
    out.identity_error = float(np.abs(covariance - np.eye(k))[np.ix_(has, has)].max(initial=0))
    return out, fit


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per row of ``df`` with a finite vector and per component: key, component, n, deviation, whitened, explained, identity_error.

    Left out are rows whose vector is null or empty, holds null or non-finite entries or has another length than most.
    Repeated vectors count once for the fit and get the same scores; null and repeated keys stay rows of their own.
    Components are numbered by falling variance; equal variances share a plane, in which any two directions will do. A component
    without variance (fewer distinct vectors than components) has the score 0 and explains 0; ``identity_error`` is of those
    with variance. An empty table gives no rows, other columns are left out. A deviation beyond 63 bits
    or an entry beyond ``LARGEST`` parts is an error.
    """
    rows = whole_vectors(df, key, vector, scale)
    schema = f"{key} {rows.schema[0].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = fit_whitening(rows, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    sent = df.sparkSession.sparkContext.broadcast(fitted[0])

    def score(batches):
        model = sent.value
        k = len(model.variances)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"))
                rows = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)), pa.array(np.repeat(model.deviations(x), k)), pa.array(model.scores(x).ravel()),
                    pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, model.identity_error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == len(fitted[0].sums)).mapInArrow(score, schema)
