"""Similarity join: all pairs of vectors within a radius, by the buckets of random-projection tables.

A table cuts space by random hyperplanes, level by level, where half of a bounded sample of the index lies on
either side, so buckets hold about as many vectors each however dense they lie. A bucket is a ball around the mean of its
sample as wide as its vectors need. Buckets whose ball lies farther off than the radius are ruled out by the
triangle inequality; with what is left everything is compared, so no pair is missing, which ``recall`` shows
against the exact join.
"""
from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusflow.operators.search import Cells, _arrow_schema, _matrix, _search_cells, _vectors
from corpusflow.session import materialized

TABLES, PROBES = 8, 6
#: Vectors of the index that a bucket is meant to hold, how many vectors and queries meet in one task at most, and levels of the table that is joined by.
LEAF, BLOCK_VECTORS, BLOCK_QUERIES, LEVELS = 512, 65_536, 32_768, 10
#: Bytes of vectors that tables are fitted on, and vectors of that sample in a bucket at least.
SAMPLE_BYTES, SAMPLE_LEAF = 32_000_000, 4


class Tables(NamedTuple):
    """Planes (width, table, level) and, per table, the offsets of a full binary tree of cuts, node i above 2i+1 and 2i+2."""
    planes: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return self.planes.shape[2]

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Buckets (row, table, 1 + probes): the own one first, then those across the planes that lie nearest; -1 where there is none."""
        rows, (_, tables, depth) = len(x), self.planes.shape
        side = (x @ self.planes.reshape(len(self.planes), -1)).reshape(rows, tables, depth)
        tab = np.arange(tables)[None, :]

        def descend(node: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """From nodes at levels down to the buckets, and how far off each cut was."""
            margins = np.full((rows, tables, depth), np.inf)
            for at in range(depth):
                go = level <= at
                off = side[:, :, at] - self.cuts[tab, np.where(go, node, 0)]
                margins[:, :, at] = np.where(go, np.abs(off), np.inf)
                node = np.where(go, 2 * node + 1 + (off > 0), node)
            return node, margins

        own, margins = descend(np.zeros((rows, tables), np.int64), np.zeros((rows, tables), np.int64))
        out = [own]
        for level in np.argsort(margins, axis=2)[:, :, :min(probes, depth)].transpose(2, 0, 1):
            # the path's node below that level is an ancestor of the bucket; its sibling lies across the cut
            child = ((own + 1) >> (depth - 1 - level)) - 1
            out.append(descend(np.where(child % 2 == 1, child + 1, child - 1), level + 1)[0])
        return np.stack(out, 2) - (2 ** depth - 1)


def fit_tables(index: DataFrame, n: int, width: int, tables: int = TABLES, leaf: int = LEAF, seed: int = 7) -> Tables:
    """Tables for ``n`` vectors, their cuts from a sample of at most ``SAMPLE_BYTES``."""
    return _fitted(_sample(index, n, width), n, width, tables, leaf, seed)


def _sample(index: DataFrame, n: int, width: int) -> np.ndarray:
    some = index.orderBy(F.xxhash64("id")).limit(min(n, SAMPLE_BYTES // (8 * width))).toArrow()
    return _vectors(some["id"], some["vec"])[1]


def _fitted(x: np.ndarray, n: int, width: int, tables: int, leaf: int, seed: int = 7) -> Tables:
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / leaf)), int(math.log2(max(len(x), 1) / SAMPLE_LEAF))))
    planes = np.random.default_rng(seed).normal(size=(width, tables, depth))
    side = np.einsum("nw,wtd->tdn", x, planes)
    cuts = np.zeros((tables, max(1, 2 ** depth - 1)))
    for t in range(tables):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            order = np.lexsort((side[t, level], node))
            names, first, sizes = np.unique(node[order], return_index=True, return_counts=True)
            # between two vectors of the sample, so that rounding does not decide on a side
            middle = first + (sizes - 1) // 2
            cuts[t, names] = (side[t, level][order][middle] + side[t, level][order][np.minimum(middle + 1, first + sizes - 1)]) / 2
            node = 2 * node + 1 + (side[t, level] > cuts[t, node])
    return Tables(planes, cuts)


def _balls(x: np.ndarray, tables: Tables) -> tuple[Tables, np.ndarray]:
    """The table whose buckets lie closest around the means of their vectors, and these means."""
    own, size = tables.buckets(x, 0)[:, :, 0], 2 ** tables.depth
    means, spread = [], []
    for cells in own.T:
        sums = np.stack([np.bincount(cells, column, size) for column in x.T], 1)
        means.append(sums / np.maximum(np.bincount(cells, minlength=size), 1)[:, None])
        spread.append(((x - means[-1][cells]) ** 2).sum())
    t = int(np.argmin(spread))
    return Tables(tables.planes[:, t:t + 1], tables.cuts[t:t + 1]), means[t]


def _bucketed(df: DataFrame, key: str, table: Tables, means: np.ndarray) -> DataFrame:
    """Rows (key, vec, cell, away): the bucket of a vector and how far it lies from the bucket's mean."""
    shared = df.sparkSession.sparkContext.broadcast((table, means))
    types = [df.schema[c].dataType.simpleString() for c in (key, "vec")]

    def place(batches):
        for batch in batches:
            table, means = shared.value
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x = _matrix(part.column(1))
                cells = table.buckets(x, 0)[:, 0, 0]
                away = np.sqrt(((x - means[cells]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells.astype(np.int32)), pa.array(away)], [key, "vec", "cell", "away"])

    return materialized(df.select(key, "vec").mapInArrow(place, f"{key} {types[0]}, vec {types[1]}, cell int, away double"), "buckets")


def _classes(df: DataFrame, key: str, vec: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Each distinct whole vector once, under its least id, and ``(member, representative)`` of all rows."""
    rows = materialized(df.select(F.col(key).alias(name), F.col(vec).alias("vec"), F.xxhash64(vec).alias("_h"))
                        .where(F.col("vec").isNotNull() & ~F.exists("vec", lambda c: c.isNull() | F.isnan(c))), "vectors")
    firsts = materialized(rows.groupBy("_h", "vec").agg(F.min(name).alias("_first")), "classes")
    members = rows.join(firsts, ["_h", "vec"]).select(F.col(name).alias("member"), F.col("_first").alias("representative"))
    return firsts.select(F.col("_first").alias(name), "vec"), members


def similarity_join(index: DataFrame, queries: DataFrame, d2_max: float, *, id_col: str = "chunk_id", vec_col: str = "embedding",
                    qid_col: str = "qid", qvec_col: str = "qvec", tables: int = TABLES, probes: int = PROBES, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs, members, asked)``: pairs (qid, id, d2) of squared distance up to ``d2_max`` between representatives of equal vectors.

    ``members`` and ``asked`` name each row's representative (member, representative) on either side; ids must be unique. Rows
    without a whole vector are in none of them. Of ``tables`` tables the one with the closest buckets is joined by; a query looks into
    every bucket that may hold a pair, whatever ``probes`` says, which callers may still give. Buckets travel in packs and crowded
    ones in blocks; nothing is capped.
    """
    vectors, members = _classes(index, id_col, vec_col, "id")
    asked, askers = _classes(queries, qid_col, qvec_col, "qid")
    schema = _arrow_schema(asked.schema["qid"].dataType, vectors.schema["id"].dataType)
    ddl = ", ".join(f"{n} {k.dataType.simpleString()}" for n, k in (("qid", asked.schema["qid"]), ("id", vectors.schema["id"]))) + ", d2 double"
    n, width = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return index.sparkSession.createDataFrame([], ddl), members, askers
    sample = _sample(vectors, n, width)
    table, means = _balls(sample, _fitted(sample, n, width, tables, max(leaf, math.ceil(n / 2 ** LEVELS))))
    placed = _bucketed(vectors, "id", table, means)
    sizes, radii = np.zeros(len(means), np.int64), np.zeros(len(means))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        sizes[r.cell], radii[r.cell] = r.n, r.radius
    pairs = _search_cells(Cells(placed, means, sizes, radii), asked, None, d2_max, schema, ddl, BLOCK_VECTORS, BLOCK_QUERIES)
    return pairs.groupBy("qid", "id").agg(F.min("d2").alias("d2")), members, askers


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact pairs (qid, id) that were found."""
    both = exact.select("qid", "id").join(found.select("qid", "id").withColumn("_f", F.lit(1)), ["qid", "id"], "left")
    have, want = both.agg(F.count("_f"), F.count("*")).first()
    return have / want if want else 1.0
