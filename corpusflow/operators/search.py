"""Exact nearest-neighbour search, fusion of several queries and reranking."""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions.text import tokens
from corpusflow.functions.vectors import relevance
from corpusflow.operators.ordering import first_rows, top_rows
from corpusflow.session import free_shuffles, materialized

TOP_K = 20
TOP_N = 5
# Bytes of query vectors that are sent to every task. Larger query tables are cut into blocks.
BROADCAST_BYTES = 64_000_000
# Rows of one block of queries or vectors in the blocked search, at most. Blocks of queries are as few as there are cores, but not
# smaller than the least: every block of queries gets every block of vectors that may hold a hit.
BLOCK_QUERIES = 65_536
LEAST_QUERIES = 4_096
BLOCK_VECTORS = 65_536
# Rows of blocks that are shuffled at once, at least; twice as many as the index has where that is more.
ROUND_ROWS = 8_000_000
# Vectors that serve as centres of cells in the blocked search: the root of their number, within these bounds.
CENTRES = (64, 1_024)
# Queries are searched once per distinct vector where that leaves out as large a share of them at least.
_EQUAL = 0.1
# Distances held at once by one task, and queries worked on at once.
_CELL = 1_000_000
_ROWS = 1_024
# Distances closer than this many digits are ties, ordered by id.
_DIGITS = 9
_TIE = 10.0 ** -_DIGITS


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.corpusflow.{name}", str(default)))


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as a dense double matrix; a row that is null or holds a null becomes NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    known = lengths[~np.isnan(lengths)] if column.null_count else lengths
    if len(known) == 0:
        return np.full((len(column), 0), np.nan)
    if (known != known[0]).any():
        raise ValueError(f"vectors of different lengths: {int(known.min())} and {int(known.max())}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, int(known[0]))
    if not column.null_count:
        return flat
    out = np.full((len(column), flat.shape[1]), np.nan)
    out[~np.isnan(lengths)] = flat
    return out


def _vectors(ids, column) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors; rows without a whole vector are nobody's neighbours and are left out."""
    ids, x = _ids(ids), _matrix(column)
    if x.shape[1] == 0:
        return ids[:0], np.zeros((0, 0))
    whole = ~np.isnan(x).any(1)
    return (ids, x) if whole.all() else (ids[whole], x[whole])


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d2 = q @ x.T
    d2 *= -2.0
    d2 += (q * q).sum(1)[:, None]
    d2 += (x * x).sum(1)[None, :]
    return np.maximum(d2, 0.0, out=d2)


class _Block:
    """Vectors that many queries are compared with; what the comparison needs of them is worked out once."""

    def __init__(self, x: np.ndarray):
        self.x, self.squares = x, (x * x).sum(1)
        self.longest = math.sqrt(self.squares.max(initial=0.0))

    @cached_property
    def single(self) -> np.ndarray:
        """Factors whose product with (query, 1, bound) is a distance less a bound, in single precision."""
        return np.concatenate([-2.0 * self.x, self.squares[:, None], np.ones((len(self.x), 1))], axis=1, dtype=np.float32, casting="same_kind")


def _block(x: np.ndarray | _Block) -> _Block:
    return x if isinstance(x, _Block) else _Block(x)


def _set_at(mask: np.ndarray) -> np.ndarray:
    """Places of a flat mask that are set, looked for eight at a time as they are few."""
    if len(mask) % 8:
        return np.flatnonzero(mask)
    at = (np.flatnonzero(mask.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[mask[at]]


def _near(q: np.ndarray, x: np.ndarray | _Block, edges: np.ndarray, first: int = 0):
    """``(rows, columns, d2)`` with ``d2 <= edges[row]``, tile by tile from column ``first``; edges that shrink meanwhile count from the next tile on.

    Products in single precision with their largest possible error sort out what is certainly too far; distances are worked out
    in double precision for the rest, and for whole tiles where little is sorted out or single precision does not reach.
    """
    block = _block(x)
    x, xx, qq = block.x, block.squares, (q * q).sum(1)
    most_q = np.sqrt(qq)
    rough = bool(qq.max(initial=0.0) < 1e30 and block.longest < 1e15)  # false for what is not finite as well
    step = max(1, _CELL // max(1, len(q)))
    if rough:
        widest = (most_q + block.longest) ** 2  # no distance is larger
        slack = (q.shape[1] + 9) * 2.0 ** -22 * widest + _TIE + 1e-30
        q32 = np.concatenate([q, np.ones((len(q), 1)), np.zeros((len(q), 1))], axis=1, dtype=np.float32, casting="same_kind")
        x32 = block.single
        tile = np.empty(len(q) * min(step, max(0, len(x) - first)), np.float32)
        mask = np.empty(len(tile), bool)
    for start in range(first, len(x), step):
        part = slice(start, start + step)
        bound = edges[:, None] + _TIE  # a little wide, as ties are settled on rounded distances
        if rough and np.isfinite(edges).all():
            width = len(xx[part])
            flat = tile[:len(q) * width]
            q32[:, -1] = qq - np.minimum(edges, widest) - slack
            np.matmul(q32, x32[part].T, out=flat.reshape(len(q), width))
            passed = _set_at(np.less_equal(flat, 0.0, out=mask[:len(flat)]))
            if len(passed) * 16 <= len(flat):
                rows, cols = np.divmod(passed, width)
                d = np.maximum(qq[rows] + xx[start + cols] - 2.0 * np.einsum("ij,ij->i", q[rows], x[start + cols]), 0.0)
                close = d <= bound[rows, 0]
                yield rows[close], start + cols[close], d[close]
                continue
        d = _distances(q, x[part])
        rows, cols = np.nonzero(d <= bound)
        yield rows, start + cols, d[rows, cols]


class _Best:
    """The k nearest (query, id, distance) seen so far by one task.

    What is found waits until it is as much as is kept, or twice as many vectors have been seen, and is then sorted in.
    """

    def __init__(self, k: int, edge: np.ndarray | None = None):
        self.k = k
        self._kept = None
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._seen = self._settled = 0
        self.edge = edge  # distance of the k-th hit of each query so far

    def add(self, q: np.ndarray, x: np.ndarray | _Block, ids: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """``wanted(rows, columns)`` says which pairs count; it needs bounds given beforehand."""
        if self.edge is None:
            self.edge = np.full(len(q), np.inf)
        if len(q) == 0:
            return
        block, start = _block(x), 0
        if np.isinf(self.edge).any() and len(ids):
            # the first tile bounds what follows
            start = min(len(ids), max(1, _CELL // len(q)))
            d = _distances(q, block.x[:start])
            k = min(self.k, start)
            rows, cols = np.nonzero(d <= np.minimum(self.edge, np.partition(d, k - 1, axis=1)[:, k - 1])[:, None] + _TIE)
            self._take(rows, ids[:start][cols], d[rows, cols], start, len(q))
        for rows, cols, d in _near(q, block, self.edge, start):
            if wanted is not None:
                counts = wanted(rows, cols)
                rows, cols, d = rows[counts], cols[counts], d[counts]
            self._take(rows, ids[cols], d, max(1, _CELL // len(q)), len(q))

    def _take(self, rows, ids, d, seen: int, queries: int) -> None:
        self._seen += seen
        if len(rows):
            self._waiting.append((rows, ids, d))
        waiting = sum(len(w[0]) for w in self._waiting)
        if waiting and (self._seen >= 2 * self._settled or waiting > self.k * queries or np.isinf(self.edge).any()):
            self._settle()

    def _settle(self) -> None:
        self._settled = self._seen
        if not self._waiting:
            return
        rows, ids, d = (np.concatenate(c) for c in zip(*([self._kept] if self._kept else []), *self._waiting))
        self._waiting = []
        near = np.round(d, _DIGITS)
        order = np.lexsort((near, rows))
        rows, ids, d, near = rows[order], ids[order], d[order], near[order]
        tie = (rows[1:] == rows[:-1]) & (near[1:] == near[:-1])
        if tie.any():
            # equal distances stand by their ids
            run = np.cumsum(np.concatenate([[True], ~tie]))
            at = np.flatnonzero(np.concatenate([[False], tie]) | np.concatenate([tie, [False]]))
            by_id = at[np.lexsort((ids[at], run[at]))]
            ids[at], d[at] = ids[by_id], d[by_id]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        self._kept = rows[keep], ids[keep], d[keep]
        full = np.flatnonzero(place == self.k - 1)
        self.edge[rows[full]] = near[full]

    def _column(self, i: int):
        self._settle()
        return self._kept[i] if self._kept else None

    q = property(lambda self: self._column(0))
    ids = property(lambda self: self._column(1))
    d = property(lambda self: self._column(2))

    def batch(self, qids, schema) -> pa.RecordBatch | None:
        if self.q is None:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(qids[self.q], schema.field(0).type), pa.array(self.ids, schema.field(1).type),
             pa.array(self.d, pa.float64())], schema=schema)


def _slices(n: int) -> list[slice]:
    return [slice(at, at + _ROWS) for at in range(0, n, _ROWS)]


class _Within:
    """All (query, id, distance) inside a radius, batch by batch."""

    def __init__(self, d2_max: float):
        self.d2_max = d2_max

    def pairs(self, q, x, ids, qids, schema):
        x = _block(x)
        for some in _slices(len(q)):
            for rows, cols, d in _near(q[some], x, np.full(len(q[some]), self.d2_max)):
                inside = d <= self.d2_max
                rows, cols, d = rows[inside], cols[inside], d[inside]
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qids[some][rows], schema.field(0).type), pa.array(ids[cols], schema.field(1).type),
                         pa.array(d, pa.float64())], schema=schema)


def _arrow_schema(qid_type, id_type) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("qid", to_arrow_type(qid_type)), ("id", to_arrow_type(id_type)), ("d2", pa.float64())])


def _pairs(index: DataFrame, queries: DataFrame, k: int | None, d2_max: float | None,
           broadcast_queries: int | None = None) -> DataFrame:
    """Candidate pairs ``(qid, id, d2)``: per task the k nearest, or all within the radius. ``queries`` is a table that was written."""
    schema = _arrow_schema(queries.schema["qid"].dataType, index.schema["id"].dataType)
    ddl = (f"qid {queries.schema['qid'].dataType.simpleString()}, "
           f"id {index.schema['id'].dataType.simpleString()}, d2 double")
    n_queries, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if broadcast_queries is None:
        broadcast_queries = _setting(queries, "broadcastQueries", BROADCAST_BYTES // (8 * max(width, 1)))
    if n_queries <= broadcast_queries:
        return _scan_with_broadcast(index, queries.toArrow(), k, d2_max, schema, ddl)
    return _scan_in_blocks(index, queries, n_queries, k, d2_max, schema, ddl)


def _scan_with_broadcast(index, table, k, d2_max, schema, ddl):
    """Few queries: every task scans its part of the index against all of them."""
    shared = index.sparkSession.sparkContext.broadcast(_vectors(table["qid"], table["vec"]))

    def scan(batches):
        qids, q = shared.value
        parts = _slices(len(q))
        best = [_Best(k) for _ in parts] if k else None
        for batch in batches:
            if batch.num_rows == 0 or len(q) == 0:
                continue
            ids, x = _vectors(batch.column("id"), batch.column("vec"))
            if len(ids) == 0:
                continue
            if best:
                block = _Block(x)
                for part, nearest in zip(parts, best):
                    nearest.add(q[part], block, ids)
            else:
                yield from _Within(d2_max).pairs(q, x, ids, qids, schema)
        for part, nearest in zip(parts, best or []):
            out = nearest.batch(qids[part], schema)
            if out is not None:
                yield out

    return index.select("id", "vec").mapInArrow(scan, ddl)


def _placed(df: DataFrame, key: str, centres: np.ndarray, extra: str = "", more=None) -> DataFrame:
    """Rows with a whole vector, their nearest centre and the distance to it; ``more(distances)`` adds columns ``extra``."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    key_type, vec_type = (df.schema[c].dataType.simpleString() for c in (key, "vec"))
    names = [key, "vec", "cell", "away", *[x.split()[0] for x in extra.split(", ") if x]]

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            whole = np.flatnonzero(~np.isnan(x).any(1)) if x.shape[1] else np.zeros(0, int)
            step = max(1, _CELL // len(shared.value))
            for at in range(0, len(whole), step):
                rows = whole[at:at + step]
                away = np.sqrt(_distances(x[rows], shared.value))
                cell = away.argmin(1)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), *(more(away) if more else [])], names)

    ddl = f"{key} {key_type}, vec {vec_type}, cell int, away double" + (f", {extra}" if extra else "")
    return materialized(df.select(key, "vec").mapInArrow(place, ddl), "cells")


class Cells(NamedTuple):
    """Vectors around centres, stored: made once, searched as often as wanted."""
    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def store_cells(index: DataFrame, id_col: str = "id", vec_col: str = "vec", centres: int | None = None) -> Cells | None:
    """The cells of an index (null: no vectors): centres are some of the vectors, in number like the root of all within ``CENTRES``."""
    index = index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    if centres is None:
        centres = _setting(index, "centres", 0) or min(max(math.isqrt(index.count()), CENTRES[0]), CENTRES[1])
    some = index.where(F.col("vec").isNotNull()).orderBy(F.xxhash64("id")).limit(centres).toArrow()
    _, points = _vectors(some["id"], some["vec"])
    if len(points) == 0:
        return None
    vectors = _placed(index, "id", points)
    sizes, radii = np.zeros(len(points), np.int64), np.zeros(len(points))
    for r in vectors.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        sizes[r.cell], radii[r.cell] = r.n, r.radius
    return Cells(vectors, points, sizes, radii)


def _met(left: DataFrame, right: DataFrame, pairs: DataFrame, blocks: int, work, ddl: str) -> DataFrame:
    """``work`` on blocks of both sides (columns qc and xc name their cells, or packs of cells) that ``pairs (qc, xc, qn, xn)`` let meet."""
    def block(col: str, count: str) -> Column:
        return F.pmod(F.xxhash64(col), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # the partition count is given, as little data means much work here
    on = ["qc", "qb", "xc", "xb"]
    cell = [c for c in ("cell",) if c in left.columns]
    left = (left.join(pairs, "qc").withColumn("qb", block("qid", "qn")).withColumn("xb", every("xn"))
            .select("qid", "vec", "reach", *cell, *on).repartition(blocks, *on))
    right = (right.join(pairs, "xc").withColumn("xb", block("id", "xn")).withColumn("qb", every("qn")).select("id", "vec", *cell, *on).repartition(blocks, *on))
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(work, ddl)


def _packs(sizes: np.ndarray, most: int, order: np.ndarray) -> np.ndarray:
    """The pack of each cell: cells that follow each other in ``order`` share one as long as it has at most ``most`` rows."""
    out, pack, filled = np.zeros(len(sizes), np.int64), 0, 0
    for cell in order:
        if filled and filled + sizes[cell] > most:
            pack, filled = pack + 1, 0
        out[cell] = pack
        filled += sizes[cell]
    return out


def _scan_in_blocks(index, queries, n_queries, k, d2_max, schema, ddl):
    """Many queries: both sides lie in cells around some of the vectors, and only cells that
    can hold a hit are compared. By the triangle inequality a query finds nothing in a cell whose border is farther off
    than its bound. That is the radius or, for the k nearest, the k-th distance in the query's own cell, which is
    found first and carried along, so that other cells hand over little that is not among the nearest.
    Neighbouring cells travel in packs, so a row is shuffled once per pack of the other side, not once per cell.
    Cells too large for a pack are cut into blocks of bounded size by the unique ids; nothing passes through the driver but
    the centres and one row per cell."""
    spark = index.sparkSession
    cells = store_cells(index) if n_queries else None
    return _search_cells(cells, queries, k, d2_max, schema, ddl) if cells else spark.createDataFrame([], ddl)


def _search_cells(cells: Cells, queries, k, d2_max, schema, ddl, most_x: int = BLOCK_VECTORS, most_q: int = BLOCK_QUERIES):
    spark = queries.sparkSession
    centres, sizes, radii = cells.centres, cells.sizes, cells.radii

    def reach(away: np.ndarray) -> list:
        """A first bound: the distance within which cells certain to be near hold k vectors."""
        if not k:
            return [pa.array(np.full(len(away), math.sqrt(d2_max)))]
        farthest = np.where(sizes > 0, away + radii, np.inf)
        order = farthest.argsort(1)
        enough = (np.cumsum(sizes[order], 1) >= k).argmax(1)
        bound = np.take_along_axis(farthest, order, 1)[np.arange(len(away)), enough]
        return [pa.array(np.where(sizes.sum() >= k, bound, np.inf))]

    asked = _placed(queries, "qid", centres, "reach double", reach)
    between = np.sqrt(_distances(centres, centres))
    block_x = _setting(queries, "blockVectors", most_x)
    cores = spark.sparkContext.defaultParallelism
    most = 16 * cores

    def cells_near(asked: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        """Which cells of vectors may hold hits of the queries of a cell, the number of those queries, and the size of their blocks."""
        near, n = np.zeros((len(sizes), len(sizes)), bool), np.zeros(len(sizes), np.int64)
        for g in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("reach").alias("reach")).collect():
            n[g.cell] = g.n
            # a hair wider than the inequality, for rounding
            near[g.cell] = (sizes > 0) & (between[g.cell] - g.radius - radii <= g.reach + 1e-6)
        least = min(most_q, max(LEAST_QUERIES, math.ceil(int(n.sum()) / cores)))
        return near, n, _setting(queries, "blockQueries", least)

    def paired(near: np.ndarray, q_packs: np.ndarray, x_packs: np.ndarray, n: np.ndarray, block_q: int) -> list[tuple[int, int, int, int, int]]:
        """Pairs of packs that have cells near each other, with the number of blocks of either and the rows that are shuffled for them."""
        at = np.argwhere(near)
        pairs = np.unique(np.stack([q_packs[at[:, 0]], x_packs[at[:, 1]]], 1), axis=0)
        q_rows, x_rows = (np.bincount(packs, rows) for packs, rows in ((q_packs, n), (x_packs, sizes)))
        blocks = [(int(i), int(j), math.ceil(q_rows[i] / block_q), math.ceil(x_rows[j] / block_x)) for i, j in pairs]
        return [(i, j, qn, xn, int(q_rows[i] * xn + x_rows[j] * qn)) for i, j, qn, xn in blocks]

    def met(left: DataFrame, right: DataFrame, pairs: list[tuple[int, int, int, int, int]], work) -> DataFrame:
        tasks = min(sum(q * x for _, _, q, x, _ in pairs) or 1, most)
        return _met(left, right, F.broadcast(spark.createDataFrame([p[:4] for p in pairs], "qc int, xc int, qn int, xn int")), tasks, work, ddl)

    def packed(df: DataFrame, packs: np.ndarray, name: str) -> DataFrame:
        table = spark.createDataFrame(list(enumerate(packs.tolist())), f"cell int, {name} int")
        return df.join(F.broadcast(table), "cell")

    def in_packs(near: np.ndarray, done: np.ndarray | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """Hits in cells ``near`` those of the queries, without pairs of cells that are ``done``."""
        shared = spark.sparkContext.broadcast((near, done))

        def hits(q_table: pa.Table, x_table: pa.Table) -> pa.Table:
            if q_table.num_rows == 0 or x_table.num_rows == 0:
                return schema.empty_table()
            near, done = shared.value
            qids, q, q_cells, bounds = _ids(q_table["qid"]), _matrix(q_table["vec"]), q_table["cell"].to_numpy(), q_table["reach"].to_numpy()
            ids, x, x_cells = _ids(x_table["id"]), _matrix(x_table["vec"]), x_table["cell"].to_numpy()
            found, whole = [], _Block(x)
            kinds, kind = np.unique(q_cells, return_inverse=True)
            there = near[kinds][:, x_cells]
            # where nearly all vectors are near, they are compared as they lie, with the queries of all such cells at once
            most_there = there.mean(1) >= 0.9 if not k or done is not None and np.isfinite(bounds).all() else there.all(1) & (done is None)
            groups = [(np.flatnonzero(most_there[kind]), None)] + [(np.flatnonzero(kind == i), np.flatnonzero(there[i])) for i in np.flatnonzero(~most_there)]
            for rows, some in groups:
                if len(rows) == 0 or some is not None and len(some) == 0:
                    continue
                block, some_ids, some_cells = (whole, ids, x_cells) if some is None else (_Block(x[some]), ids[some], x_cells[some])
                if not k:
                    found += _Within(d2_max).pairs(q[rows], block, some_ids, qids[rows], schema)
                    continue
                for part in _slices(len(rows)):
                    these = rows[part]
                    # at home a bound is found in the first tile, which is tighter than what the cells' borders give
                    best = _Best(k, None if done is None else np.round(bounds[these] ** 2 + _TIE, _DIGITS))
                    wanted = None if done is None or some is not None else lambda i, j, cells=q_cells[these]: ~done[cells[i], some_cells[j]]
                    best.add(q[these], block, some_ids, wanted)
                    batch = best.batch(qids[these], schema)
                    found += [batch] if batch is not None else []
            return pa.Table.from_batches(found, schema)

        return hits

    # cells along the direction in which the centres differ most, so that those of a pack lie near each other
    along = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    order = np.argsort(centres @ along, kind="stable")
    x_packs = _packs(sizes, block_x, order)
    vectors = cells.vectors.select("id", "vec", "cell")

    def meet_in_packs(asked: DataFrame, near: np.ndarray, n: np.ndarray, block_q: int, done: np.ndarray | None = None) -> DataFrame:
        """All packs with those near them; what is shuffled at once is bounded, and goes when its hits are written."""
        q_packs = _packs(n, block_q, order)
        work = in_packs(near, done)
        pairs = paired(near, q_packs, x_packs, n, block_q)
        shuffled = np.cumsum([p[4] for p in pairs])
        total = int(shuffled[-1]) if pairs else 0
        count = math.ceil(total / _setting(queries, "roundRows", max(ROUND_ROWS, 2 * int(sizes.sum())))) or 1
        # rounds of about as many rows each
        rounds = [[p for p, at in zip(pairs, shuffled) if (at - 1) * count // total == i] for i in range(count)] if count > 1 else [pairs]

        def meet(pairs: list) -> DataFrame:
            return met(packed(asked.select("qid", "vec", "reach", "cell"), q_packs, "qc"), packed(vectors, x_packs, "xc"), pairs, work)

        if len(rounds) == 1:
            return meet(rounds[0])
        found = []
        for some in filter(None, rounds):
            hits = meet(some)
            found.append(materialized(top_rows(hits, ["qid"], [F.round("d2", _DIGITS), F.col("id")], k).drop("rank") if k else hits, "found"))
            del hits
            free_shuffles(spark)
        return reduce(DataFrame.unionByName, found)

    near, n, block_q = cells_near(asked)
    if not k:
        return meet_in_packs(asked, near, n, block_q)
    # a query's home is its cell and others near that one, many enough vectors for a bound that little else keeps
    home = _distances(centres, centres[:CENTRES[0]]).argmin(1)
    itself = home[:, None] == home[None, :]
    homes = met(packed(asked.select("qid", "vec", "reach", "cell"), home, "qc"), packed(vectors, home, "xc"), paired(near & itself, home, home, n, block_q), in_packs(itself))
    own = materialized(top_rows(homes, ["qid"], [F.round("d2", _DIGITS), F.col("id")], k), "own")
    del homes
    free_shuffles(spark)  # both shuffle all vectors; one at a time
    kth = own.where(F.col("rank") == k).select("qid", F.sqrt("d2").alias("_kth"))
    asked = materialized(asked.join(kth, "qid", "left").withColumn("reach", F.least("reach", F.coalesce("_kth", F.lit(float("inf"))))).drop("_kth"), "bounds")
    near, n, block_q = cells_near(asked)
    return own.drop("rank").unionByName(meet_in_packs(asked, near & ~itself, n, block_q, itself))


def search(index: DataFrame, queries: DataFrame, k: int = TOP_K, *, id_col: str = "chunk_id",
           vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec",
           broadcast_queries: int | None = None) -> DataFrame:
    """Exact top-k: ``(qid, id, d2, rank)`` by squared distance, ties by id.

    Ids must be unique on both sides. Each task hands over at most k candidates per query. Up
    to ``broadcast_queries`` queries are sent to every task; more are worked on in blocks.
    Queries of equal vectors are searched once.
    """
    asked = materialized(queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("vec")), "queries")  # worked out once, their size known
    vectors = index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    nearest = [F.round("d2", _DIGITS), F.col("id")]
    rows, distinct = asked.where(F.col("vec").isNotNull()).agg(F.count("*"), F.count_distinct(F.xxhash64("vec"))).first()
    if distinct <= (1 - _EQUAL) * rows:
        classes, members = _query_classes(asked)
        found = materialized(top_rows(_pairs(vectors, classes, k, None, broadcast_queries), ["qid"], nearest, k).drop("rank"), "found")
        free_shuffles(found.sparkSession)
        pairs = found.withColumnRenamed("qid", "_class").join(members, "_class").drop("_class")
    else:
        pairs = _pairs(vectors, asked, k, None, broadcast_queries)
    ranked = top_rows(pairs, ["qid"], nearest, k)
    return ranked.select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "d2", "rank")


def _query_classes(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors ``(qid, vec)`` under numbers of their own, and ``(_class, qid)`` for every query."""
    hashed = asked.where(F.col("vec").isNotNull()).withColumn("_h", F.xxhash64("vec"))
    classes = materialized(hashed.select("_h", "vec").distinct().withColumn("_class", F.monotonically_increasing_id()), "classes")
    members = materialized(hashed.join(classes, ["_h", "vec"]).select("_class", "qid"), "members")
    return classes.select(F.col("_class").alias("qid"), "vec"), members


def within_radius(index: DataFrame, queries: DataFrame, d2_max: float, *, id_col: str = "chunk_id",
                  vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec") -> DataFrame:
    """Similarity join: all ``(qid, id, d2)`` with squared distance of at most ``d2_max``."""
    asked = materialized(queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("vec")), "queries")
    pairs = _pairs(index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), asked, None, d2_max)
    return pairs.select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "d2")


def threshold(hits: DataFrame, minimum: float) -> DataFrame:
    """Hits of sufficient relevance; applied to ranked hits, after the limit."""
    return hits.where(relevance(F.col("d2")) >= minimum)


def memory_search(index: DataFrame, queries: DataFrame, limit: int = 3, minimum: float = 0.35, **cols) -> DataFrame:
    return threshold(search(index, queries, limit, **cols), minimum)


def unique_first(hits: DataFrame, group: str, key: str, order: list[str], rank: str = "rank") -> DataFrame:
    """Keep the first occurrence of each key per group and rank what is left anew.

    Hits are ranked lists already, so a group has at most (queries x k) rows.
    """
    kept = first_rows(hits, [group, key], order)
    window = Window.partitionBy(group).orderBy(*order)
    place = F.row_number().over(window)
    return kept.withColumn("_place", place).drop(rank).withColumnRenamed("_place", rank)


def explode_queries(questions: DataFrame, col: str = "search_queries") -> DataFrame:
    """One row per search query of a question, with its position."""
    return questions.select("*", F.posexplode(col).alias("query_pos", "query")).drop(col)


def merge_positions(target: DataFrame, source: DataFrame, pos: str = "pos") -> DataFrame:
    """Append ``source`` behind ``target``: its positions move up by the largest one + 1."""
    offset = target.agg(F.coalesce(F.max(pos), F.lit(-1)) + 1).scalar()
    return target.unionByName(source.withColumn(pos, F.col(pos) + offset))


def merge_indexes(target: DataFrame, source: DataFrame, id_col: str = "doc_id", pos: str = "pos"):
    """``(vectors, documents)``: all vectors of both, each document once, the target's first."""
    vectors = merge_positions(target, source, pos)
    return vectors, first_rows(vectors, [id_col], [pos])


def search_merged(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, *, id_col: str = "doc_id", pos: str = "pos",
                  dedupe_first: bool = False, **cols) -> DataFrame:
    """Search a merged index, whose copies of a document each hold a place among the k nearest
    and are collapsed after that, or before with ``dedupe_first``."""
    rows = first_rows(vectors, [id_col], [pos]) if dedupe_first else vectors
    hits = search(rows, queries, k, id_col=pos, **cols)
    qid = cols.get("qid_col", "qid")
    return unique_first(hits.join(rows.select(pos, id_col), pos), qid, id_col, ["rank"])


class Scorer(NamedTuple):
    """How a reranker rates a pair: ``prepare`` is worked out once per text, ``score`` per pair."""

    score: Callable[[Column, Column], Column]
    prepare: Callable[[Column], Column] = lambda text: text


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def set_cosine(q: Column, p: Column) -> Column:
    size = F.size(q).cast("double") * F.size(p).cast("double")
    return F.when(size > 0, F.size(F.array_intersect(q, p)) / F.sqrt(size)).otherwise(0.0)


# cosine of the word sets of query and passage
OVERLAP = Scorer(set_cosine, word_set)


def model_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Scorer:
    """A reranking model as a batch function of queries and passages."""
    return Scorer(F.pandas_udf(score, "double"))


def bm25_scores(pairs: DataFrame, passages: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(qid, chunk_id, score)`` for ``pairs(qid, chunk_id, query)``.

    Document frequencies and the mean length come from all of ``passages(chunk_id, passage)``;
    only words of the queries are counted, and only passages of the pairs word by word. A pair
    without a common word scores 0.
    """
    asked = pairs.select("qid", "chunk_id", F.explode(word_set(F.col("query"))).alias("word"))
    lexicon = asked.select("word").distinct()
    # one pass: a passage counts under each of its words, and under no word for number and length of all
    counted = materialized(
        passages.select(tokens(F.col("passage")).alias("words"))
        .select(F.size("words").alias("len"), F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("word"))
        .join(lexicon.unionByName(passages.sparkSession.range(1).select(F.lit("").alias("word"))), "word", "left_semi")
        .groupBy("word").agg(F.count("*").alias("df"), F.sum("len").alias("len")), "lexicon")
    n, avg_len = (counted.where("word = ''").agg(F.max(x)).scalar() for x in ("df", F.expr("len / df")))
    df = counted.select("word", "df")
    rated = passages.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", tokens(F.col("passage")).alias("words"))
    tf = (rated.select("chunk_id", F.size("words").alias("len"), F.explode("words").alias("word"))
          .groupBy("chunk_id", "word").agg(F.count("*").alias("tf"), F.first("len").alias("len")))
    scored = asked.join(tf, ["chunk_id", "word"]).join(df, "word").select(
        "qid", "chunk_id",
        (F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1)
         / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))).alias("term_score"))
    total = scored.groupBy("qid", "chunk_id").agg(F.sum("term_score").alias("score"))
    return (pairs.select("qid", "chunk_id").join(total, ["qid", "chunk_id"], "left")
            .withColumn("score", F.coalesce("score", F.lit(0.0))))


def attach_scores(hits: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Put a reranker's answer, which names hits by position, back on the hits."""
    return hits.join(scores, keys)


def rerank(hits: DataFrame, scorer: Scorer = OVERLAP, top_n: int = TOP_N, *, qid: str = "qid", query: str = "query",
           passage: str = "passage", rank: str = "rank", prepared: tuple[str, str] | None = None) -> DataFrame:
    """Order the hits of a query by ``scorer`` instead of distance and keep ``top_n``.

    Equal scores keep their former order. ``prepared`` names the columns that hold prepared
    queries and passages where a caller has worked them out before joining.
    """
    if prepared is None:
        rating = scorer.score(scorer.prepare(F.col(query)), scorer.prepare(F.col(passage)))
    else:
        rating = scorer.score(F.col(prepared[0]), F.col(prepared[1]))
    scored = hits.withColumn("relevance_score", rating).drop(*(prepared or ()))
    ranked = top_rows(scored, [qid], [F.round("relevance_score", _DIGITS).desc(), F.col(rank)], top_n, "_place")
    return ranked.drop(rank).withColumnRenamed("_place", rank)
