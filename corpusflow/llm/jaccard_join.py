"""Exact n-gram Jaccard join: metric-space join with pivots, Voronoi regions and triangle-inequality windows.

Documents are sets of word shingles under the Jaccard distance. Almost all pairs of a corpus are at
distance 1, where a pivot tells nothing, so documents are first parted into *clusters* that no link
crosses: the shingles fall into m classes by hash; two linked sets differ in at most d of them, so they
agree on m - d whole classes. A set that shares fewer classes with any others has no link and is left
out; the rest that agree on a class are put into one cluster. Inside a cluster distances are informative. There pivots are chosen, every set goes to the region of its nearest pivot and
into those windows where d(x, pivot) <= d(x, nearest) + 2r, which by the triangle inequality brings
every linked pair together in a region; regions are joined in the same way again. A cluster too large for
one task is parted once more, by its rarest shingles; what still is too large is split into regions as a Spark
job, what fits is worked through in its task.
"""
from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.arrays import WORD, Texts, combine, mix, prefixes, slices, span_hashes
from corpusflow.llm.components import components
from corpusflow.llm.workers import begin, give_back
from corpusflow.session import drop_scratch, free_shuffles, materialized, scratch_path

WIDTH, PERCENT = 4, 85
#: Bytes of shingles one task joins at a time.
REGION_BYTES = 8_000_000
PIVOTS = 8
#: Ids of dropped documents that are sent to every task.
BROADCAST_IDS = 1_000_000
#: Rows of windows that a worker hands over at a time.
HANDED_OVER = 128
#: Sets that are compared pair by pair.
LEAF = 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order: offsets and values."""
    texts = Texts(column)
    prefix = prefixes(_LOWER[texts.data])
    starts, ends, doc = texts.spans(WORD[texts.data])
    word = span_hashes(prefix, starts, ends)
    counts = np.bincount(doc, minlength=texts.n)
    at = np.flatnonzero(doc[width - 1:] == doc[:len(doc) - width + 1]) if len(doc) >= width else np.zeros(0, np.int64)
    values, owner = combine(*(word[at + i] for i in range(width))), doc[at]
    first = np.concatenate([[0], np.cumsum(counts)])
    for n in range(1, width):  # texts of fewer words: the whole sequence
        few = np.flatnonzero(counts == n)
        if len(few):
            values = np.concatenate([values, combine(np.full(len(few), n), *(word[first[few] + i] for i in range(n)))])
            owner = np.concatenate([owner, few])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts.n))]), values


def bands(percent: int, limit: int) -> list[tuple[int, int, int, int]]:
    """Size bands (least size, largest size, classes, classes that may differ) that linked sets of both share.

    Sets of sizes s <= l link only if they differ in at most (s + l)(1 - t) / (1 + t) shingles, so in no more
    classes. An eighth more classes make for agreements that chance does not bring; two more
    let a few be empty.
    """
    out, least = [], 1
    while least <= limit:
        largest = max(least, least * 3 // 2 if least > 6 else least * 100 // percent)
        differ = 2 * largest * (100 - percent) // (100 + percent)
        out.append((least, largest, differ + differ // 8 + 3, differ))
        least = largest + 1
    return out


def signatures(offsets: np.ndarray, values: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the classes of each set, for its own size band and those of larger sets it may link with.

    Per band: its number, the sets, how many shared signatures a linked set has at least, where each set's
    signatures begin, and the signatures. Empty classes tell nothing and are left out, unless a set
    has so many that the agreements might all be empty.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    low, high = (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), (spread >> np.uint64(32)).astype(np.float64)
    out = []
    for band, (least, largest, classes, differ) in enumerate(bands(percent, int(sizes.max(initial=0)) * 100 // percent + 1)):
        inside = (sizes <= largest) & (sizes * 100 >= least * percent) & (sizes > 0)
        sets = np.flatnonzero(inside)
        if not len(sets) or not differ:
            continue  # so small that only equal sets link
        row = np.cumsum(inside) - 1
        take = inside[owner]
        cell = row[owner[take]] * classes + (((values[take] >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)).astype(np.int64)
        width = len(sets) * classes
        # sums modulo 2**64 from two halves, each exact in a double
        total = (np.bincount(cell, high[take], width).astype(np.uint64) << np.uint64(32)) + np.bincount(cell, low[take], width).astype(np.uint64)
        full = np.bincount(cell, minlength=width).reshape(-1, classes) > 0
        filled = full.sum(1)
        use = full | (filled <= differ)[:, None]
        who, which = np.nonzero(use)
        # of a set's full classes all but ``differ`` agree; one that uses empty ones shares one at least
        out.append((band, sets, np.maximum(filled - differ, 1), np.concatenate([[0], np.cumsum(use.sum(1))]),
                    combine(np.full(len(who), band), which, total.reshape(-1, classes)[use])))
    return out


def _set_ids(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)])
    sizes = np.diff(offsets)
    ids = combine(sums[offsets[1:]] - sums[offsets[:-1]], sizes)
    return np.where(sizes > 0, np.where(ids == 0, 1, ids), 0).astype(np.uint64).view(np.int64)


_SETS = "doc_id {0}, n_shingles long, set_id long, first boolean, band int, need int, sigs array<long>"


#: Bytes of texts whose shingles and signatures are worked out at a time.
READ_BYTES = 500_000


def _read_sets(width: int, percent: int):
    """A row per document (``first``) and one per size band of it, with its signatures."""
    def rows(batches):
        begin("sets")
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in slices(column, READ_BYTES):
                offsets, values = shingle_sets(column.slice(a, b - a), width)
                own, sizes, names = ids.slice(a, b - a), np.diff(offsets), _set_ids(offsets, values)
                n = b - a
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([own, pa.array(sizes), pa.array(names), pa.array(np.ones(n, bool)), none, none, pa.nulls(n, pa.list_(pa.int64()))],
                                                 ["doc_id", "n_shingles", "set_id", "first", "band", "need", "sigs"])
                for band, sets, need, places, sigs in signatures(offsets, values, percent):
                    n = len(sets)
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array(sets)), pa.array(sizes[sets]), pa.array(names[sets]), pa.array(np.zeros(n, bool)), pa.array(np.full(n, band, np.int32)),
                         pa.array(need.astype(np.int32)), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(sigs.view(np.int64)))],
                        ["doc_id", "n_shingles", "set_id", "first", "band", "need", "sigs"])
        give_back()

    return rows


#: Bits of a signature that tell it from others; below them stand its band and what copies of a set are dealt by.
_SIG = ~0xFFF
_BAND, _SALT = 6, 64


#: Rows that a task hands on at a time.
HANDED_ON = 200_000


def _columns(batches, count: int) -> list[np.ndarray]:
    """The first ``count`` columns of all batches; a batch is freed when it has been read."""
    parts = [[np.array(b.column(i)) for i in range(count)] for b in batches if b.num_rows]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(count)]


def _equal(values: np.ndarray) -> np.ndarray:
    """How many values are equal to each, where equal ones stand side by side."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    n = np.diff(np.append(np.flatnonzero(first), len(values)))
    return np.repeat(np.minimum(n, _CUT).astype(np.int32), n)


def _shared(batches):
    """Signatures that several sets have, from a partition that holds equal ones side by side.

    What the partition's edges cut counts as shared. A set is named once per signature.
    """
    keys, sets = _columns(batches, 2)
    if not len(keys):
        return
    order = np.lexsort((sets, keys & _SIG))
    keys, sets = keys[order], sets[order]
    del order
    new = np.ones(len(keys), bool)
    new[1:] = ((keys[1:] ^ keys[:-1]) & _SIG != 0) | (sets[1:] != sets[:-1])
    keys, sets = keys[new], sets[new]
    sig = keys & _SIG
    n = _equal(sig)
    keep = (n > 1) | (sig == sig[0]) | (sig == sig[-1])
    del new, n, sig
    keys, sets = keys[keep], sets[keep]
    for at in range(0, len(keys), HANDED_ON):
        own = keys[at:at + HANDED_ON]
        yield pa.RecordBatch.from_arrays([pa.array(own & _SIG), pa.array(sets[at:at + HANDED_ON]), pa.array(((own >> _BAND) & 63).astype(np.int32))], ["sig", "set_id", "band"])
    del keys, sets, keep, own
    give_back()


def _shared_signatures(sets: DataFrame) -> DataFrame:
    """(sig, set_id, band) of the signatures that several sets have."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of (key, set) also split a signature that very many sets share, and a set of very many copies; two
    # numbers a row are all that is shuffled. Signatures that 52 bits do not tell apart only bring sets together in vain.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALT))
    key = F.col("sig").bitwiseAND(F.lit(_SIG)) + F.shiftleft(F.col("band").cast("long"), _BAND) + salt
    rows = sets.select("band", "set_id", "doc_id", F.explode("sigs").alias("sig")).select(key.alias("key"), "set_id")
    return materialized(rows.repartitionByRange(parts, "key", "set_id").mapInArrow(_shared, "sig long, set_id long, band int"), "shared")


def _forget(spark, *tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read any more, and the shuffle files of jobs whose results are written."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            drop_scratch(spark, folder)
    free_shuffles(spark)


def _clusters(shared: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, root) of the sets that may have a link; linked ones have the same root. ``needs``: (set_id, band, need)."""
    spark, before = shared.sparkSession, shared
    for _ in range(2):
        # sets that share enough with others; then, without the rest, again
        enough = (shared.groupBy("set_id", "band").agg(F.count("*").alias("_n")).join(needs, ["set_id", "band"])
                  .where("_n >= need").select("set_id", "band"))
        shared = shared.join(enough, ["set_id", "band"], "left_semi")
        shared = materialized(_with_heads(shared), "shared")
        del enough
        _forget(spark, before)
        before = shared
        headed, shared = shared, shared.drop("head")
    return _rooted(headed)


def _with_heads(shared: DataFrame) -> DataFrame:
    """Rows whose ``sig`` several sets have, with the least of them as ``head``."""
    several = shared.groupBy("sig").agg(F.min("set_id").alias("head"), F.max("set_id").alias("_last")).where("head <> _last").select("sig", "head")
    return shared.join(several, "sig")


def _rooted(shared: DataFrame) -> DataFrame:
    """(node, root) of the sets in a scratch table (sig, set_id, head), which is removed: sets with a common ``sig`` have the same root."""
    # a label passes from a set over all its signatures: copies of one text share one with their least set and agree at
    # once, so edges are left only between labels that meet in some signature, not between sets and heads
    labels = materialized(shared.groupBy("set_id").agg(F.min("head").alias("label")), "labels")
    told = shared.select("sig", "set_id").join(labels, "set_id")
    apart = materialized(told.groupBy("sig").agg(F.min("label").alias("b"), F.max("label").alias("_last")).where("b <> _last").select("sig", "b"), "apart")
    joined = components(told.join(apart, "sig").select(F.col("label").alias("a"), "b"))
    del told, apart
    _forget(shared.sparkSession, shared)
    return (labels.join(joined, F.col("label") == F.col("node"), "left").select(F.col("set_id").alias("node"), F.coalesce("root", "label").alias("root")))


#: How often a shingle counts that the edge of a partition may cut.
_CUT = 2**31 - 1


def _occurrences(batches):
    """(key, set_id) of each shingle of each set; a cluster has keys of its own."""
    for batch in batches:
        roots, ids, codes = (batch.column(i) for i in range(3))
        n = np.array([len(c) // 8 for c in codes.to_pylist()], np.int64)
        keys = np.frombuffer(b"".join(codes.to_pylist()), np.uint64) ^ np.repeat(mix(np.asarray(roots).view(np.uint64)), n)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(np.asarray(ids), n))], ["key", "set_id"])
    give_back()


def _counted(batches):
    """(set_id, key, n) of the shingles that n > 1 sets have, from a partition that holds equal ones side by side.

    What the partition's edges may cut counts as ``_CUT`` wherever it stands, so each shingle has one count.
    """
    keys, sets = _columns(batches, 2)
    if not len(keys):
        return
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    del order
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])  # rows that repeat are one set
    keys, sets = keys[new], sets[new]
    n = _equal(keys)
    n[(keys == keys[0]) | (keys == keys[-1])] = _CUT
    keep = n > 1
    keys, sets, n = keys[keep], sets[keep], n[keep]
    del new, keep
    for at in range(0, len(keys), HANDED_ON):
        part = slice(at, at + HANDED_ON)
        yield pa.RecordBatch.from_arrays([pa.array(sets[part]), pa.array(keys[part]), pa.array(n[part])], ["set_id", "key", "n"])
    del keys, sets, n
    give_back()


def _rarest(percent: int):
    """(sig, set_id) of the shingles in one of which a set meets each that it is linked to: the rarest, as many as two linked
    sets may differ in and one more. From whole sets' rows (set_id, key, n) and one of each set with its size as -n;
    shingles that no other set has are the rarest and only counted."""
    def rows(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        sets, keys, n = (np.asarray(table.column(i).combine_chunks()) for i in range(3))
        order = np.lexsort((keys, n, sets))
        sets, keys, n = sets[order], keys[order], n[order].astype(np.int64)
        first = np.ones(len(sets), bool)
        first[1:] = sets[1:] != sets[:-1]
        group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        size, marks, length = -n[starts], np.bincount(group[n < 0], minlength=len(starts)), np.bincount(group)
        alone = size - (length - marks)
        most = size - -(-size * percent // 100) + 1 - alone
        place = np.arange(len(sets)) - starts[group] - marks[group]
        keep = (place >= 0) & (place < most[group])
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(sets[keep])], ["sig", "set_id"])
        del table, sets, keys, n, order, first, group, place, keep
        give_back()

    return rows


def _parted(members: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets of ``members`` (root, set_id, codes) that may have a link, by their rarest shingles: linked ones have the same root.

    Signatures chain sets that share a class with this one and another with that one; few sets share a rare shingle.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of (key, set) also split a shingle that very many sets have
    counted = materialized(members.select("root", "set_id", "codes").mapInArrow(_occurrences, "key long, set_id long").repartitionByRange(parts, "key", "set_id")
                           .mapInArrow(_counted, "set_id long, key long, n int"), "counted")
    _forget(spark)
    sizes = members.select("set_id", F.lit(0).cast("long").alias("key"), (-F.length("codes") / 8).cast("int").alias("n"))
    rare = materialized(counted.unionByName(sizes).repartition(parts, "set_id").mapInArrow(_rarest(percent), "sig long, set_id long"), "rare")
    _forget(spark, counted)
    headed = materialized(_with_heads(rare), "shared")
    _forget(spark, rare)
    return _rooted(headed)


class Region:
    """Sets of one cluster in a task, with what is known to be linked."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        every = np.concatenate(sets)
        self.names, self.codes = np.unique(every, return_inverse=True)
        self.percent, self.radius = percent, 1 - percent / 100
        self.parent = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def own(self, i: int) -> np.ndarray:
        return self.codes[self.offsets[i]:self.offsets[i + 1]]

    def linked(self, common: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
        return 100 * common >= self.percent * (sizes + size - common)

    def common(self, i: int, rows: np.ndarray, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Shingles that set i shares with each of ``rows``, whose codes stand in ``cells``."""
        mark = np.zeros(len(self.names), np.int64)
        mark[self.own(i)] = 1
        return np.add.reduceat(mark[cells], starts)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self.codes[np.arange(sizes.sum()) + np.repeat(self.offsets[rows] - starts, sizes)], starts

    def join(self, rows: np.ndarray, pivots: int = PIVOTS, leaf: int = LEAF) -> None:
        """Link all linked pairs of ``rows``."""
        todo = [rows]
        while todo:
            rows = todo.pop()
            if len(rows) < 2 or len({self.root(i) for i in rows.tolist()}) == 1:
                continue  # all in one component already
            cells, starts = self.gather(rows)
            if len(rows) <= leaf:
                for k, i in enumerate(rows.tolist()):
                    for j in rows[self.linked(self.common(i, rows, cells, starts), self.sizes[rows], self.sizes[i])].tolist():
                        if j != i:
                            self.link(i, j)
                continue
            chosen = rows[np.linspace(0, len(rows) - 1, pivots).astype(int)]
            distance = np.empty((pivots, len(rows)))
            for k, i in enumerate(chosen.tolist()):
                common = self.common(i, rows, cells, starts)
                distance[k] = 1 - common / (self.sizes[rows] + self.sizes[i] - common)
                for j in rows[self.linked(common, self.sizes[rows], self.sizes[i])].tolist():
                    self.link(i, j)
            # pivots are settled; their regions, with windows, hold every other linked pair
            inside = (distance <= distance.min(0) + 2 * self.radius + 1e-9) & ~np.isin(rows, chosen)
            if inside.sum() > 2 * len(rows):
                self.by_prefix(rows[~np.isin(rows, chosen)])  # regions would repeat most of the rows
            else:
                todo.extend(rows[inside[k]] for k in range(pivots))

    def by_prefix(self, rows: np.ndarray) -> None:
        """The same by an index of each set's rarest shingles: linked sets share one of them.

        The sets of what is the largest component now are only indexed, before any set is probed: they need no
        links among themselves. Sets that join it later are probed like all others.
        """
        roots = np.array([self.root(i) for i in rows.tolist()])
        names, counts = np.unique(roots, return_counts=True)
        if len(names) == 1:
            return
        cells, _ = self.gather(rows)
        often = np.bincount(cells, minlength=len(self.names))
        index: dict[int, list[int]] = {}
        others = roots != names[counts.argmax()]
        for i, probed in [*((i, False) for i in rows[~others].tolist()), *((i, True) for i in rows[others].tolist())]:
            codes, size = self.own(i), int(self.sizes[i])
            rare = codes[np.lexsort((codes, often[codes]))][:size - -(-size * self.percent // 100) + 1].tolist()
            mine = self.root(i)
            for j in sorted({j for c in rare for j in index.get(c, ())}) if probed else ():
                other = int(self.sizes[j])
                if 100 * min(size, other) >= self.percent * max(size, other) and self.root(j) != mine:
                    common = len(np.intersect1d(codes, self.own(j), assume_unique=True))
                    if 100 * common >= self.percent * (size + other - common):
                        self.link(i, j)
                        mine = self.root(i)
            for c in rare:
                index.setdefault(c, []).append(i)


def _join_groups(percent: int, group: str):
    """Links (a, b) of every group in a table (group, set_id, linked, codes); sets marked ``linked`` are known to be."""
    def work(table: pa.Table) -> pa.Table:
        a, b = [], []
        table = table.sort_by([(group, "ascending"), ("set_id", "ascending")])
        names = np.asarray(table.column(group).combine_chunks())
        ids = np.asarray(table.column("set_id").combine_chunks())
        known = np.asarray(table.column("linked").combine_chunks())
        first = np.ones(len(ids), bool)  # rows that repeat are one set
        first[1:] = (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])
        table = table.filter(pa.array(first))
        names, ids, known, codes = names[first], ids[first], known[first], table.column("codes")
        edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            region = Region([np.frombuffer(codes[i].as_py(), np.uint64) for i in range(start, end)], percent)
            settled = np.flatnonzero(known[start:end]).tolist()
            for i in settled[1:]:
                region.link(settled[0], i)
            region.join(np.arange(end - start))
            for i in range(end - start):
                if (j := region.root(i)) != i:
                    a.append(ids[start + i])
                    b.append(ids[start + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def _to_regions(percent: int):
    """Links with pivots, and the regions and windows of each set, from a part of a region's sets and its pivots."""
    radius = 1 - percent / 100

    def work(members: pa.Table, chosen: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("kind", "region", "set_id", "other", "linked", "codes")}
        pivots = [(i, np.frombuffer(c, np.uint64)) for i, c in sorted(zip(*(chosen.column(k).to_pylist() for k in ("set_id", "codes")), strict=True))]
        names = {i for i, _ in pivots}
        for name, own, codes in zip(*(members.column(k) for k in ("region", "set_id", "codes")), strict=True):
            name, own, raw = name.as_py(), own.as_py(), codes.as_py()
            mine = np.frombuffer(raw, np.uint64)
            distance, linked = [], []
            for other, theirs in pivots:
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                union = len(mine) + len(theirs) - common
                distance.append(1 - common / union)
                linked.append(100 * common >= percent * union)
                if linked[-1] and other != own:
                    for column, value in zip(out, (0, name, own, other, True, None), strict=True):
                        out[column].append(value)
            for k, d in enumerate(distance) if own not in names else ():  # pivots are settled
                if d <= min(distance) + 2 * radius + 1e-9:
                    for column, value in zip(out, (1, f"{name}/{k}", own, pivots[k][0], linked[k], raw), strict=True):
                        out[column].append(value)
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        table = pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})
        # handed over piece by piece, so that Spark does not hold a part's windows at once
        return pa.Table.from_batches(table.to_batches(max_chunksize=HANDED_OVER), table.schema)

    return work


def _links_of_large(members: DataFrame, percent: int, limit: int, pivots: int) -> DataFrame:
    """Links of clusters that exceed a task: members (region, set_id, linked, codes)."""
    spark = members.sparkSession
    links: list[DataFrame] = []
    rounds = 0
    while not members.isEmpty():
        rounds += 1
        order = W.partitionBy("region").orderBy(F.xxhash64("set_id", F.lit(rounds)), "set_id")
        chosen = materialized(members.select("region", "set_id", "codes").withColumn("_nr", F.row_number().over(order)).where(F.col("_nr") <= pivots), "pivots")
        # a region's sets are dealt to parts that fit a task, each of which gets the pivots
        parts = materialized(members.groupBy("region").agg(F.ceil(16 * F.sum(F.length("codes")) / limit).alias("_parts")), "parts")
        left = members.join(parts, "region").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("_parts")))
        right = chosen.join(parts, "region").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        told = materialized(left.select("region", "part", "set_id", "codes").groupBy("region", "part").cogroup(
            right.select("region", "part", "set_id", "codes").groupBy("region", "part")).applyInArrow(
            _to_regions(percent), "kind int, region string, set_id long, other long, linked boolean, codes binary"), "regions")
        links.append(materialized(told.where("kind = 0").select(F.col("set_id").alias("a"), F.col("other").alias("b")), "links"))
        parts = told.where("kind = 1").select("region", "set_id", "linked", "codes")
        before = members.groupBy("region").agg(F.count("*").alias("parent_rows"))
        sizes = materialized(parts.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.length("codes")).alias("bytes"),
                                                         F.sum(F.when(F.col("linked"), F.length("codes")).otherwise(0)).alias("linked_bytes"))
                             .where("linked_bytes < bytes")  # else all are linked to the pivot
                             .withColumn("parent", F.substring_index("region", "/", rounds))
                             .join(before.withColumnRenamed("region", "parent"), "parent"), "sizes")
        fits = sizes.where(F.col("bytes") <= limit).select("region")
        links.append(materialized(parts.join(fits, "region").withColumn("bucket", F.col("region")).groupBy("bucket")
                                  .applyInArrow(_join_groups(percent, "region"), "a long, b long"), "links"))
        _forget(spark)  # one shuffle of sets at a time
        # no smaller than before: all sets in chunks, every two chunks together unless all of both are linked to the pivot
        stuck = sizes.where((F.col("bytes") > limit) & (F.col("rows") > 0.5 * F.col("parent_rows"))).withColumn(
            "u", F.ceil(2 * (F.col("bytes") - F.col("linked_bytes")) / limit)).withColumn("l", F.ceil(2 * F.col("linked_bytes") / limit))
        dealt = (parts.join(stuck.select("region", "u", "l"), "region")
                 .withColumn("own", F.when(F.col("linked"), F.col("u") + F.pmod(F.xxhash64("set_id"), F.greatest("l", F.lit(1))))
                             .otherwise(F.pmod(F.xxhash64("set_id"), F.col("u"))))
                 .withColumn("other", F.explode(F.when(F.col("linked"), F.sequence(F.lit(0).cast("long"), F.col("u") - 1))
                                                .otherwise(F.sequence(F.lit(0).cast("long"), F.col("u") + F.col("l") - 1))))
                 .withColumn("bucket", F.concat_ws(":", "region", F.least("own", "other"), F.greatest("own", "other"))))
        links.append(materialized(dealt.select(F.col("bucket").alias("region"), "bucket", "set_id", "linked", "codes").groupBy("bucket")
                                  .applyInArrow(_join_groups(percent, "region"), "a long, b long"), "links"))
        again = sizes.where((F.col("bytes") > limit) & (F.col("rows") <= 0.5 * F.col("parent_rows"))).select("region")
        after = materialized(parts.join(again, "region").select("region", "set_id", "linked", "codes"), "members")
        done = [told, chosen, *([members] if rounds > 1 else [])]  # the first members are the caller's
        members = after
        del left, right, parts, dealt, told, chosen, sizes, fits, stuck, again, before, after
        _forget(spark, *done)
    out = spark.createDataFrame([], "a long, b long")
    for part in links:
        out = out.unionByName(part)
    return out


@contextmanager
def _runtime_filter(spark):
    """Lets Spark filter the large side of a join by the keys of the small one, however small the tables are."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, region_bytes: int = REGION_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """Per row of ``docs``: doc_id, size of its shingle set and its component, named by the smallest doc_id.

    Words are maximal runs of anything but ASCII white space, A-Z in lower case. Two documents link if
    100 * intersection >= ``percent`` * union of their distinct ``width``-word shingles; a text of fewer words is
    one shingle; null and empty texts and those without words have none, link with nothing and are their own
    component. Rows that share a doc_id are judged each for itself; rows without one have no component and
    link nothing. An empty table gives no rows; other columns are left out. Shingles and sets are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "sets")
    read = docs.select("doc_id", "text").mapInArrow(_read_sets(width, percent), _SETS.format(kind))
    read.write.partitionBy("first").parquet(path)
    stored = spark.read.schema(read.schema).parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = stored.where("not first and doc_id is not null")
    shared = _shared_signatures(signed)
    needs = materialized(signed.groupBy("set_id", "band").agg(F.max("need").alias("need")), "needs")
    del signed
    drop_scratch(spark, f"{path}/first=false")  # most signatures are of no more use; the shared ones are a table
    _forget(spark)
    clusters = _clusters(shared, needs)
    sets = stored.where("first").select("doc_id", "n_shingles", "set_id")

    # one text per set of a cluster
    asked = (sets.where("doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
             .join(clusters, F.col("set_id") == F.col("node")).select("doc_id", "set_id", "n", "root"))
    asked = materialized(asked, "asked")
    weights = materialized(asked.groupBy("root").agg((8 * F.sum("n")).alias("bytes")), "weights")
    total = weights.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def codes(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in slices(column, READ_BYTES):
                offsets, values = shingle_sets(column.slice(a, b - a), width)
                same = _set_ids(offsets, values) == np.asarray(ids.slice(a, b - a))
                raw = [values[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), ids.slice(a, b - a), pa.array(raw, pa.binary())], ["root", "set_id", "codes"])
                yield out.filter(pa.array(same))
        give_back()

    # Spark's runtime filter (a Bloom filter of 8 MB at most) leaves out most texts before the shuffle; the
    # condition, which always holds, lets it apply
    members = (docs.select("doc_id", "text").join(asked.where("n > 0"), "doc_id").select("set_id", "text", "root")
               .mapInArrow(codes, "root long, set_id long, codes binary").withColumn("linked", F.lit(False)))
    large = weights.where(F.col("bytes") > region_bytes).select("root")
    links = None
    if not large.isEmpty():
        with _runtime_filter(spark):
            members = materialized(members, "members")
        parted = materialized(_parted(members.join(large, "root", "left_semi"), percent), "parted")
        before, members = members, materialized(
            members.join(large.withColumn("_large", F.lit(True)), "root", "left").join(parted.select(F.col("node").alias("set_id"), F.col("root").alias("_part")), "set_id", "left")
            .where("_large is null or _part is not null")  # else without a link
            .select(F.coalesce("_part", "root").alias("root"), "set_id", "codes", "linked"), "members")
        _forget(spark, before)
        large = materialized(members.groupBy("root").agg(F.sum(F.length("codes")).alias("bytes")).where(F.col("bytes") > region_bytes).select("root"), "large")
        if not large.isEmpty():
            links = _links_of_large(members.join(large, "root", "left_semi").select(F.col("root").cast("string").alias("region"), "set_id", "linked", "codes"),
                                    percent, region_bytes, pivots)
    small = members if links is None else members.join(large, "root", "left_anti")
    buckets = max(parts, -(-2 * total // region_bytes))
    joined = (small.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(buckets))).groupBy("bucket")
              .applyInArrow(_join_groups(percent, "root"), "a long, b long"))
    named = joined.select(F.col("a").alias("node"), F.col("b").alias("root"))  # within a task roots are final
    if links is not None:
        named = named.unionByName(components(links))
    with _runtime_filter(spark):
        named = materialized(named, "components")
    found = (sets.select("doc_id", "n_shingles", "set_id").join(named, F.col("set_id") == F.col("node"), "left")
             .withColumn("_class", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id"))))
    # a table of its own, so that the rows of a very large component can be split in the join
    least = materialized(found.where("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("_least")), "least")
    return (found.join(least, "_class", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component; rows without a doc_id stay.

    Of rows that share that doc_id all stay.
    """
    found = jaccard_components(docs, width, percent)
    gone = materialized(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)  # the texts stay where they are; beyond, they are shuffled
    return docs.join(gone, "doc_id", "left_anti")
