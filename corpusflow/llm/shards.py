"""Sharding by minimax contiguous partition: equal texts stay together, shards are near equal in bytes.

All rows with one text form an atomic group, and groups stand in the order of their text's digest (groups
larger than a shard's fair share come first and get shards of their own). The smallest capacity with
which contiguous runs of groups fill the given number of shards is found by binary search, each capacity
being tried by greedy filling; cuts then lie as near to even as that capacity allows.

The ordered sizes are a Spark table with running sums. The driver never holds it: it knows some of the
boundaries between groups (``Boundaries``, at most a few times ``MARKS``), tries capacities on them in
the best and in the worst case, and asks Spark for more boundaries where the two differ, until they agree.
A row's shard follows from comparing its digest with the cuts, so neither texts nor rows are joined.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import materialized

SHARDS = 24
#: Bytes that a row weighs besides its text.
ROW_BYTES = 8
#: Boundaries that one round fetches, and parts of the digests in which running sums are formed.
MARKS, PARTS = 8_192, 4_096


@dataclass
class Boundaries:
    """Some ends of groups on the axis of running sums. Nothing lies between a known end and the start of the group there if they meet."""
    ends: np.ndarray
    starts: np.ndarray
    keys: np.ndarray

    @property
    def total(self) -> int:
        return int(self.ends[-1])

    def add(self, rows: list) -> Boundaries:
        ends = np.concatenate([self.ends, [r.end for r in rows]]).astype(np.int64)
        starts = np.concatenate([self.starts, [r.end - r.weight for r in rows]]).astype(np.int64)
        keys = np.concatenate([self.keys, np.array([bytes(r.key) for r in rows], object)])
        ends, first = np.unique(ends, return_index=True)
        return Boundaries(ends, starts[first], keys[first])

    def known(self, x: int) -> int:
        """The last known boundary up to x."""
        i = int(np.searchsorted(self.ends, x, "right")) - 1
        return int(self.ends[i]) if i >= 0 else 0

    def latest(self, x: int) -> int:
        """Where the last boundary up to x lies at most."""
        i = int(np.searchsorted(self.ends, x, "right"))
        return min(x, int(self.starts[i])) if i < len(self.ends) else self.total

    def earliest(self, x: int) -> int:
        """Where the first boundary from x on lies at least."""
        i = int(np.searchsorted(self.ends, x))
        return max(x, 0) if x <= int(self.starts[i]) else int(self.ends[i])

    def following(self, x: int) -> int:
        """The first known boundary from x on."""
        return int(self.ends[np.searchsorted(self.ends, x)]) if x > 0 else 0

    def gap(self, x: int) -> tuple[int, int] | None:
        """The stretch around x whose boundaries (after, up to) are not known."""
        i = int(np.searchsorted(self.ends, x))
        a, b = int(self.ends[i - 1]) if i else 0, int(self.starts[i]) if i < len(self.ends) else self.total
        return (a, b) if a < x and a < b else None


def _path(step: Callable[[int], int], start: int, end: int, shards: int) -> list[int]:
    at, out = start, []
    for _ in range(shards):
        at = step(at)
        out.append(at)
        if at == end:
            break
    return out


def _fill(marks: Boundaries, capacity: int, shards: int, surely: bool) -> list[int]:
    """Ends of greedily filled shards; by known boundaries only, or in the best case."""
    find = marks.known if surely else marks.latest
    return _path(lambda at: max(at, find(at + capacity)), 0, marks.total, shards)


def _fill_back(marks: Boundaries, capacity: int, shards: int, surely: bool) -> list[int]:
    """Starts of shards that are filled greedily from the end."""
    find = marks.following if surely else marks.earliest
    return _path(lambda at: min(at, find(max(at - capacity, 0))), marks.total, 0, shards)


def _smallest(marks: Boundaries, low: int, shards: int, surely: bool) -> int:
    """Binary search for the least capacity that suffices."""
    high = marks.total
    while low < high:
        middle = (low + high) // 2
        if _fill(marks, middle, shards, surely)[-1] == marks.total:
            high = middle
        else:
            low = middle + 1
    return low


#: Asks for boundaries in gaps (after, up to) of the axis.
Fetch = Callable[[list[tuple[int, int]]], list]


def _gaps(marks: Boundaries, points: list[int]) -> list[tuple[int, int]]:
    return sorted({gap for x in points if (gap := marks.gap(x))})


def minimax_cuts(marks: Boundaries, largest: int, shards: int, fetch: Fetch) -> tuple[int, Boundaries, list[int]]:
    """The smallest capacity, and the ends of all shards but the last.

    No shard exceeds the capacity. Among such cuts each one takes the boundary nearest to an even split
    that leaves the rest enough room.
    """
    least = max(largest, -(-marks.total // shards))
    while True:
        low, high = _smallest(marks, least, shards, False), _smallest(marks, least, shards, True)
        if low == high:
            break
        tried = {low, (low + high) // 2, high}
        marks = marks.add(fetch(_gaps(marks, [at + c for c in tried for surely in (False, True) for at in [0, *_fill(marks, c, shards, surely)]])))
    while True:  # the latest starts that still let the rest fit
        best, worst = _fill_back(marks, low, shards, False), _fill_back(marks, low, shards, True)
        if best == worst:
            break
        marks = marks.add(fetch(_gaps(marks, [at - low for at in [marks.total, *best, *worst]])))
    needed = (best + [0] * shards)[:shards - 1][::-1]  # where shard j has to end at least
    while True:
        cuts, unknown, at = [], [], 0
        for j in range(1, shards):
            even, reach = marks.total * j // shards, at + low
            unknown += [x for x, near in ((reach, (marks.known(reach), marks.latest(reach))), (even, (marks.known(even), marks.latest(even))),
                                          (even, (marks.following(even), marks.earliest(even)))) if near[0] != near[1]]
            nearest = min(marks.known(even), marks.following(even), key=lambda x: (abs(x - even), x))
            at = max(at, min(max(nearest, needed[j - 1]), marks.known(reach)))
            cuts.append(at)
        if not unknown:
            return low, marks, cuts
        marks = marks.add(fetch(_gaps(marks, unknown)))


@dataclass
class ShardPlan:
    """Which digest goes to which shard: ``alone`` are groups with shards of their own, ``cuts`` the last digests of the other shards."""
    shards: int
    capacity: int
    alone: list[bytes] = field(default_factory=list)
    cuts: list[bytes | None] = field(default_factory=list)

    def shard(self, key: Column) -> Column:
        """A row's shard. ``None`` among the cuts stands for a shard that ends before the first digest."""
        behind = [F.lit(1) if cut is None else (key > F.lit(cut)).cast("int") for cut in self.cuts]
        out = sum(behind, F.lit(len(self.alone)))
        for j, own in enumerate(self.alone):
            out = F.when(key == F.lit(own), j).otherwise(out)
        return out.cast("int")


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null has none) and ``ROW_BYTES``."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("bigint")


def plan_shards(rows: DataFrame, shards: int = SHARDS) -> ShardPlan:
    """The plan for rows (key, size): groups of equal keys stay together, the largest shard is as small as can be."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    groups = materialized(rows.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    alone: list[bytes] = []
    left, largest = total, 0
    for top in groups.orderBy(F.desc("weight"), "key").limit(shards).collect():
        largest = top.weight
        if top.weight * (shards - len(alone)) < left or len(alone) == shards - 1:
            break
        alone.append(bytes(top.key))
        left, largest = left - top.weight, 0
    # a group of its own comes off the axis; where all groups are off it, nothing is left to cut
    small = groups.where(~F.col("key").isin([F.lit(k) for k in alone])) if alone else groups
    ordered = materialized(
        small.withColumn("part", (F.conv(F.substring(F.hex("key"), 1, 4), 16, 10).cast("bigint") * PARTS / 65536).cast("int"))
        .withColumn("within", F.sum("weight").over(Window.partitionBy("part").orderBy("key"))), "ordered")
    parts = ordered.groupBy("part").agg(F.max("within").alias("bytes")).orderBy("part").collect()
    if not parts:
        return ShardPlan(shards, total, alone, [])
    ends = np.cumsum([p.bytes for p in parts]).tolist()
    names = [p.part for p in parts]
    before = rows.sparkSession.createDataFrame(list(zip(names, [0, *ends[:-1]], strict=True)), "part int, before bigint")
    summed = (ordered.join(F.broadcast(before), "part")
              .select("part", "key", "weight", (F.col("before") + F.col("within")).alias("end")))

    def fetch(gaps: list[tuple[int, int]]) -> list:
        """The last boundary of each slice of the gaps, ``MARKS`` at most in all. A slice of one byte holds
        one boundary, so gaps shrink until all that matters is known."""
        each = max(1, MARKS // len(gaps))
        end, inside = F.col("end"), None
        for i, (a, b) in enumerate(gaps):
            here = (end > a) & (end <= b)
            inside = F.when(here, i) if inside is None else inside.when(here, i)
        start, width = (F.array(*[F.lit(x).cast("bigint") for x in column])[F.col("i")] for column in zip(*((a, -(-(b - a) // each)) for a, b in gaps), strict=True))
        touched = F.col("part").between(names[bisect_right(ends, min(gaps)[0])], names[bisect_left(ends, max(b for _, b in gaps))])
        return (summed.where(touched).select("*", inside.alias("i")).where("i IS NOT NULL").groupBy("i", F.floor((end - start - 1) / width).alias("nr"))
                .agg(F.max("end").alias("end"), F.max_by("weight", "end").alias("weight"), F.max_by("key", "end").alias("key"))
                .select("end", "weight", "key").collect())

    none = Boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))
    marks = none.add(fetch([(0, ends[-1])]))
    capacity, marks, cuts = minimax_cuts(marks, largest, shards - len(alone), fetch)
    key_of = dict(zip(marks.ends.tolist(), marks.keys, strict=True))
    return ShardPlan(shards, capacity, alone, [key_of.get(cut) for cut in cuts])


def _numbered(rows: DataFrame) -> DataFrame:
    """The place of each row in its shard, from 0 without gaps, whatever the keys: rows are numbered by
    the written parts they lie in, whose counts are added up."""
    rows = rows.withColumn("_part", F.shiftright("row", 33))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
              .select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("row")) - 1
    return rows.withColumn("_own", own).join(counts, ["shard", "_part"]).withColumn("slot", (F.col("_before") + F.col("_own")).cast("bigint"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``bytes``: the largest shard is as small as contiguous groups of equal texts allow, the others as
    near to even as that lets them. Texts are read once; what is written and dealt out is a narrow row each.
    Null texts count as empty ones (8 bytes, checksum 0, one group with them). Repeated rows and ties share a
    shard and get slots of their own, a text of any length is one group, an empty table gives no rows, other
    columns are left out. Shards stay empty where there are fewer groups than shards.
    """
    text = F.col("text")
    rows = materialized(docs.select(
        "doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(text).alias("key"), F.monotonically_increasing_id().alias("row")), "rows")
    plan = plan_shards(rows, shards)
    return _numbered(rows.withColumn("shard", plan.shard(F.col("key")))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> ShardPlan:
    """Write ``docs`` as one folder a shard (``shard=0`` and so on); rows are written where they lie, without a shuffle of texts."""
    plan = plan_shards(docs.select(text_key(F.col("text")).alias("key"), text_size(F.col("text")).alias("size")), shards)
    docs.withColumn("shard", plan.shard(text_key(F.col("text")))).write.partitionBy("shard").parquet(path)
    return plan
