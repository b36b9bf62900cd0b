"""Work per distinct word of a corpus, joined back to the documents by position.

Token work repeats: a word costs the same wherever it stands. Documents are split into words block by
block (about ``BLOCK`` bytes of text). A block hands its distinct words to buckets of the word's hash; a
bucket holds every copy of a word in the corpus, works each distinct word out once and returns the
results to the blocks; a block then looks its words' results up by position. Only distinct words and
word numbers are shuffled, packed into a few rows per block, so no word, however frequent, is a hot key.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusflow.llm.arrays import flat, prefixes, slices, span_hashes
from corpusflow.llm.workers import give_back

BLOCK = 24_000_000
#: Bytes of texts that are split into words at a time, which takes about 60 times as much.
SPLIT_BYTES = 500_000
_C = zstandard.ZstdCompressor(level=1)
_D = zstandard.ZstdDecompressor()


@dataclass
class Words:
    """Words of a run of texts: bytes, spans, the text each belongs to and a hash each."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray


#: From a text column (nulls empty) to its words.
Splitter = Callable[[pa.Array], Words]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the caller knows their types."""
    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    out = _C.compressobj(size=sizes.nbytes + int(sizes[1:].sum()))
    return b"".join([*(out.compress(np.ascontiguousarray(a)) for a in (sizes, *arrays)), out.flush()])


def unpack(value: bytes, *kinds) -> list[np.ndarray]:
    raw = _D.decompress(value)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (count + 1)
    for size, kind in zip(np.frombuffer(raw, np.int64, count, 8), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def bytes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass
class _Block:
    """A block while it is read: its distinct words as each slice's new ones (hashes, sizes and bytes), and each slice's words as
    its distinct hashes and places in them."""
    name: str
    keys: np.ndarray
    fresh: list[tuple[np.ndarray, np.ndarray, bytes]]
    ids: list
    sizes: list[np.ndarray]
    counts: list[np.ndarray]
    hashes: list[tuple[np.ndarray, np.ndarray]]

    def spans(self) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Hashes of the distinct words, their bytes in a row, and where each begins and ends there."""
        hashes, sizes, content = zip(*self.fresh, strict=True) if self.fresh else ([self.keys], [self.keys], [])
        ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        return np.concatenate(hashes), b"".join(content), np.concatenate([np.zeros(1, np.int64), ends[:-1]])[:len(ends)], ends

    @property
    def words(self) -> dict[int, bytes]:
        """The distinct words by hash."""
        hashes, content, starts, ends = self.spans()
        return {h: content[a:b] for h, a, b in zip(hashes.tolist(), starts.tolist(), ends.tolist(), strict=True)}


def _places(distinct: int) -> type:
    """The type of places among so many distinct words."""
    return np.uint16 if distinct <= 1 << 16 else np.uint32


def _blocks(batches: Iterator[pa.RecordBatch], split: Splitter, keep_words: bool, size: int) -> Iterator[_Block]:
    """Blocks of a partition; the same partition gives the same blocks."""
    context = TaskContext.get()
    part, nr, held = context.partitionId() if context else 0, 0, 0

    def new() -> _Block:
        return _Block(f"{part}-{nr}", np.zeros(0, np.uint64), [], [], [], [], [])

    def done() -> _Block:
        if not keep_words:
            block.keys = np.unique(np.concatenate([distinct for distinct, _ in block.hashes]))
        return block

    block = new()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts, SPLIT_BYTES):
            column = texts.slice(a, b - a)
            found = split(column)
            if keep_words:
                distinct, first = np.unique(found.hashes, return_index=True)
                at = np.searchsorted(block.keys, distinct)
                unseen = np.append(block.keys, np.uint64(0))[at] != distinct
                unseen |= at == len(block.keys)
                block.keys = np.insert(block.keys, at[unseen], distinct[unseen])
                starts, ends = found.starts[first[unseen]], found.ends[first[unseen]]
                block.fresh.append((distinct[unseen], (ends - starts).astype(np.uint32), b"".join(bytes_at(found.data, starts, ends))))
            else:
                distinct, place = np.unique(found.hashes, return_inverse=True)
                block.hashes.append((distinct, place.astype(_places(len(distinct)))))
                block.ids.append(ids.slice(a, b - a))
                block.counts.append(np.bincount(found.text, minlength=b - a).astype(np.uint32))
                block.sizes.append(np.diff(flat(column)[1]))
            held += column.nbytes
            del column, found
            if held >= size:
                yield done()
                nr, held = nr + 1, 0
                block = new()
                give_back()
    if len(block.keys) or block.ids:
        yield done()
    del block
    give_back()


def per_word(docs: DataFrame, split: Splitter, work: Callable[[list[bytes]], tuple], finish, schema: str, id_col: str = "doc_id",
             text_col: str = "text", buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` from per-word results.

    ``work(words)`` is given the distinct words of a bucket, each once in the corpus, and returns how
    many numbers each has and all numbers. ``finish(results)`` is given those of a block's words and returns
    ``rows(ids, sizes, counts, places)``, which builds the rows of a slice of the block: ids and byte sizes of its
    texts, how many words each has, and the place of each word's numbers in ``results``.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    id_type = docs.schema[0].dataType.simpleString()
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    modulus = np.uint64(n)

    def words_of(batches):
        for found in _blocks(batches, split, True, block):
            names, parts, values = [], [], []
            hashes, content, starts, ends = found.spans()
            found.fresh.clear()
            bucket = hashes % modulus
            order = np.lexsort((hashes, bucket))
            buckets, first = np.unique(bucket[order], return_index=True)
            for k, own in zip(buckets, np.split(order, first[1:]), strict=False):
                words = [content[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                names.append(found.name)
                parts.append(int(k))
                values.append(pack(np.array(list(map(len, words)), np.uint32), np.frombuffer(b"".join(words), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(values, pa.binary())],
                                             ["block", "bucket", "words"])

    def once(table: pa.Table) -> pa.Table:
        opened = [unpack(v.as_py(), np.uint32, np.uint8) for v in table.column("words")]
        content = np.concatenate([c for _, c in opened])
        ends = np.cumsum(np.concatenate([sizes for sizes, _ in opened]), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        keys = span_hashes(prefixes(content), starts, ends)
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        rows = Results.of(work(bytes_at(content, starts[first], ends[first])))
        values, at = [], 0
        for sizes, _ in opened:  # a block's words came in order of their keys and go back so
            own = slice(at, at + len(sizes))
            got = rows.take(place[own])
            values.append(pack(np.bitwise_xor.reduce(keys[own], keepdims=True), np.diff(got.offsets).astype(np.uint32), got.values))
            at += len(sizes)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "results": pa.array(values, pa.binary())})

    def numbers_of(batches):
        for found in _blocks(batches, split, False, block):
            # words are numbered by bucket, then key: the order in which the buckets' results come together
            order = np.lexsort((found.keys, found.keys % modulus))
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            bucket, first = np.unique(found.keys[order] % modulus, return_index=True)
            checks = np.bitwise_xor.reduceat(found.keys[order], first) if len(first) else found.keys
            head = pack(bucket, checks)
            for ids, sizes, counts in zip(found.ids, found.sizes, found.counts, strict=True):  # a row per slice: no row has the numbers of a whole block
                distinct, place = found.hashes.pop(0)
                own = rank[np.searchsorted(found.keys, distinct)]
                order = np.argsort(own)
                back = np.empty(len(order), place.dtype)
                back[order] = np.arange(len(order))
                numbers = pack(np.diff(own[order], prepend=np.uint32(0)), back[place].view(np.uint8), sizes, counts)  # steps take less than numbers
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found.name], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([head], pa.binary()),
                     pa.array([numbers], pa.binary())], ["block", "ids", "head", "numbers"])
                head = None

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("results").to_pylist(), strict=True), key=lambda x: x[0])
        opened = [unpack(value, np.uint64, np.uint32, np.int32) for _, value in parts]
        for head in left.column("head").drop_null().to_pylist():
            bucket, checks = unpack(head, np.uint64, np.uint64)
            if [k for k, _ in parts] != bucket.tolist() or [int(c[0]) for c, _, _ in opened] != checks.tolist():
                raise RuntimeError("a block was read anew with other rows; write the input to a table first")
        rows = finish(Results.concat([Results.of((own, values)) for _, own, values in opened]) if opened else Results.of(([], [])))
        del parts, opened
        tables = []
        for ids, numbers in zip(left.column("ids"), left.column("numbers"), strict=True):
            steps, place, sizes, counts = unpack(numbers.as_py(), np.uint32, np.uint8, np.int64, np.uint32)
            own = np.cumsum(steps, dtype=np.uint32)
            tables.append(rows(ids.values, sizes, counts.astype(np.int64), own[place.view(_places(len(own)))]))
        give_back()
        return pa.concat_tables(tables) if tables else pa.table({})

    results = (docs.mapInArrow(words_of, "block string, bucket int, words binary")
               .groupBy("bucket").applyInArrow(once, "block string, bucket int, results binary"))
    numbers = docs.mapInArrow(numbers_of, f"block string, ids array<{id_type}>, head binary, numbers binary")
    return numbers.groupBy("block").cogroup(results.groupBy("block")).applyInArrow(join, schema)


@dataclass
class Results:
    """A list of numbers per word: ``values[offsets[i]:offsets[i + 1]]``."""
    offsets: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(lists) -> Results:
        counts, values = lists
        return Results(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.asarray(values, np.int32))

    def take(self, rows: np.ndarray) -> Results:
        counts = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1][rows] - offsets[:-1], counts)
        return Results(offsets, self.values[at])

    @staticmethod
    def concat(parts: list[Results]) -> Results:
        return Results.of((np.concatenate([np.diff(p.offsets) for p in parts]), np.concatenate([p.values for p in parts])))
