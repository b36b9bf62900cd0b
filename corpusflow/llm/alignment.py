"""Cross-tokenizer alignment by inverted bitmaps of id pairs.

A byte-level BPE (A) and a piece vocabulary (B) cut the same bytes; offsets where tokens of both end cut
them into groups, and the two tokens that end there are linked. Documents are worked block by block (``BLOCK``
bytes of text, at most 65,536 documents). A block keeps, for each pair of ids that it links, compressed bitmaps
of its documents: plane k holds the documents whose number of links of the pair has bit k, so all planes
OR-ed hold the documents that have the pair. Slices of a block are merged by OR as they come; population counts
of a pair's planes give its documents and its links. Spark adds these counts up per pair over all blocks (numbers
only: no bitmap is shuffled to its pair) and hands each block the totals of the pairs it has; there the
bitmaps are the postings through which totals go back to the documents.

Both tokenizers cut before a blank that follows something other than white space, so a text is split
there and each distinct word of a block is encoded and aligned once.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.arrays import flat, prefixes, slices, span_hashes
from corpusflow.llm.bpe import _BLANKS, pieces_of
from corpusflow.llm.word_table import bytes_at, pack, unpack
from corpusflow.llm.workers import begin
from corpusflow.session import materialized

BLOCK = 32_000_000
#: Documents of a block: their numbers take 16 bits.
DOCS = 1 << 16
#: Bytes of input that one task reads at least, where cores do not wait for it.
TASK = 16_000_000
_MARK = "▁"
_WIDE_BLANKS = [c.encode() for c in _BLANKS if ord(c) >= 0x80]
_encoders: dict[tuple, object] = {}


# --- words and their alignment ------------------------------------------------------------------------------

def joint_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of blank + text for each text that is not empty, where words begin and end, and the text each belongs to."""
    empty = pc.equal(pc.binary_length(column), 0)
    data, offsets = flat(pc.if_else(empty, pa.scalar(None, column.type), pc.binary_join_element_wise(" ", column, "")))
    heads = offsets[:-1][np.diff(offsets) > 0]
    blank = np.flatnonzero(data == 0x20)
    before = blank[blank > 0] - 1
    cut = np.zeros(len(data), bool)
    cut[before + 1] = ~((data[before] == 0x20) | ((data[before] >= 9) & (data[before] <= 13)) | _ends_in_wide_blank(data, before))
    cut[heads] = True
    starts = np.flatnonzero(cut)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1


def _ends_in_wide_blank(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the characters that end at the places are white space of several bytes."""
    wide = np.flatnonzero(data[last] >= 0x80)
    at = last[wide].astype(np.int64)
    two = (data[at - 1].astype(np.int64) << 8) | data[at]  # a text begins with a blank: there is a byte before
    three = (data[np.maximum(at - 2, 0)].astype(np.int64) << 16) | two
    out = np.zeros(len(last), bool)
    out[wide] = (np.isin(two, [int.from_bytes(b) for b in _WIDE_BLANKS if len(b) == 2])
                 | np.isin(three, [int.from_bytes(b) for b in _WIDE_BLANKS if len(b) == 3]))
    return out


class Encoder:
    """Both tokenizers, and for each id of theirs the bytes it stands for."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = dict(pieces_of(vocabulary))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("pieces of this vocabulary go across blanks")
        self.lone = self.b.piece_to_id(_MARK)
        self.a_len = np.zeros(1 + max(self.a_bytes), np.int64)
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    @staticmethod
    def of(vocabulary: str, model: bytes) -> Encoder:
        """One per worker process."""
        key = (hash(vocabulary), hash(model))
        begin("alignment", _encoders.clear)
        if key not in _encoders:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _encoders.clear()
            _encoders[key] = Encoder(vocabulary, model)
        return _encoders[key]

    def align(self, words: list[bytes]) -> Aligned:
        """Words that begin with a blank; a word whose bytes either tokenizer does not give back has no tokens and is not valid."""
        texts = [w.decode() for w in words]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)] if words else []
        # the library puts a blank in front itself
        b = self.b.encode([t[1:] for t in texts], num_threads=1) if words else []
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        valid = np.ones(len(words), bool)
        for i, word in enumerate(words):
            b[i] = b[i] or [self.lone]
            if b"".join([b_bytes[x] for x in b[i]]) != word or b"".join([a_bytes[x] for x in a[i]]) != word:
                valid[i], a[i], b[i] = False, [], []
        n_a, n_b = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
        a_ids, b_ids = np.array([x for ids in a for x in ids], np.int64), np.array([x for ids in b for x in ids], np.int64)
        # ends of tokens on the axis of all words' bytes
        _, at_a, at_b = np.intersect1d(np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]), assume_unique=True, return_indices=True)
        pairs = (b_ids[at_b] << 32) | a_ids[at_a]
        groups = np.searchsorted(np.cumsum(n_a), at_a, "right")
        n_groups = np.bincount(groups, minlength=len(words))
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        parts, i, j = [], 0, 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            parts.append(",".join(a_text[i:x]) + "|" + ",".join(b_text[j:y]))
            i, j = x, y
        edges = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        strings = [";".join(parts[p:q]).encode() for p, q in zip(edges, edges[1:], strict=False)]
        return Aligned(valid, n_a, n_b, n_groups, pairs, strings)


@dataclass
class Aligned:
    """What is known of words: whether their bytes come back, numbers of tokens and groups, linked pairs and groups written out."""
    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray
    strings: list[bytes]


class WordTable:
    """The distinct words of a block, each aligned once."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.keys, self.rows = encoder, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.all = Aligned(*(np.zeros(0, k) for k in (bool, np.int64, np.int64, np.int64, np.int64)), [])
        self.text = np.zeros(0, object)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rows of words in ``all``; words not seen before are added."""
        hashes = span_hashes(prefixes(data), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == distinct[inside]
        if not old.all():
            new = first[~old]
            found = self.encoder.align(bytes_at(data, starts[new], ends[new]))
            have = self.all
            fresh = len(have.valid) + np.arange(len(new))
            self.all = Aligned(*(np.concatenate([x, y]) for x, y in zip(list(vars(have).values())[:-1], list(vars(found).values())[:-1], strict=True)), [])
            self.text = np.concatenate([self.text, np.array([*found.strings, None], object)[:-1]])
            self.offsets = np.concatenate([[0], np.cumsum(self.all.n_groups)])
            self.keys, self.rows = np.concatenate([self.keys, distinct[~old]]), np.concatenate([self.rows, fresh])
            order = np.argsort(self.keys)
            self.keys, self.rows = self.keys[order], self.rows[order]
            at = np.searchsorted(self.keys, distinct)
        return self.rows[at][inverse]


# --- bitmaps ----------------------------------------------------------------------------------------------------

@dataclass
class Bitmap:
    """Bitmaps of documents, one per pair: document numbers in order, pair by pair."""
    pairs: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, pairs: np.ndarray) -> Bitmap:
        """From distinct sorted numbers (place in ``pairs`` << 16 | document)."""
        places = entries >> 16
        first = np.flatnonzero(np.diff(places, prepend=-1))
        return Bitmap(pairs[places[first]], np.diff(np.append(first, len(entries))), (entries & 0xFFFF).astype(np.uint16))

    @staticmethod
    def union(maps: list[Bitmap]) -> Bitmap:
        """OR, pair by pair."""
        pairs = np.unique(np.concatenate([m.pairs for m in maps])) if maps else np.zeros(0, np.int64)
        entries = [(np.repeat(np.searchsorted(pairs, m.pairs), m.sizes) << 16) | m.docs for m in maps]
        return Bitmap.of(np.unique(np.concatenate(entries)) if maps else np.zeros(0, np.int64), pairs)

    def to_bytes(self, n_docs: int) -> bytes:
        """A list of numbers per pair, or a bit per document where that is shorter."""
        dense = self.sizes * 16 > n_docs
        each = np.repeat(dense, self.sizes)
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        bits = np.zeros((int(dense.sum()), -(-n_docs // 8) * 8), bool)
        for row, i in enumerate(np.flatnonzero(dense).tolist()):
            bits[row, self.docs[edges[i]:edges[i + 1]]] = True
        return pack(self.pairs, np.where(dense, -1, self.sizes).astype(np.int32), self.docs[~each], np.packbits(bits, axis=1), np.array([n_docs], np.int64))

    @staticmethod
    def from_bytes(value: bytes) -> Bitmap:
        pairs, sizes, docs, bits, (n_docs,) = unpack(value, np.int64, np.int32, np.uint16, np.uint8, np.int64)
        dense = np.flatnonzero(sizes < 0)
        rows, places = np.nonzero(np.unpackbits(bits.reshape(len(dense), -1), axis=1)) if len(dense) else (np.zeros(0, np.int64),) * 2
        counts = sizes.astype(np.int64)
        counts[dense] = np.bincount(rows, minlength=len(dense))
        out = np.empty(int(counts.sum()), np.uint16)
        each = np.repeat(sizes < 0, counts)
        out[each], out[~each] = places, docs
        return Bitmap(pairs, counts, out)


class Postings:
    """Multiplicity planes of a block."""

    def __init__(self):
        self.planes: list[list[Bitmap]] = []

    def add(self, docs: np.ndarray, links: np.ndarray) -> None:
        """Links (pairs) of documents whose links are all given at once."""
        pairs, place = np.unique(links, return_inverse=True)
        entries, times = np.unique((place << 16) | docs, return_counts=True)
        k = 0
        while len(entries):
            if len(self.planes) == k:
                self.planes.append([])
            bit = (times >> k) & 1 == 1
            self.planes[k].append(Bitmap.of(entries[bit], pairs))
            more = times >> (k + 1) > 0
            entries, times, k = entries[more], times[more], k + 1
        for k, maps in enumerate(self.planes):
            if len(maps) > 8:
                self.planes[k] = [Bitmap.union(maps)]

    def merged(self) -> list[Bitmap]:
        return [Bitmap.union(maps) for maps in self.planes]


def pair_counts(planes: list[Bitmap]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, and of each the documents (population of all planes OR-ed) and the links (planes by weight)."""
    every = Bitmap.union(planes)
    links = np.zeros(len(every.pairs), np.int64)
    for k, plane in enumerate(planes):
        links[np.searchsorted(every.pairs, plane.pairs)] += plane.sizes << k
    return every.pairs, every.sizes, links


def exact_sums(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers per place; halves are summed apart, so that no digit is lost in floating point."""
    low, high = values & 0x3FFFFFF, values >> 26
    return (np.bincount(places, low, n).astype(np.int64) + (np.bincount(places, high, n).astype(np.int64) << 26))


def scores(planes: list[Bitmap], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: links, links that are the best of their B id, and the sum of their pairs' counts; read off the postings."""
    out = np.zeros((3, n_docs), np.int64)
    for k, plane in enumerate(planes):
        own = np.searchsorted(pairs, plane.pairs)
        edges = np.concatenate([[0], np.cumsum(plane.sizes)])
        step = max(1, len(plane.pairs) // max(1, len(plane.docs) // 1_000_000))
        for a in range(0, len(plane.pairs), step):
            part = slice(a, a + step)
            docs = plane.docs[edges[a]:edges[min(a + step, len(plane.pairs))]]
            sizes = plane.sizes[part]
            out[0] += np.bincount(docs, minlength=n_docs) << k
            out[1] += np.bincount(docs[np.repeat(best[own[part]], sizes)], minlength=n_docs) << k
            out[2] += exact_sums(docs, np.repeat(counts[own[part]], sizes), n_docs) << k
    return out[0], out[1], out[2]


# --- Spark ----------------------------------------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], encoder: Encoder, size: int, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, nr = context.partitionId() if context else 0, 0

    def row() -> pa.RecordBatch:
        planes = postings.merged()
        keys, documents, links = pair_counts(planes)
        numbers = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*columns, strict=True)] or [np.zeros(0, np.int64)] * 3
        values = [f"{part}-{nr}", pa.concat_arrays(ids), digests, pack(*numbers), pack(keys, documents, links), [p.to_bytes(n) for p in planes]]
        own = pa.array([0, len(values[1])], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([values[0]]), pa.ListArray.from_arrays(own, values[1]), pa.ListArray.from_arrays(own, pa.array(digests, pa.string())),
             *(pa.array([v], pa.binary()) for v in values[3:5]), pa.array([values[5]], pa.list_(pa.binary()))],
            ["block", "ids", "digests", "numbers", "counts", "planes"])

    def fresh():
        return Postings(), WordTable(encoder), [], [], [], 0, 0

    postings, table, ids, digests, columns, n, held = fresh()
    for batch in batches:
        for a, b in slices(batch.column(1)):
            for c in range(a, b, DOCS // 4):
                column, m = batch.column(1).slice(c, min(b - c, DOCS // 4)), min(b - c, DOCS // 4)
                if n + m > DOCS:
                    yield row()
                    nr += 1
                    postings, table, ids, digests, columns, n, held = fresh()
                data, starts, ends, text = joint_words(column)
                words = table.find(data, starts, ends)
                whole = np.ones(m, bool)
                whole[text[~table.all.valid[words]]] = False
                words, text = words[whole[text]], text[whole[text]]
                edges = np.searchsorted(text, np.arange(m + 1))
                columns.append([np.diff(np.concatenate([[0], np.cumsum(x[words])])[edges]) for x in (table.all.n_a, table.all.n_b, table.all.n_groups)])
                strings = table.text[words].tolist()
                for p, q in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                    line = b";".join(strings[p:q])
                    digests.append(line.decode() if keep_groups else hashlib.sha256(line).hexdigest() if line else "")
                times = table.all.n_groups[words]
                places = np.arange(times.sum()) + np.repeat(table.offsets[words] - np.concatenate([[0], np.cumsum(times)])[:-1], times) if len(words) else words
                postings.add(np.repeat(n + text, times), table.all.pairs[places])
                ids.append(batch.column(0).slice(c, m))
                n, held = n + m, held + len(data)
                if held >= size:
                    yield row()
                    nr += 1
                    postings, table, ids, digests, columns, n, held = fresh()
    if n:
        yield row()


def _gathered(docs: DataFrame) -> DataFrame:
    """A table in many small parts is read in fewer tasks, so that blocks are of a size; larger parts stay as they are."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK))
    return docs.coalesce(tasks) if docs.rdd.getNumPartitions() > tasks else docs


def align_tokens(docs: DataFrame, vocabulary: str, model: bytes, keep_groups: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the table of pairs (a_id, b_id, n_docs, n_links, best).

    ``vocabulary`` (A) and ``model`` (B) are the contents of vocabulary files. Per row of ``docs`` (doc_id, text): tokens of
    blank + text by A and of text by B (which puts the blank there itself), groups, links, links that are the most frequent of
    their B id in the corpus (ties included), the sum of the links' counts, and the SHA-256 of the groups written out (with
    ``keep_groups`` the groups themselves as well). Special tokens' strings are plain text. Null and empty texts, and texts
    that either tokenizer does not give back byte by byte, have no tokens: zeros and ''. Repeated rows count each for itself,
    a text of any length is worked whole, an empty table gives no rows, other columns are left out.
    """
    spark = docs.sparkSession
    docs = _gathered(docs.select("doc_id", "text"))
    id_type = docs.schema[0].dataType.simpleString()
    sent = spark.sparkContext.broadcast((vocabulary, model))

    def blocks(batches):
        yield from _blocks(batches, Encoder.of(*sent.value), block, keep_groups)

    stored = materialized(docs.mapInArrow(
        blocks, f"block string, ids array<{id_type}>, digests array<string>, numbers binary, counts binary, planes array<binary>"), "blocks")

    def counted(batches):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, documents, links = unpack(value.as_py(), np.int64, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array((keys >> 32).astype(np.int32)),
                     pa.array(documents), pa.array(links)], ["block", "a_id", "b_id", "n_docs", "n_links"])

    in_blocks = stored.select("block", "counts").mapInArrow(counted, "block string, a_id int, b_id int, n_docs bigint, n_links bigint")
    most = F.max("n_links").over(Window.partitionBy("b_id"))
    pairs = materialized(in_blocks.groupBy("a_id", "b_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
                         .withColumn("best", F.col("n_links") == most), "pairs")
    back = in_blocks.select("block", "a_id", "b_id").join(pairs.select("a_id", "b_id", "n_links", "best"), ["a_id", "b_id"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = (right.column("b_id").to_numpy().astype(np.int64) << 32) | right.column("a_id").to_numpy()
        order = np.argsort(keys)
        counts, best = right.column("n_links").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]
        tables = []
        for i in range(left.num_rows):
            ids, digests = left.column("ids")[i].values, left.column("digests")[i].values
            n_a, n_b, n_groups = unpack(left.column("numbers")[i].as_py(), np.int64, np.int64, np.int64)
            planes = [Bitmap.from_bytes(p) for p in left.column("planes")[i].as_py()]
            n_links, n_best, count_sum = scores(planes, keys[order], counts, best, len(ids))
            if keep_groups:
                own = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in digests.to_pylist()]
            values = [ids, n_a, n_b, n_groups, n_links, n_best, count_sum, *([pa.array(own, pa.string())] if keep_groups else []), digests]
            tables.append(pa.table([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=names))
        return pa.concat_tables(tables) if tables else pa.table({})

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    kinds = [id_type, *["bigint"] * 6, "string", *(["string"] if keep_groups else [])]
    documents = stored.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return documents, pairs
