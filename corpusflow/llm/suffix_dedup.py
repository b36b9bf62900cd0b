"""Removal of repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Equal strings meet in
one shard by content: every string has an anchor, the leftmost ``GRAM``-byte window whose hash is least
in it, and strings with one anchor in a document are neighbours, a *segment*. Segments whose anchor
occurs once cannot repeat. Segments that are equal as a whole repeat as a whole. The others, cut from
their texts, go to the shard of their anchor, where a suffix array (Larsson-Sadakane refinement) and
common prefixes (Kasai) show which of their strings occur twice, a few anchors at a time. Of an anchor with more segments than a
shard holds, digests of all strings are shuffled by range instead, and equal ones are found in each range;
no suffix array is built for it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrays import SLICE, Texts, combine, flat, prefixes, slices, span_hashes, window_hashes
from corpusflow.llm.workers import give_back
from corpusflow.session import materialized

LENGTH = 200
GRAM = 32
#: Bytes of segments in one shard.
SHARD_BYTES = 3_000_000
#: Bytes of a shard's segments whose suffixes are sorted at a time: a suffix array takes about 90 times as much.
PIECE_BYTES = 500_000
#: Bytes of segments whose strings are digested at a time, and strings that one task merges.
DIGEST_BYTES, MERGED_STRINGS = 200_000, 1_000_000
#: Different segments of one anchor in one shard.
ANCHOR_SEGMENTS = 4_000

_ANCHORS = "k1 long, k2 long, gram long, seg long, begin int, starts int, whole boolean"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:])


def segments(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, segment hash, first string and number of strings of each segment."""
    n = len(texts.data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = prefixes(texts.data)
    hashes = window_hashes(prefix, gram)
    low = np.uint64(0xFFFFFFFF)
    place = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    # strings that begin and end in one document
    size = np.diff(texts.offsets)
    turns = np.zeros(n + 1, np.int64)
    full = size >= length
    np.add.at(turns, texts.offsets[:-1][full], 1)
    np.add.at(turns, texts.offsets[1:][full] - length + 1, -1)
    valid = np.cumsum(turns)[:len(place)] > 0
    change = np.ones(len(place) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    begin, end = begin[valid[begin]], end[valid[begin]]
    doc = texts.doc_of(begin)
    seg = span_hashes(prefix, begin, end - 1 + length)
    return doc, hashes[place[begin]].view(np.int64), seg.view(np.int64), begin - texts.offsets[doc], end - begin


def _anchors(length: int, gram: int):
    def rows(batches):
        for batch in batches:
            k1, k2, column = (batch.column(i) for i in range(3))
            for a, b in slices(column, SLICE):
                texts = Texts(column.slice(a, b - a))
                doc, anchor, seg, begin, starts = segments(texts, length, gram)
                one, two = (np.asarray(k.slice(a, b - a)) for k in (k1, k2))
                # equal segments of one slice (a word repeated for pages) repeat as a whole: one of them is
                # enough for the others' sake, and neighbouring ones make up one run
                key = combine(anchor.view(np.uint64), seg.view(np.uint64))
                order = np.argsort(key, kind="stable")
                same = np.zeros(len(key) + 1, bool)
                same[1:-1] = key[order][1:] == key[order][:-1]
                whole, again = np.empty(len(key), bool), np.empty(len(key), bool)
                whole[order], again[order] = same[1:] | same[:-1], same[:-1]
                yield _batch(one[doc], two[doc], anchor, seg, begin, starts, whole, ~again)
                at = np.flatnonzero(whole)
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = (doc[at][1:] != doc[at][:-1]) | (begin[at][1:] != (begin + starts)[at][:-1])
                    first = np.flatnonzero(new)
                    runs = np.add.reduceat(starts[at], first)
                    at = at[first]
                    yield _batch(one[doc[at]], two[doc[at]], None, None, begin[at], runs, np.ones(len(at), bool), np.ones(len(at), bool))

    return rows


def _batch(k1, k2, anchor, seg, begin, starts, whole, keep) -> pa.RecordBatch:
    n = int(keep.sum())
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x)[keep].astype(np.int64)) for x in (k1, k2, anchor, seg)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(begin[keep].astype(np.int32)), pa.array(starts[keep].astype(np.int32)), pa.array(whole[keep])],
                                      ["k1", "k2", "gram", "seg", "begin", "starts", "whole"])


def _repeated(batches):
    """Segments whose anchor is not alone, from a partition that holds anchors side by side.

    ``whole``: the segment occurs again as it is. ``send``: its text is asked for, one of each kind, as the
    anchor has several. What the partition's edges cut is sent as well; the shards see all of it.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    cols = {name: np.asarray(table.column(name).combine_chunks()) for name in table.column_names}
    order = np.lexsort((cols["k2"], cols["k1"], cols["seg"], cols["gram"]))
    cols = {k: v[order] for k, v in cols.items()}
    gram, seg, n = cols["gram"], cols["seg"], len(order)
    new_gram = np.ones(n, bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new_seg = new_gram.copy()
    new_seg[1:] |= seg[1:] != seg[:-1]
    group, kind = np.cumsum(new_gram) - 1, np.cumsum(new_seg) - 1
    kinds = np.bincount(group[new_seg])[group]
    copies = np.bincount(kind)[kind]
    cut = (gram == gram[0]) | (gram == gram[-1])
    whole = (copies > 1) | cols["whole"]
    send = new_seg & ((kinds > 1) | cut)
    keep = whole | send | (kinds > 1) | cut
    out = [pa.array(cols[c][keep]) for c in ("k1", "k2", "gram", "seg", "begin", "starts")]
    yield pa.RecordBatch.from_arrays([*out, pa.array(whole[keep]), pa.array(send[keep])], ["k1", "k2", "gram", "seg", "begin", "starts", "whole", "send"])


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the rank of each; a suffix ends at ``ends``, equal ones stand by place.

    Larsson and Sadakane: groups that are equal so far are refined by the ranks of what follows, the
    compared length doubles each time, and suffixes that are alone are not touched again.
    """
    n = len(data)
    places = np.arange(n, dtype=np.int64)
    key = np.zeros(n, np.int64)
    for step in range(7):  # nine bits a byte; what lies past the end sorts first
        at = places + step
        symbol = np.zeros(n, np.int64)
        inside = at < ends
        symbol[inside] = data[at[inside]].astype(np.int64) + 1
        key = (key << 9) | symbol
    order = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)

    def regroup(slots: np.ndarray, ranked: np.ndarray) -> None:
        """New ranks for the suffixes in ``slots``: the slot where their group begins."""
        new = np.ones(len(slots), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        rank[order[slots]] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]

    slots, done = np.arange(n), 7
    longest = int((ends - places).max()) if n else 0
    regroup(slots, key[order])
    del key
    while done < longest and len(slots):
        heads = rank[order[slots]]
        equal = np.zeros(len(slots) + 1, bool)
        equal[1:-1] = heads[1:] == heads[:-1]
        slots = slots[equal[1:] | equal[:-1]]
        if not len(slots):
            break
        own = order[slots].astype(np.int64)
        after = own + done
        follows = np.zeros(len(own), np.int64)
        inside = after < ends[own]
        follows[inside] = rank[after[inside]].astype(np.int64) + 1
        key = (rank[own].astype(np.int64) << 32) | follows
        sort = np.argsort(key, kind="stable")
        order[slots] = own[sort]
        regroup(slots, key[sort])
        done *= 2
    rank[order] = np.arange(n, dtype=np.int32)
    return order, rank


def repeated_strings(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Marks the places of several texts where a string of ``length`` bytes begins that begins elsewhere too.

    Kasai's pass over common prefixes runs for all texts side by side: each place keeps all but one byte
    of the match of the place before.
    """
    ends = np.repeat(offsets[1:], np.diff(offsets))
    order, rank = suffix_array(data, ends)
    marked = np.zeros(len(data), bool)
    active = np.flatnonzero(np.diff(offsets) >= length)
    common = np.zeros(len(active), np.int64)
    step = 0
    while len(active):
        place = offsets[active] + step
        slot = rank[place]
        before = order[np.maximum(slot - 1, 0)].astype(np.int64)
        common = np.where(slot > 0, np.maximum(common - 1, 0), 0)
        open_ = np.flatnonzero(slot > 0)
        while len(open_):
            a, b = place[open_] + common[open_], before[open_] + common[open_]
            more = (common[open_] < length) & (a < ends[place[open_]]) & (b < ends[before[open_]])
            open_, a, b = open_[more], a[more], b[more]
            same = data[a] == data[b]
            open_ = open_[same]
            common[open_] += 1
        full = common >= length
        marked[place[full]] = True
        marked[before[full]] = True
        step += 1
        go = offsets[active + 1] - offsets[active] - step >= length
        active, common = active[go], common[go]
    return marked


def _pieces(gram: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of whole anchors, of about ``size`` bytes and at least one anchor each; ``gram`` is sorted."""
    edges = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
    places, at = offsets[edges], 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(places, places[at] + size, "right")) - 1)
        yield int(edges[at]), int(edges[end])
        at = end


def _marks(length: int, piece_bytes: int = PIECE_BYTES):
    """Per segment of a shard: the strings (by place) that occur elsewhere in the shard.

    Equal strings have one anchor, so a shard is worked piece by piece, however large it came out.
    """
    def work(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"gram": table.column("gram"), "seg": table.column("seg"), "places": pa.array([], pa.list_(pa.int32()))})
        table = table.select(["gram", "seg", "content"]).sort_by("gram").combine_chunks()
        data, offsets = flat(table.column("content").combine_chunks())
        counts, places = [], []
        for a, b in _pieces(np.asarray(table.column("gram").combine_chunks()), offsets, piece_bytes):
            own = offsets[a:b + 1] - offsets[a]
            found = np.flatnonzero(repeated_strings(data[offsets[a]:offsets[b]], own, length))
            of = np.searchsorted(own, found, "right") - 1
            counts.append(np.bincount(of, minlength=b - a))
            places.append((found - own[of]).astype(np.int32))
        give_back()
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.table({"gram": table.column("gram"), "seg": table.column("seg"), "places": pa.ListArray.from_arrays(ends, np.concatenate(places))})

    return work


def _strings(length: int):
    """Every string of segments as (gram, seg, place, two digests)."""
    def work(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), DIGEST_BYTES):
                gram, seg, content = (batch.column(i).slice(a, b - a) for i in range(3))
                data, offsets = flat(content)
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                row = np.repeat(np.arange(b - a), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                raw = data.tobytes()
                digests = b"".join([hashlib.blake2b(raw[p:p + length], digest_size=16).digest() for p in (offsets[row] + place).tolist()])
                d1, d2 = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64).T
                yield pa.RecordBatch.from_arrays([gram.take(pa.array(row)), seg.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(d1), pa.array(d2)],
                                                 ["gram", "seg", "place", "d1", "d2"])

    return work


def _merge(batches):
    """Strings of crowded anchors, by digest, side by side in a partition: those found twice.

    Strings that the partition's edges cut are kept as well, to be settled by ``_edges``.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    d1, d2 = (np.asarray(table.column(c).combine_chunks()) for c in ("d1", "d2"))
    key = combine(d1.view(np.uint64), d2.view(np.uint64))
    ranked = np.sort(key)
    twice = np.searchsorted(ranked, key, "right") - np.searchsorted(ranked, key, "left") > 1
    last = np.lexsort((d2, d1))[[0, -1]]
    edge = ((d1 == d1[last[0]]) & (d2 == d2[last[0]])) | ((d1 == d1[last[1]]) & (d2 == d2[last[1]]))
    keep = twice | edge
    yield from table.filter(pa.array(keep)).append_column("twice", pa.array(twice[keep])).to_batches()


def _segment_marks(sent: DataFrame, length: int, shard_bytes: int, anchor_segments: int) -> DataFrame:
    """(gram, seg, places) of every sent segment that has a repeated string; places is null for all of them."""
    kinds = materialized(sent.groupBy("gram", "seg").agg(F.count("*").alias("n"), F.first("content").alias("content")), "segments")
    total = kinds.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    crowded = kinds.groupBy("gram").agg(F.count("*").alias("_m")).where(F.col("_m") > anchor_segments).select("gram")
    crowded = materialized(crowded, "crowded")
    alone = kinds.join(crowded, "gram", "left_anti")
    marks = (alone.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard")
             .applyInArrow(_marks(length), "gram long, seg long, places array<int>"))
    strings = (kinds.join(crowded, "gram", "left_semi").select("gram", "seg", "content")
               .mapInArrow(_strings(length), "gram long, seg long, place int, d1 long, d2 long"))
    if crowded.isEmpty():
        merged = marks
    else:
        strings = materialized(strings, "strings")
        parts = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-strings.count() // MERGED_STRINGS))
        found = materialized(strings.repartitionByRange(parts, "d1", "d2", "seg", "place").mapInArrow(
            _merge, "gram long, seg long, place int, d1 long, d2 long, twice boolean"), "merged")
        edges = found.where("not twice").groupBy("d1", "d2").agg(F.count("*").alias("_n"))
        # a cut string is found again in the partition on the other side of the cut
        again = edges.where("_n > 1").select("d1", "d2").union(found.where("twice").select("d1", "d2")).distinct()
        cut = found.where("not twice").join(again, ["d1", "d2"], "left_semi")
        merged = marks.unionByName(found.where("twice").select("gram", "seg", "place").union(cut.select("gram", "seg", "place"))
                                   .groupBy("gram", "seg").agg(F.sort_array(F.collect_set("place")).alias("places")))
    whole = kinds.where("n > 1").select("gram", "seg", F.lit(None).cast("array<int>").alias("places"))
    return whole.unionByName(merged.where("size(places) > 0").join(whole, ["gram", "seg"], "left_anti"))


def _cut(content: np.ndarray, runs: list[tuple[int, int]], length: int) -> tuple[int, list[tuple[int, int]], str]:
    """Removed bytes, removed spans and a digest of the rest, from runs (first string, number of strings)."""
    spans: list[list[int]] = []
    for begin, starts in sorted(runs):
        end = begin + starts - 1 + length
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    keep = np.ones(len(content), bool)
    for a, b in spans:
        keep[a:b] = False
    return int((~keep).sum()), spans, hashlib.sha256(content[keep].tobytes()).hexdigest()


def _first_pass(length: int):
    """Rows that are settled, and for the others their text, their runs so far and the segments to send."""
    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(3))
            cols: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "text", "runs", "open", "sent")}
            for i, found in enumerate(batch.column(4).to_pylist()):
                content = data[offsets[i]:offsets[i + 1]]
                found = found or []
                runs = [(r["begin"], r["starts"]) for r in found if r["whole"]]
                rest = [r for r in found if not r["whole"]]
                sent = [r for r in found if r["send"]]
                removed, spans, digest = (None, [], None) if rest else _cut(content, runs, length)
                cols["n_removed"].append(removed)
                cols["n_spans"].append(None if rest else len(spans))
                cols["kept_sha256"].append(digest)
                cols["text"].append(content.tobytes() if rest else None)
                cols["runs"].append([{"begin": a, "starts": b} for a, b in runs] if rest else None)
                cols["open"].append([{"gram": r["gram"], "seg": r["seg"], "begin": r["begin"], "starts": r["starts"]} for r in rest])
                cols["sent"].append([{"gram": r["gram"], "seg": r["seg"], "content": content[r["begin"]:r["begin"] + r["starts"] - 1 + length].tobytes()}
                                     for r in sent])
            run = pa.list_(pa.struct([("begin", pa.int32()), ("starts", pa.int32())]))
            kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text": pa.binary(), "runs": run,
                     "open": pa.list_(pa.struct([("gram", pa.int64()), ("seg", pa.int64()), ("begin", pa.int32()), ("starts", pa.int32())])),
                     "sent": pa.list_(pa.struct([("gram", pa.int64()), ("seg", pa.int64()), ("content", pa.binary())]))}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(np.diff(offsets)), *(pa.array(cols[c], kinds[c]) for c in cols)],
                ["doc_id", "k1", "k2", "n_bytes", *cols])

    return work


def _last_pass(length: int):
    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            removed, spans, digests = [], [], []
            for i, (first, later) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                runs = [(r["begin"], r["starts"]) for r in [*(first or []), *(later or [])]]
                n, cut, digest = _cut(data[offsets[i]:offsets[i + 1]], runs, length)
                removed.append(n)
                spans.append(len(cut))
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                              pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return work


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                   anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """Per row of ``docs``: doc_id, bytes, removed bytes, removed runs and a digest of what is kept.

    Every row is a document of its own: rows that repeat (same id and text) are copies of each other, and
    texts of ``length`` bytes or more that occur twice go as a whole. Null and empty texts have no bytes; an
    empty table gives no rows; other columns are left out. Any id, null included, is returned as it is.
    Documents and strings are told apart by 128-bit hashes; equal anchors are compared byte by byte, or by
    two 64-bit hashes where whole segments agree.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text")
    anchors = materialized(keyed.select("k1", "k2", "text").mapInArrow(_anchors(length, gram), _ANCHORS), "anchors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (anchors.where("gram is not null").repartitionByRange(parts, "gram", "seg", "k1", "k2")
             .mapInArrow(_repeated, "k1 long, k2 long, gram long, seg long, begin int, starts int, whole boolean, send boolean"))
    ready = anchors.where("gram is null").select("k1", "k2", "gram", "seg", "begin", "starts", "whole", F.lit(False).alias("send"))
    # a set: rows that repeat agree in all but who sends
    runs = found.unionByName(ready).groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "starts", "whole", "send", "gram", "seg")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, "
              "runs array<struct<begin:int,starts:int>>, open array<struct<gram:long,seg:long,begin:int,starts:int>>, "
              "sent array<struct<gram:long,seg:long,content:binary>>")
    first = materialized(keyed.join(runs, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "found")
                         .mapInArrow(_first_pass(length), schema), "settled")
    sent = first.select(F.explode("sent").alias("_s")).select("_s.*")
    marks = materialized(_segment_marks(sent, length, shard_bytes, anchor_segments), "marks")
    every = F.array(F.struct(F.col("begin"), F.col("starts")))
    # places that follow each other would make one run each; strings of neighbouring places overlap anyway
    some = F.transform("places", lambda p: F.struct((F.col("begin") + p).alias("begin"), F.lit(1).alias("starts")))
    later = (first.where("kept_sha256 is null").select("k1", "k2", F.explode("open").alias("_o")).select("k1", "k2", "_o.*")
             .distinct().join(marks, ["gram", "seg"]).select("k1", "k2", F.when(F.col("places").isNull(), every).otherwise(some).alias("_r"))
             .groupBy("k1", "k2").agg(F.flatten(F.collect_list("_r")).alias("later")))
    rest = (first.where("kept_sha256 is null").join(later, ["k1", "k2"], "left").select("doc_id", "n_bytes", "text", "runs", "later")
            .mapInArrow(_last_pass(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return first.where("kept_sha256 is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(rest)
