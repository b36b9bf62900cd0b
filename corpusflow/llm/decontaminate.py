"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

A window is ten consecutive words of an item; an item of fewer words is one window. Documents are
normalised to lower-case words with single blanks between them and read once; a match is a run of
words, whose places in the original text come from the places of its words.

A benchmark too large for one automaton is cut into parts by Spark. The documents are read once per part;
what is found is kept by the digest of the text, on which alone it depends, and put together at the end.
"""
from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrays import Texts, in_slices, struct
from corpusflow.llm.workers import begin
from corpusflow.session import materialized, scratch_path

WORDS = 10
#: Windows of one automaton (about 100 bytes and a few hundred trie nodes each), and of one part of a benchmark.
MAX_WINDOWS = 200_000
#: Texts with hits whose digests are sent to every task.
BROADCAST_TEXTS = 1_000_000
# Fixed value: word bytes are digits, letters and everything outside ASCII.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if _IS_WORD[b] else 0x20 for b in range(256))

SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
#: Hits of one part; spans also by the numbers of their words, to put together what several parts cover.
_PART = "items array<string>, spans array<struct<first:int,last:int,start:int,end:int>>"


#: Longer words stand in the automaton by a digest, which no text can spell.
LONG = 64


def _short(words: list[bytes]) -> list[bytes]:
    return [w if len(w) <= LONG else b"\x00" + hashlib.sha256(w).hexdigest().encode() for w in words]


def words_of(text: str | None) -> list[bytes]:
    return _short(text.encode().translate(_NORMAL).split()) if text else []


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(windows, key: str) -> ahocorasick.Automaton:
    """Built once per worker and set of windows."""
    begin("windows", _automata.clear)
    if key not in _automata:
        _automata.clear()
        automaton = ahocorasick.Automaton()
        for window, items in windows.value.items():
            automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
        automaton.make_automaton()
        _automata[key] = automaton
    return _automata[key]


def _scan(column: pa.Array, windows, key: str, numbered: bool = False) -> pa.StructArray:
    """Hits of each text; with the numbers of the words of each span where they are asked for."""
    texts = Texts(column)
    starts, ends, doc = texts.spans(_IS_WORD[texts.data])
    n_words = np.bincount(doc, minlength=texts.n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])
    n_hit = np.zeros(texts.n, np.int64)
    found: list[list[str]] = [[] for _ in range(texts.n)]
    spans: list[list[dict]] = [[] for _ in range(texts.n)]
    automaton = _automaton(windows, key) if windows.value else None
    has_long = np.zeros(texts.n, bool)
    has_long[doc[ends - starts > LONG]] = True
    for i in np.flatnonzero(n_words) if automaton is not None else ():
        raw = texts.data[texts.offsets[i]:texts.offsets[i + 1]].tobytes()
        # one character per byte; each word ends before the blank that the next one shares
        own = raw.translate(_NORMAL).split()
        line = b" " + b" ".join(_short(own) if has_long[i] else own) + b" "
        hits = list(automaton.iter(line.decode("latin-1")))
        if not hits:
            continue
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        last = np.searchsorted(blanks, [end for end, _ in hits])  # the words up to the blank where a match ends
        covered = np.zeros(n_words[i], bool)
        items = set()
        for stop, (_, (width, names)) in zip(last, hits, strict=True):
            covered[stop - width:stop] = True
            items.update(names)
        n_hit[i] = covered.sum()
        found[i] = sorted(items)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to a byte
        for a, b in edges.reshape(-1, 2):
            start, end = (int(p - texts.offsets[i]) for p in (starts[first[i] + a], ends[first[i] + b - 1]))
            spans[i].append({"start": int(points[start]) - 1, "end": int(points[end - 1])} | ({"first": int(a), "last": int(b)} if numbered else {}))
    names = ("first", "last", "start", "end") if numbered else ("start", "end")
    span = pa.list_(pa.struct([(name, pa.int32()) for name in names]))
    return struct(n_words=n_words, n_hit=n_hit, items=pa.array(found, pa.list_(pa.string())), spans=pa.array(spans, span))


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_hits``: words, hit words, items found and the hit spans in code points.

    ``benchmark`` (item_id, text) is a fixed test set of any length. Its windows are cut and counted by Spark before they are
    sent to the tasks; one beyond ``MAX_WINDOWS`` is refused here, ``contamination`` and ``drop_contaminated``
    work through it in parts. Null texts and null items have no words; repeated items count once per id, a null id as ``null``.
    """
    spark = docs.sparkSession
    rows = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
            .mapInArrow(_window_rows(width), "window binary, item string").distinct().limit(MAX_WINDOWS + 1).collect())
    if len(rows) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows; give the benchmark in parts")
    windows: dict[bytes, list[str]] = {}
    for window, item in rows:
        windows.setdefault(bytes(window), []).append(item)
    sent, key = spark.sparkContext.broadcast(windows), uuid.uuid4().hex

    @F.arrow_udf(SCHEMA)
    def scan(column: pa.Array) -> pa.Array:
        return in_slices(column, lambda part: _scan(part, sent, key))

    return docs.withColumn("_hits", scan(F.col(text_col)))


def _fits(benchmark: DataFrame, width: int, limit: int) -> bool:
    """Whether a benchmark has no more than ``limit`` windows, counted without those that repeat left out."""
    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        sizes = (len(words_of(text)) for text in column.to_pylist())
        return pa.array([max(1, n - width + 1) if n else 0 for n in sizes], pa.int64())

    return benchmark.select(count(F.col("text")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= limit


def _window_rows(width: int):
    """(window, item) of batches of (item, text), some thousand at a time."""
    def rows(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = max(1, len(words) - width + 1) if words else 0
                for at in range(0, n, 10_000):
                    found = [b" ".join(words[i:i + width]) for i in range(at, min(at + 10_000, n))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["window", "item"])

    return rows


def _digest(text: str):
    """SHA-256 of a text; null for null."""
    return F.sha2(F.col(text).cast("binary"), 256)


def _part_scan(sent, key: str):
    @F.arrow_udf(_PART)
    def scan(column: pa.Array) -> pa.Array:
        def work(texts: pa.Array) -> pa.StructArray:
            hits = _scan(texts, sent, key, True)
            return struct(items=hits.field("items"), spans=hits.field("spans"))

        return in_slices(column, work)

    return scan


def _hits_in_parts(texts: DataFrame, benchmark: DataFrame, width: int, limit: int) -> DataFrame:
    """(_text, items, spans) of each part of ``benchmark`` that a text of ``texts`` (_text, text) has hits of.

    A part has ``limit`` pairs of a window and an item or a few more, so a window that many items have is
    spread over parts. Only one part at a time is on the driver.
    """
    spark = texts.sparkSession
    pairs = materialized(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
                         .mapInArrow(_window_rows(width), "window binary, item string").distinct(), "windows")
    n_parts = max(1, -(-pairs.count() * 11 // (10 * limit)))  # a tenth of slack for uneven hashes
    path, found = scratch_path(spark, "window_parts"), scratch_path(spark, "hits")
    (pairs.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(n_parts))).repartition(F.col("part"))
     .write.partitionBy("part").parquet(path))
    stored = spark.read.schema("window binary, item string, part long").parquet(path)
    schema = f"_text string, {_PART}"
    spark.createDataFrame([], schema).write.parquet(found)
    for part in range(n_parts):
        windows: dict[bytes, list[str]] = {}
        for window, item in stored.where(F.col("part") == part).select("window", "item").toLocalIterator():
            windows.setdefault(bytes(window), []).append(item)
        sent = spark.sparkContext.broadcast(windows)
        (texts.withColumn("_hits", _part_scan(sent, uuid.uuid4().hex)(F.col("text"))).where(F.size("_hits.items") > 0).select("_text", "_hits.*")
         .dropDuplicates(["_text"]).write.mode("append").parquet(found))
        sent.destroy()
    return spark.read.schema(schema).parquet(found)


def _united(hits: DataFrame) -> DataFrame:
    """(_text, n_hit, items, spans) from the parts' hits: all items, and the words that any part covers."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("n_hit long, spans array<struct<start:int,end:int>>")
    def unite(column: pa.Array) -> pa.Array:
        n_hit, spans = [], []
        for parts in column.to_pylist():
            runs: list[list[int]] = []
            for s in sorted((s["first"], s["last"], s["start"], s["end"]) for part in parts for s in part):
                if runs and s[0] <= runs[-1][1]:  # they overlap or touch
                    if s[1] > runs[-1][1]:
                        runs[-1][1], runs[-1][3] = s[1], s[3]
                else:
                    runs.append(list(s))
            n_hit.append(sum(r[1] - r[0] for r in runs))
            spans.append([{"start": r[2], "end": r[3]} for r in runs])
        return struct(n_hit=pa.array(n_hit, pa.int64()), spans=pa.array(spans, span))

    grouped = hits.groupBy("_text").agg(F.collect_list("spans").alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return grouped.withColumn("_u", unite(F.col("_spans"))).select("_text", "_u.n_hit", "items", "_u.spans")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_TEXTS else table


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, limit: int = MAX_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, words, hit words, items found, their digest and whether any was hit.

    A benchmark of up to ``limit`` windows needs no shuffle: each text is read once against the automaton. Of a
    larger one the texts are read once per ``limit`` windows, and what is found is joined by the texts' digests.
    Null and empty texts have no words and are clean; repeated rows are judged each for itself; empty tables give
    no rows or no hits.
    """
    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in column.to_pylist()], pa.string())

    docs = docs.select("doc_id", "text")
    if _fits(benchmark, width, limit):
        hits = find_windows(docs, benchmark, width).select("doc_id", "_hits.*")
    else:
        keyed = docs.withColumn("_text", _digest("text"))
        found = materialized(_united(_hits_in_parts(keyed.select("_text", "text"), benchmark, width, limit)), "hits")
        words = find_windows(keyed, benchmark.limit(0), width).select("doc_id", "_text", "_hits.n_words")
        hits = words.join(_small(found), "_text", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, limit: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a hit word, whatever the size of ``benchmark``."""
    columns = docs.columns
    if _fits(benchmark, width, limit):
        return find_windows(docs, benchmark, width).where("_hits.n_hit = 0").select(*columns)
    hits = _hits_in_parts(docs.select(_digest("text").alias("_text"), "text"), benchmark, width, limit)
    hit = materialized(hits.select("_text").distinct(), "hit").withColumnRenamed("_text", "_hit_text")
    return docs.join(_small(hit), _digest("text") == F.col("_hit_text"), "left_anti").select(*columns)
