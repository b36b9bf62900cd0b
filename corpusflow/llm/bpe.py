"""Byte-level BPE: encoding through a table of distinct words, decoding through an id-to-piece join."""
from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrays import flat, prefixes, span_hashes
from corpusflow.llm.word_table import Results, Words, per_word
from corpusflow.llm.workers import begin

LETTER, NUMBER, SPACE = 1, 2, 3
# Fixed value: the characters with the property White_Space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_tables: list[np.ndarray] = []
_tokenizers: dict[str, object] = {}


def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or (0) anything else."""
    if not _tables:
        from tokenizers.pre_tokenizers import ByteLevel

        def pieces(text: str) -> int:
            return len(pre.pre_tokenize_str(text))

        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        other = np.zeros(0x110000, np.uint8)
        every = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for match in regex.finditer(pattern, every):
                other[ord(match[0][0]):ord(match[0][-1]) + 1] = kind
        other[0xD800:0xE000] = 0
        pre = ByteLevel(add_prefix_space=False)
        for c in np.flatnonzero(table != other).tolist():  # two versions of Unicode differ: the tokenizer decides
            table[c] = LETTER if pieces("a" + chr(c)) == 1 else NUMBER if pieces("1" + chr(c)) == 1 else 0
        table[[ord(c) for c in _BLANKS]] = SPACE
        _tables.append(table)
    return _tables[0]


def word_starts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where words begin in a row of code points; ``heads`` are the places where texts begin.

    A word is a run of letters, of numbers or of other characters, with one blank before it if there is
    one; an apostrophe that begins a word takes an English ending; white space stands alone, its last
    character apart from the rest unless it ends the text.
    """
    n = len(points)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    begin = head.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begin)
    run_start, run_end = runs[:-1], runs[1:]
    gaps = (kind[run_start] == SPACE) & ~head[run_end]  # white space before something of the same text
    last = run_end[gaps] - 1
    blank = points[last] == 0x20
    begin[last] = True
    begin[last[blank] + 1] = False
    # endings: 's 't 'm 'd and 're 've 'll
    mark = np.flatnonzero(begin[:n] & (points == 0x27))
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
    one = points[mark + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    begin[mark[short] + 1] = False
    begin[mark[short] + 2] = True
    pairs = mark[~short & (mark + 2 < n)]
    pairs = pairs[~head[pairs + 2]]
    a, b = points[pairs + 1], points[pairs + 2]
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    begin[pairs[long] + 1] = False
    begin[pairs[long] + 3] = True
    return np.flatnonzero(begin[:n])


def splitter(special: str):
    """Words of texts; ``special`` is a word of its own wherever it stands."""
    parts_of = regex.compile(f"({regex.escape(special)})")

    def split(column: pa.Array) -> Words:
        begin("bpe", _tokenizers.clear)
        data, offsets = flat(column)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        ends = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        at_byte = np.concatenate([[0], ends])
        heads = np.searchsorted(at_byte, np.unique(offsets[:-1][np.diff(offsets) > 0]))
        if special.encode() in raw and pc.any(pc.match_substring(column, special)).as_py():
            cuts, at = [], 0
            for text in column.to_pylist():
                for part in parts_of.split(text or ""):
                    if part:
                        cuts.append((at, part == special, at + len(part)))
                    at += len(part)
            heads = np.array([a for a, _, _ in cuts])
            found = word_starts(points, heads)
            inside = np.zeros(len(points) + 1, np.int64)
            for a, alone, b in cuts:
                if alone:
                    inside[a + 1:b] = 1
            starts = found[inside[found] == 0]
        else:
            starts = word_starts(points, heads)
        first = at_byte[starts]
        last = np.append(first[1:], len(data))
        return Words(data, first, last, np.searchsorted(offsets, first, "right") - 1, span_hashes(prefixes(data), first, last))

    return split


def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    begin("bpe", _tokenizers.clear)
    if vocabulary not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[vocabulary] = Tokenizer.from_str(vocabulary)
        _tokenizers[vocabulary].no_truncation()
        _tokenizers[vocabulary].no_padding()
    return _tokenizers[vocabulary]


def word_encoder(vocabulary: str):
    """Ids of distinct words; ``vocabulary`` is the content of a vocabulary file."""
    def encode(words: list[bytes]) -> tuple:
        tokenizer = _tokenizer(vocabulary)  # looked up once: its key is the whole file
        found = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
        return np.array(list(map(len, found)), np.uint32), np.array([i for ids in found for i in ids], np.int32)

    return encode


def pieces_of(vocabulary: str) -> list[tuple[int, bytes]]:
    """The id-to-piece table: the bytes that each id stands for."""
    spec = json.loads(vocabulary)
    # the format writes printable bytes as themselves and the others as code points from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return sorted({i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if i not in added}.items() | added.items())


def special_of(vocabulary: str) -> str:
    tokens = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
    if len(tokens) != 1:
        raise ValueError("a vocabulary with one special token is asked for")
    return tokens[0]


def encode(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Per row of ``docs``: doc_id and its token ids. Null and empty texts have none."""
    def finish(results):
        def rows(ids, sizes, counts, places) -> pa.Table:
            got = results.take(places)
            edges = got.offsets[np.concatenate([[0], np.cumsum(counts)])]
            return pa.table({"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(got.values))})

        return rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_word(docs, splitter(special_of(vocabulary)), word_encoder(vocabulary), finish, f"doc_id {kind}, ids array<int>", **options)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of rows (doc_id, ids): ids are joined with the table of pieces, which has one row per id.

    Bytes that are no UTF-8 become U+FFFD. Null and empty lists give an empty text. Documents are keyed by doc_id.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(b)) for i, b in pieces_of(vocabulary)], "id int, piece binary")

    @F.arrow_udf("string")
    def join(column: pa.Array) -> pa.Array:
        return pa.array([b"".join(p).decode(errors="replace") for p in column.to_pylist()], pa.string())

    parts = (encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
             .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_p")))
    none = F.array().cast("array<binary>")
    return (encoded.select("doc_id").join(parts, "doc_id", "left")
            .select("doc_id", join(F.coalesce(F.transform("_p", lambda p: p["piece"]), none)).alias("text")))


def strung(parts: pa.LargeBinaryArray, results: Results) -> pa.LargeBinaryArray:
    """Of each list of numbers, the ``parts`` they stand for, one after the other."""
    data, edges = flat(parts.take(pa.array(results.values)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(results.offsets) - 1, [None, pa.py_buffer(edges[results.offsets]), pa.py_buffer(data)])


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, tokens, a digest of the ids and one of the text decoded from them.

    A block's distinct words come with their ids, whose pieces are looked up in the id-to-piece table, sent to the
    tasks; a document's ids and decoded text are strung together from its words. ``decode`` is not called. Null and empty texts have
    no ids and decode to an empty text. Repeated rows are worked each for itself, an empty table gives
    no rows, other columns are left out.
    """
    spark = docs.sparkSession
    pieces = pieces_of(vocabulary)
    table = [b""] * (1 + max(i for i, _ in pieces))
    for i, piece in pieces:
        table[i] = piece
    sent = spark.sparkContext.broadcast(table)

    def finish(results):
        begin("bpe rows")  # the tokenizer is no longer needed
        numbers = pa.array([b"%d," % i for i in range(len(sent.value))], pa.large_binary())
        digits, content = strung(numbers, results), strung(pa.array(sent.value, pa.large_binary()), results)
        lengths = np.diff(results.offsets)

        def rows(ids, sizes, counts, places) -> pa.Table:
            edges = np.concatenate([[0], np.cumsum(counts)])
            tokens = np.concatenate([[0], np.cumsum(lengths[places])])[edges]
            digests = []
            for words, last in ((digits, 1), (content, 0)):  # no comma after the last id
                data, offsets = flat(words.take(pa.array(places)))
                at = offsets[edges].tolist()
                every = (data[a:max(a, b - last)].tobytes() for a, b in zip(at, at[1:], strict=False))
                digests.append([hashlib.sha256(x if last else x.decode(errors="replace").encode()).hexdigest() for x in every])
            return pa.table({"doc_id": ids, "n_tokens": pa.array(np.diff(tokens), pa.int64()), "ids_sha256": pa.array(digests[0], pa.string()),
                             "decoded_sha256": pa.array(digests[1], pa.string())})

        return rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_word(docs, splitter(special_of(vocabulary)), word_encoder(vocabulary), finish,
                    f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


