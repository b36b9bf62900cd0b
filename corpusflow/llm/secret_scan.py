"""Secret scans: an Aho-Corasick keyword pass, anchored expressions near its hits, embedded checksums.

The keywords of every kind are found in one pass over the text. Only where a keyword stands does the
expression of its kind run, anchored there. Kinds that carry a checksum of their own are kept only if
it is right. Runs of hex digits have no keyword; their own expression finds them.
"""
from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrays import struct
from corpusflow.llm.workers import begin

SCHEMA = ("n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string, "
          "found array<struct<kind:string,start:int,end:int>>")

# The patterns of the contract.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",)}
BASE = ("assign", "access", "hex")
# Published token forms that end in a CRC-32 of what stands before, as six base-62 digits.
_CHECKED = re.compile(rb"(gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z_])")
_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE, "checked")


def checksum_ok(body: bytes) -> bool:
    """Whether the last six characters are the checksum of the others."""
    value = zlib.crc32(body[:-6])
    digits = bytearray()
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(_DIGITS[digit])
    return bytes(reversed(digits)) == body[-6:]


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in {**_WORDS, "checked": _PREFIXES}.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


_keywords: list[ahocorasick.Automaton] = []


def find(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, end, index of the kind) of a text in code points, in order."""
    raw = text.encode()
    if not _keywords:
        _keywords.append(_automaton())
    spans = [(m.start(), m.end(), 2) for m in _HEX.finditer(raw)]
    # one character per byte, letters A-Z in lower case: places are byte places
    hits = [(end + 1 - length, kind) for end, (kind, length) in _keywords[0].iter(raw.lower().decode("latin-1"))]
    if hits:
        after = dict.fromkeys(KINDS, 0)
        for start, kind in sorted(hits):
            if start < after[kind]:
                continue  # inside the match before
            match = {"assign": _ASSIGN, "access": _ACCESS, "checked": _CHECKED}[kind].match(raw, start)
            if match is None:
                continue
            after[kind] = match.end()  # a match that fails the checks has used up its text too
            if (len(match[2]) >= 6 if kind == "assign" else len(match[0]) >= 20 if kind == "access" else checksum_ok(match[2])):
                spans.append((start, match.end(), KINDS.index(kind)))
    if spans and not raw.isascii():
        places = sorted({p for s, e, _ in spans for p in (s, e)})
        point, before, at = {}, 0, 0
        for place in places:
            at += len(raw[before:place].decode(errors="ignore"))
            point[place], before = at, place
        spans = [(point[s], point[e], k) for s, e, k in spans]
    return sorted(spans, key=lambda x: (x[0], x[2]))


def _digest(column: pa.Array) -> pa.StructArray:
    counts, base, every, found = [[], [], [], []], [], [], []
    for text in column.to_pylist():
        spans = find(text) if text else []
        for k in range(4):
            counts[k].append(sum(x[2] == k for x in spans))
        names = [f"{KINDS[k]}:{s}:{e}" for s, e, k in spans]
        base.append(hashlib.sha256(",".join(n for n, x in zip(names, spans, strict=True) if x[2] < 3).encode()).hexdigest())
        every.append(",".join(names))
        found.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    long = [pa.array(c, pa.int64()) for c in counts]
    return struct(n_assign=long[0], n_access=long[1], n_hex=long[2], n_checked=long[3], base_sha256=pa.array(base, pa.string()),
                  spans=pa.array(every, pa.string()), found=pa.array(found, kind))


def secrets_of(text: Column) -> Column:
    """What the scan finds in a text: counts per kind, digests and the spans themselves."""
    @F.arrow_udf(SCHEMA)
    def scan(column: pa.Array) -> pa.Array:
        begin("secrets", _keywords.clear)
        return _digest(column)

    return scan(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: one row per row of ``docs``, whatever other columns it has.

    Null and empty texts have none (``base_sha256`` of the empty string). Repeated rows are scanned
    each for itself; an empty table gives no rows. No shuffle; a task holds one batch of texts.
    """
    return docs.select(F.col(id_col), secrets_of(F.col(text_col)).alias("_found")).select(id_col, "_found.*")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; where spans overlap, they go together.

    Columns keep their names and order; null texts stay null.
    """
    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        begin("secrets", _keywords.clear)
        out = []
        for text in column.to_pylist():
            at, parts = 0, []
            for start, end, kind in find(text) if text else []:
                if end > at:
                    if start >= at:
                        parts += [text[at:start], f"[{KINDS[kind]}]"]
                    at = end
            out.append(text if not parts else "".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))
