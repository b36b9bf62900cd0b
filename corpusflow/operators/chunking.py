"""Cutting documents into chunks."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.slices import in_slices

# Length and overlap in characters; separators, the coarsest first.
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 300
SEPARATORS = ("\n\n", "\n", " ", "")


def chunk_fixed(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, *,
                text_col: str = "text") -> DataFrame:
    """Chunks of fixed length at a fixed stride, with built-in functions only.

    Adds ``ord`` and ``chunk`` in place of the text; all other columns are kept. A text no
    longer than ``size`` is one chunk, an empty text none, and no chunk lies wholly inside the
    one before it. The text is cut once into pieces of one stride, so the work grows with its
    length however long it is.
    """
    stride = size - overlap
    reach = -(-size // stride)
    length = F.length(text_col)
    count = F.ceil(F.greatest(length - overlap, F.lit(1)) / stride).cast("int")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    with_pieces = df.where(length > 0).withColumn("_count", count).withColumn("_pieces", pieces)
    chunks = F.transform(
        F.sequence(F.lit(1), F.col("_count")),
        lambda i: F.substring(F.array_join(F.slice("_pieces", i, reach), ""), 1, size))
    kept = [c for c in df.columns if c != text_col]
    return with_pieces.select(*kept, F.posexplode(chunks).alias("ord", "chunk"))


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, which stays at the head of the piece it opens."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Fill chunks with whole pieces; a new chunk starts with the tail of the one before."""
    lengths = [len(p) for p in pieces]
    first = total = 0
    for i, length in enumerate(lengths):
        if i > first and total + length > size:
            chunk = "".join(pieces[first:i]).strip()
            if chunk:
                yield chunk
            while first < i and (total > overlap or total + length > size):
                total -= lengths[first]
                first += 1
        total += length
    chunk = "".join(pieces[first:]).strip()
    if chunk:
        yield chunk


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of one text: cut at the coarsest separator it has, finer only where needed."""
    level = next(i for i, s in enumerate(separators) if not s or s in text)
    small: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        finer = separators[level + 1:]
        if finer:
            yield from split_text(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def split_column(column: pa.Array, sizes: Iterable[int] = repeat(CHUNK_SIZE), overlaps: Iterable[int] = repeat(CHUNK_OVERLAP)) -> pa.Array:
    """Chunks of an Arrow text column; nulls have none."""
    limits = zip(sizes, overlaps)  # goes on from slice to slice

    def cut(texts: pa.Array, _: int) -> pa.Array:
        return pa.array([list(split_text(t.as_py() or "", *next(limits))) for t in texts], kind)

    kind = pa.list_(pa.string())
    return in_slices(column, cut, kind)


def chunk_recursive(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, *,
                    text_col: str = "text") -> DataFrame:
    """Chunks along paragraphs, lines and words, in place and without a shuffle.

    Adds ``ord`` and ``chunk`` in place of the text; all other columns are kept.
    """
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return split_column(texts, repeat(size), repeat(overlap))

    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, cut(F.col(text_col)).alias("_chunks")).select(*kept, F.posexplode("_chunks").alias("ord", "chunk"))
