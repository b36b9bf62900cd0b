"""Token counts without token ids: pieces are counted once per distinct pre-token.

The vocabulary has no piece with a blank behind another character, so merges never cross from a word
into the blank that follows; text may be cut before each run of blanks and counted part by part.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusflow.llm.arrays import Texts, prefixes, span_hashes
from corpusflow.llm.word_table import Words, per_word

#: Documents of more tokens are marked.
LIMIT = 4096
_MARK = "▁"  # what the tokenizer writes for a blank; in a text it counts as one
_models: dict[bytes, object] = {}


def split(column: pa.Array) -> Words:
    """Pre-tokens: each run of blanks with what follows, less the one blank the tokenizer puts in front anyway."""
    if pc.any(pc.match_substring(column, _MARK)).as_py():
        column = pc.replace_substring(column, _MARK, " ")
    texts = Texts(column)
    blank = texts.data == 0x20
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    heads = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    begin[heads] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(texts.data))
    # the first pre-token of a text has no blank of its own
    inner = np.ones(len(texts.data), bool)
    inner[heads] = False
    first = starts + inner[starts] if len(starts) else starts
    return Words(texts.data, first, ends, texts.doc_of(starts), span_hashes(prefixes(texts.data), first, ends))


def piece_counter(model: bytes):
    """Counts the pieces of pre-tokens; ``model`` is the content of a vocabulary file."""
    def count(words: list[bytes]) -> tuple:
        import sentencepiece

        if model not in _models:
            _models.clear()
            _models[model] = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = _models[model].encode([w.decode() for w in words], num_threads=1) if words else []
        # an empty pre-token is a lone blank: one piece
        return np.ones(len(words), np.uint32), np.array([len(x) or 1 for x in ids], np.int32)

    return count


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, UTF-8 bytes, tokens, and whether there are more than ``limit``.

    Null and empty texts have none. Repeated rows are counted each for itself, an empty table gives
    no rows, other columns are left out. ``options`` go to ``per_word``.
    """
    if b"\xe2\x96\x81" in model and _crossing(model):
        raise ValueError("pieces of this vocabulary go across blanks")

    def finish(results):
        def rows(ids, sizes, counts, places) -> pa.Table:
            sums = np.concatenate([[0], np.cumsum(results.values[places], dtype=np.int64)])
            edges = np.concatenate([[0], np.cumsum(counts)])
            tokens = sums[edges[1:]] - sums[edges[:-1]]
            return pa.table({"doc_id": ids, "n_bytes": pa.array(sizes), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

        return rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_word(docs, split, piece_counter(model), finish, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", **options)


def _crossing(model: bytes) -> bool:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return any(_MARK in pieces.id_to_piece(i).lstrip(_MARK) for i in range(pieces.get_piece_size()))
