"""Embedding and vector expressions."""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.slices import in_slices

DIMENSION = 64


@lru_cache(1 << 16)
def _bucket(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension if word else -1


def hash_embedder(dimension: int = DIMENSION) -> Callable[[Column], Column]:
    """Feature hashing of the words of a text into a unit vector, per row, without a shuffle.

    A batch is counted in slices of bounded size: each distinct word of a slice is looked up once.
    """

    def embed_slice(texts: pa.Array, _: int) -> pa.Array:
        words = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(words.flatten())
        bucket = np.array([_bucket(w, dimension) for w in coded.dictionary.to_pylist()], np.int64)
        place = bucket[np.asarray(coded.indices)]
        row = np.asarray(pc.list_parent_indices(words))
        full = place >= 0
        counts = np.bincount(row[full] * dimension + place[full], minlength=len(texts) * dimension).reshape(-1, dimension)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        vectors = (counts / np.where(norm > 0, norm, 1)).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dimension, vectors.reshape(-1))

    @F.arrow_udf("array<float>")
    def embed_words(texts: pa.Array) -> pa.Array:
        return in_slices(texts, embed_slice, pa.list_(pa.float32()))

    return lambda text: embed_words(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\r\n", "   "))


def model_embedder(make_predict: Callable, batch_size: int = 64) -> Callable[[Column], Column]:
    """Embedder around a model: ``make_predict`` loads it once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)


def embed(df: DataFrame, text_col: str, out: str = "embedding", embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add one vector per row, by word hashing unless another ``embedder`` is given."""
    return df.withColumn(out, (embedder or hash_embedder())(F.col(text_col)))


def check_dim(df: DataFrame, d: int, vec_col: str = "embedding") -> DataFrame:
    """The rows whose vector is missing or has another length."""
    return df.where(F.col(vec_col).isNull() | (F.size(vec_col) != d))


def relevance(d2: Column) -> Column:
    """Relevance of a squared distance between unit vectors."""
    return F.lit(1.0) - d2 / F.sqrt(F.lit(2.0))
