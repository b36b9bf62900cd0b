"""Language ID by prediction by partial matching over bytes.

Every language has a context tree of order 2: after the two bytes before, else (by escape) after one,
else after none, else any of 256 bytes. Escapes follow method C with exclusion: a byte that was
predicted at a longer context is left out of the shorter ones. The statistics are frozen after
training, so the code length of each byte in each context is a fixed number, worked out from the tree, which
holds the contexts that training saw; those of seen grams are tabulated, and a text's exact code length is a sum.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.arrays import Texts, flat, in_slices, struct
from corpusflow.llm.workers import begin

#: Documents per language that the trees learn from, the first by the hash of their id.
SAMPLE = 2_000
#: Ids of chosen documents that are sent to every task.
BROADCAST_IDS = 500_000
#: Code lengths that are looked up at a time.
STEP = 4_000_000
NONE = "und"
_LETTER = regex.compile(r"\p{L}")
SCHEMA = "lang_pred string, score double, bits_per_byte double"


@dataclass
class Tree:
    """The context tree of one language, as far as training saw it.

    ``grams`` are the keys (a, b, c) of symbols c seen after a and b, in order, with their bits; ``pairs`` the keys (a, b)
    of contexts, in order, with the bits of an escape, the bits of the order 1 total without the symbols seen there,
    and those of a second escape. The rest is by b (and c): bits of the order 1 counts, whether c was seen after b,
    and the bits of c below order 1.
    """
    grams: np.ndarray
    gram_bits: np.ndarray
    pairs: np.ndarray
    pair_bits: np.ndarray
    one: np.ndarray
    seen: np.ndarray
    below: np.ndarray
    own: np.ndarray

    def cost(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bits of symbols c after a and b."""
        size = len(self.seen)
        pair = a * size + b
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        # a context that was never seen excludes nothing and escapes for nothing
        escape, total, again = np.where(known, self.pair_bits[:, at], self.own[:, b]) if len(self.pairs) else self.own[:, b]
        bits = escape + np.where(self.seen[b, c], total + self.one[b, c], again + self.below[b, c])
        gram = pair * size + c
        at = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
        if len(self.grams):
            bits = np.where(self.grams[at] == gram, self.gram_bits[at], bits)
        return bits


def _bits(part: np.ndarray, whole: np.ndarray | float) -> np.ndarray:
    """-log2 of shares; 0 where there is nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((part > 0) & (whole > 0), np.log2(whole) - np.log2(part), 0.0)


def _log2(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.log2(x), 0.0)


def tree_of(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, size: int) -> Tree:
    """The tree from the counts n of distinct (a, b, c); symbol 0 (unseen) is no symbol a context predicts.

    Method C: a context escapes as if each kind of symbol it has seen had been an escape once. Symbols that a
    longer context predicts are left out of the shorter ones.
    """
    real = c > 0
    a, b, c, n = a[real], b[real], c[real], n[real].astype(np.float64)
    order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    one = np.zeros((size, size))
    np.add.at(one, (b, c), n)
    zero = one.sum(0)
    pairs, place, kinds = np.unique(a * size + b, return_inverse=True, return_counts=True)
    of = pairs % size
    total = np.bincount(place, n, len(pairs)) + kinds
    kinds_one, kinds_zero = (one > 0).sum(1), int((zero > 0).sum())
    # order 1 without what the context predicts itself, order 0 without what order 1 predicts
    rest = one.sum(1)[of] - np.bincount(place, one[b, c], len(pairs))
    left = kinds_one[of] - kinds
    rest_zero = zero.sum() - (zero[None, :] * (one > 0)).sum(1)
    left_zero = kinds_zero - kinds_one
    unseen = np.log2(max(256 - kinds_zero, 1))
    below = np.where(zero[None, :] > 0, _bits(zero[None, :], (rest_zero + left_zero)[:, None]), _bits(left_zero, rest_zero + left_zero)[:, None] + unseen)
    return Tree((a * size + b) * size + c, _bits(n, total[place]), pairs,
                np.stack([_bits(kinds, total), _log2(rest + left), _bits(left, rest + left)]),
                -_log2(one), one > 0, below,
                np.stack([np.zeros(size), _log2(one.sum(1) + kinds_one), _bits(kinds_one, one.sum(1) + kinds_one)]))


@dataclass
class Model:
    """The trees of all languages, and a table of the code lengths of the grams that any of them saw.

    ``symbol`` maps bytes to symbols: 0 stands for the start of a text and for bytes never seen. ``place`` has the row of
    each gram in ``table``, -1 for grams that no tree has; it has a fixed size at most (257 cubed), the table and the trees grow
    with what was seen.
    """
    languages: list[str]
    symbol: np.ndarray
    trees: list[Tree]
    place: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(languages: list[str], symbol: np.ndarray, trees: list[Tree]) -> Model:
        size = int(symbol.max(initial=0)) + 1
        grams = np.unique(np.concatenate([t.grams for t in trees])) if trees else np.zeros(0, np.int64)
        place = np.full(size ** 3, -1, np.int32)
        place[grams] = np.arange(len(grams), dtype=np.int32)
        a, b, c = grams // size ** 2, grams // size % size, grams % size
        table = np.stack([t.cost(a, b, c) for t in trees], 1).astype(np.float32) if trees else np.zeros((0, 0), np.float32)
        return Model(languages, symbol, trees, place, table)

    def costs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bits of each symbol under each language."""
        size = round(len(self.place) ** (1 / 3))
        row = self.place[(a * size + b) * size + c]
        bits = self.table[np.maximum(row, 0)] if len(self.table) else np.zeros((len(row), len(self.languages)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            bits[new] = np.stack([t.cost(a[new], b[new], c[new]) for t in self.trees], 1)
        return bits

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length of each text under each language."""
        texts = Texts(column)
        s = self.symbol[texts.data]
        full = np.flatnonzero(np.diff(texts.offsets))
        one, two = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        one[1:], two[2:] = s[:-1], s[:-2]
        head = texts.offsets[full]
        one[head] = two[head] = 0
        two[np.minimum(head + 1, len(s) - 1)[np.diff(texts.offsets)[full] > 1]] = 0
        out = np.zeros((texts.n, len(self.languages)))
        step = max(1, STEP // max(len(self.languages), 1))
        for start in range(0, len(s) if self.languages else 0, step):
            part = slice(start, start + step)
            inside = np.flatnonzero((head < start + step) & (texts.offsets[full + 1] > start))
            begin = np.maximum(head[inside] - start, 0)
            out[full[inside]] += np.add.reduceat(self.costs(two[part], one[part], s[part]), begin, axis=0, dtype=np.float64)
        return out


def _gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n): each byte with the two before it, 256 for the start of the text, base 257."""
    def count(batches):
        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                texts = Texts(pc.filter(batch.column(1), pc.equal(langs, lang)))
                data = texts.data.astype(np.int64)
                head = texts.offsets[:-1][np.diff(texts.offsets) > 0]
                one, two = np.full(len(data), 256), np.full(len(data), 256)
                one[1:], two[2:] = data[:-1], data[:-2]
                one[head] = two[head] = 256
                second = head + 1
                two[second[second < len(data)]] = 256
                grams, n = np.unique((two * 257 + one) * 257 + data, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())],
                                                 ["lang", "gram", "n"])

    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train_language(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows whose ``lang`` and ``text`` are not null, ``sample`` documents per language.

    Ids are chosen without reading texts; only counts of three bytes come back, so the model grows with the languages
    there are and with the contexts each of them has.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    # a language whose texts are all empty is known, too
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    chosen = (known.select("doc_id", "lang").distinct()
              .withColumn("_nr", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
              .where(F.col("_nr") <= sample).select("doc_id", "lang"))
    if len(languages) * sample <= BROADCAST_IDS:  # as many rows at most; texts then stay where they are
        chosen = F.broadcast(chosen)
    texts = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).select("lang", "text")
    grams = _gram_counts(texts).toPandas()
    seen = np.unique(grams["gram"].to_numpy(np.int64) % 257)
    symbol = np.zeros(257, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    trees = []
    by_language = dict(list(grams.groupby("lang")))
    for lang in languages:
        own = by_language.get(lang, grams.iloc[:0])
        gram, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy()
        # bytes outside the alphabet cannot come up here; the start of a text is symbol 0 as a context
        trees.append(tree_of(symbol[gram // 257 ** 2], symbol[gram // 257 % 257], symbol[gram % 257], n, len(seen) + 1))
    return Model.of(languages, symbol[:256], trees)


def _predict(column: pa.Array, model: Model) -> pa.StructArray:
    bits = model.lengths(column)
    n_bytes = np.diff(flat(column)[1])
    letters = np.array([text is not None and _LETTER.search(text) is not None for text in column.to_pylist()], bool)
    known = letters & bool(model.languages)
    if model.languages:
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2(least[:, None] - bits).sum(1)
    else:
        best, least, score = np.zeros(len(bits), int), np.zeros(len(bits)), np.zeros(len(bits))
    names = pc.if_else(pa.array(known), pa.array(np.array([*model.languages, NONE], object)[np.where(known, best, -1)], pa.string()), NONE)
    return struct(lang_pred=names, score=pa.array(np.where(known, score, 0.0)), bits_per_byte=pa.array(least / np.maximum(n_bytes, 1)))


def language_of(text: Column, model: Model, spark) -> Column:
    """Predicted language, its probability under equal priors and the code length per byte."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCHEMA)
    def predict(column: pa.Array) -> pa.Array:
        begin("language")
        return in_slices(column, lambda part: _predict(part, sent.value), 1_000_000)

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3 (null: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score and bits per byte.

    The model learns only from rows that are not held out. Null texts and texts without a letter are
    ``und`` with score 0, and so is everything where nothing can be learned. Ties go to the language that
    sorts first; repeated rows are judged each for itself; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = train_language(docs.where(~held_out(F.col("doc_id"))), sample)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(F.col("text"), model, docs.sparkSession).alias("_l"))
            .select("doc_id", "held_out", "_l.*"))


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``identify`` gives a language, however short their texts; only ``und`` goes."""
    columns = docs.columns
    model = train_language(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample)
    return (docs.withColumn("_l", language_of(F.col("text"), model, docs.sparkSession))
            .where(F.col("_l.lang_pred") != NONE).select(*columns))
