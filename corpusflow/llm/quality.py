"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics come from flat byte arrays, many documents at once. The trees are trained on a bounded
sample of labelled documents, flattened into node arrays, and score whole batches level by level.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.arrays import WORD, Texts, combine, in_slices, struct

#: Labelled documents the trees are trained on, taken by the hash of their id.
SAMPLE = 20_000
# The rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[list(b"0123456789")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?;:,")] = True

#: Feature -> sign of its effect on quality: -1 never helps, +1 never harms, 0 free.
FEATURES = {"symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "top_word_share": -1, "log_words": 0, "word_length": 0,
            "digits_per_char": 0, "stops_per_word": 0, "words_per_line": 0, "distinct_share": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{name} long" for name in COUNTS) + ", features array<double>"


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal, and whether it is the first of its kind in sorted order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    repeated, first = np.empty(len(keys), bool), np.empty(len(keys), bool)
    repeated[order] = same[1:] | same[:-1]
    first[order] = ~same[:-1]
    return repeated, first


def _largest(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Count of the most frequent key of each document."""
    _, at, counts = np.unique(keys, return_index=True, return_counts=True)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, doc[at], counts)
    return out


def _statistics(column: pa.Array) -> pa.StructArray:
    texts = Texts(column)
    data, n = texts.data, texts.n
    in_word = WORD[data]
    starts, ends, doc = texts.spans(in_word)
    n_words = np.bincount(doc, minlength=n)
    word = texts.hashes(starts, ends)
    word_chars = texts.per_text(in_word & ((data & 0xC0) != 0x80))
    symbols = texts.per_text(_SYMBOLS[data])

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([texts.offsets[1:], breaks]))
    words_before = np.searchsorted(starts, np.concatenate([line_start, line_end]))
    full = words_before[len(line_start):] > words_before[:len(line_start)]
    line_start, line_end = line_start[full], line_end[full]
    line_doc = texts.doc_of(line_start)
    _, first = _groups(combine(line_doc, texts.hashes(line_start, line_end)))
    n_lines = np.bincount(line_doc, minlength=n)
    dup_lines = n_lines - np.bincount(line_doc[first], minlength=n)

    at = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    twice, _ = _groups(combine(doc[at], word[at], word[at + 1], word[at + 2]) if len(at) else np.zeros(0, np.uint64))
    covered = np.zeros(len(doc), bool)
    for step in range(3):
        covered[at[twice] + step] = True
    repeat_words = np.bincount(doc[covered], minlength=n)

    own = combine(doc, word)
    _, new = _groups(own)
    some = np.maximum(n_words, 1)
    features = np.column_stack([
        symbols / some, repeat_words / some, dup_lines / np.maximum(n_lines, 1), _largest(own, doc, n) / some, np.log1p(n_words),
        word_chars / some, texts.per_text(_DIGITS[data]) / np.maximum(word_chars, 1), texts.per_text(_STOPS[data]) / some,
        n_words / np.maximum(n_lines, 1), np.bincount(doc[new], minlength=n) / some])
    counts = [pa.array(c.astype(np.int64)) for c in (n_words, word_chars, symbols, dup_lines, repeat_words)]
    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(FEATURES), features.reshape(-1))
    return struct(**dict(zip(COUNTS, counts, strict=True)), features=lists)


def statistics(text: Column) -> Column:
    """Counts and features of a text; null counts as empty."""
    @F.arrow_udf(SCHEMA)
    def measure(column: pa.Array) -> pa.Array:
        return in_slices(column, _statistics)

    return measure(text)


@dataclass
class Trees:
    """Trees flattened into arrays: node i of tree t is at ``t * nodes + i``; a leaf points to itself."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row."""
        total = np.full(len(x), self.base)
        nodes = self.feature.shape[1]
        flat = {k: getattr(self, k).reshape(-1) for k in ("feature", "threshold", "left", "right", "value")}
        rows = np.arange(len(x))
        for tree in range(self.feature.shape[0]):
            at = np.full(len(x), tree * nodes)
            for _ in range(self.depth):
                small = x[rows, flat["feature"][at]] <= flat["threshold"][at]
                at = tree * nodes + np.where(small, flat["left"][at], flat["right"][at])
            total += flat["value"][at]
        return total


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
          penalty: float = 1.0) -> Trees:
    """Boosted trees for the log odds of ``y``; a feature with a sign only moves the score that way.

    A split on such a feature is taken only if its children's values are in order; the middle of both
    then bounds all values below, so the order holds for the whole tree, and for their sum.
    """
    n, width = x.shape
    size = 2 ** (depth + 1) - 1
    arrays = [np.zeros((trees, size), kind) for kind in (np.int64, float, np.int64, np.int64, float)]
    feature, threshold, left, right, value = arrays
    left[:], right[:] = np.arange(size), np.arange(size)
    rate_of = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate_of / (1 - rate_of)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)]) if n else np.zeros((0, width), int)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, node] = rate * np.clip(g / (h + penalty), low, high)
            best = None
            for f in range(width if level < depth and len(rows) >= 40 else 0):
                gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], bins))[:len(cuts[f])]
                hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], bins))[:len(cuts[f])]
                wl = np.clip(gl / (hl + penalty), low, high)
                wr = np.clip((g - gl) / (h - hl + penalty), low, high)
                gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
                gain = np.where((hl < 1) | (h - hl < 1) | (signs[f] * (wr - wl) < 0), 0, gain)
                if len(gain) and gain.max() > (best[0] if best else 1e-6):
                    k = int(gain.argmax())
                    best = (gain[k], f, k, (wl[k] + wr[k]) / 2)
            if best is None:
                score[rows] += value[t, node]
                continue
            _, f, k, middle = best
            feature[t, node], threshold[t, node], left[t, node], right[t, node] = f, cuts[f][k], 2 * node + 1, 2 * node + 2
            small = binned[rows, f] <= k
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
            for child, part, (a, b) in ((2 * node + 1, rows[small], bounds[0]), (2 * node + 2, rows[~small], bounds[1])):
                todo.append((child, part, a, b, level + 1))
    return Trees(feature, threshold, left, right, value, depth, base)


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled documents, the first by the hash of their id.

    The sample's ids (at most ``sample``) are sent to the tasks, so no text is shuffled, and only its
    features come back. Without labels the trees say yes to everything.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    measured = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                .select("doc_id", "quality", statistics(F.col("text")).alias("_s"))
                .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("_s.features").alias("x")).toPandas())
    if measured.empty or not np.stack(measured["x"]).size:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()), trees=1)
    measured = measured.sort_values("doc_id")
    return train(np.stack(measured["x"]).astype(float), measured["quality"].to_numpy(float), list(FEATURES.values()))


def judge_quality(docs: DataFrame, trees: Trees, at_least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: counts, whether the base rules fail, the trees' score and the verdict.

    ``kept`` is false where the base rules fail and otherwise true from a probability of ``at_least``
    on. Null and empty texts have no words and fail. Repeated rows are judged each for itself, an
    empty table gives no rows, other columns are left out. No shuffle.
    """
    @F.arrow_udf("double")
    def score(features: pa.Array) -> pa.Array:
        x = np.asarray(features.flatten()).reshape(-1, len(FEATURES))
        return pa.array(1 / (1 + np.exp(-trees.score(x))))

    measured = docs.select("doc_id", statistics(F.col("text")).alias("_s")).select("doc_id", "_s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (measured.withColumn("score", score("features")).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= at_least)).drop("features"))
