"""Sharding against a plain search over all contiguous partitions."""
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_texts import ODD, clashing, documents

from corpusflow.llm import shards
from corpusflow.llm.shards import Boundaries, minimax_cuts, shard_documents, write_shards


def key(text):
    return hashlib.sha256((text or "").encode()).digest()[:16]


def size(text):
    return len((text or "").encode()) + 8


def least_capacity(weights, parts):
    """By dynamic programming over all cuts."""
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    best = sums[:]
    for _ in range(parts - 1):
        best = [min((max(best[i], sums[n] - sums[i]) for i in range(n + 1))) for n in range(len(sums))]
    return best[-1]


def expected(texts, parts):
    """Weights of the groups with a shard of their own, and the least capacity of the others."""
    weights = collections.Counter()
    for t in texts:
        weights[key(t)] += size(t)
    alone = []
    for k, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        left = sum(weights.values()) - sum(alone)
        if w * (parts - len(alone)) < left or len(alone) == parts - 1:
            break
        alone.append(w)
    rest = [w for k, w in sorted(weights.items()) if w not in alone or list(weights.values()).count(w) > 1]
    return alone, least_capacity(rest, parts - len(alone))


def check(rows, texts, parts):
    by_shard = collections.defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size(texts[r.doc_id]), zlib.crc32((texts[r.doc_id] or "").encode()), "bytes", None)
        by_shard[r.shard].append(r)
    assert set(by_shard) <= set(range(parts)) and len(rows) == len(texts)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    places = collections.defaultdict(set)
    for r in rows:
        places[key(texts[r.doc_id])].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    return {s: sum(r.size for r in own) for s, own in by_shard.items()}


def test_shards_are_as_small_as_can_be(spark):
    rng = random.Random(3)
    texts = ODD + ["w" * rng.randrange(3000) for _ in range(300)] + [None, ""] * 5 + ["copy " * 30] * 40
    rows = shard_documents(clashing(documents(spark, texts)), 7).collect()
    sizes = check(rows, texts, 7)
    alone, least = expected(texts, 7)
    assert sorted(sizes.values())[-1] == max([least, *alone])
    # the shards of large groups come first
    assert [sizes[j] for j in range(len(alone))] == alone and len(alone) >= 1
    assert max(sizes[j] for j in range(len(alone), 7)) == least


def test_small_groups_give_even_shards(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab ", k=rng.randrange(10, 60))) for _ in range(900)]
    sizes = check(shard_documents(documents(spark, texts), 24).collect(), texts, 24)
    assert len(sizes) == 24 and max(sizes.values()) == expected(texts, 24)[1]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(map(size, texts))


def test_few_boundaries_a_round_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["x" * rng.randrange(400) + str(i % 50) for i in range(200)]
    want = shard_documents(documents(spark, texts), 9).collect()
    monkeypatch.setattr(shards, "MARKS", 12)
    monkeypatch.setattr(shards, "PARTS", 4)
    got = shard_documents(documents(spark, texts), 9).collect()
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in want}


@pytest.mark.parametrize("seed", range(40))
def test_cuts_from_a_few_boundaries(seed):
    """The search on the driver alone, boundaries being given out sparsely."""
    rng = random.Random(seed)
    weights = [rng.choice([8, 9, 30, 500]) + rng.randrange(rng.choice([1, 50])) for _ in range(rng.randrange(1, 70))]
    parts = rng.randrange(1, 12)
    Row = collections.namedtuple("Row", "end weight key")
    rows, at = [], 0
    for i, w in enumerate(weights):
        at += w
        rows.append(Row(at, w, b"%d" % i))
    asked = []

    def fetch(gaps):
        asked.append(gaps)
        assert gaps and len(asked) < 60
        return [r for a, b in gaps for r in {(r.end - a - 1) // -(-(b - a) // 3): r for r in rows if a < r.end <= b}.values()]

    marks = Boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)).add(rows[-1:])
    capacity, marks, cuts = minimax_cuts(marks, max(weights), parts, fetch)
    assert capacity == least_capacity(weights, parts)
    ends = [0, *cuts, at]
    assert set(ends) <= {0, *(r.end for r in rows)} and ends == sorted(ends)
    assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= capacity


def test_few_rows(spark):
    assert shard_documents(documents(spark, []), 5).collect() == []
    rows = shard_documents(documents(spark, [(None, None), (3, "a"), (3, "a"), (4, "")]), 24).collect()
    assert sorted((r.size, r.slot) for r in rows) == [(8, 0), (8, 1), (9, 0), (9, 1)]
    assert len({r.shard for r in rows}) == 2
    assert {r.shard for r in shard_documents(documents(spark, ["a", "b", "c"]), 1).collect()} == {0}


def test_written_shards(spark, tmp_path):
    texts = ["one", "two", "two", None, "three " * 50]
    write_shards(documents(spark, texts), str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {r.doc_id: r.shard for r in shard_documents(documents(spark, texts), 3).collect()}
    assert {r.doc_id: (r.text, r.shard) for r in got} == {i: (t, want[i]) for i, t in enumerate(texts)}
