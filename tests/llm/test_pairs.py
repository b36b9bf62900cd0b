"""Joins over the whole corpus against brute force, with limits so small that every way is taken."""
import collections
import hashlib
import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import ODD, clashing, documents

import corpus_pipeline
import public_tokenizers
from corpusflow.llm import jaccard_join, suffix_dedup
from corpusflow.llm.components import components


# --- Jaccard join ----------------------------------------------------------------------------------------

def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def groups(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def slow_components(texts, width=4, percent=85):
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and (b := sets[j]) and 100 * len(a & b) >= percent * len(a | b)]
    return [len(s) for s in sets], groups(len(texts), links)


def near_copies(seed=3):
    """Groups of copies with more and more changed words, short texts, a shared passage and unlike texts."""
    rng = random.Random(seed)

    def text(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = [*ODD[:11], "One two THREE", "one two three four", "one two three four five six seven eight nine ten"]
    passage = text(60)
    for size in (8, 12, 30, 90, 200):
        base = text(size)
        out += [" ".join(base)] * 3
        chain = list(base)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(size)] = f"x{rng.randrange(10 ** 6)}"
            out.append(" ".join(copy))
            chain[rng.randrange(size)] = f"y{rng.randrange(10 ** 6)}"  # drifts away step by step
            out.append(" ".join(chain).upper())
        out += [" ".join(base[:-k]) for k in (1, 2, 3) if size > 8]
    out += [" ".join(text(20) + passage + text(rng.randrange(1, 25))) for _ in range(25)]
    out += [" ".join(passage + [f"z{i}"]) for i in range(6)]
    rng.shuffle(out)
    return out


TEXTS = near_copies()


@pytest.mark.parametrize("width,percent,limit", [(4, 85, 24_000_000), (5, 80, 24_000_000), (4, 85, 4_000), (2, 60, 15_000), (1, 50, 3_000)])
def test_jaccard_components(spark, width, percent, limit):
    rows = jaccard_join.jaccard_components(clashing(documents(spark, TEXTS)), width, percent, region_bytes=limit, pivots=3).collect()
    sizes, roots = slow_components(TEXTS, width, percent)
    assert sorted(map(tuple, rows)) == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots, strict=True))]


def test_jaccard_cluster_of_a_shared_passage_falls_apart(spark, monkeypatch):
    """Pairs of near copies that only a passage chains are one cluster, which regions do not make smaller: no task gets all, no pair of chunks is written."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(300)]
    texts = []
    for i in range(24):
        own = [f"v{i}x{j}" for j in range(100)]
        copy = [*own]
        copy[rng.randrange(100)] = "other"
        texts += [" ".join(passage + own), " ".join(passage + copy)]
    asked, large = [], jaccard_join._links_of_large
    parted = jaccard_join._parted
    monkeypatch.setattr(jaccard_join, "_links_of_large", lambda members, *rest: asked.append(members.count()) or large(members, *rest))
    monkeypatch.setattr(jaccard_join, "_parted", lambda members, *rest: asked.append(-members.count()) or parted(members, *rest))
    rows = jaccard_join.jaccard_components(documents(spark, texts), 5, 80, region_bytes=20_000).collect()
    sizes, roots = slow_components(texts, 5, 80)
    assert sorted(map(tuple, rows)) == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots, strict=True))]
    assert asked == [-48]


def test_rarest_shingles_of_linked_sets_meet(spark):
    """Whatever partitions cut, sets that repeat or lie in other clusters."""
    sets = [{hash(s) & (2**63 - 1) for s in shingles(t, 3)} for t in TEXTS]
    rows = [(i % 2, i // 2 + 1, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(x for s in sets if 0 < len(s) < 500 for x in (s, s))]
    rows += rows[:9]
    for percent in (60, 85):
        found = {r.node: r.root for r in jaccard_join._parted(spark.createDataFrame(rows, "root long, set_id long, codes binary").where("root = 1"), percent).collect()}
        of = {i: set(np.frombuffer(c, np.uint64).tolist()) for root, i, c in rows if root}
        linked = [(i, j) for i, a in of.items() for j, b in of.items() if j < i and 100 * len(a & b) >= percent * len(a | b)]
        assert linked and all(found[i] == found[j] for i, j in linked)
        assert len(set(found.values())) > 3


def test_jaccard_rows_that_repeat_and_lack_ids(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(5, text), (5, text), (3, text + " b"), (None, text), (8, None), (8, "other words here now"), (9, "OTHER words here now"), (None, None)]
    got = sorted(map(tuple, jaccard_join.jaccard_components(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 37, 3), (5, 37, 3), (3, 38, 3), (None, 37, None), (8, 0, 8), (8, 1, 8), (9, 1, 8), (None, 0, None)], key=str)
    kept = jaccard_join.keep_one(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 8, 8] and sum(r.doc_id is None for r in kept) == 2
    assert jaccard_join.jaccard_components(documents(spark, rows).limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for n in [1, 2, 5, 6, 7, 8, 9, 13, 20, 50, 200, 700]:
        for percent in (80, 85):
            base = rng.integers(0, 2 ** 64 - 1, n, dtype=np.uint64)
            for _ in range(60):
                cut = int(rng.integers(0, n // 4 + 1))
                new = rng.integers(0, 2 ** 64 - 1, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)
                other = np.concatenate([base[cut:], new])
                common = n - cut
                if not len(other) or 100 * common < percent * (n + len(other) - common):
                    continue
                enough = set(base.tolist()) == set(other.tolist())
                for _, sets, need, places, sigs in jaccard_join.signatures(np.array([0, n, n + len(other)]), np.concatenate([base, other]), percent):
                    if len(sets) == 2:
                        one, two = (set(sigs[places[i]:places[i + 1]].tolist()) for i in range(2))
                        enough |= len(one & two) >= max(need) and max(need) >= 1
                assert enough


def test_region_join_equals_all_pairs():
    rng = random.Random(4)
    for trial in range(12):
        bases = [rng.sample(range(5000), rng.choice([10, 40, 120])) for _ in range(6)]
        sets = []
        for _ in range(150):
            base = set(rng.choice(bases))
            for _ in range(rng.randrange(0, 1 + len(base) // 4)):
                base.discard(rng.choice(sorted(base)))
                base.add(rng.randrange(5000))
            sets.append(base)
        region = jaccard_join.Region([np.array(sorted(s), np.uint64) for s in sets], 85)
        region.join(np.arange(len(sets)), pivots=4, leaf=5)
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert [region.root(i) for i in range(len(sets))] == groups(len(sets), links), trial


def test_prefix_join_probes_sets_that_join_the_largest_component_on_the_way():
    n = 40
    core = list(range(n))

    def other(*changes):  # core with some shingles replaced: (place, new shingle)
        out = list(core)
        for place, new in changes:
            out[place] = new
        return set(out)
    # the largest component: rows 0-2, equal sets; i1 links into it, i2 is known as linked with i1, j links only with i2
    big = [other(), other(), other()]
    i1 = other((0, 100))
    far = list(range(1000, 1000 + n))
    i2, j = set(far), {*far[:-1], 2000}
    sets = [*big, i1, j, i2]
    region = jaccard_join.Region([np.array(sorted(s), np.uint64) for s in sets], 85)
    known = [(0, 1), (1, 2), (3, 5)]
    for a, b in known:
        region.link(a, b)
    region.by_prefix(np.arange(len(sets)))
    links = known + [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert (3, 0) in links and (5, 4) in links and (4, 0) not in links
    assert [region.root(i) for i in range(len(sets))] == groups(len(sets), links) == [0] * len(sets)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (500, 501), (501, 500)]
    roots = groups(600, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {i: roots[i] for i in nodes}


# --- repeated passages -----------------------------------------------------------------------------------

def slow_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=8):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choices("abcdefgh ", k=n))
    shared, other = noise(70), noise(45)
    out = [None, "", "short", "x" * 3000, "ab" * 700, noise(24), "é" * 40]
    for _ in range(40):
        out.append(noise(rng.randrange(0, 120)) + shared[rng.randrange(20):rng.randrange(40, 70)] + noise(rng.randrange(0, 90)))
    out += [other + noise(3) + other, noise(50) + other[5:] + noise(9), other[:24], other[:23], "\x00" * 30 + noise(20), "\x00" * 28]
    copy = noise(400)
    out += [copy, copy, copy[:200] + "Z" + copy[200:], copy[10:-10], noise(5) + "x" * 60]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("length,gram,shard,segments", [(24, 6, 3_000_000, 4_000), (24, 6, 500, 3), (40, 9, 2_000, 1), (200, 32, 3_000_000, 4_000)])
def test_removed_passages(spark, length, gram, shard, segments):
    texts = passages()
    if length == 200:
        texts = ["".join(f"{t} " for t in (a, b)) if a and b else a for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    rows = suffix_dedup.remove_repeats(clashing(documents(spark, texts)), length, gram, shard, segments).collect()
    want = slow_removal(texts, length)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(want)) and len(rows) == len(texts)


def test_removed_passages_of_rows_that_repeat(spark):
    text = "".join(random.Random(1).choices("abc ", k=50))
    texts = [(1, text), (1, text), (1, "other"), (None, "q" + text), (None, None)]
    rows = suffix_dedup.remove_repeats(documents(spark, texts), 24, 6).collect()
    want = [(i, *w) for (i, _), w in zip(texts, slow_removal([t for _, t in texts], 24), strict=True)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(documents(spark, texts).limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for trial in range(30):
        sizes = rng.integers(0, 80, rng.integers(1, 8))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = rng.integers(0, rng.integers(1, 4), offsets[-1]).astype(np.uint8)
        if not len(data):
            continue
        ends = np.repeat(offsets[1:], np.diff(offsets))
        order, rank = suffix_dedup.suffix_array(data, ends)
        suffix = [data[i:ends[i]].tobytes() for i in range(len(data))]
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix[i], i)), trial
        assert (rank[order] == np.arange(len(data))).all()
        for length in (1, 3, 10):
            count = collections.Counter(s[:length] for s in suffix if len(s) >= length)
            want = [len(s) >= length and count[s[:length]] > 1 for s in suffix]
            assert suffix_dedup.repeated_strings(data, offsets, length).tolist() == want


def test_shards_are_worked_in_pieces(monkeypatch):
    rnd = random.Random(4)
    passage = [rnd.randbytes(230) for _ in range(540)]
    # one anchor of 2,000 segments among many of two, in no order; equal strings have one anchor
    rows = [(0, i, passage[i % 40]) if i % 3 else (1 + i // 6, i, passage[40 + i // 6]) for i in range(3000)]
    rows = [(g, i, p + rnd.randbytes(140) if i % 5 else rnd.randbytes(370)) for g, i, p in rows]
    rnd.shuffle(rows)
    table = pa.table({"gram": [r[0] for r in rows], "seg": [r[1] for r in rows], "content": pa.array([r[2] for r in rows], pa.binary())})
    tracemalloc.start()
    marks = suffix_dedup._marks(200)(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85e6, peak  # the whole shard at once takes about 100 MB
    times = collections.Counter((g, c[i:i + 200]) for g, _, c in rows for i in range(len(c) - 199))
    want = {s: [i for i in range(len(c) - 199) if times[g, c[i:i + 200]] > 1] for g, s, c in rows}
    assert {r["seg"]: r["places"] for r in marks} == want
    sizes, inner = [], suffix_dedup.repeated_strings
    monkeypatch.setattr(suffix_dedup, "repeated_strings", lambda data, *a: sizes.append(len(data)) or inner(data, *a))
    assert {r["seg"]: r["places"] for r in suffix_dedup._marks(200, 50_000)(table).to_pylist()} == want
    assert sorted(sizes)[-2] <= 50_000 < sorted(sizes)[-1] == 370 * sum(r[0] == 0 for r in rows)


def test_strings_of_crowded_anchors_are_digested_in_pieces():
    rnd = random.Random(5)
    rows = [(i % 3, i, rnd.randbytes(rnd.choice([150, 200, 360, 360]))) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())],
                                       ["gram", "seg", "content"])
    tracemalloc.start()
    most = max(part.num_rows for part in suffix_dedup._strings(200)([batch.slice(7)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 200_000 and peak < 30e6, (most, peak)
    got = [tuple(r.values()) for part in suffix_dedup._strings(200)([batch.slice(7)]) for r in part.to_pylist()]
    assert got == [(g, s, i, *struct.unpack(">qq", hashlib.blake2b(c[i:i + 200], digest_size=16).digest()))
                   for g, s, c in rows[7:] for i in range(len(c) - 199)]


def test_segments_cover_every_string_once():
    from corpusflow.llm.arrays import Texts

    texts = Texts(pa.array(passages()))
    doc, anchor, seg, begin, starts = suffix_dedup.segments(texts, 24, 6)
    covered = sorted((d, b + i) for d, b, n in zip(doc.tolist(), begin.tolist(), starts.tolist(), strict=True) for i in range(n))
    assert covered == [(d, i) for d, n in enumerate(np.diff(texts.offsets).tolist()) for i in range(n - 23)]
    of = collections.defaultdict(set)
    for d, a, b, n in zip(doc.tolist(), anchor.tolist(), begin.tolist(), starts.tolist(), strict=True):
        for i in range(b, b + n):
            at = texts.offsets[d] + i
            of[texts.data[at:at + 24].tobytes()].add(a)
    assert all(len(a) == 1 for a in of.values())  # equal strings have the same anchor


# --- pipeline --------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    import test_texts as plain

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language ID"](spark, docs, folder)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == set(texts)  # every document has letters and a clear language

    second = stages["n-gram Jaccard join"](spark, docs, folder)
    ids = sorted(texts)
    _, roots = slow_components([texts[i] for i in ids], 5, 80)
    kept = {i for k, i in enumerate(ids) if roots[k] == k}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == kept and len(kept) < len(ids)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    third = stages["benchmark decontamination"](spark, second, folder)
    clean = {i for i in kept if not plain.slow_hits(texts[i], items)[4]}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean and len(clean) < len(kept)

    fourth = stages["secret scans"](spark, third, folder)
    after = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == docs.columns and set(after) == clean
    for i, row in after.items():
        spans = plain.base_spans(texts[i])
        assert not spans and row.text == texts[i] or spans and all(texts[i][s:e] not in row.text for s, _, e in spans)
        assert row.n_chars == len(row.text)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    for r in rows:
        ids = library.encode(after[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), plain.sha(",".join(map(str, ids))), plain.sha(after[r.doc_id].text))


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    rows = [*ODD, *ODD[:5], (None, "no id at all"), (3, None)]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for n in (len(rows), 0):
        got = docs.limit(n)
        for _, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{n}-{stage.__name__}")
            stage(spark, got, str(tmp_path)).write.parquet(path)
            got = spark.read.parquet(path)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (got.count() > 0) == (n > 0)


def batches_of(*columns, size=10_000):
    for at in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + size].copy()) for c in columns], ["a", "b"])


def peak_of(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("rows", [0, 1, 300, 1000])
def test_what_several_sets_have(rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HANDED_ON", 64)
    rnd = np.random.default_rng(rows)
    sigs, sets = rnd.integers(-60, 60, rows), rnd.integers(0, 9, rows)
    keys = (sigs << 12) + rnd.integers(0, 64, rows) + (3 << 6)
    pairs = {(int(s), int(x)) for s, x in zip(sigs, sets, strict=True)}
    n = collections.Counter(s for s, _ in pairs)
    edges = {min(n), max(n)} if n else set()
    got = [row for b in jaccard_join._shared(batches_of(keys, sets, size=70)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((s << 12, x, 3) for s, x in pairs if n[s] > 1 or s in edges)
    got = [row for b in jaccard_join._counted(batches_of(sigs, sets, size=70)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((x, s, jaccard_join._CUT if s in edges else n[s]) for s, x in pairs if n[s] > 1 or s in edges)


def test_signatures_are_counted_in_little_memory():
    rnd = np.random.default_rng(3)
    keys, sets = rnd.integers(0, 300_000, 1_000_000) << 12, rnd.integers(0, 50_000, 1_000_000)
    for work in (jaccard_join._shared, jaccard_join._counted):
        assert peak_of(lambda work=work: collections.deque(work(batches_of(keys, sets)), maxlen=0)) < 60e6  # 86 MB before


def test_shingles_are_read_in_little_memory():
    rnd = random.Random(7)
    texts = pa.array([" ".join("".join(rnd.choices("abcdefghij", k=8)) for _ in range(500)) for _ in range(1000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    assert peak_of(lambda: collections.deque(jaccard_join._read_sets(5, 80)(iter([batch])), maxlen=0)) < 25e6  # 41 MB before
