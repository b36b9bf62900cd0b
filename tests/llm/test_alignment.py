"""Alignment of two tokenizers against both libraries on whole texts."""
import collections
import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import ODD, clashing, documents, odd  # noqa: F401
from pyspark.sql import functions as F

import public_tokenizers
from corpusflow.llm.alignment import Bitmap, Encoder, Postings, align_tokens, exact_sums, joint_words, pair_counts, scores
from corpusflow.llm.arrays import slices


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def plain_tokens(texts, files):
    """Per text the ids of both and their bytes, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    spec = json.loads(files[0])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {c: chr(c) for c in printable} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in printable)}
    byte = {v: k for k, v in shown.items()}
    piece = {i: p for p, i in spec["model"]["vocab"].items()}
    for text in texts:
        if not text:
            yield [], []
            continue
        a_ids = a.encode(" " + text, add_special_tokens=False).ids
        a_tokens = [(i, bytes(byte[c] for c in piece[i])) for i in a_ids]
        b_tokens = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            b_tokens.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()))
        want = (" " + text).encode()
        same = b"".join(x for _, x in a_tokens) == want == b"".join(x for _, x in b_tokens)
        yield (a_tokens, b_tokens) if same else ([], [])


def plain(texts, files):
    """Digest rows and pair counts by the definition."""
    per_text, corpus, in_docs = [], collections.Counter(), collections.Counter()
    for a_tokens, b_tokens in plain_tokens(texts, files):
        ends = []
        for tokens in (a_tokens, b_tokens):
            at, own = 0, {}
            for k, (_, x) in enumerate(tokens):
                at += len(x)
                own[at] = k
            ends.append(own)
        groups, links, i, j = [], [], 0, 0
        for offset in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][offset] + 1, ends[1][offset] + 1
            groups.append(",".join(str(t[0]) for t in a_tokens[i:x]) + "|" + ",".join(str(t[0]) for t in b_tokens[j:y]))
            links.append((a_tokens[x - 1][0], b_tokens[y - 1][0]))
            i, j = x, y
        per_text.append((len(a_tokens), len(b_tokens), groups, links))
        corpus.update(links)
        in_docs.update(set(links))
    best = collections.Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    rows = [(n_a, n_b, len(groups), len(links), sum(corpus[x] == best[x[1]] for x in links), sum(corpus[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", ";".join(groups)) for n_a, n_b, groups, links in per_text]
    return rows, {x: (in_docs[x], n, n == best[x[1]]) for x, n in corpus.items()}


BLANKS = ["a\u3000b", "a\u3000 b", "a\u3000  b", "\xa0 x  y", "x\u2003\u2003 y", " ", "  ", "\n", "\n  word", "a \n b", "don't  we'll", "x\u0085  y", "\u1680 z", "é é  é", "end "]


def test_documents_and_pairs(spark, odd, files):  # noqa: F811
    rng = random.Random(6)
    noise = ["".join(rng.choices(["a", "the ", " ", "\n", "\u3000", "\xa0", "é ", "中", "\u2028", " Zug", "<|endoftext|>", "🙂"], k=rng.randrange(1, 40))) for _ in range(200)]
    texts = odd + BLANKS + noise + ["the same words again"] * 40
    want, pairs = plain(texts, files)
    documents_, pairs_ = align_tokens(clashing(documents(spark, texts)).repartition(3), *files, keep_groups=True, block=60_000)
    got = {r.doc_id: r for r in documents_.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) == want[i], repr(text[:80] if text else text)
    assert {(r.a_id, r.b_id): (r.n_docs, r.n_links, r.best) for r in pairs_.collect()} == pairs
    assert sum(not w[0] for w in want) > 3


def test_blocks_change_nothing(spark, files):
    texts = ["the cat sat on the mat", "the the the", None, "", "on and on", "\u2581 the", "cat " * 70] * 30
    want, _ = plain(texts, files)
    for block in (50, 1_000_000):
        rows = align_tokens(documents(spark, texts), *files, block=block)[0].collect()
        assert sorted((r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == [(i, *w[3:7]) for i, w in enumerate(want)]


def test_few_rows(spark, files):
    documents_, pairs_ = align_tokens(documents(spark, []), *files)
    assert documents_.collect() == [] and pairs_.collect() == []
    rows = align_tokens(documents(spark, [(None, None), (2, "a b"), (2, "a b"), (None, "")]), *files)[0].collect()
    assert sorted((r.n_a, r.n_links, r.count_sum) for r in rows) == [(0, 0, 0), (0, 0, 0), (2, 2, 4), (2, 2, 4)]


def test_joint_words_are_cut_by_both(odd, files):  # noqa: F811
    encoder = Encoder.of(*files)
    column = pa.array([t for t in odd + BLANKS if t and len(t) < 5000], pa.string())
    for a, b in slices(column):
        data, starts, ends, text = joint_words(column.slice(a, b - a))
        raw = data.tobytes()
        for i in range(b - a):
            words = [raw[s:e] for s, e, t in zip(starts, ends, text, strict=True) if t == i]
            whole = " " + column[a + i].as_py()
            assert b"".join(words).decode() == whole
            ids = [encoder.a.encode(w.decode(), add_special_tokens=False).ids for w in words]
            assert [x for own in ids for x in own] == encoder.a.encode(whole, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bitmaps(seed):
    """Planes against counting, through the packed form, merged from slices."""
    rng = np.random.default_rng(seed)
    n_docs, postings, want = 300, Postings(), collections.Counter()
    for start in range(0, n_docs, 20):
        docs = np.sort(rng.integers(start, start + 20, 400))
        links = np.where(rng.random(400) < 0.4, 7, rng.integers(0, 40, 400) << 32)
        postings.add(docs, links)
        want.update(zip(docs.tolist(), links.tolist(), strict=True))
    planes = [Bitmap.from_bytes(p.to_bytes(n_docs)) for p in postings.merged()]
    assert any((p.sizes * 16 > n_docs).any() for p in planes) and any((p.sizes * 16 <= n_docs).any() for p in planes)
    pairs, documents_, links = pair_counts(planes)
    for pair, n, m in zip(pairs.tolist(), documents_.tolist(), links.tolist(), strict=True):
        own = [v for (_, p), v in want.items() if p == pair]
        assert (n, m) == (len(own), sum(own))
    best = links == links.max()
    huge = links * 10 ** 12
    n_links, n_best, sums = scores(planes, pairs, huge, best, n_docs)
    place = {p: i for i, p in enumerate(pairs.tolist())}
    for d in range(n_docs):
        own = {p: v for (x, p), v in want.items() if x == d}
        assert (n_links[d], n_best[d], sums[d]) == (sum(own.values()), sum(v for p, v in own.items() if best[place[p]]), sum(v * int(huge[place[p]]) for p, v in own.items()))


def test_sums_are_exact():
    assert exact_sums(np.array([0, 0, 1]), np.array([2 ** 60 + 1, 1, 3]), 3).tolist() == [2 ** 60 + 2, 3, 0]


def test_small_parts_are_read_together(spark, tmp_path):
    from corpusflow.llm.alignment import _gathered

    documents(spark, ["a"] * 200).repartition(90, F.col("doc_id")).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(512 << 20))
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() > 20 and _gathered(df).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
