"""Chunking against the written rules, worked out the slow way."""
import random

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan_text
from corpusflow.functions.sql import register
from corpusflow.operators.chunking import SEPARATORS, chunk_fixed, chunk_recursive, split_column, split_text


def slow_split(text, size, overlap, separators=SEPARATORS):
    """The splitting rules one by one, with lists of strings."""
    separator, finer = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            separator, finer = s, separators[i + 1:]
            break
    if separator:
        parts = text.split(separator)
        parts = [parts[0]] + [separator + p for p in parts[1:]]
    else:
        parts = list(text)
    out, good = [], []

    def merge():
        current = []
        for part in good:
            if len("".join(current)) + len(part) > size and current:
                out.append("".join(current).strip())
                while len("".join(current)) > overlap or (len("".join(current)) + len(part) > size and "".join(current)):
                    current.pop(0)
            current.append(part)
        out.append("".join(current).strip())
        good.clear()
    for part in parts:
        if not part:
            continue
        if len(part) < size:
            good.append(part)
            continue
        merge()
        if finer:
            out.extend(slow_split(part, size, overlap, finer))
        else:
            out.append(part)
    merge()
    return [x for x in out if x]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \nß", max_size=120), st.integers(2, 30), st.integers(0, 12))
def test_split_matches_rules(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = list(split_text(text, size, overlap))
    assert chunks == slow_split(text, size, overlap)
    assert all(0 < len(x) <= size for x in chunks)


def test_split_prefers_paragraphs():
    text = "one two\n\nthree four\n\nfive"
    assert list(split_text(text, 15, 0)) == ["one two", "three four", "five"]
    assert list(split_text("", 15, 0)) == []


def test_chunk_recursive_keeps_columns(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc  \n") for _ in range(n)) for n in (0, 10, 1500, 4000, 9000)]
    df = spark.createDataFrame([(i, "m", t) for i, t in enumerate(texts)], "doc_id long, mark string, text string")
    rows = chunk_recursive(df).orderBy("doc_id", "ord").collect()
    want = [(i, "m", o, x) for i, t in enumerate(texts) for o, x in enumerate(slow_split(t, 1500, 300))]
    assert [tuple(r) for r in rows] == want


def test_chunk_text_in_sql(spark):
    register(spark)
    rows = spark.sql("SELECT ord, chunk FROM VALUES ('aa bb cc') t(x) LATERAL VIEW posexplode(chunk_text(x, 5, 0)) c AS ord, chunk ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(0, "aa bb"), (1, "cc")]


def test_chunk_rows_in_sql(spark):
    register(spark)
    texts = ["", None, "x y " * 900, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "id long, text string").coalesce(2)
    df = spark.sql("SELECT * FROM chunk_rows(TABLE(SELECT id, text FROM {docs}))", docs=docs)
    want = [(str(i), o, x) for i, t in enumerate(texts) for o, x in enumerate(split_text(t or ""))] + [(None, 0, "no id")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert "Exchange" not in plan_text(df) and spark.sql("SELECT * FROM chunk_rows(TABLE(SELECT id, text FROM {d}))", d=docs.where("false")).count() == 0


def test_chunk_fixed(spark):
    texts = ["", "a", "x" * 1500, "y" * 1501, "".join(chr(97 + i % 26) for i in range(5000)), "ü😀" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for size, overlap in ((1500, 300), (100, 70), (10, 0)):
        stride = size - overlap
        want = []
        for i, t in enumerate(texts):
            o = 0
            while t and (o == 0 or o * stride + overlap < len(t)):
                want.append((i, o, t[o * stride:o * stride + size]))
                o += 1
        got = [tuple(r) for r in chunk_fixed(df, size, overlap).orderBy("doc_id", "ord").collect()]
        assert got == want
    # all text is covered
    back = chunk_fixed(df).groupBy("doc_id").agg(F.sum(F.when(F.col("ord") == 0, F.length("chunk")).otherwise(F.length("chunk") - 300)).alias("n"))
    assert {r.doc_id: r.n for r in back.collect()} == {i: len(t) for i, t in enumerate(texts) if t}


def test_columns_are_cut_in_slices_of_bounded_size(monkeypatch):
    """A worker holds the objects of one slice, whatever the size of the batch."""
    from corpusflow.functions import slices as sl
    monkeypatch.setattr(sl, "SLICE_BYTES", 50)
    texts = pa.array(["a b " * 40, None, "", "x\ny " * 30, "q"] * 3)
    seen = []
    out = sl.in_slices(texts, lambda part, first: seen.append((first, len(part))) or part, pa.string())
    assert out.equals(texts) and len(seen) > 3 and [first for first, _ in seen] == [sum(n for _, n in seen[:i]) for i in range(len(seen))]
    sizes = list(range(20, 35))
    want = [list(split_text(t or "", s, 5)) for t, s in zip(texts.to_pylist(), sizes)]
    assert split_column(texts, sizes, [5] * 15).to_pylist() == want
    assert split_column(texts.slice(2, 5), sizes[2:7], [5] * 5).to_pylist() == want[2:7]
    assert split_column(texts.slice(0, 0)).to_pylist() == []


def test_vectors_do_not_depend_on_slices(spark):
    from corpusflow.functions.slices import SLICE_BYTES
    from corpusflow.functions.vectors import embed
    texts = ["a b", "a b " * (SLICE_BYTES // 4 + 10), None, "b c", "c"]
    rows = embed(spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1), "t").orderBy("id").collect()
    alone = [embed(spark.createDataFrame([(t,)], "t string"), "t").first().embedding for t in ("a b", None, "b c", "c")]
    assert [r.embedding for r in rows] == [alone[0], alone[0], *alone[1:]]
