"""Search, fusion and reranking against brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.vectors import check_dim, embed, model_embedder
from corpusflow.operators import search as se


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[200:] = x[0]  # a third are copies of one vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return x.astype("float64"), spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


def brute(x, k):
    out = {}
    for q in range(len(x)):
        d = ((x - x[q]) ** 2).sum(1)
        order = sorted(range(len(x)), key=lambda i: (round(d[i], 9), i))[:k]
        out[q] = order
    return out


@pytest.mark.parametrize("broadcast_queries", [1_000, 0])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_search_is_exact(spark, vectors, k, broadcast_queries):
    x, df = vectors
    spark.conf.set("spark.corpusflow.blockQueries", "64")
    spark.conf.set("spark.corpusflow.blockVectors", "50")
    hits = se.search(df.withColumnRenamed("id", "chunk_id"), df.withColumnRenamed("id", "qid"), k, vec_col="v", qvec_col="v",
                     broadcast_queries=broadcast_queries)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == brute(x, k)
    spark.conf.unset("spark.corpusflow.blockQueries")
    spark.conf.unset("spark.corpusflow.blockVectors")


def test_search_string_ids_and_empty_sides(spark, vectors):
    _, df = vectors
    named = df.select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("v").alias("embedding"))
    queries = df.select(F.concat(F.lit("q"), "id").alias("qid"), F.col("v").alias("qvec"))
    # all copies of vector 0 find "c0", the first of the equal ids; the others find themselves
    found = {r.qid: r.chunk_id for r in se.search(named, queries, 1).collect()}
    assert found == {f"q{i}": f"c{i if i < 200 else 0}" for i in range(300)}
    assert se.search(named.where("false"), queries, 3).count() == 0
    assert se.search(named, queries.where("false"), 3).count() == 0
    assert se.search(named, queries.where("false"), 3, broadcast_queries=0).count() == 0


def test_small_steps_give_the_same(spark, vectors, monkeypatch):
    x, _ = vectors
    best = se._Best(5)
    monkeypatch.setattr(se, "_CELL", 300 * 7)
    for start in range(0, 300, 11):
        best.add(x, x[start:start + 11], np.arange(start, min(300, start + 11)))
    got = {}
    for q, i in zip(best.q, best.ids):
        got.setdefault(int(q), []).append(int(i))
    assert got == brute(x, 5)


@pytest.mark.parametrize("broadcast_queries", [1_000, 0])
def test_within_radius(spark, vectors, broadcast_queries):
    x, df = vectors
    df = df.where("id < 200")
    spark.conf.set("spark.corpusflow.broadcastQueries", str(broadcast_queries))
    pairs = se.within_radius(df.withColumnRenamed("id", "chunk_id"), df.withColumnRenamed("id", "qid"), 4.0, vec_col="v", qvec_col="v")
    got = {(r.qid, r.chunk_id) for r in pairs.collect()}
    spark.conf.unset("spark.corpusflow.broadcastQueries")
    d = ((x[:200, None] - x[None, :200]) ** 2).sum(2)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 4.0))}


def test_unique_first(spark):
    hits = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 0, 1, "b")],
                                 "q long, query_pos int, rank int, chunk_id string")
    got = se.unique_first(hits, "q", "chunk_id", ["query_pos", "rank"]).orderBy("q", "rank").select("q", "rank", "chunk_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "b")]


def test_rerank_ties_keep_their_order_and_models_plug_in(spark):
    hits = spark.createDataFrame([(1, 1, "x", "n"), (1, 2, "x", "x y"), (1, 3, "x", "x z"), (1, 4, "x", "x")],
                                 "qid long, rank int, query string, passage string")
    got = [(r.rank, r.passage) for r in se.rerank(hits, top_n=3).orderBy("rank").collect()]
    assert got == [(1, "x"), (2, "x y"), (3, "x z")]

    def length(q: pd.Series, p: pd.Series) -> pd.Series:
        return p.str.len().astype("float64")
    got = [(r.rank, r.passage) for r in se.rerank(hits, se.model_scorer(length), 2).orderBy("rank").collect()]
    assert got == [(1, "x y"), (2, "x z")]
    assert se.rerank(hits.where("false")).count() == 0


def test_merge_indexes(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, doc_id string")
    b = spark.createDataFrame([(0, "b"), (1, "c")], "pos long, doc_id string")
    vectors, documents = se.merge_indexes(a, b)
    assert sorted((r.pos, r.doc_id) for r in vectors.collect()) == [(0, "a"), (1, "b"), (2, "b"), (3, "c")]
    assert sorted((r.pos, r.doc_id) for r in documents.collect()) == [(0, "a"), (1, "b"), (3, "c")]
    vectors, _ = se.merge_indexes(a.where("false"), b)
    assert sorted(r.pos for r in vectors.collect()) == [0, 1]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    out = {r.id: r.embedding for r in embed(df, "t").collect()}
    assert abs(sum(v * v for v in out[1]) - 1) < 1e-6 and sum(v > 0 for v in out[1]) <= 2
    assert set(out[2]) == {0.0} and set(out[3]) == {0.0}
    assert check_dim(embed(df, "t"), 64).count() == 0

    def load():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype="float32")
        return predict
    got = embed(df.where("id = 1"), "t", embedder=model_embedder(load)).first().embedding
    assert got == [5.0, 1.0]


def test_multi_search_over_text(spark):
    from corpusflow.plans.retrieve import context_of_hits, document_chunks, multi_search
    docs = spark.createDataFrame([(1, "red apples and pears", "a"), (2, "blue whales", "b"), (3, "apples", "c")], "doc_id long, text string, source string")
    index = embed(document_chunks(docs), "page_content")
    questions = spark.createDataFrame([("x:1", ["apples", "blue whales", "apples"]), ("y", ["whales"])], "question_id string, search_queries array<string>")
    hits = multi_search(index, questions, top_k=2, top_n=1)
    got = [(r.question_id, r["rank"], r.chunk_id) for r in hits.orderBy("question_id", "rank").collect()]
    assert got == [("x:1", 1, "3#0"), ("x:1", 2, "2#0"), ("y", 1, "2#0")]
    contexts = {r.question_id: r.context for r in context_of_hits(hits, "question_id").collect()}
    assert contexts["x:1"] == "<doc id='0'>apples</doc>\n<doc id='1'>blue whales</doc>"


# --- vectors that are not whole, carried bounds, stored cells ---------------------------------------

@pytest.mark.parametrize("broadcast_queries", [1_000, 0])
def test_rows_without_a_whole_vector_are_left_out(spark, broadcast_queries):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [None, 1.0]), (5, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    hits = se.search(df.withColumnRenamed("id", "chunk_id"), df.withColumnRenamed("id", "qid"), 2, vec_col="v", qvec_col="v",
                     broadcast_queries=broadcast_queries)
    got = {(r.qid, r["rank"]): r.chunk_id for r in hits.collect()}
    assert got == {(1, 1): 1, (1, 2): 5, (3, 1): 3, (3, 2): 5, (5, 1): 5, (5, 2): 1}
    nothing = df.where("id in (2, 4)")
    assert se.search(nothing.withColumnRenamed("id", "chunk_id"), df.withColumnRenamed("id", "qid"), 2, vec_col="v", qvec_col="v",
                     broadcast_queries=broadcast_queries).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "chunk_id long, v array<float>").coalesce(1)
    with pytest.raises(Exception, match="vectors of different lengths"):
        se.search(mixed, df.withColumnRenamed("id", "qid"), 1, vec_col="v", qvec_col="v", broadcast_queries=broadcast_queries).collect()


def test_the_bound_is_carried_from_the_own_cell(spark, monkeypatch):
    """Well parted clusters: cells other than the query's own hand over next to nothing."""
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(20, 6)) * 40, 50, axis=0) + rng.normal(size=(1000, 6))).astype("float32")
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    seen = {}
    met = se._met

    def counted(*args):
        out = met(*args)
        seen[len(seen)] = out
        return out
    monkeypatch.setattr(se, "_met", counted)
    hits = se.search(df, df.withColumnRenamed("id", "qid"), 10, id_col="id", vec_col="vec", qvec_col="vec", broadcast_queries=0)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == brute(x.astype("float64"), 10)
    own, others = (seen[i].count() for i in (0, 1))
    assert own <= 10 * 1000 and own + others < 2 * 10 * 1000  # all cells would hand over 64 times as many


def test_cells_are_stored_once(spark, vectors):
    x, df = vectors
    cells = se.store_cells(df, "id", "v", 17)
    assert len(cells.centres) == 17 and cells.sizes.sum() == 300 and cells.vectors.where("vec is null").count() == 0
    schema, ddl = se._arrow_schema(df.schema["id"].dataType, df.schema["id"].dataType), "qid long, id long, d2 double"
    asked = df.select(F.col("id").alias("qid"), F.col("v").alias("vec"))
    for k in (3, 7):
        pairs = se._search_cells(cells, asked.where(f"qid % {k} = 0"), k, None, schema, ddl)
        got = {}
        for r in se.top_rows(pairs, ["qid"], [F.round("d2", 9), F.col("id")], k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == {q: v for q, v in brute(x, k).items() if q % k == 0}
    assert se.store_cells(df.where("false"), "id", "v") is None


def test_a_row_travels_once_per_pack_not_once_per_cell(spark, monkeypatch):
    """Vectors without clusters, where no cell is ruled out: the 64 cells fit one pack."""
    x = np.random.default_rng(8).normal(size=(700, 16)).astype("float32")
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    pairs = []
    met = se._met
    monkeypatch.setattr(se, "_met", lambda *args: pairs.append(args[2].count()) or met(*args))
    hits = se.search(df, df.withColumnRenamed("id", "qid"), 5, id_col="id", vec_col="vec", qvec_col="vec", broadcast_queries=0)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == brute(x.astype("float64"), 5)
    assert pairs[0] == 64 and pairs[1] == 1  # 64 * 63 before


def test_hits_are_sorted_in_seldom(monkeypatch):
    x = np.random.default_rng(9).normal(size=(2_000, 8))
    sorts = []
    lexsort = np.lexsort
    monkeypatch.setattr(se, "_CELL", 400 * 20)
    monkeypatch.setattr(se.np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    best = se._Best(5)
    best.add(x[:400], x, np.arange(2_000))
    assert best.q is not None and len(sorts) < 25  # one per 20 vectors before
    monkeypatch.undo()
    got = {}
    for q, i in zip(best.q, best.ids):
        got.setdefault(int(q), []).append(int(i))
    assert got == {q: v for q, v in brute(x, 5).items() if q < 400}


@pytest.mark.parametrize("shift, scale", [(0, 1), (30, 0.01), (0, 1e-9), (0, 1e18), (5, 1e-4)])
def test_single_precision_loses_no_hit(shift, scale):
    rng = np.random.default_rng(10)
    x = shift + scale * rng.normal(size=(900, 12))
    d = se._distances(x[:50], x)
    best = se._Best(6, np.sort(d, 1)[:, 40].copy())
    best.add(x[:50], x, np.arange(900))
    assert np.allclose(best.d, np.sort(d, 1)[:, :6].ravel(), rtol=1e-9, atol=1e-9)
    edge = float(np.median(d))
    found = sum(len(rows) for rows, _, _ in se._near(x[:50], x, np.full(50, edge)))
    assert found >= (d <= edge).sum()


# --- queries of equal vectors, rounds, texts of what is kept ------------------------------------------

def by_query(hits):
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    return got


def test_queries_of_equal_vectors_are_searched_once(spark, vectors, monkeypatch):
    x, df = vectors
    searched = []
    pairs = se._pairs
    monkeypatch.setattr(se, "_pairs", lambda index, queries, *args: searched.append(queries.count()) or pairs(index, queries, *args))
    index, queries = df.select(F.col("id").alias("chunk_id"), "v"), df.select(F.col("id").alias("qid"), "v")
    assert by_query(se.search(index, queries, 4, vec_col="v", qvec_col="v")) == brute(x, 4)
    assert searched == [200]  # 300 before
    # an id that comes twice, with one vector and with two, is ranked as one query
    twice = queries.where("qid in (0, 1, 250)").unionByName(queries.where("qid = 1")).unionByName(queries.where("qid = 2").withColumn("qid", F.lit(0).cast("long")))
    got = by_query(se.search(index, twice, 3, vec_col="v", qvec_col="v"))
    assert got == {0: [0, 2, 200], 1: [1, 1, brute(x, 2)[1][1]], 250: [0, 200, 201]}


@pytest.mark.parametrize("k", [6, None])
def test_blocks_are_shuffled_in_rounds(spark, monkeypatch, k):
    x = np.random.default_rng(16).normal(size=(300, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    settings = {"broadcastQueries": "0", "blockQueries": "64", "blockVectors": "50", "roundRows": "700"}
    for key, value in settings.items():
        spark.conf.set(f"spark.corpusflow.{key}", value)
    shuffled = []
    met = se._met
    monkeypatch.setattr(se, "_met", lambda left, right, pairs, *args: shuffled.append(pairs.count()) or met(left, right, pairs, *args))
    cols = {"id_col": "id", "vec_col": "vec", "qvec_col": "vec"}
    if k:
        got = by_query(se.search(df, df.withColumnRenamed("id", "qid"), k, **cols).withColumnRenamed("id", "chunk_id"))
        assert got == brute(x.astype("float64"), k)
    else:
        d = ((x[:, None].astype("float64") - x[None]) ** 2).sum(2)
        pairs = se.within_radius(df, df.withColumnRenamed("id", "qid"), 9.0, **cols).collect()
        assert sorted((r.qid, r.id) for r in pairs) == sorted(zip(*(i.tolist() for i in np.nonzero(d <= 9.0))))
    for key in settings:
        spark.conf.unset(f"spark.corpusflow.{key}")
    assert len(shuffled) > 4 and max(shuffled[1:]) < 20  # all packs at once before


def test_texts_are_fetched_for_what_is_kept(spark, monkeypatch):
    from corpusflow.plans import retrieve as rt
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 6)) for _ in range(40)]
    rows = [(f"c{i}", t, {"source": "s"}, [float(i % 7), float(i % 5)]) for i, t in enumerate(texts)]
    rows += [rows[3], ("c4", "w1 w2 other", {"source": "t"}, [4.0, 4.0])]  # a row twice, an id with two texts
    index = spark.createDataFrame(rows, "chunk_id string, page_content string, metadata map<string,string>, embedding array<float>")
    asked = [(i, " ".join(rng.choice(words, 4)), [float(i % 7), float(i % 5)]) for i in range(12)]
    queries = spark.createDataFrame([*asked, asked[5], (6, None, [1.0, 1.0])], "qid long, query string, qvec array<float>")
    columns = ["qid", "chunk_id", "relevance_score", "page_content", "metadata", "query"]
    hits = se.search(index, queries, 8)
    before = hits.join(index.select("chunk_id", "page_content", "metadata"), "chunk_id").join(queries.select("qid", "query"), "qid")
    scores = se.rerank(before, top_n=3, passage="page_content").select("qid", F.round("relevance_score", 6).alias("s")).collect()
    seen = []
    rerank = rt.rerank
    monkeypatch.setattr(rt, "rerank", lambda df, *args, **kwargs: seen.append(df.columns) or rerank(df, *args, **kwargs))
    spark.conf.set("spark.corpusflow.pairRows", "40")
    best = rt.retrieve_rerank(index, queries, 8, 3)
    spark.conf.unset("spark.corpusflow.pairRows")
    got = [tuple(r) for r in best.select(*columns).collect()]
    assert sorted((r[0], round(r[2], 6)) for r in got) == sorted((r.qid, r.s) for r in scores)
    assert {r[:2] + r[3:4] + r[5:] for r in got} <= {(r.qid, r.chunk_id, r.page_content, r.query) for r in before.collect()}
    assert len(seen) > 2 and not any({"page_content", "metadata", "query"} & set(c) for c in seen)
